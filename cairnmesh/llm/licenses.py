"""License scans by diagonal voting.

Templates are phrases (whose words must stand consecutively) and longer notices
(of which enough must stand). Every run of k words of a text is hashed in place
(k is 2 for phrases, 3 for notices); a bitmap of the templates' hashes lets
through those that may be known and a few others, and these are joined to the
template positions by hash, then compared by their words. Each hit of word i on
position j votes for the diagonal i - j. A phrase stands where one diagonal has
all its grams. A notice's neighbouring diagonals (inserted or missing words
shift them) are merged, and the span is verified: the share of the template's
words that its hits cover decides.

Texts are read once; what goes on is a row a text with its few candidates, keyed
by a number that this table gives each row. Templates are a parameter: their
positions are broadcast where they measure few.

Words are as in ``winnow``: runs outside \\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F, A-Z as
a-z. Defined cases: a null or empty text has no words, labels or places and
score 0; a text of any length is one array of words and hashes; repeated rows
are scanned each on its own; templates of fewer words than k are taken as runs
of all their words, those without words are none; an empty table gives an empty
table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .importance import _LOW, _UP
from .store import Scratch, small
from .winnow import words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: A phrase stands word for word; of a notice SHARE of the words must stand.
    phrase: bool = False


#: Words in a gram of a phrase, of a notice.
PHRASE_GRAM, GRAM = 2, 3
#: Least covered share of a notice, and how far diagonals of one span may lie apart: a third of the template, at most DRIFT words.
SHARE, DRIFT = 0.6, 8
#: Longs in the bitmap of gram hashes (64 bits each; a power of two).
SIEVE = 2048

# Phrases and labels of the scan's contract, then the wording of public license notices.
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def _gram(h: str, k: int) -> str:
    return "xxhash64(" + ", ".join(f"get({h}, i + {j})" for j in range(k)) + ")"


def positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, label, phrase, size, k, j, g, s): every gram of every template, its hash and its words."""
    rows = spark.createDataFrame([(i, t.label, t.phrase, t.text) for i, t in enumerate(templates)], "template int, label string, phrase boolean, text string")
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("size", F.size("w")).where("size > 0")
    rows = rows.withColumn("k", F.least("size", F.when(F.col("phrase"), PHRASE_GRAM).otherwise(GRAM))).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    each = rows.select("template", "label", "phrase", "size", "k", "w", "h", F.explode(F.expr("sequence(0, size - k)")).alias("j"))
    hashed = F.coalesce(*[F.when(F.col("k") == k, F.expr(_gram("h", k).replace("i +", "j +"))) for k in range(1, max(GRAM, PHRASE_GRAM) + 1)])
    return each.select("template", "label", "phrase", "size", "k", "j", hashed.alias("g"), F.concat_ws(" ", F.slice("w", F.col("j") + 1, F.col("k"))).alias("s"))


def _sieve(hashes: list[int]) -> Column:
    """An array of longs in which bit g mod 64 of long (g div 64) mod SIEVE is set for each hash."""
    bits = [0] * SIEVE
    for g in hashes:
        bits[(g >> 6) & (SIEVE - 1)] |= 1 << (g & 63)
    return F.lit([b - (1 << 64) if b >> 63 else b for b in bits])


def candidates(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, cand): the places of each row's grams that the bitmap lets through, with their hashes and words."""
    known = [(r.k, r.g) for r in grams.select("k", "g").distinct().collect()]  # as many as the templates have words
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    rows = rows.withColumn("h", F.expr("transform(w, x -> xxhash64(x))")).withColumn("sieve", _sieve([g for _, g in known]))
    found = [F.expr("cast(array() as array<struct<i:int,k:int,g:bigint,s:string>>)")]
    for k in sorted({k for k, _ in known}):
        every = f"case when size(h) < {k} then array() else transform(sequence(0, size(h) - {k}), i -> struct(i as i, {_gram('h', k)} as g)) end"
        some = f"filter({every}, x -> (shiftright(get(sieve, cast((shiftright(x.g, 6) & {SIEVE - 1}) as int)), cast(x.g & 63 as int)) & 1) = 1)"
        found.append(F.expr(f"transform({some}, x -> struct(x.i as i, {k} as k, x.g as g, concat_ws(' ', slice(w, x.i + 1, {k})) as s))"))
    return rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(*found).alias("cand"))


def spans(spark: SparkSession, docs: DataFrame, templates: tuple[Template, ...], scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a written table (rid, doc_id, n_words) with a row for each of docs, and (rid, template, label, phrase, begin, end, share).

    begin and end are words from 0, end exclusive; share is the part of the
    template's words that stands there, verified word by word (1 for phrases).
    """
    scratch = scratch or Scratch(spark, "licenses")
    grams = scratch.keep(positions(spark, templates), "positions")
    rows = scratch.keep(candidates(docs, grams), "candidates")
    hits = rows.select("rid", F.explode("cand").alias("c")).select("rid", "c.*").join(small(grams).withColumnRenamed("s", "t"), ["k", "g"]).where("s = t")
    hits = hits.select("rid", "template", "label", "phrase", "size", "k", "i", "j", (F.col("i") - F.col("j")).alias("d"))
    own = ["rid", "template", "label", "phrase", "size", "k"]
    voted = scratch.keep(hits.groupBy(*own, "d").agg(F.collect_set("j").alias("js")), "diagonals")  # at most a template's positions each

    whole = voted.where("phrase and size(js) = size - k + 1").select("rid", "template", "label", "phrase", F.col("d").alias("begin"), (F.col("d") + F.col("size")).alias("end"), F.lit(1.0).alias("share"))

    run = Window.partitionBy("rid", "template").orderBy("d")
    apart = F.col("d") - F.lag("d").over(run) > F.least(F.lit(DRIFT), F.floor(F.col("size") / 3))
    near = voted.where("not phrase").withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.transform("js", lambda j: F.sequence(j, j + F.col("k") - 1))
    near = near.select(*own, "span", F.array_distinct(F.flatten(held)).alias("at"), (F.col("d") + F.array_min("js")).alias("b"), (F.col("d") + F.array_max("js") + F.col("k")).alias("e"))
    # positions of the merged diagonals, each once
    each = near.select(*own, "span", "b", "e", F.explode("at").alias("p")).groupBy(*own, "span").agg(F.count_distinct("p").alias("covered"), F.min("b").alias("begin"), F.max("e").alias("end"))
    part = each.select("rid", "template", "label", "phrase", "begin", "end", (F.col("covered") / F.col("size")).alias("share"))
    return rows.select("rid", "doc_id", "n_words"), whole.unionByName(part)


def scan(spark: SparkSession, docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs.

    A notice gives its label where at least SHARE of its words stand; the score
    is the largest share of any template, accepted or not.
    """
    scratch = scratch or Scratch(spark, "licenses")
    rows, found = spans(spark, docs, (*base, *notices), scratch)
    own = F.col("template") < len(base)
    named = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    judged = found.groupBy("rid").agg(
        F.count(F.when(own, 1)).alias("n_base"), F.min(F.when(own, F.col("begin"))).cast("long").alias("first_word"), F.max(F.when(own, F.col("begin"))).cast("long").alias("last_word"),
        named(own).alias("base_labels"), named(F.col("share") >= SHARE).alias("labels"), F.max("share").alias("score"),
    )
    judged = small(scratch.keep(judged, "judged"))
    out = rows.join(judged, "rid", "left")
    filled = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *[(F.coalesce(F.col(c), filled[c]) if c in filled else F.col(c)).alias(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ROWS = ", ".join(f"({i}, {_text(t.label)}, {str(t.phrase).lower()}, {_text(t.text)})" for i, t in enumerate((*BASE, *NOTICES)))

#: The same rows in DuckDB's SQL, grams compared as words.
ORACLE = rf"""
with doc as (select row_number() over () as rid, doc_id, {_SPLIT} as w from documents),
template as (select *, len(w) as size, least(len(w), case when phrase then {PHRASE_GRAM} else {GRAM} end) as k from (select t, label, phrase, {_SPLIT} as w from (values {_ROWS}) as v(t, label, phrase, text))),
position as (select t, label, phrase, size, k, j - 1 as j, array_to_string(w[j : j + k - 1], ' ') as s from (select *, unnest(range(1, size - k + 2)) as j from template)),
gram as (select rid, k, i - 1 as i, array_to_string(w[i : i + k - 1], ' ') as s from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from doc, (select distinct k from template) where len(w) >= k)),
hit as (select distinct rid, t, label, phrase, size, k, i - j as d, j from gram join position using (k, s)),
whole as (select rid, t, label, d as b, 1.0::double as share from hit where phrase group by rid, t, label, d, size, k having count(*) = size - k + 1),
diagonal as (select *, d - lag(d) over (partition by rid, t order by d) > least({DRIFT}, size // 3) as apart from (select distinct rid, t, label, size, d from hit where not phrase)),
merged as (select *, sum(case when coalesce(apart, true) then 1 else 0 end) over (partition by rid, t order by d rows unbounded preceding) as span from diagonal),
part as (select rid, t, label, null as b, count(distinct p) / size as share from (select m.*, unnest(range(h.j, h.j + h.k)) as p from merged m join hit h using (rid, t, d)) group by rid, t, label, size, span),
found as (select *, t < {len(BASE)} as own from (select * from whole union all select * from part)),
judged as (select rid, count(*) filter (own) as n_base, min(b) filter (own) as first_word, max(b) filter (own) as last_word,
  string_agg(distinct label, ',' order by label) filter (own) as base_labels, string_agg(distinct label, ',' order by label) filter (share >= {SHARE}) as labels, max(share) as score from found group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from doc left join judged using (rid)
"""
