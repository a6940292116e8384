"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the smallest hash of each run of SPAN - GRAM + 1
word-grams of GRAM words. A span of SPAN words that a document and an item
share has the same grams in both, hence the same smallest one: no shared span
is missed. Fingerprints that a document shares with the benchmark are extended:
the windows of SPAN words around each place of such a gram, and only those, are
looked up among the benchmark's windows. Items of fewer words than a window are
one window, whose first gram (GRAM words, or all if fewer) is its fingerprint;
documents then look up all their grams of that many words.

Windows are compared by two 64-bit hashes, one of word hashes and one of the
words themselves. Tables go to every task only where their bytes are measured to
be few, else joins are shuffled and Spark splits their hot keys.

Words are maximal runs of characters outside \\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F,
A-Z as a-z. Defined cases: a null or empty text has no words, no hits and is
not contaminated; an item without words is no item; rows repeating a doc_id
are judged each by its own text; equal item ids count once; a null item id
counts as the empty string. Other columns are not read, whatever their names,
and are returned where documents are filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch, packed, small

SPAN, GRAM = 13, 5
#: Contaminated: 20 * n_hit >= n_words.
SHARE = 20
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words in order; an empty array for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UP, _LOW)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _grams(hashes: str, k: int) -> str:
    """SQL for the hashes of all grams of k words of an array of word hashes."""
    parts = ", ".join(f"get({hashes}, i + {j})" for j in range(k))
    return f"case when size({hashes}) < {k} then cast(array() as array<bigint>) else transform(sequence(0, size({hashes}) - {k}), i -> xxhash64({parts})) end"


def _smallest(grams: Column, run: int) -> Column:
    """The distinct smallest values of each `run` neighbours: minima of 1, 2, 4... neighbours are joined in pairs (least skips what lies beyond the end)."""
    size = F.size(grams)
    least, width = grams, 1
    while width < run:
        step = min(width, run - width)
        least = F.zip_with(least, F.slice(least, step + 1, size), lambda x, y: F.least(x, y))
        width += step
    return F.when(size >= run, F.array_distinct(F.slice(least, 1, size - (run - 1)))).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """keep..., words w and their hashes h of each text."""
    return df.select(*keep, words(F.col("text")).alias("w")).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, with_row: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and rid, a hash of id and text) for each row of docs."""
    scratch = scratch or Scratch(spark, "winnow")
    tests = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    tests = scratch.keep(_hashed(tests, "item_id").where("size(w) > 0"), "items")
    short = sorted(r[0] for r in tests.select(F.size("h").alias("m")).where(f"m < {SPAN}").distinct().collect())  # 12 values at most
    widths = sorted({min(m, GRAM) for m in short})

    # (f, m): a fingerprint of the benchmark, and the size of the windows that it stands for
    known = [tests.where(f"size(h) >= {SPAN}").select(F.explode(_smallest(F.expr(_grams("h", GRAM)), SPAN - GRAM + 1)).alias("f"), F.lit(SPAN).alias("m"))]
    known += [tests.where(f"size(h) = {m}").select(F.expr(f"get({_grams('h', min(m, GRAM))}, 0)").alias("f"), F.lit(m).alias("m")) for m in short]
    both = known[0]
    for k in known[1:]:
        both = both.unionByName(k)
    known = scratch.keep(both.distinct(), "known")
    named = small(scratch.keep(known.select("f").distinct(), "fingerprints-known"))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), F.col("text").cast("string").alias("text"))
    rows = _hashed(texts, "doc_id", "rid").withColumn("n_words", F.size("w").cast("long")).withColumn("g", F.expr(_grams("h", GRAM)))
    # all grams of a short item's width, else only the smallest of each run
    own = [F.col("g") if GRAM in widths else _smallest(F.col("g"), SPAN - GRAM + 1), *[F.expr(_grams("h", k)) for k in widths if k < GRAM]]
    rows = scratch.keep(rows.select("doc_id", "rid", "n_words", F.array_distinct(F.concat(*own)).alias("fp")), "fingerprints")
    shared = scratch.keep(rows.select("rid", F.explode("fp").alias("f")).join(named, "f", "left_semi").distinct(), "shared")

    # extension: the windows around each place of a shared fingerprint against the benchmark's
    marked = small(scratch.keep(shared.select("rid").distinct(), "marked"))
    near = _hashed(texts.join(marked, "rid", "left_semi").dropDuplicates(["rid"]), "rid")
    grams = [near.select("rid", F.size("h").alias("n"), F.posexplode(F.expr(_grams("h", k))).alias("p", "f")) for k in sorted({GRAM, *widths})]
    every = grams[0]
    for g in grams[1:]:
        every = every.unionByName(g)
    places = every.join(small(shared), ["rid", "f"]).join(small(known), "f")
    start = F.expr(f"case when m < {SPAN} then array(p) else sequence(least(greatest(p - {SPAN - GRAM}, 0), n - {SPAN}), least(p, n - {SPAN})) end")
    starts = places.where("n >= m").select("rid", "m", "n", F.explode(start).alias("at")).where("at + m <= n")
    starts = small(scratch.keep(starts.groupBy("rid").agg(F.collect_set(F.struct("at", "m")).alias("starts")), "starts"))

    def looked_up(df: DataFrame, *keep: str) -> DataFrame:
        """(keep..., at, m, key of the window of m words at `at`)."""
        df = df.select(*keep, "h", "w", F.explode("starts").alias("s")).select(*keep, "h", "w", "s.at", "s.m")
        some = F.slice("w", F.col("at") + 1, F.col("m"))
        return df.select(*keep, "at", "m", F.xxhash64(F.slice("h", F.col("at") + 1, F.col("m"))).alias("k1"), F.xxhash64(F.concat_ws(" ", some)).alias("k2"))

    each = F.expr(f"transform(sequence(0, size(h) - least(size(h), {SPAN})), i -> struct(i as at, least(size(h), {SPAN}) as m))")
    test_windows = scratch.keep(looked_up(tests.withColumn("starts", each), "item_id").drop("at").distinct(), "windows")
    found = looked_up(near.join(starts, "rid"), "rid").join(small(test_windows), ["m", "k1", "k2"])
    found = scratch.keep(found.select("rid", "at", "m", "item_id").distinct(), "found")

    before = Window.partitionBy("rid").orderBy("at", "m").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("rid", "at", "m").distinct().withColumn("end", F.col("at") + F.col("m")).withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("at", "seen"))).cast("long").alias("hit"))
    named = found.select("rid", "item_id").distinct().groupBy("rid").agg(F.count("*").alias("items"), F.concat_ws(",", F.array_sort(F.collect_list("item_id"))).alias("list"))
    judged = covered.join(named, "rid")
    out = rows.select("doc_id", "rid", "n_words").join(judged, "rid", "left")
    out = out.select("doc_id", *(["rid"] if with_row else []), "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns and no others."""
    bad = hits(spark, docs, items, with_row=True).where("contaminated").select(F.col("rid").alias("bad"), F.col("doc_id").alias("bad_id")).distinct()
    bad = small(Scratch(spark, "contaminated").keep(bad))
    held = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("id"), packed(docs))
    return held.join(bad, (F.col("rid") == F.col("bad")) & F.col("id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")


#: The same rows in DuckDB's SQL: every window of a document against every window of an item.
ORACLE = rf"""
with doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_window as (select distinct item_id, least(len(w), {SPAN}) as m, array_to_string(w[i : i + least(len(w), {SPAN}) - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) as i from item where len(w) > 0)),
width as (select distinct m from item_window),
doc_window as (select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') as s from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from doc, width where len(w) >= m)),
found as (select doc_id, i, m, item_id from doc_window join item_window using (m, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (doc_id) left join named using (doc_id)
"""
