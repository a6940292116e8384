import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmesh.llm import jaccard, store
from cairnmesh.llm.components import smallest_reachable
from cairnmesh.llm.store import Scratch
from cairnmesh.llm.text import BLOCK, SPACE, word_hashes, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("limits", [(512, 1 << 20), (4, 1 << 20)])
def test_classes_match_brute_force(spark, docs, monkeypatch, limits):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", limits[0])
    got = jaccard.jaccard_classes(spark, docs).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_dense_group_in_blocks(spark, monkeypatch):
    """Sets around the threshold, in blocks of a few: rings, windows and recursion all get work."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    monkeypatch.setattr(store, "BROADCAST_BYTES", 1)
    r = np.random.default_rng(1)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.integers(0, 40, r.integers(0, 5)):
            w[k] = f"v{r.integers(0, 4)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_classes(spark, df).collect()} == want


@pytest.mark.parametrize("limit", [32 << 20, 1])
def test_split_anchors_match_brute_force(spark, docs, monkeypatch, limit):
    """Every anchor that two sets share is split; the classes are the same."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "SPLIT_LEAST", 2)
    monkeypatch.setattr(store, "BROADCAST_BYTES", limit)
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(spark, docs).collect() if r.doc_id is not None}
    assert got == want


def test_rows_of_a_frequent_anchor_are_dealt_over_all_tasks(spark):
    anchors = spark.range(8_000).selectExpr("id as node", "40L as n", "0 as i", "if(id % 4 = 0, id, -7L) as s")
    split = jaccard._frequent(anchors)
    assert [r.s for r in split.collect()] == [-7]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = jaccard._shared(anchors, split).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(r["count"] for r in dealt) == 6_000 and max(r["count"] for r in dealt) < 2 * 6_000 / len(dealt) and len(dealt) > 1


def test_one_each_and_empty(spark, docs, none):
    kept = jaccard.one_each(spark, docs)
    assert kept.columns == docs.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c in want.values()})
    assert jaccard.jaccard_classes(spark, none).count() == 0
    assert jaccard.one_each(spark, none).count() == 0


def test_rows_of_one_id_and_rows_without_id_link_by_their_texts(spark):
    """Nodes are sets: an id with two texts links both, rows without an id link like others, user columns of any name come back."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (None, near(c)), (None, near(c)), (5, near(a)), (6, None), (6, None), (7, "")]
    df = spark.createDataFrame([(*r, "keepme", "keepme", i) for i, r in enumerate(rows)], "doc_id long, text string, __id string, node string, th long")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(spark, df).collect()}
    assert got == {(1, 36, 1), (2, 37, 1), (3, 37, 1), (5, 37, 1), (None, 36, None), (None, 37, None), (6, 0, 6), (7, 0, 7)}
    kept = jaccard.one_each(spark, df)
    assert kept.columns == df.columns and {(r["__id"], r.node) for r in kept.collect()} == {("keepme", "keepme")}
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept.collect()) == [(0, "c"), (1, "a"), (1, "b"), (6, ""), (7, "")]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "u long, v long")
    got = {r.node: r.label for r in smallest_reachable(Scratch(spark, "t"), e).collect()}
    want = defaultdict(int) | {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert got == dict(want)


def test_word_hashes_do_not_depend_on_blocks():
    text = ("The quick brown fox " * 70_000).encode()
    assert len(text) > BLOCK
    whole = word_hashes(text)
    assert len(whole) == 280_000 and len(set(whole.tolist())) == 4
    short, first = words([b"the QUICK", b"", b"brown fox"])
    assert list(first) == [0, 2, 2, 4] and set(short.tolist()) == set(whole.tolist())
    long_word = b"a" * (BLOCK + 10)
    assert len(word_hashes(b"x " + long_word + b" y", SPACE)) == 3
