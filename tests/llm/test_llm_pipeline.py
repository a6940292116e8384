"""The pipeline's stages, each on what its predecessor kept, against plain Python; edge cases included."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnmesh.llm import quality, toxic
from cairnmesh.llm.store import Scratch

from test_llm_formats import brute_hits
from test_llm_jaccard import brute

CLASH = {c: "keepme" for c in ("__id", "rid", "row", "e", "h", "score", "kept", "node", "th", "doc", "text2")}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents (null ids and texts, repeated rows, copies, contaminated and toxic texts, columns of any name), labels and benchmark."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(r.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)] + [(9, None), (8, "")]
    rows, labels = [], []
    for i in range(240):
        t = text(r.randrange(30, 90))
        bad, junk = i % 6 == 0, i % 5 == 0
        t = f"{t} vilescum {text(3)} hatefulrot" if bad else t
        t = "### &&& === " * 20 if junk and i % 10 else t
        rows.append([i, t, ["en", "de", None][i % 3], f"s{i % 4}"])
        labels.append((i, int(not (junk and i % 10)), int(bad)))
    rows += [[1000 + i, rows[7 + i][1], "en", "s1"] for i in range(6)] + [[2000 + i, rows[17][1] + " tail", "en", "s1"] for i in range(4)]
    rows += [[3000 + i, f"{text(6)} {items[i % 5][1]} {text(6)}", "en", "s2"] for i in range(8)]
    rows += [rows[7], rows[8], [None, text(40), "en", "s1"], [None, rows[11][1], "en", "s1"], [4000, None, None, None], [4001, "", "en", "s1"], [4001, "", "en", "s1"], [4002, text(5000), "en", "s3"]]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string").withColumns({c: F.lit(v) for c, v in CLASH.items()})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def bag(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in rows)


def test_stages(spark, tables):
    folder, items = tables
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        got = scratch.keep(stage(spark, docs, folder), name.replace(" ", "-"))
        before, after = docs.collect(), got.collect()
        if name != "packing":
            assert got.columns == docs.columns and all(r[c] == v for r in after for c, v in CLASH.items())
        if name == "quality classifier":
            probability = {}
            for x in quality.Posterior(spark, docs, labels).judged().collect():
                probability.setdefault(x.doc_id, []).append(x.kept)
            sure = {i for i, k in probability.items() if all(k)}
            assert len(after) == sum(sum(k) for k in probability.values()) and {r.doc_id for r in after} >= sure
            assert not any((r.text or "").startswith("###") for r in after)
        elif name == "toxicity":
            net = toxic.train(spark, docs, labels)
            scores = toxic._scores(net, [(r.text or "").encode() for r in before])
            want = [r for r, s in zip(before, scores, strict=True) if s < net.thresholds.get(r.lang or "", net.thresholds.get("", toxic.CUT))]
            assert bag(after) == bag(want) and not any("vilescum" in (r.text or "") for r in after)
        elif name == "n-gram Jaccard join":
            ids = {i: (r.doc_id, r.text) for i, r in enumerate(sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")))}
            classes = brute([(i, t) for i, (_, t) in ids.items()])
            reps = {top for _, top in classes.values()}
            want = {ids[i] if ids[i][0] is not None else ids[i][1] for i in reps}
            have = [(r.doc_id, r.text) if r.doc_id is not None else r.text for r in after]
            assert set(have) == want and len(have) == len(want)
        elif name == "benchmark decontamination":
            want = [r for r in before if not brute_hits(r.text, items)[4]]
            assert bag(after) == bag(want) and len(after) < len(before)
        else:
            tokens = {}
            for r in after:
                tokens.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
            assert all(sum(n for _, n in some) % key[1] == 0 for key, some in tokens.items()) and {k[0] for k in tokens} == {r.doc_id for r in before}
            used = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
            assert all(u.n == u.end <= 2048 for u in used)
        seen[name] = len(after)
        docs = got
    assert seen["quality classifier"] > seen["toxicity"] > seen["n-gram Jaccard join"] > seen["benchmark decontamination"] > 0


def test_run_is_its_stages_and_empty_tables_pass(spark, tables, tmp_path):
    folder, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
