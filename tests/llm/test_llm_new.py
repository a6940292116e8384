"""License scans, importance resampling and structure repair against plain Python, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnmesh.llm import importance, licenses, repair

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


# ---- license scans


def places(text):
    w, out = words(text), []
    for t in licenses.BASE:
        p = t.text.split()
        out += [(i, t.label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(out)


MIT = next(t.text for t in licenses.NOTICES if t.text.startswith("Permission is hereby"))
LICENSED = [
    "GNU General Public License and the MIT-License; mit license", "cc by cc by cc", "gnu general public", "Apache\nLicense, apache license" + " x" * 70_000 + " CC BY",
    MIT, MIT.replace("obtaining", "ever obtaining").replace("without limitation ", ""), " ".join(MIT.split()[:12]), "released under this MIT Licence", None, "",
]


def test_scan(spark, docs):
    rows = [(i, t, 9, 0.5) for i, t in enumerate(LICENSED)] + [(0, LICENSED[0], 9, 0.5), (None, "mit license", 9, 0.5)]
    got = licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string, rid int, score double"))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = got.collect()
    assert len(got) == len(rows)
    by = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    want = Counter()
    for i, t, *_ in rows:
        p = places(t)
        want[(i, len(words(t)), len(p), p[0][0] if p else None, p[-1][0] if p else None, ",".join(sorted({x for _, x in p})))] += 1
    assert by == want
    one = {r.doc_id: r for r in got}
    assert (one[4].labels, one[4].score) == ("mit", 1.0)
    assert one[5].labels == "mit" and 0.85 < one[5].score < 1  # an inserted word and two missing ones: three diagonals
    assert one[6].labels == "" and 0 < one[6].score < licenses.SHARE
    assert one[8].score == one[9].score == 0.0 and one[8].labels == "" and all(0 <= r.score <= 1 for r in got)
    assert licenses.scan(spark, docs).count() == docs.count()
    assert licenses.scan(spark, docs.limit(0)).collect() == [] and licenses.scan(spark, docs, base=(), notices=(licenses.Template("x", "--"),)).where("labels <> '' or score > 0").count() == 0


def test_notice_spans(spark):
    """Spans are where the notice stands, once for each far place."""
    text = f"alpha beta {MIT} gamma {'delta ' * 100} {MIT.replace('charge', 'any charge')} end"
    rows, found = licenses.spans(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), licenses.NOTICES)
    size = len(words(MIT))
    got = sorted((r.begin, r.end, round(r.share, 3)) for r in found.where("share >= 0.6").collect())
    assert got == [(2, 2 + size, 1.0), (103 + size, 104 + 2 * size, round(1.0, 3))]
    assert rows.count() == 1


# ---- importance resampling


def runs(text, orders):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, orders=(1, 1), buckets=importance.BUCKETS, percent=10, least=20, seed=2024):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(b(f) for _, x in docs for f in runs(x, orders)), Counter(b(f) for x in target for f in runs(x, orders))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1.0) * (all_s + buckets) / ((s[k] + 1.0) * (all_t + buckets))))
    out = []
    for i, x in docs:
        f = runs(x, orders)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b(k)) for k in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = len(able) * percent // 100
    return Counter([(*r[:4], n if n <= drawn else None) for n, r in enumerate(able, 1)] + [(*r[:4], None) for r in out if not r[4]])


@pytest.mark.parametrize(("orders", "percent", "least"), [((1, 1), 10, 20), ((1, 2), 50, 3), ((2, 3), 100, 1)])
def test_resample(spark, docs, orders, percent, least):
    target = [docs.first().text, "word er an in on", None, "un café 中文"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(spark, docs, items, orders, percent=percent, least=least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and [t for _, t in got.dtypes] == ["bigint"] * 5
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], target, orders, percent=percent, least=least)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_resample_empty(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(spark, docs.limit(0), items).collect() == []
    got = importance.resample(spark, docs, items)
    assert Counter(tuple(r) for r in got.collect()) == resampled([(r.doc_id, r.text) for r in docs.collect()], [])


def test_ranks_over_partitions(spark):
    """Ties and one value that most rows share; ranks are 1, 2, 3... over all partitions."""
    table = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 50).alias("score"))
    got = importance.ranked(importance.Scratch(spark, "ranks"), table.repartition(7), F.desc("score"), F.asc("doc_id")).collect()
    assert sorted((r.rank, r.doc_id) for r in got) == [(n, i) for n, (_, i) in enumerate(sorted((-(7 if i % 3 < 2 else i % 50), i) for i in range(5000)), 1)]


# ---- structure repair


def cheapest(codes):
    """(cost, audit) by trying all edits, the smallest pair kept for each state."""
    best = {repair.START: (0, "")}

    def inserted(best):
        for _ in range(3):
            for q, r in repair._NEXT.items():
                if q in best:
                    c, a = best[q]
                    best[r] = min(best.get(r, (99999, "")), (c + 3, a + "I"))
        return best

    best = inserted(best)
    for code in codes:
        after = {}
        for q, (c, a) in best.items():
            for letter, r, cost in repair.Repair.arcs(q, code):
                after[r] = min(after.get(r, (99999, "")), (c + cost, a + letter))
        best = inserted(after)
    return min(best[q] for q in (repair.START, repair.ASSISTANT) if q in best)


def test_automaton():
    r, one = random.Random(3), repair.Repair()
    some = [bytes(c) for n in range(4) for c in itertools.product(range(9), repeat=n)] + [bytes(r.choices(range(9), k=r.randrange(4, 40))) for _ in range(400)]
    some += [bytes([repair.DEAD]) * 500, bytes([1]) * 300, bytes([repair.DEAD]) * 3000 + bytes([1, 2, 3])]
    for codes in some:
        assert one.run(codes) == cheapest(codes), codes
    assert len(one.vectors) < 120  # few, whatever is read


def repaired(rows):
    """The report of one conversation's damaged rows (turn, role, text), by the definitions."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, codes, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        left = text.rstrip(" \t\n\x0b\x0c\r")
        kind = 0 if not left else 1 if (role, text) in seen else 2 if left[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            faults[kind] += 1
        codes.append(repair.DEAD if kind in (0, 1) else repair.symbol(role[:1], kind == 2))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = cheapest(codes)
    out, left, last = [], iter(rows), ""
    for letter in audit:
        role = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((role, ""))
        else:
            _, own, text = next(left)
            if letter == "D":
                continue
            out.append((own if letter == "K" else role, text))
        last = out[-1][0][:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def conversations():
    r = random.Random(8)
    say = lambda: r.choice(["Yes.", "no", "Why?", " \t", "", None, "Well !\n", "it is.", "été 中文 🙂.", "a: b\nc."])
    rows = [(c, t if r.random() < 0.9 else r.choice([None, 0, -3, t]), r.choice(["user", "assistant", "system", "tool", "", None, "user"]), say()) for c in range(60) for t in range(r.randrange(1, 12))]
    rows += [(77, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(5000)] + [(None, t, "user", "Hello.") for t in range(9)] + [(78, 0, "user", "w " * 60_000)]
    return rows + rows[:5]


def test_repair(spark):
    rows = conversations()
    table = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id long, turn long, role string, text string, copies int, audit string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = repair.repair_report(spark, repair.damage(table))
    want = {c: repaired(some)[0] for c, some in damaged(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repaired_rows(spark):
    rows = [r for r in conversations() if r[0] is not None and r[0] < 60]
    hurt = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in sorted(repair.repaired(spark, hurt, repair.search(spark, hurt)).collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: out for c, some in damaged(rows).items() if (out := repaired(some)[1])}


def test_repair_empty(spark):
    none = repair.damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair.repair_report(spark, none).collect() == [] and repair.repaired(spark, none, repair.search(spark, none)).collect() == []
