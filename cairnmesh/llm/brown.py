"""Class-based bigram model by exchange clustering, and document scores.

Training texts give the count of every word (by hash; grouped aggregation over
all documents). Words of the vocabulary (all that occur LEAST times, or the
most frequent ones, at most VOCABULARY: what a task can hold) and the end mark
are items of their own; every other word stands for the item of its shape
(ending, length, script). Classes come in two steps:

* The TOP most frequent words, shapes and the end mark are clustered by
  exchange on their bigram counts: one item at a time moves to the class that
  gains most likelihood until nothing moves or SWEEPS are over.
* Every other word of the vocabulary begins in its shape's class. A distributed
  pass gathers the classes before and after it over all training texts, and each
  word moves to its best class given the class bigrams (FAR_SWEEPS times).

Then

    P(word | before) = P(class | class before) * P(item | class) * P(word | item)

with class transitions interpolated with class frequencies, and, for a shape's
words, add-one counts over the shape's known words and one unknown word. All
three factors sum to one, so an unseen word costs what its shape's unknown word
costs. Perplexity is 10 ** (-score / n_tokens).

Counts of words beyond the vocabulary are joined by shuffle, so nothing that
grows with the corpus is broadcast. Words are 64-bit hashes of their
lower-cased bytes.

Defined cases: a null or empty text is one end mark; rows repeating an id are
scored each; a null id counts as the text "" where ids are hashed; without
training rows all counts are 0 and scores follow from the smoothing alone.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, ship
from .text import blocks, words_with_shapes

TOP, SHAPES, CLASSES, SWEEPS, FAR_SWEEPS = 1500, 256, 64, 4, 1
#: Words with a class of their own: at least so frequent, and at most so many (25 bytes each in a task).
LEAST, VOCABULARY = 3, 400_000
#: Weight of class frequencies against a class's transitions, in tokens.
KAPPA = 50.0
END = 0x5851F42D4C957F2D
#: Distinct entries that a worker gathers before it sends them on.
FLUSH = 1_000_000
#: Words whose gains are computed at once.
SOME = 128


def fold(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def _ended(batch) -> tuple:
    """Runs of (place of the first text, word hashes with an end mark after each text, their shapes (-1: end), first of each text)."""
    for at, run in blocks(batch.column("text").cast(pa.binary()).to_pylist()):
        h, first, shape = words_with_shapes(run, SHAPES)
        yield at, np.insert(h, first[1:], np.uint64(END)), first + np.arange(len(first)), np.insert(shape, first[1:], -1)


def _word_counts(batches):
    held: list[tuple] = []
    size = 0

    def merged():
        w, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        n = np.bincount(place, np.concatenate([h[1] for h in held])).astype(np.int64)
        s = np.zeros(len(w), np.int64)
        s[place] = np.concatenate([h[2] for h in held])
        return w, n, s

    for batch in batches:
        for _, h, _, shape in _ended(batch):
            w, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((w, n, shape[first]))
            size += len(w)
            if size > 2 * FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH:
                    yield _counted(*held.pop())
                    size = 0
    if held:
        yield _counted(*merged())


def _counted(w, n, s):
    return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n), pa.array(s)], names=["w", "n", "shape"])


def _items(h: np.ndarray, shape: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Item of each word: its place in the sorted words, else its shape's after them, else (end mark) the last."""
    at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
    hit = words[at] == h if len(words) else np.zeros(len(h), bool)
    return np.where(shape < 0, len(words) + SHAPES, np.where(hit, at, len(words) + shape))


def _before(items: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(items)
    out[1:] = items[:-1]
    out[first[:-1]] = end
    return out


def _pair_counts(table):
    """Counts of pairs (before * m + this) of what the table says of each item: itself, or its class."""

    def run(batches):
        words, kind, m = table.value
        total = np.zeros(m * m, np.int64)
        for batch in batches:
            for _, h, first, shape in _ended(batch):
                here = kind[_items(h, shape, words)]
                key, n = np.unique(_before(here, first, kind[-1]) * m + here, return_counts=True)
                total[key] += n
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], names=["pair", "n"])

    return run


def _merged_keys(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return key, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)


def _contexts(table):
    """(item, slots, counts) of far words: slot c counts class c before the word, slot CLASSES + c class c after it."""
    wide = 2 * CLASSES

    def batch_of(key, n):
        item, first = np.unique(key // wide, return_index=True)
        ends = pa.array(np.append(first, len(key)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key % wide).astype(np.int16), n)]
        return pa.RecordBatch.from_arrays([pa.array(item), *lists], names=["item", "slots", "counts"])

    def run(batches):
        words, cls, far = table.value
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for _, h, first, shape in _ended(batch):
                items = _items(h, shape, words)
                here = cls[items]
                at = np.flatnonzero(far[items])  # a far word is no end mark, so a token follows it
                key = np.concatenate([items[at] * wide + _before(here, first, cls[-1])[at], items[at] * wide + CLASSES + here[np.minimum(at + 1, len(here) - 1)]])
                held.append(np.unique(key, return_counts=True))
                size += len(held[-1][0])
                if size > 2 * FLUSH:
                    held = [_merged_keys(held)]
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield batch_of(*held.pop())
                        size = 0
        if size:
            yield batch_of(*_merged_keys(held))

    return run


def _moved(table):
    """Rows sorted by item -> (item, class): the class that gains most when the word leaves its own, given the class bigrams."""

    def run(batches):
        g, cls = table.value
        last, rest = -1, np.zeros(2 * CLASSES)
        for batch in batches:
            item = batch.column("item").to_numpy()
            if not len(item):
                continue
            slots, counts = batch.column("slots"), batch.column("counts")
            many = np.diff(slots.offsets.to_numpy())
            found, place = np.unique(item, return_inverse=True)
            dense = np.zeros((len(found), 2 * CLASSES))
            np.add.at(dense, (np.repeat(place, many), slots.flatten().to_numpy()), counts.flatten().to_numpy())
            if last == found[0]:
                dense[0] += rest
            elif last >= 0:
                found, dense = np.concatenate([[last], found]), np.concatenate([rest[None], dense])
            last, rest = int(found[-1]), dense[-1]
            yield _placed(found[:-1], dense[:-1], cls, g)
        if last >= 0:
            yield _placed(np.array([last]), rest[None], cls, g)

    return run


def _placed(item, dense, cls, g):
    out = [best_class(dense[at : at + SOME, CLASSES:], dense[at : at + SOME, :CLASSES], cls[item[at : at + SOME]], g) for at in range(0, len(item), SOME)]
    return pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["item", "class"])


def best_class(after: np.ndarray, ahead: np.ndarray, own: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For words with class counts after and ahead of them and their own class: the class with the greatest likelihood, g being the class bigrams with the words in their own classes."""
    k, at = len(own), np.arange(len(own))
    left = np.repeat(g[None].astype(float), k, 0)
    left[at, own] = np.maximum(left[at, own] - after, 0)
    left[at, :, own] = np.maximum(left[at, :, own] - ahead, 0)
    rows, cols = left.sum(2) + ahead, left.sum(1) + after  # the word is in some class anyhow: pairs with it stay in the others' totals
    gain = (_xlogx(left + after[:, None, :]) - _xlogx(left)).sum(2) + (_xlogx(left + ahead[:, :, None]) - _xlogx(left)).sum(1)
    gain -= _xlogx(rows + after.sum(1)[:, None]) - _xlogx(rows) + _xlogx(cols + ahead.sum(1)[:, None]) - _xlogx(cols)
    best = gain.argmax(1)
    return np.where(gain[at, best] > gain[at, own] + 1e-9, best, own)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pair: np.ndarray, n: np.ndarray, m: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each of m items, from counts n of pairs (before * m + item)."""
    a, b = pair // m, pair % m
    freq = np.bincount(a, n, m) + np.bincount(b, n, m)
    order = np.argsort(-freq, kind="stable")
    cls = np.empty(m, np.int64)
    cls[order] = np.minimum(np.arange(m), classes - 1) if m <= classes else np.arange(m) % classes
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    start_a, start_b = np.searchsorted(a[by_a], np.arange(m + 1)), np.searchsorted(b[by_b], np.arange(m + 1))
    g = np.zeros((classes, classes))
    np.add.at(g, (cls[a], cls[b]), n)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not freq[w]:
                continue
            after, ahead = by_a[start_a[w] : start_a[w + 1]], by_b[start_b[w] : start_b[w + 1]]
            r = np.bincount(cls[b[after]], n[after], classes)
            q = np.bincount(cls[a[ahead]], n[ahead], classes)
            s = n[after][b[after] == w].sum()
            c0 = cls[w]
            g[c0] -= r
            g[:, c0] -= q
            g[c0, c0] += s
            r[c0] -= s
            q[c0] -= s
            rows, cols = g.sum(1) + q, g.sum(0) + r  # w is in some class anyhow: pairs with it stay in the others' totals
            gain = (_xlogx(g + r) - _xlogx(g)).sum(1) + (_xlogx(g + q[:, None]) - _xlogx(g)).sum(0)
            d = np.diag(g)
            gain += _xlogx(d + r + q + s) - _xlogx(d + r) - _xlogx(d + q) + _xlogx(d)
            gain -= _xlogx(rows + r.sum() + s) - _xlogx(rows) + _xlogx(cols + q.sum() + s) - _xlogx(cols)
            c = int(np.argmax(gain)) if gain.max() > gain[c0] + 1e-9 else int(c0)
            moved += c != c0
            cls[w] = c
            g[c] += r
            g[:, c] += q
            g[c, c] += s
        if not moved:
            break
    return cls


class Model:
    """The tables that scoring needs; of bounded size whatever the corpus."""

    def __init__(self, words, count, cls, g, shape_tokens, shape_words, end_count):
        """Of the vocabulary: sorted hashes and counts. cls: class of each word, shape and the end mark; g: class bigrams."""
        self.words, self.log, self.cls = words, np.log10(count + 1.0), cls
        own = np.concatenate([count, shape_tokens, [end_count]]) + 1.0
        size = np.bincount(cls, own, CLASSES)
        share = size / size.sum()
        self.step = np.log10(np.maximum((g + KAPPA * share) / (g.sum(1, keepdims=True) + KAPPA), 1e-300))
        self.emit = np.log10(own / size[cls])
        self.emit[len(words) : len(words) + SHAPES] -= np.log10(shape_tokens + shape_words + 1.0)
        self.end_log = float(np.log10(end_count + 1.0))


def _scored(table):
    def run(batches):
        model = table.value
        k = len(model.words)
        m = k + SHAPES + 1
        log_of = np.concatenate([model.log, np.zeros(SHAPES), [model.end_log]])
        for batch in batches:
            for at, h, first, shape in _ended(batch):
                items = _items(h, shape, model.words)
                here = model.cls[items]
                log = model.step[_before(here, first, model.cls[m - 1]), here] + model.emit[items]
                count_log = log_of[items]
                known = (items < k) | ((items == m - 1) & (model.end_log > 0))
                n = np.diff(first)
                rest = (items >= k) & (items < m - 1)
                cut = np.concatenate([[0], np.cumsum(np.add.reduceat(rest, first[:-1], dtype=np.int64))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(n)), pa.array(n), pa.array(np.add.reduceat(known, first[:-1], dtype=np.int64)), pa.array(np.add.reduceat(count_log, first[:-1])),
                        pa.array(np.add.reduceat(log, first[:-1])), pa.ListArray.from_arrays(pa.array(cut), pa.array(h[rest].view(np.int64))),
                    ],
                    names=["doc_id", "n_tokens", "known", "count_log", "model_log", "rest"],
                )

    return run


def _vocabulary(counts: DataFrame, size: int) -> tuple[Column, object]:
    """(whether a row of counts belongs to the vocabulary, the vocabulary's rows sorted by hash): all words above a bound on the count, at most `size`."""
    level = F.floor(F.log2("n") * 16)
    bins = counts.where((F.col("n") >= LEAST) & (F.col("shape") >= 0)).groupBy(level.alias("level")).count().collect()  # 1,024 rows at most
    least, total = None, 0
    for b in sorted(bins, key=lambda b: -b["level"]):
        total += b["count"]
        if total > size:
            break
        least = b["level"]
    inside = (F.col("shape") >= 0) & (F.col("n") >= LEAST) & (level >= least) if least is not None else F.lit(False)
    got = counts.where(inside).select("w", "n", "shape").toArrow()  # `size` rows at most
    words, n, shape = got["w"].to_numpy().view(np.uint64), got["n"].to_numpy(), got["shape"].to_numpy()
    order = np.argsort(words)
    return inside, (words[order], n[order], shape[order])


def _pairs(spark: SparkSession, train: DataFrame, words: np.ndarray, kind: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (before * m + this) of the kinds of all training tokens, and their counts: m * m rows at most."""
    table = spark.sparkContext.broadcast((words, kind, m))
    got = train.mapInArrow(_pair_counts(table), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(got["pair"].to_numpy())
    return got["pair"].to_numpy()[order], got["n"].to_numpy()[order]


def _classes(spark: SparkSession, train: DataFrame, words: np.ndarray, count: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each word, shape and the end mark; bigrams of classes)."""
    k = len(words)
    core = np.sort(np.lexsort((words, -count))[:TOP])
    kind = np.concatenate([len(core) + shape, len(core) + np.arange(SHAPES + 1)])  # words beyond the core stand for their shapes
    kind[core] = np.arange(len(core))

    m = len(core) + SHAPES + 1
    pair, n = _pairs(spark, train, words, kind, m)
    of_core = exchange(pair, n, m)
    cls = of_core[kind]
    g = np.zeros((CLASSES, CLASSES))
    np.add.at(g, (of_core[pair // m], of_core[pair % m]), n)
    far = np.ones(k + SHAPES + 1, bool)
    far[core] = False
    far[k:] = False
    for _ in range(FAR_SWEEPS if far.any() else 0):
        found = train.mapInArrow(_contexts(spark.sparkContext.broadcast((words, cls, far))), "item long, slots array<short>, counts array<long>")
        found = found.repartition("item").sortWithinPartitions("item").mapInArrow(_moved(spark.sparkContext.broadcast((g, cls))), "item long, class long").toArrow()  # the vocabulary's rows at most
        cls = cls.copy()
        cls[found["item"].to_numpy()] = found["class"].to_numpy()
        pair, n = _pairs(spark, train, words, cls, CLASSES)
        g = np.zeros((CLASSES, CLASSES))
        np.add.at(g, (pair // CLASSES, pair % CLASSES), n)
    return cls, g


def score_documents(spark: SparkSession, docs: DataFrame, folds: int = 7, held: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of docs."""
    ship(spark)
    scratch = scratch or Scratch(spark, "brown")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = rows.where(fold(F.col("doc_id"), folds) != held)
    counts = train.mapInArrow(_word_counts, "w long, n long, shape long").groupBy("w").agg(F.sum("n").alias("n"), F.max("shape").alias("shape"))
    counts = scratch.keep(counts, "counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("shape") < 0, F.col("n"))).alias("ends")).first()
    total, kinds, ends = whole["n"] or 0, whole["v"], whole["ends"] or 0

    inside, (words, count, shape) = _vocabulary(counts, VOCABULARY)
    beyond = counts.where(~inside & (F.col("shape") >= 0))
    by_shape = beyond.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()  # SHAPES rows
    tokens, known = np.zeros(SHAPES), np.zeros(SHAPES)
    tokens[by_shape["shape"].to_numpy()], known[by_shape["shape"].to_numpy()] = by_shape["n"].to_numpy(), by_shape["v"].to_numpy()
    cls, g = _classes(spark, train, words, count, shape)
    model = Model(words, count, cls, g, tokens, known, ends)

    schema = "doc_id long, n_tokens long, known long, count_log double, model_log double, rest array<long>"
    scored = rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), schema).withColumn("row", F.monotonically_increasing_id())
    scored = scratch.keep(scored, "scored")
    rest = scored.select("row", F.explode("rest").alias("w")).join(beyond, "w")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more_log"), F.count("*").alias("more_known"))
    more = F.coalesce("more_log", F.lit(0.0))
    out = scored.drop("rest").join(rest, "row", "left").select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("count_log") + more - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"), (F.col("model_log") + more).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
