"""Convolutional text classifier for toxicity, trained in numpy.

Words (letters, digits and characters from U+0080 on; A-Z as a-z) are hashed
to rows of an embedding table; filters of several widths run over the word
sequence, each is max-pooled over the whole text, and a logistic layer turns
the pooled values into a score. Training uses the labelled texts of the
training folds (at most FIT_ROWS of them, by smallest hash of the id), with
AdaGrad; a max-pooled filter's gradient reaches only the place of its maximum.
The learning rows are the only thing that goes to the driver.

After training, a filter of width k is k tables of responses (one for each
place in the filter), so scoring is k gathers and a maximum. Scores are
calibrated (Platt) and a threshold is chosen for each language on a part of
the training rows that was held back; the score itself never sees a language.

Defined cases: a null or empty text gets the score of a text without words;
rows repeating an id are scored each, and one of them is learned from; labels
that are null are not learned from; other columns are not read, whatever their
names, and are returned where documents are filtered; without labels of both classes every score is 0 (nothing is rejected).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .brown import fold
from .store import packed, ship
from .text import BLOCK, NOT_ALNUM, blocks, words
from .workers import lean

#: Learning rows at most (a bounded sample); each is learned from as a whole, like the texts that are scored.
FIT_ROWS = 12_000
#: Places of a text whose responses are held at once while learning; maxima are carried over these windows.
WINDOW = 1 << 16
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 21, 12, 8, (1, 2, 3)
EPOCHS, RATE, DECAY = 5, 0.03, 1e-4
CUT = 0.7
#: Buckets that fewer learning texts hold are one bucket (1): what stands in one text alone can't be learned from.
LEAST_TEXTS = 4
#: Labelled rows of a language below which its threshold is the common one.
LEAST_ROWS = 40


class ConvNet:
    """Scores runs of word buckets. Bucket 0 stands beyond a text's ends; buckets that few learning texts hold share row 1."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.random = r
        self.lookup = np.zeros(0, np.int32)  # row of each bucket
        self.table = np.zeros((2, WIDTH), np.float32)
        self.filters = [r.normal(0, 0.1, (k, WIDTH, FILTERS)).astype(np.float32) for k in WIDTHS]
        for k, f in zip(WIDTHS, self.filters, strict=True):
            f[:, 0, : FILTERS // 2] += 1 / k
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.abs(r.normal(0, 0.1, FILTERS * len(WIDTHS))).astype(np.float32)
        self.shift = np.float32(0)
        self.scale, self.offset = 1.0, 0.0
        self.responses: list[list[np.ndarray]] | None = None
        self.thresholds: dict[str, float] = {}
        self.trained = False

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        padded = np.concatenate([np.zeros(max(WIDTHS) - 1, x.dtype), x, np.zeros(max(WIDTHS) - 1, x.dtype)])
        best = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
        places = [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
        for start in range(0, len(padded), WINDOW):
            e = self.table[padded[start : start + WINDOW + max(WIDTHS) - 1]]
            for w, (k, f, b) in enumerate(zip(WIDTHS, self.filters, self.bias, strict=True)):
                n = min(WINDOW, len(padded) - k + 1 - start)
                if n <= 0:
                    continue
                z = sum((e[j : j + n] @ f[j] for j in range(k)), b)
                at = z.argmax(0)
                v = z[at, np.arange(FILTERS)]
                places[w] = np.where(v > best[w], start + at, places[w])
                best[w] = np.maximum(best[w], v)
        values, active = [np.maximum(v, 0) for v in best], [v > 0 for v in best]
        return np.concatenate(values), places, active, padded

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, langs: list, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        distinct = [np.unique(x) for x in texts]
        held, df = np.unique(np.concatenate([*distinct, np.zeros(0, np.int32)]), return_counts=True)
        held = held[df >= LEAST_TEXTS]
        self.lookup = np.ones(BUCKETS, np.int32)
        self.lookup[0] = 0
        self.lookup[held] = 2 + np.arange(len(held))
        texts, distinct = [self.lookup[x] for x in texts], [self.lookup[x] for x in distinct]
        self.table = self.random.normal(0, 0.05, (len(held) + 2, WIDTH)).astype(np.float32)
        self.table[:2] = 0
        order = r.permutation(len(texts))
        back = order[: len(order) // 5]
        learn = order[len(order) // 5 :]
        if len(set(labels[learn])) < 2:
            return
        self.trained = True
        # an embedding's first value begins as its word's log odds between the classes' texts, shrunk for rare words
        of = [np.bincount(np.concatenate([np.zeros(0, np.int32), *[distinct[i] for i in learn if labels[i] == y]]), minlength=len(self.table)) for y in (0, 1)]
        odds = np.log((of[1] + 0.5) / ((labels[learn] == 1).sum() + 1)) - np.log((of[0] + 0.5) / ((labels[learn] == 0).sum() + 1))
        self.table[:, 0] = 0.5 * odds * (of[0] + of[1]) / (of[0] + of[1] + 4)
        self.table[:2] = 0
        weight = np.where(labels == 1, (labels[learn] == 0).sum() / max(1, (labels[learn] == 1).sum()), 1.0) ** 0.5
        sums = {"t": np.full(self.table.shape, 1e-3, np.float32), "f": [np.full(f.shape, 1e-3, np.float32) for f in self.filters], "b": [np.full(FILTERS, 1e-3, np.float32) for _ in WIDTHS], "o": np.full(self.out.shape, 1e-3, np.float32), "s": 1e-3}

        def step(value, total, grad):
            total += grad * grad
            value -= RATE * grad / np.sqrt(total)

        for _ in range(EPOCHS):
            for i in r.permutation(learn):
                v, places, active, padded = self._pooled(texts[i])
                p = 1 / (1 + np.exp(-float(v @ self.out + self.shift)))
                err = np.float32((p - labels[i]) * weight[i])
                if abs(err) < 0.01:
                    continue
                grad = err * self.out
                step(self.out, sums["o"], err * v + DECAY * self.out)
                np.maximum(self.out, 0, out=self.out)  # a text is toxic by what is in it: nothing else in it makes up for that
                sums["s"] += err * err
                self.shift -= np.float32(RATE * err / np.sqrt(sums["s"]))
                for w, k in enumerate(WIDTHS):
                    g = grad[w * FILTERS : (w + 1) * FILTERS] * active[w]
                    if not g.any():
                        continue
                    step(self.bias[w], sums["b"][w], g)
                    for j in range(k):
                        rows = padded[places[w] + j]
                        e = self.table[rows]
                        back_e = (self.filters[w][j] * g).T
                        step(self.filters[w][j], sums["f"][w][j], e.T * g + DECAY * self.filters[w][j])
                        back_e[rows == 0] = 0
                        np.add.at(sums["t"], rows, back_e * back_e)
                        np.add.at(self.table, rows, -RATE * back_e / np.sqrt(sums["t"][rows]))
        self._calibrate([texts[i] for i in back], labels[back], [langs[i] for i in back])

    def _calibrate(self, texts, labels, langs) -> None:
        raw = np.array([float(self._pooled(x)[0] @ self.out + self.shift) for x in texts])
        if len(set(labels)) < 2:
            return
        mean, spread = raw.mean(), raw.std() + 1e-6
        z = (raw - mean) / spread
        a, b = 1.0, 0.0
        for _ in range(200):  # Newton steps of logistic regression on one value
            p = 1 / (1 + np.exp(-(a * z + b)))
            h = p * (1 - p) + 1e-9
            ga, gb = ((p - labels) * z).sum() + 0.01 * a, (p - labels).sum()
            haa, hab, hbb = (h * z * z).sum() + 0.01, (h * z).sum(), h.sum()
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a - da, b - db
            if abs(da) + abs(db) < 1e-9:
                break
        self.scale, self.offset = a / spread, b - a * mean / spread
        scores = 1 / (1 + np.exp(-(self.scale * raw + self.offset)))
        langs = np.array([x or "" for x in langs], object)
        for lang in sorted({"", *langs}):
            here = (langs == lang) if lang and (langs == lang).sum() >= LEAST_ROWS and len(set(labels[langs == lang])) == 2 else np.ones(len(langs), bool)
            s, y = scores[here], labels[here]
            cuts = np.linspace(0.3, 0.9, 61)
            # best F1 with precision before recall on ties: keep clean texts
            f1 = [2 * ((s >= c) & (y == 1)).sum() / max(1, (s >= c).sum() + (y == 1).sum()) for c in cuts]
            best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
            self.thresholds[lang] = float(cuts[best[len(best) // 2]])

    def freeze(self) -> ConvNet:
        """Turn filters into tables of responses; training tables are let go."""
        self.responses = [[(self.table @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]
        self.table = self.random = None
        return self

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of texts given as their words' buckets one after the other, and each text's first place."""
        n = len(first) - 1
        if not self.trained:
            return np.zeros(n)
        gap = max(WIDTHS) - 1
        x = np.insert(self.lookup[h], np.repeat(first, gap), 0)
        start = first[:-1] + gap * np.arange(n)
        total = np.full(n, float(self.shift))
        for w, k in enumerate(WIDTHS):
            size = len(x) - k + 1
            z = sum((self.responses[w][j][x[j : j + size]] for j in range(k)), self.bias[w])
            # a text's windows begin in the gap before it and end in the gap after it
            pooled = np.maximum(np.maximum.reduceat(z, start, axis=0), 0)
            total += pooled @ self.out[w * FILTERS : (w + 1) * FILTERS]
        return 1 / (1 + np.exp(-(self.scale * total + self.offset)))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (1 + (h % np.uint64(BUCKETS - 1))).astype(np.int32)


def _learning_words(batches):
    for batch in batches:
        for at, run in blocks(batch.column("text").cast(pa.binary()).to_pylist()):
            h, first = words(run, NOT_ALNUM)
            x = _buckets(h)
            lists = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            kept = [batch.column(c).slice(at, len(run)) for c in ("doc_id", "label", "lang")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.binary())], names=["doc_id", "label", "lang", "words"])


def _score(model):
    def run(batches):
        net = model.value
        for batch in batches:
            scores = _scores(net, batch.column("text").cast(pa.binary()).to_pylist())
            kept = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], names=[*names, "score"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> ConvNet:
    """Learn from the labelled rows of docs outside the held-out fold."""
    ship(spark)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).where(fold(F.col("doc_id"), folds) != held)
    chosen = marks.where(fold(F.col("doc_id"), folds) != held)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    got = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(lean(_learning_words), "doc_id long, label int, lang string, words binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("words", "lang", "label")).alias("x")).select("doc_id", "x.*").toArrow()  # one row an id, however often it repeats
    got = sorted(zip(got["doc_id"].to_pylist(), got["words"].to_pylist(), got["label"].to_pylist(), got["lang"].to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
    net = ConvNet()
    net.fit([np.frombuffer(r[1], np.int32) for r in got], np.array([r[2] for r in got]), [r[3] for r in got])
    return net.freeze()


def _scores(net: ConvNet, texts: list) -> np.ndarray:
    out = [net.scores(_buckets(h), first) for _, some in blocks(texts, BLOCK // 2) for h, first in [words(some, NOT_ALNUM)]]
    return np.concatenate(out) if out else np.zeros(0)


def _below_threshold(model, text: int, lang: int | None):
    """Rows (row) that score below their language's threshold; text and language are the row's fields of these numbers."""

    def run(batches):
        net = model.value
        common = net.thresholds.get("", CUT)
        for batch in batches:
            row = batch.column(0)
            scores = _scores(net, row.field(text).cast(pa.string()).cast(pa.binary()).to_pylist())
            langs = row.field(lang).cast(pa.string()).to_pylist() if lang is not None else [""] * len(row)
            cuts = np.array([net.thresholds.get(x or "", common) for x in langs])
            yield batch.filter(pa.array(scores < cuts))

    return run


def filtered(spark: SparkSession, docs: DataFrame, net: ConvNet) -> DataFrame:
    """The rows of docs whose score is below their language's threshold, with all their columns and no others."""
    ship(spark)
    held = docs.select(packed(docs))
    lang = docs.columns.index("lang") if "lang" in docs.columns else None
    run = _below_threshold(spark.sparkContext.broadcast(net), docs.columns.index("text"), lang)
    return held.mapInArrow(lean(run), T.StructType([T.StructField("row", held.schema["row"].dataType)])).select("row.*")


def _threshold(net: ConvNet, lang: Column) -> Column:
    out = F.lit(net.thresholds.get("", CUT))
    for name, cut in net.thresholds.items():
        if name:
            out = F.when(lang == name, cut).otherwise(out)
    return out


def score(spark: SparkSession, docs: DataFrame, net: ConvNet, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= CUT), threshold (its language's) and flagged (score >= threshold) of each row of docs."""
    ship(spark)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lean(_score(spark.sparkContext.broadcast(net))), "doc_id long, lang string, score double")
    threshold = _threshold(net, F.col("lang"))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))
