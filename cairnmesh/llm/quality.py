"""Quality by hierarchical empirical Bayes: text evidence, host and path posteriors.

Evidence: a logistic model on a few measures of the text (repetition, symbols,
capitals, word counts), fitted on labelled rows (at most FIT_ROWS ids, by
smallest hash of the id). Its log odds say nothing of the site.

Posteriors: one grouped aggregation over all documents gives each path (source
and language) and host (source) the number of documents and the sum of what
they say: the label where there is one, else the evidence's probability. A
host's rate is shrunk toward the global rate, a path's toward its host's, by
prior strengths estimated from the spread of the rates themselves (method of
moments), so sparse sites follow their parents. A document leaves out of its
site's sums exactly what it added: a labelled one all rows of its id, another
its own row. Its log odds are the evidence plus the site's log odds less the
global ones.

A third of all rows in one host costs nothing: sums are taken before the
shuffle, and site rows go to every task where they are measured to be small
(else the join is shuffled, and Spark splits its hot keys).

Defined cases: null or empty texts have the measures of an empty text; a null
host or path is a site of its own; rows repeating an id count each; rows of
labels with a null label or id are ignored, several labels of an id are
averaged; without labels of both classes every document is kept with
probability 0.5. Other columns are not read, whatever their names, and are
returned where documents are filtered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import Scratch, packed, ship, small
from .text import blocks, words
from .workers import lean

FIT_ROWS = 20_000
#: Rejected below this posterior probability.
KEEP = 0.5
#: Bounds of a prior's strength, in documents.
STRENGTH = (5.0, 10_000.0)
MEASURES = 10
#: Classes of bytes whose share is measured: capitals, symbols, digits, exclamation marks.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|{}<>=+^~@_\\", b"0123456789", b"!")
_NEW_LINE = np.zeros(256, bool)
_NEW_LINE[10] = True


def _repeats(h: np.ndarray, who: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, times of the most frequent one) of each text; values by 44 bits of their hash."""
    key = np.sort(h >> np.uint64(20) | who.astype(np.uint64) << np.uint64(44))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    of = (key[start] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, of, np.diff(np.append(start, len(key))))
    return np.bincount(of, minlength=texts), most


def _shares(run: list[bytes]) -> np.ndarray:
    """How often each class of CLASSES occurs in each text."""
    if len(run) == 1:
        return np.array([[len(run[0]) - len(run[0].translate(None, c)) for c in CLASSES]], float)
    kind = np.zeros(256, np.int8)
    for i, c in enumerate(CLASSES, 1):
        kind[list(c)] = i
    a = kind[np.frombuffer(b" ".join([*run, b""]), np.uint8)]
    start = np.concatenate([[0], np.cumsum([len(b) + 1 for b in run])[:-1]])
    return np.stack([np.add.reduceat(a == i, start, dtype=np.int64) for i in range(1, len(CLASSES) + 1)], 1).astype(float)


def measures(run: list[bytes]) -> np.ndarray:
    """A row of MEASURES for each text of a run (bytes; as `blocks` cuts them)."""
    h, first = words(run)
    n = np.diff(first)
    who = np.repeat(np.arange(len(run)), n)
    distinct, most = _repeats(h, who, len(run))
    inside = np.concatenate([who[1:] == who[:-1], [False]]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    pairs, _ = _repeats(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1], who[at], len(run))
    lines, line_first = words(run, _NEW_LINE, b"\n")
    many = np.diff(line_first)
    kinds, _ = _repeats(lines, np.repeat(np.arange(len(run)), many), len(run))
    size, some = np.maximum(1, [len(b) for b in run])[:, None], np.maximum(1, n)
    share = _shares(run)
    out = np.stack(
        [
            np.log1p(n) / 5, distinct / some, most / some, 1 - np.where(n > 1, pairs, 1) / np.maximum(1, n - 1), *(share[:, :3] / size * [1, 10, 10]).T,
            1 - kinds / np.maximum(1, many), share[:, 3] / some, np.zeros(len(run)),
        ], 1,
    )
    out[n == 0] = [0.0] * (MEASURES - 1) + [1.0]
    return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: constant) of a logistic model on measures, their squares and pairwise products, by Newton steps."""
    z = expand(x)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def expand(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).reshape(-1, MEASURES)
    i, j = np.triu_indices(MEASURES)
    return np.concatenate([x, x[:, i] * x[:, j], np.sqrt(np.abs(x)), np.ones((len(x), 1))], axis=1)


def log_odds(texts: list, weights: np.ndarray) -> np.ndarray:
    """The evidence of texts (bytes or None)."""
    out = [np.clip(expand(measures(run)) @ weights, -12, 12) for _, run in blocks(texts)]
    return np.concatenate(out) if out else np.zeros(0)


def _measured(batches):
    for batch in batches:
        for at, run in blocks(batch.column("text").cast(pa.binary()).to_pylist()):
            kept = [batch.column(c).slice(at, len(run)) for c in ("doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(measures(run).tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def _evidence(weights):
    """Rows (text, others...) -> (others..., e)."""

    def run(batches):
        for batch in batches:
            e = log_odds(batch.column(0).cast(pa.binary()).to_pylist(), weights.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(e)], names=[*batch.schema.names[1:], "e"])

    return run


def _row_evidence(weights, text: int):
    """Rows (row) -> (row, e), the text being the row's field number `text`."""

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            e = log_odds(row.field(text).cast(pa.string()).cast(pa.binary()).to_pylist(), weights.value)
            yield pa.RecordBatch.from_arrays([row, pa.array(e)], names=["row", "e"])

    return run


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: float) -> float:
    """Beta prior's strength from the spread of site rates around `mean`, beyond that of sampling."""
    got = sites.where("n >= 2").agg(F.sum("n").alias("n"), F.sum(F.expr(f"n * pow(good / n - {mean}D, 2)")).alias("spread"), F.count("*").alias("k")).first()
    if not got["k"] or got["k"] < 2:
        return STRENGTH[1]
    noise = mean * (1 - mean)
    between = (got["spread"] - got["k"] * noise) / max(1.0, got["n"] - got["k"])
    return min(STRENGTH[1], max(STRENGTH[0], noise / between - 1 if between > 0 else STRENGTH[1]))


class Posterior:
    """Weights and site tables of docs; `judged` has the probability of each row, `filtered` the rows that are kept."""

    def __init__(self, spark: SparkSession, docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", scratch: Scratch | None = None):
        ship(spark)
        self.spark, self.docs, self.host, self.path = spark, docs, host, path
        scratch = scratch or Scratch(spark, "quality")
        marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))
        marks = marks.where("doc_id is not null")
        rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("h"), F.col(path).cast("string").alias("p"))
        learn = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))  # FIT_ROWS rows of two numbers
        got = rows.join(learn, "doc_id").select("text", "doc_id", "label").mapInArrow(lean(_measured), "doc_id long, label double, x array<double>")
        got = got.groupBy("doc_id", "label").agg(F.min("x").alias("x")).toArrow()  # one row an id, however often it repeats
        x = np.array(got["x"].to_pylist(), float).reshape(-1, MEASURES)
        order = np.lexsort([*x.T, got["doc_id"].to_numpy()])  # rows come in any order: the same sums every time
        x, y = x[order], got["label"].to_numpy()[order]
        self.fitted = len(y) > 0 and (y >= 0.5).any() and (y < 0.5).any()
        if not self.fitted:
            self.slim = rows.drop("text").withColumn("e", F.lit(0.0))
            return
        self.weights = spark.sparkContext.broadcast(fit(x, y))
        self.slim = scratch.keep(rows.mapInArrow(lean(_evidence(self.weights)), "doc_id long, h string, p string, e double"), "evidence")
        # what a document says about its site: the label where there is one, else the evidence
        said = self.slim.groupBy("h", "p", "doc_id").agg(F.count("*").alias("k"), F.sum(F.expr("1 / (1 + exp(-e))")).alias("s")).join(marks, "doc_id", "left")
        said = scratch.keep(said, "said")
        paths = scratch.keep(said.groupBy("h", "p").agg(F.sum("k").alias("pn"), F.sum(F.coalesce(F.col("label") * F.col("k"), "s")).alias("pg")), "paths")
        hosts = scratch.keep(paths.groupBy("h").agg(F.sum("pn").alias("hn"), F.sum("pg").alias("hg")), "hosts")
        own = said.where("label is not null").withColumn("hk", F.sum("k").over(Window.partitionBy("h", "doc_id")))
        self.own = scratch.keep(own.select(F.col("doc_id").alias("id"), F.col("h").alias("oh"), F.col("p").alias("op"), "k", "hk", "label"), "own")
        self.sites = scratch.keep(paths.join(hosts.withColumnRenamed("h", "h2"), F.col("h").eqNullSafe(F.col("h2"))).select(F.col("h").alias("sh"), F.col("p").alias("sp"), "pn", "pg", "hn", "hg"), "sites")
        whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hg").alias("good")).first()
        self.mean = min(1 - 1e-6, max(1e-6, whole["good"] / whole["n"])) if whole["n"] else 0.5
        self.host_strength = _strength(hosts.selectExpr("hn as n", "hg as good"), self.mean)
        self.path_strength = _strength(paths.selectExpr("pn as n", "pg as good"), self.mean)

    def _rated(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, h, p, e, others...) with host_rate, path_rate, quality_p and kept."""
        if not self.fitted:
            return rows.select("*", *[F.lit(0.5).alias(c) for c in ("host_rate", "path_rate", "quality_p")], F.lit(True).alias("kept"))
        out = rows.join(small(self.sites), F.col("h").eqNullSafe(F.col("sh")) & F.col("p").eqNullSafe(F.col("sp")), "left")
        out = out.join(small(self.own), (F.col("doc_id") == F.col("id")) & F.col("h").eqNullSafe(F.col("oh")) & F.col("p").eqNullSafe(F.col("op")), "left")
        alone = F.expr("1 / (1 + exp(-e))")

        def rate(good: str, n: str, times: str, prior: Column, strength: float) -> Column:
            less = lambda c, by: F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0)) - by)
            return (less(good, F.coalesce(F.col("label") * F.col(times), alone)) + strength * prior) / (less(n, F.coalesce(F.col(times), F.lit(1))) + strength)

        out = out.withColumn("host_rate", rate("hg", "hn", "hk", F.lit(self.mean), self.host_strength))
        out = out.withColumn("path_rate", rate("pg", "pn", "k", F.col("host_rate"), self.path_strength))
        odds = F.col("e") + _logit(F.col("path_rate")) - _logit(F.lit(self.mean))
        out = out.withColumn("quality_p", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("quality_p") >= KEEP)
        return out.select(*rows.columns, "host_rate", "path_rate", "quality_p", "kept")

    def judged(self) -> DataFrame:
        """doc_id, evidence, host_rate, path_rate, quality_p and kept of each row of docs."""
        return self._rated(self.slim).select("doc_id", F.col("e").alias("evidence"), "host_rate", "path_rate", "quality_p", "kept")

    def filtered(self) -> DataFrame:
        """The rows of docs that are kept, with all their columns and no others."""
        if not self.fitted:
            return self.docs
        held = self.docs.select(packed(self.docs))
        schema = T.StructType([T.StructField("row", held.schema["row"].dataType), T.StructField("e", T.DoubleType())])
        held = held.mapInArrow(lean(_row_evidence(self.weights, self.docs.columns.index("text"))), schema)
        of = lambda c, kind: F.col("row")[c].cast(kind)
        held = held.select(of("doc_id", "long").alias("doc_id"), of(self.host, "string").alias("h"), of(self.path, "string").alias("p"), "e", "row")
        return self._rated(held).where("kept").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, quality_p and kept of each row of docs."""
    return Posterior(spark, docs, labels).judged()
