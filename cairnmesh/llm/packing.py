"""Shortest-pack-first packing over the length histogram.

Documents become token pieces of at most SIZE ids (only what doesn't fit a
sequence is cut). Lengths are placed longest first, each into the pack with
most room that can take it, else into a new one; packs of one content are one
pattern with a count, so the work depends on the lengths that occur, not on
the number of pieces. The n-th piece of a length then takes the n-th place
that the patterns have for that length: pieces are ranked within (length,
bucket of their id) and each bucket's start is a running sum over buckets, so
a length that a third of all pieces share is dealt over many tasks.

Defined cases: a null or empty text is one piece of the end id alone; repeated
rows are pieces of their own; null ids are kept. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch, ship
from .text import blocks
from .tokens import chunk_table
from .workers import lean

SIZE, END = 2048, 1
#: Pieces of a bucket, about.
BUCKET = 20_000

Place = tuple[int, int, int, int, int]


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many packs, [(length, how many in each)]) that hold every piece of the histogram once."""
    room: list[tuple[int, int]] = []  # (-free, pattern's place): most room first
    patterns: list[list] = []  # [count, [(length, times)]]

    def put(count: int, content: list[tuple[int, int]]) -> None:
        patterns.append([count, content])
        free = size - sum(a * b for a, b in content)
        if free:
            heapq.heappush(room, (-free, len(patterns) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if room and -room[0][0] >= length:
                _, at = heapq.heappop(room)
                count, content = patterns[at]
                take = min(left, count)
                patterns[at] = [0, []]
                more = [*content[:-1], (length, content[-1][1] + 1)] if content[-1][0] == length else [*content, (length, 1)]
                if count > take:
                    put(count - take, content)
                put(take, more)
                left -= take
            else:
                each = size // length
                packs, rest = divmod(left, each)
                if packs:
                    put(packs, [(length, each)])
                if rest:
                    put(1, [(length, rest)])
                left = 0
    merged: dict[tuple, int] = {}
    for count, content in patterns:
        if count:
            merged[tuple(content)] = merged.get(tuple(content), 0) + count
    return [(n, list(c)) for c, n in merged.items()]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset, times), by first rank. A row gives `times` places in each of its packs."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, content in patterns:
        offset = 0
        for length, times in content:
            at = used.get(length, 0)
            out.setdefault(length, []).append((at, sequence, offset, times))
            used[length] = at + count * times
            offset += length * times
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _cut(path: str, size: int):
    def run(batches):
        table = chunk_table(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for at, some in blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                for i, raw in enumerate(table.of_texts(some), at):
                    raw += end
                    total = len(raw) // 4
                    for start in range(0, total, size):
                        part = raw[4 * start : 4 * (start + size)]
                        rows.append((ids[i], start, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _place(table):
    def run(batches):
        known = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                here = length == n
                rows = known[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[here], "right") - 1]
                nth = rank[here] - row[:, 0]
                sequence[here] = row[:, 1] + nth // row[:, 3]
                offset[here] = row[:, 2] + nth % row[:, 3] * n
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = SIZE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs."""
    ship(spark)
    scratch = scratch or Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(rows.mapInArrow(lean(_cut(path, size), keeps=True), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # `size` rows at most
    table = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, size)))

    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("here"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("nth", F.row_number().over(inside)).join(counts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(lean(_place(table)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
