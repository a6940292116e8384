"""Exact Jaccard join of shingle sets as a join in a metric space.

Jaccard distance d is a metric, and a pair links when d <= r (r = 0.25). Four
facts make regions small without losing a link:

* Sets without a common shingle are at distance 1. Each set therefore has a
  few anchors, its first n - ceil(0.75 n) + 1 shingles in one global order
  (shingles that crowd many anchors last, then by hash); linked sets have a
  common anchor. Any global order is exact, the crowded list only saves work.
* Linked sizes differ by a factor of 4/3 at most (the window of the empty set's
  size), so an anchor's region holds sets of two neighbouring size bands only.
* Of a pair's first common anchor, both sets have only what follows it left to
  share; a set that no other set of the region can then reach leaves it.
* In each region one set is the pivot. All regions of one pivot form
  its Voronoi cell, whose members' distances to the pivot are computed. Members
  within r are linked to it, hence to each other's component, and need no
  comparison among themselves. The rest falls into rings by distance; by the
  triangle inequality a pair links only if its distances to the pivot differ by
  at most r, so rings meet only rings inside that window (boundary members are
  replicated to each). Large rings are cut into blocks; a block pair is one
  task's unit. Inside it several pivots make Voronoi regions, sets within 2 r of
  another region's border are replicated to it, regions join recursively, and
  exactly at the leaves.

Sets are compared by 64-bit shingle hashes; equal hashes count as equal
shingles. Rows with equal sets (128-bit hashes of them) are one node; nodes are
linked, not ids, so a doc_id may have rows with different texts.

Defined cases: a null or empty text has no shingles, n_shingles 0, and is its
own component; a text of 1 to 4 words is one shingle; a class is named by the
smallest doc_id of its rows; rows with a null id link like others and get the
id of their class (null if no row of it has one). Columns other than the id and
text are not read, whatever their names, and are returned where documents are
filtered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import smallest_reachable
from .store import Scratch, packed, ship, small
from .text import blocks, shingle_sets
from .workers import lean

#: A pair links when PARTS * common >= LEAST * union.
LEAST, PARTS = 3, 4
#: Shingles that are anchors of more than one row by hash order alone come last, by the logarithm of their count; at most
#: so many, the most crowded: the list that every task gets has a fixed size (9 bytes each).
CROWDED_MAX = 1 << 21
#: Anchors whose rows are dealt over all tasks: the SPLIT most frequent in the sets of one hash in SAMPLE, if SPLIT_LEAST of these have them.
#: An anchor outside the list has about 1 / SPLIT of all rows at most. The list decides where work is done; any list gives the same result.
SPLIT, SAMPLE, SPLIT_LEAST = 1 << 16, 64, 8
#: Members and shingles of a block.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
#: Sizes of a band differ by less than this factor, a little above PARTS / LEAST, so rounding can not part linked sizes by two bands.
BAND = 1.34
RINGS = 16
#: Pivots of one level of the recursion inside a block pair, and sets that are compared without one.
PIVOTS, LEAF = 8, 96


def _prefix(n: int) -> int:
    return n - (LEAST * n + PARTS - 1) // PARTS + 1 if n else 0


def _linked(common, n, m):
    return PARTS * common >= LEAST * (n + m - common)


def _runs(batches, size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows (text, others...) -> the others of a run of texts, and their sets."""
    for batch in batches:
        for at, run in blocks(batch.column(0).cast(pa.binary()).to_pylist()):
            yield [c.slice(at, len(run)) for c in batch.columns[1:]], shingle_sets(run, size)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _keyed(size: int):
    def run(batches):
        for others, sets in _runs(batches, size):
            keys = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists([s[: _prefix(len(s))] for s in sets])],
                names=["doc_id", "th", "n", "k1", "k2", "anchors"],
            )

    return run


def _reordered(size: int, crowded):
    """Anchors in the order that puts the crowded shingles last."""

    def run(batches):
        hot, level = crowded.value
        for others, sets in _runs(batches, size):
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
            late = np.where(hot[at] == flat, level[at], 0)
            out, i = [], 0
            for s in sets:
                x = late[i : i + len(s)]
                i += len(s)
                p = _prefix(len(s))
                out.append(s[np.argsort(x, kind="stable")[:p]] if x[:p].any() else s[:p])
            yield pa.RecordBatch.from_arrays([*others, pa.array([len(s) for s in sets], pa.int64()), _lists(out)], names=["node", "n", "anchors"])

    return run


def _whole(size: int):
    def run(batches):
        for others, sets in _runs(batches, size):
            yield pa.RecordBatch.from_arrays([*others, pa.array([s.tobytes() for s in sets], pa.binary())], names=["member", "shingles"])

    return run


def _groups(batches, key: int) -> Iterator[list[tuple]]:
    """Rows of sorted input with equal first `key` columns, one group at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:key] != row[:key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _to_pivot(batches):
    """Rows (cell, chunk, is_member, member, shingles), each chunk's pivot first: common shingles of pivot and member."""
    now, pivot, out = None, None, []
    for batch in batches:
        for cell, chunk, is_member, member, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = np.frombuffer(shingles, np.uint64)
            if not is_member:
                now, pivot = (cell, chunk), s
            elif now == (cell, chunk):
                at = np.searchsorted(pivot, s)
                common = int((pivot[np.minimum(at, len(pivot) - 1)] == s).sum())
                out.append((cell, member, len(pivot), len(s), common))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["cell", "member", "n_pivot", "n", "common"])
            out = []


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def top(self, x):
        while self.up.get(x, x) != x:
            self.up[x] = x = self.up.get(self.up[x], self.up[x])
        return x

    def join(self, x, y) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class _Sets:
    """Sets of one block pair over their common universe; shingles of one set only can't be in common and are left out."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        who = np.repeat(np.arange(len(sets)), self.n)
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        used = times[place] > 1
        new = np.cumsum(times > 1) - 1
        self.who, self.place, self.width = who[used], new[place[used]], int((times > 1).sum())
        order = np.argsort(self.who, kind="stable")
        self.who, self.place = self.who[order], self.place[order]
        self.first = np.searchsorted(self.who, np.arange(len(sets) + 1))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections, by products of 0/1 matrices over slices of the universe."""
        total = np.zeros((len(a), len(b)), np.float32)
        pa_, pb = ([self.place[self.first[i] : self.first[i + 1]] for i in x] for x in (a, b))
        ra, rb = (np.repeat(np.arange(len(p)), [len(x) for x in p]) for p in (pa_, pb))
        ca, cb = (np.concatenate(p) if p else np.zeros(0, int) for p in (pa_, pb))
        columns = np.intersect1d(ca, cb)
        for at in range(0, len(columns), 4096):
            part = columns[at : at + 4096]
            sides = []
            for rows, cols, size in ((ra, ca, len(a)), (rb, cb, len(b))):
                where = np.minimum(np.searchsorted(part, cols), len(part) - 1)
                ok = part[where] == cols
                m = np.zeros((size, len(part)), np.float32)
                m[rows[ok], where[ok]] = 1
                sides.append(m)
            total += sides[0] @ sides[1].T
        return total.astype(np.int64)


def _join(sets: _Sets, a: np.ndarray, b: np.ndarray, same: bool, link) -> None:
    """All linked pairs of a and b (same: within a), by recursion over Voronoi regions.

    Each set belongs to the region of its nearest pivot. By the triangle
    inequality a set that links to one of region j is at most 2 r farther from
    pivot j than from its own, so only such boundary sets of earlier regions are
    replicated to j. Where regions would save little work, the pairs are compared.
    """
    if not len(a) or not len(b):
        return
    both = a if same else np.concatenate([a, b])
    if len(both) > LEAF:
        at = np.unique(np.linspace(0, len(both) - 1, PIVOTS).astype(int))
        common = sets.common(both[at], both)
        d = 1 - common / (sets.n[both[at]][:, None] + sets.n[both] - common)
        d[np.arange(len(at)), at] = 0
        home = d.argmin(0)
        window = d <= d.min(0) + 2 * (1 - LEAST / PARTS) + 1e-9
        is_a = np.arange(len(both)) < len(a)
        parts = []
        for j in range(len(at)):
            here, edge = home == j, window[j] & (home < j)
            if same:
                parts += [(both[here], both[here], True), (both[here], both[edge], False)]
            else:
                parts += [(both[x & is_a], both[y & ~is_a], False) for x, y in ((here, here), (here, edge), (edge, here))]
        work = sum(len(x) * len(y) / (1 + s) for x, y, s in parts)
        if work < 0.7 * len(a) * len(b) / (1 + same):
            for x, y, s in parts:
                _join(sets, x, y, s, link)
            return
    common = sets.common(a, b)
    i, j = np.nonzero(_linked(common, sets.n[a][:, None], sets.n[b][None, :]) & (common > 0))
    for x, y in zip(a[i], b[j], strict=True):
        if not same or x < y:
            link(int(x), int(y))


def _block_pairs(batches):
    """Rows (cell, left, right, block, linked, member, shingles): links of a block pair, as a forest over its members."""
    for rows in _groups(batches, 3):
        left = rows[0][1]
        ids = [r[5] for r in rows]
        sets = _Sets([np.frombuffer(r[6], np.uint64) for r in rows])
        direct = np.array([r[4] for r in rows])
        at_left = np.array([r[3] == left for r in rows])
        forest, out = _Forest(), []

        def link(x, y, ids=ids, forest=forest, out=out):
            if forest.join(ids[x], ids[y]):
                out.append((ids[x], ids[y]))

        every = np.arange(len(rows))
        if rows[0][1] == rows[0][2]:  # one block: members linked to the pivot need no comparison among themselves
            _join(sets, every[~direct], every[~direct], True, link)
            _join(sets, every[direct], every[~direct], False, link)
        else:
            _join(sets, every[at_left], every[~at_left], False, link)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])


def _texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(text, doc_id, th, more...): a row is known by its id and its text's hash."""
    text = F.col(text_col).cast("string")
    return docs.select(text.alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), *more)


def _classed(spark: SparkSession, texts: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(keyed, named): (doc_id, th, n, k1, k2) of each row, and (c1, c2, component_id, rep) of each distinct set; rep is the one row that stands for its component."""
    first = scratch.keep(texts.mapInArrow(lean(_keyed(size)), "doc_id long, th long, n long, k1 long, k2 long, anchors array<long>"), "first")
    keyed = scratch.keep(first.drop("anchors"), "keyed")
    counts = first.select(F.explode("anchors").alias("s")).groupBy("s").count().where("count > 1")
    crowded = _crowded(scratch.keep(counts, "counts"))
    scratch.drop(first)

    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = keyed.where("n > 0").groupBy("k1", "k2").agg(F.min(row).alias("rep"), F.max("n").alias("n")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.keep(nodes, "nodes")
    repeated = not keyed.groupBy("doc_id", "th").count().where("count > 1").isEmpty()

    def texts_of(some: DataFrame) -> DataFrame:
        """(text, node) of these nodes, each from the row that stands for it."""
        some = some.select("node", F.col("rep.doc_id").alias("rid"), F.col("rep.th").alias("rth"))
        got = texts.join(small(some), F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("text", "node")
        return got.dropDuplicates(["node"]) if repeated else got

    work = Scratch(spark, "jaccard-work")  # tables that are gone when the classes are known
    order = spark.sparkContext.broadcast(crowded)

    def anchors_of(some: DataFrame) -> DataFrame:
        rows = texts_of(some).mapInArrow(lean(_reordered(size, order)), "node long, n long, anchors array<long>")
        return rows.select("node", "n", F.posexplode("anchors").alias("i", "s"))

    split = work.keep(_frequent(anchors_of(nodes.where(f"pmod(xxhash64(node), {SAMPLE}) = 0"))), "split")
    shared = work.keep(_shared(anchors_of(nodes), split), "shared")
    members = _with_pivots(work, shared)
    members = members.select(F.col("pivot.node").alias("cell"), F.col("node").alias("member"), "n", F.col("pivot.n").alias("n_pivot")).distinct()
    members = work.keep(members, "members")
    # a cell of one member whose size alone rules the link out has nothing to find
    more = small(work.keep(members.groupBy("cell").agg(F.count("*").alias("others")), "others"))
    members = members.join(more, "cell").where(f"others > 1 or {PARTS} * least(n, n_pivot) >= {LEAST} * greatest(n, n_pivot)").select("cell", "member")
    members = work.keep(members, "compared")
    used = nodes.join(members.select(F.explode(F.array("cell", "member")).alias("node")).distinct(), "node", "left_semi")
    sets = texts_of(work.keep(used.select("node", "rep"), "used")).mapInArrow(lean(_whole(size)), "member long, shingles binary")
    # both uses make the sets anew from the texts: cheaper than a table of them, which would be as large as its input

    measured = work.keep(_measure(work, members, sets), "measured")
    direct = F.expr(f"{PARTS} * common >= {LEAST} * (n + n_pivot - common)")
    measured = measured.withColumn("direct", direct)
    edges = measured.where("direct").select(F.col("cell").alias("u"), F.col("member").alias("v"))
    edges = edges.unionByName(_block_rows(work, measured, sets).mapInArrow(lean(_block_pairs), "u long, v long"))
    labels = smallest_reachable(work, edges)

    # a component's row is the smallest of its nodes' rows; its smallest doc_id is that row's
    linked = labels.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    linked = small(work.keep(linked, "linked"))
    labels = scratch.keep(labels.join(linked, "label").select(F.col("node").alias("labelled"), "least"), "named")
    work.drop()
    named = nodes.join(labels, F.col("node") == F.col("labelled"), "left").withColumn("rep", F.coalesce("least", "rep"))
    return keyed, named.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("rep.doc_id").alias("component_id"), "rep")


def jaccard_classes(spark: SparkSession, docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    ship(spark)
    keyed, named = _classed(spark, _texts(docs, id_col, text_col), size, scratch or Scratch(spark, "jaccard"))
    out = keyed.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(spark: SparkSession, docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of docs for each class: that of the smallest doc_id, with all its columns and no others.

    Rows without words are classes of their own. Of rows that repeat an id and
    a text (also where the id is null) one stays. A row without an id stays only
    where no row of its class has one.
    """
    ship(spark)
    scratch = Scratch(spark, "one-each")
    keyed, named = _classed(spark, _texts(docs), size, scratch)
    kept = named.select(F.col("rep.doc_id").alias("id"), F.col("rep.th").alias("kth")).unionByName(keyed.where("n = 0").select(F.col("doc_id").alias("id"), F.col("th").alias("kth")))
    kept = small(scratch.keep(kept.distinct(), "kept"))
    out = _texts(docs, "doc_id", "text", packed(docs)).join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("kth")), "left_semi")
    if not keyed.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "th"])
    return out.select("row.*")


def _crowded(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, level) of the most crowded anchors, as many as CROWDED_MAX allows; level: 1 + log2 of the count."""
    least, total = 2, 0
    for r in counts.groupBy(F.floor(F.log2("count")).alias("level")).count().orderBy(F.desc("level")).collect():  # 64 rows at most
        total += r["count"]
        if total > CROWDED_MAX:
            least = 1 << (r["level"] + 1)
            break
    found = counts.where(F.col("count") >= least).toArrow()
    s = found["s"].to_numpy().view(np.uint64)
    order = np.argsort(s)
    if not len(s):
        return np.zeros(1, np.uint64), np.zeros(1, np.uint8)
    return s[order], (1 + np.log2(found["count"].to_numpy())).astype(np.uint8)[order]


def _frequent(anchors: DataFrame) -> DataFrame:
    """(s): the anchors to split, at most SPLIT rows."""
    counts = anchors.groupBy("s").count().where(f"count >= {SPLIT_LEAST}")
    return counts.orderBy(F.desc("count"), "s").limit(SPLIT).select("s")


def _shared(anchors: DataFrame, split: DataFrame) -> DataFrame:
    """(node, n, s, room, split) of anchors that another set of their region may link by; all rows of split ones, which are judged when counted."""
    # if s is a pair's first common anchor, the set x at place i has n - i shingles left to share, so 3 * n(y) <= 4 * n(x) - 7 * i
    anchors = anchors.withColumn("room", F.expr(f"{PARTS} * n - {LEAST + PARTS} * i"))
    anchors = anchors.join(F.broadcast(split.withColumn("split", F.lit(True))), "s", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    anchors = anchors.withColumn("part", F.when(F.col("split"), F.col("node")).otherwise(F.lit(-1).cast("long"))).repartition("s", "part")
    region = Window.partitionBy("s", "part")
    anchors = anchors.select("node", "n", "s", "room", "split", *[f.over(region).alias(k) for k, f in _told().items()])
    return anchors.where(f"split or {_REACHED}").select("node", "n", "s", "room", "split")


def _told() -> dict:
    """What a region's rows say together."""
    return {"sharers": F.count("*"), "all_n": F.sum("n"), "all_room": F.sum("room"), "least_n": F.min("n"), "most_room": F.max("room")}


#: Whether some other row of the region leaves a row room for a link.
_REACHED = (
    f"((sharers = 2 and {LEAST} * (all_n - n) <= room and {LEAST} * n <= all_room - room)"
    f" or (sharers > 2 and {LEAST} * least_n <= room and {LEAST} * n <= most_room))"
)


def _with_pivots(scratch: Scratch, shared: DataFrame) -> DataFrame:
    """(s, band, node, n, pivot) of the members of each region that aren't its pivot.

    Split regions are pre-aggregated where their rows lie, and what is known of
    a region (its counts: SPLIT rows at most; its pivots: broadcast where measured
    to be small) goes to the rows, which never meet in one task.
    """
    # linked sizes differ by one band at most: a region holds two neighbouring bands, each set enters two regions
    band = F.log(BAND, F.col("n")).cast("int")
    bands = F.explode(F.array(band, band + 1)).alias("band")
    least = F.min(F.struct("node", "n"))
    rest = shared.where("not split").select("node", "n", "s", bands)
    rest = rest.withColumn("pivot", least.over(Window.partitionBy("s", "band")))
    told = scratch.keep(shared.where("split").groupBy("s").agg(*[f.alias(k) for k, f in _told().items()]), "told")
    hot = shared.where("split").join(F.broadcast(told), "s").where(_REACHED).select("node", "n", "s", bands)
    pivots = scratch.keep(hot.groupBy("s", "band").agg(least.alias("pivot")), "pivots")
    hot = hot.join(small(pivots), ["s", "band"]).select("node", "n", "s", "band", "pivot")
    return rest.unionByName(hot).where(F.col("node") != F.col("pivot.node"))


def _measure(scratch: Scratch, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Common shingles of each member and its cell's pivot. Large cells are dealt over chunks, each with a copy of the pivot."""
    cells = small(scratch.keep(members.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2 * BLOCK_SETS)).alias("chunks")), "cells"))
    rows = members.join(cells, "cell").select("cell", F.expr("pmod(xxhash64(member), chunks)").alias("chunk"), F.lit(True).alias("is_member"), "member")
    pivots = cells.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("is_member"), F.col("cell").alias("member"))
    rows = rows.unionByName(pivots).join(sets, "member").select("cell", "chunk", "is_member", "member", "shingles")
    rows = rows.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "is_member")
    return rows.mapInArrow(lean(_to_pivot), "cell long, member long, n_pivot long, n long, common long")


def _block_rows(scratch: Scratch, measured: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of each pair of blocks that may hold links the pivot doesn't show, sorted by the pair.

    What is known of a cell or ring is a written table of one row each, joined
    back by broadcast where it is measured to be small: the members of a crowded
    cell never meet in one task.
    """
    d = F.expr("1 - common / cast(n + n_pivot - common as double)")
    far = small(scratch.keep(measured.where(~F.col("direct")).groupBy("cell").agg(F.min(d).alias("nearest_far")), "far"))
    # of the members linked to the pivot only the boundary can link to the rest
    rows = measured.join(far, "cell").withColumn("d", d).where(~F.col("direct") | (F.col("d") >= F.col("nearest_far") - (1 - LEAST / PARTS) - 1e-9))
    rows = scratch.keep(rows.select("cell", "member", "n", "direct", "d"), "boundary")
    whole = rows.groupBy("cell").agg(F.count("*").alias("members"), F.sum("n").alias("volume")).where("members > 1")
    whole = small(scratch.keep(whole.select("cell", F.expr(f"members <= {BLOCK_SETS} and volume <= {BLOCK_SHINGLES}").alias("small")), "sizes"))
    rows = rows.join(whole, "cell")
    rows = rows.withColumn("ring", F.expr(f"case when small then 0 when direct then -1 - least({RINGS - 1}, floor(d * {RINGS})) else 1 + least({RINGS - 1}, floor(d * {RINGS})) end"))
    rings = rows.groupBy("cell", "ring").agg(F.expr(f"case when max(small) then 1 else greatest(ceil(count(*) / {BLOCK_SETS // 2}), ceil(sum(n) / {BLOCK_SHINGLES // 2})) end").alias("chunks"))
    rings = scratch.keep(rings, "rings")
    rows = rows.join(small(rings), ["cell", "ring"]).withColumn("block", F.expr("ring * 1000000L + pmod(xxhash64(member), chunks)"))
    blocks_ = rings.select("cell", "ring", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk")).select("cell", "ring", F.expr("ring * 1000000L + chunk").alias("block"))
    window = -(-RINGS * (PARTS - LEAST) // PARTS) + 1
    b = blocks_.select("cell", F.col("ring").alias("ring2"), F.col("block").alias("block2"))
    pairs = blocks_.join(b, "cell").where(f"block <= block2 and not (ring < 0 and ring2 < 0) and abs(abs(ring) - abs(ring2)) <= {window}")
    pairs = pairs.select("cell", F.col("block").alias("left"), F.col("block2").alias("right"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    pairs = small(scratch.keep(pairs, "pairs"))
    rows = rows.join(pairs, ["cell", "block"]).join(sets, "member")
    rows = rows.select("cell", "left", "right", "block", "direct", "member", "shingles")
    return rows.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rows in DuckDB's SQL: every pair of documents with a common shingle, and everything that links reach.
ORACLE = rf"""
with recursive doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') as w from documents),
shingle as materialized (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from doc where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by 1),
pair as (select a.doc_id as u, b.doc_id as v, count(*) as c from shingle a join shingle b using (s) where a.doc_id < b.doc_id group by 1, 2),
link as materialized (select u, v from pair join size a on a.doc_id = u join size b on b.doc_id = v where {PARTS} * c >= {LEAST} * (a.n + b.n - c)),
either as (select u, v from link union all select v, u from link),
reach as (select doc_id, doc_id as other from size union select reach.doc_id, v from reach join either on u = other)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id
from doc left join size using (doc_id) left join (select doc_id, min(other) as component_id from reach group by 1) using (doc_id)
"""
