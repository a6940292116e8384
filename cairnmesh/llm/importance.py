"""Target-distribution importance resampling, in DataFrame functions only.

Words (as in ``winnow``: runs outside \\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F, A-Z as
a-z) give features, all runs of the given numbers of consecutive words; a
feature's bucket is its crc32 modulo `buckets`. Both tables' features are
exploded and counted by bucket (summed before the shuffle), which gives every
bucket a gain, the log ratio of its shares in target and corpus. The gains, one
row a bucket whatever the corpus, are broadcast and joined to the exploded
features again, and summed by document. A Gumbel number from the document's id
turns the weights into a draw without replacement: the highest scores win.

Ranks come from a distributed sort: rows are range-partitioned by score and
numbered inside their partition, and each partition adds the rows of those
before it. No task holds more than its range, and no key is gathered.

Defined cases: a null or empty text has no features, weight 0 and can't be
drawn; a text of any length is one array of words; a null doc_id takes the
empty string's number and comes after other ids at equal scores; rows that
repeat an id are scored and ranked each by its own text, equal ones in any
order; an empty target gives the gains of zero counts; an empty table gives an
empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch
from .winnow import words

ORDERS, BUCKETS, PERCENT, LEAST, SEED = (1, 1), 10_000, 10, 20, 2024


def features(w: Column, orders: tuple[int, int] = ORDERS) -> Column:
    """All runs of orders[0] to orders[1] consecutive words of an array, joined by a space."""

    def of(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, n)))
        return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<string>"))

    runs = [w if n == 1 else of(n) for n in range(orders[0], orders[1] + 1)]
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def bucket_counts(table: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""
    one = table.select(F.explode(features(words(F.col("text").cast("string")), orders)).alias("f"))
    return one.groupBy(bucket(F.col("f"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(spark: SparkSession, docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, scratch: Scratch | None = None) -> DataFrame:
    """(bucket, gain) for each of the buckets: 1000 times the log ratio of add-one shares, rounded down."""
    scratch = scratch or Scratch(spark, "importance")
    s, t = scratch.keep(bucket_counts(docs, orders, buckets), "source"), scratch.keep(bucket_counts(target, orders, buckets), "target")
    total = lambda x: float(x.agg(F.sum("n")).first()[0] or 0)
    all_s, all_t = total(s), total(t)
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
    plus = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    ratio = plus("t") * F.lit(all_s + buckets) / (plus("s") * F.lit(all_t + buckets))
    return scratch.keep(both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")), "gains")


def scores(docs: DataFrame, gain: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs. A document's sums are made where its features are exploded, before any shuffle."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    rows = rows.select("rid", "doc_id", F.size("w").alias("n_words"), F.explode_outer(features(F.col("w"), orders)).alias("f")).withColumn("bucket", bucket(F.col("f"), buckets))
    held = rows.join(F.broadcast(gain), "bucket", "left")  # as many rows as buckets
    one = held.groupBy("rid", "doc_id", "n_words").agg(F.count("f").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return one.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + luck).alias("score"))


def ranked(scratch: Scratch, table: DataFrame, *order: Column) -> DataFrame:
    """The table with `rank` (1, 2, 3... in this order) from one distributed sort and the partitions' offsets."""
    # an id made after the sort holds the partition in its upper bits and the place in it below
    placed = scratch.keep(table.orderBy(*order).withColumn("placed", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("placed", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.col("placed").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("part", F.shiftright("placed", 33)).join(F.broadcast(offsets), "part")
    return out.withColumn("rank", (F.col("offset") + nth + 1).cast("long")).drop("part", "placed", "offset")


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS,
    percent: int = PERCENT, least: int = LEAST, seed: int = SEED, scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs; rank is null where a row isn't drawn."""
    scratch = scratch or Scratch(spark, "importance")
    scored = scratch.keep(scores(docs, gains(spark, docs, target, orders, buckets, scratch), orders, buckets, seed), "scored")
    able = F.col("n_words") >= least
    drawn = scored.where(able).count() * percent // 100
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("n_features"), F.asc("weight"))
    some = ranked(scratch, scored.where(able), *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32_sql(value: str) -> str:
    """DuckDB has no crc32: a reduction over the bytes of `value` with the table `crc(entry)` that CRC makes, which must stand in the FROM clause."""
    octets = f"list_transform(range(cast(len(hex({value})) / 2 as bigint)), lambda p: cast('0x' || substr(hex({value}), cast(2 * p + 1 as bigint), 2) as bigint))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(entry[xor(c & 255, b) + 1], c >> 8), cast(4294967295 as bigint)), cast(4294967295 as bigint))"


#: One row: the table of the reflected polynomial 0xEDB88320.
CRC = """crc as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as bigint)) else c >> 1 end, cast(n as bigint)) order by n) as entry
  from range(256) as r(n))"""

ORACLE = rf"""
with {CRC},
doc as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
aim as (select unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as f from benchmark),
used as (select rid, unnest(w) as f from doc),
bucketed as (select f, {crc32_sql("f")} % {BUCKETS} as b from (select f from used union select f from aim), crc),
s as (select b, count(*) as s from used join bucketed using (f) group by b),
t as (select b, count(*) as t from aim join bucketed using (f) group by b),
total as (select (select count(*) from used) as all_s, (select count(*) from aim) as all_t),
gain as (select b, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (all_s + {BUCKETS}.0::double) / ((coalesce(s, 0) + 1.0::double) * (all_t + {BUCKETS}.0::double)))) as bigint) as g
  from range({BUCKETS}) as r(b) left join s using (b) left join t using (b), total),
weighed as (select rid, sum(g) as weight from used join bucketed using (f) join gain using (b) group by rid),
scored as (select doc_id, len(w) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) as score
  from doc left join weighed using (rid)),
placed as (select *, case when n_features >= {LEAST} then row_number() over (partition by n_features >= {LEAST} order by score desc, doc_id) end as place, (select count(*) from scored where n_features >= {LEAST}) as able from scored)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when place <= {PERCENT} * able // 100 then place end as rank from placed
"""
