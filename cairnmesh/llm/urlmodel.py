"""URL filter by the ratio of two character models, in DataFrame functions only.

Rules (host suffix, path prefix) decide the urls they fit; the longest rule
wins. Half of the decided urls (by a hash) are the training text of two
variable-order Markov models, one of accepted and one of rejected urls. A
character's probability after a context of ORDER characters is interpolated
with that after the next shorter context (Witten-Bell: the shorter one's weight
is the number of the longer one's different followers over that number plus its
count), down to a uniform one; a context that a class has never seen leaves all
weight to the shorter one. So each class's probabilities sum to one. A url
without a rule is rejected when its log-likelihood difference per character is
below a threshold, which is calibrated on the other half of the decided urls:
the middle of the cuts that give the best mean of the two classes' recalls.

Every place of a url is one gram of ORDER + 1 characters (start marks before
the first), so all counts follow from those of the distinct grams, and each
distinct gram's ratio is computed once, level by level. The most frequent grams
(at most HEAD) go to every task, places with the others are joined by shuffle:
a gram that all urls hold is never a key of a shuffle.

Defined cases: a null url or one without "://" has an empty host and path and
no rule; a null or empty url is allowed (there is nothing to judge; its
difference is 0); where a half lacks one class, both learn from and calibrate on
all decided urls; without decided urls of both classes every difference is 0 and
every url is allowed; repeated rows get the same verdict each. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

#: Fixed by the contract, longest rule first: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 4
#: Symbols of the uniform distribution below the shortest context.
SYMBOLS = 256
#: Grams that every task gets at most (ORDER + 1 characters and a number each).
HEAD = 200_000
#: Characters of urls that one task cuts into grams, about.
TASK_CHARS = 1 << 20
STEPS = 200
MARK = "\x02"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _places(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep..., gram): for each character of a url, it and the ORDER before it."""
    grams = F.expr(f"transform(sequence(1, length(url)), i -> substring(concat('{MARK * ORDER}', url), i, {ORDER + 1}))")
    return texts.where("length(url) > 0").select(*keep, F.explode(grams).alias("gram"))


def _ratios(scratch: Scratch, grams: DataFrame) -> DataFrame:
    """(gram, places, ratio) of grams (gram, a, r, places): log10 of a gram's last character's accepted over its rejected probability."""
    low = None
    for n in range(1, ORDER + 2):
        end = F.expr(f"right(gram, {n})")
        here = grams.groupBy(end.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("ctx", F.expr(f"left(g, {n - 1})"))
        seen = [e for c in ("a", "r") for e in (F.sum(c).alias(f"all_{c}"), F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"kinds_{c}"))]
        here = here.join(here.groupBy("ctx").agg(*seen), "ctx")
        if low is None:
            here = here.withColumns({"low_a": F.lit(1.0 / SYMBOLS), "low_r": F.lit(1.0 / SYMBOLS)})
        else:
            here = here.withColumn("tail", F.expr(f"right(g, {n - 1})")).join(low.toDF("tail", "low_a", "low_r"), "tail")
        for c in ("a", "r"):
            here = here.withColumn(f"p_{c}", F.expr(f"case when all_{c} = 0 then low_{c} else ({c} + kinds_{c} * low_{c}) / (all_{c} + kinds_{c}) end"))
        low = here.select("g", "p_a", "p_r")
        if n <= ORDER:
            low = scratch.keep(low, f"level{n}")
    return grams.select("gram", "places").join(low.withColumnRenamed("g", "gram"), "gram").select("gram", "places", F.expr("log10(p_a) - log10(p_r)").alias("ratio"))


def _scores(scratch: Scratch, texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(url, total): the sum of each url's ratios."""
    level = F.floor(F.log2("places") * 8)
    least, inside, all_ = 0, 0, 0
    bins = sorted(ratios.groupBy(level.alias("level")).count().collect(), key=lambda b: -b["level"])  # 512 rows at most
    for b in bins:
        all_ += b["count"]
        if all_ <= HEAD:
            least, inside = b["level"], all_
    often = level >= least if inside else F.lit(False)
    head, rest = F.broadcast(ratios.where(often).select("gram", "ratio")), ratios.where(~often).select("gram", "ratio")  # HEAD rows at most
    places = _places(texts, "url")
    parts = places.join(head, "gram").groupBy("url").agg(F.sum("ratio").alias("total"))
    if inside < all_:
        parts = parts.unionByName(places.join(head, "gram", "left_anti").join(rest, "gram").groupBy("url").agg(F.sum("ratio").alias("total")))
    return parts.groupBy("url").agg(F.sum("total").alias("total"))


def _threshold(held: DataFrame, allowed: int, blocked: int) -> float:
    """Middle of the cuts on scores of decided urls (score, ruled, times) with the best mean of both recalls."""
    ends = held.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    step = (ends["high"] - ends["low"]) / STEPS
    if step <= 0:
        return float("-inf")
    count = lambda v: F.sum(F.when(F.col("ruled") == v, F.col("times")).otherwise(0)).alias(v)
    at = F.least(F.lit(STEPS - 1), F.floor((F.col("score") - ends["low"]) / step))
    bins = {b["at"]: b for b in held.groupBy(at.alias("at")).agg(count("allow"), count("block")).collect()}  # STEPS rows at most
    good, bad, best, cuts = allowed, 0, -1, []
    for k in range(STEPS + 1):  # a cut at low + k * step; both recalls by their common denominator
        gain = good * blocked + bad * allowed
        if gain > best:
            best, cuts = gain, [k]
        elif gain == best and cuts[-1] == k - 1:
            cuts.append(k)
        if k in bins:
            good, bad = good - bins[k]["allow"], bad + bins[k]["block"]
    return ends["low"] + (cuts[0] + cuts[-1]) / 2 * step


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES, scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (difference per character) and threshold of each row of pages."""
    scratch = scratch or Scratch(spark, "urls")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("ruled", verdict)
    texts = rows.groupBy("url", "ruled").agg(F.count("*").alias("times")).withColumn("half", F.expr("substring(md5(url), 1, 1) < '8'"))
    texts = scratch.keep(texts, "texts")
    decided = {(r["ruled"], r["half"]): r["n"] for r in texts.where("ruled is not null").groupBy("ruled", "half").agg(F.sum("times").alias("n")).collect()}  # 4 rows
    apart = len(decided) == 4
    total = {v: sum(n for (ruled, half), n in decided.items() if ruled == v and not (apart and half)) for v in ("allow", "block")}
    if not total["allow"] or not total["block"]:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"), F.lit(float("-inf")).alias("threshold"))

    chars = texts.agg(F.sum(F.length("url"))).first()[0]
    texts = texts.repartition(int(chars // TASK_CHARS) + 1, "url")  # a few bytes of a url become ORDER + 1 times as many
    learn = "ruled is not null and half" if apart else "ruled is not null"
    count = lambda v: F.sum(F.when(F.expr(learn) & (F.col("ruled") == v), F.col("times")).otherwise(0)).alias
    grams = _places(texts, "ruled", "half", "times").groupBy("gram").agg(count("allow")("a"), count("block")("r"), F.count("*").alias("places"))
    ratios = scratch.keep(_ratios(scratch, scratch.keep(grams, "grams")), "ratios")
    scored = texts.join(_scores(scratch, texts, ratios), "url", "left").withColumn("score", F.expr("coalesce(total / length(url), 0D)"))
    scored = scratch.keep(scored.select("url", "ruled", "half", "times", "score"), "scored")
    threshold = _threshold(scored.where("ruled is not null" + (" and not half" if apart else "")), total["allow"], total["block"])
    out = rows.join(scored.select("url", "score"), "url")
    said = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when((F.length("url") > 0) & (F.col("score") < threshold), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def _level(n: int) -> str:
    """SQL for the probabilities of the grams of n characters: (g, p_a, p_r)."""
    low = f"select g, {1 / SYMBOLS} as low_a, {1 / SYMBOLS} as low_r from" if n == 1 else f"select h.g, p_a as low_a, p_r as low_r from level{n - 1} l join"
    on = "" if n == 1 else f" on right(h.g, {n - 1}) = l.g"
    p = ", ".join(f"case when all_{c} = 0 then low_{c} else ({c} + kinds_{c} * low_{c}) / (all_{c} + kinds_{c}) end as p_{c}" for c in ("a", "r"))
    return f"""here{n} as (select right(gram, {n}) as g, left(right(gram, {n}), {n - 1}) as ctx, sum(a) as a, sum(r) as r from gram group by 1, 2),
after{n} as (select ctx, sum(a) as all_a, sum(r) as all_r, sum(cast(a > 0 as int)) as kinds_a, sum(cast(r > 0 as int)) as kinds_r from here{n} group by 1),
low{n} as ({low} here{n} h{on}),
level{n} as (select g, {p} from here{n} join after{n} using (ctx) join low{n} using (g))"""


def _case(what: str) -> str:
    fits = "".join(f" when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p if what == 'rule' else v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"case{fits} end as {what}"


#: The same rows in DuckDB's SQL, for tables whose halves both hold both classes.
ORACLE = rf"""
with page as (select page_id, coalesce(url, '') as url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
judged as (select *, {_case('rule')}, {_case('ruled')} from page),
texts as (select url, ruled, substring(md5(url), 1, 1) < '8' as half, count(*) as times from judged group by 1, 2, 3),
place as (select *, substring(concat(repeat(chr(2), {ORDER}), url), cast(unnest(range(1, length(url) + 1)) as int), {ORDER + 1}) as gram from texts),
gram as (select gram, sum(case when half and ruled = 'allow' then times else 0 end) as a, sum(case when half and ruled = 'block' then times else 0 end) as r from place group by 1),
{", ".join(_level(n) for n in range(1, ORDER + 2))},
score as (select url, sum(log10(p_a) - log10(p_r)) / any_value(length(url)) as score from place join level{ORDER + 1} on gram = g group by url),
held as (select * from score join texts using (url) where ruled is not null and not half),
ends as (select min(score) as low, (max(score) - min(score)) / {STEPS} as step from held),
whole as (select sum(case when ruled = 'allow' then times else 0 end) as allowed, sum(case when ruled = 'block' then times else 0 end) as blocked from held),
bin as (select least({STEPS - 1}, floor((score - low) / step)) as slot, ruled, times from held, ends),
gain as (select k, (allowed - coalesce(sum(case when slot < k and ruled = 'allow' then times end), 0)) * blocked + coalesce(sum(case when slot < k and ruled = 'block' then times end), 0) * allowed as gain
  from range({STEPS + 1}) cut(k), bin, whole group by k, allowed, blocked),
best as (select k, k - row_number() over (order by k) as run from gain where gain = (select max(gain) from gain)),
cut as (select low + (min(k) + max(k)) / 2.0 * step as threshold from best, ends where run = (select min(run) from best) group by low, step)
select page_id, host, path, rule, case when ruled is not null then ruled when url <> '' and score < threshold then 'block' else 'allow' end as verdict,
  round(coalesce(score, 0), 6) as score, round(threshold, 6) as threshold
from judged left join score using (url), cut
"""
