"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a 48-bit hash of its id, its text and a number among rows that are equal in both.  A source that must
yield need tokens takes all documents whose hash lies under a threshold.  Four histograms of 4096 buckets each find it:
tokens are summed by source and leading 12 bits, the bucket in which the running sum passes the need is cut into 4096
again, and so on.  Only (source, bucket) sums are ever shuffled or ordered; documents are filtered where they lie and
never sorted.  Texts are read once: the rest works on what was measured.

A target above the source's size takes every document once and a threshold's share of them a second time.

Null and wordless texts have size 0 and never matter.  Rows that share an id, or have none, are told apart by their
texts; rows equal in both are numbered, so that each has a hash of its own and reruns agree on how many are taken.  Null
sources form one source, which is last.  No rows: no rows.  Other columns pass; input columns named like an output
(size, source_size, target, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 4
#: Tables with a row a source travel to the documents up to this many rows (some MB).  Beyond that only sources with a
#: share of HOT of all documents do, of which there are 1 / HOT at most; others are joined by shuffle.
TRAVELS, HOT = 100_000, 0.001
OUTPUT = ("size", "source_size", "target", "taken")


def sized(docs: DataFrame, texts: bool = True) -> DataFrame:
    """_row (the columns of docs), source, size, _key (the source), and _k, a 60-bit hash of id and text."""
    passed = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUTPUT and (texts or c != "text")]
    content = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).cast("string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.struct(*passed).alias("_row"), "source", size.alias("size"), key.alias("_key"), F.conv(F.substring(F.md5(content.cast("binary")), 1, 15), 16, 10).cast("long").alias("_k"))


def hashed(measured: DataFrame) -> DataFrame:
    """A written table of sized() with _h for _k.  Equal rows are numbered by partition, so that any number of them is no task of its own."""
    first = F.shiftright("_k", 60 - BITS * LEVELS)
    on = ["_key", "_k"]
    again = materialize(measured.groupBy(*on).count().where("count > 1").select(*on), "mix-equal")
    if again.isEmpty():
        return measured.withColumn("_h", first).drop("_k")
    several = materialize(measured.withColumn("_part", F.spark_partition_id()).join(again, on, "left_semi"), "mix-numbered")
    by_part = several.groupBy(*on, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select(*on, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*on, "_part").orderBy(F.lit(1)))
    tied = several.withColumn("_at", at).join(offsets, [*on, "_part"]).withColumn("_tie", F.col("_before") + F.col("_at"))
    later = F.concat(F.col("_k").cast("string"), F.lit(":"), F.col("_tie").cast("string"))
    other = F.shiftright(F.conv(F.substring(F.md5(later.cast("binary")), 1, 15), 16, 10).cast("long"), 60 - BITS * LEVELS)
    tied = tied.withColumn("_h", F.when(F.col("_tie") == 1, first).otherwise(other)).select(*[c for c in measured.columns if c != "_k"], "_h")
    return measured.join(again, on, "left_anti").withColumn("_h", first).drop("_k").unionByName(tied)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """From (source, source_size, _key), one row a source, its target: weight-proportional shares of share x all, none above most x its size.

    What a capped source leaves goes to the others by weight until none is above.  Ordered by cap a weight, the sources
    that end at their cap come first, so running sums over the few source rows give the common level at once.
    """
    n = len(weights)
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = capped.withColumn("level", level)
    # the first source that stays under its cap sets the level; before it, all are capped
    common = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("place_by_cap"))).over(everything)
    leveled = leveled.withColumn("place_by_cap", F.row_number().over(by_cap)).withColumn("first_free", common)
    final = F.max(F.when(F.col("place_by_cap") == F.col("first_free"), F.col("level"))).over(everything)
    leveled = leveled.withColumn("final", final)
    target = F.when(F.col("first_free").isNull() | (F.col("place_by_cap") < F.col("first_free")), F.col("cap")).otherwise(F.col("weight") * F.col("final"))
    return leveled.select("_key", "source_size", target.alias("target"))


def _with_source(rows: DataFrame, small: DataFrame) -> DataFrame:
    """rows joined on _key with a written table of a row a source, which has _hot."""
    if small.count() <= TRAVELS:
        return rows.join(F.broadcast(small.drop("_hot")), "_key")
    hot, rest = small.where("_hot").drop("_hot"), small.where("not _hot").drop("_hot")
    apart = rows.join(F.broadcast(hot.select("_key")), "_key", "left_anti").join(rest, "_key")
    return rows.join(F.broadcast(hot), "_key").unionByName(apart)


def thresholds(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source (_key) with a need, the first hash (_h) that is not taken, so that the taken tokens come as near as documents allow."""
    state = wanted.select("_key", "_hot", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        rows = docs if level == 1 else _with_source(docs, state.select("_key", "_hot", F.col("prefix").alias("at"))).where(F.shiftright("_h", shift + BITS) == F.col("at"))
        sums = rows.groupBy("_key", F.shiftright("_h", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("tokens"))
        running = F.sum("tokens").over(Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ahead = sums.withColumn("running", running).join(state.select("_key", "need", "below"), "_key").withColumn("sum", F.col("below") + F.col("running"))
        # the boundary bucket is the first whose sum passes the need; if none does, everything is taken
        passed = F.col("sum") > F.col("need")
        edge = ahead.where(passed).groupBy("_key").agg(F.min_by(F.struct("bucket", "sum", "tokens"), "bucket").alias("x"))
        state = materialize(edge.join(state.select("_key", "_hot", "need"), "_key").select("_key", "_hot", "need", F.col("x.bucket").alias("prefix"), (F.col("x.sum") - F.col("x.tokens")).alias("below"), F.col("x.sum").alias("over")), f"mix-{level}")
    # at the last level a bucket is one hash: it is taken too if that comes nearer
    return state.select("_key", (F.col("prefix") + F.when(F.col("over") - F.col("need") < F.col("need") - F.col("below"), 1).otherwise(0)).alias("_limit"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, texts: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken, the tokens that the mix takes of each (0, size, ... up to most times size); without text if not `texts`."""
    if most != int(most):
        raise ValueError("most is a whole number of passes over a source")
    rows = hashed(materialize(sized(docs, texts), "mix-sizes"))
    light = rows.select("_key", "_h", "size")
    sources = rows.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(sources, "mix-sources")
    every = sources.agg(F.sum("n")).first()[0] or 0
    goal = targets(sources.select("source", "source_size", "_key"), weights, share, most).join(sources.select("_key", (F.col("n") >= HOT * every).alias("_hot")), "_key")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = materialize(goal.withColumn("_whole", whole).withColumn("need", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-goal")
    limits = thresholds(light, goal)
    plan = goal.join(limits, "_key", "left").select("_key", "_hot", "source_size", "target", "_whole", F.coalesce("_limit", F.lit(0)).alias("_limit"))
    extra = F.when(F.col("_h") < F.col("_limit"), 1).otherwise(0)
    mixed = _with_source(rows, materialize(plan, "mix-plan"))
    taken = (F.col("size") * F.least(F.col("_whole") + extra, F.lit(int(most)))).cast("long")
    return mixed.select("_row.*", "size", "source_size", "target", taken.alias("taken"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, texts=False).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
with d as (
  select doc_id, source, size, ('0x' || substr(case when tie = 1 then m else md5(k::varchar || ':' || tie::varchar) end, 1, 12))::bigint as h
  from (
    select doc_id, source, size, m, k, row_number() over (partition by source, k) as tie
    from (
      select doc_id, source, m, ('0x' || substr(m, 1, 15))::bigint as k, size
      from (
        select doc_id, source, md5(coalesce(doc_id::varchar, 'null') || ':' || coalesce(text, '')) as m,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents)))),
s as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1)::bigint as place from d group by source),
w as (select *, case place % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2.0::double as cap from s),
l as (
  select *, row_number() over (order by cap / weight, place) as k,
    (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level from w),
f as (select *, min(case when level * weight <= cap then k end) over () as first_free from l),
g as (select *, max(case when k = first_free then level end) over () as final from f),
t as (
  select source, source_size, case when first_free is null or k < first_free then cap else weight * final end as target from g),
n as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
    target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size as need from t),
c as (
  select d.doc_id, d.size, d.h, n.source_size, n.target, n.whole, n.need,
    sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row)::double as running,
    sum(d.size) over (partition by d.source, d.h)::double as own
  from d join n on d.source is not distinct from n.source)
select doc_id, size, source_size, target,
  (size * least(2, whole + case when running <= need or (running - own <= need and running - need < need - (running - own)) then 1 else 0 end))::bigint as taken
from c
"""
