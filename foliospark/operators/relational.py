"""Joins, rankings and merges that retrieval and administration are made of.

All take and return DataFrames; every ordering ends in a unique column, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert by key: the last row of each key in the given order (S-20, G-08, ST-02)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (A-13, U-07)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def keep_best(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of the highest score of each key (A-12)."""
    return keep_first(df, keys, [F.col(score).desc(), F.col(tie)])


def paged(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a listing (S-16, S-17)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def cascade_delete(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the keys that are gone (S-21, J-12)."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def priority_union(parts: list[DataFrame], keys: list[str], tie: list[str]) -> DataFrame:
    """Union distinct by key: a key comes from the first part that has it (U-01, U-06)."""
    whole = None
    for k, part in enumerate(parts):
        part = part.withColumn("_priority", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    return keep_first(whole, keys, [F.col("_priority"), *[F.col(t) for t in tie]]).drop("_priority")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, columns by name (U-03)."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def range_join(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, keys: list[str], cell: int = 16) -> DataFrame:
    """Rows of points and ranges with equal keys and start <= point <= end (J-05, J-06).

    A range is entered once for each cell of `cell` points that it touches, so the join is on key and cell.
    """
    cut = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    met = points.withColumn("_cell", F.floor(F.col(point) / cell)).join(cut, [*keys, "_cell"])
    return met.where(F.col(point).between(F.col(start), F.col(end))).drop("_cell")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of its keys that isn't later (J-07).

    One pass over the union, sorted within a key, instead of a join by inequality; a right row at the same time counts.
    """
    marked = left.withColumn("_right", F.lit(False)).withColumn("_new", F.lit(None).cast(_struct_type(right, values)))
    added = right.select(*keys, at, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, at)], F.lit(True).alias("_right"), F.struct(*values).alias("_new"))
    order = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_right").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = marked.unionByName(added).withColumn("_last", F.last("_new", ignorenulls=True).over(order))
    return filled.where("not _right").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def _struct_type(df: DataFrame, values: list[str]) -> str:
    return "struct<" + ",".join(f"{v}:{df.schema[v].dataType.simpleString()}" for v in values) + ">"


def fill_forward(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Nulls of value take the last one before them, and if there is none the first one after (J-08)."""
    over = Window.partitionBy(*keys).orderBy(order)
    before = F.last(value, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first(value, ignorenulls=True).over(over.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(before, first))


def theta_contains(left: DataFrame, text: Column, words: DataFrame, word: str) -> DataFrame:
    """Rows of left with each word that its text contains, case apart (J-09, J-10, J-15, P-02).

    words is a bounded vocabulary (a question's, or a pack's): it travels to the rows, which stay where they are.
    """
    return left.join(F.broadcast(words), F.contains(F.lower(text), F.lower(F.col(word))))


def confirm(hits: DataFrame, other: DataFrame, keys: list[str], bonus: str, scale: float) -> DataFrame:
    """hits with scale x the other side's value added where it has the key (J-11)."""
    return hits.join(other.select(*keys, F.col(bonus).alias("_bonus")), keys, "left").withColumn("score", F.col("score") + F.coalesce(F.col("_bonus") * scale, F.lit(0.0))).drop("_bonus")


def fill_gap(hits: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """hits and those rows of other whose key they lack (J-11)."""
    return hits.unionByName(other.join(hits.select(*keys), keys, "left_anti").select(*hits.columns))


def prefix_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: Column) -> DataFrame:
    """Rows in order as long as their running size stays within the budget (W-04)."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(size).over(over)).where(F.col("running") <= budget)


def proportional_sizes(df: DataFrame, keys: list[str], size: Column, budget: int, least: int) -> DataFrame:
    """df with allowed: each row's size, cut in proportion if all sizes exceed the budget, but not below `least` (W-05)."""
    total = F.sum(size).over(Window.partitionBy(*keys)) if keys else F.sum(size).over(Window.partitionBy(F.lit(1)))
    cut = F.least(size, F.greatest(F.lit(least), F.floor(size * budget / total)))
    return df.withColumn("allowed", F.when(total > budget, cut).otherwise(size).cast("long"))


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of consecutive rows of one value: keys, value, first, last, n (W-02, A-20)."""
    over = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(over)) | F.lag(order).over(over).isNull()).cast("int")
    numbered = df.withColumn("_run", changed)
    numbered = numbered.withColumn("_run", F.sum("_run").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def number_ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Distinct whole numbers of each key as ranges, '0-3, 5' (A-20)."""
    one = df.select(*keys, number).distinct()
    one = one.withColumn("_run", F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number)))
    runs = one.groupBy(*keys, "_run").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"])
    return runs.groupBy(*keys).agg(F.array_join(ordered, ", ").alias("ranges"), F.sum(F.col("b") - F.col("a") + 1).cast("long").alias("n"))


def section_ends(sections: DataFrame, keys: list[str], order: str, level: str, page: str, last: Column) -> DataFrame:
    """sections with end_page: the page of the next section of this level or a higher one, else the last page (W-03).

    Sorted outlines are read once, each from its end, as they lie in a partition: a task holds one section of each level
    that is still open above, whatever the number of documents and however long one is.  Sections at one place don't
    end each other, and those without a place, level or page end nothing.
    """
    over = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    numbered = sections.withColumns({"_place": F.row_number().over(over), "_rank": F.rank().over(over), "_own": F.when(F.col(order).isNotNull(), F.col(level)), "_at": F.col(page).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, held = [], []  # (level, page), levels rising towards the top; held: of the place at hand
        for batch in batches:
            ends = []
            for place, rank, own, at in zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True):
                if place == 1:
                    stack, held = [], []
                elif place == rank:
                    for one in held:
                        while stack and stack[-1][0] >= one[0]:
                            stack.pop()
                        stack.append(one)
                    held = []
                if own is None:
                    ends.append(None)
                    continue
                ends.append(next((x[1] for x in reversed(stack) if x[0] <= own), None))
                if at is not None:
                    held.append((own, at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(ends, pa.int64())], names=[*batch.schema.names[:-4], "_next"])

    kind = sections.schema[page].dataType
    found = numbered.select(*sections.columns, "_place", "_rank", "_own", "_at").mapInArrow(run, StructType([*sections.schema.fields, StructField("_next", LongType())]))
    return found.withColumn("end_page", F.coalesce(F.col("_next").cast(kind), last)).drop("_next")


def widen(pages: DataFrame, keys: list[str], page: str, radius: int, least: int) -> DataFrame:
    """Page sets of fewer than `least` pages with all pages within the radius, from page 1 on (W-07)."""
    sized = pages.select(*keys, page).distinct().withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    around = F.when(F.col("_n") < least, F.sequence(F.greatest(F.col(page) - radius, F.lit(1)), F.col(page) + radius)).otherwise(F.array(page))
    return sized.select(*keys, F.explode(around).alias(page)).distinct()


def with_next(chosen: DataFrame, index: str) -> DataFrame:
    """Chosen chapters and the one after each (W-06)."""
    return chosen.select(*[c for c in chosen.columns if c != index], F.explode(F.array(F.col(index), F.col(index) + 1)).alias(index)).distinct()


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key (W-09)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col("_rank") <= n).drop("_rank")


def df_weights(hits: DataFrame, term: str, item: str) -> DataFrame:
    """hits with df, the items that a term hits, and weight 1 / (1 + df) (A-11)."""
    counts = hits.groupBy(term).agg(F.countDistinct(item).alias("df"))
    return hits.join(counts, term).withColumn("weight", 1.0 / (1 + F.col("df")))
