"""Layout operators on boxes made from line items: an order is a page, its lines are boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..registry import query, table

_BOX = "l_orderkey as page, l_linenumber as box, (l_partkey % 500)::double as x1, (l_suppkey % 700)::double as y1, (l_partkey % 500 + 40 + l_quantity)::double as x2, (l_suppkey % 700 + 30 + l_quantity)::double as y2"


def boxes(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    x, y, q = F.col("l_partkey") % 500, F.col("l_suppkey") % 700, F.col("l_quantity")
    made = {"x1": x, "y1": y, "x2": x + 40 + q, "y2": y + 30 + q}
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias(f"{prefix}box"), *[v.cast("double").alias(prefix + k) for k, v in made.items()])


@query(f"""
with b as (select {_BOX} from lineitem), p as (select a.page, a.box as a_box, b.box as b_box, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as s, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as t from b a join b on a.page = b.page and a.box < b.box)
select page, a_box, b_box, round(s / (t - s), 6) as iou from p where s / (t - s) > 0.2
""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-14: boxes of a page that overlap."""
    pairs = L.overlapping(boxes(spark, sf_dir, "a_"), boxes(spark, sf_dir, "b_"), "page", 0.2)
    return pairs.where("a_box < b_box").select("page", "a_box", "b_box", F.round("iou", 6).alias("iou"))


@query(f"""
with b as (select {_BOX} from lineitem), m as (select * from b where box % 2 = 1), c as (select * from b where box % 2 = 0),
d as (select m.page, m.box as media, c.box as caption, abs((m.y1 + m.y2) / 2 - (c.y1 + c.y2) / 2) as gap from m join c using (page)), n as (select page, media, min_by(caption, (gap, caption)) as caption from d where gap < 150 group by all)
select m.page, m.box as media, n.caption from m left join n on m.page = n.page and m.box = n.media
""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13: the nearest caption of each picture."""
    named = lambda p, c: boxes(spark, sf_dir, p).withColumnRenamed(f"{p}box", c)
    return L.nearest_caption(named("m_", "media").where("media % 2 = 1"), named("c_", "caption").where("caption % 2 = 0"), "page")


@query(f"""
with b as (select {_BOX} from lineitem), c as (select *, (x1 + x2) / 2 as c from b), m as (select page, (min(c) + max(c)) / 2 as mid, count(*) as n from c group by page),
s as (select page, n, count(*) filter (c < mid) as l, count(*) filter (c >= mid) as r from c join m using (page) group by page, n),
g as (select page, x1 - lag(x1) over (partition by page order by x1) as gap from b), k as (select page, count(*) as n, count(*) filter (gap > 0.15 * 500) as k from g group by page)
select s.page, case when s.n >= 3 and l >= 2 and r >= 2 and abs(l - r) <= 0.5 * greatest(l, r) then 2 else 1 end::int as by_halves, case when k.n < 3 then 1 else least(k + 1, 3) end::int as by_gaps from s join k using (page)
""")
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-60: columns of pages by two rules."""
    b = boxes(spark, sf_dir)
    halves = L.columns_by_halves(b, "page").withColumnRenamed("columns", "by_halves")
    return halves.join(L.columns_by_gaps(b, "page", "x1", 500.0).withColumnRenamed("columns", "by_gaps"), "page")


@query(f"""
with b as (select distinct {_BOX.replace("l_linenumber as box", "l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity::bigint as box")} from lineitem), o as (select page, box, row_number() over (partition by page order by least(floor((x1 + x2) / 2 / 250), 1), y1, x1, box) as ord, row_number() over (partition by page order by (x2 - x1) * (y2 - y1) desc, box) as size_rank from b)
select page, box, ord::int as ord, size_rank <= 4 as large from o
""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-09, T-10: boxes in reading order, and the four largest."""
    b = named_boxes(spark, sf_dir)
    large = L.largest_regions(b, "page", "box").select("page", "box", F.lit(True).alias("large"))
    ordered = L.reading_order(b, "page", F.lit(2), 500.0, "box").select("page", "box", "ord")
    return ordered.join(large, ["page", "box"], "left").select("page", "box", "ord", F.coalesce("large", F.lit(False)).alias("large"))


def named_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a name of their own on a page."""
    x, y, q = F.col("l_partkey") % 500, F.col("l_suppkey") % 700, F.col("l_quantity")
    made = {"x1": x, "y1": y, "x2": x + 40 + q, "y2": y + 30 + q}
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("box"), *[v.cast("double").alias(k) for k, v in made.items()]).distinct()


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as t from documents)
select kind, count(*) as n from (select case
  when length(t) < 50 and (regexp_matches(t, '^[\d.\s]+') or (length(t) < 30 and not regexp_matches(t, '[，。；：]'))) and length(t) < 20 and not regexp_matches(t, '[：:]$') then 'title'
  when length(t) < 50 and (regexp_matches(t, '^[\d.\s]+') or (length(t) < 30 and not regexp_matches(t, '[，。；：]'))) then 'section-header'
  when regexp_matches(t, '(?i)^(图\s*\d+|Fig\.?\s*\d+|Figure\s*\d+|表\s*\d+|Table\s*\d+)') then 'caption'
  when length(t) < 200 and regexp_matches(t, '^[*※①\[(]') and regexp_matches(t, '注|note|参考|ref') then 'footnote'
  when regexp_matches(t, '^\s*[•\-*\d+.①-⓿]\s') then 'list-item'
  when len(regexp_extract_all(t, '[=+\-×÷ΣΠ∂∫√≠≤≥∞αβγ^_{}]')) / greatest(length(t), 1) > 0.1 then 'formula' else 'text' end as kind from l) group by kind
""")
def element_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-61: kinds of text elements."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("t"))
    return lines.groupBy(L.element_type(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query("""
with e as (select conv_id as page, role as kind, text from conversations), c as (select page, count(*) as n, sum(length(text)) as chars, bool_or(contains(lower(text), 'appendix')) as appendix, count(*) filter (regexp_matches(lower(text), 'name|address|tel|phone|email')) as fields, bool_or(contains(lower(text), 'cover')) as cover, count(*) filter (regexp_matches(text, '^[\\d.\\s]+')) as numbered, bool_or(contains(lower(text), 'contents')) as toc from e group by page)
select page, case when cover and n < 5 then 'cover' when toc and numbered >= 3 then 'toc' when fields >= 3 then 'form' when appendix then 'appendix' when chars < 50 then 'blank' else 'text_body' end as page_type from c
""")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-61: kinds of pages from their elements."""
    return L.page_type(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("role").alias("kind"), "text"), "page")


_MARK = """
b as (select l_suppkey as doc, l_orderkey as page, (l_linenumber % 4 * 15 + l_suppkey % 3 * 20)::double as angle, (l_suppkey % 7 * 50)::double as x, (l_linenumber % 2 * 50)::double as y, round(l_discount * 8, 2) as gray, (l_linenumber % 5 + 1)::int as segments, 1 as dist, 50 as size from lineitem),
s as (select *, not (abs(angle) < 15 or abs(angle - 180) < 15 or abs(angle - 90) < 15 or abs(angle + 90) < 15) as slanted from b),
t as (select *, least(case when slanted then 0.4::double + case when abs(angle) % 90 between 15 and 75 then 0.2::double else 0 end + case when abs(angle) % 90 between 30 and 60 then 0.1::double else 0 end else 0::double end + case when gray > 0.3 then 0.15::double else 0 end + case when segments > 1 and dist < segments and segments / dist > 2 then 0.15::double else 0 end, 1.0::double) as score from s)"""


@query(f"with {_MARK} select doc, round(angle)::bigint as angle, count(*) as n, round(sum(score), 6) as score from t group by all")
def watermark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-57: scores of text blocks."""
    b = marks(spark, sf_dir).withColumn("score", L.watermark_score(F.col("angle"), F.col("gray"), F.col("segments"), F.col("distinct")))
    return b.groupBy("doc", F.round("angle").cast("long").alias("angle")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        s.alias("doc"), F.col("l_orderkey").alias("page"), (n % 4 * 15 + s % 3 * 20).cast("double").alias("angle"), (s % 7 * 50).cast("double").alias("x"), (n % 2 * 50).cast("double").alias("y"),
        F.round(F.col("l_discount") * 8, 2).alias("gray"), (n % 5 + 1).cast("int").alias("segments"), F.lit(1).alias("distinct"), F.lit(50).alias("size"),
    )


@query("""
with b as (select l_suppkey as doc, l_orderkey as page, (l_suppkey % 7 * 50)::double as x, least(0.85::double + case when l_linenumber % 5 + 1 > 2 then 0.15::double else 0 end, 1.0::double) as score from lineitem),
g as (select doc, '45.0_' || x::varchar || '_0.0_0.5' as signature, count(*) as n, avg(score) as score, count(distinct page) as pages from b group by doc, x)
select doc, signature, n, round(score, 6) as score from g where n >= greatest(2, floor(0.7 * pages)) and score > 0.5
""")
def watermark_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16: watermarks by recurring signatures."""
    return L.watermarks(marks(spark, sf_dir).withColumns({"gray": F.lit(0.5), "angle": F.lit(45.0), "y": F.lit(0.0)}))


@query("""
select p_partkey as doc, 1 as page, (63 + length(p_size::varchar) + length(p_name))::int as size, 45.0::double as angle, p_size::double as x, 40.0::double as y, 'F1' as font, 0.5::double as gray, 1 as segments, 1 as distinct, p_name as text from part
union all select p_partkey, 1, 39, 0.0, 10.0, 20.0, '', 0.0, 1, 1, 'ab' from part
""")
def content_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-58: text blocks of content streams, made from catalogue rows."""
    stream = F.concat(F.lit("q BT /F1 12 Tf 0.7071 0.7071 -0.7071 0.7071 "), F.col("p_size").cast("string"), F.lit(" 40 Tm 0.5 g ("), "p_name", F.lit(") Tj ET Q BT 1 0 0 1 10 20 Tm [(a) -20 (b)] TJ ET"))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), stream.cast("binary").alias("stream"))
    return L.stream_blocks(pages).withColumn("angle", F.round("angle", 6))


@query(f"""
with b as (select {_BOX} from lineitem), c as (select page, box as caption, x1, greatest(y1 - 300, 0) as y0, x2, y1 as yb from b where box = 1), t as (select * from b where box > 1),
o as (select c.page, c.caption, c.x1, y0, c.x2, yb, sum(coalesce(greatest(least(c.x2, t.x2) - greatest(c.x1, t.x1), 0) * greatest(least(yb, t.y2) - greatest(y0, t.y1), 0), 0)) as covered from c left join t on c.page = t.page group by all)
select page, caption, round(covered / nullif((x2 - x1) * (yb - y0), 0), 6) as cover from o where covered / nullif((x2 - x1) * (yb - y0), 0) < 0.35
""")
def chart_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-70: bands above captions with little text."""
    captions = boxes(spark, sf_dir, "c_").withColumnRenamed("c_box", "caption").where("caption = 1")
    return L.chart_regions(captions, boxes(spark, sf_dir, "t_").where("t_box > 1"), "page").select("page", "caption", F.round("cover", 6).alias("cover"))
