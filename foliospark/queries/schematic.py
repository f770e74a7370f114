"""Circuit-diagram operators on pages made from the catalogue, and retrieval by vectors first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import schematic as S
from ..registry import query, table
from .retrieval import _COS, _and_or, _page_bm25

_PAGE = "select p_partkey, p_name as title, 'C' || p_partkey || ' 10uF R' || p_size || ' C' || p_partkey || ' VDD_' || upper(string_split(p_name, ' ')[1]) || ' ' || (p_size % 5) || '.' || (p_partkey % 9) || 'V VDD_' || upper(string_split(p_name, ' ')[1]) || ' 9V GND ' || case when p_size % 3 = 0 then 'power tree ' else '' end || 'I2C_SDA U' || (p_partkey % 7) as text from part"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rail = F.concat(F.lit("VDD_"), F.upper(F.split("p_name", " ")[0]), F.lit(" "))
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    text = F.concat(F.lit("C"), s("p_partkey"), F.lit(" 10uF R"), s("p_size"), F.lit(" C"), s("p_partkey"), F.lit(" "), rail, s(F.col("p_size") % 5), F.lit("."), s(F.col("p_partkey") % 9), F.lit("V "), rail, F.lit("9V GND "), F.when(F.col("p_size") % 3 == 0, "power tree ").otherwise(""), F.lit("I2C_SDA U"), s(F.col("p_partkey") % 7))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), text.alias("text"))


@query(rf"""
with p as ({_PAGE}), x as (select *, regexp_extract_all(text, '\b([CRUQLDBVFMJXT]\d+[A-Z]?)\b', 1) as refs, regexp_extract_all(text, '\b((?:VDDA|VDD|VCC)_[A-Z0-9_]+)\s+(\d+(?:\.\d+)?V)', 2) as volts, regexp_extract_all(text, '\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b', 1) as nets from p)
select p_partkey, case when contains(text, 'power tree') then 'power_tree' else 'unknown' end as kind, array_to_string(list_filter(refs, lambda r, i: list_position(refs, r) = i), ' ') as parts, volts[1] as voltage, len(list_distinct(nets)) as nets, len(list_filter(list_distinct(refs), lambda r: contains(lower(r), 'c'))) as caps from x
""")
def schematic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-05, X-07, F-38, K-17: parts, nets and rails of circuit pages."""
    t = F.col("text")
    parts = S.components(t)
    return sheets(spark, sf_dir).select(
        "p_partkey", S.page_kind(t, F.col("title")).alias("kind"), F.array_join(F.transform(parts, lambda c: c["ref"]), " ").alias("parts"), S.power(t)[0]["voltage"].alias("voltage"),
        F.size(S.nets(t)).cast("long").alias("nets"), F.size(S.find(parts, "ref", F.lit("c"))).cast("long").alias("caps"),
    )


@query(rf"""
with p as ({_PAGE}), r as (select *, string_agg(text, ' ') over (order by p_partkey rows between 5 preceding and current row) as near from p)
select p_partkey, case when p_partkey % 50 = 0 or len(regexp_extract_all(near, '\b[RCUQLDBVFM]\d{{3,}}\b')) >= 10 then 'schematic' end as subtype from r
""")
def schematic_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-08: documents that are circuit diagrams, by name or content."""
    from pyspark.sql import Window

    numbered = sheets(spark, sf_dir).withColumn("block", F.floor(F.col("p_partkey") / 6))
    # the five sheets before each, from its own block of six and the one before
    both = numbered.withColumn("home", F.col("block")).unionByName(numbered.withColumns({"home": F.col("block") + 1}))
    over = Window.partitionBy("home").orderBy("p_partkey").rowsBetween(-5, 0)
    near = both.withColumn("near", F.array_join(F.collect_list("text").over(over), " ")).where("home = block")
    name = F.when(F.col("p_partkey") % 50 == 0, "board_sch.pdf").otherwise("board.pdf")
    return near.select("p_partkey", S.subtype(name, F.lit(""), F.col("near")).alias("subtype"))


@query("""
with p as (select p_partkey, p_size % 4 as k, p_size, upper(string_split(p_name, ' ')[1]) as w from part)
select p_partkey, case k when 0 then 'A=1V;B=2V' when 1 then 'C=' || p_size || 'V' else 'VDD_' || w || '=3.3V' end as supplies, case k when 0 then 0 when 1 then 0 when 2 then 2 else 0 end::int as pins from p
""")
def schematic_model_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-06: supplies and pins from a model's answers, or by rules where an answer has none."""
    k = F.col("p_size") % 4
    answer = (
        F.when(k == 0, 'So: ```json\n[{"name":"A","voltage":"1V","source":"x"},{"name":"B","voltage":"2V"}]\n```').when(k == 1, F.concat(F.lit('{"power_supplies":[{"name":"C","voltage":"'), F.col("p_size").cast("string"), F.lit('V"}],"special_notes":[]}')))
        .otherwise("I can't tell")
    )
    pins = F.when(k == 2, '[{"pin":"P1","functions":["UART","PWM"]},{"pin":"P2"}]').otherwise("none")
    text = F.concat(F.lit("VDD_"), F.upper(F.split("p_name", " ")[0]), F.lit(" 3.3V"))
    supplies = F.transform(S.model_power(answer, text), lambda x: F.concat_ws("=", x["name"], x["voltage"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(supplies, ";").alias("supplies"), F.size(S.model_pins(pins)).alias("pins"))


@query(r"""
select item_id, md5(trim(regexp_replace(regexp_replace(text || ' -- (x)?', '[^\p{L}\p{N}_\s\x{4e00}-\x{9fff}]', ' ', 'g'), '\s+', ' ', 'g'))) as cleaned from benchmark
""")
def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11: questions without punctuation."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.retrieval_query(F.concat("text", F.lit(" -- (x)?"))).cast("binary")).alias("cleaned"))


FEATURE = ((1, "GNU General Public License"), (2, "worthless pathetic"), (900000, "GNU License"))
_FEATURE = ", ".join(f"({i}, '{w}')" for i, text in FEATURE for w in text.lower().split())


@query(f"""
with {_page_bm25(_FEATURE)}, {_and_or(40)}, vs as (select q.vec_id as query_id, v.vec_id as page, {_COS} as score from embeddings q, embeddings v where q.vec_id in (1, 2, 900000)),
vn as (select query_id, page, score from (select *, row_number() over (partition by query_id order by score desc, page) as k from vs where score >= 0.3) where k <= 20), vr as (select query_id from n where query_id not in (select query_id from vn)),
vm as (select query_id, page, score from (select *, row_number() over (partition by query_id order by score desc, page) as k from vs where score >= 0.35) where k <= 20),
tx as (select * from x where query_id in (select query_id from vr)), tf as (select query_id from vr where coalesce((select count(*) from tx where tx.query_id = vr.query_id), 0) < 20),
fl as (select query_id, page, 0.8 * score as score from vm where 0.8 * score >= 0.25 and query_id in (select query_id from tf) and (query_id, page) not in (select (query_id, page) from tx)),
ma as (select query_id, page, score, stage from (select *, row_number() over (partition by query_id order by score desc, page) as k from (select *, 'text' as stage from tx union all select *, 'vector' from fl)) where k <= 20),
y as (select *, row_number() over (partition by query_id order by score desc, page) as r from (select query_id, page, score, 'vector' as stage from vn union all select * from ma))
select query_id::bigint as query_id, page, round(score, 6) as score, stage, r::int as rank from y where r <= 20
""")
def retrieve_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-08, R-09, R-11: vectors first, text where none is near."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    asked = spark.createDataFrame(list(FEATURE), "query_id long, query string")
    vectors = table(spark, sf_dir, "embeddings")
    embedded = vectors.join(F.broadcast(asked.select("query_id")), F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")
    return R.retrieve_feature(docs, vectors, asked, embedded).select("query_id", "page", F.round("score", 6).alias("score"), "stage", "rank")
