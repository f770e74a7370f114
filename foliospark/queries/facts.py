"""Facts extracted from texts, looked up and rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import model_tokens
from ..operators import facts as X
from ..registry import query, table

VOCABULARY = X.Vocabulary(headers=("Core", "Package"), units={"compute power": ("TOPS",)}, frequency=("frequency", "clock"))
_FACTS = "select p_partkey as fact_id, 'BR' || (100 + p_size) as entity, string_split(p_name, ' ')[2] as attribute, p_size::varchar as value, p_type || ' ' || p_name as source_text, (p_partkey % 40)::int as page_num from part"
_Q = "(values (1, 'BR111 ring economy'), (2, 'gear bolt of BR105 and BR128'), (3, 'nothing zzz')) q(query_id, query)"
QUESTIONS = ((1, "BR111 ring economy"), (2, "gear bolt of BR105 and BR128"), (3, "nothing zzz"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.concat(F.lit("BR"), (100 + F.col("p_size")).cast("string")).alias("entity"), F.split("p_name", " ")[1].alias("attribute"), F.col("p_size").cast("string").alias("value"), F.concat_ws(" ", "p_type", "p_name").alias("source_text"), (F.col("p_partkey") % 40).cast("int").alias("page_num"))


@query(f"""
with f as ({_FACTS}), w as (select distinct query_id, unnest(list_transform(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9.\\-]{{1,20}}'), lambda x: lower(x))) as term from {_Q}),
e as (select distinct lower(trim(entity)) as term from f),
s as (select term, count(distinct attribute) as spread from (select distinct term from w), f where contains(lower(concat_ws(' ', attribute, value, source_text)), term) group by term),
k as (select * from w where term not in (select term from s where spread > 3 and term not in (select term from e))),
h as (select query_id, fact_id, count(*) as hits from k, f where contains(lower(concat_ws(' ', entity, attribute, value, source_text)), term) group by all having count(*) >= 2),
r as (select h.*, entity, attribute, value, page_num, row_number() over (partition by query_id order by hits desc, page_num, fact_id) as r from h join f using (fact_id))
select query_id, fact_id, entity, attribute, value, hits, r::int as rank from r where r <= 12
""")
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-21, R-22, T-04, A-08, A-09, J-10: facts for questions, by selective keywords."""
    asked = spark.createDataFrame(list(QUESTIONS), "query_id int, query string")
    return X.lookup(facts(spark, sf_dir), asked).select("query_id", "fact_id", "entity", "attribute", "value", "hits", "rank")


@query(f"""
with f as ({_FACTS}), w(term) as (values ('brand'), ('red'), ('promo'), ('ring'), ('gear'))
select term, count(distinct attribute) as spread from w, f where contains(lower(concat_ws(' ', attribute, value, source_text)), term) group by term
""")
def fact_keyword_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-08: attributes that a keyword touches."""
    words = spark.createDataFrame([("brand",), ("red",), ("promo",), ("ring",), ("gear",)], "term string")
    return X.spread(facts(spark, sf_dir), words)


@query()
def fact_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-23: facts as a text block with quoted evidence."""
    asked = spark.createDataFrame(list(QUESTIONS), "query_id int, query string")
    return X.render(X.lookup(facts(spark, sf_dir), asked))


@query()
def fact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-01, X-02, X-04, W-12: facts of pages, made from documents with specification lines added."""
    lines = F.concat(F.lit("\nball size: 0."), (F.col("doc_id") % 90).cast("string"), F.lit("mm\nSupport ten UART interfaces.\nNPU: up to "), (F.col("doc_id") % 7).cast("string"), F.lit(" TOPS.\nMax CPU frequency NA 2 GHz"))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_num"), F.col("source").alias("entity"), F.concat("text", lines).alias("raw_text"))
    return X.extract(pages, VOCABULARY)


@query("""
select p_partkey, coalesce(nullif(regexp_extract(p_name || ' RK' || (1000 + p_partkey), '(RK\\d{4}[A-Z]?)', 1), ''), substr(p_name, 1, 40)) as entity, 'RK' || (1000 + p_partkey) as model from part
""")
def entity_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-03, K-14, F-07: a document's entity from its title."""
    title = F.concat("p_name", F.lit(" RK"), (1000 + F.col("p_partkey")).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", X.infer_entity(title, F.col("p_type"), [r"(RK\d{4}[A-Z]?)"]).alias("entity"), F.array_join(model_tokens(title), "|").alias("model"))
