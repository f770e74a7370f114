"""Plans, packs and model-backed operators over the test tables; model calls take the stub's fallbacks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import retrieval
from ..plans import model, packs, planner
from ..registry import query, table

QUESTIONS = ((1, "compare AB123 and CD456 power"), (2, "overview of the license"), (3, "what is AB123"), (4, "revenue trend 2023 2024"), (5, ""))


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id int, query string")


@query("""
with p as (select p_partkey, p_size % 4 as k, 'AB' || (100 + p_partkey) as a, 'CD' || (100 + p_size) as c, p_name from part), q as (select *, case k when 0 then 'compare ' || a || ' and ' || c || ' power' when 1 then 'overview of the ' || p_name when 2 then 'what is ' || a else 'revenue trend ' || p_name end as query from p)
select p_partkey as query_id, unnest(case when k = 0 then [0, 1] else [0] end)::int as step, case k when 0 then 'compare' when 1 then 'macro' when 2 then 'exact_lookup' else 'time_series' end as intent, case k when 0 then 'decomposed' when 2 then 'filtered' else 'single' end as tool,
  unnest(case k when 0 then [a || ' ' || query, c || ' ' || query] else [query] end) as sub_query, case k when 0 then a || '|' || c when 2 then a else '' end as doc_filter, case k when 0 then 32000 when 2 then 64000 else 80000 end::int as quota from q
""")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-11, R-16, R-25, R-27, M-10, F-54: the steps of questions, with tools and quotas."""
    k, a, c = F.col("p_size") % 4, F.concat(F.lit("AB"), (100 + F.col("p_partkey")).cast("string")), F.concat(F.lit("CD"), (100 + F.col("p_size")).cast("string"))
    text = F.when(k == 0, F.concat(F.lit("compare "), a, F.lit(" and "), c, F.lit(" power"))).when(k == 1, F.concat(F.lit("overview of the "), "p_name")).when(k == 2, F.concat(F.lit("what is "), a)).otherwise(F.concat(F.lit("revenue trend "), "p_name"))
    return planner.steps(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("query")))


@query("""
with p as (select min(p_partkey) as p_partkey from part where contains(lower(p_name || ' AB' || (100 + p_size)), 'ab123'))
select 1 as query_id, 'AB123' as entity, p_partkey from p union all select 1, 'CD456', null union all select 3, 'AB123', p_partkey from p
""")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-15, P-17: the first document for each identifier of a question."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" AB"), (100 + F.col("p_size")).cast("string")).alias("title"))
    return planner.coverage(questions(spark), parts, "p_partkey", "title")


@query("select p_type, case when p_type in ('ECONOMY', 'STANDARD') then 'sample_parts' else 'generic' end as pack, count(*) as n from part group by all")
def pack_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL-03, PL-04, PL-05, PL-06, PL-07, S-14: packs by category, the generic one for the rest."""
    registry = packs.Registry({p.id: p for p in (packs.GENERIC, packs.compose(packs.GENERIC, packs.SAMPLE))})
    return registry.assign(spark, table(spark, sf_dir, "part"), "p_type").groupBy("p_type", "pack").agg(F.count("*").alias("n"))


class Told(model.Stub):
    """A model whose answers are known: the hash of what it is asked, or JSON for some questions."""

    def generate(self, prompt: str) -> str:
        if "as a JSON list" in prompt:
            return 'Surely: ["' + prompt.rsplit(" ", 1)[-1] + '", "More Words", "ring"]'
        if prompt.startswith("Subject"):
            return '```json\n{"subject": "Widget", "year": "77777", "doc_type": "datasheet"}\n```'
        if prompt.startswith("Classify"):
            return '{"level1": "Parts", "level2": "Rings", "level3": "Small"}' if "ring" in prompt else "no idea"
        return hashlib.md5(prompt.encode()).hexdigest()


@query("select item_id, md5(text) as answer from benchmark")
def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-01, M-02: prompts by partition, here to a model that answers with their hash."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return model.map_prompts(rows, Told).select(F.col("id").alias("item_id"), "answer")


@query("select item_id, 64 as size, length(text) >= 3 as filled, true as whole from benchmark")
def model_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-03: embeddings in batches, here of hashed trigrams; unit vectors, if a text has a trigram."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    made = model.map_embeddings(rows).withColumn("filled", F.exists("embedding", lambda x: x > 0))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return made.select(F.col("id").alias("item_id"), F.size("embedding").alias("size"), "filled", (~F.col("filled") | (F.abs(norm - 1) < 1e-9)).alias("whole"))


@query("""
with p as (select *, 'AB' || (1000 + p_partkey) || '_data-sheet ' || p_name || '.pdf' as filename from part)
select p_partkey as doc_id, case when p_size % 5 = 0 then 'Given ' || p_name when contains(lower(p_name), 'widget') then 'Widget' else 'AB' || (1000 + p_partkey) || ' data sheet ' || p_name end as title,
  case when contains(p_name, 'ring') then 'Parts' else 'Technical Documentation' end as level1, case when contains(p_name, 'ring') then 'Rings' else 'Datasheet' end as level2, case when contains(p_name, 'ring') then 'Small' else 'AB' || (1000 + p_partkey) end as level3 from p
""")
def model_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-07, M-08: classes and titles by a model, behind their gates, or by the file name."""
    given = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" Given "), "p_name"))
    name = F.concat(F.lit("AB"), (1000 + F.col("p_partkey")).cast("string"), F.lit("_data-sheet "), "p_name", F.lit(".pdf"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), name.alias("filename"), F.col("p_name").alias("summary"), given.alias("explicit"))
    return model.describe(rows, Told)


@query("""
with q as (select p_partkey, string_split(p_name, ' ') as w from part), a as (select p_partkey, w || ['More Words', 'ring'] as l from q)
select p_partkey as query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as keywords from a
""")
def keyword_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-12: search words of a question with those that a model adds."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    answers = model.map_prompts(model.keyword_prompts(asked), Told)
    return model.expanded_keywords(asked, answers).select("query_id", F.array_join("keywords", "|").alias("keywords"))


def _words_of(text: str) -> dict[str, list[str]]:
    return {"words": sorted(set(text.split()))}


@query("""
with p as (select p_partkey, p_name, p_type in ('ECONOMY', 'STANDARD') as own, list_sort(list_distinct(string_split(p_name, ' '))) as w from part)
select p_partkey as doc_id, case when own then case when contains(p_name, 'ring') then 'ringed' else 'part' end end as subtype, case when own then '{"size": ' || length(p_name) || '}' end as data, case when own then upper(p_name) end as searchable,
  case when own then '{"words": ["' || array_to_string(w, '", "') || '"]}' end as entities from p
""")
def pack_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL-01, K-17: what packs make of pages, each page by its document's pack."""
    hooks = packs.Hooks(extract_entities=_words_of, detect_subtype=lambda name, text: "part", process_page=lambda text: ("ringed" if "ring" in text else "", {"size": len(text)}, text.upper()))
    own = packs.Pack("sample_parts", "Parts", "1", packs.SAMPLE.categories, packs.SAMPLE.data, hooks)
    registry = packs.Registry({p.id: p for p in (packs.GENERIC, own)})
    assigned = registry.assign(spark, table(spark, sf_dir, "part"), "p_type")
    pages = assigned.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_num"), "pack", F.lit("x.pdf").alias("filename"), F.col("p_name").alias("text"))
    return registry.process(pages).drop("page_num")


@query("""
with s as (select p_partkey, 'what size has it' as query, lower(p_name || ' ' || p_type) as t from part)
select p_partkey, (1.0 + case when contains(t, 'small') then 1.5 else 0 end + case when contains(t, 'promo') then -1.0 else 0 end)::double as score from s
""")
def pack_retrieval_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-12, PL-02: a pack's boosts and penalties, applied to hits."""
    registry = packs.Registry({packs.SAMPLE.id: packs.SAMPLE})
    hits = table(spark, sf_dir, "part").select("p_partkey", F.lit("what size has it").alias("query"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.lit(1.0).alias("score"))
    return retrieval.boost(hits, "query", "title", registry.boost_rules(spark, packs.SAMPLE)).select("p_partkey", "score")


@query()
def engine_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-24, R-28, R-30, R-32, M-11, K-13, K-16: documents ingested and questions answered through the engine."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    asked = spark.createDataFrame([(1, "GNU General Public License"), (2, "worthless pathetic scum"), (3, "zzzzz nothing")], "query_id int, query string")
    return Engine().ingest(docs).ask(asked)
