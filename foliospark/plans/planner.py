"""Plans of questions: category, filters, entities, steps and quotas, as columns of the questions' table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T

INTENTS = ("exact_lookup", "relation", "compare", "cross_reference", "feature", "macro", "time_series")


def validated(questions: DataFrame) -> DataFrame:
    """questions with error: too long, or empty (P-16)."""
    return questions.withColumn("error", F.when(F.length("query") > DEFAULT.max_query_chars, "too long").when(F.trim("query") == "", "empty"))


def intent(question: Column) -> Column:
    """An intent by words and identifiers, where no model decides (R-11, M-10)."""
    low = F.lower(question)
    return (
        F.when(low.rlike("compare|difference|versus| vs |对比|区别"), "compare").when(low.rlike("trend|over time|变化|趋势") | (F.size(T.years(question)) >= 2), "time_series")
        .when(low.rlike("see also|refer|参见"), "cross_reference").when(low.rlike("relation|depend|关系"), "relation").when(low.rlike("overview|summar|概述|总结"), "macro")
        .when((F.size(T.model_tokens(question)) == 0) & low.rlike("support|feature|特性"), "feature").otherwise("exact_lookup")
    )


def steps(questions: DataFrame, quota: int = DEFAULT.single_step_quota) -> DataFrame:
    """(query_id, step, tool, sub_query, doc_filter, quota): one step for each identifier of a comparison, else one (R-25, R-16, F-54)."""
    kind, models = intent(F.col("query")), T.model_tokens(F.col("query"))
    parts = F.when((kind == "compare") & (F.size(models) >= 2), F.transform(models, lambda m: F.concat_ws(" ", m, F.col("query")))).otherwise(F.array("query"))
    planned = questions.select("query_id", kind.alias("intent"), models.alias("doc_filter"), F.posexplode(parts).alias("step", "sub_query"), F.size(parts).alias("n"))
    share = F.greatest(F.floor(F.lit(quota) / F.col("n")), F.lit(DEFAULT.min_step_quota))
    share = F.when(F.size("doc_filter") > 0, F.floor(share * DEFAULT.filtered_quota_ratio)).otherwise(share)
    tool = F.when(F.col("n") > 1, "decomposed").when(F.size("doc_filter") > 0, "filtered").otherwise("single")
    return planned.select("query_id", "step", "intent", tool.alias("tool"), "sub_query", F.array_join("doc_filter", "|").alias("doc_filter"), share.cast("int").alias("quota"))


def coverage(questions: DataFrame, documents: DataFrame, key: str, title: str) -> DataFrame:
    """(query_id, entity, key): for each identifier of a question the first document that names it; null if none does (J-15).

    Identifiers are the questions' own, few words that travel to the documents.
    """
    named = questions.select("query_id", F.explode(T.model_tokens(F.col("query"))).alias("entity"))
    words = named.select("entity").distinct()
    hits = documents.join(F.broadcast(words), T.term_hit(F.col(title), F.col("entity"))).groupBy("entity").agg(F.min(key).alias(key))
    return named.join(F.broadcast(hits), "entity", "left").select("query_id", "entity", key)


def completed(questions: DataFrame, candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, added): the candidates (query_id, doc_id), and for each entity of a question that none of them names the first document that does (J-15).

    documents: doc_id, title, filename.  The questions' entities are few and travel to the documents.
    """
    named = questions.select("query_id", F.explode(T.entities(F.col("query"))).alias("entity"))
    shown = documents.select("doc_id", F.upper(F.concat_ws(" ", "title", "filename")).alias("_t"))
    hits = shown.join(F.broadcast(named.select("entity").distinct()), F.contains("_t", F.upper("entity"))).select("entity", "doc_id")
    met = named.join(hits, "entity").join(candidates.select("query_id", "doc_id", F.lit(True).alias("_in")).distinct(), ["query_id", "doc_id"], "left")
    first = met.groupBy("query_id", "entity").agg(F.max("_in").alias("_covered"), F.min("doc_id").alias("doc_id")).where("_covered is null")
    return candidates.select("query_id", "doc_id").distinct().withColumn("added", F.lit(False)).unionByName(first.select("query_id", "doc_id").distinct().withColumn("added", F.lit(True)))


def merged_filters(own: Column, found: Column, most: int = 30) -> Column:
    """A step's documents and those found besides, 30 at most (U-05)."""
    return F.slice(F.array_distinct(F.concat(F.coalesce(own, F.array()), F.coalesce(found, F.array()))), 1, most)
