"""A training-corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads back as the next stage's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, mixing, quality, repeats, simhash
from foliospark.llm.common import materialize, table

#: Bytes of a string that must not repeat; passages of over 50 words have more.
REPEAT_BYTES = 256


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes accept (score 0.7 or more)."""
    voters = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, voters).where("score >= 0.7").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id."""
    return simhash.representatives(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that lie in strings of REPEAT_BYTES found elsewhere too; a cut character goes whole."""
    return repeats.cut_repeats(docs, REPEAT_BYTES).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with their size, their source's size and target, and the words taken of each."""
    return mixing.mix(docs).where("taken > 0 or size = 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near dedup", near_dedup_stage),
    ("repeated substrings", repeats_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
]
#: Votes, fingerprints and refinement are no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
