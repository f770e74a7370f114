"""The engine's Python interface: ingest documents, search, look up facts, ask."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, facts, retrieval
from .plans import model, planner

#: Fixed value: characters of a chunk.
CHUNK = 1600


class Engine:
    """Tables of one knowledge base and the questions put to them; every method takes and returns DataFrames.

    Documents: doc_id, title, text.  Everything is declared lazily; nothing is collected.
    """

    def __init__(self, vocabulary: facts.Vocabulary | None = None, client: Callable[[], model.ModelClient] = model.Stub):
        self.vocabulary, self.client = vocabulary or facts.Vocabulary(), client
        self.documents: DataFrame | None = None

    def ingest(self, documents: DataFrame) -> Engine:
        """Sanitizes texts, drops empty and repeated ones, cuts chunks, reads facts (K-13, K-16, ST-03)."""
        self.raw = documents.select("doc_id", "title", "text")
        clean = self.raw.withColumn("text", T.sanitize_chars(T.strip_generated(F.col("text")))).where(F.trim("text") != "")
        first = clean.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
        self.documents = clean.join(first.select("doc_id"), "doc_id", "left_semi")
        self.chunks = chunking.structural_chunks(self.documents, "doc_id", "text", CHUNK).withColumn("chunk_id", F.concat_ws("-", "doc_id", "idx"))
        pages = self.documents.select("doc_id", F.lit(1).alias("page_num"), F.col("title").alias("entity"), F.col("text").alias("raw_text"))
        self.facts = facts.extract(pages, self.vocabulary).withColumn("fact_id", F.xxhash64("doc_id", "attribute", "value"))
        return self

    def search(self, questions: DataFrame, limit: int = 10) -> DataFrame:
        """(query_id, chunk_id, score, stage, rank) for questions (query_id, query) (R-24)."""
        words = questions.select("query_id", F.explode(T.trigram_tokens(T.chunk_tokens(F.col("query")))).alias("term"))
        return retrieval.and_or_search(self.chunks, "chunk_id", "chunk", words, limit)

    def shown(self, hits: DataFrame) -> DataFrame:
        """(query_id, score, doc_id, page_num, title, chunk) of hits (query_id, chunk_id, score): the documents that were hit are cut again, and no others."""
        # a hit's document passed the sieve of ingest; its id stands before the chunk's number
        hit = hits.select("query_id", "chunk_id", "score", F.regexp_extract("chunk_id", r"(?s)^(.*)-\d+$", 1).alias("_doc"))
        met = self.raw.join(F.broadcast(hit), F.col("doc_id").cast("string") == F.col("_doc"))
        texts = met.select(F.struct("query_id", "chunk_id", "score", "doc_id", "title").alias("hit"), T.sanitize_chars(T.strip_generated(F.col("text"))).alias("text"))
        cut = chunking.structural_chunks(texts, "hit", "text", CHUNK)
        own = cut.where(F.col("hit.chunk_id") == F.concat_ws("-", "hit.doc_id", "idx"))
        return own.select("hit.query_id", "hit.score", "hit.doc_id", F.col("idx").alias("page_num"), "hit.title", "chunk")

    def lookup(self, questions: DataFrame) -> DataFrame:
        return facts.lookup(self.facts, questions)

    def ask(self, questions: DataFrame, limit: int = 10) -> DataFrame:
        """(query_id, answer, confidence, pages): search, merge, synthesize (R-28, R-30, M-11)."""
        hits = self.shown(self.search(questions, limit))
        rows = hits.join(F.broadcast(questions), "query_id").select("query_id", "query", F.col("doc_id").cast("string").alias("doc_id"), "title", "page_num", F.col("title").alias("section"), "score", F.col("chunk").alias("text"))
        merged = retrieval.merge_contexts(rows)
        asked = planner.validated(questions).where("error is null").join(merged, "query_id", "left").select("query_id", "query", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("pages", F.lit(0)).alias("pages"))
        factory = self.client

        def answer(parts):
            client = factory()
            for part in parts:
                yield pd.DataFrame({"query_id": part["query_id"], "answer": [model.synthesize(q, c, client) for q, c in zip(part["query"], part["context"], strict=True)], "context": part["context"], "pages": part["pages"]})

        answered = asked.mapInPandas(answer, "query_id int, answer string, context string, pages int")
        return answered.select("query_id", "answer", T.confidence(F.col("answer"), F.col("context")).alias("confidence"), "pages")
