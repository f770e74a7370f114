"""Model calls behind an interface, with a deterministic stub that takes the documented fallbacks.

A client is built once for each partition by a factory, so connections aren't pickled and calls go out from executors.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The longest prompt and the longest text to embed, in characters.
PROMPT_CHARS, EMBED_CHARS = 45875, 6881
RETRIES = 3


class ModelClient(Protocol):
    def generate(self, prompt: str) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Stub:
    """No model: empty answers, which send callers to their fallbacks, and vectors of hashed character trigrams."""

    def __init__(self, size: int = 64):
        self.size = size

    def generate(self, prompt: str) -> str:
        return ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            low = text.lower()
            for k in range(len(low) - 2):
                v[int.from_bytes(hashlib.blake2b(low[k : k + 3].encode(), digest_size=4).digest(), "little") % self.size] += 1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def guarded(client: ModelClient, prompt: str) -> str:
    """An answer, with the prompt cut to what fits, again with half of it after each failure (M-01, M-02)."""
    size = min(len(prompt), PROMPT_CHARS)
    for k in range(RETRIES):
        try:
            return client.generate(prompt[:size])
        except Exception:
            if k == RETRIES - 1:
                raise
            size //= 2
    return ""


def read_json(text: str):
    """The first JSON object or array in an answer, whatever is around it: fences, thoughts, prose; None if there is none (F-68)."""
    text = re.sub(r"(?s)<think>.*?</think>", "", text)
    for m in re.finditer(r"[\[{]", text):
        try:
            return json.JSONDecoder().raw_decode(text[m.start() :])[0]
        except ValueError:
            continue
    return None


def map_prompts(prompts: DataFrame, factory: Callable[[], ModelClient] = Stub) -> DataFrame:
    """(id, answer) of prompts (id, prompt) (M-01)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "answer": [guarded(client, p) for p in part["prompt"]]})

    return prompts.select("id", "prompt").mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, answer string")


def map_embeddings(texts: DataFrame, factory: Callable[[], ModelClient] = Stub, batch: int = 8) -> DataFrame:
    """(id, embedding) of texts (id, text), in batches (M-03)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for part in parts:
            cut = [(t or "")[:EMBED_CHARS] for t in part["text"]]
            vectors = [v for k in range(0, len(cut), batch) for v in client.embed(cut[k : k + batch])]
            yield pd.DataFrame({"id": part["id"], "embedding": vectors})

    return texts.select("id", "text").mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, embedding array<double>")


def classify(text: str, filename: str, client: ModelClient) -> tuple[str, str, str]:
    """Three category levels, by the model or the constants that stand in for it (M-07)."""
    read = read_json(guarded(client, f"Classify into three levels as JSON: {filename}\n{text[:2000]}"))
    if isinstance(read, dict) and all(isinstance(read.get(f"level{k}"), str) for k in (1, 2, 3)):
        return read["level1"], read["level2"], read["level3"]
    model = re.search(r"[A-Z]{2,}\d{3,}[A-Z0-9]*", filename)
    return "Technical Documentation", "Datasheet", model[0] if model else ""


def derive_title(filename: str, summary: str, explicit: str | None, client: ModelClient) -> str:
    """A title: the explicit one, else what the model found that is in the source, else from the file name (M-08)."""
    if explicit and explicit.strip():
        return explicit.strip()
    bare = lambda s: re.sub(r"\s+", "", s).lower()
    source = bare(filename + summary)
    read = read_json(guarded(client, f"Subject, year and type as JSON: {filename}\n{summary[:1500]}"))
    stands = lambda k, v: bare(v) in source and (k != "year" or re.fullmatch(r"\d{4}", v.strip()))  # noqa: E731  digits of an identifier aren't a year
    parts = [str(read[k]) for k in ("subject", "year", "doc_type") if read.get(k) and stands(k, str(read[k]))] if isinstance(read, dict) else []
    if parts:
        return " ".join(parts)
    name = re.sub(r"^[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}_", "", filename)
    return re.sub(r"\.[A-Za-z]{2,4}$", "", name).replace("_", " ").replace("-", " ").strip() or filename


def describe(documents: DataFrame, factory: Callable[[], ModelClient] = Stub) -> DataFrame:
    """(doc_id, title, level1, level2, level3) of documents (doc_id, filename, summary, explicit): M-07 and M-08 by partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for part in parts:
            rows = [(i, derive_title(f, s or "", e, client), *classify(s or "", f, client)) for i, f, s, e in zip(part["doc_id"], part["filename"], part["summary"], part["explicit"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "title", "level1", "level2", "level3"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "filename", "summary", "explicit").mapInPandas(run, f"doc_id {kind}, title string, level1 string, level2 string, level3 string")


def keyword_prompts(questions: DataFrame) -> DataFrame:
    """(id, prompt): what a model is asked for the search words of a question (M-12)."""
    ask = F.lit("Give search keywords for this question as a JSON list, with synonyms and full names of short forms: ")
    return questions.select(F.col("query_id").alias("id"), F.concat(ask, "query").alias("prompt"))


def expanded_keywords(questions: DataFrame, answers: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, keywords): a question's own words, then those of a model's answer (id, answer), once each, `most` of them at most (M-12)."""
    from ..functions.text import distinct_fold, query_keywords

    told = F.from_json(F.regexp_extract("answer", r"(?s)(\[.*?\])", 1), "array<string>")
    joined = questions.join(answers.select(F.col("id").alias("query_id"), told.alias("_told")), "query_id", "left")
    both = F.concat(query_keywords(F.col("query")), F.coalesce("_told", F.array().cast("array<string>")))
    return joined.select("query_id", F.slice(distinct_fold(F.filter(both, lambda w: F.trim(w) != "")), 1, most).alias("keywords"))


def summarize(texts: list[str], client: ModelClient) -> str:
    """A summary by the model, else the heads of the first ten parts (M-09)."""
    answer = guarded(client, "Summarize:\n" + "\n".join(t[:300] for t in texts[:10]))
    return answer.strip() or " ".join(t[:100].strip() for t in texts[:10])


def query_type(question: str, entities: list[str], client: ModelClient) -> str:
    """deep_research or traditional, by the model or by two distinct entities (R-27)."""
    answer = guarded(client, f"traditional or deep_research? {question}").strip().lower()
    return answer if answer in ("traditional", "deep_research") else "deep_research" if len({e.lower() for e in entities}) >= 2 else "traditional"


def synthesize(question: str, context: str, client: ModelClient) -> str:
    """An answer from a context; without a model, the sentences of the context that share most words with the question (M-11)."""
    if len(context.strip()) < 50:
        return "No relevant information was found."
    answer = guarded(client, f"Answer from the context.\n{context}\nQuestion: {question}")
    if answer.strip():
        return answer.strip()
    words = set(re.findall(r"\w{3,}", question.lower()))
    sentences = [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+|\n+", context) if s.strip()]
    ranked = sorted(range(len(sentences)), key=lambda k: (-len(words & set(re.findall(r"\w{3,}", sentences[k].lower()))), k))[:3]
    return " ".join(sentences[k] for k in sorted(ranked))
