"""Ranked retrieval for sets of questions: bm25, substring counts, vectors, structure, rare tokens, merging.

A set of questions is a DataFrame keyed by query_id.  Its distinct tokens become one array that travels to the text, so
chunks are scanned once where they lie and only (chunk, token) hits move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, BM25_LEAST_IDF, DEFAULT
from ..functions import text as T
from .relational import range_join


def with_vocabulary(texts: DataFrame, terms: DataFrame, name: str = "_terms") -> DataFrame:
    """texts with the array of all distinct terms (column term) of the questions at hand, one broadcast row."""
    return texts.join(F.broadcast(terms.agg(F.array_sort(F.collect_set("term")).alias(name))))


def term_counts(chunks: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, size, term, tf): overlapping occurrences, case apart, of tokens of three characters or more (F-52)."""
    marked = with_vocabulary(chunks.select(key, F.lower(text).alias("_t"), F.greatest(F.length(text) - 2, F.lit(0)).alias("size")), terms.where(F.length("term") >= 3))
    hits = marked.select(key, "size", "_t", F.explode(F.filter("_terms", lambda w: F.contains(F.col("_t"), w))).alias("term"))
    return hits.select(key, "size", "term", F.regexp_count("_t", F.concat(F.lit(r"(?=\Q"), F.col("term"), F.lit(r"\E)"))).alias("tf"))


def bm25(chunks: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(query_id, key, score, matched) for terms (query_id, term): statistics over all chunks, trigram lengths.

    Scores have six decimals, so that equal ones are equal in whatever order their parts were added.
    """
    terms = terms.withColumn("term", F.lower("term")).distinct()
    hits = term_counts(chunks, key, text, terms)
    whole = chunks.agg(F.count("*").alias("n_all"), F.avg(F.greatest(F.length(text) - 2, F.lit(0))).alias("mean"))
    df = hits.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = df.join(F.broadcast(whole)).select("term", "mean", F.when(idf > 0, idf).otherwise(BM25_LEAST_IDF).alias("idf"))
    asked = terms.join(weights, "term")  # as many rows as the questions have terms
    part = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("size") / F.col("mean")))
    return hits.join(F.broadcast(asked), "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))


def top(hits: DataFrame, keys: list[str], order: list[Column], limit: int | Column) -> DataFrame:
    """The first `limit` rows of each key with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)


def and_or_search(chunks: DataFrame, key: str, text: str, terms: DataFrame, limit: int) -> DataFrame:
    """Hits with all terms; where a question has fewer than max(3, .3 limit) of them, also hits with any, up to twice the limit (R-01, T-01).

    Chunks are scored once.  Of the hits with all terms and of all hits only the best that either rule can use go on, and
    both rules are read from ranks among these.
    """
    scored = bm25(chunks, key, text, terms)
    need = terms.select("query_id", F.lower("term").alias("term")).distinct().groupBy("query_id").agg(F.count("*").alias("terms"))
    marked = scored.join(F.broadcast(need), "query_id").withColumn("all", (F.col("matched") == F.col("terms")) & (F.col("terms") >= 2))  # a row a question
    order = [F.col("score").desc(), F.col(key)]
    by_kind = F.row_number().over(Window.partitionBy("query_id", "all").orderBy(*order))
    best = marked.withColumn("own", by_kind).where(F.col("own") <= 2 * limit)
    whole = Window.partitionBy("query_id")
    ranked = best.withColumn("place", F.row_number().over(whole.orderBy(*order)))
    strict = F.col("all") & (F.col("own") <= limit)
    loose = F.sum(strict.cast("int")).over(whole) < max(int(0.3 * limit), 3)
    kept = ranked.withColumn("loose", loose).where(strict | (F.col("loose") & (F.col("place") <= 2 * limit)))
    staged = kept.select("query_id", key, "score", "matched", "terms", "all", F.when(strict, "and").otherwise("or").alias("stage"))
    return top(staged, ["query_id"], order, limit)


def like_search(chunks: DataFrame, key: str, text: str, terms: DataFrame, limit: int) -> DataFrame:
    """(query_id, key, matched, score): how many two-character tokens a chunk contains; score .1 + min(.05 matched, .3) (T-02)."""
    marked = with_vocabulary(chunks.select(key, F.lower(text).alias("_t")), terms.select(F.lower("term").alias("term")))
    hits = marked.select(key, F.explode(F.filter("_terms", lambda w: F.contains(F.col("_t"), w))).alias("term"))
    counted = hits.join(F.broadcast(terms.select("query_id", F.lower("term").alias("term")).distinct()), "term").groupBy("query_id", key).agg(F.count("*").alias("matched"))
    scored = counted.withColumn("score", 0.1 + F.least(0.05 * F.col("matched"), F.lit(0.3)))
    return top(scored, ["query_id"], [F.col("matched").desc(), F.col(key)], max(2 * limit, 40))


def page_scores(hits: DataFrame, keys: list[str], pages: DataFrame, keywords: Column) -> DataFrame:
    """Chunk hits (keys, score) as page scores: sum + .2 each chunk, and for each keyword .5 in the title, .3 in the text, .5 an occurrence up to 2; .4 once if any is in the title (A-06)."""
    base = hits.groupBy(*keys).agg(F.count("*").alias("chunks"), F.sum("score").alias("total"))
    joined = base.join(pages, [k for k in keys if k in pages.columns])
    title, body = F.lower("title"), F.lower("text")
    low = F.transform(keywords, F.lower)
    each = F.aggregate(low, F.lit(0.0), lambda s, w: s + F.when(F.contains(title, w), 0.5).otherwise(0.0) + F.when(F.contains(body, w), 0.3 + F.least(0.5 * ((F.length(body) - F.length(F.replace(body, w, F.lit("")))) / F.length(w)), F.lit(2.0))).otherwise(0.0))
    any_title = F.when(F.exists(low, lambda w: F.contains(title, w)), 0.4).otherwise(0.0)
    return joined.withColumn("page_score", F.col("total") + 0.2 * F.col("chunks") + each + any_title)


#: Question vectors that are compared at once; each block of them is broadcast by itself.
QUERY_BLOCK = 8192
#: Cosines that a task holds at once: a batch of vectors meets so many of the questions as give no more.
TILE = 1 << 19


def _tiles(questions: int, vectors: int) -> Iterator[slice]:
    step = max(1, TILE // vectors)
    return (slice(k, k + step) for k in range(0, questions, step))


def _unit(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a length, as unit vectors of a dimension or the first row's, and their places."""
    sizes = np.diff(column.offsets.to_numpy())
    if not sizes.any():
        return np.zeros((0, size or 1)), np.zeros(0, np.int64)
    size = size or sizes[sizes > 0][0]
    at = np.flatnonzero((sizes == size) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    x = values[starts[at][:, None] + np.arange(size)]
    norm = np.sqrt((x * x).sum(axis=1))
    whole = np.isfinite(norm) & (norm > 0)
    return x[whole] / norm[whole, None], at[whole]


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stated questions (query_id, embedding) in bounded blocks, read through an iterator."""
    block: list = []
    for row in queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield _block_of(block)
            block = []
    if block:
        yield _block_of(block)


def _block_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
    x, at = _unit(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())))
    return np.array([r["query_id"] for r in rows], np.int64)[at], x


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, vec_id, score, rank): the k highest cosines, of six decimals, ties to the smaller id (R-04, F-51).

    The questions are a stated set; blocks of them travel to the vectors, and each batch of vectors passes on the rows
    that are among its own best and no worse than k that its task has passed on.  Vectors without a length or of another
    dimension have no cosine.  All pairs are compared; a task's memory depends on neither number.
    """
    found = None
    for block in _query_blocks(queries):
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, q = shared.value
            bound = np.full(len(q), least)  # at least k cosines are known to be as high
            for batch in batches:
                x, at = _unit(batch.column(1), q.shape[1])
                if not len(at):
                    continue
                for tile in _tiles(len(q), len(x)):
                    score = np.round(q[tile] @ x.T, 6)
                    if score.shape[1] > k:
                        np.maximum(bound[tile], np.partition(score, -k, axis=1)[:, -k], out=bound[tile])
                    row, column = np.nonzero(score >= bound[tile][:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[tile][row]), batch.column(0).take(pa.array(at[column])), pa.array(score[row, column])], names=["query_id", "vec_id", "score"])

        one = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "query_id long, vec_id long, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    return top(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def vector_groups(vectors: DataFrame, queries: DataFrame, group: str, least: float) -> DataFrame:
    """(query_id, group, score): each group's highest cosine, of at least `least`; groups are joined before anything is ranked (A-07)."""
    found = None
    for block in _query_blocks(queries):
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, q = shared.value
            for batch in batches:
                x, at = _unit(batch.column(1), q.shape[1])
                if not len(at):
                    continue
                label = batch.column(0).take(pa.array(at)).dictionary_encode()
                number = label.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(number, kind="stable")
                starts = np.flatnonzero(np.diff(number[order], prepend=-1))
                x, own = x[order], number[order][starts]
                for tile in _tiles(len(q), len(x)):
                    score = np.maximum.reduceat(np.round(q[tile] @ x.T, 6), starts, axis=1)
                    row, column = np.nonzero(score >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[tile][row]), label.dictionary.take(pa.array(own[column])), pa.array(score[row, column])], names=["query_id", group, "score"])

        kind = vectors.schema[group].dataType.simpleString()
        one = vectors.where(F.col(group).isNotNull()).select(group, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"query_id long, {group} {kind}, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = vectors.select(F.lit(0).cast("long").alias("query_id"), group, F.lit(0.0).alias("score")).limit(0)
    return found.groupBy("query_id", group).agg(F.max("score").alias("score"))


def group_best(hits: DataFrame, keys: list[str], group: str, k: int) -> DataFrame:
    """The best score of each group, then the k best groups (A-07, T-03)."""
    return top(hits.groupBy(*keys, group).agg(F.max("score").alias("score")), keys, [F.col("score").desc(), F.col(group)], k)


def section_priority(sections: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, section, priority, weighted): 3 for a title hit, 2 for keywords, 1 for a summary; weighted by 1 / (1 + df) (R-06, R-14)."""
    columns = (("title", 3), ("keywords", 2), ("summary", 1))
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    marked = with_vocabulary(sections.select("section", *[text(c).alias(c) for c, _ in columns]), words.select(F.lower("term").alias("term")))
    value = lambda w: F.greatest(*[F.when(F.contains(F.col(c), w), v).otherwise(0) for c, v in columns])
    hits = marked.select("section", F.inline(F.filter(F.transform("_terms", lambda w: F.struct(w.alias("term"), value(w).alias("priority"))), lambda x: x["priority"] > 0)))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    asked = words.select("query_id", F.lower("term").alias("term")).distinct()
    joined = hits.join(F.broadcast(asked), "term").join(F.broadcast(df), "term")
    return joined.groupBy("query_id", "section").agg(F.max("priority").alias("priority"), F.round(F.sum(F.col("priority") / (1.0 + F.col("df"))), 6).alias("weighted"))


def rare_tokens(pages: DataFrame, key: str, text: str, words: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(query_id, key, tokens, weight, score): pages with a question's rare tokens (R-17).

    Identifiers of letters and digits, and words of five letters in at most two sections, count; of these the first
    five by kind and length; those on 1 to 16 pages; of the pages the 12 with most tokens and the rarest.
    """
    c = DEFAULT
    identifier = F.col("term").rlike("[A-Za-z]") & F.col("term").rlike(r"\d")
    asked = words.select("query_id", "term").distinct().withColumn("identifier", identifier)
    if sections is not None:
        df = with_vocabulary(sections.select(F.lower("title").alias("_t")), words).select(F.explode(F.filter("_terms", lambda w: F.contains(F.col("_t"), F.lower(w)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        asked = asked.join(F.broadcast(df), "term", "left").where(F.col("identifier") | ((F.length("term") >= 5) & (F.coalesce("df", F.lit(0)) <= c.rare_max_df)))
    else:
        asked = asked.where(F.col("identifier") | (F.length("term") >= 5))
    asked = top(asked, ["query_id"], [F.col("identifier").desc(), F.length("term").desc(), F.col("term")], c.rare_max_tokens).drop("rank")
    hits = with_vocabulary(pages.select(key, F.lower(text).alias("_t")), asked).select(key, F.explode(F.filter("_terms", lambda w: F.contains(F.col("_t"), F.lower(w)))).alias("term"))
    n = hits.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") <= c.rare_max_hits)
    met = hits.join(F.broadcast(n), "term").join(F.broadcast(asked), "term")
    best = met.groupBy("query_id", key).agg(F.count("*").alias("tokens"), F.round(F.sum(1.0 / F.col("n")), 6).alias("weight"))
    ranked = top(best, ["query_id"], [F.col("tokens").desc(), F.col("weight").desc(), F.col(key)], c.rare_max_pages)
    return ranked.withColumn("score", F.lit(c.rare_score) + F.col("tokens"))


def boost(hits: DataFrame, query: str, title: str, rules: DataFrame) -> DataFrame:
    """hits with the boosts and penalties of rules (rule, query_keywords, keywords, amount, unless) added to score (F-56)."""
    rules = rules.agg(F.collect_list(F.struct("query_keywords", "keywords", "amount", "unless")).alias("_rules"))
    some = lambda words, text: F.exists(words, lambda w: F.contains(text, F.lower(w)))
    q, t = F.lower(query), F.lower(F.coalesce(F.col(title), F.lit("")))
    fits = lambda r: some(r["query_keywords"], q) & some(r["keywords"], t) & ~some(r["unless"], q)
    total = F.aggregate("_rules", F.lit(0.0), lambda s, r: s + F.when(fits(r), r["amount"]).otherwise(0.0))
    return hits.join(F.broadcast(rules)).withColumn("score", F.col("score") + total).drop("_rules")


def retrieve_exact(chunks: DataFrame, sections: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, embedded: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(query_id, page, score, stage, rank): staged evidence joined by page (R-06).

    Text hits lead; pages of the five best weighted sections are raised by .5 or added at 6, 8 or 10 by priority; rare
    tokens add at 45 and more; vectors raise confirmed pages by 25 x cosine and fill gaps at 5 + 2.5 x cosine.  A page
    keeps the stage that brought it first and the sum of what supports it.
    """
    words = questions.select("query_id", F.explode(T.query_keywords(F.lower("query"))).alias("term"))
    text = and_or_search(chunks, "page", "text", words, limit).select("query_id", "page", "score", F.lit("text").alias("stage"), F.lit(1).alias("ord"))
    chapters = top(section_priority(sections, words), ["query_id"], [F.col("weighted").desc(), F.col("section")], DEFAULT.weighted_chapters)
    base = F.element_at(F.array(F.lit(6.0), F.lit(8.0), F.lit(10.0)), F.col("priority"))
    ranges = chapters.join(sections.select("section", "start_page", "end_page"), "section")
    structure = range_join(chunks.select("page"), "page", ranges, "start_page", "end_page", []).groupBy("query_id", "page").agg(F.max(base).alias("score")).select("query_id", "page", "score", F.lit("structure").alias("stage"), F.lit(2).alias("ord"))
    rare = rare_tokens(chunks, "page", "text", words).select("query_id", "page", "score", F.lit("rare").alias("stage"), F.lit(3).alias("ord"))
    parts = text.unionByName(structure).unionByName(rare)
    if vectors is not None:
        near = vector_search(vectors, embedded, 4 * limit, DEFAULT.vector_min_score)
        parts = parts.unionByName(near.select("query_id", F.col("vec_id").alias("page"), (DEFAULT.vector_base + 2.5 * F.col("score")).alias("score"), F.lit("vector").alias("stage"), F.lit(4).alias("ord")))
    first = F.min_by(F.struct("stage", "score"), "ord")
    extra = F.sum(F.when(F.col("stage") == "structure", 0.3 * F.col("score")).when(F.col("stage") == "rare", F.col("score")).otherwise(0.0))
    joined = parts.groupBy("query_id", "page").agg(first.alias("f"), extra.alias("extra"), F.count("*").alias("n"))
    score = F.col("f.score") + F.when(F.col("n") > 1, F.col("extra")).otherwise(0.0)
    return top(joined.select("query_id", "page", F.round(score, 6).alias("score"), F.col("f.stage").alias("stage")), ["query_id"], [F.col("score").desc(), F.col("page")], limit)


def chapter_pages(sections: DataFrame, questions: DataFrame, least: int = 1) -> DataFrame:
    """(query_id, section, hits, rank): sections by how many of a question's words their fields have, 30 at most (R-14)."""
    words = questions.select("query_id", F.explode(T.query_keywords(F.lower("query"))).alias("term")).distinct()
    text = F.lower(F.concat_ws(" ", "title", "keywords", "summary"))
    hits = with_vocabulary(sections.select("section", text.alias("_t")), words).select("section", F.explode(F.filter("_terms", lambda w: T.term_hit(F.col("_t"), w))).alias("term"))
    counted = hits.join(F.broadcast(words), "term").groupBy("query_id", "section").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    return top(counted, ["query_id"], [F.col("hits").desc(), F.col("section")], DEFAULT.chapter_preselect)


def decompose(questions: DataFrame, entities: str = "entities", periods: str = "periods") -> DataFrame:
    """(query_id, part, sub_query): one question for each entity and period (R-26, R-07)."""
    whole = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c)).otherwise(F.array(F.lit("")))
    named = questions.select("query_id", "query", F.explode(whole(entities)).alias("e"), F.col(periods))
    dated = named.select("query_id", "query", "e", F.explode(whole(periods)).alias("p"))
    parts = dated.select("query_id", F.trim(F.concat_ws(" ", F.nullif("e", F.lit("")), F.nullif("p", F.lit("")), "query")).alias("sub_query"))
    return parts.withColumn("part", F.row_number().over(Window.partitionBy("query_id").orderBy("sub_query")))


def guard_rewrite(questions: DataFrame) -> DataFrame:
    """questions with used: the rewrite, unless it lacks an identifier of the question (R-29)."""
    lost = F.exists(T.model_tokens(F.col("query")), lambda t: ~F.contains(F.lower("rewritten"), F.lower(t)))
    return questions.withColumn("used", F.when(F.col("rewritten").isNull() | lost, F.col("query")).otherwise(F.col("rewritten")))


def smart_truncate(text: str, query: str, most: int) -> str:
    """A page cut to a size: sentences with the question's words first, then head and tail (F-27)."""
    if len(text) <= most:
        return text
    words = [w.lower() for w in re.findall(r"[一-鿿]{2,}", query)] + [w.lower() for w in re.findall(r"[A-Za-z0-9]{3,}", query) if not w.isdigit()]
    sentences = [s.strip() for s in re.split(r"(?<=[。！？.!?])\s+", text)]
    told = [s for s in sentences if s and any(w in s.lower() for w in words)][:10]
    parts = ["...[excerpt]...", *(["\n[Relevant paragraphs]", *told] if told else [])]
    room = most - len("\n".join(parts)) - 100
    if room > 500:
        head, tail = text[: room // 2], text[len(text) - room // 2 :]
        parts.append("\n" + head)
        if tail not in head:
            parts.append("\n...\n" + tail)
    whole = "\n".join(parts)
    return whole if len(whole) <= most else whole[:most] + "\n...[truncated]"


def excerpt(text: str, tokens: list[str], size: int = DEFAULT.excerpt_chars, most: int = DEFAULT.excerpt_windows) -> tuple[str, bool]:
    """Windows around exact hits, joined where they overlap; hits in table rows come alone if there are any (F-29)."""
    low = text.lower()
    hits = sorted({m.start() for t in tokens if t for m in re.finditer(re.escape(t.lower()), low)})
    if not hits:
        return "", False
    in_table = [p for p in hits if "|" in text[text.rfind("\n", 0, p) + 1 : (text.find("\n", p) + len(text) + 1) % (len(text) + 1) or len(text)]]
    spans: list[list[int]] = []
    for p in in_table or hits:
        a, b = max(0, p - size // 2), min(len(text), p + size // 2)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return f"[Exact keyword match: {', '.join(tokens[:5])}]\n" + "\n...\n".join(text[a:b] for a, b in spans[:most]) + "\n", bool(in_table)


def excerpts(pages: DataFrame, key: str, text: str, tokens: list[str], size: int = DEFAULT.excerpt_chars, most: int = DEFAULT.excerpt_windows) -> DataFrame:
    """(key, text, excerpt, in_table) of the pages that have any of the tokens; the others stay in the JVM (F-29)."""
    hit = F.lit(False)
    for token in tokens:
        hit = hit | F.contains(F.lower(text), F.lit(token.lower()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [excerpt(t, tokens, size, most) for t in part[text]]
            yield pd.DataFrame({key: part[key], text: part[text], "excerpt": [x for x, _ in found], "in_table": [b for _, b in found]})

    return pages.where(hit).select(key, text).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, {text} string, excerpt string, in_table boolean")


def merge_contexts(hits: DataFrame, most: int = DEFAULT.merge_max) -> DataFrame:
    """(query_id, context, pages, chars): the hits (query_id, query, doc_id, title, page_num, section, score, text) of each question as one text (R-13).

    Each document has an equal share, 5000 characters at least; its pages come by score, those under .15 only if there
    is nothing better (five then); a page gives what its tier and a quarter of the share allow.  The hits of a question
    are at most a few hundred rows, so they are merged in one group.
    """
    c = DEFAULT

    def tier(score: float) -> int:
        from ..config import CONTENT_TIERS, LAST_TIER

        return next((size for least, size in CONTENT_TIERS if score >= least), LAST_TIER)

    def one(key, group: pd.DataFrame) -> pd.DataFrame:
        query = group["query"].iloc[0]
        order = group.groupby("doc_id")["score"].max().sort_values(ascending=False, kind="stable").index
        share = max(most // max(len(order), 1), c.merge_min_per_doc) if len(order) > 1 else most
        out, used, pages = [], 0, 0
        for doc in order:
            rows = group[group["doc_id"] == doc].sort_values(["score", "page_num"], ascending=[False, True])
            good = rows[rows["score"] >= c.merge_min_score]
            rows = good if len(good) else rows.head(5)
            head = f"\n\n===== Document: {rows['title'].iloc[0]} =====\n"
            if used + len(head) > most:
                break
            out.append(head)
            used += len(head)
            own = 0
            for r in rows.itertuples():
                cap = min(tier(r.score), max(c.min_page_chars, int(share * c.page_fraction)))
                piece = f"\n--- {r.section} (Page {r.page_num}) ---\n{smart_truncate(r.text, query, cap)}"
                room = min(share - own, most - used)
                if len(piece) > room:
                    if room > 100:
                        out.append(piece[:room] + "...")
                        used += room + 3
                        pages += 1
                    break
                out.append(piece)
                own += len(piece)
                used += len(piece)
                pages += 1
        text = "".join(out)[:most]
        return pd.DataFrame([(key[0], text, pages, len(text))], columns=["query_id", "context", "pages", "chars"])

    return hits.groupBy("query_id").applyInPandas(one, "query_id int, context string, pages int, chars int")


def retrieve_macro(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, embedded: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, page, score, stage, rank): text hits, filled up with vectors at .8 x cosine, .25 at least (R-09)."""
    words = questions.select("query_id", F.explode(T.query_keywords(F.lower("query"))).alias("term"))
    text = and_or_search(chunks, "page", "text", words, 2 * limit).select("query_id", "page", "score", F.lit("text").alias("stage"))
    few = questions.select("query_id").join(text.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce(F.col("n"), F.lit(0)) < limit).select("query_id")
    near = vector_search(vectors, embedded, limit, 0.35).join(few, "query_id", "left_semi")
    fill = near.select("query_id", F.col("vec_id").alias("page"), (0.8 * F.col("score")).alias("score"), F.lit("vector").alias("stage")).where(F.col("score") >= 0.25)
    fill = fill.join(text.select("query_id", "page"), ["query_id", "page"], "left_anti")
    return top(text.unionByName(fill), ["query_id"], [F.col("score").desc(), F.col("page")], limit)


def retrieve_feature(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, embedded: DataFrame, limit: int = 20) -> DataFrame:
    """Vectors alone, and the macro way for questions that none is near to (R-08)."""
    near = vector_search(vectors, embedded, limit, 0.3).select("query_id", F.col("vec_id").alias("page"), "score", F.lit("vector").alias("stage"))
    rest = questions.join(near.select("query_id").distinct(), "query_id", "left_anti")
    other = retrieve_macro(chunks, vectors, rest, embedded, limit).drop("rank")
    return top(near.unionByName(other), ["query_id"], [F.col("score").desc(), F.col("page")], limit)


def fence_diagrams(answer: str) -> str:
    """An answer with runs of three or more lines of box drawing in code fences, outside fences that are there (F-32)."""
    out, held, fenced = [], [], False
    drawn = re.compile(r"[─│┌┐└┘├┤┬┴┼═║╔╗╚╝]|[+|][-=]{3,}|[-=]{2,}>|^\s*[|+].*[|+]\s*$")

    def flush():
        nonlocal held
        table = any(re.match(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$", line) and "|" in line for line in held)
        out.extend(["```", *held, "```"] if len(held) >= 3 and not table else held)
        held = []

    for line in answer.split("\n"):
        if line.lstrip().startswith("```"):
            flush()
            fenced = not fenced
            out.append(line)
        elif not fenced and drawn.search(line):
            held.append(line)
        else:
            flush()
            out.append(line)
    flush()
    return "\n".join(out)


def sample_context(context: str, query: str, most: int, segments: int = 5) -> str:
    """A long context cut to windows around the question's words, or to segments at even distances (F-33)."""
    if len(context) <= most:
        return context
    words = [w.lower() for w in re.findall(r"[一-鿿]{2,}|[A-Za-z0-9]{3,}", query) if not w.isdigit()]
    low = context.lower()
    hits = sorted({m.start() for w in words for m in re.finditer(re.escape(w), low)})
    size = most // segments
    spans: list[list[int]] = []
    for p in hits or [k * len(context) // segments for k in range(segments)]:
        a, b = max(0, p - size // 2), min(len(context), p + size // 2)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        elif sum(y - x for x, y in spans) + b - a <= most:
            spans.append([a, b])
    return "\n...\n".join(context[a:b] for a, b in spans)[:most]
