"""Steps of a loop that looks for evidence in turns: hybrid hits, page reads, candidates, quotas, supplements, structure by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from .relational import keep_first, range_join, with_next
from .retrieval import top

#: Text hits are enough from this score and number on; what a cosine counts beside text scores.
GOOD_SCORE, GOOD_HITS, VECTOR_SCALE = 5.0, 2, 10.0
#: Pages after a candidate that are read too, and how many a question reads.
READ_AHEAD, READ_MOST = 3, 10
#: Fixed value: rows that each document of a question gets at least.
LEAST_A_DOCUMENT = 8
#: Words that ask for power, rails that answer, page kinds with their base score.
POWER_WORDS = ("电源", "供电", "电压", "电流", "power", "voltage", "current", "pmic", "dcdc", "buck", "ldo")
RAILS = ("vcc_core", "vcc_io", "vdd_soc")
KIND_SCORES = {"power_tree": 3.0, "power_desc": 3.0, "dcdc": 3.0, "power_layout": 2.0, "pinmux": 2.0}


def hybrid(text: DataFrame, vectors: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, page, score, stage, rank): text hits (query_id, page, score) alone where they are good, else with vector hits at ten times their cosine (R-19)."""
    good = text.groupBy("query_id").agg(((F.max("score") > GOOD_SCORE) & (F.count("*") >= GOOD_HITS)).alias("good"))
    more = vectors.join(good.where("good"), "query_id", "left_anti").join(text.select("query_id", "page"), ["query_id", "page"], "left_anti")
    both = text.select("query_id", "page", "score", F.lit("text").alias("stage")).unionByName(more.select("query_id", "page", F.round(VECTOR_SCALE * F.col("score"), 6).alias("score"), F.lit("vector").alias("stage")))
    return top(both, ["query_id"], [F.col("score").desc(), F.col("page")], limit)


def candidate_pages(hits: DataFrame, pages: DataFrame, ahead: int = READ_AHEAD, most: int = READ_MOST) -> DataFrame:
    """(query_id, doc_id, page_num, distance, rank): the pages to be read: those hit (query_id, doc_id, page_num, score) and the ones after, which exist (R-20)."""
    ranges = hits.withColumns({"first": F.col("page_num"), "last": F.col("page_num") + ahead}).drop("page_num")
    met = range_join(pages.select("doc_id", "page_num"), "page_num", ranges, "first", "last", ["doc_id"])
    near = met.groupBy("query_id", "doc_id", "page_num").agg(F.max("score").alias("score"), F.min(F.col("page_num") - F.col("first")).alias("distance"))
    return top(near, ["query_id"], [F.col("distance"), F.col("score").desc(), F.col("doc_id"), F.col("page_num")], most).select("query_id", "doc_id", "page_num", "distance", "rank")


def fair_split(hits: DataFrame, quota: int, least: int = LEAST_A_DOCUMENT) -> DataFrame:
    """The best hits (query_id, doc_id, page, score) of each document, a quota shared equally between a question's documents, `least` each at least (R-16)."""
    number = hits.groupBy("query_id").agg(F.countDistinct("doc_id").alias("_docs"))
    share = F.greatest(F.floor(F.lit(quota) / F.col("_docs")), F.lit(least))
    return top(hits.join(number, "query_id"), ["query_id", "doc_id"], [F.col("score").desc(), F.col("page")], share).drop("_docs", "rank")


def first_answers(ranked: DataFrame, text: Column, questions: DataFrame) -> DataFrame:
    """(query_id, token, doc_id): for each identifier of a question the first of its ranked documents (query_id, doc_id, rank, text) that names it (R-30)."""
    asked = questions.select("query_id", F.explode(T.model_tokens(F.col("query"))).alias("token"))
    met = ranked.withColumn("_t", F.lower(text)).join(asked, "query_id").where(F.contains("_t", F.lower("token")))
    return keep_first(met.select("query_id", "token", "doc_id", "rank"), ["query_id", "token"], [F.col("rank"), F.col("doc_id")]).drop("rank")


def result_text(page: Column, chunk: Column) -> Column:
    """What a hit shows: its page, and before it the chunk where the page, white space apart, doesn't hold it (R-10)."""
    bare = lambda c: F.translate(F.coalesce(c, F.lit("")), " \t\n\x0b\x0c\r", "")
    return F.when(bare(page) == "", chunk).when(F.contains(bare(page), bare(chunk)), page).otherwise(F.concat(chunk, F.lit("\n\n"), page))


def supplement(pages: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, page_num, score): pages of circuit documents among the hits that a question on power calls for (R-31).

    pages has doc_id, page_num, kind and data (the page's nested rows as JSON).  A page scores by its kind, a point for
    each word of the question and three for a main rail.
    """
    low = F.lower("query")
    power = questions.where(F.exists(F.array(*[F.lit(w) for w in POWER_WORDS]), lambda w: F.contains(low, w)))
    words = F.filter(F.split(F.translate(F.regexp_replace(low, "[，,]", " "), "?", ""), r"\s+"), lambda w: F.length(w) > 2)
    asked = power.select("query_id", words.alias("_words"))
    documents = hits.select("query_id", "doc_id").distinct().join(asked, "query_id")
    base = F.element_at(F.create_map(*[F.lit(x) for pair in KIND_SCORES.items() for x in pair]), F.col("kind"))
    met = pages.where(F.col("kind").isin(*KIND_SCORES)).withColumn("_data", F.lower("data")).join(documents, "doc_id")
    matched = F.size(F.filter("_words", lambda w: F.contains(F.col("_data"), w))) + F.when(F.exists(F.array(*[F.lit(r) for r in RAILS]), lambda r: F.contains(F.col("_data"), r)), 3).otherwise(0)
    return met.withColumn("_n", matched).where("_n > 0").select("query_id", "doc_id", "page_num", (base + F.col("_n")).alias("score"))


def model_sections(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(doc_id, place, title, level, start_page) from a model's JSON list of sections, fenced or not; rows without a title go (K-11)."""
    text = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    read = F.from_json(text, "array<struct<title:string,level:int,start_page:int>>")
    rows = answers.select("doc_id", F.posexplode(read).alias("place", "s"))
    whole = rows.where(F.trim(F.coalesce("s.title", F.lit(""))) != "")
    return whole.select("doc_id", "place", F.col("s.title").alias("title"), F.coalesce("s.level", F.lit(1)).alias("level"), F.coalesce("s.start_page", F.lit(1)).alias("start_page"))


def page_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, page_num, title, level, n): each page (doc_id, page_num, text) with the deepest section that covers it (W-10).

    Of several equally deep ones the first whose title stands on the page, else the first; n: how many cover the page.
    sections: doc_id, place, title, level, start_page, end_page.
    """
    # the cells of all documents' sections are many more than Spark reckons: none of them is broadcast
    met = range_join(pages.hint("merge"), "page_num", sections, "start_page", "end_page", ["doc_id"], cell=64)
    told = (F.length("title") > 2) & F.contains("text", F.col("title"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(F.col("level").desc(), told.desc(), F.col("start_page"), F.col("place")))
    n = F.count("*").over(Window.partitionBy("doc_id", "page_num"))
    return met.withColumns({"_rank": rank, "n": n}).where("_rank = 1").select("doc_id", "page_num", "title", "level", "n")


def strategy(pages: DataFrame) -> DataFrame:
    """(doc_id, coverage, strategy): how a document's structure is found (K-09).

    pages has doc_id, in_outline and has_heading.  outline if it covers half of the pages, extrapolated if it covers
    some, text if any page has a heading, else empty.
    """
    told = pages.groupBy("doc_id").agg(F.avg(F.col("in_outline").cast("double")).alias("coverage"), F.max("has_heading").alias("_heading"))
    kind = F.when(F.col("coverage") >= 0.5, "outline").when(F.col("coverage") > 0, "extrapolated").when(F.col("_heading"), "text").otherwise("empty")
    return told.select("doc_id", F.round("coverage", 6).alias("coverage"), kind.alias("strategy"))


def saved_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, path, start_page, end_page, pages, text, keywords): the pages of each section as one row (K-10)."""
    parts = F.array_sort(F.collect_list(F.struct("page_num", "raw_text")))
    made = pages.groupBy("doc_id", "path").agg(F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"), F.count("*").alias("pages"), F.array_join(F.transform(parts, lambda x: x["raw_text"]), "\n").alias("text"))
    return made.withColumn("keywords", F.array_join(T.distinct_fold(T.query_keywords(F.col("path"))), ","))


def neighbours(sections: DataFrame, chosen: DataFrame) -> DataFrame:
    """(section, parent, distance): the sections chosen and those before and after them below the same parent (J-06)."""
    order = Window.partitionBy("parent").orderBy("start_page", "section")
    placed = sections.withColumn("_place", F.row_number().over(order))
    centre = placed.join(chosen.select("section").distinct(), "section", "left_semi")
    around = centre.select("parent", F.explode(F.array(*[F.struct((F.col("_place") + d).alias("_place"), F.lit(abs(d)).alias("distance")) for d in (-1, 0, 1)])).alias("x")).select("parent", "x.*")
    return placed.join(around, ["parent", "_place"]).groupBy("section", "parent").agg(F.min("distance").alias("distance"))


def chapter_evidence(sections: DataFrame, scored: DataFrame, chosen: DataFrame, whole: int = DEFAULT.chapter_merge_all, cap: int = DEFAULT.chapter_merge_cap) -> DataFrame:
    """(query_id, doc_id, idx, start_page, end_page, score): the chapters that a question reads, at 10 (R-14).

    Those chosen (query_id, doc_id, idx), those that words alone brought up (scored: with score) and weren't, all of them
    in documents of up to `whole` chapters and the best `cap` in longer ones, and the chapter after each of these.
    """
    keys = ["query_id", "doc_id", "idx"]
    sizes = sections.groupBy("doc_id").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), F.col("idx")))
    missed = scored.join(chosen.select(*keys), keys, "left_anti").withColumn("_place", place).join(sizes, "doc_id").where((F.col("_n") <= whole) | (F.col("_place") <= cap))
    read = with_next(chosen.select(*keys).unionByName(missed.select(*keys)).distinct(), "idx")
    return read.join(sections.select("doc_id", "idx", "start_page", "end_page"), ["doc_id", "idx"]).select(*keys, "start_page", "end_page", F.lit(10.0).alias("score"))


def acronyms(text: Column) -> Column:
    """array(struct(short, long)): what a text explains as 'NPU (Neural Process Unit)' or the other way round, once each (M-13).

    The words' first letters, small words apart, are those of the short form.
    """
    letters = lambda long: F.array_join(F.transform(F.filter(F.split(long, r"[\s-]+"), lambda w: ~F.lower(w).isin("of", "and", "the", "for", "to", "in")), lambda w: F.upper(F.substring(w, 1, 1))), "")
    pairs = lambda pattern, short, long: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), short).alias("short"), F.regexp_extract_all(text, F.lit(pattern), long).alias("long"))
    after = pairs(r"\b([A-Z]{2,8}) \(([A-Za-z]+(?:[ -][A-Za-z]+){1,9})\)", 1, 2)
    before = F.transform(pairs(r"\b([A-Z][A-Za-z]*(?:[ -][A-Za-z]+){1,9}) \(([A-Z]{2,8})\)", 2, 1), lambda p: F.struct(p["short"].alias("short"), p["long"].alias("long")))
    return F.array_distinct(F.filter(F.concat(F.transform(after, lambda p: F.struct(p["short"].alias("short"), p["long"].alias("long"))), before), lambda p: letters(p["long"]) == p["short"]))


def queue(requests: DataFrame, keys: list[str], at: str, service: str, order: str) -> DataFrame:
    """requests with start and wait, both in the unit of at and service, of a queue that serves one at a time in order (ST-07).

    Who starts when is a running maximum: of every earlier request, its arrival and all service from it on.
    """
    before = Window.partitionBy(*keys).orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*keys).orderBy(at, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = requests.withColumn("_served", F.coalesce(F.sum(service).over(before), F.lit(0)))
    started = served.withColumn("start", F.max(F.col(at) - F.col("_served")).over(until) + F.col("_served"))
    return started.withColumn("wait", F.col("start") - F.col(at)).drop("_served")


def progress(pages: DataFrame, keys: list[str], order: str, every: int = 10) -> DataFrame:
    """(keys, done, total, percent): an ingestion's messages, after every tenth page and at the end (ST-08)."""
    done = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    total = F.count("*").over(Window.partitionBy(*keys))
    told = pages.withColumns({"done": done, "total": total}).where((F.col("done") % every == 0) | (F.col("done") == F.col("total")))
    return told.select(*keys, "done", "total", F.floor(100 * F.col("done") / F.col("total")).cast("int").alias("percent"))
