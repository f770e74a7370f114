"""Steps of a loop that looks for evidence in turns, on pages made from documents, conversations and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agentic as A
from ..operators import relational as J
from ..operators import retrieval as R
from ..plans.planner import completed, merged_filters
from ..registry import query, table


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.col("role").alias("path"), F.col("text").alias("raw_text"))


@query("""
with t as (select doc_id % 40 as query_id, doc_id as page, round(n_chars / 1000.0::double, 6) as score from documents where contains(text, 'license')), v as (select vec_id % 40 as query_id, vec_id as page, embedding[1]::double as score from embeddings),
g as (select query_id from t group by query_id having max(score) > 5 and count(*) >= 2),
u as (select query_id, page, score, 'text' as stage from t union all select query_id, page, round(10.0::double * score, 6), 'vector' from v where not exists (select 1 from g where g.query_id = v.query_id) and not exists (select 1 from t where t.query_id = v.query_id and t.page = v.page)),
r as (select *, row_number() over (partition by query_id order by score desc, page) as r from u)
select query_id, page, score, stage, r::int as rank from r where r <= 10
""")
def hybrid_good_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-19: text hits alone where they are good, else with vectors."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("license")))
    text = docs.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("page"), F.round(F.col("n_chars") / 1000.0, 6).alias("score"))
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("query_id"), F.col("vec_id").alias("page"), F.element_at("embedding", 1).cast("double").alias("score"))
    return A.hybrid(text, vectors).select("query_id", "page", "score", "stage", "rank")


@query("""
with h as (select conv_id % 20 as query_id, conv_id as doc_id, turn as page_num, (length(text) / 100.0)::double as score from conversations where contains(text, 'the')),
m as (select query_id, h.doc_id, p.turn as page_num, max(score) as score, min(p.turn - h.page_num) as distance from h join conversations p on p.conv_id = h.doc_id and p.turn between h.page_num and h.page_num + 3 group by all),
r as (select *, row_number() over (partition by query_id order by distance, score desc, doc_id, page_num) as r from m)
select query_id, doc_id, page_num::int as page_num, distance::int as distance, r::int as rank from r where r <= 10
""")
def candidate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-20: pages to be read: hits and the three pages after, ten a question."""
    pages = turns(spark, sf_dir)
    hits = pages.where(F.contains("raw_text", F.lit("the"))).select((F.col("doc_id") % 20).alias("query_id"), "doc_id", "page_num", (F.length("raw_text") / 100.0).alias("score"))
    return A.candidate_pages(hits, pages).select("query_id", "doc_id", "page_num", F.col("distance").cast("int").alias("distance"), "rank")


@query("""
with h as (select doc_id % 3 as query_id, source, doc_id, n_chars, row_number() over (partition by doc_id % 3, source order by n_chars desc, doc_id) as r from documents), n as (select query_id, greatest(60 // count(distinct source), 8) as share from h group by query_id)
select query_id, source, doc_id as page, n_chars as score from h join n using (query_id) where r <= share
""")
def fair_document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-16, R-18: a quota shared between a question's documents."""
    hits = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("query_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.col("n_chars").alias("score"))
    return A.fair_split(hits, 60).select("query_id", F.col("doc_id").alias("source"), "page", "score")


@query("""
with o as (select o_custkey, [o_custkey::varchar] || list_sort(list(distinct (o_orderkey % 50)::varchar)) as l from orders group by o_custkey)
select o_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], ',') as docs from o
""")
def step_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-05: candidates joined to a step's documents, up to a cap."""
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set((F.col("o_orderkey") % 50).cast("string"))).alias("candidates"))
    return found.select("o_custkey", F.array_join(merged_filters(F.array(F.col("o_custkey").cast("string")), F.col("candidates"), 5), ",").alias("docs"))


@query("""
with d as (select p_size % 5 as query_id, p_partkey, p_name || ' RK' || (1000 + p_partkey % 7) as t, row_number() over (partition by p_size % 5 order by p_partkey desc) as rank from part), w(token) as (values ('RK1003'), ('RK1005'), ('ZZ99')),
h as (select query_id, token, p_partkey, rank from d, w where contains(lower(t), lower(token)))
select query_id::int as query_id, token, min_by(p_partkey, rank) as doc_id from h group by query_id, token
""")
def first_document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-30: the first document that names each identifier of a question."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part").withColumn("query_id", (F.col("p_size") % 5).cast("int"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("p_partkey").desc()))
    ranked = part.select("query_id", F.col("p_partkey").alias("doc_id"), rank.alias("rank"), F.concat("p_name", F.lit(" RK"), (1000 + F.col("p_partkey") % 7).cast("string")).alias("text"))
    asked = spark.createDataFrame([(k, "compare RK1003 and RK1005 with ZZ99") for k in range(5)], "query_id int, query string")
    return A.first_answers(ranked, F.col("text"), asked)


@query("""
with d as (select p_partkey, upper(p_name || ' AB' || (100 + p_size) || case when p_partkey = 7 or p_partkey = 9 then ' 上海公司_2023.pdf' else ' x.pdf' end) as t from part), e(query_id, entity) as (values (1, 'COMPARE'), (1, 'AB123'), (1, '上海公司'), (2, 'WHAT'), (2, 'AB145')), c as (select (p_partkey % 3)::int as query_id, p_partkey from part where p_partkey between 5 and 12),
m as (select query_id, entity, p_partkey, exists (select 1 from c where c.query_id = e.query_id and c.p_partkey = d.p_partkey) as own from e, d where contains(t, entity)), f as (select query_id, min(p_partkey) as k from m group by query_id, entity having not bool_or(own))
select query_id, p_partkey as doc_id, false as added from c union all select distinct query_id, k, true from f
""")
def entity_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-15: documents added for what a question names, in Latin or CJK, and no candidate does."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey").isin(7, 9), "上海公司_2023.pdf").otherwise("x.pdf")
    documents = part.select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" AB"), (100 + F.col("p_size")).cast("string")).alias("title"), name.alias("filename"))
    asked = spark.createDataFrame([(1, "compare AB-123 与 上海公司 营业收入"), (2, "what is ab145?"), (3, "公司 多少")], "query_id int, query string")
    candidates = part.where("p_partkey between 5 and 12").select((F.col("p_partkey") % 3).cast("int").alias("query_id"), F.col("p_partkey").alias("doc_id"))
    return completed(asked, candidates, documents)


@query(r"""
with d as (select doc_id, text, case when lang = 'en' then substr(text, 11, 60) when lang = 'fr' then 'other words' else '' end as chunk from documents), b as (select *, translate(text, E' \t\n\x0b\x0c\r', '') as bt, translate(chunk, E' \t\n\x0b\x0c\r', '') as bc from d)
select doc_id, md5(case when bt = '' then chunk when contains(bt, bc) then text else chunk || E'\n\n' || text end) as shown from b
""")
def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10: a hit shows its page, and its chunk too where the page lacks it."""
    chunk = F.when(F.col("lang") == "en", F.substring("text", 11, 60)).when(F.col("lang") == "fr", "other words").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(A.result_text(F.col("text"), chunk).cast("binary")).alias("shown"))


_KIND = "['power_tree', 'power_desc', 'dcdc', 'power_layout', 'pinmux', 'text'][p_size % 6 + 1]"


@query(f"""
with p as (select p_partkey % 50 as doc_id, p_partkey as page_num, {_KIND} as kind, lower('{{"rail":"' || case when p_partkey % 3 = 0 then 'VCC_CORE' else 'aux' end || '","name":"' || p_name || '"}}') as data from part),
q(query_id, words) as (values (1, ['power', 'ring']), (2, ['voltage', 'the', 'red'])), h as (select * from (values (1, 3), (1, 7), (2, 7), (2, 9), (3, 9)) h(query_id, doc_id)),
m as (select query_id, doc_id, page_num, kind, len(list_filter(words, lambda w: contains(data, w))) + case when contains(data, 'vcc_core') then 3 else 0 end as n from p join h using (doc_id) join q using (query_id) where kind <> 'text')
select query_id, doc_id, page_num, (case when kind in ('power_layout', 'pinmux') then 2 else 3 end + n)::double as score from m where n > 0
""")
def circuit_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-31, PL-02: circuit pages that a question on power calls for, by their nested rows."""
    kinds = F.array(*[F.lit(k) for k in ("power_tree", "power_desc", "dcdc", "power_layout", "pinmux", "text")])
    data = F.to_json(F.struct(F.when(F.col("p_partkey") % 3 == 0, "VCC_CORE").otherwise("aux").alias("rail"), F.col("p_name").alias("name")))
    pages = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").alias("page_num"), F.element_at(kinds, (F.col("p_size") % 6 + 1).cast("int")).alias("kind"), data.alias("data"))
    asked = spark.createDataFrame([(1, "Power, ring?"), (2, "voltage of the red"), (3, "plain question")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 3), (1, 7), (2, 7), (2, 9), (3, 9)], "query_id int, doc_id long")
    return A.supplement(pages, asked, hits)


@query("""
with t as (select distinct conv_id, turn from conversations where turn >= 1 and conv_id is not null)
select conv_id as doc_id, turn::int as page_num, case when turn < 2 then 'Part A' when turn < 4 then 'deep' else 'Part B' end as title, case when turn between 2 and 3 then 2 else 1 end::int as level, case when turn between 2 and 3 then 2 else 1 end::bigint as n from t
""")
def model_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-11, W-10: sections of a model's answer, and each page's deepest one."""
    pages = turns(spark, sf_dir).groupBy("doc_id", "page_num").agg(F.min("raw_text").alias("text"))
    told = 'As asked:\n```json\n[{"title":"Part A","level":1,"start_page":1},{"title":"deep","level":2,"start_page":2},{"title":" ","level":1,"start_page":3},{"title":"Part B","start_page":4}]\n```'
    sections = A.model_sections(pages.select("doc_id").distinct().withColumn("answer", F.lit(told)))
    ended = J.section_ends(sections, ["doc_id"], "place", "level", "start_page", F.lit(1000)).withColumn("end_page", F.col("end_page") - 1)
    return A.page_sections(pages.where("doc_id is not null"), ended)


@query("""
with p as (select conv_id as doc_id, turn % (conv_id % 5 + 1) = 0 and conv_id % 7 > 1 as o, contains(text, '#') as h from conversations), a as (select doc_id, avg(o::int) as c, bool_or(h) as h from p group by doc_id)
select doc_id, round(c, 6) as coverage, case when c >= 0.5 then 'outline' when c > 0 then 'extrapolated' when h then 'text' else 'empty' end as strategy from a
""")
def structure_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-09: how a document's structure is found."""
    outlined = (F.col("page_num") % (F.col("doc_id") % 5 + 1) == 0) & (F.col("doc_id") % 7 > 1)
    return A.strategy(turns(spark, sf_dir).select("doc_id", outlined.alias("in_outline"), F.contains("raw_text", F.lit("#")).alias("has_heading")))


@query("""
select conv_id as doc_id, role as path, min(turn)::int as start_page, max(turn)::int as end_page, count(*) as pages, md5(string_agg(text, chr(10) order by turn, text)) as text_md5, role as keywords from conversations group by conv_id, role
""")
def saved_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10: the pages of a section as one row with its text and keywords."""
    made = A.saved_sections(turns(spark, sf_dir))
    return made.select("doc_id", "path", "start_page", "end_page", "pages", F.md5(F.col("text").cast("binary")).alias("text_md5"), "keywords")


@query("""
with s as (select p_partkey, p_brand, p_type, row_number() over (partition by p_brand order by p_size, p_partkey) as k from part)
select b.p_partkey as section, b.p_brand as parent, min(abs(a.k - b.k))::int as distance from s a join s b on a.p_brand = b.p_brand and abs(a.k - b.k) <= 1 where starts_with(a.p_type, 'PROMO') group by all
""")
def section_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06: sections and their neighbours below the same parent."""
    part = table(spark, sf_dir, "part")
    sections = part.select(F.col("p_partkey").alias("section"), F.col("p_brand").alias("parent"), F.col("p_size").alias("start_page"))
    return A.neighbours(sections, part.where(F.startswith("p_type", F.lit("PROMO"))).select(F.col("p_partkey").alias("section")))


@query("""
with w as (select p_partkey, p_name, string_split(p_name, ' ') as w from part)
select p_partkey, upper(w[1][1] || w[2][1]) || '=' || p_name || '; RO=Ring of Opal; DDR=Double Data Rate' as pairs from w
""")
def acronym_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-13: short forms that a text explains."""
    short = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.upper(F.substring(w, 1, 1))), "")
    own = F.concat(short, F.lit(" ("), "p_name", F.lit(")"))
    text = F.concat(F.lit("See "), own, F.lit(", again "), own, F.lit(", RO (Ring of Opal), ABC (not these words) and a Big Thing (XY); a bus, Double Data Rate (DDR)."))
    shown = F.transform(A.acronyms(text), lambda p: F.concat(p["short"], F.lit("="), p["long"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(shown, "; ").alias("pairs"))


@query("""
with s as (select p_brand, p_partkey, p_name, p_size, p_type, row_number() over (partition by p_brand order by p_partkey) - 1 as idx, count(*) over (partition by p_brand) as n from part),
c as (select p_brand, idx from s where p_type = 'PROMO'), m as (select p_brand, idx, n, row_number() over (partition by p_brand order by p_size desc, idx) as k from s where contains(p_name, 'ring') and (p_brand, idx) not in (select (p_brand, idx) from c)),
r as (select p_brand, idx from c union select p_brand, idx from m where n <= 8 or k <= 2), x as (select p_brand, idx from r union select p_brand, idx + 1 from r)
select 1 as query_id, p_brand as doc_id, idx::int as idx, p_partkey as start_page, p_partkey + 1 as end_page, 10.0::double as score from x join s using (p_brand, idx)
""")
def chapter_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-14, U-06, W-06: chapters chosen, those that words brought up, and the ones after."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    chapters = table(spark, sf_dir, "part").select(F.lit(1).alias("query_id"), F.col("p_brand").alias("doc_id"), place.alias("idx"), F.col("p_partkey").alias("start_page"), (F.col("p_partkey") + 1).alias("end_page"), "p_name", "p_type", F.col("p_size").alias("score"))
    return A.chapter_evidence(chapters, chapters.where(F.contains("p_name", F.lit("ring"))), chapters.where("p_type = 'PROMO'"), 8, 2)


@query("""
with d as (select doc_id, lower(text) as t from documents), h as (select doc_id, t, 'license' as w, instr(t, 'license') as a from d where contains(t, 'license'))
select doc_id, md5('[Exact keyword match: license]' || chr(10) || substr(text, greatest(a - 50, 1), a + 49 - greatest(a - 50, 1) + 1) || chr(10)) as shown from h join documents using (doc_id) where (length(t) - length(replace(t, 'license', ''))) = 7 and not contains(text, '|')
""")
def exact_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-29: windows around exact hits; here of documents with one hit and no table, whose window SQL can cut too."""
    shown = R.excerpts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", ["license"], 100)
    single = (F.size(F.split(F.lower("text"), "license", -1)) == 2) & ~F.contains("text", F.lit("|"))
    return shown.where(single).select("doc_id", F.md5(F.col("excerpt").cast("binary")).alias("shown"))


@query("""
with e as (select event_id, user_id, floor(epoch(ts::timestamp))::bigint as t, (event_id % 900 + 1)::bigint as service from events), s as (select *, coalesce(sum(service) over (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding), 0) as served from e),
m as (select *, max(t - served) over (partition by user_id order by t, event_id rows unbounded preceding) + served as start from s)
select event_id, start::bigint as start, (start - t)::bigint as wait from m
""")
def queue_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-07: when each request of a one-at-a-time queue starts, and how long it waited."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), (F.col("event_id") % 900 + 1).cast("long").alias("service"))
    return A.queue(events, ["user_id"], "t", "service", "event_id").select("event_id", "start", "wait")


@query("""
with d as (select conv_id, row_number() over (partition by conv_id order by turn) as done, count(*) over (partition by conv_id) as total from conversations)
select conv_id as doc_id, done::int as done, total, (100 * done // total)::int as percent from d where done % 10 = 0 or done = total
""")
def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-08: progress messages of an ingestion."""
    return A.progress(turns(spark, sf_dir), ["doc_id"], "page_num")
