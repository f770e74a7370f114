"""Chunking and ranked retrieval over documents, embeddings and a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import retrieval as R
from ..registry import query, table

QUESTIONS = ((1, "GNU General Public License"), (2, "worthless pathetic"), (3, "leeux elleech que"), (4, "erential license"))
WORDS = [(i, w) for i, q in QUESTIONS for w in q.lower().split()]
_Q = ", ".join(f"({i}, '{w}')" for i, w in WORDS)
_CHUNKS = """
  select doc_id * 16777216 + i as chunk_id, doc_id, substr(text, (i * 1440 + 1)::int, 1600) as chunk
  from (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 160) / 1440.0), 1)::bigint)) as i from documents)"""
_BM25 = f"""
c as ({_CHUNKS}), q(query_id, term) as (values {_Q}),
h as (select chunk_id, doc_id, greatest(length(chunk) - 2, 0) as size, term, (length(lower(chunk)) - length(replace(lower(chunk), term, ''))) // length(term) as tf from c, (select distinct term from q where length(term) >= 3)
  where contains(lower(chunk), term)),
s as (select count(*) as n_all, avg(greatest(length(chunk) - 2, 0)) as mean from c),
d as (select term, count(*) as n from h group by term),
w as (select term, mean, case when ln((n_all - n + 0.5) / (n + 0.5)) > 0 then ln((n_all - n + 0.5) / (n + 0.5)) else 1e-6 end as idf from d, s),
b as (select query_id, chunk_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)))::double, 6) as score, count(*) as matched from h join w using (term) join q using (term) group by all)"""


#: A chunk's id is its document's id times 2^24 and its number there; a string has fewer characters than that many chunks.
CHUNKS = 24


def document_of(chunk_id: Column) -> Column:
    return F.shiftright(chunk_id, CHUNKS)


def chunks(spark: SparkSession, sf_dir: str, size: int = 1600, overlap: int = 160) -> DataFrame:
    made = C.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", size, overlap)
    return made.select((F.shiftleft(F.col("doc_id").cast("long"), CHUNKS) + F.col("idx")).alias("chunk_id"), "doc_id", "chunk")


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORDS, "query_id int, term string")


@query(f"with c as ({_CHUNKS}) select chunk_id, doc_id, length(chunk) as size, md5(chunk) as chunk_md5 from c")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-01: windows of 1600 characters that overlap by 160."""
    return chunks(spark, sf_dir).select("chunk_id", "doc_id", F.length("chunk").cast("long").alias("size"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query()
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-02, S-09: chunks by structure; tests hold them against their size bound and the text."""
    return C.structural_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 1600)


@query()
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-04, K-05, K-06, S-19: chunks of a document's pages (turns of a conversation), section by section."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.col("role").alias("section_path"), F.col("text").alias("raw_text"))
    return C.document_chunks(pages)


@query(r"""
with p as (select doc_id, 1 as part, 'x' as y, '# ' || source || chr(10) || text || chr(10) || '## ' || lang as t from documents),
s as (select doc_id, unnest(list_filter(string_split(regexp_replace(t, '(?m)^#', chr(1) || '#', 'g'), chr(1)), lambda x: trim(x) <> '')) as piece from p)
select doc_id, count(*) as pieces, min(length(piece))::bigint as least from s group by doc_id
""")
def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-08, K-03: parts that begin at headings."""
    marked = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n## "), "lang")
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.explode(C.heading_parts(marked)).alias("piece"))
    return pieces.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.min(F.length("piece")).cast("long").alias("least"))


@query()
def structure_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-07, K-08, K-09, K-10: sections read from headings and carried on to the pages that follow."""
    page = F.concat(F.when(F.col("turn") % 4 == 0, F.concat((F.col("turn") / 4 + 1).cast("int").cast("string"), F.lit(". "), "role", F.lit("\n"))).otherwise(""), "text")
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), page.alias("raw_text"))
    return C.text_structure(pages).select("doc_id", "page_num", "section_level", "section_path", "section_title")


@query(f"""
with {_BM25}, t as (select query_id, doc_id, round(sum(score), 6) as score, count(*) as chunks from b group by all), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from t)
select query_id, doc_id, round(score, 6) as score, chunks, r::int as rank from r where r <= 20
""")
def bm25_document_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-01, F-52, A-06, T-01: chunks ranked by bm25, summed by document; the flagship."""
    hits = R.bm25(chunks(spark, sf_dir), "chunk_id", "chunk", words(spark)).withColumn("doc_id", document_of(F.col("chunk_id")))
    docs = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("chunks"))
    return R.top(docs, ["query_id"], [F.col("score").desc(), F.col("doc_id")], 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "chunks", "rank")


@query(f"""
with {_BM25}, n as (select query_id, count(*) as terms from q group by query_id), m as (select b.*, matched = terms and terms >= 2 as whole from b join n using (query_id)),
a as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from m where whole) where k <= 10),
f as (select query_id from n where coalesce((select count(*) from a where a.query_id = n.query_id), 0) < 3),
o as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from m where query_id in (select query_id from f)) where k <= 20),
u as (select query_id, chunk_id, score, 'and' as stage from a union all select query_id, chunk_id, score, 'or' from o where (query_id, chunk_id) not in (select (query_id, chunk_id) from a)),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from u)
select query_id, chunk_id, round(score, 6) as score, stage, r::int as rank from r where r <= 10
""")
def bm25_and_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-01, R-05, R-15, U-01: all terms first, any term where those are few."""
    hits = R.and_or_search(chunks(spark, sf_dir), "chunk_id", "chunk", words(spark), 10)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "stage", "rank")


@query(f"""
with c as ({_CHUNKS}), q(query_id, term) as (values (1, 'li'), (1, 'ce'), (2, 'wo'), (2, 'xq'), (3, 'ñe')), h as (select query_id, chunk_id, count(*) as matched from c, q where contains(lower(chunk), term) group by all),
r as (select *, row_number() over (partition by query_id order by matched desc, chunk_id) as r from h)
select query_id, chunk_id, matched, round(0.1 + least(0.05 * matched, 0.3), 6)::double as score from r where r <= 40
""")
def like_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-02, R-03, T-02: chunks by how many short tokens they contain."""
    asked = spark.createDataFrame([(1, "li"), (1, "ce"), (2, "wo"), (2, "xq"), (3, "ñe")], "query_id int, term string")
    return R.like_search(chunks(spark, sf_dir), "chunk_id", "chunk", asked, 20).select("query_id", "chunk_id", "matched", F.round("score", 6).alias("score"))


@query(f"""
with {_BM25}, p as (select query_id, b.doc_id, count(*) as n, sum(score) as total from b group by all), k as (select query_id, list(distinct term) as kws from q group by query_id),
j as (select p.*, lower(d.source) as title, lower(d.text) as body, kws from p join documents d using (doc_id) join k using (query_id)),
z as (select query_id, doc_id, total + 0.2 * n + list_sum(list_transform(kws, lambda w: case when contains(title, w) then 0.5 else 0.0 end + case when contains(body, w) then 0.3 + least(0.5 * ((length(body) - length(replace(body, w, ''))) / length(w)), 2.0) else 0.0 end)) + case when len(list_filter(kws, lambda w: contains(title, w))) > 0 then 0.4 else 0.0 end as score from j)
select query_id, doc_id, round(score::double, 6) as score from z
""")
def page_aggregate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-06, R-05: chunk hits as page scores, with bonuses for keywords in titles and texts."""
    hits = R.bm25(chunks(spark, sf_dir), "chunk_id", "chunk", words(spark)).withColumn("doc_id", document_of(F.col("chunk_id")))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    keywords = words(spark).groupBy("query_id").agg(F.collect_set("term").alias("keywords"))
    scored = R.page_scores(hits.select("query_id", "doc_id", "score").join(F.broadcast(keywords), "query_id"), ["query_id", "doc_id", "keywords"], pages, F.col("keywords"))
    return scored.select("query_id", "doc_id", F.round("page_score", 6).alias("score"))


_COS = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6)"


@query(f"""
with s as (select q.vec_id as query_id, v.vec_id, {_COS} as score from embeddings q, embeddings v where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s)
select query_id, vec_id, score, r::int as rank from r where r <= 10
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-04, F-51, S-18: exact cosine top-k; the questions are the rows whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_search(vectors, asked, 10).select("query_id", "vec_id", "score", "rank")


@query(f"""
with s as (select q.vec_id as query_id, v.label, {_COS} as score from embeddings q, embeddings v where q.vec_id % 100 = 0), g as (select query_id, label, max(score) as score from s where score >= 0.1 group by all), r as (select *, row_number() over (partition by query_id order by score desc, label) as r from g)
select query_id, label, score from r where r <= 5
""")
def vector_group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-07, T-03, P-05: the best cosine of each group over a threshold, then the best groups."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return R.group_best(R.vector_groups(vectors, asked, "label", 0.1), ["query_id"], "label", 5).select("query_id", "label", "score")


CATALOGUE = "select p_partkey as section, p_name as title, p_brand as keywords, p_type as summary from part"
_W = "(values (1, 'ring'), (1, 'brand#1'), (2, 'gear'), (2, 'al'), (3, 'zzz')) w(query_id, term)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("section"), F.col("p_name").alias("title"), F.col("p_brand").alias("keywords"), F.col("p_type").alias("summary"), F.col("p_partkey").alias("start_page"), (F.col("p_partkey") + F.col("p_size") % 3).alias("end_page"))


@query(f"""
with h as (select query_id, term, section, case when contains(lower(title), term) then 3 when contains(lower(keywords), term) then 2 when contains(lower(summary), term) then 1 else 0 end as priority from ({CATALOGUE}), {_W}),
k as (select * from h where priority > 0), d as (select term, count(distinct section) as df from k group by term)
select query_id, section, max(priority)::int as priority, round(sum(priority / (1.0 + df)), 6)::double as weighted from k join d using (term) group by all
""")
def section_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-06, R-14, T-08, A-11: sections by where a question's words stand, weighted against common words."""
    asked = spark.createDataFrame([(1, "ring"), (1, "brand#1"), (2, "gear"), (2, "al"), (3, "zzz")], "query_id int, term string")
    return R.section_priority(catalogue(spark, sf_dir), asked).select("query_id", "section", "priority", F.round("weighted", 6).alias("weighted"))


@query("""
with w(query_id, term) as (values (1, 'andreineaou'), (1, 'treeaument'), (2, 'thanbletion'), (2, 'thattionwh'), (3, 'abc123')), h as (select query_id, term, doc_id from documents, w where contains(lower(text), term)), n as (select term, count(*) as n from h group by term having count(*) <= 16),
g as (select query_id, doc_id, count(*) as tokens, sum(1.0::double / n) as weight from h join n using (term) group by all), r as (select *, row_number() over (partition by query_id order by tokens desc, weight desc, doc_id) as r from g)
select query_id, doc_id, tokens, round(weight, 6) as weight, (45.0 + tokens)::double as score from r where r <= 12
""")
def rare_token_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-17, F-29: pages that rare tokens must bring up."""
    asked = spark.createDataFrame([(1, "andreineaou"), (1, "treeaument"), (2, "thanbletion"), (2, "thattionwh"), (3, "abc123")], "query_id int, term string")
    return R.rare_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", asked).select("query_id", "doc_id", "tokens", F.round("weight", 6).alias("weight"), "score")


RULES = (("small", ["tin", "metal"], ["small", "medium"], 1.5, []), ("promo", ["tin"], ["promo"], -1.0, ["plated"]), ("unless", ["tin"], ["large"], -9.0, ["steel"]), ("any", ["a"], ["economy"], 0.25, []))


@query("""
with s as (select p_partkey, 'tin or steel parts' as query, lower(p_type) as t from part)
select p_partkey, ((case when contains(t, 'small') or contains(t, 'medium') then 1.5 else 0 end) + (case when contains(t, 'promo') then -1.0 else 0 end) + (case when contains(t, 'economy') then 0.25 else 0 end))::double as score from s
""")
def boost_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-56, PL-02: boosts and penalties by the question and the section's title."""
    rules = spark.createDataFrame(list(RULES), "rule string, query_keywords array<string>, keywords array<string>, amount double, unless array<string>")
    hits = table(spark, sf_dir, "part").select("p_partkey", F.lit("tin or steel parts").alias("query"), "p_type", F.lit(0.0).alias("score"))
    return R.boost(hits, "query", "p_type", rules).select("p_partkey", "score")


def _page_bm25(words: str) -> str:
    """SQL for bm25 of whole documents as b(query_id, page, score, matched); words: the values of q(query_id, term)."""
    return f"""
q(query_id, term) as (values {words}), c as (select doc_id as page, lower(text) as t, greatest(length(text) - 2, 0) as size from documents),
h as (select page, size, term, (length(t) - length(replace(t, term, ''))) // length(term) as tf from c, (select distinct term from q where length(term) >= 3) where contains(t, term)),
s as (select count(*) as n_all, avg(size) as mean from c), d as (select term, count(*) as n from h group by term),
w as (select term, mean, case when ln((n_all - n + 0.5) / (n + 0.5)) > 0 then ln((n_all - n + 0.5) / (n + 0.5)) else 1e-6 end as idf from d, s),
b as (select query_id, page, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)))::double, 6) as score, count(*) as matched from h join w using (term) join q using (term) group by all)"""


def _and_or(limit: int) -> str:
    """SQL for the hits of and_or_search among b, as x(query_id, page, score)."""
    return f"""
n as (select query_id, count(*) as terms from q group by query_id), m as (select b.*, matched = terms and terms >= 2 as whole from b join n using (query_id)),
a as (select * from (select *, row_number() over (partition by query_id order by score desc, page) as k from m where whole) where k <= {limit}),
f as (select query_id from n where coalesce((select count(*) from a where a.query_id = n.query_id), 0) < {max(int(0.3 * limit), 3)}),
o as (select * from (select *, row_number() over (partition by query_id order by score desc, page) as k from m where query_id in (select query_id from f)) where k <= {2 * limit}),
u as (select query_id, page, score from a union all select query_id, page, score from o where (query_id, page) not in (select (query_id, page) from a)),
x as (select query_id, page, score from (select *, row_number() over (partition by query_id order by score desc, page) as k from u) where k <= {limit})"""


EXACT = ((1, "GNU General Public License src3"), (2, "worthless pathetic"), (3, "XY99 loweiig"))
_EXACT = ", ".join(f"({i}, '{w}')" for i, text in EXACT for w in text.lower().split())


@query(f"""
with {_page_bm25(_EXACT)}, {_and_or(20)},
sec as (select source as section, lower(source) as title, min(doc_id) as a, least(max(doc_id), min(doc_id) + 3) as z from documents group by source),
sh as (select query_id, term, section from sec, q where contains(title, term)), sd as (select term, count(distinct section) as df from sh group by term),
sp as (select query_id, section, round(sum(3 / (1.0 + df))::double, 6) as weighted from sh join sd using (term) group by all), sk as (select *, row_number() over (partition by query_id order by weighted desc, section) as k from sp),
st as (select query_id, doc_id as page, 10.0::double as score from sk join sec using (section) join documents on doc_id between a and z where k <= 5 group by all),
ra as (select *, regexp_matches(term, '[a-z]') and regexp_matches(term, '[0-9]') as ident from q), rk as (select *, row_number() over (partition by query_id order by ident desc, length(term) desc, term) as k from ra where ident or length(term) >= 5),
rt as (select query_id, term from rk where k <= 5), rh as (select distinct term, page from c, (select distinct term from rt) where contains(t, term)), rn as (select term, count(*) as n from rh group by term having count(*) <= 16),
rp as (select query_id, page, count(*) as tokens, round(sum(1.0::double / n), 6) as weight from rh join rn using (term) join rt using (term) group by all),
rr as (select query_id, page, (45.0 + tokens)::double as score from (select *, row_number() over (partition by query_id order by tokens desc, weight desc, page) as k from rp) where k <= 12),
vs as (select e.vec_id as query_id, v.vec_id as page, {_COS} as score from (select vec_id, embedding from embeddings where vec_id in (1, 2, 3)) e join embeddings v on true join (select vec_id, embedding from embeddings) q on q.vec_id = e.vec_id),
vn as (select query_id, page, 5.0 + 2.5 * score as score from (select *, row_number() over (partition by query_id order by score desc, page) as k from vs where score >= 0.45) where k <= 80),
p as (select query_id, page, score, 'text' as stage, 1 as ord from x union all select query_id, page, score, 'structure', 2 from st union all select query_id, page, score, 'rare', 3 from rr union all select query_id, page, score, 'vector', 4 from vn),
j as (select query_id, page, min_by(score, ord) as first, min_by(stage, ord) as stage, sum(case stage when 'structure' then 0.3::double * score when 'rare' then score else 0 end) as extra, count(*) as n from p group by query_id, page),
z as (select query_id, page, round(first + case when n > 1 then extra else 0 end, 6) as score, stage from j), y as (select *, row_number() over (partition by query_id order by score desc, page) as r from z)
select query_id::bigint as query_id, page, score, stage, r::int as rank from y where r <= 20
""")
def retrieve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-06, R-09, R-18: all evidence of a question's pages, ranked."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").alias("page"), "text")
    sections = docs.groupBy("source").agg(F.min("doc_id").alias("start_page"), F.max("doc_id").alias("end_page")).select(F.col("source").alias("section"), F.col("source").alias("title"), F.lit("").alias("keywords"), F.lit("").alias("summary"), "start_page", F.least("end_page", F.col("start_page") + 3).alias("end_page"))
    asked = spark.createDataFrame(list(EXACT), "query_id long, query string")
    vectors = table(spark, sf_dir, "embeddings")
    # a question's embedding is the vector of its number
    embedded = vectors.join(F.broadcast(asked.select("query_id")), F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")
    return R.retrieve_exact(pages, sections, asked, vectors, embedded).select("query_id", "page", "score", "stage", "rank")


@query(f"""
with w(query_id, term) as (values (1, 'red'), (1, 'ring'), (2, 'standard'), (2, 'gear'), (3, 'nothing9'), (3, 'here')), s as (select section, lower(concat_ws(' ', title, keywords, summary)) as t from ({CATALOGUE})),
h as (select query_id, section, count(*) as hits from s, w where regexp_matches(t, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') group by all), r as (select *, row_number() over (partition by query_id order by hits desc, section) as r from h)
select query_id, section, hits, r::int as rank from r where r <= 30
""")
def chapter_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-14, U-06, J-06: chapters by how many words of a question they have."""
    asked = spark.createDataFrame([(1, "red ring"), (2, "STANDARD gear"), (3, "nothing9 here")], "query_id int, query string")
    return R.chapter_pages(catalogue(spark, sf_dir), asked)


@query("""
with x as (select p_partkey, p_type as query, unnest(case when p_size % 5 = 0 then [''] else string_split(p_name, ' ') end) as e, case when p_size % 2 = 0 then ['2023', '2024'] else [''] end as periods from part), y as (select p_partkey, trim(concat_ws(' ', nullif(e, ''), nullif(unnest(periods), ''), query)) as sub_query from x)
select p_partkey as query_id, sub_query, row_number() over (partition by p_partkey order by sub_query)::int as part from y
""")
def decompose_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-07, R-26, R-28: a question for each entity and period."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_type").alias("query"), F.when(F.col("p_size") % 5 == 0, none).otherwise(F.split("p_name", " ")).alias("entities"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("2023"), F.lit("2024"))).otherwise(none).alias("periods"),
    )
    return R.decompose(rows).select("query_id", "sub_query", "part")


@query("select p_partkey as query_id, case when p_size % 3 = 2 then 'power of rk' || (1000 + p_partkey) else 'what of RK' || (1000 + p_partkey) end as used from part")
def guard_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-29: a rewrite that loses an identifier is not used."""
    number = (1000 + F.col("p_partkey")).cast("string")
    rewritten = F.when(F.col("p_size") % 3 == 0, "what of the chip").when(F.col("p_size") % 3 == 2, F.concat(F.lit("power of rk"), number))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("what of RK"), number).alias("query"), rewritten.alias("rewritten"))
    return R.guard_rewrite(rows).select("query_id", "used")


@query()
def merge_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-13, F-27, F-33, W-04: the hits of questions merged into contexts of a bounded size."""
    hits = bm25_document_topk(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    asked = spark.createDataFrame(list(QUESTIONS), "query_id int, query string")
    rows = hits.join(F.broadcast(asked), "query_id").select("query_id", "query", F.col("source").alias("doc_id"), F.col("source").alias("title"), F.col("doc_id").alias("page_num"), F.concat(F.lit("part "), F.col("rank").cast("string")).alias("section"), "score", "text")
    return R.merge_contexts(rows)


@query(r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') as text from pages
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10: the text of pages without markup."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", " "), r"(?s)<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(bare, r"[\t\n\f\r ]+", " ").alias("text"))
