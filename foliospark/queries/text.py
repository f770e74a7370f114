"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table

#: Questions in two scripts for the tokenizers; the second field is what DuckDB's VALUES get too.
QUESTIONS = (
    (1, "RK3588 的详细规格是什么"), (2, "version 2024 compare"), (3, "12345"), (4, "AB1234X与CD99 PCIe3.1 difference, please!"), (5, ""),
    (6, "营业收入和成本 2023年"), (7, "what's the UART-baud rate?"), (8, "电源"), (9, "ZX81 zx81 ZX81 MAX232A"),
)
VALUES = ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in QUESTIONS)
CJK = r"\x{4e00}-\x{9fff}"
_FROM = f"(select * from (values {VALUES}) v(query_id, query) union all select 100 + item_id, text from benchmark) q"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions above and all test items."""
    items = table(spark, sf_dir, "benchmark").select((100 + F.col("item_id")).alias("query_id"), F.col("text").alias("query"))
    return spark.createDataFrame(list(QUESTIONS), "query_id long, query string").unionByName(items)


_CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '[^\p{{L}}\p{{N}}_{CJK}]+', ' ', 'g'), '([{CJK}])([A-Za-z0-9_])', '\1 \2', 'g'), '([A-Za-z0-9_])([{CJK}])', '\1 \2', 'g'), '\s+', ' ', 'g'))"


@query(rf"select query_id, {_CLEAN} as cleaned from {_FROM}")
def text_clean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01: search strings of questions."""
    return questions(spark, sf_dir).select("query_id", T.clean_query(F.col("query")).alias("cleaned"))


@query(rf"""
with c as (select query_id, unnest(list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '')) as w from {_FROM}),
t as (select query_id, case when regexp_full_match(w, '[{CJK}]+') and length(w) >= 3 then list_transform(range(1, length(w)), lambda i: substr(w, i::int, 2)) else [w] end as p from c),
u as (select query_id, unnest(p) as token from t)
select query_id, token, count(*) as n, length(token) >= 3 and not regexp_full_match(token, '\d+') as is_trigram, length(token) = 2 as is_bigram from u group by all
""")
def text_chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-02, F-04: chunk tokens and their classes."""
    tokens = questions(spark, sf_dir).select("query_id", F.explode(T.chunk_tokens(F.col("query"))).alias("token"))
    return tokens.groupBy("query_id", "token").agg(F.count("*").alias("n")).select("*", (F.size(T.trigram_tokens(F.array("token"))) > 0).alias("is_trigram"), (F.size(T.bigram_tokens(F.array("token"))) > 0).alias("is_bigram"))


@query(rf"""
with c as (select query_id, unnest(list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '')) as w from {_FROM}),
t as (select query_id, case when regexp_full_match(w, '[{CJK}]+') and length(w) > 4 then list_distinct(list_append(list_transform(range(1, length(w), 2), lambda i: substr(w, i::int, 2)), substr(w, length(w)::int - 1, 2))) else [w] end as p from c),
u as (select query_id, unnest(p) as token from t)
select query_id, token, count(*) as n from u group by all
""")
def text_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-03: page tokens."""
    tokens = questions(spark, sf_dir).select("query_id", F.explode(T.page_tokens(F.col("query"))).alias("token"))
    return tokens.groupBy("query_id", "token").agg(F.count("*").alias("n"))


@query(rf"""
with q as (select * from {_FROM})
select query_id, array_to_string(list_concat(regexp_extract_all(query, '[{CJK}]{{2,}}'), list_filter(regexp_extract_all(query, '[A-Za-z0-9]{{2,}}'), lambda t: not regexp_full_match(t, '\d+'))), '|') as keywords,
  array_to_string(list_concat(regexp_extract_all(query, '[{CJK}]{{2,}}'), list_filter(regexp_extract_all(query, '[A-Za-z0-9]{{3,}}'), lambda t: not regexp_full_match(t, '\d+'))), '|') as page_keywords,
  case when regexp_matches(query, '[{CJK}]') then 'zh' else 'en' end as language
from q
""")
def text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-05, F-06, F-30: keywords for sections and for pages, and the language."""
    q = F.col("query")
    return questions(spark, sf_dir).select("query_id", F.array_join(T.query_keywords(q), "|").alias("keywords"), F.array_join(T.query_keywords(q, 3), "|").alias("page_keywords"), T.language(q).alias("language"))


@query(rf"""
with q as (select query_id, ' ' || regexp_replace(query, '([^A-Za-z0-9])', ' \1 ', 'g') || ' ' as query from {_FROM}),
m as (select query_id, regexp_extract_all(query, '[^A-Za-z0-9]([A-Z]+\d{{2,}}[A-Z]*)[^A-Za-z0-9]', 1) as tokens from q)
select query_id, array_to_string(list_filter(tokens, lambda t, i: list_position(tokens, t) = i), '|') as models from m
""")
def text_model_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-07, F-08: identifiers of capitals and digits."""
    return questions(spark, sf_dir).select("query_id", F.array_join(T.model_tokens(F.col("query")), "|").alias("models"))


@query(rf"""
with q as (select query_id, regexp_extract_all(query, '[A-Za-z][A-Za-z0-9.\-]{{1,20}}') as w from {_FROM}),
d as (select query_id, list_filter(w, lambda t, i: list_position(list_transform(w, lambda x: lower(x)), lower(t)) = i) as w from q)
select query_id, array_to_string(w, '|') as keywords, array_to_string(case when list_contains(list_transform(w, lambda x: lower(x)), 'difference') and not list_contains(list_transform(w, lambda x: lower(x)), 'compare') then list_append(w, 'compare') else w end[1:24], '|') as expanded from d
""")
def text_fact_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-09, F-10: fact keywords, and their expansion by a vocabulary."""
    words = T.fact_keywords(F.col("query"))
    vocabulary = F.create_map(F.lit("difference"), F.array(F.lit("compare")))
    return questions(spark, sf_dir).select("query_id", F.array_join(words, "|").alias("keywords"), F.array_join(T.expand_terms(words, vocabulary), "|").alias("expanded"))


@query(r"""
select doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{E000}-\x{F8FF}]', '', 'g')) as sanitized_md5,
  case when length(text) < 200 then substr(text, 1, 100) when length(array_to_string(string_split(text, '.')[1:3], '.')) > 200 then substr(array_to_string(string_split(text, '.')[1:3], '.'), 1, 200) || '...' else array_to_string(string_split(text, '.')[1:3], '.') end as summary,
  md5(text) as text_md5, regexp_matches(text, '[\x{4e00}-\x{9fff}]') as has_cjk
from documents
""")
def text_sanitize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-12, F-20, F-30, F-50: sanitized characters, page summaries, content hashes."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitize_chars(t).cast("binary")).alias("sanitized_md5"), T.page_summary(t, ".").alias("summary"), F.md5(t.cast("binary")).alias("text_md5"), (T.language(t) == "zh").alias("has_cjk"))


_TITLE = r"regexp_replace(trim(regexp_replace(regexp_replace(p_name || '  ' || p_size || ' ', '\s+\d+\s*$', ''), '\.{2,}$', '')), '\s+', ' ', 'g')"


@query(rf"""
select p_partkey, {_TITLE} as title, array_to_string(regexp_extract_all({_TITLE}, '[A-Za-z][A-Za-z0-9\-_]+')[1:5], ', ') as keywords,
  trim(translate(regexp_replace(lower(replace(p_name, ' ', '_')) || '-' || p_partkey || '.pdf', '\.(pdf|docx|md|txt)$', ''), '_-', '  ')) as file_title,
  regexp_extract('spec_' || replace(upper(p_brand), '#', '') || '123.pdf', '([A-Z]{{2,}}\d{{3,}}[A-Z0-9]*)', 1) as model,
  regexp_extract('/store/' || p_type || '/' || p_name || '.png', '([^/\\]*)$', 1) as base
from part
""")
def text_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-14, F-18, F-19, F-21, F-39: titles from headings and file names."""
    title = T.clean_title(F.concat("p_name", F.lit("  "), F.col("p_size").cast("string"), F.lit(" ")))
    file = F.concat(F.lower(F.regexp_replace("p_name", " ", "_")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", title.alias("title"), T.title_keywords(title).alias("keywords"), T.filename_title(file).alias("file_title"),
        T.product_model(F.concat(F.lit("spec_"), F.regexp_replace(F.upper("p_brand"), "#", ""), F.lit("123.pdf"))).alias("model"),
        T.basename(F.concat(F.lit("/store/"), "p_type", F.lit("/"), "p_name", F.lit(".png"))).alias("base"),
    )


LINES = ("# Overview", "### Power rails 3", "2.3.1 Clock tree", "40、营业收入和营业成本", "Chapter 4 Interfaces", "section B Notes", "第三章 总体设计", "plain text line", "1234567890 too long", "第二节 电源", "")
LINE_VALUES = ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(LINES))


@query(rf"""
with l as (select * from (values {LINE_VALUES}) l(line_no, line)),
k as (select *, case when regexp_matches(line, '^#{{1,6}}\s+.+') then 'sharp' when regexp_matches(line, '^第[一二三四五六七八九十]+[编章节部篇]\s+.+') then 'cjk'
  when regexp_matches(line, '^\d+(?:\.\d+)*[\s、．.]{{1,3}}.+') and length(regexp_extract(line, '^(\d+(?:\.\d+)*)[\s、．.]{{1,3}}(.+)', 1)) <= 8 then 'number'
  when regexp_matches(line, '^(?i:Chapter|Section|Part)\s+(?:\d+|[A-Z])\s+.+') then 'named' end as kind from l)
select line_no, case kind when 'sharp' then length(regexp_extract(line, '^(#{{1,6}})\s+(.+)', 1)) when 'cjk' then case regexp_extract(line, '^第([一二三四五六七八九十]+)([编章节部篇])', 2) when '章' then 2 when '节' then 3 else 1 end
    when 'number' then length(regexp_replace(regexp_extract(line, '^(\d+(?:\.\d+)*)', 1), '\d', '', 'g')) + 1 when 'named' then case when lower(line) like 'section%' then 2 else 1 end end::int as level,
  case kind when 'sharp' then trim(regexp_extract(line, '^(#{{1,6}})\s+(.+)', 2)) when 'cjk' then trim(regexp_extract(line, '^第[一二三四五六七八九十]+[编章节部篇]\s+(.+)', 1))
    when 'number' then trim(regexp_extract(line, '^(\d+(?:\.\d+)*)[\s、．.]{{1,3}}(.+)', 2)) when 'named' then trim(regexp_extract(line, '^(?i:Chapter|Section|Part)\s+(?:\d+|[A-Z])\s+(.+)', 1)) end as title
from k
""")
def text_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-15: heading lines of four styles."""
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no int, line string").withColumn("h", T.heading(F.col("line")))
    return lines.select("line_no", "h.level", "h.title")


@query(r"""
with p as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: trim(x)), lambda x: x <> '' and length(x) <= 80) as l from documents),
t as (select *, coalesce(l[1], '') as page_title from p)
select doc_id, page_title, case when instr(lower(text), lower(page_title)) > 0 and page_title <> '' then instr(lower(text), lower(page_title)) + length(page_title) - 1 else 0 end::int as title_end,
  lower(regexp_replace(text, '\s+', '', 'g')) like '%license%' as mentions_license
from t
""")
def text_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-16, F-17, F-22: page titles, where they end, and containment whatever the spaces."""
    docs = table(spark, sf_dir, "documents").withColumn("page_title", T.page_title(F.col("text")))
    end = F.when(F.col("page_title") != "", T.title_end(F.col("text"), F.col("page_title"))).otherwise(0).cast("int")
    return docs.select("doc_id", "page_title", end.alias("title_end"), T.contains_loosely(F.col("text"), F.lit("LI CENSE")).alias("mentions_license"))


@query(r"""
with g as (select doc_id, text || case doc_id % 3 when 0 then chr(10) || '--- ### Page Visual Analysis (VLM)' || chr(10) || 'Summary: x' when 1 then '=== page chart content analysis === y' else '' end as t from documents)
select doc_id, md5(regexp_replace(t, '(?si)(?:---\s*#{0,3}\s*Page Visual Analysis \(VLM\)|===\s*Page Chart Content Analysis\s*===).*', '')) as kept_md5 from g
""")
def text_strip_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-23, P-10: text without the blocks that a model has added."""
    added = F.when(F.col("doc_id") % 3 == 0, "\n--- ### Page Visual Analysis (VLM)\nSummary: x").when(F.col("doc_id") % 3 == 1, "=== page chart content analysis === y").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_generated(F.concat("text", added)).cast("binary")).alias("kept_md5"))


@query(r"""
with s as (select doc_id, text, case when length(text) <= 120 then text when length(regexp_extract(substr(text, 1, 120), '(?s)^(.*[.!?;])', 1)) > 60 then regexp_extract(substr(text, 1, 120), '(?s)^(.*[.!?;])', 1) else substr(text, 1, 120) || '...' end as quote from documents),
p as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: true) as lines from documents)
select s.doc_id, quote, (length(text) - length(replace(text, '?', ''))) > 0.3 * length(text) and length(text) > 0 as garbled,
  ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::bigint as n_the
from s
""")
def text_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-26, F-31: verbatim quotes trimmed at a sentence's end, garbled answers, occurrences side by side."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.trim_verbatim(t, 120).alias("quote"), T.is_garbled_answer(t).alias("garbled"), T.count_of(F.lower(t), "the").alias("n_the"))


@query(r"""
with p as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
m as (select *, list_transform(parts, lambda x, i: case when length(trim(x)) > 50 then '[Section ' || i || ']' || chr(10) else '' end || x || chr(10)) as marked from p)
select doc_id, md5(case when length(text) < 1000 or len(parts) <= 3 then replace(text, chr(10), chr(10) || chr(10)) else array_to_string(marked, chr(10)) end) as labelled_md5 from m
""")
def text_label_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-28: numbered paragraphs (lines of documents are their paragraphs here)."""
    spaced = F.regexp_replace("text", "\n", "\n\n")
    labelled = F.when(F.length("text") < 1000, spaced).otherwise(T.label_paragraphs(spaced))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(labelled.cast("binary")).alias("labelled_md5"))


@query(r"""
with t as (select doc_id, trim(text) as t from documents),
s as (select doc_id, t, length(regexp_replace(t, '[\s\x0b\x1c-\x1f]', '', 'g')) as total, len(regexp_extract_all(t, '[\x{25a1}\x{fffd}\x{25a0}\x{201a}\x{0192}\x00\x10-\x1b]')) as bad,
  least(len(regexp_extract_all(t, '[a-zA-Z]{2,}')) / 10.0::double, 1.0::double) as dict, list_filter(list_transform(string_split(t, chr(10)), lambda x: length(trim(x))), lambda n: n > 0) as sizes from t),
p as (select *, case when total > 0 then bad / total::double else 1.0 end as garbled,
  len(list_filter(sizes, lambda n: n > 5 and n < 200)) / len(sizes)::double as fair, len(list_filter(sizes, lambda n, i: n < 5 and coalesce(sizes[i + 1], 0) > 50)) / len(sizes)::double as short from s),
q as (select *, case when not contains(t, chr(10)) then 0.5 when len(sizes) >= 3 then (fair + 1 - short) / 2 else fair end as para from p),
r as (select *, (1 - garbled) * 0.4::double + dict * 0.3::double + para * 0.3::double as score from q)
select doc_id, case when length(t) < 10 then 1.0 else garbled end as garbled, round(case when length(t) < 10 then 0.0 else score end, 6) as score,
  case when length(t) < 10 then 'FAIL' when score >= 0.7 and garbled <= 0.05 and dict >= 0.3 then 'PASS' when score >= 0.4 and garbled <= 0.05 then 'SUSPICIOUS' else 'FAIL' end as level
from r
""")
def text_quality_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17, K-15: garbled, dictionary and paragraph shares, and the level that decides on recognition."""
    return T.text_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "garbled", F.round("score", 6).alias("score"), "level")


@query(r"""
with a as (select doc_id, text, lower(text) as low from documents),
s as (select *, contains(low, 'not found') or contains(low, 'no relevant') or contains(low, 'no information') or contains(low, 'does not contain') or contains(low, 'does not mention') as missing,
  len(regexp_extract_all(low, '\d+[.\d]*\s*(?:mm|mhz|ghz|v|ma)')) + len(regexp_extract_all(low, '\b(?:the|of|de)\b')) + (length(low) - length(replace(low, chr(10) || '- ', ''))) // 3 + (length(low) - length(replace(low, chr(10) || '* ', ''))) // 3 + ((length(low) - length(replace(low, chr(10) || '|', ''))) // 2) // 2 as n from a)
select doc_id, case when length(trim(text)) < 10 then 'none' when missing and n >= 3 then 'medium' when missing then 'low' when n >= 8 and length(text) > 500 then 'high' when (n >= 4 and length(text) > 200) or (n >= 2 and length(text) > 100) then 'medium' else 'low' end as confidence from s
""")
def text_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-59, R-32: how far an answer can be trusted."""
    return table(spark, sf_dir, "documents").select("doc_id", T.confidence(F.col("text"), F.lit(""), terms="the|of|de").alias("confidence"))


@query("""
select s.score, case when s.score >= 5.0 then 16000 when s.score >= 2.0 then 10000 when s.score >= 0.5 then 6000 when s.score >= 0.15 then 3000 else 3000 end::int as cap,
  least(greatest(20, 15 * s.n), 500)::int as max_results
from (values (6.0::double, 3), (2.5, 40), (0.6, 0), (0.2, 1), (0.0, 2)) s(score, n)
""")
def text_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-53, F-55: characters for a score, results for a number of entities."""
    rows = spark.createDataFrame([(6.0, 3), (2.5, 40), (0.6, 0), (0.2, 1), (0.0, 2)], "score double, n int")
    return rows.select("score", T.content_cap(F.col("score")).alias("cap"), T.max_results(F.col("n")).alias("max_results"))


@query(r"""
with d as (select doc_id, ' ' || lower(text) || ' ' as t from documents)
select doc_id, regexp_matches(t, '[^a-z0-9]the[^a-z0-9]') as the_word, contains(t, 'ing') as ing_precise, regexp_matches(t, '[^a-z0-9]of[^a-z0-9]') as of_precise, contains(t, 'ción') as cion_part from d
""")
def text_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-41, P-07, P-08: documents that have a term as a word, and by the precise rule."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.term_hit(t, F.lit("The")).alias("the_word"), T.precise_match(t, F.lit("ing")).alias("ing_precise"), T.precise_match(t, F.lit("of")).alias("of_precise"), T.term_hit(t, F.lit("ción")).alias("cion_part"))


@query(r"""
with d as (select doc_id, doc_id % 30 as k, repeat(E'row 123 value\n', (doc_id % 30)::int) || E'\n[Table 1]\n| a |\n' as t from documents) select doc_id, md5(case when k > 15 then '| a |' else t end) as page_md5 from d
""")
def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-13: pages without the plain text that a table repeats."""
    page = F.concat(F.repeat(F.lit("row 123 value\n"), (F.col("doc_id") % 30).cast("int")), F.lit("\n[Table 1]\n| a |\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.optimize_tables(page).cast("binary")).alias("page_md5"))


def _json(c: Column) -> Column:
    return F.concat(F.lit('{"headers":["name","size"],"rows":[["'), "p_name", F.lit('","'), c.cast("string"), F.lit('"],["x",null]]}'))


@query(r"""
with p as (select *, p_size % 3 as k from part)
select p_partkey, case when k < 2 then E'| name | size |\n| --- | --- |\n| ' || p_name || ' | ' || p_size || E' |\n| x |  |' end as markdown,
  round(case k when 0 then 1.0 when 1 then 0.1 else 0.5 end::double, 6) as latex, case when k = 0 then 'bar' when k = 1 then 'line' when contains(p_name, 'widget') then 'flow' else 'unknown' end as chart,
  (k + 1)::int as pieces, case k when 0 then 7 when 1 then 12 else p_size end::int as number, array_to_string(list_sort(list_distinct(['PCIe' || p_size || '.1', 'PCIe2.1', 'PCIe3.1'])), '|') as versions,
  p_name || ' of ' || p_size as value, k <> 1 as content, case when p_size % 2 = 0 then '2023' else '2023|2024' end as years
from p
""")
def text_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-24, F-25, F-34..F-38: tables, formulas, charts, context pieces, number words, versions, values, titles, years."""
    k, size = F.col("p_size") % 3, F.col("p_size").cast("string")
    by = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    marked = F.concat(F.lit("intro\n"), F.array_join(F.array_repeat(F.lit("--- A (Page 1) ---\nx"), k.cast("int")), "\n"))
    versions = F.concat(F.lit("PCIe "), size, F.lit(".1, PCIe2.1 and pcie 3.1, PCIe"), size, F.lit(".1"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.json_table(F.when(k < 2, _json(F.col("p_size"))).otherwise("no json")).alias("markdown"), T.latex_score(by(F.lit(r"\frac{a}{b} = 1"), F.lit("{{"), F.lit("x"))).alias("latex"),
        T.chart_type(by(F.lit("A bar chart of trends"), F.lit("the Trend line"), F.when(F.contains("p_name", F.lit("widget")), "block diagram and photo").otherwise("nothing"))).alias("chart"),
        F.size(T.split_at_markers(marked)).alias("pieces"), T.number_value(by(F.lit(" Seven"), F.lit("TWELVE"), size)).cast("int").alias("number"),
        F.array_join(F.array_sort(F.transform(T.version_tokens(versions, "PCIe"), lambda v: F.regexp_replace(v, "pcie", "PCIe"))), "|").alias("versions"),
        T.clean_value(F.concat(F.lit(" : "), "p_name", F.lit("  of\n"), size, F.lit(". "))).alias("value"), T.is_content_title(by(F.lit("Overview"), F.lit("Table of Contents"), F.lit("Pins"))).alias("content"),
        F.array_join(T.years(F.when(F.col("p_size") % 2 == 0, "2023 and 2023").otherwise("2023 and 2024, 2023")), "|").alias("years"),
    )
