"""Scans, filters, joins, aggregates, windows, top-k and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import query, table


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (1, 7, 32, 100, 4000) and o_orderstatus in ('F', 'O', 'P')")
def scan_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-15, P-01: rows by key; the filters reach the Parquet scan."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(1, 7, 32, 100, 4000) & F.col("o_orderstatus").isin("F", "O", "P")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_orderdate from orders where o_orderpriority = '1-URGENT' order by o_orderdate desc, o_orderkey limit 25 offset 50")
def list_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-16, T-11, T-12: a page of a filtered listing, newest first."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate")
    return R.paged(urgent, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50, 25)


@query("""
with v as (select event_id, user_id, event_type, value from events union all select event_id + 100000, user_id, event_type, value * 2 from events where event_id % 3 = 0)
select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from v) where r = 1
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-20, G-08: an upsert as union and keep-latest; of rows with one id, which the SQL leaves open, the upserted one stays."""
    old = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.lit(0).alias("_new"))
    new = old.where("event_id % 3 = 0").withColumns({"event_id": F.col("event_id") + 100000, "value": F.col("value") * 2, "_new": F.lit(1)})
    order = [F.col("event_id"), F.col("_new"), F.col("value")]
    return R.keep_latest(old.unionByName(new), ["user_id", "event_type"], order).select("user_id", "event_type", "event_id", "value")


@query("""
select 'orders' as name, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)
union all select 'customer', count(*) from customer where c_nationkey <> 3
""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-21, J-12: what is left when a nation's customers and their orders go."""
    customer = table(spark, sf_dir, "customer")
    gone = customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("key"))
    left = R.cascade_delete({"orders": table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key"), "customer": customer.withColumnRenamed("c_custkey", "key")}, "key", gone)
    return R.union_all([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()])


@query("""
select event_id, coalesce(nullif(regexp_extract(props, '"k"\\s*:\\s*(-?\\d+)', 1), ''), '') as k, string_split(event_type || ',x', ',')[1] as first_tag, len(string_split(event_type || ',x', ',')) as tags from events
""".replace("\\\\", "\\"))
def nested_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-24, F-68: JSON and comma-joined columns decoded."""
    tags = F.split(F.concat("event_type", F.lit(",x")), ",")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), tags[0].alias("first_tag"), F.size(tags).alias("tags"))


@query("""
select p_partkey, p_name from part where contains(lower(coalesce(p_name, '')), 'al') or contains(lower(coalesce(p_brand, '')), 'al') or contains(lower(coalesce(p_type, '')), 'al')
""")
def like_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-02, P-03: a substring in any of some columns, case apart, null-safe."""
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("al"))
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", "p_name")


@query("""
with k as (select kw, count(distinct doc_id) as n from (values ('license'), ('the'), ('gpl'), ('ening')) k(kw), documents where contains(lower(text), kw) group by kw)
select kw, n, n <= 40 as selective from k
""")
def keyword_page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-03, A-27: documents that contain a keyword, and whether they are few."""
    words = spark.createDataFrame([("license",), ("the",), ("gpl",), ("ening",)], "kw string")
    hits = R.theta_contains(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), words, "kw")
    return hits.groupBy("kw").agg(F.countDistinct("doc_id").alias("n")).withColumn("selective", F.col("n") <= 40)


@query("""
select c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' or n_name = 'FRANCE' or c_mktsegment = 'BUILDING'
""")
def category_or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-04: a category at any of three levels."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.where((F.col("r_name") == "ASIA") | (F.col("n_name") == "FRANCE") | (F.col("c_mktsegment") == "BUILDING")).select("c_custkey")


@query("""
with r as (select event_id, user_id, value, count(*) filter (value >= 0.9) over (partition by user_id) as good, row_number() over (partition by user_id order by value desc, event_id) as r from events)
select event_id, user_id, value from r where (good > 0 and value >= 0.9) or (good = 0 and r <= 5)
""")
def threshold_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-05: rows over a threshold, and where there are none the best five."""
    by = Window.partitionBy("user_id")
    good = F.sum((F.col("value") >= 0.9).cast("int")).over(by)
    rank = F.row_number().over(by.orderBy(F.col("value").desc(), "event_id"))
    ranked = table(spark, sf_dir, "events").select("event_id", "user_id", "value", good.alias("good"), rank.alias("rank"))
    return ranked.where(((F.col("good") > 0) & (F.col("value") >= 0.9)) | ((F.col("good") == 0) & (F.col("rank") <= 5))).select("event_id", "user_id", "value")


@query("""
with t(term) as (values ('small'), ('small_ring'), ('hot')), p as (select p_partkey, lower(p_name) as n from part)
select term, p_partkey from t, p where contains(n, lower(term)) or contains(n, replace(lower(term), '_', ' ')) or contains(n, replace(lower(term), ' ', '_'))
""")
def doc_filter_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-06, P-17: filter terms resolved against titles in three spellings."""
    terms = spark.createDataFrame([("small",), ("small_ring",), ("hot",)], "term string")
    spelled = terms.select("term", F.explode(F.array_distinct(F.array(F.lower("term"), F.translate(F.lower("term"), "_", " "), F.translate(F.lower("term"), " ", "_")))).alias("spelling"))
    return R.theta_contains(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"), spelled, "spelling").select("term", "p_partkey").distinct()


@query("""
select doc_id, contains(lower(substr(text, 1, 200)), 'license') or contains(lower(substr(text, 1, 200)), 'contents') as low_value, regexp_matches(source, '^(_|\\d+$)') as no_title from documents
""")
def low_value_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-09, P-11: pages of little value by their first characters, and titles that aren't content."""
    head = F.lower(F.substring("text", 1, 200))
    words = F.array(F.lit("license"), F.lit("contents"))
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(words, lambda w: F.contains(head, w)).alias("low_value"), F.col("source").rlike(r"^(_|\d+$)").alias("no_title"))


@query("""
with f as (select o_orderkey, [o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y')] as x from orders)
select o_orderkey, array_to_string(list_filter(x, lambda v: not regexp_full_match(v, '\\d{4}(-\\d{2}){0,2}')), '|') as kept from f
""")
def time_filters_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-12: filter values that are dates are dropped."""
    values = F.array("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.filter(values, lambda v: ~v.rlike(r"^\d{4}(-\d{2}){0,2}$")), "|").alias("kept"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def owned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-13: rows of owners, as a semi join."""
    owners = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(owners, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""
with m as (select max(ts) as now from events)
select event_id, ts, event_type, value from events, m where ts >= now - interval 24 hour and event_type = 'click' order by ts desc, event_id limit 50
""")
def event_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-14, P-15, F-67: events since a cutoff, of one type, newest first."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    recent = events.join(F.broadcast(now)).where((F.col("ts") >= F.col("now") - F.expr("interval 24 hours")) & (F.col("event_type") == "click"))
    return recent.orderBy(F.col("ts").desc(), "event_id").limit(50).select("event_id", "ts", "event_type", "value")


@query("""
select p_partkey, p_size, case when p_size < 10 and p_retailprice < 1000 then 'blank' when p_size < 10 then 'text' when p_retailprice > 1500 then 'text' else 'candidate' end as page_class,
  case when p_size > 20 and length(p_name) < 20 then 'scan_page' when contains(p_name, 'a') and length(p_name) < 30 then 'image_table' when contains(p_type, 'LARGE') then 'native_table' else 'text' end as page_type from part
""")
def page_class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-03, P-19: page classes by rules on sizes and marks."""
    first = F.when((F.col("p_size") < 10) & (F.col("p_retailprice") < 1000), "blank").when(F.col("p_size") < 10, "text").when(F.col("p_retailprice") > 1500, "text").otherwise("candidate")
    kind = F.when((F.col("p_size") > 20) & (F.length("p_name") < 20), "scan_page").when(F.contains("p_name", F.lit("a")) & (F.length("p_name") < 30), "image_table").when(F.contains("p_type", F.lit("LARGE")), "native_table").otherwise("text")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", first.alias("page_class"), kind.alias("page_type"))


@query("""
with c(cat) as (values ('STANDARD'), ('ECONOMY ANODIZED STEEL'), ('PROMO'), ('zzz')), t as (select distinct p_type from part)
select cat, max(case when lower(cat) = lower(p_type) then 1.0 when contains(lower(p_type), lower(cat)) or contains(lower(cat), lower(p_type)) then 0.8 else 0.0 end) as score from c, t group by cat
""")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-20, PL-05: how well categories match, 1 exact and .8 as a part."""
    categories = spark.createDataFrame([("STANDARD",), ("ECONOMY ANODIZED STEEL",), ("PROMO",), ("zzz",)], "cat string")
    types = table(spark, sf_dir, "part").select(F.lower("p_type").alias("t")).distinct()
    low = F.lower("cat")
    score = F.when(low == F.col("t"), 1.0).when(F.contains("t", low) | F.contains(low, F.col("t")), 0.8).otherwise(0.0)
    return types.join(F.broadcast(categories)).groupBy("cat").agg(F.max(score).alias("score"))


@query("""
with q(query_id, needed) as (values (1, ['src1', 'en']), (2, ['src3', 'fr']), (3, ['nothing', 'else'])), m as (
  select query_id, doc_id, list_filter([contains(source, needed[1]), contains(lang, needed[2])], lambda x: x) as hits, least(2, len(needed)) as need from q, documents), s as (select *, len(hits) >= need as ok from m),
a as (select query_id, count(*) filter (ok) as n from s group by query_id)
select s.query_id, count(*) as docs from s join a using (query_id) where ok or n = 0 group by s.query_id
""")
def subquery_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-18: documents with enough of a sub-query's marks, and all documents where none has."""
    asked = spark.createDataFrame([(1, ["src1", "en"]), (2, ["src3", "fr"]), (3, ["nothing", "else"])], "query_id int, needed array<string>")
    both = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(F.broadcast(asked))
    hits = F.contains("source", F.col("needed")[0]).cast("int") + F.contains("lang", F.col("needed")[1]).cast("int")
    n = both.groupBy("query_id").agg(F.count(F.when(hits >= 2, 1)).alias("some"), F.count("*").alias("all"))
    return n.select("query_id", F.when(F.col("some") > 0, F.col("some")).otherwise(F.col("all")).alias("docs"))


@query("select conv_id, count(*) as messages, count(*) filter (role = 'user') as asked, max(turn) as last_turn from conversations group by conv_id")
def session_message_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-02, A-03: sessions with their messages, empty ones too."""
    talk = table(spark, sf_dir, "conversations")
    return talk.select("conv_id").distinct().join(talk, "conv_id", "left").groupBy("conv_id").agg(F.count("turn").alias("messages"), F.count(F.when(F.col("role") == "user", 1)).alias("asked"), F.max("turn").alias("last_turn"))


@query("""
with s as (select user_id, max(ts) as expires from events group by user_id)
select c_custkey, c_name, case when c_custkey % 2 = 0 then expires else null end as expires from customer join s on c_custkey = user_id
""")
def session_user_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03, ST-05: users by session, with the session's expiry in place of their own."""
    sessions = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("expires"))
    return table(spark, sf_dir, "customer").join(sessions, F.col("c_custkey") == F.col("user_id")).select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("expires")).alias("expires"))


@query("""
select l_orderkey, l_linenumber, o_orderdate, c_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_shipdate >= timestamp '1998-06-01' and l_quantity > 45
""")
def hits_join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01, J-04: hits with their pages and documents by inner joins instead of a lookup for each."""
    hits = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp")) & (F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return hits.join(orders, "l_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")


_SECTIONS = "select o_orderkey as section, o_custkey % 50 as doc, (o_orderkey % 97)::bigint as start_page, (o_orderkey % 97 + o_orderkey % 13)::bigint as end_page from orders"


@query(f"""
with s as ({_SECTIONS}), p as (select l_orderkey * 10 + l_linenumber as page, (l_suppkey % 50)::bigint as doc, (l_partkey % 110)::bigint as page_num from lineitem)
select p.doc, p.page_num, count(*) as n, min(section) as first_section from p join s on p.doc = s.doc and page_num between start_page and end_page group by all
""")
def section_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-05, J-06: pages within sections; both sides meet in cells of pages, not by inequality alone."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sections = o.select(F.col("o_orderkey").alias("section"), (F.col("o_custkey") % 50).alias("doc"), (F.col("o_orderkey") % 97).alias("start_page"), (F.col("o_orderkey") % 97 + F.col("o_orderkey") % 13).alias("end_page"))
    # equal pages join once and count by how many they are
    pages = l.groupBy((F.col("l_suppkey") % 50).alias("doc"), (F.col("l_partkey") % 110).alias("page_num")).agg(F.count("*").alias("times"))
    met = R.range_join(pages, "page_num", sections, "start_page", "end_page", ["doc"])
    return met.groupBy("doc", "page_num").agg(F.sum("times").alias("n"), F.min("section").alias("first_section"))


@query("""
with c as (select event_id, user_id, ts from events where event_type <> 'purchase'), p as (select user_id, ts, max(event_id) as last_purchase, max_by(value, event_id) as amount from events where event_type = 'purchase' group by user_id, ts)
select c.event_id, c.user_id, c.ts, last_purchase, amount from c asof left join p on c.user_id = p.user_id and c.ts >= p.ts
""")
def asof_latest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07: each event with its user's latest purchase until then."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"), F.max_by("value", "event_id").alias("amount"))
    return R.as_of(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["last_purchase", "amount"])


@query("""
with e as (select event_id, user_id, case when event_type = 'purchase' then value end as v from events)
select event_id, user_id, coalesce(last_value(v ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), first_value(v ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following)) as v from e
""")
def fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-08: gaps filled from before, else from after."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return R.fill_forward(events, ["user_id"], "event_id", "v")


@query("""
with k(kw) as (values ('red'), ('ring'), ('economy'), ('zzz')), h as (select kw, p_partkey, p_brand from k, part where contains(lower(p_name || ' ' || p_type), kw)), d as (select kw, count(distinct p_brand) as df from h group by kw)
select h.kw, p_brand, df, round(sum(1.0::double / (1 + df)), 6) as weight from h join d using (kw) group by h.kw, p_brand, df
""")
def df_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-09, A-11: keywords against sections, and inverse document-frequency weights."""
    words = spark.createDataFrame([("red",), ("ring",), ("economy",), ("zzz",)], "kw string")
    hits = R.theta_contains(table(spark, sf_dir, "part"), F.concat_ws(" ", "p_name", "p_type"), words, "kw").select("kw", "p_partkey", "p_brand")
    return R.df_weights(hits, "kw", "p_brand").groupBy("kw", "p_brand", "df").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query("""
with v as (select vec_id as doc_id, label, embedding[1]::double as sim from embeddings), d as (select doc_id, length(text)::double / 1000 as score from documents where contains(text, 'the'))
select doc_id, round(d.score + coalesce(25.0 * sim, 0), 6) as score, 'page' as stage from d left join v using (doc_id)
union all select doc_id, round(5.0 + 2.5 * sim, 6), 'vector' from v where doc_id not in (select doc_id from d)
""")
def hybrid_confirm_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11: text hits raised where vectors confirm them, and vector hits that fill gaps."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.element_at("embedding", 1).cast("double").alias("sim"))
    text = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", (F.length("text").cast("double") / 1000).alias("score"))
    raised = R.confirm(text, vectors, ["doc_id"], "sim", 25.0).select("doc_id", "score", F.lit("page").alias("stage"))
    gap = vectors.select("doc_id", (5.0 + 2.5 * F.col("sim")).alias("score"), F.lit("vector").alias("stage"))
    return R.fill_gap(raised, gap, ["doc_id"]).withColumn("score", F.round("score", 6))


@query("""
select 'documents' as name, count(*) as n, count(distinct source) as kinds from documents union all select 'part', count(*), count(distinct p_type) from part union all select 'users', count(*), count(distinct c_mktsegment) from customer
""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01, A-25, G-07: counts of tables."""
    one = lambda name, t, kind: table(spark, sf_dir, t).agg(F.count("*").alias("n"), F.countDistinct(kind).alias("kinds")).select(F.lit(name).alias("name"), "n", "kinds")
    return R.union_all([one("documents", "documents", "source"), one("part", "part", "p_type"), one("users", "customer", "c_mktsegment")])


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, count(distinct user_id) as users from events group by event_type")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-02, A-24: a distribution by type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("""
with j as (select coalesce(nullif(r_name, ''), 'Uncategorized') as l1, coalesce(nullif(n_name, ''), 'Uncategorized') as l2, coalesce(nullif(c_mktsegment, ''), 'Uncategorized') as l3 from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey)
select l1, l2, l3, count(*) as n from j group by rollup(l1, l2, l3) having l1 is not null
""")
def rollup_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-04: counts at three levels of categories."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Uncategorized"))
    return joined.select(named("r_name").alias("l1"), named("n_name").alias("l2"), named("c_mktsegment").alias("l3")).rollup("l1", "l2", "l3").agg(F.count("*").alias("n")).where("l1 is not null")


@query("""
with c as (select p_brand, p_type, count(*) as n from part group by all), r as (select *, row_number() over (partition by p_brand order by contains(lower('show me economy anodized steel parts'), lower(p_type)) desc, n desc, p_type) as r from c)
select p_brand, p_type, n from r where r = 1
""")
def category_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-05: the most frequent category, but one that the question names comes first."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    named = F.contains(F.lit("show me economy anodized steel parts"), F.lower("p_type"))
    return R.keep_first(counts, ["p_brand"], [named.desc(), F.col("n").desc(), F.col("p_type")])


@query("""
with k(kw) as (values ('the'), ('license'), ('of'), ('public'))
select kw, count(distinct source) as spread from k join documents on contains(lower(text), kw) group by kw
""")
def keyword_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-08: how many distinct attributes a keyword touches."""
    words = spark.createDataFrame([("the",), ("license",), ("of",), ("public",)], "kw string")
    return R.theta_contains(table(spark, sf_dir, "documents"), F.col("text"), words, "kw").groupBy("kw").agg(F.countDistinct("source").alias("spread"))


@query("select distinct p_brand, p_type from part where p_type is not null and p_type <> ''")
def distinct_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-09, A-10: a vocabulary without blanks."""
    return table(spark, sf_dir, "part").where("p_type is not null and p_type <> ''").select("p_brand", "p_type").distinct()


@query("select conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') as roles, arg_min(text, turn) as first_text, list_sum(list_distinct(list(turn)))::bigint as turns from conversations group by conv_id")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14: sources merged by document, the first attributes kept."""
    turns = F.aggregate(F.collect_set("turn"), F.lit(0).cast("long"), lambda s, x: s + x)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.min_by("text", "turn").alias("first_text"), turns.alias("turns"))


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
c as (select *, count(*) over (partition by doc_id, trim(line)) as n from l)
select d.doc_id, md5(coalesce(string_agg(line, chr(10) order by i) filter (not (length(trim(line)) > 15 and n >= 3)), '')) as kept_md5, count(*) filter (length(trim(line)) > 15 and n >= 3) as dropped
from documents d left join c using (doc_id) group by d.doc_id
""")
def repeated_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15, F-12: lines of more than 15 characters that a page has three times go; all in arrays, without a shuffle."""
    lines = F.split("text", "\n", -1)
    mark = lambda x: (F.length(F.trim(x)) > 15) & F.array_contains(F.col("often"), F.trim(x))
    docs = table(spark, sf_dir, "documents").withColumn("sorted", F.array_sort(F.transform(lines, lambda x: F.trim(x))))
    often = F.array_distinct(F.filter("sorted", lambda x, i: (i >= 2) & (F.col("sorted")[F.greatest(i - 2, F.lit(0))] == x)))
    docs = docs.withColumn("often", often)
    kept = F.array_join(F.filter(lines, lambda x: ~mark(x)), "\n")
    return docs.select("doc_id", F.md5(kept.cast("binary")).alias("kept_md5"), F.size(F.filter(lines, mark)).cast("long").alias("dropped"))


@query("select source, case when count(distinct lang) = 1 then min(lang) else 'mixed' end as text_source, round(avg(case when n_chars > 1000 then 1.0 else 0.0 end), 6) as coverage, coalesce(round(avg(n_chars) filter (n_chars > 5000), 6), round(avg(n_chars), 6)) as mean_long from documents group by source")
def text_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18, A-21, A-26: where text is from, the share that is covered, a filtered mean with a fallback."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.when(F.countDistinct("lang") == 1, F.min("lang")).otherwise("mixed").alias("text_source"), F.round(F.avg((n > 1000).cast("double")), 6).alias("coverage"),
        F.coalesce(F.round(F.avg(F.when(n > 5000, n)), 6), F.round(F.avg(n), 6)).alias("mean_long"),
    )


@query("""
select case when ends_with(url, '#top') then 'anchored' when contains(url, '?') then 'query' else 'plain' end as class, round(sum(strlen(html)) / 1048576.0, 2) as mb, count(*) as files from pages group by 1
""")
def storage_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-19: bytes by class."""
    kind = F.when(F.col("url").endswith("#top"), "anchored").when(F.contains("url", F.lit("?")), "query").otherwise("plain")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("class")).agg(F.round(F.sum(F.octet_length("html")) / 1048576.0, 2).alias("mb"), F.count("*").alias("files"))


@query("""
with d as (select distinct s_nationkey, s_suppkey from supplier), r as (select *, s_suppkey - row_number() over (partition by s_nationkey order by s_suppkey) as g from d),
i as (select s_nationkey, min(s_suppkey) as a, max(s_suppkey) as b from r group by s_nationkey, g)
select s_nationkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges, sum(b - a + 1)::bigint as n from i group by s_nationkey
""")
def instance_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20, K-12: numbers of a family as ranges."""
    return R.number_ranges(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey")


@query("""
with s as (select *, row_number() over (partition by conv_id order by turn) as r, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) - length(text) as ahead from conversations)
select conv_id, string_agg(substr(text, 1, 30), '/' order by turn) filter (r <= 10) as head, min(turn) as first, max(turn) as last, coalesce(sum(least(length(text), 800 - ahead)) filter (ahead < 800), 0)::bigint as sampled from s group by conv_id
""")
def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22, A-23, M-09: the heads of a group's first ten parts, its range, and a sample up to a size."""
    over = Window.partitionBy("conv_id").orderBy("turn")
    talk = table(spark, sf_dir, "conversations").withColumns({"r": F.row_number().over(over), "ahead": F.sum(F.length("text")).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text")})
    heads = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 10, F.struct("turn", F.substring("text", 1, 30).alias("t"))))), lambda x: x["t"]), "/")
    return talk.groupBy("conv_id").agg(heads.alias("head"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.coalesce(F.sum(F.when(F.col("ahead") < 800, F.least(F.length("text"), 800 - F.col("ahead")))), F.lit(0)).cast("long").alias("sampled"))


@query("""
with r as (select l_orderkey, l_suppkey, l_linenumber, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as r from lineitem)
select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, r::int as r from r where r <= 3 order by l_extendedprice desc, l_orderkey, l_linenumber limit 40
""")
def rank_within_then_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-01, T-08: the best rows of each document, then of all."""
    best = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"))
    ranked = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", best.alias("r")).where("r <= 3")
    return ranked.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(40)


@query("""
with e as (select user_id, event_id, event_type, case when lag(event_type) over w is distinct from event_type or lag(event_id) over w is null then 1 else 0 end as c from events window w as (partition by user_id order by event_id)),
r as (select *, sum(c) over (partition by user_id order by event_id rows unbounded preceding) as run from e)
select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) as n from r group by user_id, run, event_type
""")
def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-02: runs of consecutive rows with one path."""
    return R.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("""
with s as (select o_custkey as doc, o_orderkey as ord, (o_orderkey % 3 + 1)::int as level, row_number() over (partition by o_custkey order by o_orderkey) as page from orders)
select a.doc, a.ord, a.level, a.page, coalesce(min(b.page), 999)::bigint as end_page from s a left join s b on a.doc = b.doc and b.ord > a.ord and b.level <= a.level group by all
""")
def section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-03: a section ends where one of its level or higher begins."""
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    sections = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"), page.cast("long").alias("page"))
    return R.section_ends(sections, ["doc"], "ord", "level", "page", F.lit(999).cast("long"))


@query("""
with r as (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) as running from documents)
select source, doc_id, running::bigint as running from r where running <= 35500
""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-04: rows in order until a budget is spent."""
    return R.prefix_budget(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], F.col("n_chars"), F.lit(35500)).select("source", "doc_id", "running")


@query("""
with t as (select source, doc_id, n_chars, sum(n_chars) over (partition by source) as total from documents)
select source, doc_id, (case when total > 80000 then least(n_chars, greatest(500, floor(n_chars * 80000 / total))) else n_chars end)::bigint as allowed from t
""")
def proportional_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-05, F-54: sizes cut in proportion to a quota."""
    return R.proportional_sizes(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], F.col("n_chars"), 80000, 500).select("source", "doc_id", "allowed")


@query("""
with p as (select distinct s_nationkey as doc, s_suppkey as page from supplier), n as (select *, count(*) over (partition by doc) as n from p),
w as (select distinct doc, unnest(case when n < 4 then generate_series(greatest(page - 2, 1), page + 2) else [page] end) as page from n)
select doc, page from w union select doc, page + 1 from w where doc < 3
""")
def widen_and_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-06, W-07, U-02: small scopes widened by two pages, chapters with the next one."""
    pages = R.widen(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("page")), ["doc"], "page", 2, 4)
    return pages.unionByName(R.with_next(pages.where("doc < 3"), "page").select("doc", "page")).distinct()


@query("select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as n from events")
def rate_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-08: events of the hour before each."""
    over = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.count("*").over(over).alias("n"))


@query("""
with r as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations)
select conv_id, string_agg(role || ': ' || substr(text, 1, 60), chr(10) order by turn) as history from r where r <= 4 group by conv_id
""")
def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-09, F-40: the last messages of a session, in order."""
    last = R.last_n(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)
    told = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 60)).alias("t")))), lambda x: x["t"])
    return last.groupBy("conv_id").agg(F.array_join(told, "\n").alias("history"))


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
h as (select *, lag(line) over (partition by doc_id order by i) as before from l)
select doc_id, i::int as i, md5(before) as header_md5, length(line)::int as size from h where length(line) < 60 and length(before) < 20 and length(line) > 0
""")
def header_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-11: short lines right after a short header."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("p"))
    found = lines.withColumn("before", before).where((F.length("line") < 60) & (F.length("before") < 20) & (F.length("line") > 0))
    return found.select("doc_id", (F.col("p") + 1).alias("i"), F.md5(F.col("before").cast("binary")).alias("header_md5"), F.length("line").alias("size"))


@query("select n_nationkey, (select min(i) from generate_series(1, 500) g(i) where i not in (select s_suppkey from supplier where s_nationkey = n_nationkey))::bigint as free from nation")
def next_free_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-13: the least number that a tenant hasn't used: one past the first gap, from each tenant's own numbers."""
    used = table(spark, sf_dir, "supplier").where("s_suppkey >= 1").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey").distinct()
    used = used.withColumn("r", F.row_number().over(Window.partitionBy("n_nationkey").orderBy("s_suppkey")))
    dense = used.where("r = s_suppkey").groupBy("n_nationkey").agg(F.max("r").alias("r"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(dense, "n_nationkey", "left").select("n_nationkey", (F.coalesce("r", F.lit(0)) + 1).cast("long").alias("free"))


@query("""
select p_partkey, p_type, p_size from part order by (case when contains(p_type, 'ECONOMY') then 2 when contains(p_type, 'PROMO') then 1 else 0 end + greatest(0, 4 - p_size % 5)) desc, p_size desc, p_partkey limit 30
""")
def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-02, T-05, T-06, T-07: sorts by flags, bonuses and counts, with a last unique key."""
    hits = F.when(F.contains("p_type", F.lit("ECONOMY")), 2).when(F.contains("p_type", F.lit("PROMO")), 1).otherwise(0)
    return table(spark, sf_dir, "part").orderBy((hits + F.greatest(F.lit(0), 4 - F.col("p_size") % 5)).desc(), F.col("p_size").desc(), "p_partkey").limit(30).select("p_partkey", "p_type", "p_size")


@query("""
with a as (select doc_id, 2.0 as score, 'and' as stage from documents where contains(text, 'license') and contains(text, 'the')), o as (select doc_id, 1.0, 'or' from documents where contains(text, 'license') or contains(text, 'ing ')), l as (select doc_id, 0.5, 'like' from documents where contains(text, 'on'))
select doc_id, score, stage from a union all select * from o where doc_id not in (select doc_id from a) union all select * from l where doc_id not in (select doc_id from a) and doc_id not in (select doc_id from o)
""")
def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-01, U-05, U-06: hits of three stages, each document from the first that has it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    has = lambda w: F.contains("text", F.lit(w))
    part = lambda cond, score, stage: docs.where(cond).select("doc_id", F.lit(score).cast("decimal(2,1)").alias("score"), F.lit(stage).alias("stage"))
    return R.priority_union([part(has("license") & has("the"), 2.0, "and"), part(has("license") | has("ing "), 1.0, "or"), part(has("on"), 0.5, "like")], ["doc_id"], ["doc_id"])


@query("select md5(text) as text_md5, min(doc_id) as first_doc, count(*) as copies from documents group by 1")
def exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-03, F-50, U-07: equal contents by hash, the first kept."""
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""
with u as (select c_name, count(*) as n, min(c_custkey) as id from customer group by c_name)
select n_nationkey as tenant, count(c_custkey) as users, count(c_custkey) filter (c_acctbal < 0) as expired, max(c_custkey) as newest, case when count(c_custkey) >= 70 then 'reject' when count(c_custkey) >= 63 then 'warn' else 'ok' end as admission
from nation left join customer on c_nationkey = n_nationkey group by n_nationkey
""")
def tenant_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-01, G-02, G-05, J-17: tenants with their users, and admission by capacity; one table with a tenant column, no loop."""
    users = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("users"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("expired"), F.max("c_custkey").alias("newest"))
    n = F.coalesce("users", F.lit(0))
    return table(spark, sf_dir, "nation").join(users, "n_nationkey", "left").select(F.col("n_nationkey").alias("tenant"), n.alias("users"), F.coalesce("expired", F.lit(0)).alias("expired"), "newest", F.when(n >= 70, "reject").when(n >= 63, "warn").otherwise("ok").alias("admission"))
