"""Tenants and users as tables: lifecycle, sign-in, access decisions, diagnostics of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a tenant and of a user that an update may change.
TENANT_FIELDS, USER_FIELDS = ("name", "status", "quota"), ("role", "display_name", "tenant_id")
#: Paths that need no sign-in, and endings of static files.
OPEN_PATHS = ("/", "/api/v1/health", "/api/v1/login")
STATIC = (".js", ".css", ".png", ".jpg", ".svg", ".ico", ".woff2", ".html", ".json", ".txt", ".md")


def live(tenants: DataFrame) -> DataFrame:
    """Tenants that aren't deleted (G-01)."""
    return tenants.where("status <> 'deleted'")


def delete_tenants(tenants: DataFrame, users: DataFrame, gone: DataFrame, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables after deleting tenants: marked, or taken out if hard, and their users with them (G-01)."""
    keep = tenants.join(gone.select("tenant_id"), "tenant_id", "left_anti")
    if not hard:
        keep = keep.unionByName(tenants.join(gone.select("tenant_id"), "tenant_id", "left_semi").withColumn("status", F.lit("deleted")))
    return keep, users.join(gone.select("tenant_id"), "tenant_id", "left_anti")


def reactivate(tenants: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tenants with those chosen active again, if they were marked (G-01)."""
    marked = tenants.join(chosen.select("tenant_id", F.lit(True).alias("_again")), "tenant_id", "left")
    return marked.withColumn("status", F.when(F.col("_again") & (F.col("status") == "deleted"), "active").otherwise(F.col("status"))).drop("_again")


def update(rows: DataFrame, key: str, changes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows with the changes (key, field, value) of permitted fields, the last by value where there are several (G-01, G-02)."""
    one = changes.where(F.col("field").isin(*fields)).groupBy(key).pivot("field", list(fields)).agg(F.max("value"))
    named = one.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(named, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def create_users(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (user_id, name, ...) with accepted: names are unique over all tenants, so neither a known nor a twice wanted one is accepted but once, for the least id (G-02)."""
    known = users.select("name", F.lit(True).alias("_known")).distinct()
    first = wanted.groupBy("name").agg(F.min("user_id").alias("_first"))
    return wanted.join(known, "name", "left").join(first, "name").withColumn("accepted", F.col("_known").isNull() & (F.col("user_id") == F.col("_first"))).select(*wanted.columns, "accepted")


def password_hash(password: Column, salt: Column, rounds: int = 1000) -> Column:
    """A salted SHA-256 chain in the JVM; salts are columns, so nothing random enters a plan (F-69)."""
    first = F.sha2(F.concat(salt, F.lit(":"), password).cast("binary"), 256)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda h, _: F.sha2(F.concat(h, salt).cast("binary"), 256))


def new_key(seed: Column) -> Column:
    """An access key: 'sk-' and 48 hexadecimal digits of a secret seed (F-69)."""
    return F.concat(F.lit("sk-"), F.substring(F.sha2(seed.cast("binary"), 256), 1, 48))


def sign_in(attempts: DataFrame, users: DataFrame, rounds: int = 1000) -> DataFrame:
    """attempts (attempt_id, name, password) with user_id and outcome: ok, refused, or ambiguous if several users fit (G-03)."""
    tried = attempts.join(users.select("name", "user_id", "salt", "hash"), "name", "left")
    fits = password_hash(F.col("password"), F.col("salt"), rounds) == F.col("hash")
    found = tried.groupBy("attempt_id").agg(F.count(F.when(fits, 1)).alias("n"), F.min(F.when(fits, F.col("user_id"))).alias("user_id"))
    outcome = F.when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous").otherwise("refused")
    return found.select("attempt_id", F.when(F.col("n") == 1, F.col("user_id")).alias("user_id"), outcome.alias("outcome"))


def rotate_keys(users: DataFrame, sessions: DataFrame, chosen: DataFrame, seed: Column) -> tuple[DataFrame, DataFrame]:
    """Users with new keys for those chosen, and the sessions without theirs (G-03)."""
    marked = users.join(chosen.select("user_id", F.lit(True).alias("_new")), "user_id", "left")
    changed = marked.withColumn("api_key", F.when(F.col("_new"), new_key(seed)).otherwise(F.col("api_key"))).drop("_new")
    return changed.select(*users.columns), sessions.join(chosen.select("user_id"), "user_id", "left_anti")


def access(requests: DataFrame, users: DataFrame, tenants: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, path, authorization, tenant) with tenant_id, status and reason, as the gate before every route decides (G-04).

    A key (session keys and users' keys are rows of users: api_key, user_id, tenant_id, role, expires_at) must be known
    and not expired; only admins may name another tenant than their own; the tenant must be active.
    """
    is_open = F.col("path").isin(*OPEN_PATHS) | F.col("path").startswith("/static/") | F.exists(F.array(*[F.lit(x) for x in STATIC]), lambda x: F.endswith(F.col("path"), x))
    bearer = F.coalesce(F.col("authorization").startswith("Bearer "), F.lit(False))
    key = F.trim(F.regexp_replace(F.coalesce("authorization", F.lit("")), "Bearer ", ""))
    known = users.select(F.col("api_key").alias("_key"), F.col("tenant_id").alias("_own"), "role", "expires_at", F.lit(True).alias("_known"))
    asked = requests.withColumn("_key", F.when(bearer & (key != ""), key)).join(known, "_key", "left")
    asked = asked.withColumn("tenant_id", F.coalesce(F.nullif("tenant", F.lit("")), F.col("_own")))
    asked = asked.join(tenants.select("tenant_id", F.col("status").alias("_status")), "tenant_id", "left")
    reason = (
        F.when(is_open, "open").when(~bearer, "no sign-in").when(key == "", "empty key").when(F.col("_known").isNull(), "unknown key").when(F.col("expires_at") <= now, "expired key")
        .when((F.col("tenant_id") != F.col("_own")) & (F.col("role") != "admin"), "other tenant").when(F.coalesce(F.col("_status"), F.lit("")) != "active", "inactive tenant").otherwise("granted")
    )
    status = F.when(F.col("reason").isin("open", "granted"), 200).when(F.col("reason").isin("other tenant", "inactive tenant"), 403).otherwise(401)
    judged = asked.withColumn("reason", reason).withColumn("status", status)
    return judged.select("request_id", F.when(F.col("reason") != "open", F.col("tenant_id")).alias("tenant_id"), "status", "reason")


def diagnose(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a document: pages, empty pages, sections, chunks, pages without a chunk, and what is amiss (G-06)."""
    told = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count(F.when(F.trim(F.coalesce("raw_text", F.lit(""))) == "", 1)).alias("empty_pages"), F.countDistinct("section_path").alias("sections"),
    )
    cut = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.countDistinct("page_num").alias("_covered"))
    whole = documents.select("doc_id").join(told, "doc_id", "left").join(cut, "doc_id", "left").na.fill(0, ["pages", "empty_pages", "sections", "chunks", "_covered"])
    uncovered = F.greatest(F.col("pages") - F.col("_covered"), F.lit(0))
    amiss = F.when(F.col("pages") == 0, "no pages").when(F.col("chunks") == 0, "not indexed").when(F.col("empty_pages") * 2 > F.col("pages"), "mostly empty").when(F.col("sections") == 0, "no structure").otherwise("fine")
    return whole.select("doc_id", "pages", "empty_pages", "sections", "chunks", uncovered.alias("uncovered"), amiss.alias("state"))
