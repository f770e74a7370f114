"""The knowledge base's tables: their columns, how older ones are brought up to date, and what an upload must keep to (G-10, S-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of each table; a new one is added at the end.
TABLES = {
    "documents": "doc_id string, file_hash string, filename string, title string, category string, pages int, status string, created_at timestamp",
    "pages": "doc_id string, page_num int, page_type string, section_path string, section_title string, raw_text string, summary string, extra string",
    "chunks": "doc_id string, chunk_idx int, page_num int, section_path string, chunk string",
    "facts": "doc_id string, entity string, attribute string, value string, page_num int, source_text string",
    "tenants": "tenant_id string, name string, status string, quota int",
    "users": "user_id string, tenant_id string, name string, role string, api_key string, salt string, hash string, expires_at timestamp",
    "sessions": "session_id string, user_id string, updated_at timestamp",
    "events": "event_id string, tenant_id string, kind string, at timestamp, detail string",
}
#: The user that a new system begins with, before its password is set.
FIRST_TENANT, FIRST_USER = ("default", "Default", "active", 0), ("admin", "default", "admin", "admin")


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conform(rows: DataFrame, name: str) -> DataFrame:
    """rows with the table's columns in order and type; missing ones are null, unknown ones go."""
    known = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{known[f.name.lower()]}`") if f.name.lower() in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])


def begin(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables of a new system: empty, but for the first tenant and its administrator."""
    empty = {name: spark.createDataFrame([], schema(name)) for name in TABLES}
    tenant = spark.createDataFrame([FIRST_TENANT], "tenant_id string, name string, status string, quota int")
    user = spark.createDataFrame([FIRST_USER], "user_id string, tenant_id string, name string, role string")
    return {**empty, "tenants": conform(tenant, "tenants"), "users": conform(user, "users")}


def upload_name(name: Column) -> Column:
    """A file's name without the id that an upload puts before it, and without folders."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\\\]*)$", 1), r"^(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}_", "")


def judge_uploads(uploads: DataFrame, used: DataFrame, most_bytes: int, quota_bytes: int) -> DataFrame:
    """uploads (upload_id, tenant_id, name, size) with file, and verdict: empty, too large, over quota, or stored.

    Uploads of a tenant are taken by id; one that isn't stored takes nothing of the quota that `used` (tenant_id, bytes) leaves.
    A running sum over those that could be stored stands for the quota: the first that doesn't fit ends a tenant's batch.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("tenant_id").orderBy("upload_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sound = F.when(F.col("size") <= 0, "empty").when(F.col("size") > most_bytes, "too large")
    judged = uploads.join(used, "tenant_id", "left").withColumn("_sound", sound)
    taken = F.coalesce("bytes", F.lit(0)) + F.sum(F.when(F.col("_sound").isNull(), F.col("size")).otherwise(0)).over(order)
    verdict = F.coalesce("_sound", F.when(taken > quota_bytes, "over quota").otherwise("stored"))
    return judged.select("upload_id", "tenant_id", upload_name(F.col("name")).alias("file"), "size", verdict.alias("verdict"))
