"""The knowledge base's tables as partitioned Parquet: schemas, append, upsert, delete, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import keep_latest

SCHEMAS = {
    "documents": "doc_id string, tenant_id string, filename string, title string, doc_type string, tags array<string>, metadata map<string,string>, status string, file_hash string, category1 string, category2 string, category3 string, pack string, summary string, updated_at timestamp",
    "pages": "doc_id string, tenant_id string, page_id long, page_num int, section_path string, section_title string, section_level int, page_type string, raw_text string",
    "sections": "doc_id string, tenant_id string, section_path string, section_title string, section_level int, start_page int, end_page int, parent_path string, keywords string, summary string, entities string",
    "chunks": "doc_id string, tenant_id string, page_id long, page_num int, chunk_idx int, section_path string, section_title string, chunk_text string, preview string",
    "vectors": "doc_id string, tenant_id string, page_id long, chunk_idx int, embedding array<float>",
    "facts": "doc_id string, tenant_id string, entity string, attribute string, value string, unit string, page_num int, source_text string, verified boolean",
    "query_log": "tenant_id string, user_id string, query string, query_hash string, intent string, elapsed_ms long, results int, created_at timestamp",
    "events": "tenant_id string, service string, event_type string, message string, ts timestamp",
}
KEYS = {"documents": ["doc_id"], "pages": ["doc_id", "page_num"], "sections": ["doc_id", "section_path"], "chunks": ["page_id", "chunk_idx"], "vectors": ["page_id", "chunk_idx"]}


class Store:
    """Tables below a path that all executors share, partitioned by tenant; a version folder for each rewrite."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(n[1:]) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n[:1] == "v" and n[1:].isdigit())

    def read(self, name: str, tenant: str | None = None) -> DataFrame:
        """A table, of one tenant if named: that filter prunes partitions."""
        versions = self._versions(name)
        schema = StructType.fromDDL(SCHEMAS[name])
        if not versions:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v{versions[-1]}")
        return df if tenant is None else df.where(F.col("tenant_id") == tenant)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows added to the current version; page texts are never null (S-19, S-22)."""
        self._shaped(name, rows).write.mode("append").partitionBy("tenant_id").parquet(f"{self.path}/{name}/v{(self._versions(name) or [1])[-1]}")

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])]
        out = rows.select(*columns)
        return out.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))) if name == "pages" else out

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        """A new version, which readers see when it is whole; the old one stays for those who read it."""
        rows.write.partitionBy("tenant_id").parquet(f"{self.path}/{name}/v{(self._versions(name) or [0])[-1] + 1}")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of their keys; columns that they lack become null (S-20)."""
        new = self._shaped(name, rows).withColumn("_new", F.lit(1))
        both = self.read(name).withColumn("_new", F.lit(0)).unionByName(new)
        self._rewrite(name, keep_latest(both, KEYS[name], [F.col("_new")]).drop("_new"))

    def delete_documents(self, gone: DataFrame) -> None:
        """All rows of some documents go, from every table (S-21)."""
        for name in ("vectors", "chunks", "facts", "sections", "pages", "documents"):
            if self._versions(name):
                self._rewrite(name, self.read(name).join(gone.select("doc_id").distinct(), "doc_id", "left_anti"))

    def follow(self, name: str, stream: DataFrame, checkpoint: str):
        """A streaming sink that appends each micro-batch once (S-22)."""

        def write(batch: DataFrame, epoch: int) -> None:
            self._shaped(name, batch).write.mode("overwrite").parquet(f"{self.path}/{name}-stream/epoch={epoch}")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
