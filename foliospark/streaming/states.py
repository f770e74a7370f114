"""Task states, sessions and event windows, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str, at: str, id: str, columns: list[str]) -> DataFrame:
    """The last row of each key by time and id (ST-02, ST-04); one aggregate, merged map-side."""
    last = F.max_by(F.struct(*columns), F.struct(at, id)).alias("last")
    return events.groupBy(key).agg(last, F.max(at).alias("updated_at"), F.count("*").alias("n")).select(key, "last.*", "updated_at", "n")


def recovered(states: DataFrame, status: str, running: tuple[str, ...] = ("pending", "processing")) -> DataFrame:
    """Tasks that a restart has interrupted become failed (ST-02)."""
    return states.withColumn(status, F.when(F.col(status).isin(*running), "failed").otherwise(F.col(status)))


def alive(states: DataFrame, updated: str, now: Column, hours: int) -> DataFrame:
    """Tasks that aren't past their time to live (ST-02, F-67)."""
    return states.where(F.col(updated) >= now - F.expr(f"interval {hours} hours"))


def active_sessions(issued: DataFrame, revoked: DataFrame, key: str, now: Column) -> DataFrame:
    """Session keys that are neither revoked nor expired (ST-05, G-03, P-14)."""
    return issued.join(revoked.select(key), key, "left_anti").where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def tumbling(events: DataFrame, at: str, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums by window and keys; a watermark where events are a stream (ST-06)."""
    if late:
        events = events.withWatermark(at, late)
    grouped = events.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Runs of a key's events with no gap as long as `gap` (ST-06)."""
    if late:
        events = events.withWatermark(at, late)
    grouped = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return grouped.select(key, F.col("w.start").alias("start"), "last", "n")


def first_seen(files: DataFrame, hash_: str, at: str, late: str) -> DataFrame:
    """A stream's files without those whose content came before, within the watermark (ST-03)."""
    return files.withWatermark(at, late).dropDuplicatesWithinWatermark([hash_])
