"""Sliding-window admission: a request passes if fewer than `limit` passed in the window before it; refused ones don't count.

The decision for a key is sequential.  In batch, keys are sorted within partitions and read through once with a state
of at most `limit` times, so a hot key costs time but no memory; as a stream the same state is kept by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests a minute by kind of key.
LIMITS = {"query": 15, "upload": 5, "login_user": 5, "login_ip": 20}
OUTPUT = "key string, ts timestamp, id long, admitted boolean"


def admit(times: list[float], now: float, limit: int, window: float) -> tuple[list[float], bool]:
    """The times that still count, with now if it is admitted."""
    times = [t for t in times if now - t < window]
    if len(times) >= limit:
        return times, False
    return [*times, now], True


def batch(requests: DataFrame, limit: int, window: float = 60.0, partitions: int | None = None) -> DataFrame:
    """OUTPUT for requests (key, ts, id) in the order of ts and id (ST-01)."""
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, []
        for part in parts:
            out = []
            for own, now in zip(part["key"], part["ts"].astype("int64") / (1e9 if str(part["ts"].dtype).startswith("datetime64[ns") else 1e6), strict=True):
                if own != key:
                    key, times = own, []
                times, ok = admit(times, now, limit, window)
                out.append(ok)
            yield part.assign(admitted=out)

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "ts", "id").mapInPandas(run, OUTPUT)


def stream(requests: DataFrame, limit: int, window: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """The same for a streaming DataFrame; within a micro-batch requests of a key are taken by ts and id.

    A key's times are dropped once the watermark, `delay` behind the latest request, is a window past the last of them.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        out = []
        for now in rows["ts"].map(lambda t: t.timestamp()):
            times, ok = admit(times, now, limit, window)
            out.append(ok)
        state.update((times,))
        last = rows["ts"].max().timestamp()
        state.setTimeoutTimestamp(max(int(1000 * (last + window)), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "id": rows["id"], "admitted": out})

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"))
    return rows.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(run, OUTPUT, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
