"""Arrow batches that Python holds: bounded as Spark sends them, and read in slices of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch for Python, unless the session was given values; Spark's defaults are 10000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that are Python strings at once.
SLICE_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS and BATCH_BYTES unless the session was given values."""
    for key, default, value in ((ROWS, "10000", BATCH_ROWS), (BYTES, "67108864b", BATCH_BYTES)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, str(value))


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in slices: after its first row, a slice has at most SLICE_BYTES of the text in a column."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.cumsum(size + 1) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
