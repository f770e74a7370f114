"""Shared storage, materialisation and flat-text kernels of the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..batches import ROWS, bounded_batches

U64 = np.uint64
#: Texts are handled in chunks of about this many bytes, so a worker's arrays stay small.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context.

    Where neither is set, a local session gets a temporary folder; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, frees: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and any executor can read it again.

    The tables of `frees`, which nothing needs once df is written, are deleted then; df's own when the driver's JVM ends.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for old in frees:
        _delete(spark, old)
    hadoop, system = _file_system(spark, path)
    system.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, written: DataFrame) -> None:
    hadoop, system = _file_system(spark, written._written)
    system.delete(hadoop, True)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows, for what is run within; for tables whose rows are large."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=width, count=n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        texts = [b"" if x is None else (x.encode() if isinstance(x, str) else x) for x in column.to_pylist()]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), offs
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES):
    """Runs of whole rows, (first, last + 1), of about size bytes each."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A finishing permutation of 64-bit values, so that every bit depends on every other."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Fingerprints are taken modulo this Mersenne prime, twice.
PRIME = (1 << 31) - 1


def _folded(x: np.ndarray) -> np.ndarray:
    """x below 2^62 modulo PRIME, up to one PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    return (x & U64(PRIME)) + (x >> U64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    return x - U64(PRIME) * (x >= U64(PRIME))


class Fingerprints:
    """Fingerprints of substrings: two polynomials over tabulated bytes modulo the prime 2^31 - 1, finished by mix().

    prefix[i] holds the weighted sum of the first i bytes, and weights have inverses, so the value of any span comes from
    two prefixes.  The tables' values are as good as random, so two different strings are equal in both with a
    probability of 2^-62, whatever they are.  Different seeds give independent values.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1, fold: bool = False):
        self.sums, self.down = [], []
        for half in (2 * seed, 2 * seed + 1):
            bytes_ = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(half * 7919)) % U64(PRIME)
            if fold:
                bytes_[65:91] = bytes_[97:123]
            up, down = self.powers(len(data) + 1, half)
            prefix = np.zeros(len(data) + 1, U64)
            terms = bytes_[data]
            terms *= up[: len(data)]
            np.cumsum(_folded(terms), out=prefix[1:])
            self.sums.append(prefix)
            self.down.append(down)

    @classmethod
    def powers(cls, n: int, half: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of a base and of its inverse."""
        have = cls._powers.get(half)
        if have is None or len(have[0]) < n:
            size = max(n, CHUNK_BYTES + 1024)
            base = int(mix(np.array([half + 1], U64))[0] % U64(PRIME - 2)) + 2
            have = tuple(cls._geometric(x, size).astype(np.uint32) for x in (base, pow(base, -1, PRIME)))
            if size <= CHUNK_BYTES + 1024:
                cls._powers[half] = have
        return have

    @staticmethod
    def _geometric(x: int, size: int) -> np.ndarray:
        out, done = np.ones(size, U64), 1
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = _reduced(_folded(out[:more] * U64(pow(x, done, PRIME))))
            done += more
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        first, second = (_reduced(_folded(_folded(prefix[end] - prefix[start]) * down[start])) for prefix, down in zip(self.sums, self.down, strict=True))
        return mix((first << U64(31) | second) + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def byte_class(kind: str) -> np.ndarray:
    """Which of the 256 bytes belong to a word: 'alnum' is 0-9, A-Z, a-z and all from 0x80 on; 'black' is all but space and 0x09-0x0D."""
    out = np.zeros(256, bool)
    if kind == "alnum":
        for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
            out[lo : hi + 1] = True
    else:
        out[:] = True
        out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def word_spans(data: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of a class's bytes; no run crosses a row's end."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = byte_class(kind)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    for cut in (offs[1:-1],):
        cut = cut[(cut > 0) & (cut < len(data))]
        both = cut[inside[cut] & inside[cut - 1]]
        begins[both] = True
        ends[both] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def per_row(offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the sorted starts fall in each row; as n + 1 bounds into starts."""
    return np.searchsorted(starts, offs, side="left")


def arrow_table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
