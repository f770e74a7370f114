"""Exact repeated substrings by bucket-pointer refinement over sampled suffixes.

A byte goes if it lies in a string of `window` bytes that starts anywhere else too.  Sorting every suffix would move a
row for each byte, so suffixes are sampled: each window chooses the q-gram of least hash in it (its anchor), and equal
windows choose alike, so windows are compared by their anchors' buckets alone.

Refinement: an anchor's windows are known by how far they start before it.  A row holds a run of them and two bucket
numbers: that of the bytes which all windows of its part share, and that of all bytes of the run.  Rows are sorted by
these.  Alone in the first bucket: no window repeats.  Together in the second: all do.  Else the row's part is cut and
its pieces are sorted by the buckets of their own, longer offsets: 192 windows, then 24, then one.  A bucket that is
settled passes one row on for all, if unsettled ones may still meet it.  Each task settles its own equal rows first, so
a group of copies sends a row for each task.  Bucket numbers are fingerprints of content, of 62 bits and with a seed of
their own for each of the two: equal bytes have equal numbers everywhere, and no number needs to be looked up.

Null text is empty.  Texts shorter than the window stay.  Repeated rows remove each other.  Extra columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchors
from .common import CHUNK_BYTES, U64, Fingerprints, chunks, flat, materialize, mix, table

Q = 17
#: Windows are hashed in chunks of about this many bytes: a worker holds some 15 arrays of 8 bytes for each, in cache.
SPAN_BYTES = 1 << 18
REF = "uid long, pos long, part int, lo int, hi int"
ROWS = f"{REF}, ikey long, ukey long, n int"
STATES = f"{REF}, state int"
COVERED, OPEN, SPOKESMAN = 1, 2, 3


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(schema: str, *arrays: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": np.int64, "int": np.int32}
    typed = [a if isinstance(a, pa.Array) else pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(kinds[c.split()[1]])) for a, c in zip(arrays, schema.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(typed, names=_names(schema))


def _pieces(lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs lo..hi of distances, the parts of a width that they touch: (owner, first distance of the part)."""
    first, count = lo // width, hi // width - lo // width + 1
    owner = np.repeat(np.arange(len(lo)), count)
    return owner, (first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * width


def _rows(prints: tuple[Fingerprints, ...], at: np.ndarray, uid: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int, width: int) -> pa.RecordBatch:
    """ROWS of the anchors at these places of a chunk, cut to parts of a width; equal rows of the chunk are settled (n = 0) but for one (n = 2)."""
    owner, part = _pieces(lo, hi, width)
    a = at[owner]
    low, high = np.maximum(lo[owner], part), np.minimum(hi[owner], part + width - 1)
    shared, whole = prints[0], prints[-1]
    ikey = mix(shared.of(a - part, a - part - width + 1 + window) + U64(width) * U64(1 << 20) + part.astype(U64))
    ukey = mix(whole.of(a - high, a - low + window) + (low * 1024 + high).astype(U64))
    order = np.lexsort((ukey, ikey))
    same = np.zeros(len(order), bool)
    same[1:] = (ikey[order][1:] == ikey[order][:-1]) & (ukey[order][1:] == ukey[order][:-1])
    n = np.ones(len(order), np.int32)
    n[1:][same[1:]] = 0
    n[:-1][same[1:] & ~same[:-1]] = 2
    o = owner[order]
    return _batch(ROWS, uid[o], pos[o], part[order], low[order], high[order], ikey[order], ukey[order], n)


def first_rows(texts: DataFrame, window: int) -> DataFrame:
    """ROWS of all anchors of (uid, text), in parts of 192 windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            data, offs = flat(batch.column(1))
            for i, j in chunks(offs, SPAN_BYTES):
                part, local = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                if len(part) < window:
                    continue
                prints = Fingerprints(part)
                at, first, last, row = anchors(part, local, window, Q, prints)
                if len(at):
                    yield _rows((prints, Fingerprints(part, seed=2)), at, uid[i:j][row], at - local[row], at - last, at - first, window, 192)

    return texts.mapInArrow(run, ROWS)


#: A task that sorts a bucket of more rows than this hands them on in parts.
HELD_ROWS = 1 << 18


def settle(rows: DataFrame) -> DataFrame:
    """STATES of the rows: COVERED, OPEN, and SPOKESMAN, a covered row once more that goes on for its equals; rows alone are dropped.

    Rows are dealt by ranges of both bucket numbers, so a bucket of any size is split between tasks, and only rows that
    are equal in both, which each task has made one, stay together.  Where a first bucket may go on in another task, or
    is handed on in parts, its rows count as not alone and as awaited: at worst a row is looked at once more.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def judged(columns: list[np.ndarray], edges: set[int]) -> pa.RecordBatch:
        uid, pos, part, lo, hi, ikey, ukey, count = columns
        i_new = np.concatenate([[True], ikey[1:] != ikey[:-1]])
        u_new = i_new | np.concatenate([[True], ukey[1:] != ukey[:-1]])
        i_at, u_at = np.flatnonzero(i_new), np.flatnonzero(u_new)
        i_of, u_of = np.cumsum(i_new) - 1, np.cumsum(u_new) - 1
        edge = np.isin(ikey, list(edges))
        covered = (np.add.reduceat(count, u_at) >= 2)[u_of]
        open_ = ((np.add.reduceat(count, i_at) >= 2)[i_of] | edge) & ~covered
        awaited = np.logical_or.reduceat(open_, i_at)[i_of] | edge
        spoken = covered & awaited & u_new
        picks = [np.flatnonzero(x) for x in (covered, open_, spoken)]
        take = np.concatenate(picks)
        state = np.repeat([COVERED, OPEN, SPOKESMAN], [len(x) for x in picks])
        return _batch(STATES, *[x[take] for x in (uid, pos, part, lo, hi)], state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, edges = 0, set()
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            if not edges:
                edges.add(int(columns[5][0]))
            held.append(columns)
            size += len(columns[0])
            if size < HELD_ROWS:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[5], whole[5][-1]))
            if not cut:  # one bucket: all but the last run of equals goes on now
                edges.add(int(whole[5][-1]))
                cut = int(np.searchsorted(whole[6], whole[6][-1]))
            if cut:
                yield judged([x[:cut] for x in whole], edges)
            elif size > 8 * HELD_ROWS:  # one run of equals, all covered: one row stands for those to come
                yield judged(whole, edges)
                whole[7][-1] = 2
                cut = size - 1
            held = [[x[cut:] for x in whole]]
            size -= cut
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield judged(whole, edges | {int(whole[5][-1])})

    met = rows.where("n > 0").repartitionByRange(n, "ikey", "ukey").sortWithinPartitions("ikey", "ukey").mapInArrow(run, STATES)
    return met.unionByName(rows.where("n = 0").select(*_names(REF), F.lit(COVERED).alias("state")))


def _packed(texts: DataFrame) -> DataFrame:
    """(uid, packed): texts compressed, for the joins that move them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, offs = flat(batch.column(1))
            packed = [squeeze(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["uid", "packed"])

    return texts.mapInArrow(run, "uid long, packed binary")


def contexts(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(uid, pos, part, lo, hi, context): the bytes that the windows lo..hi of each wanted row span."""
    asked = wanted.groupBy("uid").agg(F.collect_set(F.struct("pos", "part", "lo", "hi")).alias("refs"))
    asked = materialize(asked, "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            size = 0
            for uid, packed, refs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = open_up(packed.as_py())
                for r in refs:
                    context = text[r["pos"] - r["hi"] : r["pos"] - r["lo"] + window]
                    for column, value in zip(out, (uid, r["pos"], r["part"], r["lo"], r["hi"], context), strict=True):
                        column.append(value)
                    size += len(context)
                if size > CHUNK_BYTES:
                    yield made(out)
                    out, size = [[] for _ in range(6)], 0
            yield made(out)

    def made(out):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[*_names(REF), "context"])

    found = _packed(texts).join(asked, "uid").select("uid", "packed", "refs").mapInArrow(run, f"{REF}, context binary")
    return found.dropDuplicates(["uid", "pos", "part", "lo", "hi"])


def finer_rows(parts: DataFrame, window: int, width: int) -> DataFrame:
    """ROWS of (uid, pos, part, lo, hi, from, to, context): the windows from..to of contexts that span lo..hi, in narrower parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, pos, hi, low, high = (batch.column(k).to_numpy() for k in range(5))
            data, offs = flat(batch.column(5))
            for i, j in chunks(offs, SPAN_BYTES):
                part, local = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                prints = (Fingerprints(part), Fingerprints(part, seed=2))
                yield _rows(prints, local[:-1] + hi[i:j], uid[i:j], pos[i:j], low[i:j].astype(np.int64), high[i:j].astype(np.int64), window, width)

    return parts.select("uid", "pos", "hi", F.col("low"), F.col("high"), "context").mapInArrow(run, ROWS)


def covered_runs(texts: DataFrame, window: int = 400) -> DataFrame:
    """(uid, runs): for each text with repeated windows, the runs of bytes [start, end) that they cover, unmerged; texts: (uid, text)."""
    if not 192 + Q <= window < 1024:
        raise ValueError("windows are of 209 to 1023 bytes")
    rows = materialize(first_rows(texts, window), "rows")
    states = materialize(settle(rows), "states", (rows,))
    wanted = states.where(F.col("state") >= OPEN)
    spans = materialize(contexts(texts, wanted, window), "contexts")
    finer = materialize(finer_rows(spans.withColumns({"low": F.col("lo"), "high": F.col("hi")}), window, 24), "rows-24")
    first = materialize(settle(finer), "states-24", (finer,))
    again = first.where(F.col("state") >= OPEN).select("uid", "pos", (F.floor(F.col("part") / 192) * 192).cast("int").alias("part"), F.col("lo").alias("low"), F.col("hi").alias("high")).distinct()
    single = materialize(finer_rows(spans.join(again, ["uid", "pos", "part"]), window, 1), "rows-1", (spans,))
    covered = states.unionByName(first).unionByName(settle(single)).where(F.col("state") == COVERED)
    run = F.struct((F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + window).alias("end"))
    runs = covered.select("uid", run.alias("run")).groupBy("uid").agg(F.collect_set("run").alias("runs"))
    return materialize(runs, "runs", (states, first, single))


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    """Sorted maximal runs; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    bounds = [0, *[x for span in spans for x in span], len(text)]
    return b"".join(memoryview(text)[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def cut_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """docs with text (what remains, without the rests of characters cut in part), n_bytes, spans (the maximal removed byte runs) and kept_sha256 (of the remaining bytes), in place of columns of these names.

    Copies of a text share their runs; where there are very many, Spark deals that key of the join out anew (AQE).
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "n_bytes", "spans", "kept_sha256")]
    marked = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("bytes")).withColumn("uid", F.xxhash64("bytes"))
    runs = covered_runs(marked.select("uid", F.col("bytes").alias("text")), window)
    schema = f"row {marked.schema['row'].dataType.simpleString()}, text string, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = flat(batch.column(1))
            for i, j in chunks(offs):
                rest, sizes, spans, digests = [], np.diff(offs[i : j + 1]), [], []
                for text, found in zip(batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i).to_pylist(), strict=True):
                    raw = text.as_buffer()
                    at = merged(found or [])
                    left = kept(raw, at) if at else raw
                    rest.append(left.decode("utf-8", "ignore") if at else text.as_py())
                    spans.append([{"start": a, "end": b} for a, b in at])
                    digests.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rest, pa.string()), pa.array(sizes), pa.array(spans, span_type), pa.array(digests)], names=["row", "text", "n_bytes", "spans", "kept_sha256"])

    found = marked.join(runs, "uid", "left").select("row", "bytes", "runs").mapInArrow(run, schema)
    return found.select("row.*", "text", "n_bytes", "spans", "kept_sha256")


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "text")
