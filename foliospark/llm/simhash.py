"""Near-duplicate documents by SimHash and pivot distance tables.

Fingerprints: words are lower-cased (A-Z), cut at white space and joined three at a time; a bit is set if more than half
of the shingles' XXH64 values have it.  Only distinct fingerprints are compared, so a group of copies is one entry.

Links: two fingerprints that differ in at most d bits agree in two of d + 2 segments at least, so each fingerprint is
sent to the cell of every pair of its segments.  Within a cell, the pivot table holds each fingerprint's Hamming
distances to fixed reference fingerprints; by the triangle inequality a pair whose largest coordinate difference exceeds
d is discarded, and the survivors are verified by their own distance.  A cell passes on a spanning forest, never its
pairs.  Fingerprints of crowded cells are no task's to hold: each goes to its 64 one-bit variants and itself, where those
within two bits of each other meet, at most 65 at a variant; that links the same pairs in linear time.

Components: rounds of contraction towards the neighbour of least random priority, each round's tables written to the
shared folder.

Null, empty and wordless texts have fingerprint zero and are linked like any other.  Repeated rows share a component.
An empty table gives an empty result; extra columns are ignored.  A null doc_id takes part but is never a component id.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, flat, materialize, mix, table, unused

PIVOTS = mix(np.arange(1, 17, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Fingerprints of cells with more than this are linked by one-bit variants.
DENSE = 192
PIECE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def bit_counts(text: bytes, width: int) -> tuple[np.ndarray, int]:
    """How many shingles have each bit, and how many there are; long texts are taken piece by piece, cut at white space."""
    counts, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest
    first = True
    while at < len(text) or first:
        to = min(at + PIECE, len(text))
        if to < len(text):
            cut = _SPACE.search(text, to)
            to = cut.start() if cut else len(text)
        words = carry + text[at:to].lower().split()
        last = to == len(text)
        at, joined = to, b" ".join(words)
        first = False
        if len(words) < width:
            if last and not n and words:
                hashes = [digest(joined, 42)]
            elif last:
                break
            else:
                carry = words
                continue
        else:
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[: len(words) - width]]
            hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)]
        carry = words[len(words) - width + 1 :] if width > 1 else []
        values = np.array(hashes, U64)
        for k in range(0, len(values), 1 << 14):
            counts += np.unpackbits(values[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(values)
        if last:
            break
    return counts, n


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(1))
            values = np.zeros(len(offs) - 1, U64)
            for k in range(len(values)):
                counts, n = bit_counts(data[offs[k] : offs[k + 1]].tobytes(), width)
                values[k] = np.packbits(2 * counts > n, bitorder="little").view(U64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """The first bit and the width of distance + 2 segments of the 64 bits."""
    bounds = [64 * k // (distance + 2) for k in range(distance + 3)]
    return [(a, b - a) for a, b in itertools.pairwise(bounds)]


def cells(distinct: DataFrame, distance: int) -> DataFrame:
    """(cell, fp): each fingerprint in the cell of every pair of segments; other columns go with it."""
    part = lambda a, w: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    pairs = list(itertools.combinations(segments(distance), 2))
    keys = [F.xxhash64(F.lit(k), part(*x), part(*y)) for k, (x, y) in enumerate(pairs)]
    return distinct.select(F.explode(F.array(*keys)).alias("cell"), *distinct.columns)


def _linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least index that it reaches over the edges."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
        if len(a):
            a, b = root[a], root[b]
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def _close(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (indices) of fingerprints of a cell within the distance, by the pivot table; they come sorted by cell."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    found = [(np.zeros(0, np.int64),) * 2]
    at = np.arange(n)
    step = 1
    while len(at):
        at = at[at + step < n]
        at = at[cell[at] == cell[at + step]]
        near = at
        for p in range(len(PIVOTS)):
            near = near[np.abs(table[near, p] - table[near + step, p]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        found.append((near, near + step))
        step += 1
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def _search(cell: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """The root (an index) of each of the fingerprints, which come sorted by cell."""
    return _linked(len(fp), *_close(cell, fp, distance))


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): edges that join all fingerprints within distance of each other.

    Crowded cells are marked and linked by variants if distance is 2; for other distances they are searched like any.
    """
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = DENSE if distance == 2 else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, U64)
        crowd = None  # the cell whose members are marked as they come

        def found(cell, fp):
            bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            many = np.repeat((np.diff(bounds) > most) | (cell[bounds[:-1]] == crowd), np.diff(bounds))
            some = ~many
            few = fp[some]
            root = _search(cell[some], few, distance)
            other = root != np.arange(len(root))
            a, b = np.concatenate([few[other], fp[many]]), np.concatenate([few[root[other]], fp[many]])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(U64)])
            done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if len(cell) - done > most:
                crowd, before, done = int(cell[-1]), crowd, len(cell)
                if before is not None and before != crowd and cell[0] == before:
                    cut = int(np.searchsorted(cell, before, side="right"))
                    yield pa.RecordBatch.from_arrays([pa.array(fp[:cut].view(np.int64))] * 2, names=["a", "b"])
                    cell, fp, done = cell[cut:], fp[cut:], done - cut
            if done:
                yield found(cell[:done], fp[:done])
                cell, fp = cell[done:], fp[done:]
        if len(cell):
            yield found(cell, fp)

    made = cells(distinct, distance).repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a long, b long")
    made = materialize(made, "cells")
    edges = made.where("a <> b")
    if distance == 2:
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
        spread = made.where("a = b").select("a").distinct().select("a", F.explode(F.array_append(flips, F.col("a"))).alias("variant"))
        chained = spread.select("a", F.lag("a").over(Window.partitionBy("variant").orderBy("a")).alias("b"))
        edges = edges.unionByName(chained.where("b is not null"))
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root names the component.

    In each round every node moves to the neighbour, or itself, of least priority under that round's hash, and edges
    are carried over; the graph shrinks by a constant factor.  Afterwards the rounds' moves are composed.
    """
    edges = materialize(edges.where("a <> b").select("a", "b"), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c, k=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("p"), F.col(c).alias("v"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        move = materialize(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u"))["v"].alias("m")), "moves")
        moves.append(move)
        once = edges.join(move.select(F.col("u").alias("a"), F.col("m").alias("ma")), "a")
        twice = once.join(move.select(F.col("u").alias("b"), F.col("m").alias("mb")), "b")
        edges = materialize(twice.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for move in moves[1:]:
        out = out.join(move.select(F.col("u").alias("root"), "m"), "root", "left").select("node", F.coalesce("m", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the least doc_id that links reach."""
    marked = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    ids = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = materialize(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; of fewer words, their whole sequence is one; none of no words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: max(len(words) - width, 0)]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[min(width, len(words)) - 1 :], strict=True)], U64))


#: Bands of least hashes, and how many a band takes: a pair of similarity 0.8 shares a band in 9998 of 10000 cases.
BANDS, ROWS_A_BAND = 16, 4
#: Buckets of at most this many texts are compared whole; the members of larger ones also go through crowded().
WHOLE = 16
#: With how many texts of its middle each member of a larger bucket is compared.
CORE = 2
#: Fingerprints that differ in this many bits at most meet by cells and pivot tables; the bands are for the rest.
DISTANCE = 2


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(uid, fp, bands) of (uid, text): the SimHash of all shingles, and hashes of bands of least values."""
    factors = mix(np.arange(101, 101 + BANDS * ROWS_A_BAND, dtype=U64)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(1))
            fps, bands = np.zeros(len(offs) - 1, U64), []
            for k in range(len(fps)):
                values = shingle_hashes(data[offs[k] : offs[k + 1]].tobytes(), width)
                counts = np.zeros(64, np.int64)
                least = np.full(len(factors), np.iinfo(np.uint64).max, U64)
                for at in range(0, len(values), 1 << 11):
                    part = values[at : at + (1 << 11)]
                    counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    least = np.minimum(least, (part[:, None] * factors[None, :]).min(axis=0))
                fps[k] = np.packbits(2 * counts > len(values), bitorder="little").view(U64)[0]
                mixed = np.arange(1, BANDS + 1, dtype=U64)
                for row in least.reshape(ROWS_A_BAND, BANDS):
                    mixed = mix(mixed ^ row)
                bands.append(mixed.view(np.int64) if len(values) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["uid", "fp", "bands"])

    return texts.mapInArrow(run, "uid long, fp long, bands array<long>")


#: A task that reads a bucket of more texts than this takes it in parts; the middle of each part goes on to the next.
HELD_TEXTS = 1 << 19


def _core(fp: np.ndarray) -> np.ndarray:
    """The members nearest to the majority fingerprint, which is about that of the text the others were made from."""
    middle = np.packbits(2 * np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) > len(fp), bitorder="little").view(U64)[0]
    return np.argsort(np.bitwise_count(fp ^ middle), kind="stable")[:CORE]


def _proposed(fp: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket: all of them, or of a large one each member with the core and, as a mark, with itself."""
    n = len(fp)
    if not large:
        return np.triu_indices(n, 1)
    every, core = np.arange(n), _core(fp)
    return np.concatenate([every, np.tile(every, len(core))]), np.concatenate([every, np.repeat(core, n)])


def _in_parts(rows: DataFrame, pairs: Callable) -> DataFrame:
    """(a, b) of (key, uid, fp): what pairs(key, uid, fp, split) makes of each key's bucket, or of its parts if it is `split`."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def made(held, split):
        a, b = pairs(*[np.concatenate(x) for x in zip(*held, strict=True)], split)
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        split = None  # the bucket that was taken in parts
        for batch in batches:
            key, uid, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(U64)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1][0][-1] != key[0]):
                yield made([*held, (key[:cut], uid[:cut], fp[:cut])], split)
                held = []
            held.append((key[cut:], uid[cut:], fp[cut:]))
            if sum(len(x[0]) for x in held) > HELD_TEXTS:  # one bucket
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                split = whole[0][0]
                yield made([whole], split)
                core = _core(whole[2])
                held = [tuple(x[core] for x in whole)]
        if held:
            yield made(held, split)

    spread = rows.select("key", "uid", "fp").repartition(n, "key").sortWithinPartitions("key", "uid")
    return spread.mapInArrow(run, "a long, b long").distinct()


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def close(sketched: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of uids, a < b, of fingerprints within the distance, by cells and pivot tables as in links().

    Where more than WHOLE texts of a cell hang together, or a cell is crowded, each goes with their middle, and as a = b.
    """

    def pairs(cell, uid, fp, split):
        bounds = _bounds(cell)
        many = np.repeat((np.diff(bounds) > DENSE) | (cell[bounds[:-1]] == split), np.diff(bounds))
        some = np.flatnonzero(~many)
        a, b = _close(cell[some], fp[some], distance)
        root = _linked(len(some), a, b)
        large = np.bincount(root, minlength=len(some))[root] > WHOLE
        out = [(uid[some[a[~large[a]]]], uid[some[b[~large[a]]]])]
        group = np.concatenate([some[large], np.flatnonzero(many)])
        name = np.concatenate([some[root[large]], np.repeat(bounds[:-1], np.diff(bounds))[many]])
        group, name = group[np.argsort(name, kind="stable")], np.sort(name)
        for i, j in itertools.pairwise(_bounds(name)) if len(name) else ():
            a, b = _proposed(fp[group[i:j]], True)
            out.append((uid[group[i:j]][a], uid[group[i:j]][b]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    worded = sketched.where(F.size("bands") > 0).select("uid", "fp")
    return _in_parts(cells(worded, distance).withColumnRenamed("cell", "key"), pairs)


def candidates(sketched: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of uids, a < b, from buckets of equal bands, whose fingerprints differ in more than the distance, which leaves them out
    of close(); and a = b for every member of a bucket that isn't compared whole."""

    def pairs(band, uid, fp, split):
        bounds = _bounds(band)
        out = [(np.zeros(0, np.int64),) * 2]
        for k in np.flatnonzero(np.diff(bounds) > 1):
            i, j = bounds[k], bounds[k + 1]
            a, b = _proposed(fp[i:j], j - i > WHOLE or band[i] == split)
            far = (a == b) | (np.bitwise_count(fp[i:j][a] ^ fp[i:j][b]) > distance)
            out.append((uid[i:j][a[far]], uid[i:j][b[far]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return _in_parts(sketched.select(F.explode("bands").alias("key"), "uid", "fp"), pairs)


#: Shingles are ordered by how often one in SAMPLE texts has them; the FREQUENT most frequent ones travel to the texts.
#: Any order gives the same pairs: it decides only how many are compared.
SAMPLE, FREQUENT = 16, 1 << 18
#: Lists of more texts that share a shingle are compared in blocks of about this many, each pair of blocks by itself.
LIST_BLOCK = 1024
PREFIX = "token long, uid long, root long, size int, place int, early boolean"


def _least(total, share: float):
    """The least whole number that is at least total x share."""
    return np.ceil(total * share - 1e-9).astype(np.int64)


def frequent(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts (uid, shingles) often has, sorted, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _ = flat(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64))], names=["token"])

    some = whole.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0).select("shingles").mapInArrow(run, "token long")
    found = some.groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    token, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefixes(texts: DataFrame, similarity: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """PREFIX for each text's rarest shingles: of two similar texts, the first shingle that they share is among both's.

    It is at an early place of the shorter one: those that leave enough for a text of the same size.
    """
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            out = []
            for uid, root, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(x.as_py(), np.int64)
                n = len(x)
                often = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    often = np.where(known[at] == x, counts[at], 0)
                last = n - int(_least(np.float64(n), similarity))
                place = np.arange(last + 1)
                early = place <= n - int(_least(np.float64(2 * n), similarity / (1 + similarity)))
                out.append((x[np.lexsort((x, often))[: last + 1]], np.full(last + 1, uid), np.full(last + 1, root), np.full(last + 1, n, np.int32), place.astype(np.int32), early))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=[x.split()[0] for x in PREFIX.split(", ")])

    return texts.select("uid", "root", "shingles").mapInArrow(run, PREFIX)


def crowded(texts: DataFrame, similarity: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b), a < b: all pairs of (uid, root, shingles) of different roots that can have the similarity, by a prefix filter.

    Texts meet by the rare shingles of their prefixes; a pair stays if what follows the shared one in both can hold the
    overlap that it needs, which is so for a similar pair's first.  Lists of any size are compared whole: long ones as
    pairs of blocks, each with a key of its own, and lists without an early place not at all.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(prefixes(texts, similarity, order), "prefixes")
    long = rows.groupBy("token").agg(F.count("*").alias("n"), F.max("early").alias("any")).where(F.col("n") > LIST_BLOCK)
    long = long.select("token", F.when(F.col("any"), F.ceil(F.col("n") / LIST_BLOCK)).otherwise(0).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("uid", F.lit(7)), F.col("blocks")).cast("int")
    cells = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, own) as lo, greatest(k, own) as hi))")
    split = rows.join(materialize(long, "long"), "token", "left")
    few = split.where("blocks is null").select(F.col("token").alias("cell"), "uid", "root", "size", "place", "early", F.lit(0).alias("side"))
    many = split.where("blocks > 0").withColumn("own", own).withColumn("c", F.explode(cells)).select(
        F.xxhash64("token", "c.lo", "c.hi").alias("cell"), "uid", "root", "size", "place", "early",
        F.when(F.col("c.lo") == F.col("c.hi"), 0).when(F.col("own") == F.col("c.lo"), 1).otherwise(2).alias("side"),
    )

    def pairs(cell, uid, root, size, place, early, side):
        bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        use = (np.diff(bounds) > 1) & np.logical_or.reduceat(early, bounds[:-1])
        at = np.flatnonzero(np.repeat(use, np.diff(bounds)))
        out, step = [np.zeros((2, 0), np.int64)], 1
        while len(at):
            at = at[at + step < len(cell)]
            at = at[cell[at] == cell[at + step]]
            to = at + step
            ok = (root[at] != root[to]) & (early[at] | early[to]) & ((side[at] == 0) | (side[at] != side[to]))
            a, b = at[ok], to[ok]
            ok = _least(size[a] + size[b].astype(np.float64), similarity / (1 + similarity)) <= np.minimum(size[a] - place[a], size[b] - place[b])
            a, b = uid[a[ok]], uid[b[ok]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            step += 1
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            if not len(got[0]):
                continue
            cut = int(np.searchsorted(got[0], got[0][-1]))
            if cut or (held and held[-1][0][-1] != got[0][0]):
                yield pairs(*[np.concatenate(x) for x in zip(*held, [x[:cut] for x in got], strict=True)])
                held = []
            held.append([x[cut:] for x in got])
        if held:
            yield pairs(*[np.concatenate(x) for x in zip(*held, strict=True)])

    spread = few.unionByName(many).repartition(n, "cell").sortWithinPartitions("cell", "uid")
    return spread.mapInArrow(run, "a long, b long").where("a < b").distinct()


def similar(texts: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): pairs of (uid, text) whose sets of shingles have at least this Jaccard similarity, computed from whole texts.

    Pairs whose SimHashes are close come from cells and pivot tables, those further apart from bands of least hashes. All
    pairs of a band's bucket or a cell's group are looked at, but for those that other edges join anyway.
    """
    sketched = materialize(sketches(texts, width).dropDuplicates(["uid"]), "sketches")
    pairs = materialize(close(sketched).unionByName(candidates(sketched)).distinct(), "candidates")
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "asked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(1))
            made = [(shingle_hashes(data[a:b].tobytes(), width) >> U64(16)).tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["uid", "shingles"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    whole = materialize(texts.join(asked, "uid").dropDuplicates(["uid"]).select("uid", "text").mapInArrow(sets, "uid long, shingles binary"), "shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        met = pairs.join(whole.select(F.col("uid").alias("a"), F.col("shingles").alias("x")), "a").join(whole.select(F.col("uid").alias("b"), F.col("shingles").alias("y")), "b")
        return met.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")

    near = materialize(verify(pairs.where("a < b")), "near")
    marked = pairs.where("a = b").select(F.col("a").alias("uid"))
    if marked.isEmpty():
        return near
    rooted = marked.join(components(near).select(F.col("node").alias("uid"), "root"), "uid", "left").select("uid", F.coalesce("root", "uid").alias("root"))
    left = crowded(whole.join(materialize(rooted, "rooted"), "uid"), similarity, frequent(whole))
    return near.unionByName(verify(materialize(left, "crowded")))


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of texts that are equal or linked by similarity, the row of the least id (null ids last).

    Texts without words are alike only if equal.  Rows that share that id and text stay once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    uid, key = unused(docs, "uid", "key")
    marked = docs.withColumns({uid: F.xxhash64(text), key: F.xxhash64(F.col("doc_id").cast("string"), text)})
    edges = similar(docs.select(F.xxhash64(text).alias("uid"), text.alias("text")), width, similarity)
    roots = components(edges)
    rows = materialize(marked.select(F.col(uid).alias("uid"), F.col(key).alias("key"), F.col("doc_id").alias("id")), "ids")
    least = rows.groupBy("uid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"))
    rooted = least.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").select(F.coalesce("root", "uid").alias("root"), "least")
    chosen = materialize(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias(key)), "chosen")
    kept = marked.join(chosen, key, "left_semi")
    repeated = not rows.groupBy("key").count().where("count > 1").isEmpty()
    if repeated:
        kept = kept.dropDuplicates([key])
    return kept.drop(uid, key)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
