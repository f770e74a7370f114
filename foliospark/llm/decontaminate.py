"""Benchmark decontamination over a distributed positional inverted index.

The training side is indexed once, whatever will be looked for: mapInArrow cuts documents into shards of about 1 MB and
stores, for each shard, its terms and the positions of each.  Shards are rows of a table in the shared folder, so the
index is split by document: a shard answers for its documents alone and no posting list ever meets another task.  A
search intersects offset-adjusted lists, beginning with the rarest term of each test phrase in the shard at hand.

Null, empty and wordless texts have no words and are never hit; an item without words has no window.  Repeated
documents each get their own row and repeated items count once.  Extra columns of either table are ignored.  Items
without an id are searched like others and are together one item, null in item_ids; ids that aren't whole numbers are
listed as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Fingerprints, chunks, flat, materialize, per_row, table, unused, word_spans

#: Positions left free between two documents of a shard, so that no phrase or neighbourhood spans them.
GAP = 1 << 12
#: Test texts are searched in blocks of about this many bytes, so what is broadcast stays bounded.
BLOCK_BYTES = 16 << 20
INDEX = "shard string, doc_ids binary, no_id binary, n_words binary, first binary, terms binary, ends binary, positions binary"
#: shard and place tell an index's documents apart.
RESULT = "shard string, place int, doc_id long, n_words long, n_hit long, item_ids array<{}>, spans array<struct<start:long,end:long>>"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all words of a text column, and n + 1 bounds of the rows in them."""
    data, offs = flat(column)
    found, bounds = [], [np.zeros(1, np.int64)]
    for a, b in chunks(offs):
        part, local = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        start, end = word_spans(part, local, "alnum")
        found.append(Fingerprints(part, fold=True).of(start, end))
        bounds.append(per_row(local, start)[1:] + bounds[-1][-1])
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate(bounds)


def id_type(items: DataFrame) -> str:
    """How item ids are listed: 'long', or 'string' unless their type is of whole numbers."""
    return "long" if items.schema["item_id"].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | str | None, str]]]:
    """Test items in bounded blocks, read through an iterator: the driver holds one partition of short texts at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast(id_type(items)), F.col("text")).where("text is not null").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


class Phrases:
    """The distinct windows of a block of items as rows of term numbers, by window length; owners are places in ids."""

    def __init__(self, block: list[tuple[int | str | None, str]], n: int, kind: str = "long"):
        self.kind = kind
        self.ids = list(dict.fromkeys(item for item, _ in block))
        number = {item: k for k, item in enumerate(self.ids)}
        values, bounds = words_of(pa.array([text for _, text in block], pa.large_string()))
        self.vocabulary = np.unique(values)
        terms = np.searchsorted(self.vocabulary, values).astype(np.int32)
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        by_length: dict[int, tuple[list, list]] = {}
        for (item, _), a, b in zip(block, bounds[:-1], bounds[1:], strict=True):
            if b > a:
                width = min(n, int(b - a))
                rows, owners = by_length.setdefault(width, ([], []))
                windows = np.lib.stride_tricks.sliding_window_view(terms[a:b], width)
                rows.append(windows)
                owners.append(np.full(len(windows), number[item], np.int64))
        for rows, owners in by_length.values():
            self.groups.append((np.concatenate(rows), np.concatenate(owners)))


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each shard: document ids, word counts, first positions, and all terms' postings in CSR form."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, no_id = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            _, offs = flat(texts)
            for a, b in chunks(offs):
                values, bounds = words_of(texts.slice(a, b - a))
                counts = np.diff(bounds)
                first = bounds[:-1] + GAP * np.arange(b - a)
                at = np.arange(len(values)) + GAP * np.repeat(np.arange(b - a), counts)
                order = np.argsort(values, kind="stable")
                terms, sizes = np.unique(values, return_counts=True)
                row = [ids[a:b].astype(np.int64), no_id[a:b], counts.astype(np.int64), first.astype(np.int64), terms, np.cumsum(sizes), at[order].astype(np.int32 if first[-1] + counts[-1] < 1 << 31 else np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{made}"]), *[pa.array([x.tobytes()], pa.binary()) for x in row]], names=[x.split()[0] for x in INDEX.split(", ")])
                made += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(shards, INDEX)


class Shard:
    """The postings that an index row has of a sorted vocabulary, with lookups by (number of the term, position)."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        of = lambda name, kind: np.frombuffer(row[name], kind)
        self.name, self.doc_ids, self.n_words, self.first = row["shard"], of("doc_ids", np.int64), of("n_words", np.int64), of("first", np.int64)
        self.no_id = of("no_id", bool)
        own, ends = of("terms", U64), of("ends", np.int64)
        at = np.minimum(np.searchsorted(vocabulary, own), max(len(vocabulary) - 1, 0))
        asked = np.flatnonzero(vocabulary[at] == own) if len(vocabulary) else np.zeros(0, np.int64)
        terms, sizes = at[asked], np.diff(ends, prepend=0)[asked]
        total = int(ends[-1]) if len(ends) else 0
        positions = of("positions", np.int32 if len(row["positions"]) == 4 * total else np.int64)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.positions = positions[np.repeat(ends[asked] - sizes, sizes) + within].astype(np.int64)
        self.end, self.count = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        self.end[terms], self.count[terms] = np.cumsum(sizes), sizes
        self.keys = (np.repeat(terms.astype(np.int64), sizes) << 40) | self.positions

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term.astype(np.int64) << 40) | position
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        return (self.keys[found] == key) & (position >= 0)

    def listed(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of the terms: the index of each one's term, and its position."""
        n = self.count[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return owner, self.positions[(self.end[terms] - n)[owner] + within]

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches: (window, start) pairs, from the rarest term's list, cut by one offset-adjusted list after the other."""
        counts = self.count[windows]
        alive = np.flatnonzero(counts.min(axis=1) > 0)
        if not len(alive):
            return alive, alive
        order = np.argsort(counts[alive], axis=1, kind="stable")
        rarest = order[:, 0]
        owner, position = self.listed(windows[alive, rarest])
        start = position - rarest[owner]
        for step in range(1, windows.shape[1]):
            column = order[owner, step]
            keep = self.has(windows[alive[owner], column], start + column)
            owner, start = owner[keep], start[keep]
        return alive[owner], start


def _covered(shard: Shard, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    order = np.lexsort((end, start))
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.concatenate([new[1:] - 1, [len(end) - 1]])]


def find_phrases(index: DataFrame, phrases: Phrases) -> DataFrame:
    """RESULT for every indexed document: its words, those inside an occurrence of a window, the items found and the hit runs (word offsets)."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, wanted.vocabulary)
                starts, ends, owners = [], [], []
                for windows, items in wanted.groups:
                    window, start = shard.phrases(windows)
                    starts.append(start)
                    ends.append(start + windows.shape[1])
                    owners.append(items[window])
                n = len(shard.doc_ids)
                hit, found, runs = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
                start, end, owner = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends, owners))
                if len(start):
                    doc = np.searchsorted(shard.first, start, side="right") - 1
                    for d, item in np.unique(np.stack([doc, owner]), axis=1).T.tolist():
                        found[d].append(wanted.ids[item])
                    start, end = _covered(shard, start, end)
                    doc = np.searchsorted(shard.first, start, side="right") - 1
                    np.add.at(hit, doc, end - start)
                    for d, a, b in zip(doc.tolist(), (start - shard.first[doc]).tolist(), (end - shard.first[doc]).tolist(), strict=True):
                        runs[d].append({"start": a, "end": b})
                spans = pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                items = pa.array(found, pa.list_(pa.int64() if wanted.kind == "long" else pa.string()))
                place = pa.array(np.arange(n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([shard.name] * n, pa.string()), place, pa.array(shard.doc_ids, mask=shard.no_id), pa.array(shard.n_words), pa.array(hit), items, spans], names=["shard", "place", "doc_id", "n_words", "n_hit", "item_ids", "spans"])

    return index.mapInArrow(search, RESULT.format(phrases.kind))


def find_near(index: DataFrame, pairs: list[tuple[str, str]], distance: int) -> DataFrame:
    """Proximity matches: (doc_id, pair, first, second) for occurrences of two words at most distance words apart, either order.

    The rarer word's list leads; the other one is looked up around each posting.  distance stays below GAP.
    """
    if not 0 < distance < GAP:
        raise ValueError(f"distance is 1 to {GAP - 1}")
    values, _ = words_of(pa.array([x for pair in pairs for x in pair], pa.large_string()))
    if len(values) != 2 * len(pairs):
        raise ValueError("each side of a pair is one word")
    vocabulary = np.unique(values)
    shared = index.sparkSession.sparkContext.broadcast((np.searchsorted(vocabulary, values).reshape(-1, 2), vocabulary))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, vocabulary = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, vocabulary)
                out = []
                for k, (a, b) in enumerate(terms):
                    lead, other = (a, b) if shard.count[a] <= shard.count[b] else (b, a)
                    _, at = shard.listed(np.array([lead]))
                    for gap in [*range(-distance, 0), *range(1, distance + 1)]:
                        near = at[shard.has(np.full(len(at), other), at + gap)]
                        first, second = (near, near + gap) if lead == a else (near + gap, near)
                        doc = np.searchsorted(shard.first, near, side="right") - 1
                        out.append((shard.doc_ids[doc], np.full(len(near), k), first - shard.first[doc], second - shard.first[doc], shard.no_id[doc]))
                if out:
                    doc_id, pair, first, second, no_id = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=no_id), *[pa.array(x.astype(np.int64)) for x in (pair, first, second)]], names=["doc_id", "pair", "first", "second"])

    return index.mapInArrow(search, "doc_id long, pair long, first long, second long")


def contamination(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans) for every document, against all items.

    Items beyond one block are searched block by block in the same index, and a document's parts are joined by its place
    there, so repeated and null ids stay apart.
    """
    kind = id_type(items)
    index, found, several = materialize(build_index(docs), "index"), None, False
    for block in item_blocks(items):
        part = find_phrases(index, Phrases(block, n, kind))
        found, several = (part, False) if found is None else (found.unionByName(part), True)
    if found is None:
        found = find_phrases(index, Phrases([], n, kind))
    return (_merged(found) if several else found).select("doc_id", "n_words", "n_hit", "item_ids", "spans")


def _merged(parts: DataFrame) -> DataFrame:
    """The results of several blocks as one row for each document: runs are united word by word."""
    grouped = parts.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    joined = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    united = grouped.withColumn("spans", joined)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return united.select("doc_id", "n_words", hit.alias("n_hit"), "item_ids", "spans")


def clean(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of docs that no window of any item occurs in.

    Only rows that are hit are told apart: by id and a hash of the text, so that rows sharing an id are judged by their
    own text.
    """
    (name,) = unused(docs, "key")
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    found = materialize(contamination(docs.select(key.alias("doc_id"), "text"), items, n).where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct(), "hit")
    return docs.withColumn(name, key).join(found, name, "left_anti").drop(name)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w, row_number() over () as rid from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
iwin as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from iw where len(w) > 0)),
lens as (select distinct n from iwin),
dwin as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)),
hits as (select d.rid, d.i, d.n, q.item_id from dwin d join iwin q on d.n = q.n and d.g = q.g),
words as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hits) group by rid),
items as (
  select rid, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct rid, item_id::varchar as name from hits) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (rid) left join items using (rid)
"""
