"""Language-model scores of texts: unigram counts with add-one, and the context-mixing model of mixing_model.

One pass over the training documents gathers words and grams; each task sums its own before anything is shuffled, and
both tables grow with the corpus.  Grams fill the model's hashed counters, region by region; that table has four slots
for each distinct gram, up to 2^most_bits slots of two bytes, which is what may be broadcast.  Weights are learnt online
over shares of the gram table and averaged by weight, then refined; where a text is scored, a second mixer's weights
move along that text.

Words counted often enough to be among the `frequent` most are broadcast (a bounded table) and looked up where texts
are scored; each text's rarer words, a few hundredths, are joined with the whole table of counts.

A null text is empty: its one token is its end.  A null id is in training.  Repeated rows count and are scored each.
Without training documents the model is untrained and c, N and V are 0.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Fingerprints, chunks, flat, materialize, table, word_spans
from .mixing_model import MOST_BITS, ORDERS, REGION_BITS, Cache, Model, contexts, grams, packed_counts, slots, table_bits, text_costs

#: The key of the end of a text among words.
END_KEY = U64(1)
#: A task's sums are handed on when they reach this many rows.
HELD = 3_000_000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def words(part: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a chunk's words, without the lowest bit, and the row of each."""
    start, end = word_spans(part, local, "black")
    row = np.searchsorted(local, start, side="right") - 1
    return Fingerprints(part, fold=True).of(start, end) | U64(1), row


def gather(docs: DataFrame) -> DataFrame:
    """(key, n) over docs (text): odd keys are words or the end, even ones grams shifted by one; summed."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        key, n = key[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return [(key[new], np.add.reduceat(n, new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def made():
            for key, n in summed(held):
                for at in range(0, len(key), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 18)].view(np.int64)), pa.array(n[at : at + (1 << 18)])], names=["key", "n"])

        for batch in batches:
            data, offs = flat(batch.column(0))
            for i, j in chunks(offs):
                part, local = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                word, _ = words(part, local)
                for key, factor in ((word, 0), (grams(part, local)[0], 1)):
                    if len(key):
                        key, n = np.unique(key, return_counts=True)
                        held.append((key << U64(factor), n.astype(np.int64)))
                        size += len(key)
                held.append((np.array([END_KEY]), np.array([j - i], np.int64)))
                if size > 1_000_000:
                    held[:] = summed(held)
                    size = len(held[0][0])
                    if size > HELD:
                        yield from made()
                        held.clear()
                        size = 0
        if held:
            yield from made()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def counters(grams_: DataFrame, bits: int) -> np.ndarray:
    """The model's table, built region by region from (gram, n), read by the driver as blocks of fixed total size."""
    low_bits = bits - REGION_BITS
    n = int(grams_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_order, level = [], grams_.select(F.col("gram").alias("sub"), "n")
    for order in reversed(ORDERS):
        level = level.groupBy(F.col("sub").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1).cast("long")).alias("sub")).agg(F.sum("n").alias("n"))
        by_order.append(level.select(F.lit(order).alias("order"), "sub", "n"))
        level = by_order[-1].select("sub", "n")
    rows = by_order[0]
    for other in by_order[1:]:
        rows = rows.unionByName(other)

    def hashes(order, sub):
        out = np.zeros(len(sub), U64)
        for o in ORDERS:
            out[order == o] = contexts(sub[order == o], o)
        return out

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
            region = (hashes(order, sub) >> U64(64 - REGION_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(region), *batch.columns], names=["region", "order", "sub", "n"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions: dict[int, np.ndarray] = {}
        for batch in batches:
            region, order, sub, n = (c.to_numpy() for c in batch.columns)
            sub = sub.view(U64)
            h, byte = hashes(order, sub), (sub & U64(255)).astype(np.int64)
            for r in np.unique(region).tolist():
                some = region == r
                counts = regions.setdefault(r, np.zeros((2, 1 << low_bits)))
                for j in range(8):
                    at = slots(h[some], (1 << j) | (byte[some] >> (8 - j)), bits) & ((1 << low_bits) - 1)
                    bit = (byte[some] >> (7 - j)) & 1
                    np.add.at(counts, (bit, at), n[some])
        for r, counts in regions.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed_counts(*counts).tobytes()], pa.binary())], names=["region", "counts"])

    table_ = np.zeros(1 << bits, np.uint16)
    made = rows.mapInArrow(placed, "region int, order int, sub long, n long").repartition(n, "region").mapInArrow(built, "region int, counts binary")
    for row in materialize(made, "regions").toLocalIterator():
        table_[row["region"] << low_bits : (row["region"] + 1) << low_bits] = np.frombuffer(row["counts"], np.uint16)
    return table_


def train(grams_: DataFrame, bits: int) -> tuple[Model, Broadcast]:
    """The model of (gram, n), without its table, and the table as a broadcast: counters, then weights learnt online in shares and averaged, then the refinement of their outcomes."""
    spark = grams_.sparkSession
    shared = spark.sparkContext.broadcast(counters(grams_, bits))
    model = Model(np.zeros(0, np.uint16))

    def pairs(batches):
        for batch in batches:
            key, n = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
            if len(key):
                yield key, n

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value)
        total = sum(own.learn(key, n) for key, n in pairs(batches))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([own.weights.tobytes()], pa.binary())], names=["total", "weights"])

    total, weights = 0.0, np.zeros_like(model.weights, np.float64)
    for row in grams_.mapInArrow(learn, "total double, weights binary").toLocalIterator():  # a small row from each share
        total += row["total"]
        weights += row["total"] * np.frombuffer(row["weights"], np.float32).reshape(weights.shape)
    if not total:
        return model, shared
    model.weights = (weights / total).astype(np.float32)
    shared_weights = model.weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, shared_weights)
        seen = sum((own.outcomes(key, n) for key, n in pairs(batches)), np.zeros(1))
        if seen.size > 1:
            yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["outcomes"])

    seen = sum((np.frombuffer(row[0], np.float64) for row in grams_.mapInArrow(judge, "outcomes binary").toLocalIterator()), np.zeros(1))
    model.refine(seen)
    return model, shared


def scores(docs: DataFrame, folds: int = 7, fold: int = 2, frequent: int = 1 << 18, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), folds, fold).alias("held_out"))
    gathered = materialize(gather(rows.where("not held_out")), "gathered")
    is_word = F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1
    counts = gathered.where(is_word)
    n_tokens, n_types = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    found = gathered.where(~is_word).select(F.shiftrightunsigned("key", 1).alias("gram"), "n")
    model, counters_ = train(found, table_bits(found.count(), most_bits))
    least = _frequent_from(counts, frequent)
    known = counts.where(F.col("n") >= least).toPandas()  # at most `frequent` rows
    known = known.sort_values("key", key=lambda s: s.to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((model.weights, model.refined, known["key"].to_numpy().view(U64), known["n"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, refined, keys, amounts = shared.value
        model = Model(counters_.value, weights, refined)
        cache, made = Cache(model), TaskContext.get().partitionId() << 40
        logs = np.log10(amounts + 1.0)
        end = np.searchsorted(keys, END_KEY)
        end_known = end < len(keys) and keys[end] == END_KEY
        for batch in batches:
            data, offs = flat(batch.column(1))
            for i, j in chunks(offs):
                part, local, m = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], j - i
                word, row = words(part, local)
                at = np.searchsorted(keys, word)
                at[at == len(keys)] = 0
                hit = keys[at] == word if len(keys) else np.zeros(len(word), bool)
                n_known = np.bincount(row[hit], minlength=m) + int(end_known)
                base = np.bincount(row[hit], logs[at[hit]], m) + (logs[end] if end_known else 0.0)
                rare_row, rare = row[~hit], word[~hit]
                order = np.lexsort((rare, rare_row))
                rare_row, rare = rare_row[order], rare[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])])) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rare)))
                bounds = np.searchsorted(rare_row[new], np.arange(m + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(rare[new].view(np.int64)), pa.array(times.astype(np.int64))], names=["key", "times"])
                gram, cut = grams(part, local)
                score = -text_costs(cache.costs, gram, cut)
                columns = [np.arange(made, made + m), np.bincount(row, minlength=m) + 1, n_known, base, score, np.diff(local)]
                made += m
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, m), batch.column(2).slice(i, m), *[pa.array(c) for c in columns], pa.ListArray.from_arrays(pa.array(bounds), pairs)],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "n_bytes", "rare"],
                )

    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<struct<key:long,times:long>>"
    scored = materialize(rows.select("doc_id", "text", "held_out").mapInArrow(run, schema), "scored")
    asked = scored.select("row", F.inline("rare"))
    met = asked.join(counts.where(F.col("n") < least), "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("extra"))
    whole = scored.drop("rare").join(met, "row", "left")
    floor = float(np.log10(n_tokens + n_types + 1))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("extra", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` words have it or more; from the histogram of counts, in powers and steps of 1/16."""
    step = F.floor(F.log2("n") * 16)
    steps = sorted((int(r[0]), r[1], r[2]) for r in counts.groupBy(step.alias("s")).agg(F.count("*"), F.min("n")).collect())  # 16 rows a doubling
    total, least = 0, 1 << 62
    for _, n, low in reversed(steps):
        if total + n > most:
            break
        total, least = total + n, int(low)
    return least


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
