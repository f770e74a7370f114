"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its byte-class trigrams, hashed words and marks for words said twice running; all of the text
counts.  A bounded sample of labelled training rows (at most `sample` a label, by hash of the id) gives term weights,
the latent axes (a singular value decomposition) and the voters.  Every document is projected on the axes and compared
with all voters by blocked exact cosine products; its k nearest vote, weighted by a power of similarity.

The label, language, source and id of a document are no inputs of its score.  Null, empty and wordless texts have the
zero vector and get the share of label 1 in the sample; if no usable label exists every score is 0.5.  Repeated rows
get equal scores.  Repeated labels of an id vote once, with the lowest label; repeated ids of documents too, with one of their texts.  Extra columns pass.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import U64, Fingerprints, chunks, flat, table, word_spans

CLASSES, WORDS, MARKS = 14, 2048, 8
TERMS = CLASSES**3 + WORDS + MARKS
BLOCK = 2048


def classes() -> np.ndarray:
    """A class for each byte: space, line end, lower, upper, digit, five kinds of punctuation, symbols, brackets, high bytes, others."""
    out = np.full(256, 13, np.int64)
    out[[0x20, 0x09]] = 0
    out[[0x0A, 0x0D]] = 1
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A], out[0x80:] = 2, 3, 4, 12
    for k, some in enumerate((".", ",;:", "!?", "|", "-_/\\'\"`", "*#$%&@^~+=", "()[]{}<>")):
        out[[ord(c) for c in some]] = 5 + k
    return out


def features(column: pa.Array) -> np.ndarray:
    """A row of term shares for each text: square roots of each family's relative counts."""
    data, offs = flat(column)
    n = len(offs) - 1
    out = np.zeros((n, TERMS), np.float32)
    kind = classes()
    for i, j in chunks(offs, 1 << 20):
        part, local = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        size = len(part)
        if not size:
            continue
        of = kind[part]
        row = np.repeat(np.arange(j - i), np.diff(local))
        if size >= 3:
            term = (of[:-2] * CLASSES + of[1:-1]) * CLASSES + of[2:]
            inside = row[:-2] == row[2:]
            counts = np.bincount(row[:-2][inside] * CLASSES**3 + term[inside], minlength=(j - i) * CLASSES**3).reshape(j - i, -1)
            out[i:j, : CLASSES**3] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        start, end = word_spans(part, local, "black")
        if len(start):
            value, owner = Fingerprints(part, fold=True).of(start, end), row[start]
            words = np.bincount(owner, minlength=j - i)
            counts = np.bincount(owner * WORDS + (value % U64(WORDS)).astype(np.int64), minlength=(j - i) * WORDS).reshape(j - i, -1)
            out[i:j, CLASSES**3 : CLASSES**3 + WORDS] = np.sqrt(counts / np.maximum(words, 1)[:, None])
            again = np.bincount(owner[1:][(value[1:] == value[:-1]) & (owner[1:] == owner[:-1])], minlength=j - i)
            share = again / np.maximum(words, 1)
            out[i:j, -MARKS] = np.sqrt(share)
            out[i:j, -MARKS + 1] = np.sqrt((1 - share) * (words > 0))
    return out


@dataclass
class Voters:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    power: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        x = (terms * self.weights) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        out = np.full(len(terms), self.labels.mean())
        some = np.flatnonzero(terms.any(axis=1))
        for at in range(0, len(some), BLOCK):
            rows = some[at : at + BLOCK]
            near = self.latent(terms[rows]) @ self.vectors.T
            top = np.argpartition(-near, min(self.k, near.shape[1]) - 1, axis=1)[:, : self.k]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** self.power + 1e-12
            out[rows] = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return out


def families() -> np.ndarray:
    """How much each family of terms counts beside the others.

    Words are fewer in a text than trigrams, so their shares scatter more and are given less weight; repetition is one
    pair of terms beside thousands and is given more.  Any such weights give exact votes, by other distances.
    """
    out = np.ones(TERMS, np.float32)
    out[CLASSES**3 : CLASSES**3 + WORDS] = 0.3
    out[-MARKS:] = 1.5
    return out


def fit(terms: np.ndarray, y: np.ndarray, axes: int = 48, k: int = 15, power: float = 8.0) -> Voters:
    """Voters from the terms (see features) and labels of the sample."""
    y = np.asarray(y, np.float64)
    some = terms.any(axis=1)
    terms, y = terms[some], y[some]
    if not len(y):
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, k, power)
    seen = (terms > 0).sum(axis=0)
    weights = (families() * (np.log((1 + len(y)) / (1 + seen)) + 1)).astype(np.float32)
    x = terms * weights
    # the axes from the smaller of the two Gram matrices
    whole = x.astype(np.float64)
    values, vectors = np.linalg.eigh(whole @ whole.T)
    best = np.argsort(-values)[: min(axes, len(values))]
    best = best[values[best] > 1e-9 * values.max()]
    basis = (whole.T @ (vectors[:, best] / np.sqrt(values[best]))).astype(np.float32)
    voters = Voters(weights, basis, np.zeros((0, 1), np.float32), y, k, power)
    voters.vectors = voters.latent(terms)
    return voters


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, sample: int = 800, folds: int = 4, held: int = 2) -> Voters:
    """Voters from at most `sample` labelled rows of each label, none of the held-out fold.

    An id that several rows of docs have counts once, with the text of least hash.  Texts stay on the executors: the
    driver gets a row of TERMS numbers for each of the 2 x sample ids at most.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(fold_of(F.col("doc_id"), folds) != held)
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rank = F.xxhash64(F.col("doc_id"), F.lit(9))
    picked = [one.where(F.col("quality") == q).orderBy(rank, "doc_id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 x sample rows
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[bytes, int, bytes]] = {}  # of each id the text of least digest: no more entries than the sample
        for batch in batches:
            ids, quality = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for k, i in enumerate(ids):
                text = batch.column(1)[k].as_py().encode()
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if i not in best or digest < best[i][0]:
                    best[i] = (digest, quality[k], zlib.compress(features(pa.array([text], pa.large_binary())).tobytes(), 1))
        if best:
            digests, quality, terms = zip(*best.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(digests, pa.binary()), pa.array(quality, pa.int32()), pa.array(terms, pa.binary())], names=["doc_id", "digest", "quality", "terms"])

    made = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id long, digest binary, quality int, terms binary")
    found = made.groupBy("doc_id").agg(F.min_by(F.struct("quality", "terms"), "digest").alias("x")).select("doc_id", "x.*").collect()
    found.sort(key=lambda r: r["doc_id"])
    terms = np.stack([np.frombuffer(zlib.decompress(r["terms"]), np.float32) for r in found]) if found else np.zeros((0, TERMS), np.float32)
    return fit(terms, np.array([r["quality"] for r in found], np.float64))


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """docs with score, between 0 and 1; a column of that name is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                values = voters.score(features(rows.column(at)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(values, pa.float64())], names=[*rows.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    voters = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), voters)
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
