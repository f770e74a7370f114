"""Token counts of documents from flat token files, by separator scan.

A token file is nothing but ids with an end-of-document id after each document, in blocks of fixed length that ignore
documents; there is no index.  Each block is searched for the separator at once, and yields its number of tokens and
the separators' places.  A prefix scan over a file's blocks (running sums of tokens and separators, running maximum of
the last separator's place) then gives each separator its ordinal in the file and its document's length, however many
blocks the document spans.

Null, empty and very long texts are documents like any other (0 tokens, many blocks; runs of white space of any length); repeated rows are counted each;
tokens after a file's last separator form a last document.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed values of the vocabulary: its pre-splitting pattern and the id left free for the end of a document.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 1 << 20
#: White space as the pattern's \\s has it; runs of more than LONG_SPACE are tokenised by themselves.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_SPACE = 1 << 14
#: file: name of the token file; block: its number there; ids: little-endian ids. A manifest row has ids of documents instead.
FILES = "file string, block long, ids binary, manifest boolean"


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(encoding, text: str, long_space: int = LONG_SPACE) -> list[int]:
    """The ids of a text.  The tokenizer's matcher overflows in very long runs of white space, so these are cut out.

    The pattern starts anew at a run, and takes all of it, or all but its last character if anything follows; so the
    ids are those of the whole text.
    """
    out, at = [], 0
    for m in re.finditer(f"{SPACE}{{{long_space},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """FILES of docs (doc_id, text): a token file for each input partition, and manifest rows with its documents' ids in order.

    The vocabulary's file is read on the driver and broadcast; it is of fixed size.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = np.uint16 if end < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoder(shared.value)
        name, block, part, held, size = f"part-{TaskContext.get().partitionId():06d}", 0, 0, [], 0

        def made(number, ids, manifest):
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([ids], pa.binary()), pa.array([manifest])], names=["file", "block", "ids", "manifest"])

        for batch in batches:
            ids = batch.column(0)
            for text in batch.column(1):
                tokens = np.array([*tokens_of(encoding, text.as_py() or ""), end], kind)
                held.append(tokens)
                size += len(tokens)
                while size >= block_tokens:
                    stream = np.concatenate(held)
                    yield made(block, stream[:block_tokens].tobytes(), False)
                    held, size, block = [stream[block_tokens:]], size - block_tokens, block + 1
            yield made(part, _id_bytes(ids), True)
            part += 1
        if size:
            yield made(block, np.concatenate(held).tobytes(), False)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, FILES)


def _id_bytes(ids: pa.Array) -> bytes:
    """Ids as 9 bytes each: a null mark and the value."""
    out = np.zeros(len(ids), np.dtype([("null", np.uint8), ("value", np.int64)]))
    out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["value"] = ids.fill_null(0).to_numpy()
    return out.tobytes()


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, block, ids) of raw token files of up to 2 GB each, `width` bytes a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                for k, at in enumerate(range(0, len(raw), block_tokens * width)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([raw[at : at + block_tokens * width]], pa.binary())], names=["file", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, ids binary")


def scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in token files given as blocks (file, block, ids)."""
    kind = np.dtype({2: np.uint16, 4: np.uint32}[width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for ids in batch.column(2):
                tokens = np.frombuffer(ids.as_py(), kind)
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == end).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    met = materialize(blocks.select("file", "block", "ids").mapInArrow(run, "file string, block long, n long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = met.select("file", "block", "n", F.size("ends").cast("long").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    placed = summary.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("first_ordinal", F.coalesce(F.sum("k").over(before), F.lit(0)))
    placed = placed.withColumn("open", F.coalesce(F.max(F.col("last") + F.col("start") + 1).over(before), F.lit(0)))
    joined = met.select("file", "block", "ends").join(placed.select("file", "block", "start", "first_ordinal", "open"), ["file", "block"])
    lengths = F.transform("ends", lambda e, i: F.struct((F.col("first_ordinal") + i).alias("ordinal"), (e + F.col("start") - F.when(i == 0, F.col("open")).otherwise(F.col("start") + F.element_at("ends", F.greatest(i, F.lit(1)).cast("int")) + 1)).alias("n_tokens")))
    closed = joined.select("file", F.inline(lengths))
    rest = placed.groupBy("file").agg(F.sum("k").alias("ordinal"), (F.sum("n") - F.coalesce(F.max(F.col("last") + F.col("start") + 1), F.lit(0))).alias("n_tokens")).where("n_tokens > 0")
    return closed.unionByName(rest.select("file", "ordinal", "n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document, through token files in the shared folder."""
    files = materialize(write_tokens(docs, vocabulary), "tokens")
    counted = scan(files.where("not manifest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part, raw in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
                ids = np.frombuffer(raw, np.dtype([("null", np.uint8), ("value", np.int64)]))
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([part] * n, pa.int64()), pa.array(np.arange(n)), pa.array(ids["value"], mask=ids["null"] > 0)], names=["file", "part", "at", "doc_id"])

    listed = files.where("manifest").select("file", "block", "ids").mapInArrow(run, "file string, part long, at long, doc_id long")
    sizes = listed.groupBy("file", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).select("file", "part", "offset")
    named = listed.join(offsets, ["file", "part"]).select("file", (F.col("offset") + F.col("at")).alias("ordinal"), "doc_id")
    return named.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
