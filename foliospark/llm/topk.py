"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

Rows are packed into shards where they lie, each with its tree, and written to the shared folder.  A shard's own query
rows form a query block, which first searches its own shard; the kth scores found there are lower bounds for all others.
A shard's root ball bounds what any of its rows can score, so a block visits only shards that may still win, the most
promising first, in rounds: after each, the current kth scores are shared, and shards and queries that can't reach them
any more drop out.  Within a shard, nodes are taken by falling upper bound q.c + |q| r and dropped once that is below
the kth score so far.  A round sends each shard to one task and its queries after it; results are at most k rows a query
and shard, merged by query.

Components become floor(scale * x).  Vectors that are null or hold a null or non-finite component take no part, nor do
those with a null id.  Vectors of different lengths are not compared.  Rows that repeat an id are separate: each
queries and is found, never by itself.  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, materialize, table

SHARD_ROWS, LEAF = 16384, 256
#: Queries in a row that visits a shard, and such rows in an Arrow batch.
PIECE, BATCH = 256, 16
#: Bytes of root balls that are broadcast at once; more are taken in parts.
ROOT_BYTES = 64 << 20
#: A block visits so many shards in its first round, and GROWTH times as many in all after each further one.
FIRST, GROWTH = 2, 16
#: Below every score; its negative exists.
LEAST = -(1 << 62)
SHARD = "shard string, dim int, ids binary, vectors binary, centers binary, radii binary, nodes binary, n_queries long"
FOUND = "block string, query int, query_id long, dim int, vector binary, bound long, best array<struct<vec_id:long,score:long>>"


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows, and by node: center, radius, and (first, end, left child or -1); a right child follows its left one."""
    order, centers, radii, nodes = np.arange(len(x)), [], [], []
    todo = [(0, len(x))]
    at = 0
    while at < len(todo):
        a, b = todo[at]
        rows = x[order[a:b]]
        center = rows.mean(axis=0)
        centers.append(center)
        radii.append(np.sqrt(((rows - center) ** 2).sum(axis=1).max()))
        left = -1
        if b - a > LEAF and radii[-1] > 0:
            far = rows[((rows - center) ** 2).sum(axis=1).argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            along = rows @ (far - other)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, half)]
            left = len(todo)
            todo += [(a, a + half), (a + half, b)]
        nodes.append((a, b, left))
        at += 1
    return order, np.array(centers), np.array(radii), np.array(nodes, np.int64).reshape(-1, 3)


def packed_vectors(x: np.ndarray) -> bytes:
    """Rows of whole numbers in two or four bytes a component, if they fit, else as doubles."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64).tobytes()


def unpacked_vectors(raw: bytes, n: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(raw) // max(n * dim, 1) or 8]
    return np.frombuffer(raw, kind).reshape(n, dim).astype(np.float64)


def upper_bounds(q: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """By query and ball, what no row of the ball exceeds."""
    upper = q @ centers.T + np.linalg.norm(q, axis=1)[:, None] * radii[None, :]
    return upper + 1e-9 * (1 + np.abs(upper))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where every partial sum is a whole number it can hold."""
    bound = np.abs(q).sum(axis=1).max(initial=0) * np.abs(x).max(initial=0)
    if bound < 1 << 24:
        return (q.astype(np.float32) @ x.T.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


class Tree:
    def __init__(self, row: dict):
        self.dim = row["dim"]
        of = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = of("ids", np.int64)
        self.vectors = unpacked_vectors(row["vectors"], len(self.ids), self.dim)
        self.centers = of("centers", np.float64).reshape(-1, self.dim)
        self.radii, self.nodes = of("radii", np.float64), of("nodes", np.int64).reshape(-1, 3)

    def search(self, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, (ids, scores) of its best rows here that reach its bound; own: the row that is the query, or -1."""
        least, n = LEAST, len(q)
        kth = bound.copy()
        upper = upper_bounds(q, self.centers, self.radii)
        best_ids, best = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), least)
        heap = [(-upper[:, 0].max(initial=-np.inf), 0)] if n and len(self.ids) else []
        while heap:
            _, node = heapq.heappop(heap)
            active = np.flatnonzero(upper[:, node] >= kth)
            if not len(active):
                continue
            a, b, left = self.nodes[node]
            if left >= 0:
                for child in (left, left + 1):
                    heapq.heappush(heap, (-upper[active, child].max(), int(child)))
                continue
            scores = products(q[active], self.vectors[a:b])
            self_at = own[active] - a
            mine = np.flatnonzero((own[active] >= 0) & (self_at >= 0) & (self_at < b - a))
            scores[mine, self_at[mine]] = least
            some = np.flatnonzero((scores >= np.maximum(kth[active], least + 1)[:, None]).any(axis=1))
            if not len(some):
                continue
            rows = active[some]
            all_scores = np.concatenate([best[rows], scores[some]], axis=1)
            all_ids = np.concatenate([best_ids[rows], np.broadcast_to(self.ids[a:b], (len(rows), b - a))], axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_scores, order, axis=1)
            best_ids[rows] = np.take_along_axis(all_ids, order, axis=1)
            kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
        keep = (best > least) & (best >= bound[:, None])
        return [(best_ids[i, keep[i]], best[i, keep[i]]) for i in range(n)]


def shards(vectors: DataFrame, scale: float, every: int) -> DataFrame:
    """SHARD's rows: up to SHARD_ROWS vectors of one length with their tree; ids keep the tree's order."""

    def pack(dim: int, ids: np.ndarray, x: np.ndarray, name: str) -> pa.RecordBatch:
        order, centers, radii, nodes = ball_tree(x)
        row = [name, dim, ids[order].tobytes(), packed_vectors(x[order]), centers.tobytes(), radii.tobytes(), nodes.tobytes(), int((ids % every == 0).sum())]
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                waiting.setdefault(dim, []).append((ids[rows].astype(np.int64), values[starts[rows][:, None] + np.arange(dim)]))
                while sum(len(i) for i, _ in waiting[dim]) >= SHARD_ROWS:
                    i, x = (np.concatenate(v) for v in zip(*waiting[dim], strict=True))
                    waiting[dim] = [(i[SHARD_ROWS:], x[SHARD_ROWS:])]
                    yield pack(dim, i[:SHARD_ROWS], x[:SHARD_ROWS], f"{part}-{made}")
                    made += 1
        for dim, rest in waiting.items():
            i, x = (np.concatenate(v) for v in zip(*rest, strict=True))
            if len(i):
                yield pack(dim, i, x, f"{part}-{made}")
                made += 1

    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(whole)
    return clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, SHARD)


def _own(packed: DataFrame, k: int, every: int) -> DataFrame:
    """FOUND's rows: each shard's queries, searched in their own shard."""
    best_type = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                own = np.flatnonzero(tree.ids % every == 0)
                for at in range(0, len(own), 4096):
                    some = own[at : at + 4096]
                    q = tree.vectors[some]
                    found = tree.search(q, some, np.full(len(some), LEAST), k)
                    bounds = [int(s[k - 1]) if len(s) >= k else LEAST for _, s in found]
                    best = [[{"vec_id": i, "score": s} for i, s in zip(a.tolist(), b.tolist(), strict=True)] for a, b in found]
                    n = len(some)
                    arrays = [pa.array([row["shard"]] * n), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(tree.ids[some]), pa.array(np.full(n, tree.dim, np.int32)), pa.array([packed_vectors(v) for v in q], pa.binary()), pa.array(bounds, pa.int64()), pa.array(best, best_type)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FOUND.split(", ")])

    return packed.where("n_queries > 0").mapInArrow(run, FOUND)


def _stacked(queries: list[dict], dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([unpacked_vectors(x["vector"], 1, dim)[0] for x in queries]), np.array([x["bound"] for x in queries], np.int64)


def _visits(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """(block, piece, shard, round): the other shards that some query of a piece may find a result in, the best first."""
    roots = packed.select("shard", "dim", F.expr("substring(centers, 1, 8 * dim)").alias("center"), F.expr("substring(radii, 1, 8)").alias("radius"))
    size = roots.agg(F.sum(F.length("center") + 64)).first()[0] or 0
    parts = -(-size // ROOT_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                q, bound = _stacked(row["queries"], row["dim"])
                balls = [x for x in row["balls"] if x["shard"] != row["block"]]
                if not balls:
                    continue
                centers, radii = np.stack([np.frombuffer(x["center"], np.float64) for x in balls]), np.array([np.frombuffer(x["radius"], np.float64)[0] for x in balls])
                gain = (upper_bounds(q, centers, radii) - bound[:, None]).max(axis=0)
                for k in np.flatnonzero(gain >= 0).tolist():
                    for column, value in zip(out, (row["block"], row["piece"], balls[k]["shard"], float(gain[k])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["block", "piece", "shard", "gain"])

    made = None
    for part in range(parts):
        some = roots.where(F.pmod(F.xxhash64("shard"), F.lit(parts)) == part).groupBy("dim").agg(F.collect_list(F.struct("shard", "center", "radius")).alias("balls"))
        met = pieces.join(F.broadcast(some), "dim").select("block", "piece", "dim", "queries", "balls")  # ROOT_BYTES of balls
        one = met.mapInArrow(run, "block string, piece long, shard string, gain double")
        made = one if made is None else made.unionByName(one)
    place = F.row_number().over(Window.partitionBy("block", "piece").orderBy(F.col("gain").desc(), "shard"))
    late = F.ceil(F.log(float(GROWTH), F.col("place") / F.lit(float(FIRST)) - 1e-9))
    return made.withColumn("place", place).select("block", "piece", "shard", F.greatest(late, F.lit(0)).cast("int").alias("round"))


def _searched(visits: DataFrame, pieces: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """(block, query, query_id, vec_id, score) of pieces in the shards that they visit; each shard goes to one task, its queries after it."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = lambda schema: [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in schema.split(", "))]
    tree = packed.select("shard", F.lit(0).alias("kind"), "dim", "ids", "vectors", "centers", "radii", "nodes", *none(f"block string, queries {pieces.schema['queries'].dataType.simpleString()}"))
    asked = visits.join(pieces, ["block", "piece"]).select("shard", F.lit(1).alias("kind"), "dim", *none("ids binary, vectors binary, centers binary, radii binary, nodes binary"), "block", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["kind"]:
                    tree = Tree(row)
                    continue
                asked = row["queries"]
                q, bound = _stacked(asked, row["dim"])
                found = tree.search(q, np.full(len(q), -1), bound, k)
                sizes = [len(a) for a, _ in found]
                numbers = np.repeat(np.array([x["query"] for x in asked], np.int32), sizes)
                ids = np.repeat(np.array([x["query_id"] for x in asked], np.int64), sizes)
                arrays = [pa.array([row["block"]] * len(ids), pa.string()), pa.array(numbers), pa.array(ids), pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([b for _, b in found]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "query", "query_id", "vec_id", "score"])

    dealt = tree.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "block string, query int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by every, against all other rows."""
    spark = vectors.sparkSession
    order = Window.partitionBy("block", "query").orderBy(F.col("score").desc(), "vec_id")
    packed = materialize(shards(vectors, scale, every), "shards")
    with batches_of(spark, BATCH):
        asked = materialize(_own(packed, k, every), "asked")
        best = asked.select("block", "query", "query_id", F.inline("best"))
        queries, visits = asked.select("block", "dim", "query", "query_id", "vector"), None
        bounds = asked.select("block", "query", "bound")
        rounds, at = 1, 0
        while at < rounds:
            known = queries.join(bounds, ["block", "query"])
            pieces = known.groupBy("block", "dim", F.floor(F.col("query") / PIECE).alias("piece")).agg(F.collect_list(F.struct("query", "query_id", "vector", "bound")).alias("queries"))  # PIECE queries
            pieces = materialize(pieces, "pieces")
            if visits is None:
                if packed.select("shard").limit(2).count() < 2:
                    break
                visits = materialize(_visits(pieces, packed), "visits")
                rounds = (visits.agg(F.max("round")).first()[0] if not visits.isEmpty() else -1) + 1
                if not rounds:
                    break
            found = _searched(_alive(visits.where(F.col("round") == at), pieces, packed), pieces, packed, k)
            ranked = best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            best = materialize(ranked.drop("rank"), "best")
            bounds = best.groupBy("block", "query").agg(F.when(F.count("*") == k, F.min("score")).otherwise(LEAST).alias("bound"))
            at += 1
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _alive(visits: DataFrame, pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The visits of a round that can still win under the current kth scores, by the shards' root balls."""
    roots = packed.select("shard", F.expr("substring(centers, 1, 8 * dim)").alias("center"), F.expr("substring(radii, 1, 8)").alias("radius"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                q, bound = _stacked(row["queries"], row["dim"])
                keep.append(bool((upper_bounds(q, np.frombuffer(row["center"], np.float64)[None], np.frombuffer(row["radius"], np.float64))[:, 0] >= bound).any()))
            yield batch.select(["block", "piece", "shard"]).filter(pa.array(keep, pa.bool_()))

    met = visits.join(roots, "shard").join(pieces, ["block", "piece"]).select("block", "piece", "shard", "dim", "center", "radius", "queries")
    return met.mapInArrow(run, "block string, piece long, shard string")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


OP10_SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e, row_number() over () as rid
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.rid as qr, q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.rid <> c.rid and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by qr order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20
"""
