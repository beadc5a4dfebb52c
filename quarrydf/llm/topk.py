"""Exact top-k search by inner product: ball-tree branch and bound per shard.

All vectors are dealt into shards, the queries into blocks. A task holds one block of queries and goes through some shards one after the
other; each shard becomes a ball tree, whose nodes are visited in the order of their upper bound (inner product with the centre plus
norm times radius) and left alone when that is below the query's current kth score. The kth scores carry over from shard
to shard, and start from those of a small pilot set that all tasks share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydf.llm import common

#: Rows of a shard, of a block of queries and of the pilot set; shards that a task goes through; rows of a leaf.
SHARD, BLOCK, PILOT, SHARDS, LEAF = 4096, 2048, 512, 8, 64
_LOW = np.iinfo(np.int64).min


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = vector.isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), _LOW), np.full((n, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer every row of ``rows`` the same ids with these scores (a score of ``_LOW`` is no offer)."""
        better = (scores >= self.scores[rows, -1][:, None]).any(1)
        rows, scores = rows[better], scores[better]
        if len(rows):
            k = self.scores.shape[1]
            s = np.concatenate([self.scores[rows], scores], 1)
            i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
            i[s == _LOW] = np.iinfo(np.int64).max
            order = np.lexsort((i, ~s), axis=1)[:, :k]
            self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _largest(vectors: np.ndarray) -> int:
    """The largest absolute component."""
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


class BallTree:
    """Vectors in nested balls: each node has a centre, a radius and either two nodes or a range of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.arange(len(ids))
        self.largest = _largest(vectors)
        self._all = vectors.astype(np.float64)
        self.root = self._node(0, len(ids))
        self.ids = ids[self.order]
        self.vectors = vectors[self.order]
        self.floats = self._all[self.order]
        del self._all

    def _node(self, a: int, b: int):
        rows = self.order[a:b]
        x = self._all[rows]
        centre = x.mean(0)
        away = ((x - centre) ** 2).sum(1)
        radius = float(np.sqrt(away.max(initial=0.0)))
        if b - a <= LEAF or radius == 0:
            return centre, radius, a, b, None
        # split halfway along the line through two far points
        one = x[int(away.argmax())]
        two = x[int(((x - one) ** 2).sum(1).argmax())]
        side = np.argsort(x @ (two - one), kind="stable")
        self.order[a:b] = rows[side]
        middle = (a + b) // 2
        return centre, radius, a, b, (self._node(a, middle), self._node(middle, b))

    def search(self, ids: np.ndarray, queries: np.ndarray, best: Best, visited: list[int] | None = None) -> None:
        """Offer all vectors but those of the query's own id to ``best``. A score beyond 64 bits is an error."""
        floats = queries.astype(np.float64)
        # no term of a score is larger; below 2^52 doubles hold every partial sum
        most = self.largest * _largest(queries) * max(1, self.vectors.shape[1])
        slack = most * 2.0**-50
        norms = np.sqrt((floats**2).sum(1))

        def bound(node, rows):
            reach = floats[rows] @ node[0] + norms[rows] * node[1]
            return reach + 1e-9 * (np.abs(reach) + norms[rows] * (np.linalg.norm(node[0]) + 1)) + 1e-6

        def visit(node, rows, reach):
            rows = rows[reach >= best.kth()[rows]]  # what was found meanwhile counts
            if not len(rows):
                return
            _, _, a, b, children = node
            if children is None:
                if visited is not None:
                    visited.append(len(rows) * (b - a))
                for at in range(a, b, LEAF * 16):
                    to = min(b, at + LEAF * 16)
                    own, near = ids[rows][:, None] == self.ids[at:to][None], floats[rows] @ self.floats[at:to].T
                    if most < 2**52:
                        scores = np.rint(near).astype(np.int64)
                    else:
                        # 64-bit sums wrap, so they are right whenever the score itself fits
                        if (~own & (np.abs(near) + slack >= 2.0**63)).any():
                            raise OverflowError("an inner product does not fit in 64 bits: quantise with a smaller scale")
                        scores = queries[rows] @ self.vectors[at:to].T
                    scores[own] = _LOW
                    best.add(rows, scores, self.ids[at:to])
                return
            left, right = (bound(c, rows) for c in children)
            first = left >= right
            # each query goes down the more promising side first
            visit(children[0], rows[first], left[first])
            visit(children[1], rows, right)
            visit(children[0], rows[~first], left[~first])

        everyone = np.arange(len(ids))
        if len(everyone) and len(self.ids):
            visit(self.root, everyone, bound(self.root, everyone))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows of ``vectors`` with the highest inner product with each query.

    Both tables have ``vec_id`` (long) and ``v`` (array of long); null vectors take no part. Exact; all rows if there are fewer
    than ``k``; ties to the smaller id; rows of the query's own id are left out; of repeated
    queries the one with the smallest vector is asked, repeated candidates count each. Vectors are compared with
    those of their own length. A score beyond 64 bits is an error. Every shard meets every block of queries once, in some task; memory is bounded by one
    shard and one block, and nothing is collected.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    # the place in the table spreads repeated rows over the shards
    rows = vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("place")).filter("v IS NOT NULL AND vec_id IS NOT NULL").withColumn("dim", F.size("v"))
    asked = queries.filter("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("dim"))
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    spans = -(-shards // SHARDS)
    # the pilot set: the longest vectors, a fixed number of them
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    pilot = rows.orderBy(norm.desc(), "vec_id").limit(PILOT).collect()
    shared = spark.sparkContext.broadcast([(r["vec_id"], list(r["v"])) for r in pilot])

    shard = F.pmod(F.xxhash64("vec_id", "place"), F.lit(shards)).cast("int")
    to_blocks = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (shard % spans).alias("span"), (shard + 1).alias("part"), "vec_id", "v")
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int")
    to_spans = asked.select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), F.lit(0).alias("part"), "vec_id", "v")
    keys = ["dim", "block", "span"]
    dealt = to_blocks.unionByName(to_spans).repartition(*keys).sortWithinPartitions(*keys, "part")

    def runs(batches):
        """Rows of equal (dim, block, span, part), whole, in order."""
        held, key = [], None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if tuple(marks[a]) != key and held:
                    yield key, *_joined(held)
                    held = []
                key = tuple(marks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield key, *_joined(held)

    def _joined(parts):
        return np.concatenate([p.column(4).to_numpy(zero_copy_only=False) for p in parts]), np.concatenate([_matrix(p.column(5)) for p in parts])

    def run(batches):
        task, ids, asked_for, best = None, None, None, None

        def results():
            found = best.scores != _LOW
            at = np.nonzero(found)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.scores.shape[1]).reshape(best.ids.shape)[at]), pa.array(best.ids[at]), pa.array(best.scores[at])], ["query_id", "vec_id", "score"])

        for key, some_ids, some in runs(batches):
            if key[:3] != task:
                if best is not None:
                    yield results()
                task, best = key[:3], None
            if key[3] == 0:
                ids, asked_for, best = some_ids, some, Best(len(some_ids), k)
                first = [(i, v) for i, v in shared.value if len(v) == some.shape[1]]
                floor = Best(len(ids), k)
                if first:
                    # only their kth score is used: the rows themselves come again with their shards
                    BallTree(np.array([i for i, _ in first]), np.array([v for _, v in first], np.int64).reshape(len(first), -1)).search(ids, some, floor)
                best = _Floored(len(ids), k, floor.kth())
            elif best is not None:
                BallTree(some_ids, some).search(ids, asked_for, best)
        if best is not None:
            yield results()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Floored(Best):
    """Best rows when the kth score is known to be at least ``floor``."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        super().__init__(n, k)
        self.floor = floor

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)


def op6_topk(spark, sf_dir):
    """The five best matches in ``embeddings`` of every vector whose id is divisible by 50."""
    rows = common.only(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    vectors = rows.select("vec_id", quantise(F.col("embedding")).alias("v"))
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
