"""Connected components of a link table: links are contracted where they lie, then large-star and small-star steps alternate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydf.llm.common import attach, discard, materialize, ship

#: Links that a task gets at least, if there are as many, and that it contracts at once.
TOGETHER, AT_ONCE = 1 << 14, 1 << 17


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Links from each node to the smallest node that these links connect it with (disjoint sets, paths halved)."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    nodes = [x for x, up in above.items() if x != up]
    return nodes, [top(x) for x in nodes]


def contracted(links: DataFrame, n: int) -> DataFrame:
    """Links that connect what the ``n`` links of ``links`` connect, with shorter chains: each task makes stars of what it holds.

    There is a task for every ``TOGETHER`` links, but no more than the table has parts, and a task holds ``AT_ONCE`` links at a time and one batch.
    """
    ship(links.sparkSession)

    def run(batches):
        held, size = [], 0

        def made():
            u, v = stars(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
            size += batch.num_rows
            if size >= AT_ONCE:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    return links.select("u", "v").coalesce(max(1, -(-n // TOGETHER))).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: for every node of ``links`` (long columns ``u`` and ``v``) the smallest node that it reaches.

    Self-links and repeated links do no harm; nulls are dropped; an empty table gives an empty one. Links that one task holds are
    made stars first, which saves rounds. Each round is a few
    joins and partial aggregates on node keys, written to the shared folder, so a lost executor repeats one round at
    most. A node with very many links is one row of an aggregate, which its links meet by broadcast. The number of
    rounds grows with the logarithm of the longest chain; rounds end when nothing changes.
    """
    ordered = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    given = materialize(ordered, "links")
    edges = materialize(contracted(given, given.count()).distinct(), "links")
    discard(given)
    before = _state(edges)
    while True:
        # large star: the larger neighbours of a node are linked to the smallest node around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = materialize(attach(both, least, ["u"], 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # small star: a node and its smaller neighbours are linked to the smallest of these
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = attach(large, lowest, ["u"], 2 * before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "links")
        now = _state(after)
        discard(edges)
        discard(large)
        edges = after
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
