"""Distributed connected components: forests of shares of the links, then alternating large-star and small-star rounds
(Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lensmill.llm.common import materialise

#: Parts that the links of one node are dealt out to.
SPREAD = 64
#: Links that one task contracts to a forest.
SHARE = 1 << 20


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the smallest member for each component of the links a-b among 0..n-1: at most n - 1 links."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    own = np.flatnonzero(root != np.arange(n))
    return root[own], own


def with_least(df: DataFrame, key: str, value: str, spread: str) -> DataFrame:
    """df and ``m``, the least ``value`` of each key, where no key's rows meet in one task.

    A key's rows are dealt out by a hash of ``spread``: at most SPREAD partial minima a key are put together, and each
    goes back to its own part of the rows.
    """
    salted = df.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SPREAD)))
    partial = salted.groupBy(F.col(key).alias("k"), F.col("salt").alias("s")).agg(F.min(value).alias("part_m"))
    total = partial.groupBy(F.col("k").alias("k_all")).agg(F.min("part_m").alias("m"))
    least = partial.join(total, F.col("k") == F.col("k_all")).select("k", "s", "m")
    return salted.join(least, (F.col(key) == F.col("k")) & (F.col("salt") == F.col("s"))).drop("k", "s", "salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large star) or smaller (small star) neighbours to its smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    joined = with_least(both, "a", "b", "b").withColumn("m", F.least("a", "m"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where(F.col("a") > F.col("b")).distinct()


def contracted(links: DataFrame, parts: int) -> DataFrame:
    """A forest of the links of each of ``parts`` equal shares of links(a, b), by signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if not held:
            return
        a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        low, high = forest(len(nodes), place[: len(a)], place[len(a) :])
        for at in range(0, len(low), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[high[at : at + (1 << 16)]]), pa.array(nodes[low[at : at + (1 << 16)]])], names=["a", "b"])

    return links.select("a", "b").repartition(parts).mapInArrow(run, "a bigint, b bigint")


def smallest_reachable(links: DataFrame, max_rounds: int = 60, share: int = SHARE) -> DataFrame:
    """node, root for every node of links(a, b); root is the smallest node it reaches.

    Shares of at most ``share`` links are first contracted to forests, each in a task. If there was one share, that is
    the result; otherwise stars are alternated over the forests, each round written out, until nothing changes.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    edges, (n, _) = _counted(edges)
    parts = max(1, -(-n // share))
    edges, state = _counted(contracted(edges, parts))
    for _ in range(max_rounds if parts > 1 else 0):
        edges, now = _counted(_star(_star(edges, True), False))
        if now == state:
            break
        state = now
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges written out, with their number and a sum of their hashes, both taken while they are written."""
    seen = Observation()
    out = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "cc")
    found = seen.get
    return out, (found["n"], found["h"])
