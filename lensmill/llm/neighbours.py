"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact verification, components.

1. Equal vectors become one node with a number of copies, so a group of copies is compared once.
2. The signs of a node's products with hyperplanes are taken once. A table's code is some of them; SIGNATURE of them are
   the node's signature. Codes and signatures are shuffled, vectors are not: nodes that meet in a bucket of a table are
   candidates if their signatures differ in few enough bits. Buckets are walked in blocks that return forests, see
   simhash.met(), so none is capped and a group of near copies gives no quadratic output.
3. Candidates fall into groups. The vectors of a group of up to GROUP nodes meet in one task, which compares all its
   pairs by exact cosine in double precision. Nodes of larger groups are filed under each table's code again, with
   their vectors, and compared bucket by bucket; there a pair counts in the first table it meets in, by the codes that
   were taken once, so no link counts twice.
4. Components come from forests of the exact links.

With b bits and t tables a pair at angle x meets with probability 1 - (1 - (1 - x / pi)^b)^t. The bits follow from the
number of nodes (buckets of some 1,000 unrelated ones, as comparing signatures is cheap), the tables from the recall
asked for at the threshold itself (0.995 unless told otherwise; nearer pairs are found more surely). The signatures of a
pair at the threshold differ by more than the limit with a chance of 1 in 30,000.

Defined results: null, empty and zero vectors, and those with null or non-finite components, link with nothing and
are their own component; vectors of different lengths do not link; equal vectors are rows of their own and link;
a null id is left out of components (component null) but its row is returned; rows that repeat an id are one vector
each, and link if they are alike; other columns are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import materialise
from lensmill.llm.components import forest, smallest_reachable, with_least
from lensmill.llm.simhash import met

BLOCK, SEED, SIGNATURE, GROUP = 1024, 20240229, 192, 4096
_SIGNS = [f"s{k}" for k in range(SIGNATURE // 64)]


def design(n: int, threshold: float, recall: float = 0.995, bucket: int = 1000) -> tuple[int, int]:
    """Bits and tables for n vectors."""
    bits = max(4, math.ceil(math.log2(max(2, n) / bucket)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def sign_limit(threshold: float) -> int:
    """Bits of SIGNATURE in which a pair at the threshold differs at most, up to four standard deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SIGNATURE * p + 4 * math.sqrt(SIGNATURE * p * (1 - p)))


@lru_cache(8)
def hyperplanes(dimensions: int, n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, n))


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that tiny and huge ones keep their direction."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, dim, codes array<int> (one a table) and the signature of each of nodes(node, dim, v); no shuffle."""
    schema = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("codes", pa.list_(pa.int32())), *[(s, pa.int64()) for s in _SIGNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                dim = part.column(1).to_numpy(zero_copy_only=False)
                for d in np.unique(dim):
                    own = part.filter(pa.array(dim == d))
                    x = unit(own.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
                    signs = x @ hyperplanes(int(d), max(SIGNATURE, bits * tables)) > 0
                    codes = (signs[:, : bits * tables].reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)
                    prints = np.packbits(signs[:, :SIGNATURE], axis=1).view(">i8").astype(np.int64)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), listed, *[pa.array(np.ascontiguousarray(c)) for c in prints.T]], schema=schema)

    return nodes.select("node", "dim", "v").mapInArrow(run, f"node bigint, dim int, codes array<int>, {', '.join(f'{s} bigint' for s in _SIGNS)}")


def candidates(signs: DataFrame, threshold: float) -> DataFrame:
    """node, root of the nodes of signed() that any table and their signatures bring together."""
    places = signs.select("node", "dim", *_SIGNS, F.posexplode("codes").alias("tab", "code"))
    buckets = places.select("node", *_SIGNS, F.xxhash64("dim", "tab", "code").alias("bucket"), F.lit(True).alias("own"))
    return smallest_reachable(materialise(met(buckets, sign_limit(threshold)), "vector-candidates"))


_FOUND = "kind int, a bigint, b bigint"


def _found(node: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """kind 0: node a links to b others here; kind 1: a and b are linked."""
    linked = np.flatnonzero(count)
    if not len(linked):
        return None
    kinds = np.concatenate([np.zeros(len(linked), np.int32), np.ones(len(a), np.int32)])
    columns = [kinds, np.concatenate([node[linked], node[a]]), np.concatenate([count[linked].astype(np.int64), node[b]])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, work) -> Iterator[pa.RecordBatch]:
    """work(key, columns after the keys) for each run of rows equal in the first ``keys`` columns; the last is a list column."""
    now, held = None, []

    def flush():
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return work(now, columns) if len(columns[0]) > 1 else None

    for batch in batches:
        if not batch.num_rows:
            continue
        key_of = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)], axis=1)
        for piece in np.split(np.arange(len(key_of)), np.flatnonzero((np.diff(key_of, axis=0) != 0).any(axis=1)) + 1):
            key = tuple(key_of[piece[0]].tolist())
            if key != now and held:
                if (found := flush()) is not None:
                    yield found
                held = []
            now, part = key, batch.slice(int(piece[0]), len(piece))
            lists = {i: part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1) for i in range(keys, part.num_columns) if pa.types.is_list(part.column(i).type)}
            held.append([lists[i] if i in lists else part.column(i).to_numpy(zero_copy_only=False) for i in range(keys, part.num_columns)])
    if held and (found := flush()) is not None:
        yield found


def group_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links within each group of members(root, dim, node, copies, v), all of whose pairs are compared in one task."""

    def compared(key: tuple, columns: list[np.ndarray]) -> pa.RecordBatch | None:
        node, copies, x = columns
        x, count, a, b = unit(x.astype(np.float64)), np.zeros(len(node)), [], []
        for at in range(0, len(x), 512):
            near = x[at : at + 512] @ x.T >= threshold
            near[np.arange(len(near)), at + np.arange(len(near))] = False
            count[at : at + 512] = near @ copies
            i, j = np.nonzero(near)
            own = forest(len(x), i + at, j)
            a.append(own[0])
            b.append(own[1])
        return _found(node, count, *forest(len(x), np.concatenate(a), np.concatenate(b)))

    rows = members.select("root", "dim", "node", "copies", "v").repartition("root", "dim").sortWithinPartitions("root", "dim")
    return rows.mapInArrow(lambda batches: _grouped(batches, 2, compared), _FOUND)


def bucket_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links among members(node, dim, codes, copies, v) that meet in a bucket of some table, each in the first one."""
    placed = members.select("node", "dim", "copies", "codes", "v", F.posexplode("codes").alias("tab", "code"))
    sizes = members.select("dim", F.posexplode("codes").alias("tab", "code")).groupBy("dim", "tab", "code").count().where("count > 1")
    dealt = placed.join(sizes, ["dim", "tab", "code"])
    dealt = dealt.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("x"), F.greatest(j, F.col("block")).alias("y")))
    dealt = dealt.select("dim", "tab", "code", F.explode(pairs).alias("xy"), "block", "node", "copies", "codes", "v").select("dim", "tab", "code", "xy.x", "xy.y", "block", "node", "copies", "codes", "v")

    def compared(key: tuple, columns: list[np.ndarray]) -> pa.RecordBatch | None:
        _, tab, _, bx, by = key
        block, node, copies, codes, x = columns
        x, count, a, b = unit(x.astype(np.float64)), np.zeros(len(node)), [], []
        for at in range(0, len(x), 512):
            i, j = np.nonzero(x[at : at + 512] @ x.T >= threshold)
            i += at
            keep = (i < j) & (np.minimum(block[i], block[j]) == bx) & (np.maximum(block[i], block[j]) == by)
            i, j = i[keep], j[keep]
            for c in codes[:, :tab].T:
                fresh = c[i] != c[j]
                i, j = i[fresh], j[fresh]
            count += np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            own = forest(len(x), i, j)
            a.append(own[0])
            b.append(own[1])
        return _found(node, count, *forest(len(x), np.concatenate(a), np.concatenate(b)))

    keys = ("dim", "tab", "code", "x", "y")
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _grouped(batches, 5, compared), _FOUND)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.995, group: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    # Equal vectors share 128 bits of hashes.
    marks = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2")]
    rows = materialise(rows.select("vec_id", "v", F.coalesce(ok, F.lit(False)).alias("usable"), F.monotonically_increasing_id().alias("uid"), *marks), "vectors")
    whole = rows.where("usable").groupBy("h1", "h2").agg(F.min("uid").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialise(whole, "vector-nodes")
    bits, tables = design(nodes.count(), threshold, recall)
    # A node's vector is that of its first row, so vectors need no grouping.
    vectors = rows.where("usable").select(F.col("uid").alias("vid"), F.size("v").alias("dim"), "v")
    first = vectors.join(nodes.select("node", "copies"), F.col("vid") == F.col("node")).select("node", "dim", "copies", "v")
    signs = materialise(signed(first, bits, tables), "vector-signs")
    reached = candidates(signs, threshold)
    sizes = reached.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n"))
    placed = reached.join(sizes, F.col("root") == F.col("r")).select(F.col("node").alias("own"), "root", (F.col("n") > group).alias("large"))
    members = materialise(first.join(placed, F.col("node") == F.col("own")).drop("own"), "vector-members")
    codes = signs.select(F.col("node").alias("coded"), "codes")
    large = members.where("large").join(codes, F.col("node") == F.col("coded")).select("node", "dim", "codes", "copies", "v")
    found = materialise(group_links(members.where("NOT large"), threshold).unionAll(bucket_links(large, threshold)), "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("counted")).agg(F.sum("b").alias("others"))
    linked = smallest_reachable(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "own")
    named = nodes.join(linked, F.col("node") == F.col("own"), "left").select("h1", "h2", "node", "copies", "least", F.coalesce("root", "node").alias("root"))
    named = with_least(named, "root", "least", "node").join(counts, F.col("node") == F.col("counted"), "left")
    named = named.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "m", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("vec_id", "usable", "h1", "h2").join(named, F.col("usable") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("usable"), F.col("m")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


__all__ = ["design", "hyperplanes", "near_duplicates", "unit"]
