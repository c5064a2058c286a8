"""Conversation prefix trie: nodes are the distinct beginnings of conversations, totals of subtrees come by peeling leaves.

A beginning is known by 128 bits: each turn is hashed with its position, and the hashes of the turns so far are XORed.
That sum is associative, so it is taken over range partitions and a conversation of any length is never one task.

Nodes on one path with equal numbers of members have equal members: they are one chain, named by its smallest member
and that number. Chains of one member are leaves at once. Every other chain waits with a counter of the children below
its last node; a chain whose counter reaches 0 is complete and sends its totals to the chain above, round by round,
until the root's chain is complete. There are as many rounds as branchings on the longest path.

Defined results: turns are ordered by turn (null first), then by the MD5 of role and text, so that repeated rows tie
only with their equals; null role and text are empty; rows without conv_id belong to no conversation; a conversation
without turns is a member of the root; an empty table has no nodes; other columns are dropped, so clashing names do no
harm. Two beginnings of equal length are taken for equal if 128 bits agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.llm.common import materialise, rows_of, running, to_batch

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations with one host, and the most turns that one takes from it.
HOSTED, MOST_GIVEN = 20, 3
_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _place(position: Column, a: Column, b: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at a position."""
    return [F.xxhash64(position.cast("long"), a, b), F.xxhash64(b, a, position.cast("long"))]


def turns_of(conversations: DataFrame) -> DataFrame:
    """c, part, pos (from 1), a, b, words of each turn; part: the range partition of its place in the order of all turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    own = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), half(1).alias("a"), half(16).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    own = own.withColumn("at", F.monotonically_increasing_id())
    order = ("c", F.col("turn").asc_nulls_first(), "a", "b", "at")
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(own.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "turns")
    starts = ranged.groupBy("part", "c").agg(F.count("*").alias("n_in"))
    ahead = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", "c", F.coalesce(F.sum("n_in").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("part", "c").orderBy(*order[1:])
    placed = ranged.withColumn("nth", F.row_number().over(within)).join(starts, ["part", "c"])
    return materialise(placed.select("c", "part", (F.col("nth") + F.col("start")).alias("pos"), "a", "b", "words"), "placed-turns")


def hosts(turns: DataFrame) -> DataFrame:
    """c, h, given (up to h turns of its host), k = size(given), last (its number of turns when rebuilt)."""
    # A host gives three turns at most, so the list is bounded.
    heads = turns.where((F.col("c") % HOSTED == 0) & (F.col("pos") <= MOST_GIVEN)).groupBy(F.col("c").alias("host")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head"))
    own = turns.groupBy("c").agg(F.max("pos").alias("n_own")).withColumn("h", (F.crc32(F.col("c").cast("string").cast("binary")) % 4).cast("int"))
    own = own.join(heads, F.col("c") - F.col("c") % HOSTED == F.col("host"), "left")
    given = F.when(F.col("host").isNotNull(), F.slice("head", F.lit(1), F.col("h")))
    own = own.select("c", "h", "n_own", F.coalesce(given, F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,words:bigint>>")).alias("given")).withColumn("k", F.size("given"))
    return own.withColumn("last", F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))


def beginnings(turns: DataFrame) -> DataFrame:
    """c, depth, k1, k2 (the key of its first depth turns), p1, p2 (of one turn less), words of the last turn, ends."""
    info = materialise(hosts(turns), "hosts")
    hashed = F.transform("given", lambda g, j: F.struct(*_place(j + 1, g["a"], g["b"])))
    info = info.withColumn("hashed", hashed).withColumns({"x1": F.col("hashed.col1"), "x2": F.col("hashed.col2")})
    xor = lambda x, upto: F.aggregate(F.slice(x, F.lit(1), upto), F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v))
    root = info.select("c", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(x) for x in ("k1", "k2")], *[F.lit(None).cast("long").alias(x) for x in ("p1", "p2")], F.lit(0).cast("long").alias("words"), (F.col("last") == 0).alias("ends"))
    given = info.select("c", "last", "x1", "x2", F.posexplode("given").alias("j", "g"))
    given = given.select(
        "c", (F.col("j") + 1).cast("long").alias("depth"), *[xor(f"x{i}", F.col("j") + 1).alias(f"k{i}") for i in (1, 2)], *[xor(f"x{i}", F.col("j")).alias(f"p{i}") for i in (1, 2)],
        "g.words", (F.col("last") == F.col("j") + 1).alias("ends"),
    )
    about = info.select("c", "h", "k", "last", xor("x1", F.size("x1")).alias("g1"), xor("x2", F.size("x2")).alias("g2"))
    own = turns.join(about, "c").where(F.col("pos") > F.col("h")).withColumn("depth", F.col("k") + F.col("pos") - F.col("h"))
    for i in (0, 1):
        own = own.withColumn(f"x{i + 1}", _place(F.col("depth"), F.col("a"), F.col("b"))[i])
    own = materialise(own.select("c", "part", "depth", "words", "x1", "x2", "g1", "g2", (F.col("depth") == F.col("last")).alias("ends")), "own-turns")
    ahead = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("part", "c").agg(F.bit_xor("x1").alias("a1"), F.bit_xor("x2").alias("a2"))
    parts = parts.select("part", "c", *[F.coalesce(F.bit_xor(f"a{i}").over(ahead), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    so_far = Window.partitionBy("part", "c").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"k{i}": F.bit_xor(f"x{i}").over(so_far).bitwiseXOR(F.col(f"g{i}")) for i in (1, 2)}).join(parts, ["part", "c"])
    own = own.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    own = own.select("c", "depth", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)], "words", "ends")
    return materialise(root.unionByName(given).unionByName(own), "beginnings")


def linked_nodes(occurrences: DataFrame) -> DataFrame:
    """A row a node: its key, smallest member, number of members and children, its parent's smallest member and number."""
    nodes = occurrences.groupBy("depth", "k1", "k2").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max("words").alias("words"))
    nodes = materialise(nodes, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    own = nodes.join(below, ["depth", "k1", "k2"], "left").join(above, ["depth", "p1", "p2"], "left")
    own = own.select("conv_id", "depth", "k1", "k2", "parent_conv_id", "parent_n", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    return materialise(own, "linked-nodes")


def peeled(chains: DataFrame, messages: DataFrame) -> DataFrame:
    """chains with n_leaves and below (what the subtrees under their last nodes save), found by rounds of messages.

    chains: conv_id, n_convs, parent_conv_id, parent_n, remaining (children it waits for). messages: to_conv, to_n, leaves,
    saved of children that are complete from the start. A chain that is complete sends leaves, and what it and all below it save.
    """
    waiting, done = chains.withColumns({"n_leaves": F.when(F.col("remaining") == 0, 1).otherwise(0).cast("long"), "below": F.lit(0).cast("long")}), []
    while True:
        got = messages.groupBy(F.col("to_conv").alias("conv_id"), F.col("to_n").alias("n_convs")).agg(F.count("*").alias("came"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_below"))
        state = waiting.join(got, ["conv_id", "n_convs"], "left").withColumns({
            "remaining": F.col("remaining") - F.coalesce("came", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("leaves", F.lit(0)), "below": F.col("below") + F.coalesce("saved_below", F.lit(0)),
        }).drop("came", "leaves", "saved_below")
        state = materialise(state, "peeling")
        complete, waiting = state.where("remaining = 0"), state.where("remaining > 0")
        done.append(complete)
        if waiting.isEmpty():
            break
        messages = complete.where(F.col("parent_n").isNotNull()).select(F.col("parent_conv_id").alias("to_conv"), F.col("parent_n").alias("to_n"), F.col("n_leaves").alias("leaves"), (F.col("saved") + F.col("below")).alias("saved"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, whose pieces come in order; one running digest is all that is held."""
    now, sha = None, None
    for batch in batches:
        out = []
        for *key, piece in rows_of(batch, "depth", "k1", "k2", "piece"):
            if key != now:
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(piece.encode())
            else:
                sha.update(f",{piece}".encode())
        yield to_batch(_ENDS, list(zip(*out, strict=True)) if out else [[]] * 4)
    if now:
        yield to_batch(_ENDS, [[x] for x in (*now, sha.hexdigest())])


def ends(occurrences: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of each node at which conversations end; ids are joined range by range before they are hashed."""
    n = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = occurrences.where("ends").select("depth", "k1", "k2", "c").repartitionByRange(n, "depth", "k1", "k2", "c").withColumn("part", F.spark_partition_id())
    pieces = last.groupBy("part", "depth", "k1", "k2").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("piece"))
    return pieces.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "part").mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    occurrences = beginnings(turns_of(conversations))
    nodes = linked_nodes(occurrences)
    single = F.col("n_convs") == 1
    several = running(nodes.where(~single).select("conv_id", "n_convs", "depth", "parent_conv_id", "parent_n", "n_children", "own"), ["conv_id", F.desc("n_convs"), "depth"], {"before": "own"}, "chains")
    several = materialise(several, "chains-in-order")
    chains = several.groupBy("conv_id", "n_convs").agg(
        F.min_by("parent_conv_id", "depth").alias("parent_conv_id"), F.min_by("parent_n", "depth").alias("parent_n"), F.max_by("n_children", "depth").alias("remaining"),
        F.sum("own").alias("saved"), F.min("before").alias("first"),
    )
    tops = nodes.where(single & (F.col("parent_n") > 1))
    found = peeled(chains, tops.select(F.col("parent_conv_id").alias("to_conv"), F.col("parent_n").alias("to_n"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    totals = several.select("conv_id", "n_convs", "depth", "before").join(found.select("conv_id", "n_convs", "n_leaves", "below", "saved", "first"), ["conv_id", "n_convs"])
    totals = totals.select("conv_id", "depth", "n_leaves", (F.col("below") + F.col("saved") - (F.col("before") - F.col("first"))).alias("saved_tokens"))
    shared = nodes.where(~single).join(totals, ["conv_id", "depth"])
    alone = nodes.where(single).withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    nothing = hashlib.sha256(b"").hexdigest()
    out = shared.unionByName(alone).join(ends(occurrences), ["depth", "k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
