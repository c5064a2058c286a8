"""Sharding by sampled splitters: near-equal bytes, equal texts side by side.

Records are ordered by a key (60 bits of the text's MD5), then id, then a row number. A sample of records, drawn with
probability in proportion to size, gives splitters at its quantiles; they cut the order into ranges of similar bytes,
also inside a group of equal texts or of rows that repeat a text and an id. Ranges are measured, and any that turned out
overfull is sampled again and subdivided. Exact byte sums of the ranges and running sums inside them give each record its
place on the line of all bytes, and the line is cut into shards of equal length: a record goes where its middle lies. A
group of equal texts that a cut divides stays whole in the shard of its middle unless it holds more than ``whole`` of
a shard.

The driver holds the splitters (at most MAX_RANGES at first, and the parts of overfull ranges), nothing else.

Defined results: null text has size 16, crc32 of no bytes (0), and is grouped with the empty text; records equal in text
and id are told apart by an arbitrary row number, null ids come first; slots follow that order within a shard and have no
gap; an empty table gives an empty result; other columns are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.llm.common import materialise

RANGE_ROWS, MAX_RANGES, SAMPLES_PER_RANGE, OVERHEAD = 20_000, 20_000, 20, 16
#: A range of more than this times the wanted rows is cut again, at most so many times.
OVERFULL, ROUNDS = 2, 3
ORDER = ["key", "id", "uid"]
_KEY = np.dtype([(c, "i8") for c in ORDER])


def drawn(rows: DataFrame, chance: Column, salt: int, *columns: str) -> pd.DataFrame:
    """The order columns and w of rows drawn by chance (w where it is over 1), in order; by hash, so reruns agree."""
    kept = (F.pmod(F.xxhash64(*ORDER, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)) < chance
    return rows.where(kept).select(*ORDER, *columns, F.greatest(chance, F.lit(1.0)).alias("w")).toPandas().sort_values(ORDER)


def quantiles(sample: pd.DataFrame, pieces: int) -> list[tuple[int, ...]]:
    """At most pieces - 1 splitters at the quantiles of a sample in order."""
    if sample.empty or pieces < 2:
        return []
    place = np.cumsum(sample.w.to_numpy()) / sample.w.sum()
    at = np.searchsorted(place, np.arange(1, pieces) / pieces)
    return list(sample[ORDER].iloc[at[at < len(sample)]].itertuples(index=False, name=None))


def splitters(rows: DataFrame, total: int, n: int) -> list[tuple[int, ...]]:
    """Splitters of rows(key, id, uid, size) into ranges of similar bytes, the overfull of which are cut again."""
    ranges = int(min(MAX_RANGES, max(1, n // RANGE_ROWS)))
    wanted = max(RANGE_ROWS, n / ranges)
    cuts = sorted(set(quantiles(drawn(rows, F.col("size") * F.lit(ranges * SAMPLES_PER_RANGE / max(1, total)), 1), ranges)))
    for k in range(ROUNDS):
        placed = ranged(rows, cuts)
        sizes = placed.groupBy("rng").agg(F.count("*").alias("n_in"), F.sum("size").alias("bytes_in"))
        full = sizes.where(F.col("n_in") > OVERFULL * wanted).withColumn("pieces", F.ceil(F.col("n_in") / wanted))
        full = full.select(F.col("rng").alias("full"), "pieces", "bytes_in")
        # A range a row: as many as there are splitters at most.
        inside = placed.join(F.broadcast(full), F.col("rng") == F.col("full"))
        again = drawn(inside, F.col("size") * F.col("pieces") * SAMPLES_PER_RANGE / F.col("bytes_in"), k + 2, "rng", "pieces")
        more = [c for _, own in again.groupby("rng", sort=True) for c in quantiles(own, int(own.pieces.iloc[0]))]
        if not set(more) - set(cuts):
            break
        cuts = sorted({*cuts, *more})
    return cuts


def ranged(rows: DataFrame, cuts: list[tuple[int, ...]]) -> DataFrame:
    """Adds ``rng``, the number of splitters at or below a record, by binary search over Arrow batches."""
    held = np.array(cuts, _KEY)

    @F.pandas_udf("int")
    def place(key: pd.Series, id_: pd.Series, uid: pd.Series) -> pd.Series:
        x = np.empty(len(key), _KEY)
        x["key"], x["id"], x["uid"] = key, id_, uid
        return pd.Series(np.searchsorted(held, x, side="right").astype("int32"))

    return rows.withColumn("rng", place(*ORDER))


def shard(
    df: DataFrame, shards: int = 40, whole: float = 0.1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null) of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = materialise(scanned, "shard-rows")
    sums = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    if not sums.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    placed = ranged(rows, splitters(rows.select(*ORDER, "size"), sums.total, sums.n))
    in_range = Window.partitionBy("rng").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    walked = placed.withColumn("end_in", F.sum("size").over(in_range)).withColumn("nth_in", F.row_number().over(in_range))
    per_range = placed.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range, as many as splitters.
    offsets = per_range.select(F.col("rng").alias("r"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("n0"))
    line = walked.join(F.broadcast(offsets), F.col("rng") == F.col("r"))
    capacity = sums.total / shards
    middle = (F.col("b0") + F.col("end_in") - F.col("size") / 2) / capacity
    line = line.select("doc_id", "size", "text_crc32", "key", (F.col("n0") + F.col("nth_in") - 1).alias("nth"), (F.col("b0") + F.col("end_in")).alias("end"), F.least(F.floor(middle), F.lit(shards - 1)).cast("int").alias("shard"))
    line = materialise(line, "shard-line")
    groups = line.groupBy("key").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.min(F.col("end") - F.col("size")).alias("start"), F.max("end").alias("stop"))
    divided = groups.where((F.col("lo") < F.col("hi")) & (F.col("stop") - F.col("start") <= whole * capacity))
    # A cut divides one group at most, so there are fewer of these than shards.
    moved = divided.select(F.col("key").alias("k"), F.least(F.floor((F.col("start") + F.col("stop")) / 2 / capacity), F.lit(shards - 1)).cast("int").alias("kept_in"))
    line = line.join(F.broadcast(moved), F.col("key") == F.col("k"), "left").withColumn("shard", F.coalesce("kept_in", "shard"))
    firsts = line.groupBy("shard").agg(F.min("nth").alias("first")).select(F.col("shard").alias("s"), "first")
    out = line.join(F.broadcast(firsts), F.col("shard") == F.col("s"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
