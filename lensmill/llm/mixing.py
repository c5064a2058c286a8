"""Mixing sources to target weights along a time-varying curriculum.

A source's schedule w(t) over training time 0..1 is piecewise linear. Its integral, scaled to the source's target,
is its cumulative token demand. The source's documents, in a hashed order, lie end to end on a tape that repeats
(at most ``max_repeats`` times); a document copy whose midpoint lies within the target is taken, and its training
position is the time at which the demand reaches that midpoint. Documents are range-sorted by first position.

Targets: the total is shared by weight; no target exceeds max_repeats times its source's size, and what is left over
is shared by weight among the others until none is above (water filling, solved in closed form over sorted ratios).

Everything is DataFrame functions. Tapes are cut into sampled ranges down to single rows, so that a source or an id with
a third of all rows is summed by many tasks; only the ranges' sums are put in order.

Defined results: null text has size 0; sources are ordered by code point, null last, and a null source is a source;
a source of size 0 has target 0 and its documents take nothing; documents of size 0 take 0; rows that are equal in
every column are numbered apart, so each takes its own share; an empty table gives an empty result; other columns are
dropped, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import materialise, numbered, release, running, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a range of the tapes; there are as many ranges as shuffle partitions at least and MAX_RANGES at most.
BUCKET_ROWS, MAX_RANGES = 20_000, 20_000
#: Schedules as (time, weight) knots, taken in turn by sources: falling, level, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, pick, mark: one scan of the texts; pick is the hashed order (first 60 bits of MD5 of the id)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return own.select("doc_id", "source", *tape_key("doc_id", "text"))


def tape_key(id_col: str, text_col: str) -> list[Column]:
    """size, pick, mark: a source's rows lie on its tape by pick, id, size and mark; repeated rows, by their numbers."""
    pick = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return [size.alias("size"), pick.alias("pick"), F.xxhash64(text_col).alias("mark")]


def targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """source, place, weight, source_size, tape_start, target of each source.

    Sources are put in order by ranges, first by name, then by the ratio of cap and weight, so there may be millions.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = running(sums, [F.col("source").asc_nulls_last()], {"tape_start": "source_size"}, "mix-places").withColumnRenamed("nth", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = running(s, ["ratio", "place"], {"caps_before": "cap", "weight_before": "weight"}, "mix-ratios").drop("nth")
    whole = s.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))
    s = s.crossJoin(F.broadcast(whole))  # one row
    # The level if this source and those of larger ratio are not held back; the first that stays within its cap sets it.
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before"))
    s = s.withColumn("level", level)
    held = s.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct("ratio", "place")).alias("water"))
    s = s.crossJoin(F.broadcast(held))  # one row
    target = F.least(F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return s.select("source", "place", "weight", "source_size", "tape_start", target.alias("target"))


def inverse_demand(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source has been asked for ``share`` (0..1) of its target."""
    out = None
    for i, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        asked, time = share * sum(areas), F.lit(float(knots[-1][0]))
        for k in reversed(range(len(areas))):
            (t0, w0), (t1, w1) = knots[k], knots[k + 1]
            slope, rest = (w1 - w0) / (t1 - t0), asked - sum(areas[:k])
            # rest = w0 d + slope d^2 / 2, written so that it holds for slope 0
            d = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
            time = F.when(asked <= sum(areas[: k + 1]), t0 + F.coalesce(d, F.lit(0.0))).otherwise(time)
        out = F.when(place % len(schedules) == i, time) if out is None else out.when(place % len(schedules) == i, time)
    return out


def laid_out(rows: DataFrame, goals: DataFrame, max_repeats: int) -> DataFrame:
    """rows of sized() and row_at with source_size, target, place, middle (of the first copy on the tape) and copies.

    All tapes are put in order as one, one source after the other, and cut into ranges wherever rows are many, also
    inside a source, an id or a group of repeated rows.
    """
    goal = goals.select(F.col("source").alias("own_source"), "place", "source_size", "target", "tape_start")
    named = rows.join(goal, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")
    ranges = int(min(MAX_RANGES, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET_ROWS)))
    tape = running(named, ["place", "pick", "doc_id", "size", "mark", "row_at"], {"before": "size"}, "mix-tape", ranges)
    middle = F.col("before") - F.col("tape_start") + F.col("size") / 2
    copies = F.when((F.col("size") == 0) | (F.col("source_size") == 0), 0).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(max_repeats), F.floor((F.col("target") - middle) / F.col("source_size")) + 1))
    )
    return tape.withColumn("middle", middle).withColumn("copies", copies.cast("int"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, schedules=SCHEDULES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, position; range-sorted by position.

    position is the training time of the first copy (null if none is taken), later copies follow by the same rule.
    """
    rows = numbered(sized(docs, id_col, text_col, source_col), "mix-sizes")
    out = laid_out(rows, materialise(targets(rows, weights, max_repeats), "mix-targets"), max_repeats)
    position = F.when(F.col("copies") > 0, inverse_demand(F.col("middle") / F.col("target"), F.col("place"), schedules))
    out = out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), position.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def apply(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, schedules=SCHEDULES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", position_col: str | None = None,
) -> DataFrame:
    """docs with each row as often as the mix takes it, range-sorted by each copy's own training position.

    The k-th copy lies k - 1 source sizes further on the tape than the first. The places are found without texts; then
    texts are joined to them by row number and sorted, so docs is stored with its numbers first. position_col names a
    column for the positions, if they are wanted.
    """
    columns, own = docs.columns, [f"c_{i}" for i in range(len(docs.columns))]
    id_at, text_at, source_at = (own[columns.index(c)] for c in (id_col, text_col, source_col))
    since = written()
    docs = numbered(docs.toDF(*own), "mix-docs")
    rows = docs.select(F.col(id_at).alias("doc_id"), F.col(source_at).cast("string").alias("source"), "row_at", *tape_key(id_at, text_at))
    rows = materialise(rows, "mix-sizes")
    goals = materialise(targets(rows, weights, max_repeats), "mix-targets")
    taken = laid_out(rows, goals, max_repeats).where("copies > 0").select(F.col("row_at").alias("taken_at"), "place", "middle", "source_size", "target", "copies")
    taken = materialise(taken, "mix-copies")
    release(docs.sparkSession, since, (docs, taken))
    copies = docs.join(taken.hint("merge"), F.col("row_at") == F.col("taken_at")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    share = (F.col("middle") + (F.col("copy") - 1) * F.col("source_size")) / F.col("target")
    out = copies.withColumn("position", inverse_demand(share, F.col("place"), schedules)).select(*own, "position", "copy")
    out = out.orderBy("position", id_at, "copy").select(*own, *["position"] * (position_col is not None))
    return out.toDF(*columns, *[position_col] * (position_col is not None))


__all__ = ["apply", "inverse_demand", "mix", "sized", "targets"]
