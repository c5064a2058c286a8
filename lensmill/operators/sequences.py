"""Order-dependent operators over sessions, in batch: throttle, stability gate, latest state, as-of quad, motion."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain as chained

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lensmill.sources.stored import in_blocks

TRANSITIONS = ("processing", "completed", "failed", "reset")


def nullable(field: StructField) -> StructField:
    """A field of the same type, all of whose parts may be null, as those of a missing struct are."""
    return StructField(field.name, StructType.fromDDL(f"x {field.dataType.simpleString()}").fields[0].dataType)


def throttle(frames: DataFrame, interval_ms: int = 66, session: str = "session_id", ts: str = "timestamp_ms", tie: str = "event_id") -> DataFrame:
    """Frames that are forwarded: each at least interval_ms after the one forwarded before it (at first: after 0).

    What is forwarded depends on what was, so a session is a fold in order of time. It streams through one task with
    the last forwarded time as its only state: a long session takes time there but no memory. Equal times go by tie, if there
    is such a column. throttle_in_blocks() divides long sessions.
    """
    schema = frames.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(session)).to_pylist()
            times = batch.column(batch.schema.get_field_index(ts)).to_pylist()
            keep = np.zeros(len(keys), bool)
            for i, (key, t) in enumerate(zip(keys, times, strict=True)):
                if key != now:
                    now, last = key, 0
                if t is not None and t - last >= interval_ms:
                    keep[i], last = True, t
            yield batch.filter(pa.array(keep))

    return frames.repartition(session).sortWithinPartitions(session, ts, *[c for c in (tie,) if c in frames.columns]).mapInArrow(run, schema)


def stability_gate(frames: DataFrame, window_ms: int = 1000) -> DataFrame:
    """Each frame's stage, progress and stable_since, and its session's captured_at (first time the gate fires).

    A run of valid frames is an island between invalid ones; progress is the time since its first frame over the
    window. From the capture on the stage stays capturing and progress 1, as further frames are ignored.
    """
    by = Window.partitionBy("session_id").orderBy("timestamp_ms", "event_id")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    valid = F.coalesce("is_valid", F.lit(False))
    out = frames.withColumn("island", F.sum(F.when(valid, 0).otherwise(1)).over(so_far))
    since = F.min(F.when(valid, F.col("timestamp_ms"))).over(Window.partitionBy("session_id", "island"))
    out = out.withColumn("stable_since", F.when(valid, since))
    out = out.withColumn("elapsed", F.col("timestamp_ms") - F.col("stable_since"))
    out = out.withColumn("captured_at", F.min(F.when(F.col("elapsed") >= window_ms, F.col("timestamp_ms"))).over(Window.partitionBy("session_id")))
    done = F.coalesce(F.col("timestamp_ms") >= F.col("captured_at"), F.lit(False))
    stage = F.when(done, "capturing").when(valid, "stabilizing").otherwise("idle")
    progress = F.when(done, 1.0).when(valid, F.least(F.lit(1.0), F.col("elapsed") / window_ms)).otherwise(0.0)
    return out.withColumns({"stage": stage, "stability_progress": progress}).drop("island", "elapsed")


def stage_changes(gated: DataFrame) -> DataFrame:
    """Rows at which a session's stage changes; it begins as idle."""
    by = Window.partitionBy("session_id").orderBy("timestamp_ms", "event_id")
    return gated.withColumn("before", F.coalesce(F.lag("stage").over(by), F.lit("idle"))).where(F.col("stage") != F.col("before")).drop("before")


def latest(frames: DataFrame, *values: str, session: str = "session_id") -> DataFrame:
    """The last values of each session: one aggregate, combined before the shuffle."""
    newest = F.max(F.struct("timestamp_ms", "event_id", *values)).alias("s")
    return frames.groupBy(session).agg(newest, F.count("*").alias("n_frames")).select(session, "s.*", "n_frames")


def tie_of(frames: DataFrame) -> Column:
    """What puts frames of equal times in order: event_id, where there is one."""
    return F.col("event_id").cast("long") if "event_id" in frames.columns else F.lit(0).cast("long")


def asof_quad(captures: DataFrame, frames: DataFrame) -> DataFrame:
    """captures(session_id, capture_id, timestamp_ms) with the quad of the last frame at or before; it may be null.

    One union and one window by session instead of a range join; frames at a capture's own time count. The quad is
    wrapped, so a frame without a quad differs from no frame.
    """
    a = frames.select("session_id", "timestamp_ms", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("capture_id"), F.struct(F.col("timestamp_ms").alias("frame_ms"), "quad").alias("seen"), tie_of(frames).alias("tie"))
    b = captures.select("session_id", "timestamp_ms", F.lit(1).alias("kind"), "capture_id", F.lit(None).cast(a.schema["seen"].dataType).alias("seen"), F.lit(0).cast("long").alias("tie"))
    by = Window.partitionBy("session_id").orderBy("timestamp_ms", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("seen", F.last("seen", ignorenulls=True).over(by)).where("kind = 1")
    return seen.select("session_id", "capture_id", "timestamp_ms", F.col("seen.frame_ms").alias("frame_ms"), F.col("seen.quad").alias("quad"))


def motion(thumbnails: DataFrame, keep: tuple[str, ...] = ("session_id", "event_id")) -> DataFrame:
    """The kept columns and motion_score of each thumbnail against its session's last one.

    thumbnails: session_id, event_id, timestamp_ms, thumb_width, thumb_height, gray (null: 0 and no reference) and what is
    kept. A session streams through one sorted partition; one thumbnail is the only state.
    """
    own = thumbnails.select(*dict.fromkeys((*keep, "session_id", "thumb_width", "thumb_height", "gray", "event_id", "timestamp_ms"))).withColumn("is_lent", F.lit(False))
    return _differences(own.repartition("session_id").sortWithinPartitions("session_id", "timestamp_ms", "event_id"), keep, ("session_id",))


def _differences(thumbnails: DataFrame, keep: tuple[str, ...], groups: tuple[str, ...]) -> DataFrame:
    """The kept columns and motion_score of thumbnails that come sorted by groups; a row with is_lent is only compared with."""
    from lensmill.streaming.capture import motions as differences

    schema = StructType([*(nullable(thumbnails.schema[c]) for c in keep), StructField("motion_score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, None
        for batch in batches:
            at, pairs, own_rows = {n: i for i, n in enumerate(batch.schema.names)}, [], []
            values = (batch.column(at[n]).to_pylist() for n in ("thumb_width", "thumb_height", "gray", "is_lent", *groups))
            for w, h, gray, is_lent, *group in zip(*values, strict=True):
                if group != now:
                    now, before = group, None
                own = (w, h, gray) if gray is not None else None
                own_rows.append(not is_lent)
                if not is_lent:
                    pairs.append((before, own))
                before = own
            kept = batch.filter(pa.array(own_rows, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(kept.column(at[c]).cast(arrow.field(c).type) for c in keep), pa.array(differences(pairs), pa.float64())], schema=arrow)

    return thumbnails.mapInArrow(run, schema)


def throttle_in_blocks(frames: DataFrame, interval_ms: int = 66, session: str = "session_id", ts: str = "timestamp_ms", tie: str = "event_id") -> DataFrame:
    """throttle(), where one session may hold any share of the frames.

    The order of all frames is cut into even blocks. What a block forwards depends only on the first frame that it
    forwards, and that is one of those in its first interval_ms: for each, the block says which frame it forwards last. These
    maps, a few rows a block, are chained; then every block is walked from its known start, all at once.
    """
    ranged = in_blocks(frames, session, ts, tie, tag="throttle")
    key = frames.schema[session].dataType
    maps_ddl = StructType([StructField("part", ranged.schema["part"].dataType), StructField(session, key), StructField("enters", LongType()), StructField("leaves", LongType())])
    maps_arrow = to_arrow_schema(maps_ddl)

    def maps_of(part, name, times: np.ndarray) -> Iterator[tuple]:
        follows = np.searchsorted(times, times + interval_ms).tolist()
        first = np.searchsorted(times, [times[0] + interval_ms, interval_ms])
        entries = {*range(min(int(first[0]) + 1, len(times))), *([int(first[1])] if first[1] < len(times) else [])}
        seen: dict[int, int] = {}
        for at in sorted(entries, reverse=True):
            # Ways that meet go on as one.
            path, i = [], at
            while i < len(times) and i not in seen:
                path.append(i)
                i = follows[i]
            last = seen[i] if i < len(times) else int(times[path[-1]])
            seen.update(dict.fromkeys(path, last))
            yield part, name, int(times[at]), last

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in chained(batches, [None]):
            out = []
            rows = [] if batch is None else zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for part, name, t in rows:
                if (part, name) != now:
                    if held:
                        out += maps_of(*now, np.array(held))
                    now, held = (part, name), []
                held.append(t)
            if batch is None and held:
                out += maps_of(*now, np.array(held))
            yield _arrow(out, maps_arrow)

    starts_ddl = StructType([StructField("part", ranged.schema["part"].dataType), StructField(session, key), StructField("last", LongType())])
    starts_arrow = to_arrow_schema(starts_ddl)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part, last, entered = None, None, 0, True
        for batch in batches:
            out = []
            for p, s, enters, leaves in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != name:
                    name, part, last = s, None, 0
                if p != part:
                    part, entered = p, False
                    out.append((p, s, last))
                if not entered and enters - last >= interval_ms:
                    last, entered = leaves, True
            yield _arrow(out, starts_arrow)

    timed = ranged.where(F.col(ts).isNotNull())
    maps = timed.select("part", session, F.col(ts).cast("long")).repartition("part").sortWithinPartitions("part", session, ts).mapInArrow(summarise, maps_ddl)
    starts = maps.repartition(session).sortWithinPartitions(session, "part", "enters").mapInArrow(chain, starts_ddl)
    whole = timed.withColumn("last", F.lit(None).cast("long")).unionByName(starts, allowMissingColumns=True)
    schema, names = StructType([StructField(f.name, f.dataType) for f in frames.schema]), frames.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            times, given = (batch.column(at[n]).to_pylist() for n in (ts, "last"))
            keep = np.zeros(len(times), bool)
            for i, (t, start) in enumerate(zip(times, given, strict=True)):
                if start is not None:
                    last = start
                elif t - last >= interval_ms:
                    keep[i], last = True, t
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(at[n]) for n in names], names=names)

    return whole.repartition("part").sortWithinPartitions("part", session, F.col("last").isNull(), ts, tie).mapInArrow(walk, schema)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def motion_in_blocks(thumbnails: DataFrame, keep: tuple[str, ...] = ("session_id", "event_id")) -> DataFrame:
    """motion(), where one session may hold any share of the thumbnails: each block of the order is lent the last thumbnail
    before it, one row a block, and all blocks are walked at once."""
    order = ("session_id", "timestamp_ms", "event_id")
    image = ("thumb_width", "thumb_height", "gray")
    own = in_blocks(thumbnails.select(*dict.fromkeys((*keep, *order, *image))), *order, tag="motion")
    ends = own.groupBy("part", "session_id").agg(F.max_by(F.struct(*image), F.struct("timestamp_ms", "event_id")).alias("end"))
    before = Window.partitionBy("session_id").orderBy("part")
    lent = ends.withColumn("lent", F.lag("end").over(before)).where(F.col("lent").isNotNull()).select("part", "session_id", "lent.*", F.lit(True).alias("is_lent"))
    whole = own.withColumn("is_lent", F.lit(False)).unionByName(lent, allowMissingColumns=True)
    return _differences(whole.repartition("part").sortWithinPartitions("part", "session_id", F.desc("is_lent"), "timestamp_ms", "event_id"), keep, ("part", "session_id"))
