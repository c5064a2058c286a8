"""Structured Streaming: throttle and stability gate as one stateful operator, latest state, motion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lensmill.operators.sequences import tie_of

OUTPUT = "session_id bigint, timestamp_ms bigint, stage string, stability_progress double"
_STATE = "last_forwarded bigint, stage string, since bigint, latch boolean"
#: What a control event does at equal times comes before frames.
_BUSY = ("capturing", "processing", "completed")


def step(state: dict, kind: str | None, valid: bool, t: int, window_ms: int, interval_ms: int) -> float | None:
    """Applies one event to a session's state; the progress after it, or None if the frame was not forwarded or ignored.

    kind: None for a frame, else an outside transition (processing, completed, failed, reset).
    """
    if kind is not None:
        if kind in ("failed", "reset"):
            state["since"], state["latch"] = None, kind == "failed"
            state["stage"] = "failed" if kind == "failed" else "idle"
            return 0.0
        state["stage"] = kind
        return None
    if t - state["last_forwarded"] < interval_ms:
        return None
    state["last_forwarded"] = t
    if state["stage"] in _BUSY:
        return None
    if not valid:
        state["since"], state["latch"], state["stage"] = None, False, "idle"
        return 0.0
    if state["latch"]:
        return None
    if state["since"] is None:
        state["since"], state["stage"] = t, "stabilizing"
    progress = min(1.0, (t - state["since"]) / window_ms)
    if progress >= 1:
        state["stage"] = "capturing"
    return progress


class CaptureGate(StatefulProcessor):
    """Throttle and gate of a session; emits a row where the stage changes."""

    def __init__(self, window_ms: int = 1000, interval_ms: int = 66, keep_ms: int | None = None):
        self.window_ms, self.interval_ms, self.keep_ms = window_ms, interval_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", _STATE, self.keep_ms) if self.keep_ms else handle.getValueState("gate", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ("last_forwarded", "stage", "since", "latch")
        state = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else {"last_forwarded": 0, "stage": "idle", "since": None, "latch": False}
        events = pd.concat(list(rows)).sort_values(["timestamp_ms", "order", "event_id"], kind="stable")
        out = []
        for e in events.itertuples():
            before = state["stage"]
            progress = step(state, e.kind if isinstance(e.kind, str) else None, bool(e.is_valid), int(e.timestamp_ms), self.window_ms, self.interval_ms)
            if state["stage"] != before:
                out.append((key[0], int(e.timestamp_ms), state["stage"], progress or 0.0))
        self.state.update(tuple(state[n] for n in names))
        yield pd.DataFrame(out, columns=["session_id", "timestamp_ms", "stage", "stability_progress"])

    def close(self) -> None:
        pass


def events_of(frames: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """Frames (session_id, timestamp_ms, is_valid) and control events (…, kind) in one stream; controls go first at equal times, frames by event_id."""
    own = frames.select("session_id", "timestamp_ms", F.coalesce("is_valid", F.lit(False)).alias("is_valid"), F.lit(None).cast("string").alias("kind"), F.lit(1).alias("order"), tie_of(frames).alias("event_id"))
    if controls is None:
        return own
    return own.unionByName(controls.select("session_id", "timestamp_ms", F.lit(False).alias("is_valid"), "kind", F.lit(0).alias("order"), F.lit(-1).cast("long").alias("event_id")))


def capture_stages(events: DataFrame, window_ms: int = 1000, interval_ms: int = 66, keep_ms: int | None = None) -> DataFrame:
    """Stage changes of each session of a stream of events_of(). State: one row a session, in RocksDB.

    keep_ms: how long a session's state outlives its last event, in processing time; without it, it stays for good.

    Events of a micro-batch are put in order of time; sources must deliver batches in that order.
    """
    own = events.groupBy("session_id")
    return own.transformWithStateInPandas(CaptureGate(window_ms, interval_ms, keep_ms), OUTPUT, "Append", "ProcessingTime" if keep_ms else "None")


def replayed(events: DataFrame, window_ms: int = 1000, interval_ms: int = 66) -> DataFrame:
    """The batch twin: the same steps over each session's events in order of time, streamed through sorted partitions."""
    import pyarrow as pa

    schema = pa.schema([("session_id", pa.int64()), ("timestamp_ms", pa.int64()), ("stage", pa.string()), ("stability_progress", pa.float64())])

    def run(batches):
        now, state = None, {}
        for batch in batches:
            out = []
            for s, t, valid, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != now:
                    now, state = s, {"last_forwarded": 0, "stage": "idle", "since": None, "latch": False}
                before = state["stage"]
                progress = step(state, kind, valid, t, window_ms, interval_ms)
                if state["stage"] != before:
                    out.append((s, t, state["stage"], progress or 0.0))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    own = events.select("session_id", "timestamp_ms", "is_valid", "kind", "order", "event_id")
    return own.repartition("session_id").sortWithinPartitions("session_id", "timestamp_ms", "order", "event_id").mapInArrow(run, OUTPUT)


def stable_captures(stages: DataFrame) -> DataFrame:
    """The moments at which a photo is taken."""
    return stages.where(F.col("stage") == "capturing").select("session_id", "timestamp_ms")


def capture_sink(extract: Callable[[DataFrame], DataFrame], results: str, controls: str, done: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over capture_stages(): takes the photos of a batch, stores results and control events.

    extract gets (session_id, timestamp_ms) of each capture and returns those with success and whatever else was read.
    A capture is processing, then completed, or failed if success is false or null or the photo is missing. A batch that is
    run again writes over its own folder, so each is stored once; done is called with what was stored.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        shots = stable_captures(batch)
        at = f"{results}/batch={batch_id}"
        extract(shots).write.mode("overwrite").parquet(at)
        stored = batch.sparkSession.read.parquet(at)
        ended = shots.join(stored.select("session_id", "timestamp_ms", "success"), ["session_id", "timestamp_ms"], "left")
        kinds = F.array(F.lit("processing"), F.when(F.coalesce("success", F.lit(False)), "completed").otherwise("failed"))
        ended.select("session_id", "timestamp_ms", F.posexplode(kinds).alias("order", "kind")).write.mode("overwrite").parquet(f"{controls}/batch={batch_id}")
        if done:
            done(stored, batch_id)

    return run


def latest_states(frames: DataFrame, *values: str) -> DataFrame:
    """Last values of each session, for update mode."""
    return frames.groupBy("session_id").agg(F.max_by(F.struct(*values), "timestamp_ms").alias("state"), F.max("timestamp_ms").alias("timestamp_ms")).select("session_id", "timestamp_ms", "state.*")


class Motion(StatefulProcessor):
    """Mean absolute difference to the previous thumbnail of the session over 255; 0 at first or if the size changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.previous = handle.getValueState("previous", "width int, height int, gray binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.previous.get() if self.previous.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values("timestamp_ms", kind="stable").itertuples():
            now = (int(e.width), int(e.height), bytes(e.gray))
            out.append((key[0], int(e.timestamp_ms), motion(before, now)))
            before = now
        self.previous.update(before)
        yield pd.DataFrame(out, columns=["session_id", "timestamp_ms", "motion_score"])

    def close(self) -> None:
        pass


def motion(before: tuple | None, now: tuple) -> float:
    if before is None or before[:2] != now[:2]:
        return 0.0
    a, b = (np.frombuffer(x[2], np.uint8).astype(np.int16) for x in (before, now))
    return float(np.abs(a - b).mean() / 255) if len(a) else 0.0


def motions(pairs: list[tuple[tuple | None, tuple | None]]) -> list[float]:
    """motion() of each pair, 0 where there is no image; images of one size are compared in stacks."""
    out, sizes = [0.0] * len(pairs), {}
    for i, (before, now) in enumerate(pairs):
        if before and now and before[:2] == now[:2] and len(before[2]) == len(now[2]) > 0:
            sizes.setdefault(len(now[2]), []).append(i)
        elif now:
            out[i] = motion(before, now)
    for n, own in sizes.items():
        step = max(1, (1 << 18) // n)
        for at in range(0, len(own), step):
            some = own[at : at + step]
            a, b = (np.frombuffer(b"".join(pairs[i][k][2] for i in some), np.uint8).reshape(-1, n).astype(np.int16) for k in (0, 1))
            for i, m in zip(some, (np.abs(a - b).mean(axis=1) / 255).tolist(), strict=True):
                out[i] = m
    return out


def motion_scores(thumbnails: DataFrame) -> DataFrame:
    """Motion of a stream of (session_id, timestamp_ms, width, height, gray binary)."""
    return thumbnails.groupBy("session_id").transformWithStateInPandas(Motion(), "session_id bigint, timestamp_ms bigint, motion_score double", "Append", "None")
