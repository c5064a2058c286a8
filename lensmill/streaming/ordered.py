"""Event-time order for streams of frames, and the loop in which captures drive the gate that fired them.

Frames may arrive in any order and in any batch: they wait in state until the watermark has passed them, and are then
folded in order of time, control events first, equal times by event_id. A frame older than the watermark is late: it is
counted (a row with stage ``late``) and takes no part. With ``holds`` the gate is part of a loop: after it has fired, or
while a document is read, later frames wait for the control event that answers, however late that comes, so the result does
not depend on how the stream was cut into batches.

A session's state goes once the watermark is ``ends_ms`` past its last event, whether or not an answer is still missing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lensmill.streaming.capture import step

EVENT = "session_id bigint, timestamp_ms bigint, event_id bigint, is_valid boolean, quad array<double>, kind string"
OUTPUT = "session_id bigint, timestamp_ms bigint, stage string, stability_progress double, frame_ms bigint, quad array<double>"
#: Moves the watermark on and is nothing else.
HEARTBEAT = "heartbeat"
_ROW = ("timestamp_ms", "event_id", "is_valid", "quad", "kind")
_GATE = ("last_forwarded", "stage", "since", "latch", "frame_ms", "quad", "last_ms", "timer_ms")
_FRESH = (0, "idle", None, False, None, None, 0, None)
_COLUMNS = ("session_id", "timestamp_ms", "stage", "stability_progress", "frame_ms", "quad")
#: Groups of sessions, the keys of the state; and the group of the session whose id is null.
GROUPS, NAMELESS = 256, -1


def frame_events(frames: DataFrame) -> DataFrame:
    """EVENT rows of frames(session_id, timestamp_ms, event_id, is_valid, quad)."""
    corners = [F.col(f"quad.{c}.{k}") for c in ("topLeft", "topRight", "bottomRight", "bottomLeft") for k in "xy"]
    flat = F.when(F.col("quad").isNotNull(), F.array(*corners))
    return frames.select("session_id", "timestamp_ms", "event_id", F.coalesce("is_valid", F.lit(False)).alias("is_valid"), flat.alias("quad"), F.lit(None).cast("string").alias("kind"))


def control_events(controls: DataFrame) -> DataFrame:
    """EVENT rows of controls(session_id, timestamp_ms, kind)."""
    return controls.select("session_id", "timestamp_ms", F.lit(-1).cast("bigint").alias("event_id"), F.lit(False).alias("is_valid"), F.lit(None).cast("array<double>").alias("quad"), "kind")


def heartbeat(spark: SparkSession, timestamp_ms: int) -> DataFrame:
    """One EVENT row of no session, with which a source tells that nothing older will come."""
    return spark.createDataFrame([(-1, timestamp_ms, -1, False, None, HEARTBEAT)], EVENT)


def _place(row: tuple) -> tuple:
    """Where a row stands in its session: by time, control events first, then by event_id."""
    return row[0], row[4] is None, row[1]


def _packed(rows: list[tuple]) -> bytes:
    return pickle.dumps(rows, protocol=5)


class OrderedGate(StatefulProcessor):
    """Throttle, gate and the quad of the last forwarded frame, in event-time order; emits a row where the stage changes.

    A row of stage processing, at which reading starts, carries the time and the quad of the last forwarded frame: frames
    forwarded after the shutter count, and the quad is null if that frame showed no document.

    A key is a group of sessions, since each call to the state store costs far more than the folding of a session's rows. A
    group has one gate row a session, and what waits as packed rows: one for each delivery, one after a fold.
    """

    def __init__(self, window_ms: int = 1000, interval_ms: int = 66, ends_ms: int | None = None, holds: bool = False):
        self.window_ms, self.interval_ms, self.ends_ms, self.holds = window_ms, interval_ms, ends_ms, holds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gates = handle.getListState("gate", "session_id bigint, last_forwarded bigint, stage string, since bigint, latch boolean, frame_ms bigint, quad array<double>, last_ms bigint, timer_ms bigint")
        self.waiting = handle.getListState("waiting", "session_id bigint, rows binary")
        self.timer = handle.getValueState("timer", "timer_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, out, new = timerValues.getCurrentWatermarkInMs(), [], {}
        for part in rows:
            for session, t, event_id, valid, quad, kind in zip(*(part[c] for c in ("session_id", *_ROW)), strict=True):
                row = (int(t), int(event_id), bool(valid), None if quad is None else [float(x) for x in quad], kind if isinstance(kind, str) else None)
                session = None if key[0] == NAMELESS else int(session)
                if row[4] is None and row[0] < mark:
                    out.append((session, row[0], "late", None, None, None))
                elif row[4] != HEARTBEAT:
                    new.setdefault(session, []).append(row)
        if new:
            out += self._moved(new, mark)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._moved({}, timerValues.getCurrentWatermarkInMs()), columns=_COLUMNS)

    def _moved(self, new: dict[int | None, list[tuple]], mark: int) -> list[tuple]:
        """Adds new rows to what waits, folds the sessions that have come to their time or got an answer, sets the group's one timer."""
        gates = {r[0]: dict(zip(_GATE, r[1:], strict=True)) for r in self.gates.get()}
        for session, rows in new.items():
            state = gates.setdefault(session, dict(zip(_GATE, _FRESH, strict=True)))
            state["last_ms"] = max(state["last_ms"], *(r[0] for r in rows))
            state["timer_ms"] = min(r[0] + 1 for r in rows) if state["timer_ms"] is None else min(state["timer_ms"], *(r[0] + 1 for r in rows))
        moved = {s for s, state in gates.items() if state["timer_ms"] is not None and state["timer_ms"] <= mark} | {s for s, rows in new.items() if any(r[4] is not None for r in rows)}
        if moved:
            out = self._folded(gates, new, moved, mark)
        else:
            out = []
            self.waiting.appendList([(s, _packed(rows)) for s, rows in new.items()])
        if gates:
            self.gates.put([(s, *(state[n] for n in _GATE)) for s, state in gates.items()])
        else:
            self.gates.clear()
        self._wake(min((state["timer_ms"] for state in gates.values() if state["timer_ms"] is not None), default=None), mark)
        return out

    def _folded(self, gates: dict[int | None, dict], new: dict[int | None, list[tuple]], moved: set[int | None], mark: int) -> list[tuple]:
        """Takes what is waiting of some sessions and older than the watermark, in order; keeps the rest. Sessions that are over go."""
        kept, packed, out = [], {s: [] for s in moved}, []
        for session, rows in self.waiting.get():
            if session in moved:
                packed[session].append(rows)
            else:
                kept.append((session, bytes(rows)))
        kept += [(s, _packed(rows)) for s, rows in new.items() if s not in moved]
        for session, parts in packed.items():
            held = sorted([*(r for part in parts for r in pickle.loads(part)), *new.get(session, ())], key=_place)
            state = gates[session]
            taken, rows = self._session(session, state, held, mark)
            out += taken
            if self.ends_ms is not None and state["last_ms"] + self.ends_ms < mark:
                del gates[session]
                continue
            state["timer_ms"] = min((r[0] + 1 for r in rows if r[0] >= mark), default=None if self.ends_ms is None else state["last_ms"] + self.ends_ms + 1)
            if rows:
                kept.append((session, _packed(rows)))
        if kept:
            self.waiting.put(kept)
        else:
            self.waiting.clear()
        return out

    def _session(self, session: int | None, state: dict, held: list[tuple], mark: int) -> tuple[list[tuple], list[tuple]]:
        """Stage changes of one session's rows in order, up to the watermark or to where it waits for an answer; the rows after that."""
        answers = sum(r[4] is not None for r in held)
        out, taken = [], 0
        for t, _, valid, quad, kind in held:
            if t >= mark or self.holds and kind is None and not answers and state["stage"] in ("capturing", "processing"):
                break
            taken += 1
            answers -= kind is not None
            stage, forwarded = state["stage"], state["last_forwarded"]
            progress = step(state, kind, valid, t, self.window_ms, self.interval_ms)
            if kind == "reset":
                state["frame_ms"] = state["quad"] = None
            elif state["last_forwarded"] != forwarded:
                state["frame_ms"], state["quad"] = t, quad
            if state["stage"] != stage:
                seen = (state["frame_ms"], state["quad"]) if state["stage"] == "processing" else (None, None)
                out.append((session, t, state["stage"], progress or 0.0, *seen))
        return out, held[taken:]

    def _wake(self, due: int | None, mark: int) -> None:
        set_for = self.timer.get()[0] if self.timer.exists() else None
        if due == set_for:
            return
        if set_for is not None and set_for > mark:
            self.handle.deleteTimer(set_for)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def close(self) -> None:
        pass


def groups_for(sessions: int, partitions: int) -> int:
    """A number of groups for so many sessions: some 256 sessions each, but two groups a partition at least."""
    return max(2 * partitions, -(-sessions // 256))


def ordered_stages(events: DataFrame, delay_ms: int, window_ms: int = 1000, interval_ms: int = 66, ends_ms: int | None = None, holds: bool = False, groups: int = GROUPS) -> DataFrame:
    """Stage changes and late rows of a stream of EVENT rows that come at most delay_ms out of order.

    State: the rows of each session that the watermark has not passed, and one row for its gate. Sessions are dealt by a hash
    to ``groups`` groups, which are the keys of the state. What waits in a group is held in memory, packed, while it is worked
    on; groups of some hundred sessions (groups_for) keep that small. A query must go on with the number it began with.
    """
    # The copy of the time that carries the watermark is left out again, else late rows would go before they are counted.
    marked = events.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", f"{delay_ms} milliseconds")
    # Without nulls, which pandas would turn all ids of a part into floats for.
    group = F.when(F.col("session_id").isNull(), NAMELESS).otherwise(F.pmod(F.xxhash64("session_id"), F.lit(groups)).cast("int"))
    own = marked.select(group.alias("session_group"), F.coalesce("session_id", F.lit(0)).alias("session_id"), *_ROW).groupBy("session_group")
    return own.transformWithStateInPandas(OrderedGate(window_ms, interval_ms, ends_ms, holds), OUTPUT, "Append", "EventTime")


def loop_sink(extract: Callable[[DataFrame], DataFrame], stages: str, controls: str, shutter_ms: int, extract_ms: int) -> Callable[[DataFrame, int], bool]:
    """A foreachBatch function that answers the gate of the query it belongs to.

    A capture is answered by ``processing`` shutter_ms later. Where processing has begun, extract gets the row, with the
    quad, and returns session_id, timestamp_ms and success; the answer, extract_ms later, is ``completed``, or
    ``failed`` if success is false, null or missing. stages gets the batch's rows, controls the answers, which the same query
    reads as its second source. A batch that is run again writes over its own folders. The function returns whether there were
    answers, and runs the batch's plan once: all else reads the stored rows.
    """

    def run(batch: DataFrame, batch_id: int) -> bool:
        own = f"{stages}/batch-{batch_id}"
        batch.write.mode("overwrite").parquet(own)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(own)
        shots = stored.where("stage = 'capturing'").select("session_id", (F.col("timestamp_ms") + shutter_ms).alias("timestamp_ms"), F.lit("processing").alias("kind"))
        begun = stored.where("stage = 'processing'")
        ended = begun.select("session_id", "timestamp_ms").join(extract(begun).select("session_id", "timestamp_ms", "success"), ["session_id", "timestamp_ms"], "left")
        ended = ended.select("session_id", (F.col("timestamp_ms") + extract_ms).alias("timestamp_ms"), F.when(F.coalesce("success", F.lit(False)), "completed").otherwise("failed").alias("kind"))
        answers = control_events(shots.unionByName(ended))
        asked = not answers.isEmpty()
        if asked:
            answers.write.mode("overwrite").parquet(f"{controls}/batch-{batch_id}")
        return asked

    return run


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a stream with state, so that its settings touch no other query."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def folder_stream(spark: SparkSession, *folders: str) -> DataFrame:
    """The EVENT rows of one or several folders, as one stream."""
    out = None
    for folder in folders:
        own = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(folder)
        out = own if out is None else out.unionByName(own)
    return out
