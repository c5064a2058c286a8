"""The gate in event-time order: any delivery gives what the frames in order give; state ends with its session."""

import random

import pytest
from pyspark.sql import functions as F

from lensmill.streaming import capture, ordered


@pytest.fixture
def deliver(spark, tmp_path):
    """Runs a stream over folders of events, one run a delivery; returns its rows and where its state is."""
    own = ordered.stateful_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")

    def run(deliveries, **options):
        for rows in deliveries:
            own.createDataFrame(rows, ordered.EVENT).write.mode("append").parquet(str(tmp_path / "in"))
            stages = ordered.ordered_stages(ordered.folder_stream(own, str(tmp_path / "in")), **options)
            query = stages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        return [tuple(r) for r in own.read.schema(ordered.OUTPUT).parquet(str(tmp_path / "out")).collect()], str(tmp_path / "state")

    run.session = own
    return run


def frame(session, t, event_id, valid=True, quad=None):
    return (session, t, event_id, valid, quad, None)


def beat(t):
    return (-1, t, -1, False, None, ordered.HEARTBEAT)


def folded(rows, window_ms, interval_ms=66):
    """The stage changes of one session's rows in order."""
    state, out = {"last_forwarded": 0, "stage": "idle", "since": None, "latch": False}, []
    for s, t, _, valid, _, kind in sorted(rows, key=lambda r: (r[1], r[5] is None, r[2])):
        before = state["stage"]
        progress = capture.step(state, kind, valid, t, window_ms, interval_ms)
        if state["stage"] != before:
            out.append((s, t, state["stage"], progress or 0.0))
    return out


def test_shuffled_deliveries_and_late_rows(deliver):
    dealt = random.Random(7)
    rows = [frame(s, 1000 + 40 * (k // 2), 100 * s + k, (k * 7 + s) % 13 > 0) for s in range(6) for k in range(120)]
    late = [r for r in rows if r[1] < 1400 and r[2] % 11 == 0]
    timely = [r for r in rows if r not in late]
    deliveries = [[], [], []]
    for r in timely:
        deliveries[min(2, (r[1] - 1000 + dealt.randrange(-150, 150)) // 900 if r[1] > 1200 else 0)].append(r)
    for part in deliveries:
        dealt.shuffle(part)
    deliveries[2] += [*late, beat(10**7)]
    found, _ = deliver(deliveries, delay_ms=400, window_ms=900)
    assert sorted(r[:2] for r in found if r[2] == "late") == sorted(r[:2] for r in late) and late
    want = [x for s in range(6) for x in folded([r for r in timely if r[0] == s], 900)]
    assert sorted(r[:4] for r in found if r[2] != "late") == sorted(want) and len(want) > 20


def test_equal_times_go_by_event_id(deliver):
    rows = [frame(1, 1000, 2, False), frame(1, 1000, 1, True), frame(1, 1100, 4, True), frame(1, 1100, 3, False)]
    found, _ = deliver([[*rows, beat(10**6)]], delay_ms=10, window_ms=500)
    # The first of either time is forwarded: valid at 1000, not valid at 1100.
    assert sorted(r[1:3] for r in found) == [(1000, "stabilizing"), (1100, "idle")]


def test_held_frames_wait_for_the_answers(deliver):
    """Frames after the shutter wait; those before the reading starts move its quad, and a failure must be followed by an invalid frame."""
    quads = {t: [float(t)] * 8 for t in (1300, 1400)}
    frames = [frame(1, t, t, t != 1800, quads.get(t)) for t in range(1000, 2600, 100)]
    answer = lambda t, kind: (1, t, -1, False, None, kind)
    found, _ = deliver([[*frames, beat(10**6)], [answer(1450, "processing")], [answer(1650, "failed")], [answer(2250, "processing"), answer(2300, "completed")]], delay_ms=10, window_ms=300, holds=True)
    found.sort(key=lambda r: r[1])
    assert [r[1:3] for r in found] == [(1000, "stabilizing"), (1300, "capturing"), (1450, "processing"), (1650, "failed"), (1800, "idle"), (1900, "stabilizing"), (2200, "capturing"), (2250, "processing"), (2300, "completed")]
    # The frame at 1400 came after the shutter; the one at 2200 showed no document.
    assert found[2][4:] == (1400, quads[1400]) and found[7][4:] == (2200, None)


def test_state_ends_with_its_session(deliver):
    """Rows of both state variables fall to zero once the watermark has passed the sessions' ends."""
    rows = [frame(s, 1000 + 50 * k, k) for s in range(5) for k in range(10)]
    count = lambda at, name: deliver.session.read.format("statestore").option("path", at).option("stateVarName", name).load().count()
    _, state = deliver([rows], delay_ms=100, ends_ms=5000)
    assert count(state, "gate") == 5
    assert count(state, "waiting") > 0
    deliver([[beat(10**6)]], delay_ms=100, ends_ms=5000)
    assert count(state, "gate") == count(state, "waiting") == 0


def test_controls_in_one_folder_and_frames_in_another(spark):
    events = ordered.control_events(spark.createDataFrame([(1, 5, "reset")], "session_id bigint, timestamp_ms bigint, kind string"))
    assert events.schema.simpleString() == ordered.frame_events(spark.createDataFrame([], "session_id bigint, timestamp_ms bigint, event_id bigint, is_valid boolean, quad struct<topLeft:struct<x:double,y:double>,topRight:struct<x:double,y:double>,bottomRight:struct<x:double,y:double>,bottomLeft:struct<x:double,y:double>>")).schema.simpleString()
    assert events.where(F.col("kind") == "reset").count() == 1
