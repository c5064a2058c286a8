"""Long sessions in even blocks, and the store of latest values, against folds written plainly."""

import random

import pytest

from lensmill.operators import sequences
from lensmill.streaming import capture, store


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_throttle_in_blocks(spark, partitions):
    """One session with two thirds of the frames, gaps, bursts, equal times, null times and a null session."""
    dealt = random.Random(int(partitions))
    rows, t = [], 0
    for i in range(1500):
        t += dealt.choice((0, 0, 1, 3, 20, 66, 70)) if i % 300 else 500
        rows.append((7 if i % 3 else dealt.choice((1, 2, None)), None if i % 401 == 5 else t, i, "x"))
    want, last = set(), {}
    for s, at, i, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if at - last.get(s, 0) >= 66:
            last[s] = at
            want.add((s, at, i))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frames = spark.createDataFrame(rows, "session_id bigint, timestamp_ms bigint, event_id bigint, other string")
        found = sequences.throttle_in_blocks(frames)
        assert found.columns == frames.columns
        assert {tuple(r)[:3] for r in found.collect()} == want
        assert {tuple(r)[:3] for r in sequences.throttle(frames).collect()} == want
        assert sequences.throttle_in_blocks(frames.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_are_even(spark):
    """A session with all frames is dealt out over all blocks."""
    frames = spark.range(4000).selectExpr("1L AS session_id", "id * 10 AS timestamp_ms", "id AS event_id")
    sizes = [r["count"] for r in sequences.in_blocks(frames, "session_id", "timestamp_ms", "event_id").groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_motion_in_blocks(spark):
    dealt = random.Random(4)
    rows = [(1 if i % 4 else 2, i, i // 3, *((2, 2) if i % 50 else (4, 1)), None if i % 37 == 9 else bytes(dealt.randrange(256) for _ in range(4))) for i in range(600)]
    df = spark.createDataFrame(rows, "session_id bigint, event_id bigint, timestamp_ms bigint, thumb_width int, thumb_height int, gray binary")
    want, before = {}, {}
    for s, i, _, w, h, gray in rows:
        now = (w, h, gray) if gray is not None else None
        want[i] = capture.motion(before.get(s), now) if now else 0.0
        before[s] = now
    for own in (sequences.motion, sequences.motion_in_blocks):
        assert {r.event_id: r.motion_score for r in own(df).collect()} == want


def test_store_of_latest_values(spark):
    """In any order of arrival: the later of two holds, a result clears the error before it, a reset everything."""
    events = [
        (1, 10, 1, "error", "e1"), (1, 20, 2, "result", "r2"), (2, 10, 1, "result", "r1"), (2, 20, 2, "error", "e2"), (3, 5, 1, "guidance", "READY"), (3, 9, 1, "reset", None), (3, 9, 2, "stage", "idle"),
        (4, 7, 3, "stage", "b"), (4, 7, 1, "stage", "a"), (5, 1, 1, "unheard of", "x"), (1, 30, 9, "guidance", None),
    ]
    found = {r.session_id: tuple(r)[1:] for r in store.latest_values(spark.createDataFrame(events, store.EVENT)).collect()}
    assert found == {1: (None, None, "r2", None, 30), 2: (None, None, "r1", "e2", 20), 3: (None, "idle", None, None, 9), 4: (None, "b", None, None, 7), 5: (None, None, None, None, None)}
