"""Groups of sessions as keys of the gate's state, deliveries read alone, the sink's one run."""

import os

import pandas as pd
from pyspark.sql import functions as F

from lensmill.sources.stored import stored
from lensmill.streaming import ordered
from tests.test_ordered import beat, folded, frame


class Values:
    """A list or value state; each call is counted."""

    def __init__(self, calls):
        self.calls, self.held = calls, []

    def get(self):
        self.calls.append("get")
        return list(self.held) if not isinstance(self.held, tuple) else self.held

    def exists(self):
        self.calls.append("exists")
        return bool(self.held)

    def put(self, rows):
        self.calls.append("put")
        self.held = list(rows)

    update = lambda self, row: (self.calls.append("update"), setattr(self, "held", row))

    def appendList(self, rows):
        self.calls.append("append")
        self.held = [*self.held, *rows]

    def clear(self):
        self.calls.append("clear")
        self.held = []


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, name, schema):
        return Values(self.calls)

    getValueState = getListState

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Mark:
    def __init__(self, mark):
        self.getCurrentWatermarkInMs = lambda: mark


def test_a_group_of_sessions_takes_a_few_calls():
    rows = [frame(s, 1000 + 50 * k, k, (k + s) % 9 > 0) for k in range(40) for s in range(500)]
    gate, handle = ordered.OrderedGate(300), Handle()
    gate.init(handle)
    columns = [c.split()[0] for c in ordered.EVENT.split(", ")]
    out = []
    for mark, some in ((0, rows[:9000]), (1500, []), (1500, rows[9000:]), (10**6, [])):
        if some:
            found = gate.handleInputRows((3,), iter([pd.DataFrame(some, columns=columns)]), Mark(mark))
        else:
            found = gate.handleExpiredTimer((3,), Mark(mark), None)
        for part in found:
            out += list(part.itertuples(index=False, name=None))
    want = [x for s in range(500) for x in folded([r for r in rows if r[0] == s], 300)]
    assert sorted(r[:4] for r in out) == sorted(want)
    assert len(handle.calls) < 40


def test_null_and_large_ids(spark, tmp_path):
    own = ordered.stateful_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    large = [2**60 + 1, 2**60 + 2]
    rows = [frame(s, 1000 + 100 * k, k, k != 2) for s in (*large, None) for k in range(4)]
    own.createDataFrame([*rows, beat(10**6)], ordered.EVENT).write.parquet(str(tmp_path / "in"))
    stages = ordered.ordered_stages(ordered.folder_stream(own, str(tmp_path / "in")), 10, groups=1)
    stages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = {tuple(r) for r in own.read.schema(ordered.OUTPUT).parquet(str(tmp_path / "out")).select("session_id", "timestamp_ms", "stage").collect()}
    assert found == {(s, t, stage) for s in (*large, None) for t, stage in ((1000, "stabilizing"), (1200, "idle"), (1300, "stabilizing"))}


def test_the_sink_runs_a_batch_once_and_tells_of_answers(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(len(batch))
            yield batch

    rows = [(s, 1000, "capturing", 1.0, None, None) for s in range(6)]
    batch = spark.createDataFrame(rows, ordered.OUTPUT).mapInPandas(counted, ordered.OUTPUT)
    sink = ordered.loop_sink(lambda begun: begun.withColumn("success", F.lit(True)), str(tmp_path / "stages"), str(tmp_path / "controls"), 100, 200)
    assert sink(batch, 0) is True and ran.value == 6
    assert sink(batch.where("stage = 'idle'"), 1) is False and not os.path.exists(tmp_path / "controls/batch-1")


def test_a_part_is_read_alone(spark):
    own = stored(spark.range(100).withColumn("part", F.col("id") % 4), "parts", "part")
    assert sorted(r.id for r in own.where("part = 3").collect()) == list(range(3, 100, 4))
    assert own.columns == ["id", "part"] and all("part=3" in f for f in (r.f for r in own.where("part = 3").select(F.input_file_name().alias("f")).distinct().collect()))
