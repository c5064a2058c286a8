"""The store as a stream, in any order of arrival."""

import pytest

from lensmill.streaming import ordered, store


@pytest.mark.parametrize("turned", [False, True])
def test_the_store_does_not_depend_on_arrival(spark, tmp_path, turned):
    """Events of one time and id included: the stream gives what the batch twin gives."""
    events = [(1, 10, 5, "error", "e5"), (1, 10, 5, "result", "r5"), (1, 9, 4, "guidance", "g4"), (2, 7, 1, "stage", "idle"), (2, 8, 2, "reset", None), (2, 8, 2, "stage", "late")]
    own = ordered.stateful_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    last = {}
    for k, some in enumerate((events[::2], events[1::2])[:: -1 if turned else 1]):
        own.createDataFrame(some, store.EVENT).write.mode("append").parquet(str(tmp_path / "in"))
        values = store.stored_values(own.readStream.schema(store.EVENT).parquet(str(tmp_path / "in")))
        keep = lambda batch, _: last.update({r.session_id: tuple(r) for r in batch.collect()})
        values.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(last.values()) == sorted(tuple(r) for r in store.latest_values(spark.createDataFrame(events, store.EVENT)).collect())
