"""Activations that overlap a running load."""

from lensmill.operators import registry


def test_overlapping_loads(spark):
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rows = [
        # Two wait for a load of a: one joins it, one loads b after it; then a is loaded no more.
        (1, 1, 0, 100, True, "a"), (1, 2, 10, 100, True, "a"), (1, 3, 20, 100, True, "b"), (1, 4, 150, 100, True, "c"), (1, 5, 1000, 100, True, "b"), (1, 6, 1001, 1, True, "c"), (1, 7, 2000, 1, True, "x"), (1, 8, 2001, 1, True, "c"),
        # Who waits for a load that fails is rejected; what was loaded stays.
        (2, 1, 0, 50, True, "a"), (2, 2, 100, 50, False, "b"), (2, 3, 120, 50, True, "c"), (2, 4, 130, 50, True, "a"), (2, 5, 200, 50, None, "c"),
        # Both go on when the load ends, and the one that ends last stays.
        (3, 1, 0, 100, True, "a"), (3, 2, 10, 90, True, "b"), (3, 3, 20, 80, True, "c"), (3, 4, 500, 1, True, "b"),
    ]
    log = spark.createDataFrame(rows, "app_id bigint, seq bigint, started_ms bigint, load_ms bigint, succeeds boolean, model_id string")
    runs = registry.loads(log, models)
    found = {(r.app_id, r.seq): (r.outcome, r.began_ms, r.ended_ms) for r in runs.collect()}
    assert len(found) == len(rows)
    assert [found[1, k] for k in range(1, 9)] == [("loaded", 0, 100), ("joined", None, None), ("loaded", 100, 200), ("loaded", 200, 300), ("loaded", 1000, 1100), ("noop", None, None), ("error", None, None), ("loaded", 2001, 2002)]
    assert [found[2, k] for k in range(1, 6)] == [("loaded", 0, 50), ("failed", 100, 150), ("rejected", None, None), ("noop", None, None), ("failed", 200, 250)]
    assert [found[3, k] for k in range(1, 5)] == [("loaded", 0, 100), ("loaded", 100, 190), ("loaded", 100, 180), ("noop", None, None)]
    assert {r.app_id: r.loaded_id for r in registry.loaded_models(runs).collect()} == {1: "c", 2: "a", 3: "b"}
    assert registry.loads(log.limit(0), models).count() == 0
