"""The session folds as SQL table functions."""

from lensmill.operators import tables

FRAME = "session_id bigint, event_id bigint, timestamp_ms bigint, is_valid boolean, kind string, spare int"
CALL = "TABLE({f}) PARTITION BY session_id ORDER BY (timestamp_ms, event_id)"


def gated(spark, frames, more=""):
    tables.register(spark)
    return [tuple(r) for r in spark.sql(f"SELECT * FROM gated_frames({CALL}{more}) ORDER BY session_id, timestamp_ms, event_id", f=frames).collect()]


def test_throttle(spark):
    own = spark.createDataFrame([(1, 3, 200, None, None, 0), (1, 1, 70, True, None, 0), (1, 2, 135, True, None, 0), (1, 4, None, True, None, 0), (2, 5, 66, False, None, 0), (2, 4, 66, False, None, 0), (None, 6, 100, True, None, 0)], FRAME)
    tables.register(spark)
    at = lambda more: sorted((r.event_id for r in spark.sql(f"SELECT * FROM throttled_frames({CALL}{more})", f=own).collect()))
    assert at("") == [1, 3, 4, 6] and at(", interval_ms => 60") == [1, 2, 3, 4, 6] and at(", interval_ms => 201") == []


def test_gate_with_control_events(spark):
    own = [(1, 1, 100, True, None, 0), (1, 2, 200, None, None, 0), (1, 3, 300, True, None, 0), (1, 4, 800, True, None, 0), (1, 5, 900, True, None, 0), (1, 6, 1000, True, "failed", 0), (1, 7, 1100, True, None, 0),
           (1, 8, 1200, False, None, 0), (1, 9, 1300, True, None, 0), (1, 10, None, True, None, 0)]
    found = gated(spark, spark.createDataFrame(own, FRAME), ", window_ms => 500")
    assert [(e, s, p) for _, e, _, s, p in found] == [
        (1, "stabilizing", 0.0), (2, "idle", 0.0), (3, "stabilizing", 0.0), (4, "capturing", 1.0), (5, "capturing", 1.0), (6, "failed", 0.0), (7, "failed", 0.0), (8, "idle", 0.0), (9, "stabilizing", 0.0),
    ]


def test_no_kind_and_no_rows(spark):
    own = spark.createDataFrame([(1, 1, 100, True, "reset", 0)], FRAME)
    assert gated(spark, own.drop("kind")) == [(1, 1, 100, "stabilizing", 0.0)]
    assert gated(spark, own.limit(0)) == []


def test_views_of_the_parsers(spark):
    line = "array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>"
    none = spark.createDataFrame([], f"capture_id bigint, document_type string, text string, lines {line}, confidence double, spare int")
    none.createOrReplaceTempView("no_captures")
    tables.parsed_views(spark, "no_captures")
    assert all(spark.table(v).count() == 0 for v in ("extracted_documents", "parsed_zones", "parsed_licences", "parsed_cards"))
    zone = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    own = spark.createDataFrame([(1, "PASSPORT", zone, None, 0.5, 3), (2, None, None, None, None, 4)], none.schema)
    own.createOrReplaceTempView("two_captures")
    tables.parsed_views(spark, "two_captures")
    found = spark.sql("SELECT capture_id, spare, ok, format FROM parsed_zones ORDER BY capture_id").collect()
    assert [(r.capture_id, r.spare, r.ok, r.format) for r in found] == [(1, 3, True, "TD3"), (2, 4, False, found[1].format)]
    assert spark.sql("SELECT count(*) FROM extracted_documents").first()[0] == 2
