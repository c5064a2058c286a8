"""Sources, sinks, registry and the entry module."""

from pyspark.sql import functions as F

from lensmill.operators import registry
from lensmill.sources import media


def test_charset_and_settings(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("a\r\n\nb\n \n")
    assert media.read_charset(spark, str(tmp_path / "dict.txt")) == ["a", "b", " "]
    assert media.read_charset(spark, str(tmp_path / "dict.txt"), "ios") == ["a", "", "b", " "]
    where = str(tmp_path / "settings")
    assert media.read_setting(spark, where, "k", "none") == "none"
    media.write_setting(spark, where, "k", "one")
    media.write_setting(spark, where, "k", "two")
    assert media.read_setting(spark, where, "k") == "two"


def test_photos_and_models(spark, tmp_path):
    (tmp_path / "m.onnx").write_bytes(b"abc")
    assert media.model_bytes(spark, "bundle://m.onnx", str(tmp_path)) == b"abc"
    assert media.read_photos(spark, f"file://{tmp_path}/m.onnx").first().length == 3
    own = spark.createDataFrame([("m", bytearray(b"abc"))], "n string, c binary")
    assert own.select(registry.version(F.col("n"), F.col("c"))).first()[0] == "m@352441c2"


def test_registry(spark):
    models = registry.latest_models(spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "b", 1)], "id string, label string, registered_seq bigint"))
    assert {r.id: r.label for r in models.collect()} == {"a": "new", "b": "b"}
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "a"), (2, 1, "x")], "app_id bigint, seq bigint, model_id string")
    assert [r.outcome for r in registry.activations(log, models).orderBy("app_id", "seq").collect()] == ["loaded", "error", "noop", "error"]
    assert {r.app_id: r.active_id for r in registry.active_model(log, models).collect()} == {1: "a", 2: registry.DEFAULT_MODEL["id"]}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_log_lines(spark):
    rows = spark.createDataFrame([(1, True, "VISA", 0.5)], "capture_id bigint, success boolean, document_type string, confidence double")
    assert "confidence=0.500" in media.log_lines(rows).first().line
