"""Model registry: latest registration, activation log, active model, versions, settings."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bundled default.
DEFAULT_MODEL = {
    "id": "default-docaligner-rapidocr-v1",
    "label": "DocAligner + RapidOCR (bundled default)",
    "license": "Apache-2.0",
    "detector_model_path": "bundle://docaligner_fastvit_heatmap.onnx",
    "ocr_det_model_path": "bundle://ch_PP-OCRv4_det_infer.onnx",
    "ocr_cls_model_path": "bundle://ch_ppocr_mobile_v2.0_cls_infer.onnx",
    "ocr_rec_model_path": "bundle://en_PP-OCRv3_rec_infer.onnx",
    "ocr_rec_charset_path": "bundle://en_dict.txt",
    "face_detector_model_path": "bundle://face_detection_yunet_2023mar.onnx",
    "classifier_model_path": "",
}


def latest_models(registrations: DataFrame) -> DataFrame:
    """The last registration of each id (largest registered_seq): an aggregate, combined before the shuffle."""
    others = [c for c in registrations.columns if c not in ("id", "registered_seq")]
    newest = registrations.groupBy("id").agg(F.max(F.struct("registered_seq", *others)).alias("m"))
    return newest.select("id", "m.*")


def activations(log: DataFrame, models: DataFrame) -> DataFrame:
    """log(seq, model_id) with known, and outcome: error (unknown id), noop (already active) or loaded.

    An unknown id leaves the active model as it is; the order is total, so the window runs over the log alone.
    """
    from pyspark.sql import Window

    known = log.join(models.select(F.col("id").alias("known_id")), F.col("model_id") == F.col("known_id"), "left")
    known = known.withColumn("known", F.col("known_id").isNotNull()).drop("known_id")
    by = Window.partitionBy("app_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("known"), F.col("model_id")), ignorenulls=True).over(by)
    outcome = F.when(~F.col("known"), "error").when(F.coalesce(before == F.col("model_id"), F.lit(False)), "noop").otherwise("loaded")
    return known.withColumn("outcome", outcome)


def active_model(log: DataFrame, models: DataFrame, default: str = DEFAULT_MODEL["id"]) -> DataFrame:
    """app_id and its active model id: the last activation of a known model, the default where there is none."""
    done = log.join(models.select(F.col("id").alias("known_id")), F.col("model_id") == F.col("known_id"), "left")
    last = F.max(F.when(F.col("known_id").isNotNull(), F.struct("seq", "model_id")))
    return done.groupBy("app_id").agg(last.alias("m")).select("app_id", F.coalesce("m.model_id", F.lit(default)).alias("active_id"))


LOADS = "app_id bigint, seq bigint, model_id string, outcome string, began_ms bigint, ended_ms bigint"


class _Loader:
    """One app's loads in the order of time: what is loaded, the load in flight, and who waits for it."""

    def __init__(self) -> None:
        self.loaded, self.flight, self.due = None, None, []

    def settle(self, until: float) -> Iterator[tuple]:
        """What ends, and who goes on, up to a time; a load's end comes before those who waited for it."""
        while self.due and self.due[0][0] <= until:
            t, waits, _, load, row = heappop(self.due)
            if not waits:
                if load["succeeds"]:
                    self.loaded = load["model"]
                self.flight = None
            elif not load["succeeds"]:
                yield (*row[:3], "rejected", None, None)
            elif self.loaded == row[2]:
                yield (*row[:3], "joined", None, None)
            else:
                yield self.begin(row, t)

    def begin(self, row: tuple, t: int) -> tuple:
        app, seq, model, takes, succeeds = row
        self.flight = {"model": model, "succeeds": succeeds, "ends": t + takes}
        heappush(self.due, (t + takes, False, seq, self.flight, row))
        return app, seq, model, "loaded" if succeeds else "failed", t, t + takes

    def activate(self, row: tuple, t: int, known: bool) -> Iterator[tuple]:
        yield from self.settle(t)
        if not known:
            yield (*row[:3], "error", None, None)
        elif self.loaded == row[2]:
            yield (*row[:3], "noop", None, None)
        elif self.flight:
            heappush(self.due, (self.flight["ends"], True, row[1], self.flight, row))
        else:
            yield self.begin(row, t)


def loads(log: DataFrame, models: DataFrame) -> DataFrame:
    """What each activation of log(app_id, seq, started_ms, load_ms, succeeds, model_id) came to; ended_ms where it loaded.

    error: unknown id. noop: already loaded when it started. Otherwise one that starts while a load is in flight waits for
    its end: rejected if that load fails, joined if it was of the same model, else its own load begins there. loaded, or
    failed, which leaves loaded what was. An app's log is one fold with the waiting activations as its state.
    """
    known = log.join(models.select(F.col("id").alias("known_id")), F.col("model_id") == F.col("known_id"), "left")
    own = known.select("app_id", "seq", "model_id", "load_ms", F.coalesce("succeeds", F.lit(False)).alias("succeeds"), "started_ms", F.col("known_id").isNotNull().alias("known"))
    names = [x.split()[0] for x in LOADS.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("model_id", "outcome") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        app, loader = None, _Loader()
        for batch in chain(batches, [None]):
            out: list[tuple] = []
            rows = () if batch is None else zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for *row, started, found in rows:
                if row[0] != app:
                    out += loader.settle(inf)
                    app, loader = row[0], _Loader()
                out += loader.activate(tuple(row), started, found)
            if batch is None:
                out += loader.settle(inf)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return own.repartition("app_id").sortWithinPartitions("app_id", "started_ms", "seq").mapInArrow(run, LOADS)


def loaded_models(runs: DataFrame) -> DataFrame:
    """app_id and loaded_id: the model whose load ended last and well; null before any has."""
    last = F.max(F.when(F.col("outcome") == "loaded", F.struct("ended_ms", "seq", "model_id")))
    return runs.groupBy("app_id").agg(last.alias("m")).select("app_id", F.col("m.model_id").alias("loaded_id"))


def is_loaded(model_id: Column, loaded_id: Column) -> Column:
    return F.coalesce(model_id == loaded_id, F.lit(False))


def require_known(model_id: Column, found: Column) -> Column:
    """The id, or an error where the lookup found nothing."""
    return F.when(found.isNotNull(), model_id).otherwise(F.raise_error(F.concat(F.lit("no model registered with id "), model_id)))


def version(name: Column, content: Column) -> Column:
    """name@crc32 in hexadecimal."""
    return F.concat(name, F.lit("@"), F.lower(F.hex(F.crc32(content.cast("binary")))))


def file_version(name: Column, size: Column, mtime: Column) -> Column:
    return F.concat(name, F.lit("#"), size.cast("string"), F.lit("@"), mtime.cast("string"))
