"""Sources and sinks: frames, photos, charsets, model bytes, rectified images, settings, logs."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Collection, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Declared once, never inferred.
FRAME_SCHEMA = """session_id bigint, event_id bigint, timestamp_ms bigint, detected boolean, document_type string, confidence double,
quad struct<topLeft:struct<x:double,y:double>,topRight:struct<x:double,y:double>,bottomRight:struct<x:double,y:double>,bottomLeft:struct<x:double,y:double>>,
frame_width double, frame_height double, blur_score double, brightness double, glare_ratio double, motion_score double, distance_ratio double, perspective_skew_deg double, out_of_frame_ratio double"""
FACE_FRAME_SCHEMA = """session_id bigint, event_id bigint, timestamp_ms bigint, detected boolean, confidence double, box struct<x:double,y:double,width:double,height:double>,
landmarks struct<rightEye:struct<x:double,y:double>,leftEye:struct<x:double,y:double>,noseTip:struct<x:double,y:double>,rightMouthCorner:struct<x:double,y:double>,leftMouthCorner:struct<x:double,y:double>>,
frame_width double, frame_height double, blur_score double, brightness double, glare_ratio double, motion_score double"""
IMAGE_SCHEMA = "image_id bigint, width int, height int, row_stride int, pixel_format string, orientation string, is_mirrored boolean, data binary"
EMPTY_FRAME = {"detected": False, "document_type": "GENERIC", "confidence": 0.0, "frame_width": 0.0, "frame_height": 0.0, "blur_score": 0.0, "brightness": 0.0, "glare_ratio": 0.0, "motion_score": 0.0, "distance_ratio": 0.0, "perspective_skew_deg": 0.0, "out_of_frame_ratio": 0.0}
DEFAULT_DOCUMENT_TYPE = "PASSPORT"


def read_frames(spark: SparkSession, path: str, face: bool = False, stream: bool = False) -> DataFrame:
    """Frames from a folder of Parquet files, as a batch or as a stream."""
    schema = FACE_FRAME_SCHEMA if face else FRAME_SCHEMA
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).parquet(path)


def or_empty(frames: DataFrame) -> DataFrame:
    """Missing members of a frame row replaced by those of the empty row."""
    return frames.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in EMPTY_FRAME.items() if k in frames.columns})


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime, content of captured photos; a file:// prefix is as good as none."""
    return spark.read.format("binaryFile").load(path.removeprefix("file://"))


def read_charset(spark: SparkSession, path: str, profile: str = "android") -> list[str]:
    """Symbols of a charset file, one a line, a line of one space kept. android drops all empty lines, ios the last only.

    Bounded: a charset has some thousand lines at most; the file is read as one value.
    """
    text = spark.read.text(path, wholetext=True).first()
    lines = (text.value if text else "").replace("\r", "").split("\n")
    if profile == "android":
        return [x for x in lines if x]
    return lines[:-1] if lines and not lines[-1] else lines


def model_bytes(spark: SparkSession, path: str, assets: str) -> bytes:
    """A model's bytes: bundle://name lies in the assets folder, other paths stand for themselves."""
    if path == "bundle://":
        raise ValueError("a bundled model needs a name")
    where = f"{assets.rstrip('/')}/{path.removeprefix('bundle://')}" if path.startswith("bundle://") else path
    try:
        return bytes(spark.read.format("binaryFile").load(where).first().content)
    except Exception as e:
        raise FileNotFoundError(f"no model at {where}") from e


def bundled_path(name: str, listed: Collection[str]) -> str:
    """The resource of that name among those listed (paths in the bundle).

    First by base name and extension at the top of the bundle, then by the whole name in any of its folders.
    """
    base, dot, extension = name.rpartition(".")
    wanted = f"{base}.{extension}" if dot and base else name
    for found in ([p for p in sorted(listed) if p == wanted], [p for p in sorted(listed) if p.rsplit("/", 1)[-1] == name]):
        if found:
            return found[0]
    raise FileNotFoundError(f"no bundled model {name}")


class ImageFiles(DataSource):
    """The sink of write_image_files(): files of (image_id, content) in a folder that driver and executors mount."""

    @classmethod
    def name(cls) -> str:
        return "lensmill_images"

    def schema(self) -> str:
        return "image_id bigint, content binary"

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"].removeprefix("file://").rstrip("/"))


@dataclass
class WrittenPart(WriterCommitMessage):
    partition: int
    attempt: str
    n_files: int


class ImageWriter(DataSourceWriter):
    """Each attempt of a task fills a folder of its own beside the final ones. Committing renames one folder for each task, so
    neither a task that fails nor one that runs twice leaves a file; aborting takes all of them away."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex
        self.pending = f"{folder}/_pending-{self.job}"

    def write(self, iterator: Iterator[Row]) -> WrittenPart:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        os.makedirs(f"{self.pending}/{attempt}")
        n = 0
        for image_id, content in iterator:
            if content is not None:
                kind = "jpg" if content[:2] == bytes((255, 216)) else "pgm" if content[:2] == b"P5" else "ppm"
                with open(f"{self.pending}/{attempt}/{image_id}.{kind}", "wb") as f:
                    f.write(content)
                n += 1
        return WrittenPart(context.partitionId(), attempt, n)

    def commit(self, messages: list[WrittenPart | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        for m in messages:
            if m is not None and m.n_files:
                os.replace(f"{self.pending}/{m.attempt}", f"{self.folder}/part-{m.partition:05}-{self.job}")
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[WrittenPart | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


def write_image_files(images: DataFrame, folder: str) -> DataFrame:
    """Writes rectified images, now and once, as files named by their ids; returns image_id, path of all that the folder holds.

    images: image_id, content (null: no file). The files of one call appear together, in one subfolder for each task.
    """
    spark = images.sparkSession
    spark.dataSource.register(ImageFiles)
    images.select(F.col("image_id").cast("long"), "content").write.format("lensmill_images").mode("append").option("path", folder).save()
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,pgm,ppm}").load(folder)
    return own.select(F.regexp_extract("path", "(-?[0-9]+)[.][a-z]+$", 1).cast("long").alias("image_id"), "path")


def write_images(images: DataFrame, path: str) -> None:
    """Sink for rectified images: (image_id, content) as Parquet, one row an image, executors writing in parallel."""
    images.select("image_id", "content").write.mode("append").parquet(path)


def _settings(spark: SparkSession, path: str):
    """The file that holds the settings, in a folder, and how to reach it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    own = hadoop.Path(f"{path.rstrip('/')}/settings.json")
    return own, hadoop.FileContext.getFileContext(own.toUri(), spark._jsc.hadoopConfiguration()) if own.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    own, files = _settings(spark, path)
    if not files.util().exists(own):
        return {}
    stream = files.open(own)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_setting(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Sets a key; the table of all keys is one file, replaced in one step, so a reader sees it before or after. One writer at a time."""
    own, files = _settings(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    text = json.dumps(read_settings(spark, path) | {key: value}, sort_keys=True)
    files.mkdir(own.getParent(), None, True)
    new = hadoop.Path(own.getParent(), f"_settings-{uuid.uuid4().hex}.json")
    create, gateway = getattr(hadoop, "CreateFlag"), spark.sparkContext._gateway
    stream = files.create(new, spark._jvm.java.util.EnumSet.of(create.CREATE), gateway.new_array(getattr(hadoop, "Options$CreateOpts"), 0))
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    how = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    files.rename(new, own, how)


def read_setting(spark: SparkSession, path: str, key: str, default: str | None = None) -> str | None:
    return read_settings(spark, path).get(key, default)


def start_lines(captures: DataFrame) -> DataFrame:
    return captures.select("capture_id", F.concat(F.lit("[capture] started "), "document_type").alias("line"))


def ocr_lines(captures: DataFrame) -> DataFrame:
    """Log text of raw OCR: a head, the full text, then a line for each text line; numbers to three places, seq is their order."""
    f3 = lambda x: F.format_number(x, 3)
    head = F.concat(F.lit("[ocr] "), "document_type", F.lit(" confidence="), f3(F.col("confidence")), F.lit(" lines="), F.size("lines"))
    full = F.concat(F.lit("[ocr] text: "), F.when(F.col("text") == "", "(empty)").otherwise(F.col("text")))
    box = lambda l: F.concat_ws(",", *[f3(l[k]) for k in ("x", "y", "width", "height")])
    own = F.transform("lines", lambda l, i: F.concat(F.lit("[ocr] line "), i, F.lit(" confidence="), f3(l["confidence"]), F.lit(" box="), box(l), F.lit(" text="), l["text"]))
    return captures.select("capture_id", F.posexplode(F.concat(F.array(head, full), own)).alias("seq", "line"))


def read_document_type(spark: SparkSession, path: str) -> str:
    """The last document type that was written as a setting, or the default."""
    return read_setting(spark, path, "document_type", DEFAULT_DOCUMENT_TYPE)


def log_lines(results: DataFrame) -> DataFrame:
    """Log text of extraction results: success, type, confidence to three places, and the fields as JSON."""
    fields = [c for c in results.columns if c not in ("success", "confidence")]
    line = F.concat(F.lit("[extract] "), F.when(F.col("success"), "ok ").otherwise("failed "), F.col("document_type"), F.lit(" confidence="), F.format_number("confidence", 3), F.lit(" "), F.to_json(F.struct(*fields)))
    return results.select("capture_id", line.alias("line"))
