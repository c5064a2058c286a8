"""Frame and capture pipelines with stub models, orientation and formats of pixels, sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensmill.functions import frames, geometry, pixels, tensors
from lensmill.operators import vision
from lensmill.plans import queries as q
from lensmill.sources import media
from lensmill.streaming import capture

IMAGE = "session_id bigint, event_id bigint, timestamp_ms bigint, width int, height int, row_stride int, pixel_format string, orientation string, is_mirrored boolean, data binary"


def images(spark, *rows):
    return spark.createDataFrame([(1, k, k, *r) for k, r in enumerate(rows)], IMAGE)


def test_orientation_and_size():
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    at = lambda o, m: pixels.oriented(gray, o, m)
    assert at("up", True)[0].tolist() == [3, 2, 1, 0] and at("down", False)[0].tolist() == [11, 10, 9, 8]
    assert at("right", False)[0].tolist() == [8, 4, 0] and at("left", False)[0].tolist() == [3, 7, 11]
    large = np.tile(np.arange(960, dtype=np.uint16)[None] // 4, (600, 1)).astype(np.uint8)
    small = pixels.downscale(large)
    assert small.shape == (300, 480) and abs(int(small[0, 240]) - 120) <= 1
    shape, sx, sy = pixels.text_input(np.zeros((70, 2000), np.uint8))
    assert shape.shape == (64, 960) and (sx, sy) == (0.48, 64 / 70)
    assert pixels.text_input(np.zeros((70, 2000), np.uint8), profile="ios")[0].shape == (32, 960)


def test_formats():
    rgb = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 255, 255]]], np.uint8)
    assert pixels.to_gray(rgb.tobytes(), 2, 2, 6, "rgb").tolist() == [[76, 150], [29, 255]]
    bgra = np.concatenate([rgb[..., ::-1], np.full((2, 2, 1), 9, np.uint8)], axis=2)
    assert pixels.to_gray(bgra.tobytes(), 2, 2, 8, "bgra").tolist() == [[76, 150], [29, 255]]
    assert pixels.bgr_of(rgb.tobytes(), 2, 2, 6, "rgb", (1, 0, 1, 2)).tolist() == [[[0, 255, 0]], [[255, 255, 255]]]
    nv12 = bytes([81] * 4 + [90, 240])
    assert np.abs(pixels.bgr_of(nv12, 2, 2, 2, "nv12").astype(int) - [14, 14, 238]).max() <= 1
    assert pixels.tensor(np.full((1, 1), 51, np.uint8), (0.1,) * 3, (0.5,) * 3).ravel().tolist() == pytest.approx([0.2] * 3)
    assert pixels.tensor(rgb, raw=True)[0, 0].tolist() == [[255, 0], [0, 255]]


def test_crops_and_decoders():
    image = np.arange(200, dtype=np.uint8).reshape(20, 10)
    tall = np.array([[0, 0], [9, 0], [9, 19], [0, 19]], float)
    assert pixels.text_crop(image, tall).shape == (19, 9) and pixels.text_crop(image, tall, "ios").shape == (9, 19)
    assert vision.rectify(image, [0, 0, 3, 0, 3, 3, 0, 3], "ios") is image and vision.rectify(image, [0, 0, 3, 0, 3, 3, 0, 3]).shape == (3, 3)
    with pytest.raises(ValueError, match="netpbm.*own"):
        pixels.decode(b"junk", (pixels.netpbm, lambda x: (_ for _ in ()).throw(ValueError("own"))))
    assert pixels.decode(b"P5\n2 1\n255\nab").tolist() == [[97, 98]]


def test_document_frames(spark):
    """A model's corners, the contours where it fails or answers in no known shape, and the empty row of a bad frame."""
    scene = np.full((120, 160), 20, np.uint8)
    scene[20:100, 30:130] = 220
    flat = np.full((120, 160), 90, np.uint8)
    row = lambda g, kind="yuv": (160, 120, 160, kind, "up", False, bytearray(g.tobytes()))
    given = images(spark, row(scene), row(flat), row(scene, "heic"))

    def odd(x):
        if x.mean() > 0.38:
            return [np.zeros((1, 7))]
        raise RuntimeError("no")

    found = {r.event_id: r for r in vision.document_frames(given, odd, q.constant_type, size=32).collect()}
    assert found[0].detected and found[0].document_type == "VISA" and abs(found[0].quad.topLeft.x - 30) <= 3 and found[0].confidence > 0.9
    assert not found[1].detected and found[1].document_type == "GENERIC" and found[1].brightness == 90 and found[1].quad is None
    assert not found[2].detected and (found[2].confidence, found[2].frame_width, found[2].blur_score, found[2].distance_ratio) == (0, 0, 0, 0)
    own = {r.event_id: r for r in vision.document_frames(given, q.constant_corners, profile="ios", size=32).collect()}
    assert own[1].detected and own[1].confidence == 0.9 and own[1].quad.topLeft.x == pytest.approx(16) and own[1].motion_score > 0.1
    none = lambda x: [np.full((1, 4, 2, 2), 0.0)]
    assert vision.document_frames(given, none, profile="ios", size=32).where("detected").count() == 0
    assert vision.document_frames(given.where("false"), odd).count() == 0 and vision.face_frames(given, None).where("detected").count() == 0


def test_best_face(spark):
    box = lambda x, s: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"), F.lit(s).alias("score"))
    r = spark.range(1).select(tensors.best_face(F.array(box(0.0, 0.75), box(1.0, 0.9), box(50.0, 0.6))).alias("b"), tensors.best_face(F.array(box(0.0, 0.6))).alias("none")).first()
    assert r.b.x == 1.0 and r.none is None


def test_captures(spark):
    photos = spark.createDataFrame([(1, "ID_CARD", bytearray(b"P5\n16 12\n255\n" + bytes([10]) * 192), None), (2, "ID_CARD", bytearray(b"junk"), None)], "capture_id bigint, document_type string, content binary, quad array<double>")
    models = {"text_detector": q.one_line, "text_direction": lambda x: [np.array([[0.0, 1.0]])], "text_recogniser": q.by_brightness}
    rows = {r.capture_id: r for r in vision.capture_texts(photos, models, list(q.READ_CHARSET)).collect()}
    assert rows[1].text == "A B" and rows[1].error is None and rows[1].rectified is None
    assert rows[2].text == "" and rows[2].confidence == 0 and "no decoder" in rows[2].error
    with pytest.raises(ValueError, match="text_recogniser"):
        vision.capture_texts(photos, models | {"text_recogniser": None}, ["A"])
    with pytest.raises(ValueError, match="charset"):
        vision.capture_texts(photos, models, [])
    logs = [r.line for r in media.ocr_lines(vision.capture_texts(photos, models, list(q.READ_CHARSET)).where("capture_id = 1")).orderBy("seq").collect()]
    assert len(logs) == 3 and "lines=1" in logs[0] and logs[2].endswith("text=A B") and media.start_lines(photos).count() == 2


def test_reading_order(spark):
    line = "array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>"
    lines = [("b", 0.5, 0.4, 0.1, 0.1, 0.1), ("a", 0.7, 0.1, 0.1, 0.1, 0.1), (" ", 0.9, 0.0, 0.0, 0.1, 0.1), ("top", 0.9, 0.9, 0.0, 0.1, 0.1)]
    own = spark.createDataFrame([(lines,)], f"lines {line}")
    texts = lambda profile: [r.text for r in own.select(frames.in_reading_order(frames.readable(F.col("lines"), profile), profile).alias("o")).first().o]
    assert texts("android") == ["top", "a", "b"] and texts("ios") == [" ", "top", "b", "a"]


def test_sizes_and_profiles(spark):
    """Lines and direction inputs by the declared size and the profile; a face output that is missing."""
    seen = []

    def model(x):
        seen.append(x.shape[2:])
        return [np.zeros((1, 3, 4), np.float32)]

    wide = np.full((10, 100), 200, np.uint8)
    for profile, width in (("android", 320), ("ios", 480)):
        vision.recognised(wide, model, profile)
        assert seen.pop() == (48, width)
    model.input_size = lambda height, width: (32, width)
    vision.recognised(wide[:, :11], model, "android")
    vision.recognised(wide[:, :17], model, "ios")
    assert seen == [(32, 35), (32, 54)]
    stretched, padded = (vision.direction_input(wide[:, :15], 48, 192, p) for p in ("android", "ios"))
    assert stretched.shape == padded.shape == (48, 192) and stretched.min() == 200 and padded[:, :72].min() == 200 and padded[:, 72:].max() == 0

    def partial(x):
        out = {f"{n}_{s}": np.zeros(((64 // s) ** 2, k)) for s in (8, 16, 32) for n, k in (("cls", 1), ("obj", 1), ("bbox", 4), ("kps", 10))}
        out["cls_16"][5] = out["obj_16"][5] = 1.0
        del out["kps_32"]
        return out

    given = images(spark, (30, 20, 30, "yuv", "up", False, bytearray(bytes([90]) * 600)))
    found = {p: vision.face_frames(given, partial, 64, p).first().detected for p in ("android", "ios")}
    assert found == {"android": False, "ios": True}


def test_models_and_idle(spark):
    read = lambda path: (_ for _ in ()).throw(FileNotFoundError(path)) if "gone" in path else path.encode()
    paths = {n: n for n in vision.REQUIRED} | {"classifier": "gone"}
    pack = vision.load_models(read, paths, lambda name, content: content)
    assert pack["detector"] == b"detector" and pack["classifier"] is None and pack["face_detector"] is None
    with pytest.raises(FileNotFoundError):
        vision.load_models(read, paths | {"text_detector": "gone"}, lambda name, content: content)
    assert vision.static_size([1, 3, 48, "w"], 32, 320) == (48, 320) and vision.static_size([], 48, 192) == (48, 192)
    assert media.bundled_path("a.b.txt", ["x/a.b.txt", "c.onnx"]) == "x/a.b.txt" and media.bundled_path("c.onnx", ["c.onnx", "x/c.onnx"]) == "c.onnx"
    idle = spark.range(1).select(frames.idle_guidance().alias("d"), frames.idle_guidance(True).alias("f")).first()
    assert (idle.d.code, idle.d.is_valid, idle.d.is_correct_document_type, idle.d.has_document, idle.f.code) == ("NO_DOCUMENT", False, True, False, "NO_FACE")


def test_sinks(spark, tmp_path):
    own = spark.createDataFrame([(1, bytearray(b"P5\n1 1\n255\nx")), (2, None)], "image_id bigint, content binary")
    found = media.write_image_files(own, str(tmp_path)).collect()
    assert [r.image_id for r in found] == [1] and open(found[0].path.removeprefix("file:"), "rb").read().endswith(b"x")
    stages = spark.createDataFrame([(1, 5, "capturing", 1.0), (2, 6, "capturing", 1.0), (3, 7, "idle", 0.0)], capture.OUTPUT)
    seen = []
    sink = capture.capture_sink(lambda shots: shots.withColumn("success", F.col("session_id") == 1), f"{tmp_path}/r", f"{tmp_path}/c", lambda rows, k: seen.append((k, rows.count())))
    sink(stages, 0)
    sink(stages, 0)
    kinds = sorted((r.session_id, r.order, r.kind) for r in spark.read.parquet(f"{tmp_path}/c").collect())
    assert kinds == [(1, 0, "processing"), (1, 1, "completed"), (2, 0, "processing"), (2, 1, "failed")] and seen == [(0, 2), (0, 2)]
    assert media.read_document_type(spark, f"{tmp_path}/none") == "PASSPORT"
    empty = spark.createDataFrame([(None, None)], "detected boolean, document_type string")
    assert media.or_empty(empty).first().document_type == "GENERIC"


def test_frames_from_files(spark, tmp_path):
    q.frames(spark, "/root/testdata/sf0.001").limit(5).write.parquet(str(tmp_path / "f"))
    assert media.read_frames(spark, str(tmp_path / "f")).where("quad IS NOT NULL").count() > 0
    assert geometry.CORNERS[0] == "topLeft" and media.read_frames(spark, str(tmp_path / "f"), stream=True).isStreaming
