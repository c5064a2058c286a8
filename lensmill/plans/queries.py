"""The engine's queries: each applies operators to a projection of the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.functions import documents, geometry, guidance, mrz, tensors
from lensmill.functions import frames as rows
from lensmill.operators import registry, sequences, tables, vision
from lensmill.plans import fixtures
from lensmill.plans.fixtures import projected, table
from lensmill.sources.stored import shared_folder
from lensmill.streaming import capture
from lensmill.streaming.ordered import stateful_session

AS_OF_YEAR = 2026


def r6(x: Column) -> Column:
    """Rounded half up at six places, the same way in either engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames mapped to the nested row: quad null where nothing is detected, type coerced, ratios computed."""
    raw = projected(spark, sf_dir, fixtures.FRAMES_SQL)
    quad = geometry.quad_of([geometry.point(F.col(f"{c}_x"), F.col(f"{c}_y")) for c in ("tl", "tr", "br", "bl")])
    return rows.document_row(raw.withColumn("quad", quad))


def face_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    raw = projected(spark, sf_dir, fixtures.FACE_FRAMES_SQL)
    box = geometry.box_of(c("box_x"), c("box_y"), c("box_w"), c("box_h"))
    middle = geometry.point((c("right_x") + c("left_x")) / 2, c("right_y") + 60)
    marks = F.struct(geometry.point(c("right_x"), c("right_y")).alias("rightEye"), geometry.point(c("left_x"), c("left_y")).alias("leftEye"), middle.alias("noseTip"), middle.alias("rightMouthCorner"), middle.alias("leftMouthCorner"))
    return rows.face_row(raw.withColumn("face", F.when(c("detected"), F.struct(box.alias("box"), marks.alias("landmarks"), c("confidence").alias("confidence")))))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidance.with_guidance(frames(spark, sf_dir), F.lit("PASSPORT"))


def g_geometry(spark, sf_dir):
    f = frames(spark, sf_dir)
    q, w, h = F.col("raw_quad"), F.col("frame_width"), F.col("frame_height")
    center = geometry.quad_center(q)
    return f.select(
        "event_id", r6(geometry.distance(q["topLeft"], q["topRight"])).alias("top_edge"), r6(center["x"]).alias("center_x"), r6(center["y"]).alias("center_y"),
        r6(geometry.quad_area(q)).alias("area"), r6(geometry.center_offset_ratio(q, w, h)).alias("offset_ratio"), r6(geometry.quad_rotation_deg(q)).alias("rotation_deg"),
        r6(F.col("perspective_skew_deg")).alias("skew_deg"), r6(F.col("out_of_frame_ratio")).alias("out_ratio"), r6(F.col("distance_ratio")).alias("distance_ratio"),
    )


def g_bbox_and_domain(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select("event_id", "document_type", *[F.col(f"bounding_box.{k}").alias(f"box_{k}") for k in ("x", "y", "width", "height")], F.coalesce("quad.topLeft.x", F.lit(-1.0)).alias("tl_x_or_default"))


def g_order_points(spark, sf_dir):
    f = frames(spark, sf_dir)
    own = geometry.corners(F.col("raw_quad"))
    ordered = f.withColumn("o", geometry.order_points([own[2], own[0], own[3], own[1]]))
    return ordered.select("event_id", *[F.col(f"o.{c}.{k}").alias(f"{c.lower()}_{k}") for c in geometry.CORNERS for k in "xy"])


def g_orientation(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("orientation", F.element_at(F.array(*map(F.lit, ("up", "right", "down", "left"))), (F.col("event_id") % 4 + 1).cast("int")))
    mirrored = F.col("event_id") % 3 == 0
    w, h, o = F.col("frame_width"), F.col("frame_height"), F.col("orientation")
    dw, dh = geometry.oriented_size(w, h, o)
    f = f.withColumns({"q": geometry.orient_quad(F.col("raw_quad"), w, h, o, mirrored), "b": geometry.orient_box(geometry.corner_box(F.col("raw_quad")), w, h, o, mirrored)})
    return f.select("event_id", dw.alias("display_width"), dh.alias("display_height"), *[F.col(f"q.{c}.{k}").alias(f"{c.lower()}_{k}") for c in geometry.CORNERS for k in "xy"], *[F.col(f"b.{k}").alias(f"box_{k}") for k in ("x", "y", "width", "height")])


def g_clamp(spark, sf_dir):
    f = frames(spark, sf_dir)
    f = f.withColumns({"q": geometry.clamp_quad(F.col("raw_quad"), F.col("frame_width"), F.col("frame_height"))})
    f = f.withColumn("b", geometry.bounding_rect(F.col("q"))).withColumn("n", geometry.normalised_rect(F.col("b"), F.col("frame_width"), F.col("frame_height")))
    return f.select("event_id", *[F.col(f"q.{c}.{k}").alias(f"{c.lower()}_{k}") for c in geometry.CORNERS for k in "xy"], *[F.col(f"b.{k}").alias(f"box_{k}") for k in ("width", "height")], *[r6(F.col(f"n.{k}")).alias(f"norm_{k}") for k in ("x", "y")])


def g_view_scale(spark, sf_dir):
    f = frames(spark, sf_dir)
    sx, sy = geometry.view_scale(390.0, F.col("frame_width")), geometry.view_scale(844.0, F.when(F.col("event_id") % 17 == 0, 0.0).otherwise(F.col("frame_height")))
    f = f.withColumns({"q": geometry.scale_quad(F.col("raw_quad"), sx, sy), "g": geometry.guide_rect(F.lit(390.0) + F.col("event_id") % 5, F.lit(844.0))})
    fade = geometry.edge_fade((F.col("event_id") % 101) / 100)
    path = geometry.add_file_scheme(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("file:///p/"), F.col("event_id"))).otherwise(F.concat(F.lit("/p/"), F.col("event_id"))))
    return f.select("event_id", r6(F.col("q.bottomRight.x")).alias("view_x"), r6(F.col("q.bottomRight.y")).alias("view_y"), *[r6(F.col(f"g.{k}")).alias(f"guide_{k}") for k in ("x", "y", "width", "height")], r6(fade).alias("fade"), path.alias("photo_uri"), geometry.strip_file_scheme(path).alias("photo_path"), geometry.multiple_of_32((F.col("event_id") % 1500).cast("double")).alias("side32"))


def guidance_flags(spark, sf_dir):
    return judged(spark, sf_dir).select("event_id", *guidance.FLAGS, "is_valid")


def guidance_code(spark, sf_dir):
    return judged(spark, sf_dir).select("session_id", "event_id", "timestamp_ms", "code", "message", "is_valid", "confidence")


def guidance_code_counts(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"))


def face_geometry(spark, sf_dir):
    f = face_frames(spark, sf_dir).where(F.col("box").isNotNull())
    center = geometry.box_center(F.col("box"))
    return f.select("event_id", center["x"].alias("center_x"), center["y"].alias("center_y"), r6(geometry.box_offset_ratio(F.col("box"), F.col("frame_width"), F.col("frame_height"))).alias("offset_ratio"), r6(geometry.eye_tilt_deg(F.col("landmarks"))).alias("tilt_deg"))


def face_guidance(spark, sf_dir):
    return guidance.with_face_guidance(face_frames(spark, sf_dir)).select("event_id", *guidance.FACE_FLAGS, "code", "message", "is_valid", r6(F.col("size_ratio")).alias("size_ratio"))


def quality_indicators(spark, sf_dir):
    f = frames(spark, sf_dir)
    found = guidance.indicators()
    names = {"blurScore": "blur", "brightness": "light", "glareRatio": "glare", "motionScore": "motion", "distanceRatio": "distance", "perspectiveSkewDeg": "skew"}
    return f.select("event_id", *[x for k, (_, passed, score) in found.items() for x in (passed.alias(f"{names[k]}_passed"), r6(score).alias(f"{names[k]}_score"))])


def quality_score(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", guidance.quality_score().cast("long").alias("quality_score"), F.floor(F.col("confidence") * 100 + 0.5).cast("long").alias("percent"))


def mrz_fields(spark, sf_dir):
    """Check digit, repair, dates and sex of bare fields."""
    parts = projected(spark, sf_dir, fixtures._PARTS)
    parts = parts.withColumn("number", F.concat(F.lit("L"), F.substring("doc_no", 2, 8))).withColumn("check", F.concat(F.col("c_custkey") % 10))
    spoiled = F.when(F.col("c_custkey") % 3 == 0, F.translate("dob", "0", "O")).otherwise(F.col("dob"))
    parts = parts.withColumns({"n": mrz.reconcile(F.col("number"), F.col("check"), 9), "d": mrz.reconcile(spoiled, mrz.check_digit(F.col("dob"), 6).cast("string"), 6)})
    return parts.select(
        "c_custkey", mrz.check_digit(F.col("number"), 9).alias("number_check"), F.col("n.value").alias("number_value"), F.col("n.ok").alias("number_ok"), F.col("d.value").alias("dob_value"), F.col("d.ok").alias("dob_ok"),
        mrz.mrz_date(F.col("d.value"), True, AS_OF_YEAR).alias("born"), mrz.mrz_date(F.col("expiry"), False, AS_OF_YEAR).alias("expires"), mrz.clean_name(F.col("names")).alias("clean_names"), mrz.strip_fillers(F.col("names")).alias("stripped"), mrz.to_letters(F.col("doc_no")).alias("lettered"), mrz.gender(F.element_at(F.array(*map(F.lit, "MF<")), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("gender"),
    )


def mrz_parse(spark, sf_dir):
    own = mrz.with_mrz(projected(spark, sf_dir, fixtures.MRZ_SQL), "text", AS_OF_YEAR)
    return own.select("c_custkey", "ok", "kind", F.coalesce("format", F.lit("")).alias("format"), "valid_checks", *mrz.FIELDS)


def captures(spark, sf_dir, sql: str, kind: str) -> DataFrame:
    """capture_id, document_type, text, lines, confidence from one row a line; a capture's lines are few."""
    return rows.captures_of(projected(spark, sf_dir, sql), F.lit(kind))


def ocr_fulltext(spark, sf_dir):
    own = captures(spark, sf_dir, fixtures.CARD_LINES_SQL, "ID_CARD")
    return own.select("capture_id", F.col("text").alias("full_text"), r6(F.col("confidence")).alias("mean_confidence"), F.size("lines").alias("n_lines"))


def licence_parse(spark, sf_dir):
    own = documents.with_licence(captures(spark, sf_dir, fixtures.LICENCE_LINES_SQL, "DRIVING_LICENCE"), as_of_year=AS_OF_YEAR)
    return own.select("capture_id", "ok", "full_name", "licence_number", "date_of_birth", "issue_date", "expiry_date", "address", "country")


def licence_categories(spark, sf_dir):
    own = documents.with_licence(captures(spark, sf_dir, fixtures.LICENCE_LINES_SQL, "DRIVING_LICENCE"), as_of_year=AS_OF_YEAR)
    return own.select("capture_id", F.array_join("categories", ",").alias("categories"))


def id_parse(spark, sf_dir):
    own = documents.with_id_card(captures(spark, sf_dir, fixtures.CARD_LINES_SQL, "ID_CARD"), as_of_year=AS_OF_YEAR)
    return own.select("capture_id", "ok", "full_name", "id_number", "date_of_birth", "expiry_date", "address", "nationality")


def all_captures(spark, sf_dir) -> DataFrame:
    """Captures of all types; those of cards have odd ids, of licences even ones, of zones negative ones."""
    numbered = lambda own, k: own.withColumn("capture_id", 2 * F.col("capture_id") + k)
    licences = numbered(captures(spark, sf_dir, fixtures.LICENCE_LINES_SQL, "DRIVING_LICENCE"), 0)
    cards = numbered(captures(spark, sf_dir, fixtures.CARD_LINES_SQL, "RESIDENCE_PERMIT"), 1)
    zones = projected(spark, sf_dir, fixtures.MRZ_SQL)
    kind = F.when(F.col("c_custkey") % 13 == 0, "GENERIC").when(F.col("c_custkey") % 2 == 0, "VISA").otherwise("PASSPORT")
    zones = zones.select((-F.col("c_custkey")).alias("capture_id"), kind.alias("document_type"), F.lit(None).cast(cards.schema["lines"].dataType).alias("lines"), F.when(F.col("c_custkey") % 17 == 0, " \n ").otherwise(F.col("text")).alias("text"), F.lit(0.5).alias("confidence"))
    return licences.unionByName(cards).unionByName(zones)


def extract_document(spark, sf_dir):
    """All captures of all types through the dispatcher."""
    own = documents.extract(all_captures(spark, sf_dir), AS_OF_YEAR)
    own = own.withColumn("confidence", r6(F.col("confidence")))
    return own.withColumn("mrz_valid", F.coalesce(F.col("mrz_valid").cast("string"), F.lit("null")))


def throttle(spark, sf_dir):
    return sequences.throttle(frames(spark, sf_dir).select("session_id", "event_id", "timestamp_ms"))


def stability_gate(spark, sf_dir):
    own = sequences.stability_gate(judged(spark, sf_dir).select("session_id", "event_id", "timestamp_ms", "is_valid"))
    return own.select("session_id", "event_id", "stage", r6(F.col("stability_progress")).alias("stability_progress"), F.coalesce("captured_at", F.lit(-1)).alias("captured_at"))


def latest_state(spark, sf_dir):
    own = judged(spark, sf_dir).select("session_id", "event_id", "timestamp_ms", "code", "is_valid", "frame_width", "frame_height")
    return sequences.latest(own, "code", "is_valid", "frame_width", "frame_height")


def asof_quad(spark, sf_dir):
    """The quad of the last frame at or up to 119 ms before each frame's shifted time."""
    f = frames(spark, sf_dir)
    shots = f.select("session_id", F.col("event_id").alias("capture_id"), (F.col("timestamp_ms") - F.col("event_id") % 120).alias("timestamp_ms"))
    own = sequences.asof_quad(shots, f)
    return own.select("session_id", "capture_id", "timestamp_ms", F.coalesce("frame_ms", F.lit(-1)).alias("frame_ms"), F.coalesce("quad.topLeft.x", F.lit(-1.0)).alias("tl_x"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def heatmap_decode(spark, sf_dir):
    """64 values as four 4x4 channels, and the first eight as a direct regression."""
    v = _vectors(spark, sf_dir)
    own = [tensors.heatmap_corner(F.slice("embedding", 16 * c + 1, 16), 4, 4) for c in range(4)]
    v = v.withColumns({f"c{i}": x for i, x in enumerate(own)})
    direct = [r6(tensors.direct_value(F.get("embedding", F.lit(i)))).alias(f"direct_{i}") for i in range(8)]
    score = sum((F.col(f"c{i}.peak") for i in range(4)), F.lit(0.0)) / 4
    scaled = [r6(geometry.model_to_frame(F.col(f"c{i}.{k}"), F.lit(0.256 if k == "x" else 0.32), F.lit(1000.0 if k == "x" else 800.0))).alias(f"frame_{k}{i}") for i in range(4) for k in "xy"]
    return v.select("vec_id", *[F.col(f"c{i}.{k}").alias(f"{k}{i}") for i in range(4) for k in "xy"], r6(score).alias("confidence"), *direct, *scaled)


def class_softmax(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("c", tensors.classify(F.transform(F.slice("embedding", 1, 6), lambda x: x * 8)))
    return v.select("vec_id", F.col("c.label").alias("label"), r6(F.col("c.confidence")).alias("confidence"), F.col("c.trusted").alias("trusted"))


CHARSET = ("A", "B", "C", "D", "E", "F")


def ctc_decode(spark, sf_dir):
    """64 values as 8 steps of 8 classes over a charset of six: class 7 is the space beyond it."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, 8))
    v = _vectors(spark, sf_dir).withColumn("c", tensors.ctc(steps, F.array(*map(F.lit, CHARSET)), 8))
    return v.select("vec_id", F.col("c.text").alias("text"), r6(F.col("c.confidence")).alias("confidence"))


def ctc_decode_ios(spark, sf_dir):
    """The same without a space: the class beyond the charset is dropped."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, 8))
    v = _vectors(spark, sf_dir).withColumn("c", tensors.ctc(steps, F.array(*map(F.lit, CHARSET)), 8, "ios"))
    return v.select("vec_id", F.col("c.text").alias("text"), r6(F.col("c.confidence")).alias("confidence"))


def face_decode(spark, sf_dir):
    """64 values as a 2x2 grid of stride 32, 16 values a cell: every cell's face, before suppression."""
    v = _vectors(spark, sf_dir)
    e = lambda i, k: F.get("embedding", 16 * i + k).cast("double")

    def cell(i: Column) -> Column:
        return tensors.face_cell(F.abs(e(i, 0)) * 3, F.abs(e(i, 1)) * 3, F.array(*[e(i, 2 + k) for k in range(4)]), F.array(*[e(i, 6 + k) for k in range(10)]), F.floor(i / 2), i % 2, F.lit(32))

    own = v.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), cell)).alias("cell", "f"))
    return own.select("vec_id", "cell", *[r6(F.col(f"f.{k}")).alias(k) for k in ("x", "y", "w", "h", "score")], r6(F.col("f.landmarks")[0]["x"]).alias("eye_x"), r6(F.col("f.landmarks")[4]["y"]).alias("mouth_y"))


def _boxes(spark, sf_dir):
    """Eight boxes a vector: positions and scores from eight values each."""
    v = _vectors(spark, sf_dir)
    e = lambda i, k: F.get("embedding", 8 * i + k).cast("double")
    one = lambda i: F.struct((e(i, 0) * 100).alias("x"), (e(i, 1) * 100).alias("y"), (F.abs(e(i, 2)) * 100 + 20).alias("w"), (F.abs(e(i, 3)) * 100 + 20).alias("h"), (F.abs(e(i, 4)) * 2 + 0.5).alias("score"), i.alias("cell"))
    return v.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), one).alias("boxes"))


def nms(spark, sf_dir):
    own = _boxes(spark, sf_dir).select("vec_id", F.posexplode(tensors.nms(F.col("boxes"))).alias("rank", "b"))
    return own.select("vec_id", "rank", F.col("b.cell").alias("cell"), r6(F.col("b.score")).alias("score"))


def registrations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("m"), F.col("p_partkey") % 50).alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("license"), F.col("p_partkey").alias("registered_seq"))


def activation_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 100).alias("app_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("m"), (F.col("o_orderkey") * 7) % 60).alias("model_id"))


def registry_latest(spark, sf_dir):
    own = registry.latest_models(registrations(spark, sf_dir))
    return own.select("id", "label", "license", "registered_seq")


def model_version(spark, sf_dir):
    """Versions by crc32."""
    own = registry.latest_models(registrations(spark, sf_dir))
    return own.select("id", registry.version(F.col("id"), F.col("label")).alias("version"))


def registry_active(spark, sf_dir):
    models = registry.latest_models(registrations(spark, sf_dir))
    return registry.active_model(activation_log(spark, sf_dir), models)


def registry_activations(spark, sf_dir):
    models = registry.latest_models(registrations(spark, sf_dir))
    return registry.activations(activation_log(spark, sf_dir), models).groupBy("app_id", "outcome").agg(F.count("*").alias("n"))


IMAGE_W, IMAGE_H = 16, 12


def partitions(spark) -> int:
    """A stated number, as adaptive execution would join parts that hold nothing but ids."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What images() computes from an event_id depends on its remainder by this alone: pixels go by 256 and 5.
DISTINCT_IMAGES = 256 * 5


def images(spark, sf_dir):
    """A 16 x 12 gray image for each event, rows padded to a stride of 20, pixels by arithmetic."""
    # Ids alone are dealt out, before each becomes an image, as the table may be one small file.
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"))
    e = e.repartition(partitions(spark), "event_id").withColumn("remainder", F.col("event_id") % DISTINCT_IMAGES)
    value = lambda i: F.pmod(F.col("remainder") * 31 + (i % 20) * 7 + F.floor(i / 20) * 13 + (i % 20) * F.floor(i / 20) * (F.col("remainder") % 5), F.lit(256))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(20 * IMAGE_H - 1)), lambda i: F.lpad(F.hex(value(i)), 2, "0")), "")
    data = spark.range(1 - DISTINCT_IMAGES, DISTINCT_IMAGES).withColumnRenamed("id", "remainder").select("remainder", F.unhex(text).alias("data"))
    e = e.join(F.broadcast(data), "remainder", "left")
    return e.select(
        F.col("event_id").alias("image_id"), "session_id", "event_id", F.col("event_id").alias("timestamp_ms"), F.lit(IMAGE_W).alias("width"), F.lit(IMAGE_H).alias("height"),
        F.lit(20).alias("row_stride"), F.lit("yuv").alias("pixel_format"), F.lit("up").alias("orientation"), F.lit(False).alias("is_mirrored"), F.coalesce("data", F.lit(b"")).alias("data"),
    )


def pix_quality(spark, sf_dir):
    own = vision.frame_quality(images(spark, sf_dir))
    return own.select("image_id", r6(F.col("blur_score")).alias("blur_score"), r6(F.col("brightness")).alias("brightness"), r6(F.col("glare_ratio")).alias("glare_ratio"))


def pix_motion(spark, sf_dir):
    own = vision.thumbnails(images(spark, sf_dir), carry=("session_id", "event_id", "timestamp_ms"))
    return sequences.motion(own).select("session_id", "event_id", r6(F.col("motion_score")).alias("motion_score"))


def constant_corners(x):
    """A detector that finds the same quad in every image."""
    return [np.array([[0.1, 0.25, 0.9, 0.25, 0.9, 0.75, 0.1, 0.75]])]


def constant_heatmaps(x):
    """One that gives its corners as heatmaps of 4 x 4 cells."""
    out = np.zeros((1, 4, 4, 4), np.float32)
    for c, (row, column) in enumerate(((0, 0), (0, 3), (3, 3), (3, 0))):
        out[0, c, row, column] = 0.5 + c / 10
    return [out]


def constant_type(x):
    """A classifier that calls every document a visa."""
    return [np.array([[0.0, 0.0, 0.0, 0.0, 6.0, 0.0]])]


def constant_face(x):
    """A face detector that finds one face, in row 3 and column 4 of the finest grid, at any input size."""
    size = x.shape[2]
    out = {f"{n}_{s}": np.zeros(((size // s) ** 2, k)) for s in (8, 16, 32) for n, k in (("cls", 1), ("obj", 1), ("bbox", 4), ("kps", 10))}
    cell = 3 * (size // 8) + 4
    out["cls_8"][cell], out["obj_8"][cell], out["bbox_8"][cell], out["kps_8"][cell] = 0.81, 1.0, (0.5, 0.5, np.log(2), np.log(2)), np.arange(10) / 10
    return out


_FRAME = ("session_id", "event_id", "detected", "document_type", "frame_width", "frame_height")


def scan_frames(spark, sf_dir):
    """Camera images to frame rows, with a detector that gives the corners and a classifier."""
    own = vision.document_frames(images(spark, sf_dir), constant_corners, constant_type, size=32)
    corner = [r6(F.col(f"quad.{c}.{k}")).alias(f"{c.lower()}_{k}") for c in ("topLeft", "bottomRight") for k in "xy"]
    return own.select(*_FRAME, *[r6(F.col(c)).alias(c) for c in ("confidence", "blur_score", "brightness", "glare_ratio", "motion_score", "distance_ratio", "perspective_skew_deg", "out_of_frame_ratio")], *corner)


def scan_frames_heatmap(spark, sf_dir):
    """The same with heatmaps and no classifier."""
    own = vision.document_frames(images(spark, sf_dir), constant_heatmaps, size=32)
    return own.select(*_FRAME, r6(F.col("confidence")).alias("confidence"), *[r6(F.col(f"quad.{c}.{k}")).alias(f"{c.lower()}_{k}") for c in geometry.CORNERS for k in "xy"])


def scan_faces(spark, sf_dir):
    own = vision.face_frames(images(spark, sf_dir), constant_face, size=64)
    return own.select(
        "session_id", "event_id", "detected", "frame_width", "frame_height", *[r6(F.col(c)).alias(c) for c in ("confidence", "blur_score", "brightness", "glare_ratio", "motion_score")],
        *[r6(F.col(f"box.{k}")).alias(f"box_{k}") for k in ("x", "y", "width", "height")], r6(F.col("landmarks.rightEye.x")).alias("right_eye_x"), r6(F.col("landmarks.leftMouthCorner.y")).alias("mouth_y"),
    )


READ_CHARSET = tuple("ABCDEFG")


def one_line(x):
    """A text detector that finds one line in every image."""
    out = np.zeros(x.shape[2:], np.float32)
    out[8:16, 4:28] = 1
    return [out[None, None]]


def by_brightness(x):
    """A recogniser that reads three letters, the first by the brightness of the line, then a blank, then a space."""
    k = 1 + int(round((float(x.mean()) * 0.5 + 0.5) * 255)) // 30 % 7
    out = np.zeros((1, 5, 9))
    out[0, np.arange(5), (k, k, 0, 8, 2)] = 5.0
    return [out]


def read_captures(spark, sf_dir):
    """Photos of one shade each, read by models that find one line in each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("capture_id")).repartition(partitions(spark), "capture_id")
    shade = F.lpad(F.hex(F.col("capture_id") % 8 * 30 + 10), 2, "0")
    photo = F.concat(F.lit(b"P5\n16 12\n255\n"), F.unhex(F.repeat(shade, 192)))
    quad = F.when(F.col("capture_id") % 2 == 0, F.array(*[F.lit(float(v)) for v in (0, 0, 15, 0, 15, 11, 0, 11)]))
    models = {"text_detector": one_line, "text_direction": lambda x: [np.array([[1.0, 0.0]])], "text_recogniser": by_brightness}
    own = vision.capture_texts(o.select("capture_id", F.lit("ID_CARD").alias("document_type"), photo.alias("content"), quad.alias("quad")), models, list(READ_CHARSET))
    line = F.get("lines", F.lit(0))
    return own.select("capture_id", "document_type", "text", F.size("lines").alias("n_lines"), r6(F.col("confidence")).alias("confidence"), *[r6(line[k]).alias(k) for k in ("x", "y", "width", "height")], F.col("rectified").isNotNull().alias("has_rectified"), F.coalesce("error", F.lit("")).alias("error"))


def g_landmark_orientation(spark, sf_dir):
    """Landmarks of faces turned with their buffers."""
    f = face_frames(spark, sf_dir).where(F.col("landmarks").isNotNull())
    o = F.element_at(F.array(*map(F.lit, ("up", "right", "down", "left"))), (F.col("event_id") % 4 + 1).cast("int"))
    f = f.withColumn("m", rows.orient_landmarks(F.col("landmarks"), F.col("frame_width"), F.col("frame_height"), o, F.col("event_id") % 3 == 0))
    return f.select("event_id", *[F.col(f"m.{n}.{k}").alias(f"{n.lower()}_{k}") for n in ("rightEye", "leftEye") for k in "xy"])


def shown_labels(spark, sf_dir):
    """Badge of each frame with a document: label and per cent."""
    f = frames(spark, sf_dir).where("detected")
    return f.select("event_id", rows.shown_label(F.col("document_type")).alias("label"), rows.shown_percent(F.col("confidence")).alias("percent"))


def capture_replay(spark, sf_dir):
    """Throttle and gate together, as the stream runs them, over a batch."""
    own = capture.replayed(capture.events_of(judged(spark, sf_dir)))
    return own.select("session_id", "timestamp_ms", "stage", r6(F.col("stability_progress")).alias("stability_progress"))


def capture_replay_face(spark, sf_dir):
    """The replay with the window of faces, 600 ms."""
    own = capture.replayed(capture.events_of(judged(spark, sf_dir)), window_ms=600)
    return own.select("session_id", "timestamp_ms", "stage", r6(F.col("stability_progress")).alias("stability_progress"))


def stream_throttle_gate(spark, sf_dir):
    """The same as a stream over a folder of frames, run until it has read what is there."""
    folder = f"{shared_folder(spark)}/lensmill/frames-{uuid.uuid4().hex}"
    events = capture.events_of(judged(spark, sf_dir))
    events.write.parquet(f"{folder}/in")
    own = stateful_session(spark)
    stages = capture.capture_stages(own.readStream.schema(events.schema).parquet(f"{folder}/in"))
    run = stages.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    own = spark.read.schema(stages.schema).parquet(f"{folder}/out")
    return own.select("session_id", "timestamp_ms", "stage", r6(F.col("stability_progress")).alias("stability_progress"))


def sql_throttle(spark, sf_dir):
    """The throttle, called from SQL."""
    tables.register(spark)
    own = frames(spark, sf_dir).select("session_id", "event_id", "timestamp_ms")
    return spark.sql("SELECT * FROM throttled_frames(TABLE({own}) PARTITION BY session_id ORDER BY (timestamp_ms, event_id))", own=own)


def sql_stability_gate(spark, sf_dir):
    """The gate over all frames, called from SQL."""
    tables.register(spark)
    own = judged(spark, sf_dir).select("session_id", "event_id", "timestamp_ms", "is_valid")
    return spark.sql(
        """SELECT session_id, event_id, stage, round(stability_progress, 6) AS stability_progress,
             coalesce(min(CASE WHEN stage = 'capturing' THEN timestamp_ms END) OVER (PARTITION BY session_id), -1) AS captured_at
           FROM gated_frames(TABLE({own}) PARTITION BY session_id ORDER BY (timestamp_ms, event_id), interval_ms => 0)""",
        own=own,
    )


def sql_extract_document(spark, sf_dir):
    """The dispatcher, called from SQL."""
    all_captures(spark, sf_dir).createOrReplaceTempView("all_captures")
    tables.parsed_views(spark, "all_captures", AS_OF_YEAR)
    return spark.sql("SELECT * EXCEPT (confidence, mrz_valid), round(confidence, 6) AS confidence, coalesce(CAST(mrz_valid AS STRING), 'null') AS mrz_valid FROM extracted_documents")


def sql_id_parse(spark, sf_dir):
    """Cards, called from SQL."""
    captures(spark, sf_dir, fixtures.CARD_LINES_SQL, "ID_CARD").createOrReplaceTempView("card_captures")
    tables.parsed_views(spark, "card_captures", AS_OF_YEAR)
    return spark.sql("SELECT capture_id, ok, full_name, id_number, date_of_birth, expiry_date, address, nationality FROM parsed_cards")


def g_ios(spark, sf_dir):
    """Rules of the second profile: what counts as found, distance in frames of three sizes, detector sides."""
    side = lambda whole, tenth: F.when(F.col("event_id") % 3 == 0, whole).when(F.col("event_id") % 3 == 1, tenth).otherwise(0.5)
    f = frames(spark, sf_dir)
    confidence = F.when(F.col("event_id") % 5 == 0, 0.0).when(F.col("event_id") % 7 > 0, F.col("confidence"))
    quad = F.when(F.col("detected"), F.col("raw_quad"))
    return f.select(
        "event_id", rows.is_found(quad, confidence, "ios").alias("found"), rows.is_found(quad, confidence).alias("found_android"),
        r6(geometry.distance_ratio(F.col("raw_quad"), side(1000.0, 100.0), side(800.0, 80.0), "ios")).alias("distance_ratio"),
        r6(geometry.distance_ratio(F.col("raw_quad"), side(1000.0, 100.0), side(800.0, 80.0))).alias("distance_android"),
        geometry.multiple_of_32((F.col("event_id") % 1500).cast("double"), profile="ios").alias("side"),
    )


def sql_capture_replay(spark, sf_dir):
    """Throttle and gate together, called from SQL: the rows at which a stage changes."""
    tables.register(spark)
    own = judged(spark, sf_dir).select("session_id", "event_id", "timestamp_ms", "is_valid")
    return spark.sql(
        """SELECT session_id, timestamp_ms, stage, round(stability_progress, 6) AS stability_progress
           FROM (SELECT *, lag(stage, 1, 'idle') OVER (PARTITION BY session_id ORDER BY timestamp_ms, event_id) AS before
                 FROM gated_frames(TABLE({own}) PARTITION BY session_id ORDER BY (timestamp_ms, event_id)))
           WHERE stage <> before""",
        own=own,
    )


QUERIES = (
    g_geometry, g_bbox_and_domain, g_order_points, g_orientation, g_clamp, g_view_scale, guidance_flags, guidance_code, guidance_code_counts, face_geometry, face_guidance,
    quality_indicators, quality_score, mrz_fields, mrz_parse, ocr_fulltext, licence_parse, licence_categories, id_parse, extract_document, throttle, stability_gate, latest_state,
    asof_quad, heatmap_decode, class_softmax, ctc_decode, ctc_decode_ios, face_decode, nms, registry_latest, model_version, registry_active, registry_activations,
    pix_quality, pix_motion, capture_replay, capture_replay_face, stream_throttle_gate, scan_frames, scan_frames_heatmap, scan_faces, read_captures, g_landmark_orientation, shown_labels,
    sql_throttle, sql_stability_gate, sql_capture_replay, sql_extract_document, sql_id_parse, g_ios,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
