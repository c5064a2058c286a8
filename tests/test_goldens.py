"""Hand-derived results of the engine's rules."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lensmill.functions import documents, geometry, guidance, mrz, pixels, tensors
from lensmill.operators import sequences, vision
from lensmill.streaming import capture

Q0 = ((100.0, 100.0), (900.0, 100.0), (900.0, 700.0), (100.0, 700.0))


def quad_row(points):
    return None if points is None else Row(**{c: Row(x=float(x), y=float(y)) for c, (x, y) in zip(geometry.CORNERS, points, strict=True)})


SCHEMA = "id string, detected boolean, confidence double, document_type string, quad struct<topLeft:struct<x:double,y:double>,topRight:struct<x:double,y:double>,bottomRight:struct<x:double,y:double>,bottomLeft:struct<x:double,y:double>>, frame_width double, frame_height double, blur_score double, brightness double, glare_ratio double, motion_score double, distance_ratio double, perspective_skew_deg double, out_of_frame_ratio double"


def frame(name, quad=Q0, **changes):
    own = {"detected": True, "confidence": 0.9, "document_type": "PASSPORT", "frame_width": 1000.0, "frame_height": 800.0, "blur_score": 120.0, "brightness": 140.0, "glare_ratio": 0.02, "motion_score": 0.01, "distance_ratio": 0.6, "perspective_skew_deg": 0.0, "out_of_frame_ratio": 0.0} | changes
    return (name, own["detected"], own["confidence"], own["document_type"], quad_row(quad), own["frame_width"], own["frame_height"], own["blur_score"], own["brightness"], own["glare_ratio"], own["motion_score"], own["distance_ratio"], own["perspective_skew_deg"], own["out_of_frame_ratio"])


GUIDANCE = [
    (frame("G1"), "READY", True),
    (frame("G2", detected=False), "NO_DOCUMENT", False),
    (frame("G3a", confidence=0.54), "NO_DOCUMENT", False),
    (frame("G3b", confidence=0.55), "READY", True),
    (frame("G4a", document_type="VISA"), "WRONG_DOCUMENT_TYPE", False),
    (frame("G4b", document_type="GENERIC"), "READY", True),
    (frame("G5a", distance_ratio=0.34), "MOVE_CLOSER", False),
    (frame("G5b", distance_ratio=0.35), "READY", True),
    (frame("G5c", distance_ratio=0.92), "READY", True),
    (frame("G5d", distance_ratio=0.93), "MOVE_FARTHER", False),
    (frame("G6", ((-200, 100), (800, 100), (800, 700), (-200, 700)), out_of_frame_ratio=0.2), "PARTIALLY_OUT_OF_FRAME", False),
    (frame("G7", ((270, 100), (1000, 100), (1000, 700), (270, 700))), "CENTER_DOCUMENT", False),
    (frame("G8", ((100, 30), (900, 170), (900, 700), (100, 700))), "ALIGN_DOCUMENT", False),
    (frame("G9", perspective_skew_deg=12.01), "TILT_PHONE", False),
    (frame("G10a", motion_score=0.041), "HOLD_STILL", False),
    (frame("G10b", blur_score=59.0), "BLURRY", False),
    (frame("G10c", brightness=59.0), "LOW_LIGHT", False),
    (frame("G10d", brightness=221.0), "OVEREXPOSED", False),
    (frame("G10e", glare_ratio=0.081), "REDUCE_GLARE", False),
    (frame("G11", blur_score=59.0, motion_score=0.05), "HOLD_STILL", False),
    (frame("G12", distance_ratio=float("nan")), "READY", False),
    (frame("G13", None), "READY", True),
]


def test_guidance(spark):
    rows = spark.createDataFrame([r for r, _, _ in GUIDANCE], SCHEMA)
    found = {r.id: (r.code, r.is_valid) for r in guidance.with_guidance(rows, F.lit("PASSPORT")).collect()}
    assert found == {r[0]: (code, valid) for r, code, valid in GUIDANCE}
    untyped = guidance.with_guidance(spark.createDataFrame([frame("G4c", document_type="VISA")], SCHEMA)).first()
    assert (untyped.code, untyped.is_valid) == ("READY", True)


def test_geometry(spark):
    rows = spark.createDataFrame([frame("a", ((10, 20), (90, 15), (95, 80), (5, 85))), frame("b", ((200, 100), (800, 100), (900, 700), (100, 700)))], SCHEMA)
    a, b = rows.select(geometry.corner_box(F.col("quad")).alias("box"), F.round(geometry.perspective_skew_deg(F.col("quad")), 6).alias("skew")).collect()
    assert tuple(a.box) == (5, 15, 90, 70) and b.skew == 9.462322
    points = spark.createDataFrame([frame("o", ((9, 9), (0, 0), (0, 9), (9, 0)))], SCHEMA)
    o = points.select(geometry.order_points(geometry.corners(F.col("quad"))).alias("q")).first().q
    assert [tuple(o[c]) for c in geometry.CORNERS] == [(0, 0), (9, 0), (9, 9), (0, 9)]


def test_eye_tilt(spark):
    marks = "m struct<rightEye:struct<x:double,y:double>,leftEye:struct<x:double,y:double>>"
    eyes = [((400, 300), (600, 300)), ((600, 300), (400, 300)), ((400, 300), (600, 400))]
    rows = spark.createDataFrame([(Row(Row(float(a), float(b)), Row(float(c), float(d))),) for (a, b), (c, d) in eyes], marks)
    assert [r[0] for r in rows.select(F.round(geometry.eye_tilt_deg(F.col("m")), 3)).collect()] == [0, 0, 26.565]


def test_indicator_scores(spark):
    row = spark.createDataFrame([frame("S1", distance_ratio=0.635, perspective_skew_deg=3.0)], SCHEMA)
    found = row.select(*[s.alias(k) for k, (_, _, s) in guidance.indicators().items()], guidance.quality_score().alias("total")).first()
    assert [round(x, 9) for x in found[:6]] == [1, 1, 0.9375, 0.9375, 1, 0.875] and found.total == 96


L1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
ZONES = {
    "M1": (f"{L1}\nL898902C36UTO7408122F1204159ZE184226B<<<<<10", ("TD3", "ANNA MARIA", "ERIKSSON", "L898902C3", "UTO", "1974-08-12", "Female", "2012-04-15", 3)),
    "M3": ("I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<", ("TD1", "ANNA MARIA", "ERIKSSON", "D23145890", "UTO", "1974-08-12", "Female", "2012-04-15", 3)),
    "M4": (f"{L1}\nL898902C36UTO74O8122F1204159ZE184226B<<<<<10", ("TD3", "ANNA MARIA", "ERIKSSON", "L898902C3", "UTO", "1974-08-12", "Female", "2012-04-15", 3)),
    "M6": ("nothing\nhere", (None, "", "", "", "", "", "", "", 0)),
}


def test_zones(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in ZONES.items()], "id string, text string")
    found = {r.id: r for r in mrz.with_mrz(rows).collect()}
    for k, (_, want) in ZONES.items():
        r = found[k]
        assert (r.format, r.first_name, r.last_name, r.document_number, r.nationality, r.date_of_birth, r.gender, r.expiry_date, r.valid_checks) == want
    visa = spark.createDataFrame([("V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL8988901C4XXX4009078F96121096ZE184226B<<<<<<",), (None,)], "text string")
    r, empty = mrz.with_mrz(visa).collect()
    assert (r.format, r.kind, r.visa_number, r.visa_expiry_date, r.document_number, r.date_of_birth, r.valid_checks) == ("MRV_A", "visa", "L8988901C", "2096-12-10", "", "1940-09-07", 3)
    assert not empty.ok and empty.valid_checks == 0


LINE = "array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>"


def lined(spark, texts, ys=None):
    ys = ys or [i / len(texts) for i in range(len(texts))]
    lines = [Row(t, 0.9, 0.1, y, 0.8, 0.05) for t, y in zip(texts, ys, strict=True)]
    return spark.createDataFrame([("\n".join(texts), lines)], f"text string, lines {LINE}")


def test_licence(spark):
    texts = ["DRIVING LICENCE", "1. MORGAN", "2. SARAH MEREDYTH", "3. 11.03.1976 UNITED KINGDOM", "4a. 19.01.2013", "4b. 18.01.2023", "5. MORGA753116SM9IJ", "8. 122 BURNS CRESCENT", "EDINBURGH", "EH1 9GP", "9. AM/A1/B"]
    r = documents.with_licence(lined(spark, texts)).first()
    assert (r.licence_number, r.full_name, r.date_of_birth, r.issue_date, r.expiry_date) == ("MORGA753116SM9IJ", "SARAH MEREDYTH MORGAN", "1976-03-11", "2013-01-19", "2023-01-18")
    assert r.address == "BURNS CRESCENT, EDINBURGH, EH1 9GP, AM/A1/B" and r.categories == ["AM", "A1"] and r.ok


def test_id_card(spark):
    texts = ["REPUBLIC OF UTOPIA", "IDENTITY CARD", "ANNA MARIA ERIKSSON", "ID NUMBER: AB1234567", "DOB 12.8.1974", "EXPIRY 15/04/2032", "ADDRESS: 1 MAIN ST", "UTOPOLIS", "UT1 2AA"]
    r = documents.with_id_card(lined(spark, texts, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.65, 0.7])).first()
    assert (r.id_number, r.full_name, r.date_of_birth, r.expiry_date, r.address, r.nationality, r.ok) == ("IDENTITY", "ANNA MARIA ERIKSSON", "1974-08-12", "2032-04-15", "ADDRESS: 1 MAIN ST, UTOPOLIS, UT1 2AA", "", True)


def test_throttle(spark):
    rows = spark.createDataFrame([(1, i, 1000 + t) for i, t in enumerate((0, 50, 66, 100, 132))], "session_id bigint, event_id bigint, timestamp_ms bigint")
    assert sorted(r.timestamp_ms for r in sequences.throttle(rows).collect()) == [1000, 1066, 1132]


def test_gate_and_latch():
    state = {"last_forwarded": 0, "stage": "idle", "since": None, "latch": False}
    events = [(0, True), (500, True), (900, False), (1000, True), (2000, True), (2010, "processing"), (2020, "failed"), (2100, True), (2200, False), (2300, True), (3300, True)]
    stages = []
    for t, e in events:
        progress = capture.step(state, e if isinstance(e, str) else None, e is True, 10_000 + t, 1000, 66)
        stages.append((state["stage"], progress))
    assert [s for s, _ in stages] == ["stabilizing", "stabilizing", "idle", "stabilizing", "capturing", "processing", "failed", "failed", "idle", "stabilizing", "capturing"]
    assert stages[1][1] == 0.5


def test_tensors(spark):
    box = "array<struct<x:double,y:double,w:double,h:double,score:double>>"
    rows = spark.createDataFrame([([Row(0.0, 0.0, 10.0, 10.0, 0.9), Row(5.0, 0.0, 10.0, 10.0, 0.8), Row(6.0, 0.0, 10.0, 10.0, 0.75), Row(0.0, 0.0, 1.0, 1.0, 0.5)],)], f"b {box}")
    kept = rows.select(tensors.nms(F.col("b")).alias("k")).first().k
    assert [k.score for k in kept] == [0.9, 0.75]
    steps = [[1.0 if k == best else 0.0 for k in range(30)] for best in (0, 18, 18, 0, 18, 19)]
    charset = F.array(*[F.lit(chr(48 + i)) for i in range(17)], F.lit("A"), F.lit("B"))
    r = spark.createDataFrame([(steps, [0.0] * 6)], "s array<array<float>>, l array<float>").select(tensors.ctc(F.col("s"), charset, 30).alias("t"), tensors.classify(F.col("l")).alias("c"), tensors.heatmap_corner(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.9))), 2, 2).alias("h")).first()
    assert r.t.text == "AAB" and r.c.label == "PASSPORT" and abs(r.c.confidence - 1 / 6) < 1e-12 and (r.h.x, r.h.y) == (192, 192)


def test_pixels():
    flat = np.full((12, 16), 100, np.uint8)
    assert pixels.laplacian_variance(flat) == 0 and pixels.brightness(flat) == 100 and pixels.glare_ratio(flat + 155) == 1
    with pytest.raises(ValueError):
        pixels.to_gray(b"", 4, 4, 4, "yuv-10-bit")
    scene = np.full((120, 160), 20, np.uint8)
    scene[20:100, 30:130] = 220
    quad, confidence = pixels.contour_quad(scene)
    assert np.abs(quad - [[30, 20], [129, 20], [129, 99], [30, 99]]).max() <= 3 and confidence > 0.9
    assert np.array_equal(pixels.warp(scene, np.array([[0, 0], [159, 0], [159, 119], [0, 119]]))[1:-1, 1:-1].shape, (117, 157))
    assert np.array_equal(pixels.decode(pixels.encode(scene)).shape[:2], scene.shape)
    prob = np.zeros((64, 64))
    prob[10:16, 8:40] = prob[30:36, 8:40] = 1
    first, second = pixels.text_boxes(prob, 1.0, 1.0)
    assert first[:, 1].mean() < second[:, 1].mean()


def test_vision_stages(spark):
    data = bytes(range(256)) * 2
    rows = spark.createDataFrame([(1, 16, 16, 20, "yuv", "up", False, bytearray(data)), (2, 16, 16, 20, "heic", "up", False, bytearray(data))], "image_id bigint, width int, height int, row_stride int, pixel_format string, orientation string, is_mirrored boolean, data binary")
    found = {r.image_id: r for r in vision.frame_quality(rows).collect()}
    assert vision.contour_quads(rows).where("image_id = 1 AND error IS NULL AND quad_confidence >= 0").count() == 1
    assert found[1].error is None and found[1].blur_score >= 0 and "unsupported" in found[2].error
    shapes = {r.image_id: r.shape for r in vision.infer(rows, lambda x: [x.mean(axis=(2, 3))], 32).collect()}
    assert shapes == {1: [1, 3], 2: None}


def test_stream_equals_replay(spark):
    from lensmill.plans import queries as q

    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, q.stream_throttle_gate(spark, sf).collect())) == sorted(map(tuple, q.capture_replay(spark, sf).collect()))
