"""Quality flags, the one guidance code of a frame, and quality indicators, as plain column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lensmill.functions import geometry as g


# Thresholds, codes and messages.
@dataclass(frozen=True)
class Thresholds:
    min_confidence: float = 0.55
    min_classification: float = 0.6
    min_blur: float = 60.0
    min_brightness: float = 60.0
    max_brightness: float = 220.0
    max_glare: float = 0.08
    max_motion: float = 0.04
    min_distance: float = 0.35
    max_distance: float = 0.92
    max_offset: float = 0.18
    max_skew_deg: float = 12.0
    max_rotation_deg: float = 8.0
    max_out_of_frame: float = 0.02
    stable_ms: int = 1000
    throttle_ms: int = 66


@dataclass(frozen=True)
class FaceThresholds:
    min_confidence: float = 0.6
    min_blur: float = 15.0
    min_brightness: float = 40.0
    max_brightness: float = 240.0
    max_glare: float = 0.15
    max_motion: float = 0.08
    min_size: float = 0.06
    max_size: float = 0.65
    max_offset: float = 0.3
    max_tilt_deg: float = 25.0
    stable_ms: int = 600
    throttle_ms: int = 66


DOCUMENT_TYPES = ("PASSPORT", "VISA", "ID_CARD", "DRIVING_LICENCE", "RESIDENCE_PERMIT", "GENERIC")
MESSAGES = {
    "NO_DOCUMENT": "Document not detected",
    "WRONG_DOCUMENT_TYPE": "This doesn't look like the right document type",
    "MOVE_CLOSER": "Move closer",
    "MOVE_FARTHER": "Move farther",
    "CENTER_DOCUMENT": "Center document in frame",
    "ALIGN_DOCUMENT": "Align document",
    "TILT_PHONE": "Tilt phone slightly",
    "HOLD_STILL": "Hold still",
    "BLURRY": "Image is blurry",
    "LOW_LIGHT": "Increase lighting",
    "OVEREXPOSED": "Reduce lighting",
    "REDUCE_GLARE": "Reduce glare",
    "PARTIALLY_OUT_OF_FRAME": "Document partially outside frame",
    "READY": "Perfect — hold still",
    "CAPTURING": "Capturing...",
    "SCANNING": "Scanning...",
    "EXTRACTING_TEXT": "Extracting text...",
    "COMPLETED": "Completed",
}
FACE_MESSAGES = {
    "NO_FACE": "Position your face in the frame",
    "MOVE_CLOSER": "Move closer",
    "MOVE_FARTHER": "Move farther",
    "CENTER_FACE": "Center your face in the frame",
    "LEVEL_HEAD": "Hold your head level",
    "HOLD_STILL": "Hold still",
    "BLURRY": "Image is blurry",
    "LOW_LIGHT": "Increase lighting",
    "OVEREXPOSED": "Reduce lighting",
    "REDUCE_GLARE": "Reduce glare",
    "READY": "Perfect — hold still",
    "CAPTURING": "Capturing...",
    "EXTRACTING": "Processing...",
    "COMPLETED": "Completed",
}
FLAGS = ("has_document", "is_correct_document_type", "is_centered", "is_sharp", "has_no_glare", "has_good_brightness", "is_still", "is_correct_size", "is_correct_perspective", "is_fully_in_frame")
FACE_FLAGS = ("has_face", "is_centered", "is_correct_size", "is_level", "is_sharp", "has_no_glare", "has_good_brightness", "is_still")


def at_least(x: Column, bound: float) -> Column:
    """x >= bound; NaN is not, although Spark orders it above all numbers."""
    return ~F.isnan(x) & (x >= bound)


def within(x: Column, lo: float, hi: float) -> Column:
    return at_least(x, lo) & (x <= hi)


def above(x: Column, bound: float) -> Column:
    return ~F.isnan(x) & (x > bound)


def message_of(code: Column, messages: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in messages.items() for x in pair]), code)


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.when(*cases[0])
    for condition, code in cases[1:]:
        out = out.when(condition, code)
    return out.otherwise(otherwise)


def document_flags(expected: Column | None, t: Thresholds = Thresholds()) -> dict[str, Column]:
    """The ten flags over columns detected, confidence, document_type, quad, frame size and metrics."""
    c = F.col
    has = c("detected") & at_least(c("confidence"), t.min_confidence)
    known = F.lit(False) if expected is None else expected.isNotNull() & (expected != "") & (c("document_type") != "GENERIC") & (c("document_type") != expected)
    off = g.center_offset_ratio(c("quad"), c("frame_width"), c("frame_height"))
    turned = F.when(has & c("quad").isNotNull(), F.abs(g.quad_rotation_deg(c("quad")))).otherwise(0.0)
    return {
        "has_document": has,
        "is_correct_document_type": ~(has & F.coalesce(known, F.lit(False))),
        "is_centered": ~has | c("quad").isNull() | (off <= t.max_offset),
        "is_sharp": at_least(c("blur_score"), t.min_blur),
        "has_no_glare": c("glare_ratio") <= t.max_glare,
        "has_good_brightness": within(c("brightness"), t.min_brightness, t.max_brightness),
        "is_still": c("motion_score") <= t.max_motion,
        "is_correct_size": ~has | within(c("distance_ratio"), t.min_distance, t.max_distance),
        "is_correct_perspective": (c("perspective_skew_deg") <= t.max_skew_deg) & (turned <= t.max_rotation_deg),
        "is_fully_in_frame": ~has | (c("out_of_frame_ratio") <= t.max_out_of_frame),
        "rotation_deg": turned,
    }


def with_guidance(frames, expected: Column | None = None, t: Thresholds = Thresholds()):
    """frames with the ten flags, code, message and is_valid: one projection, no shuffle."""
    flags = document_flags(expected, t)
    out = frames.withColumns({k: F.coalesce(v, F.lit(False)) if k != "rotation_deg" else v for k, v in flags.items()})
    c = F.col
    code = first_match(
        [
            (~c("has_document"), "NO_DOCUMENT"),
            (~c("is_correct_document_type"), "WRONG_DOCUMENT_TYPE"),
            (~F.isnan("distance_ratio") & (c("distance_ratio") < t.min_distance), "MOVE_CLOSER"),
            (above(c("distance_ratio"), t.max_distance), "MOVE_FARTHER"),
            (~c("is_fully_in_frame"), "PARTIALLY_OUT_OF_FRAME"),
            (~c("is_centered"), "CENTER_DOCUMENT"),
            (~(c("rotation_deg") <= t.max_rotation_deg), "ALIGN_DOCUMENT"),
            (~(c("perspective_skew_deg") <= t.max_skew_deg), "TILT_PHONE"),
            (~c("is_still"), "HOLD_STILL"),
            (~c("is_sharp"), "BLURRY"),
            (~F.isnan("brightness") & (c("brightness") < t.min_brightness), "LOW_LIGHT"),
            (above(c("brightness"), t.max_brightness), "OVEREXPOSED"),
            (~c("has_no_glare"), "REDUCE_GLARE"),
        ],
        "READY",
    )
    valid = c(FLAGS[0])
    for flag in FLAGS[1:]:
        valid = valid & c(flag)
    return out.withColumns({"code": code, "is_valid": valid}).withColumn("message", message_of(c("code"), MESSAGES))


def with_face_guidance(frames, t: FaceThresholds = FaceThresholds()):
    """Face frames (box, landmarks) with eight flags, code, message and is_valid."""
    c = F.col
    has = c("detected") & at_least(c("confidence"), t.min_confidence)
    area = c("frame_width") * c("frame_height")
    ratio = F.when(has & c("box").isNotNull() & (area > 0), c("box.width") * c("box.height") / area).otherwise(0.0)
    tilt = F.when(has & c("landmarks").isNotNull(), F.abs(g.eye_tilt_deg(c("landmarks")))).otherwise(0.0)
    flags = {
        "has_face": has,
        "is_centered": ~has | c("box").isNull() | (g.box_offset_ratio(c("box"), c("frame_width"), c("frame_height")) <= t.max_offset),
        "is_correct_size": ~has | within(ratio, t.min_size, t.max_size),
        "is_level": tilt <= t.max_tilt_deg,
        "is_sharp": at_least(c("blur_score"), t.min_blur),
        "has_no_glare": c("glare_ratio") <= t.max_glare,
        "has_good_brightness": within(c("brightness"), t.min_brightness, t.max_brightness),
        "is_still": c("motion_score") <= t.max_motion,
    }
    out = frames.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()} | {"size_ratio": ratio, "tilt_deg": tilt})
    code = first_match(
        [
            (~c("has_face"), "NO_FACE"),
            (c("size_ratio") < t.min_size, "MOVE_CLOSER"),
            (above(c("size_ratio"), t.max_size), "MOVE_FARTHER"),
            (~c("is_centered"), "CENTER_FACE"),
            (~c("is_level"), "LEVEL_HEAD"),
            (~c("is_still"), "HOLD_STILL"),
            (~c("is_sharp"), "BLURRY"),
            (c("brightness") < t.min_brightness, "LOW_LIGHT"),
            (above(c("brightness"), t.max_brightness), "OVEREXPOSED"),
            (~c("has_no_glare"), "REDUCE_GLARE"),
        ],
        "READY",
    )
    valid = c(FACE_FLAGS[0])
    for flag in FACE_FLAGS[1:]:
        valid = valid & c(flag)
    return out.withColumns({"code": code, "is_valid": valid}).withColumn("message", message_of(c("code"), FACE_MESSAGES))


def indicators(t: Thresholds = Thresholds()) -> dict[str, tuple[str, Column, Column]]:
    """Label, passed and score (0..1, NaN gives 0) of the six indicators."""

    def unit(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0))))

    def band(x: Column, lo: float, hi: float) -> Column:
        return unit(1 - F.abs(x - (lo + hi) / 2) / ((hi - lo) / 2))

    c = F.col
    return {
        "blurScore": ("Sharpness", at_least(c("blur_score"), t.min_blur), unit(c("blur_score") / (t.min_blur * 2))),
        "brightness": ("Lighting", within(c("brightness"), t.min_brightness, t.max_brightness), band(c("brightness"), t.min_brightness, t.max_brightness)),
        "glareRatio": ("Glare", c("glare_ratio") <= t.max_glare, unit(1 - c("glare_ratio") / (t.max_glare * 4))),
        "motionScore": ("Stability", c("motion_score") <= t.max_motion, unit(1 - c("motion_score") / (t.max_motion * 4))),
        "distanceRatio": ("Distance", within(c("distance_ratio"), t.min_distance, t.max_distance), band(c("distance_ratio"), t.min_distance, t.max_distance)),
        "perspectiveSkewDeg": ("Perspective", c("perspective_skew_deg") <= t.max_skew_deg, unit(1 - c("perspective_skew_deg") / (t.max_skew_deg * 2))),
    }


def quality_score(t: Thresholds = Thresholds()) -> Column:
    scores = [s for _, _, s in indicators(t).values()]
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return F.floor(total / 6 * 100 + 0.5)
