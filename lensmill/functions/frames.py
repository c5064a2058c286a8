"""Frame and capture rows: raw detector values to the nested rows that guidance and parsers take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.functions import geometry, guidance, tensors

#: Labels shown for document types; fixed values.
SHOWN_LABELS = {"PASSPORT": "Passport", "DRIVING_LICENCE": "Driving Licence", "ID_CARD": "ID Card", "RESIDENCE_PERMIT": "Residence Permit", "VISA": "Visa", "GENERIC": "Document"}
LANDMARKS = ("rightEye", "leftEye", "noseTip", "rightMouthCorner", "leftMouthCorner")


def coerced_type(kind: Column) -> Column:
    """The document type, GENERIC if it is none of the known ones."""
    return F.when(kind.isin(*guidance.DOCUMENT_TYPES), kind).otherwise("GENERIC")


def document_row(raw: DataFrame) -> DataFrame:
    """raw with document_type coerced, quad null where nothing is detected, bounding_box, and the quad's ratios.

    raw_quad keeps the quad as it was given. The ratios are 0 without a quad; frames that failed get the empty row's zeros.
    """
    q, w, h = F.col("raw_quad"), F.col("frame_width"), F.col("frame_height")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    own = raw.withColumns({"raw_quad": F.col("quad"), "detected": F.coalesce("detected", F.lit(False)), "document_type": coerced_type(F.col("document_type"))})
    own = own.withColumns({c: zero(F.col(c).cast("double")) for c in ("confidence", "frame_width", "frame_height", "blur_score", "brightness", "glare_ratio", "motion_score")})
    own = own.withColumn("quad", F.when(F.col("detected"), q))
    ratios = {"distance_ratio": geometry.distance_ratio(q, w, h), "perspective_skew_deg": geometry.perspective_skew_deg(q), "out_of_frame_ratio": geometry.out_of_frame_ratio(q, w, h)}
    return own.withColumns({"bounding_box": F.when(F.col("quad").isNotNull(), geometry.corner_box(F.col("quad"))), **{k: zero(v) for k, v in ratios.items()}})


def face_row(raw: DataFrame) -> DataFrame:
    """raw with face struct<box, landmarks, confidence> (null if there is none) as detected, box, landmarks, confidence."""
    measures = ("frame_width", "frame_height", "blur_score", "brightness", "glare_ratio", "motion_score")
    own = {"detected": F.col("face").isNotNull(), "box": F.col("face.box"), "landmarks": F.col("face.landmarks"), "confidence": F.coalesce("face.confidence", F.lit(0.0))}
    return raw.withColumns({**own, **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in measures}}).drop("face")


def known_shape(shape: tuple[int, ...]) -> bool:
    """Whether corner_output() can read an output of this shape: four heatmaps, or eight numbers."""
    n = 1
    for d in shape:
        n *= max(d, 1)
    return (len(shape) == 4 and shape[1] == 4) or n == 8


def corner_output(shape: Column, data: Column, width: Column, height: Column, size: int, profile: str = "android") -> Column:
    """struct<quad, confidence> of a corner detector's output in frame pixels, null for no output.

    Four heatmaps give the centres of their peaks and the mean of the peaks; eight numbers are the corners themselves.
    """
    h, w = F.get(shape, F.lit(2)), F.get(shape, F.lit(3))
    sx, sy = F.lit(size) / width, F.lit(size) / height
    placed = lambda x, y: geometry.point(geometry.model_to_frame(x, sx, width.cast("double")), geometry.model_to_frame(y, sy, height.cast("double")))
    channels = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: tensors.heatmap_corner(F.slice(data, c * h * w + 1, h * w), h, w, size))

    def from_heatmaps(own: Column) -> Column:
        score = sum((own[k]["peak"] for k in range(4)), F.lit(0.0)) / 4
        return F.struct(geometry.quad_of([placed(own[k]["x"], own[k]["y"]) for k in range(4)]).alias("quad"), score.alias("confidence"))

    value = lambda k: tensors.direct_value(F.get(data, F.lit(k)), size, profile)
    direct = F.struct(geometry.quad_of([placed(value(2 * k), value(2 * k + 1)) for k in range(4)]).alias("quad"), F.lit(tensors.direct_confidence(profile)).alias("confidence"))
    return F.when((F.size(shape) == 4) & (F.get(shape, F.lit(1)) == 4), geometry.bound(channels, from_heatmaps)).when(F.size(data) == 8, direct)


def face_output(best: Column, width: Column, height: Column, size: int) -> Column:
    """struct<box, landmarks, confidence> of a decoded face in frame pixels, null for none; the box's corner is clamped."""
    sx, sy = F.lit(size) / width, F.lit(size) / height
    at = lambda v, scale, most: geometry.clamp(v / scale, 0.0, most.cast("double"))
    box = geometry.box_of(at(best["x"], sx, width), at(best["y"], sy, height), best["w"] / sx, best["h"] / sy)
    marks = F.struct(*[geometry.point(F.get(best["landmarks"], F.lit(k))["x"] / sx, F.get(best["landmarks"], F.lit(k))["y"] / sy).alias(n) for k, n in enumerate(LANDMARKS)])
    return F.when(best.isNotNull(), F.struct(box.alias("box"), marks.alias("landmarks"), best["score"].alias("confidence")))


def orient_landmarks(marks: Column, width: Column, height: Column, orientation: Column, mirrored: Column) -> Column:
    """Each landmark turned as a point of its buffer; a right eye stays the right eye."""
    return F.struct(*[geometry.orient_point(marks[n], width, height, orientation, mirrored).alias(n) for n in LANDMARKS])


def is_found(quad: Column, confidence: Column, profile: str = "android") -> Column:
    """Whether a detector's answer counts: with corners, on ios with some confidence too."""
    return quad.isNotNull() & (F.coalesce(confidence > 0, F.lit(False)) if profile == "ios" else F.lit(True))


def readable(lines: Column, profile: str = "android") -> Column:
    """Lines with a text: android drops blank ones, ios empty ones only."""
    if profile == "ios":
        return F.filter(lines, lambda l: l["text"].isNotNull() & (l["text"] != ""))
    return F.filter(lines, lambda l: l["text"].isNotNull() & l["text"].rlike("(?U)\\S"))


def in_reading_order(lines: Column, profile: str = "android") -> Column:
    """Lines by the centre of their height, ties by their left edge; ios leaves ties in the order given."""
    tie = lambda l, i: F.struct(l["x"].alias("t")) if profile == "android" else F.struct(i.cast("double").alias("t"))
    keyed = F.transform(lines, lambda l, i: F.struct((l["y"] + l["height"] / 2).alias("c"), tie(l, i).alias("t"), i.alias("i"), l.alias("l")))
    # The number makes every key differ, so the line beside it never decides, and no comparison runs as a lambda.
    return F.transform(F.sort_array(keyed), lambda k: k["l"])


def with_full_text(captures: DataFrame) -> DataFrame:
    """captures with text (its lines joined by newlines) and confidence (their mean, 0 without lines)."""
    mean = F.when(F.size("lines") > 0, F.aggregate("lines", F.lit(0.0), lambda a, l: a + l["confidence"]) / F.size("lines")).otherwise(0.0)
    return captures.withColumns({"text": F.array_join(F.transform("lines", lambda l: l["text"]), "\n"), "confidence": mean})


def captures_of(lines: DataFrame, document_type: Column, profile: str = "android") -> DataFrame:
    """capture_id, document_type, lines, text, confidence from one row a line (line_idx, text, confidence, x, y, width, height)."""
    item = F.struct("line_idx", "text", "confidence", "x", "y", "width", "height")
    rows = lines.groupBy("capture_id").agg(F.sort_array(F.collect_list(item)).alias("o"))
    bare = F.transform("o", lambda l: F.struct(*[l[k].alias(k) for k in ("text", "confidence", "x", "y", "width", "height")]))
    rows = rows.select("capture_id", document_type.alias("document_type"), readable(bare, profile).alias("lines"))
    return with_full_text(rows.withColumn("lines", in_reading_order(F.col("lines"), profile)))


def shown_label(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SHOWN_LABELS.items() for x in pair]), coerced_type(kind))


def shown_percent(confidence: Column) -> Column:
    """Confidence in per cent, halves up."""
    return F.floor(confidence * 100 + 0.5).cast("long")


def idle_guidance(face: bool = False) -> Column:
    """Guidance before the first frame: nothing found, no flag set but that of a document of the right type."""
    code = "NO_FACE" if face else "NO_DOCUMENT"
    flags = guidance.FACE_FLAGS if face else guidance.FLAGS
    message = guidance.message_of(F.lit(code), guidance.FACE_MESSAGES if face else guidance.MESSAGES)
    set_ = lambda name: F.lit("correct" in name.lower() and "type" in name.lower())
    return F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(False).alias("is_valid"), F.lit(0.0).alias("confidence"), *[set_(n).alias(n) for n in flags])
