"""Column functions over points, quads and boxes. A quad is struct<topLeft,topRight,bottomRight,bottomLeft> of points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("topLeft", "topRight", "bottomRight", "bottomLeft")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad_of(points: list[Column]) -> Column:
    return F.struct(*[p.alias(c) for p, c in zip(points, CORNERS, strict=True)])


def corners(quad: Column) -> list[Column]:
    return [quad[c] for c in CORNERS]


def box_of(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def clamp(x: Column, lo: float | Column, hi: float | Column) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def quad_center(quad: Column) -> Column:
    own = corners(quad)
    return point(sum(p["x"] for p in own) / 4, sum(p["y"] for p in own) / 4)


def quad_area(quad: Column) -> Column:
    own = corners(quad)
    turns = [a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(own, own[1:] + own[:1], strict=True)]
    return F.abs(reduce(lambda a, b: a + b, turns)) / 2


def offset_ratio(center: Column, width: Column, height: Column) -> Column:
    """Distance of a point from the frame's centre over half the diagonal, at most 1; 0 for an empty frame."""
    most = F.hypot(width / 2, height / 2)
    return F.when(most == 0, 0.0).otherwise(F.least(F.lit(1.0), distance(center, point(width / 2, height / 2)) / most))


def center_offset_ratio(quad: Column, width: Column, height: Column) -> Column:
    return offset_ratio(quad_center(quad), width, height)


def quad_rotation_deg(quad: Column) -> Column:
    a, b = quad["topLeft"], quad["topRight"]
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def box_center(box: Column) -> Column:
    return point(box["x"] + box["width"] / 2, box["y"] + box["height"] / 2)


def box_offset_ratio(box: Column, width: Column, height: Column) -> Column:
    return offset_ratio(box_center(box), width, height)


def eye_tilt_deg(landmarks: Column) -> Column:
    """From |dx|, so a mirrored face does not turn by 180 degrees."""
    a, b = landmarks["rightEye"], landmarks["leftEye"]
    return F.degrees(F.atan2(b["y"] - a["y"], F.abs(b["x"] - a["x"])))


def perspective_skew_deg(quad: Column) -> Column:
    """Largest deviation of a corner from 90 degrees; a corner with an edge of length 0 is left out, 0 if all are."""
    own, found = corners(quad), []
    for i, p in enumerate(own):
        before, after = own[i - 1], own[(i + 1) % 4]
        ax, ay, bx, by = before["x"] - p["x"], before["y"] - p["y"], after["x"] - p["x"], after["y"] - p["y"]
        length = F.hypot(ax, ay) * F.hypot(bx, by)
        cosine = clamp((ax * bx + ay * by) / length, -1.0, 1.0)
        found.append(F.when(length > 0, F.abs(F.degrees(F.acos(cosine)) - 90)).otherwise(0.0))
    return F.greatest(*found)


def extent(quad: Column) -> tuple[Column, Column, Column, Column]:
    """Least and greatest x, least and greatest y."""
    xs, ys = [p["x"] for p in corners(quad)], [p["y"] for p in corners(quad)]
    return F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)


def bounding_rect(quad: Column) -> Column:
    x0, x1, y0, y1 = extent(quad)
    return box_of(x0, y0, x1 - x0, y1 - y0)


def out_of_frame_ratio(quad: Column, width: Column, height: Column) -> Column:
    """Share of the quad's own box that lies outside of the frame."""
    x0, x1, y0, y1 = extent(quad)
    area = (x1 - x0) * (y1 - y0)
    inside = F.greatest(F.lit(0.0), F.least(x1, width) - F.greatest(x0, F.lit(0.0))) * F.greatest(F.lit(0.0), F.least(y1, height) - F.greatest(y0, F.lit(0.0)))
    return F.when(area <= 0, 0.0).otherwise(clamp(1 - inside / area, 0.0, 1.0))


def distance_ratio(quad: Column, width: Column, height: Column, profile: str = "android") -> Column:
    """Quad area over frame area: android clamps to 0..4, ios floors the denominator at 1."""
    if profile == "ios":
        return quad_area(quad) / F.greatest(width * height, F.lit(1.0))
    return F.when(width * height > 0, clamp(quad_area(quad) / (width * height), 0.0, 4.0)).otherwise(0.0)


def corner_box(quad: Column) -> Column:
    """The frame row's box: x of the left corners, y of the top ones, extents to the right and bottom ones."""
    tl, tr, br, bl = corners(quad)
    x, y = F.least(tl["x"], bl["x"]), F.least(tl["y"], tr["y"])
    return box_of(x, y, F.greatest(tr["x"], br["x"]) - x, F.greatest(bl["y"], br["y"]) - y)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it: a one-element transform."""
    return F.transform(F.array(value), use)[0]


def order_points(points: list[Column]) -> Column:
    """Quad from four points in any order: extremes of x + y and of y - x, the first point on ties."""

    def ordered(own: Column) -> Column:
        def pick(key, sign: int) -> Column:
            return F.array_min(F.transform(own, lambda p, i: F.struct((sign * key(p)).alias("k"), i.alias("i"), p.alias("p"))))["p"]

        total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
        return quad_of([pick(total, 1), pick(slope, 1), pick(total, -1), pick(slope, -1)])

    return bound(F.array(*points), ordered)


def oriented_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    turned = orientation.isin("left", "right")
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def orient_point(p: Column, width: Column, height: Column, orientation: Column, mirrored: Column) -> Column:
    """Rotates a point of a width x height buffer upright, then mirrors it."""
    x = F.when(orientation == "right", height - p["y"]).when(orientation == "left", p["y"]).when(orientation == "down", width - p["x"]).otherwise(p["x"])
    y = F.when(orientation == "right", p["x"]).when(orientation == "left", width - p["x"]).when(orientation == "down", height - p["y"]).otherwise(p["y"])
    w, _ = oriented_size(width, height, orientation)
    return point(F.when(mirrored, w - x).otherwise(x), y)


def orient_quad(quad: Column, width: Column, height: Column, orientation: Column, mirrored: Column) -> Column:
    return order_points([orient_point(p, width, height, orientation, mirrored) for p in corners(quad)])


def orient_box(box: Column, width: Column, height: Column, orientation: Column, mirrored: Column) -> Column:
    """Axis-aligned box of the oriented corners."""
    x0, y0 = box["x"], box["y"]
    x1, y1 = x0 + box["width"], y0 + box["height"]
    own = [orient_point(point(x, y), width, height, orientation, mirrored) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    return bound(quad_of(own), bounding_rect)


def clamp_quad(quad: Column, width: Column, height: Column) -> Column:
    return quad_of([point(clamp(p["x"], 0.0, width - 1), clamp(p["y"], 0.0, height - 1)) for p in corners(quad)])


def scale_quad(quad: Column, sx: Column, sy: Column) -> Column:
    return quad_of([point(p["x"] * sx, p["y"] * sy) for p in corners(quad)])


def view_scale(view: Column | float, frame: Column) -> Column:
    return F.when(frame > 0, F.lit(view) / frame).otherwise(0.0)


def guide_rect(width: Column, height: Column, width_ratio: float = 0.86, aspect: float = 1.42) -> Column:
    w = width * width_ratio
    h = w / aspect
    return box_of((width - w) / 2, (height - h) / 2, w, h)


def edge_fade(progress: Column, edge: float = 0.12) -> Column:
    """Opacity that rises over the first 0.12, falls over the last 0.12, and is 1 between."""
    return F.when(progress < edge, progress / edge).when(progress > 1 - edge, (1 - progress) / edge).otherwise(1.0)


def normalised_rect(box: Column, width: Column, height: Column) -> Column:
    return box_of(box["x"] / width, box["y"] / height, box["width"] / width, box["height"] / height)


def strip_file_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^file://", "")


def add_file_scheme(path: Column) -> Column:
    return F.when(path.startswith("file://"), path).otherwise(F.concat(F.lit("file://"), path))


def model_to_frame(value: Column, scale: Column, size: Column | None = None) -> Column:
    """A model coordinate in frame pixels; with a size it is clamped into the frame."""
    return value / scale if size is None else clamp(value / scale, 0.0, size)


def multiple_of_32(size: Column, limit: int = 960, profile: str = "android") -> Column:
    """Detector input side: at most the limit, at least 32; android rounds up, ios to the nearest."""
    capped = F.least(size.cast("double"), F.lit(float(limit))) / 32
    return F.greatest(F.lit(32), ((F.ceil(capped) if profile == "android" else F.floor(capped + 0.5)) * 32).cast("int"))
