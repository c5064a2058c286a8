"""Decoding of model outputs that are arrays of floats, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("PASSPORT", "DRIVING_LICENCE", "ID_CARD", "RESIDENCE_PERMIT", "VISA", "GENERIC")


def argmax(a: Column) -> Column:
    """Place (from 0) of the first largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def winner_probability(a: Column) -> Column:
    """Softmax of the largest value alone: 1 / sum(exp(v - max))."""
    top = F.array_max(a)
    return 1 / F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.exp((v - top).cast("double")))


def sigmoid_if_logit(v: Column) -> Column:
    return F.when((v >= 0) & (v <= 1), v).otherwise(1 / (1 + F.exp(-v)))


def heatmap_corner(a: Column, height: int, width: int, size: int = 256) -> Column:
    """struct<x, y, peak> of one channel's first peak, at its cell's centre."""
    i = argmax(a)
    return F.struct(((i % width) + 0.5).__mul__(size / width).alias("x"), (F.floor(i / width) + 0.5).__mul__(size / height).alias("y"), sigmoid_if_logit(F.array_max(a).cast("double")).alias("peak"))


def direct_value(v: Column, size: int = 256, profile: str = "android") -> Column:
    """Regressed coordinate: android scales only what lies in about 0..1, ios always scales."""
    v = v.cast("double")
    return v * size if profile == "ios" else F.when(v.between(-0.01, 1.01), v * size).otherwise(v)


def direct_confidence(profile: str = "android") -> float:
    return 0.9 if profile == "ios" else 0.7


def classify(logits: Column, labels=LABELS, least: float = 0.6) -> Column:
    """struct<label, confidence, trusted>: GENERIC where the confidence is under the least that is trusted."""
    label, p = F.element_at(F.array(*[F.lit(x) for x in labels]), argmax(logits) + 1), winner_probability(logits)
    return F.struct(label.alias("label"), p.alias("confidence"), F.when(p >= least, label).otherwise("GENERIC").alias("trusted"))


def ctc(steps: Column, charset: Column, classes: int, profile: str = "android") -> Column:
    """struct<text, confidence> of array<array<float>> steps: greedy, repeats collapsed, class 0 blank.

    Class i is charset[i - 1]; classes beyond the charset are dropped, but for the last one, which android reads as a space.
    """
    return collapsed(F.transform(steps, lambda s: F.struct(argmax(s).alias("k"), winner_probability(s).alias("p"))), charset, F.lit(classes), profile)


def collapsed(best: Column, charset: Column, classes: Column, profile: str = "android") -> Column:
    """ctc() from the best class k and its probability p of each step."""
    fresh = F.filter(best, lambda b, i: (b["k"] != 0) & ((i == 0) | (b["k"] != F.get(best, i - 1)["k"])))
    beyond = lambda k: F.when(k == classes - 1, " ") if profile == "android" else F.lit(None).cast("string")
    spelled = F.transform(fresh, lambda b: F.struct(F.coalesce(F.get(charset, b["k"] - 1), beyond(b["k"])).alias("c"), b["p"].alias("p")))
    kept = F.filter(spelled, lambda b: b["c"].isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, b: acc + b["p"])
    return F.struct(F.array_join(F.transform(kept, lambda b: b["c"]), "").alias("text"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0).alias("confidence"))


def face_cell(cls: Column, obj: Column, bbox: Column, kps: Column, row: Column, col: Column, stride: Column) -> Column:
    """struct<x, y, w, h, score, landmarks> of one grid cell."""
    clip = lambda v: F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(0.0))
    w, h = F.exp(bbox[2].cast("double")) * stride, F.exp(bbox[3].cast("double")) * stride
    x, y = (col + bbox[0].cast("double")) * stride - w / 2, (row + bbox[1].cast("double")) * stride - h / 2
    marks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: F.struct(((F.get(kps, 2 * n).cast("double") + col) * stride).alias("x"), ((F.get(kps, 2 * n + 1).cast("double") + row) * stride).alias("y")))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.sqrt(clip(cls) * clip(obj)).alias("score"), marks.alias("landmarks"))


def iou(a: Column, b: Column) -> Column:
    overlap = lambda lo, hi: F.greatest(F.lit(0.0), F.least(*hi) - F.greatest(*lo))
    common = overlap((a["x"], b["x"]), (a["x"] + a["w"], b["x"] + b["w"])) * overlap((a["y"], b["y"]), (a["y"] + a["h"], b["y"] + b["h"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union <= 0, 0.0).otherwise(common / union)


def nms(candidates: Column, least_score: float = 0.7, threshold: float = 0.3) -> Column:
    """Candidates (array of struct with x, y, w, h, score) that survive greedy suppression, best first, input order on ties."""
    fit = F.filter(candidates, lambda c: c["score"] >= least_score)
    numbered = F.transform(fit, lambda c, i: F.struct((-c["score"]).alias("k"), i.alias("i"), c.alias("c")))
    ordered = F.transform(F.array_sort(numbered), lambda x: x["c"])
    keep = lambda kept, c: F.when(F.exists(kept, lambda k: iou(k, c) >= threshold), kept).otherwise(F.concat(kept, F.array(c)))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), keep)


def best_face(candidates: Column) -> Column:
    return F.get(nms(candidates), F.lit(0))
