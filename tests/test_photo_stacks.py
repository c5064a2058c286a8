"""Photos that are read in stacks: text boxes, outlines and lines are those of each photo alone, with few Python calls a photo."""

import cProfile
import pstats

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lensmill.functions import pixels
from lensmill.operators import vision
from lensmill.plans import queries as q

STUBS = {"text_detector": q.one_line, "text_direction": lambda x: [np.array([[1.0, 0.0]])], "text_recogniser": q.by_brightness}


def blobs(n: int, h: int, w: int, seed: int = 1) -> np.ndarray:
    """Maps with regions of all shapes: noise, averaged with its neighbours."""
    a = np.random.default_rng(seed).random((n, h, w))
    for _ in range(seed % 4):
        p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge")
        a = (p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] + a) / 5
    return np.clip(a - np.quantile(a, 0.6) + 0.3, 0, 1)


def components(mask: np.ndarray) -> list[set]:
    """Connected sets of pixels (row, column), in order of their first pixel."""
    left, out = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    for p in sorted(left):
        if p in left:
            own, todo = set(), [p]
            while todo:
                y, x = todo.pop()
                if (y, x) in left:
                    left.discard((y, x))
                    own.add((y, x))
                    todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            out.append(own)
    return out


def walked(own: set) -> list[tuple[int, int]]:
    """Border pixels (x, y), step by step, from the first pixel until the first step comes again."""
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    at = start = min(own)
    out, heading, first = [], 0, None
    while True:
        turn = next((d % 8 for d in range(heading + 5, heading + 13) if (at[0] + around[d % 8][0], at[1] + around[d % 8][1]) in own), None)
        if turn is None or (at == start and turn == first):
            return out or [start[::-1]]
        out.append(at[::-1])
        first = turn if first is None else first
        at, heading = (at[0] + around[turn][0], at[1] + around[turn][1]), turn


@pytest.mark.parametrize("seed", range(1, 9))
def test_outlines_of_a_stack_are_walked(seed):
    """Many outlines are walked side by side; few, and those that are left at last, one after the other."""
    masks = blobs(12, 9 + seed, 17, seed) > 0.3
    points, n, whose = pixels.outlines_all(masks)
    found = np.split(points, np.cumsum(n)[:-1])
    plain = [(i, walked(own)) for i, mask in enumerate(masks) for own in components(mask)]
    assert [(i, list(map(tuple, line.tolist()))) for i, line in zip(whose.tolist(), found, strict=True)] == plain
    for mask in masks[:3]:
        assert [line.tolist() for line in pixels.outlines(mask, holes=False)] == [list(map(list, walked(own))) for own in components(mask)]


def test_hulls_of_many_sets():
    """A corner is a point that lies between no others: checked by every pair, for pixels and for other numbers, lines and single points."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, k % 7 + 1, (k % 11 + 1, 2)) for k in range(80)] + [np.array([[3, 1]] * 4), np.array([[0, 0], [2, 2], [1, 1]])]
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for kind in (int, float):
        corners, whose = pixels.hulls(np.concatenate(sets).astype(kind), own)
        for i, s in enumerate(sets):
            found, given = corners[whose == i].tolist(), np.unique(s, axis=0).tolist()
            side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            after = found[1:] + found[:1]
            assert found[0] == min(given) and all(p in given for p in found) and len({*map(tuple, found)}) == len(found)
            assert all(side(a, b, p) >= 0 for a, b in zip(found, after, strict=True) for p in given)
            assert len(found) < 3 or all(side(a, b, c) > 0 for a, b, c in zip(found, after, after[1:] + after[:1], strict=True))


@pytest.mark.parametrize("profile", ["android", "ios"])
def test_boxes_of_a_stack(profile):
    probs = blobs(30, 24, 40, 6)
    together = pixels.text_boxes_all(probs, 0.8, 1.7, profile)
    assert sum(map(len, together)) > 60
    for own, prob in zip(together, probs, strict=True):
        assert np.array_equal(own, pixels.text_boxes(prob, 0.8, 1.7, profile))
    assert pixels.text_boxes_all(np.zeros((3, 8, 8)), 1.0, 1.0, profile) == [[], [], []]


@pytest.mark.parametrize(("shape", "size"), [((4, 18), (192, 48)), ((12, 16), (32, 32)), ((24, 48), (192, 48)), ((1, 1), (5, 3)), ((64, 64), (128, 128)), ((65, 9), (20, 30)), ((9, 30), (12, 5))])
def test_small_images_are_resized_exactly(shape, size):
    """Each pixel as two rows and two columns give it, also where it lies right between two values."""
    (h, w), (width, height) = shape, size
    own = np.random.default_rng(3).integers(0, 256, (3, h, w), dtype=np.uint8)
    found = pixels.bilinear_all(own, width, height)
    place = lambda k, n, m: min(max((k + 0.5) * n / m - 0.5, 0), n - 1)
    for y in range(height):
        for x in range(0, width, 3):
            py, px = place(y, h, height), place(x, w, width)
            fy, fx = py - int(py), px - int(px)
            column = lambda c: own[:, int(py), c].astype(float) * (1 - fy) + own[:, min(int(py) + 1, h - 1), c].astype(float) * fy  # noqa: E731, B023
            assert np.array_equal(found[:, y, x], (column(int(px)) * (1 - fx) + column(min(int(px) + 1, w - 1)) * fx + 0.5).astype(np.uint8))


def test_parts_are_larger_where_images_are_small():
    rows = lambda n, size: pa.record_batch({"content": pa.array([b"x" * size] * n)})
    assert [p.num_rows for p in vision._parts(rows(2500, 200))] == [1024, 1024, 452]
    assert [p.num_rows for p in vision._parts(rows(150, 100_000))] == [64, 64, 22]
    mixed = pa.record_batch({"content": pa.array([b"x" * (100_000 if i < 100 else 100) for i in range(1000)])})
    parts = list(vision._parts(mixed))
    assert parts[0].num_rows == 64 and sum(p.num_rows for p in parts) == 1000


def test_lines_become_arrow_arrays(spark):
    kind = to_arrow_schema(StructType.fromDDL(f"raw array<struct<steps:{vision._BEST},classes:int,x:double,y:double,width:double,height:double>>"))[0].type
    line = lambda k: (np.arange(k), np.arange(k) / 7, 9, [0.1, 0.2, 0.3, float(k)])
    photos = [[line(3), line(0)], None, [], [line(1)]]
    as_dict = lambda l: {"steps": [{"k": int(k), "p": float(p)} for k, p in zip(l[0], l[1], strict=True)], "classes": l[2], **dict(zip(("x", "y", "width", "height"), l[3], strict=True))}
    for own in (photos, [None], [[]]):
        found = vision._line_arrays(own)
        found.validate(full=True)
        assert found.cast(kind).to_pylist() == [None if o is None else [as_dict(x) for x in o] for o in own]


def test_few_python_calls_a_photo(monkeypatch):
    """Photos share the steps' Python work; each alone took some 500 calls."""
    caught = []

    def catch(images, ddl, work, carry, *rest):
        caught.append(work)
        raise StopIteration

    monkeypatch.setattr(vision, "_in_batches", catch)
    with pytest.raises(StopIteration):
        vision.capture_texts(None, STUBS, list(q.READ_CHARSET))
    rng = np.random.default_rng(4)
    quad = [0.0, 0.0, 15.0, 0.0, 15.0, 11.0, 0.0, 11.0]
    rows = [{"content": b"P5\n16 12\n255\n" + rng.bytes(192), "quad": quad if i % 2 else None} for i in range(1024)]
    caught[0](rows[:64])
    profile = cProfile.Profile()
    found = profile.runcall(caught[0], rows)
    assert len(found) == 1024 and all(len(x[0]) == 1 for x in found)
    assert pstats.Stats(profile).total_calls < 200 * len(rows)


def bright_rows(x):
    """A text detector that finds what is bright; it fails where the first pixel is black."""
    if x[0, 0, 0, 0] < -2.1:
        raise RuntimeError("black corner")
    return [(x[:, :1] > 0.8).astype(np.float32)]


def by_shade(x):
    """A recogniser that reads two letters by what it sees; it fails on the darkest lines."""
    shade = (float(x.mean()) + 1) / 2
    if shade < 0.45:
        raise RuntimeError("too dark")
    out = np.zeros((1, 4, 9))
    out[0, np.arange(4), (1 + int(shade * 7), 0, 1 + int(float(x.max()) * 3) % 6, 8)] = 4.0
    return [out]


@pytest.mark.parametrize("profile", ["android", "ios"])
def test_photos_together_are_read_as_alone(spark, profile):
    """Photos of several shapes, good and bad, in one part give what each gives in a batch of its own."""
    models = {"text_detector": bright_rows, "text_direction": lambda x: [np.array([[0.5, float(x[0, 0, 0, 0]) + 0.5]])], "text_recogniser": by_shade}
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        h, w = ((24, 40), (12, 16), (33, 32))[i % 3]
        image = (blobs(1, h, w, 2 + i)[0] * 700 - 100).clip(0 if i % 13 == 0 else 1, 255).astype(np.uint8)
        if i % 13 == 0:
            image[0, 0] = 0
        content = b"P5\n%d %d\n255\n" % (w, h) + image.tobytes()
        quad = ([1.0, 1.0, w - 2.0, 0.5, w - 1.0, h - 2.0, 0.0, h - 1.0], None, [float("nan")] * 8)[min(int(rng.integers(0, 12)), 2) if i % 2 else 0] if i % 4 else None
        rows.append((i, "ID_CARD", content[: 40 if i % 17 == 0 else None], quad))
    rows += [(120, "ID_CARD", b"P5\n0 0\n255\n", None), (121, "ID_CARD", b"P5\n7", None)]
    photos = spark.createDataFrame(rows, "capture_id bigint, document_type string, content binary, quad array<double>").coalesce(1)
    read = lambda: {r.capture_id: r.asDict(True) for r in vision.capture_texts(photos, models, list("ABCDEFGH"), profile).collect()}
    together = read()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        alone = read()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert together == alone and len(alone) == len(rows)
    assert alone[120]["error"] == "ValueError: the photo has no pixels" and "head" in alone[121]["error"]
    errors = {r["error"] for r in alone.values()}
    assert None in errors and len(errors) > 2 and max(len(r["lines"]) for r in alone.values()) > 1


def test_bends_keep_areas_and_hulls():
    """Points on a straight line between two others go; single pixels, lines there and back and turns by one step stay."""
    masks = blobs(20, 15, 15, 3) > 0.3
    masks[0], masks[1] = False, False
    masks[0, 3, 4] = masks[1, 2:9, 5] = True
    points, n, _ = pixels.outlines_all(masks)
    few, left = pixels.bends(points, n)
    cut = lambda p, k: np.split(p, np.cumsum(k)[:-1])
    assert left.sum() < n.sum() and cut(few, left)[0].tolist() == [[4, 3]] and cut(few, left)[1].tolist() == [[5, 2], [5, 8]]
    for a, b in zip(cut(points, n), cut(few, left), strict=True):
        assert pixels.polygon_area(a) == pixels.polygon_area(b) and np.array_equal(pixels.hull(a), pixels.hull(b))
