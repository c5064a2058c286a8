"""Pixel and inference stages over Arrow batches, and the frame and capture pipelines made of them.

Models are pluggable: any callable from a 1x3xHxW array to a list (or dict) of arrays will do; onnx_model() makes one from
ONNX bytes, one session a worker and version. Python runs models and pixel arithmetic, each once an image; what their
outputs mean is decided by native columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from lensmill.functions import frames, geometry, pixels, tensors
from lensmill.operators import sequences

Model = Callable[[np.ndarray], list[np.ndarray]]
#: Images of a batch that are worked on at a time, and pixels that are measured in one stack.
IMAGE_ROWS, STACK_PIXELS = 64, 1 << 21
#: Small images come in larger parts: as many rows, while they hold so many bytes at most.
SMALL_ROWS, SMALL_BYTES = 1024, 1 << 18
#: Pixels of what is made for a stack of images, so that its parts stay in a core's cache.
MADE_PIXELS = 1 << 16
MEASURES = "width int, height int, blur_score double, brightness double, glare_ratio double"
STRIDES = (8, 16, 32)
DETECTOR_SIZE, CLASSIFIER_SIZE, FACE_SIZE = 256, 224, 640
HALF = (0.5,) * 3
PLAIN = {"mean": (0.0,) * 3, "std": (1.0,) * 3}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of IMAGE_ROWS rows, or of more where they are small."""
    at = 0
    while at < batch.num_rows:
        rows = SMALL_ROWS
        while rows > IMAGE_ROWS and batch.slice(at, rows).nbytes > SMALL_BYTES:
            rows = max(IMAGE_ROWS, rows // 2)
        yield batch.slice(at, rows)
        at += rows


def _in_batches(images: DataFrame, ddl: str, work: Callable[[list[dict]], list], carry: tuple[str, ...], arrays: Mapping[str, Callable[[list], pa.Array]] = {}) -> DataFrame:
    """The carried columns, those of ddl as work() gives them, a tuple or an exception for each row, and error.

    A row that fails gives nulls and the error's text, as one bad frame must not end a job. arrays: for columns whose values
    are not what Arrow takes, what makes an array of them.
    """
    own = StructType.fromDDL(ddl).fields
    schema = StructType([*(sequences.nullable(images.schema[c]) for c in carry), *own, StructField("error", StringType())])
    arrow = to_arrow_schema(schema)
    kinds = [arrays.get(f.name, lambda v, t=f.type: pa.array(v, t)) for f in arrow][len(carry) : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                names = part.schema.names
                found = work([dict(zip(names, v, strict=True)) for v in zip(*(c.to_pylist() for c in part.columns), strict=True)])
                failed = [f"{type(x).__name__}: {x}" if isinstance(x, Exception) else None for x in found]
                values = zip(*((None,) * len(kinds) if isinstance(x, Exception) else x for x in found), strict=True)
                columns = [part.column(names.index(c)).cast(arrow.field(c).type) for c in carry]
                columns += [made(list(v)) for v, made in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed, pa.string())], schema=arrow)

    return images.mapInArrow(run, schema)


def _each(work: Callable[[dict], tuple]) -> Callable[[list[dict]], list]:
    def one(row: dict):
        try:
            return work(row)
        except Exception as e:
            return e

    return lambda rows: [one(row) for row in rows]


def _raised(e: Exception):
    raise e


def _alike(items: list, key: Callable, work: Callable[[list], Sequence], made: int | Callable = 0, most: int = MADE_PIXELS) -> list:
    """work() of all items that have the same key together, made pixels of each at most ``most`` at a time; exceptions stay.

    Items that fail together are tried one by one, so that only those that fail alone give an exception.
    """
    out, groups = list(items), {}
    for i, x in enumerate(items):
        if not isinstance(x, Exception):
            groups.setdefault(key(x), []).append(i)
    for k, own in groups.items():
        step = max(1, most // max(1, made(k) if callable(made) else made))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            try:
                found = list(work([items[i] for i in some]))
            except Exception:
                found = _each(lambda x: list(work([x]))[0])([items[i] for i in some])
            for i, x in zip(some, found, strict=True):
                out[i] = x
    return out


def _stacked(images: list[np.ndarray]) -> np.ndarray:
    """np.stack() of arrays of one shape, with less work an array."""
    return np.concatenate(images).reshape(len(images), *images[0].shape)


def _inputs(images: list[np.ndarray], size: int, made: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Place and 1 x C x H x W input of each image, squashed to size x size, stack by stack of images of one shape."""
    shapes: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        shapes.setdefault(image.shape, []).append(i)
    step = max(1, MADE_PIXELS // (size * size))
    for own in shapes.values():
        for at in range(0, len(own), step):
            some = own[at : at + step]
            x = made(pixels.bilinear_all(_stacked([images[i] for i in some]), size, size))
            yield from ((i, x[k : k + 1]) for k, i in enumerate(some))


def warped(images: list[np.ndarray], quads: list[np.ndarray]) -> list:
    """pixels.warp() of each image by its quad, or an exception."""
    if not quads:
        return []
    given = _stacked(quads)
    finite = np.isfinite(given).all(axis=(1, 2))
    sizes = pixels.warp_sizes(np.where(finite[:, None, None], given, 0.0)).tolist()
    given = [x if ok else ValueError("the quad is not finite") for x, ok in zip(zip(images, quads, sizes, strict=True), finite.tolist(), strict=True)]
    together = lambda own: pixels.warp_all(_stacked([x[0] for x in own]), _stacked([x[1] for x in own]), *own[0][2])
    return _alike(given, lambda x: (x[0].shape, *x[2]), together, lambda k: k[-1] * k[-2])


def gray_of(row: dict) -> np.ndarray:
    gray = pixels.to_gray(row["data"], row["width"], row["height"], row["row_stride"], row["pixel_format"])
    return pixels.downscale(pixels.oriented(gray, row["orientation"] or "up", bool(row["is_mirrored"])))


def color_of(row: dict) -> np.ndarray:
    """The image as RGB, as gray_of() turns and scales it; a format without colour gives gray three times over."""
    bgr = pixels.bgr_of(row["data"], row["width"], row["height"], row["row_stride"], row["pixel_format"])
    if not bgr.size:
        return np.repeat(gray_of(row)[..., None], 3, axis=2)
    return pixels.downscale(pixels.oriented(bgr[..., ::-1], row["orientation"] or "up", bool(row["is_mirrored"])))


def _measured(grays: list) -> list:
    """Size, blur, brightness and glare of each gray image (exceptions stay); images of one size are measured in stacks."""
    out, sizes = list(grays), {}
    for i, gray in enumerate(grays):
        if not isinstance(gray, Exception):
            sizes.setdefault(gray.shape, []).append(i)
    for (h, w), own in sizes.items():
        step = max(1, STACK_PIXELS // max(1, h * w))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            stack = np.stack([grays[i] for i in some])
            for i, *m in zip(some, pixels.laplacian_variance(stack).tolist(), pixels.brightness(stack).tolist(), pixels.glare_ratio(stack).tolist(), strict=True):
                out[i] = (w, h, *m)
    return out


def frame_quality(images: DataFrame, carry: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Size, blur, brightness and glare of each image of IMAGE_SCHEMA."""
    grays = _each(gray_of)
    return _in_batches(images, MEASURES, lambda rows: _measured(grays(rows)), carry)


def contour_quads(images: DataFrame, profile: str = "android", carry: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The contour quad of each image, null if there is none, and its confidence."""

    def work(row: dict) -> tuple:
        found = pixels.contour_quad(gray_of(row), profile)
        return (found[0].ravel().tolist(), float(found[1])) if found else (None, 0.0)

    return _in_batches(images, "quad array<double>, quad_confidence double", _each(work), carry)


def thumbnails(images: DataFrame, edge: int = pixels.MOTION_EDGE, carry: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Gray thumbnails for motion: the carried columns, thumb_width, thumb_height, gray."""

    def work(row: dict) -> tuple:
        small = pixels.downscale(gray_of(row), edge)
        return small.shape[1], small.shape[0], small.tobytes()

    return _in_batches(images, "thumb_width int, thumb_height int, gray binary", _each(work), carry)


def clamped(quad: np.ndarray, image: np.ndarray) -> np.ndarray:
    return np.clip(quad, 0, np.array(image.shape[1::-1]) - 1)


def rectify(image: np.ndarray, quad, profile: str = "android") -> np.ndarray:
    """The quad warped upright; ios clamps it first and leaves the image as it is if no more than 16 pixels are in it."""
    if quad is None:
        return image
    q = np.array(quad, float).reshape(4, 2)
    if profile == "ios":
        q = clamped(q, image)
        if pixels.polygon_area(q) <= 16:
            return image
    return pixels.warp(image, q)


def rectified(photos: DataFrame, profile: str = "android") -> DataFrame:
    """photos(image_id, content, quad array<double> of 8 or null): the warped image, encoded."""
    work = lambda row: (pixels.encode(rectify(pixels.decode(row["content"]), row["quad"], profile)),)
    return _in_batches(photos, "content binary", _each(work), ("image_id",))


def _boxes(maps: list, profile: str) -> list:
    """pixels.text_boxes() of each map and its scales, or an exception."""
    together = lambda own: pixels.text_boxes_all(_stacked([x[0] for x in own]), *own[0][1:], profile)
    return _alike(maps, lambda x: (x[0].dtype.str, *x[0].shape, *x[1:]), together, lambda k: k[1] * k[2], STACK_PIXELS)


def text_lines(maps: DataFrame, profile: str = "android") -> DataFrame:
    """maps(image_id, height, width, prob array<float>, scale_x, scale_y): quads of text lines in reading order."""

    def work(rows: list[dict]) -> list:
        probs = _each(lambda row: (np.array(row["prob"], np.float32).reshape(row["height"], row["width"]), row["scale_x"], row["scale_y"]))(rows)
        return [x if isinstance(x, Exception) else ([q.ravel().tolist() for q in x],) for x in _boxes(probs, profile)]

    found = _in_batches(maps, "quads array<array<double>>", work, ("image_id",))
    return found.select("image_id", F.posexplode("quads").alias("line_idx", "quad"))


@lru_cache(8)
def session(version: str, content: bytes):
    """An ONNX session of one thread, one a worker and version; tasks scale it, not threads."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])


def close_sessions() -> None:
    """Drops the sessions of this process; a worker's go when it ends, or when newer versions push them out."""
    session.cache_clear()


def onnx_model(version: str, content: bytes, named: bool = False) -> Model:
    """A model from ONNX bytes; the session is made on the worker at its first call. named: outputs as a dict."""

    def run(x: np.ndarray):
        own = session(version, content)
        out = own.run(None, {own.get_inputs()[0].name: x})
        return {o.name: v for o, v in zip(own.get_outputs(), out, strict=True)} if named else out

    run.input_size = lambda height, width: input_size(version, content, height, width)
    return run


def declared_size(model: Model, height: int, width: int) -> tuple[int, int]:
    """What a model says of its input (an attribute input_size, as onnx_model sets it), or the defaults."""
    return model.input_size(height, width) if hasattr(model, "input_size") else (height, width)


def static_size(shape: list, height: int, width: int) -> tuple[int, int]:
    """Input height and width that a model declares, or the defaults where it leaves them open."""
    fixed = [n if isinstance(n, int) and n > 0 else None for n in [*shape, None, None, None, None][2:4]]
    return fixed[0] or height, fixed[1] or width


def input_size(version: str, content: bytes, height: int, width: int) -> tuple[int, int]:
    return static_size(session(version, content).get_inputs()[0].shape, height, width)


REQUIRED, OPTIONAL = ("detector", "text_detector", "text_direction", "text_recogniser"), ("face_detector", "classifier")


def load_models(read: Callable[[str], bytes], paths: Mapping[str, str], make: Callable[[str, bytes], Model] = onnx_model) -> dict[str, Model | None]:
    """All models of a pack at once: a required one that is missing is an error, an optional one is None.

    The pack replaces the one before only when it is complete, as its caller gets a new dict or an error.
    """
    out: dict[str, Model | None] = {}
    for name in (*REQUIRED, *OPTIONAL):
        try:
            path = paths.get(name)
            if not path:
                raise FileNotFoundError(f"no path for the model {name}")
            out[name] = make(path, read(path))
        except Exception:
            if name in REQUIRED:
                raise
            out[name] = None
    return out


def infer(images: DataFrame, model: Model, size: int, raw: bool = False, output: int = 0, color: bool = False) -> DataFrame:
    """Each image squashed to size x size through the model: image_id, shape, data, scale_x, scale_y, error.

    Gray is repeated to three channels unless color is asked for.
    """

    def work(row: dict) -> tuple:
        image, sx, sy = pixels.squash(color_of(row) if color else gray_of(row), size)
        found = model(pixels.tensor(image, raw=raw))[output]
        return list(found.shape), found.ravel().astype(np.float32).tolist(), sx, sy

    return _in_batches(images, "shape array<int>, data array<float>, scale_x double, scale_y double", _each(work), ("image_id",))


_DETECTED = f"{MEASURES}, thumb_width int, thumb_height int, gray binary, shape array<int>, data array<float>, contour array<double>, contour_confidence double"


def detect(images: DataFrame, model: Model | None, size: int = DETECTOR_SIZE, profile: str = "android", carry: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Carried columns, measures, thumbnail, quad (struct, in pixels of the working image) and confidence of each image.

    One pass over the pixels: the model runs once an image, and the contours where it fails or its output has no known
    shape. Either quad is decoded by native columns.
    """

    def answered(x: np.ndarray) -> tuple | None:
        try:
            out = model(x)[0]
            return (list(out.shape), out.ravel().astype(np.float32).tolist()) if frames.known_shape(out.shape) else None
        except Exception:  # a detector that fails is one that found nothing
            return None

    def found(gray: np.ndarray, answer: tuple | None) -> tuple:
        small = pixels.downscale(gray, pixels.MOTION_EDGE)
        thumb = (small.shape[1], small.shape[0], small.tobytes())
        if answer:
            return (*thumb, *answer, None, None)
        contour = pixels.contour_quad(gray, profile)
        return (*thumb, None, None, *((contour[0].ravel().tolist(), float(contour[1])) if contour else (None, None)))

    def work(rows: list[dict]) -> list:
        grays = _each(gray_of)(rows)
        images = grays
        if profile == "ios":
            images = _each(lambda x: x[1] if isinstance(x[1], Exception) else color_of(x[0]))(list(zip(rows, grays, strict=True)))
        seen, answers = [i for i, x in enumerate(images) if not isinstance(x, Exception) and x.size], {}
        if model is not None:
            answers = {seen[k]: answered(x) for k, x in _inputs([images[i] for i in seen], size, lambda x: pixels.tensors(x, **PLAIN))}
        rest = _each(lambda i: images[i] if isinstance(images[i], Exception) else found(grays[i], answers.get(i)))(list(range(len(rows))))
        return [b if isinstance(b, Exception) else (*a, *b) for a, b in zip(_measured(grays), rest, strict=True)]

    own = _in_batches(images, _DETECTED, work, carry)
    corner = frames.corner_output(F.col("shape"), F.col("data"), F.col("width"), F.col("height"), size, profile)
    own = own.withColumn("corner", corner)
    by_contour = geometry.quad_of([geometry.point(F.get("contour", F.lit(2 * k)), F.get("contour", F.lit(2 * k + 1))) for k in range(4)])
    quad = F.coalesce("corner.quad", F.when(F.col("contour").isNotNull(), by_contour))
    confidence = F.coalesce("corner.confidence", "contour_confidence", F.lit(0.0))
    return own.withColumns({"quad": quad, "confidence": confidence}).drop("shape", "data", "corner", "contour", "contour_confidence")


def classify_documents(images: DataFrame, model: Model, size: int = CLASSIFIER_SIZE, carry: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """images with quad_at (array<double> of 8 or null): logits of the part of each image in its quad, null without one."""

    logits = _each(lambda x: (model(x)[0].ravel().astype(np.float32).tolist(),))

    def work(rows: list[dict]) -> list:
        out: list = [(None,)] * len(rows)
        some = [i for i, row in enumerate(rows) if row["quad_at"] is not None]
        for i, gray in zip(some, _each(gray_of)([rows[i] for i in some]), strict=True):
            out[i] = gray
        some = [i for i in some if not isinstance(out[i], Exception)]
        for i, crop in zip(some, warped([out[i] for i in some], [np.array(rows[i]["quad_at"], float).reshape(4, 2) for i in some]), strict=True):
            out[i] = crop
        some = [i for i in some if not isinstance(out[i], Exception)]
        for k, x in _inputs([out[i] for i in some], size, pixels.tensors):
            out[some[k]] = logits([x])[0]
        return out

    return _in_batches(images, "logits array<float>", work, carry)


_IMAGE = ("width", "height", "row_stride", "pixel_format", "orientation", "is_mirrored", "data")
_KEYS = ("session_id", "event_id", "timestamp_ms")


def document_frames(images: DataFrame, detector: Model | None, classifier: Model | None = None, size: int = DETECTOR_SIZE, profile: str = "android") -> DataFrame:
    """Frame rows of camera images (IMAGE_SCHEMA with session_id, event_id, timestamp_ms): detection, type, measures, motion.

    Images are not shuffled; only thumbnails and decoded values are, by session, for motion. A frame that fails gives
    the empty row. The classifier runs for frames with a quad alone and counts from a confidence of 0.6.
    """
    given = images.select(*_KEYS, *_IMAGE, *[F.col(c).alias(f"buffer_{c}") for c in _IMAGE] if classifier else [])
    own = detect(given, detector, size, profile, carry=(*_KEYS, *[c for c in given.columns if c.startswith("buffer_")]))
    own = own.withColumn("found", frames.is_found(F.col("quad"), F.col("confidence"), profile))
    kept = [*_KEYS, "width", "height", "blur_score", "brightness", "glare_ratio", "thumb_width", "thumb_height", "gray", "quad", "confidence", "found"]
    if classifier:
        at = F.when(F.col("found"), F.array(*[p[k] for p in geometry.corners(F.col("quad")) for k in "xy"]))
        buffers = own.select(*kept[:3], *[F.col(c).alias(f"own_{c}") for c in kept[3:]], *[F.col(f"buffer_{c}").alias(c) for c in _IMAGE], at.alias("quad_at"))
        own = classify_documents(buffers, classifier, carry=tuple(buffers.columns[: len(kept)])).toDF(*kept, "logits", "error")
        kind = F.coalesce(tensors.classify(F.col("logits"))["trusted"], F.lit("GENERIC"))
        own = own.withColumn("document_type", F.when(F.col("found"), kind).otherwise("GENERIC"))
    else:
        own = own.withColumn("document_type", F.lit("GENERIC"))
    moved = sequences.motion(own.drop("error"), keep=tuple(c for c in own.columns if c not in ("error", "gray", "thumb_width", "thumb_height")))
    return frames.document_row(moved.withColumnsRenamed({"found": "detected", "width": "frame_width", "height": "frame_height"}))


def faces_of(images: DataFrame, model: Callable[[np.ndarray], Mapping[str, np.ndarray]], size: int = FACE_SIZE, least: float = 0.7, carry: tuple[str, ...] = ("image_id",), profile: str = "android") -> DataFrame:
    """Carried columns, measures, thumbnail and cells: the raw values of the grid cells whose score reaches ``least``.

    The model gives cls_s, obj_s, bbox_s and kps_s for each stride s of 8, 16, 32. Few cells pass, so only those leave Python.
    Where one of the four is missing, android finds no face in the image, ios none of that stride.
    """
    cell = "struct<cls:double,obj:double,bbox:array<double>,kps:array<double>,grid_row:int,grid_col:int,stride:int>"

    def cells(x: np.ndarray) -> list[dict]:
        out = model(x)
        found = []
        for stride in STRIDES:
            columns = size // stride
            if profile == "ios" and not all(np.size(out.get(f"{n}_{stride}", ())) for n in ("cls", "obj", "bbox", "kps")):
                continue
            cls, obj, bbox, kps = (np.asarray(out[f"{n}_{stride}"], np.float64).reshape(columns * columns, -1) for n in ("cls", "obj", "bbox", "kps"))
            # Clipping makes a product of two positive values no larger, so few cells are looked at closely.
            near = np.flatnonzero(cls[:, 0] * obj[:, 0] >= 0.999 * least * least)
            score = np.sqrt(np.clip(cls[near, 0], 0, 1) * np.clip(obj[near, 0], 0, 1))
            for k in near[score >= least].tolist():
                found.append({"cls": cls[k, 0], "obj": obj[k, 0], "bbox": bbox[k].tolist(), "kps": kps[k].tolist(), "grid_row": k // columns, "grid_col": k % columns, "stride": stride})
        return found

    def thumb(gray: np.ndarray) -> tuple:
        small = pixels.downscale(gray, pixels.MOTION_EDGE)
        return small.shape[1], small.shape[0], small.tobytes()

    def work(rows: list[dict]) -> list:
        grays = _each(gray_of)(rows)
        seen, found = [i for i, g in enumerate(grays) if not isinstance(g, Exception) and g.size], {}
        for k, x in _inputs([grays[i] for i in seen], size, lambda x: pixels.tensors(x, raw=True)):
            own = _each(cells)([x])[0]
            found[seen[k]] = [] if isinstance(own, Exception) else own
        return [g if isinstance(g, Exception) else (*m, *thumb(g), found.get(i, [])) for i, (m, g) in enumerate(zip(_measured(grays), grays, strict=True))]

    return _in_batches(images, f"{MEASURES}, thumb_width int, thumb_height int, gray binary, cells array<{cell}>", work, carry)


def face_frames(images: DataFrame, model: Callable | None, size: int = FACE_SIZE, profile: str = "android") -> DataFrame:
    """Face frame rows of camera images: the best face that survives suppression, measures, motion. See document_frames()."""
    empty = {f"{n}_{s}": np.zeros(((size // s) ** 2, k)) for s in STRIDES for n, k in (("cls", 1), ("obj", 1), ("bbox", 4), ("kps", 10))}
    own = faces_of(images.select(*_KEYS, *_IMAGE), model or (lambda x: empty), size, carry=_KEYS, profile=profile)
    decoded = F.transform("cells", lambda c: tensors.face_cell(c["cls"], c["obj"], c["bbox"], c["kps"], c["grid_row"], c["grid_col"], c["stride"]))
    own = own.withColumn("best", tensors.best_face(decoded))
    own = own.withColumn("face", frames.face_output(F.col("best"), F.col("width"), F.col("height"), size)).drop("cells", "best", "error")
    moved = sequences.motion(own, keep=tuple(c for c in own.columns if c not in ("gray", "thumb_width", "thumb_height")))
    return frames.face_row(moved.withColumnsRenamed({"width": "frame_width", "height": "frame_height"}))


_BEST = "array<struct<k:int,p:double>>"


def best_classes(steps: np.ndarray) -> list[dict]:
    """First largest class of each step and its softmax probability."""
    return [{"k": a, "p": b} for a, b in zip(*(x[0].tolist() for x in best_classes_all(steps[None])), strict=True)]


def best_classes_all(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best_classes() of each of a stack of lines with equally many steps: the classes and the probabilities."""
    return steps.argmax(axis=2), 1 / np.exp(steps - steps.max(axis=2, keepdims=True)).sum(axis=2)


def _read_lines(outs: list) -> list:
    """Best classes of each step, their probabilities and the number of classes, of each output; see read_classes()."""

    def together(own: list[np.ndarray]) -> list[tuple]:
        if own[0].ndim != 3:
            return [(np.empty(0, int), np.empty(0), 0)] * len(own)
        return [(k, p, own[0].shape[2]) for k, p in zip(*best_classes_all(_stacked([x[0] for x in own]).astype(np.float64)), strict=True)]

    return _alike(outs, lambda x: x.shape, together, lambda k: int(np.prod(k)))


def _lists(lengths: list[int], values: pa.Array, missing: list[bool] | None = None) -> pa.Array:
    """Lists of the given lengths, cut from all values one after the other; null where one is missing."""
    ends = np.cumsum([0, *lengths], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, values, mask=None if missing is None else pa.array(missing, pa.bool_()))


def _line_arrays(photos: list[list[tuple] | None]) -> pa.Array:
    """Arrow's array of each photo's lines (classes, probabilities, number of classes, box), without a Python value a step."""
    lines = [line for own in photos for line in own or ()]
    whole = lambda k, t: np.concatenate([np.empty(0, t), *(line[k] for line in lines)]).astype(t)
    best = pa.StructArray.from_arrays([pa.array(whole(0, np.int32)), pa.array(whole(1, np.float64))], ["k", "p"])
    boxes = np.array([line[3] for line in lines], float).reshape(-1, 4).T
    parts = [_lists([len(line[0]) for line in lines], best), pa.array([line[2] for line in lines], pa.int32()), *map(pa.array, boxes)]
    own = pa.StructArray.from_arrays(parts, ["steps", "classes", "x", "y", "width", "height"])
    return _lists([len(own or ()) for own in photos], own, [own is None for own in photos])


#: The widest line that a recogniser is given.
WIDEST = {"android": 320, "ios": 1600}


def recognised(crop: np.ndarray, model: Model, profile: str = "android") -> tuple[list[dict], int]:
    """Best class of each step of a line, and the number of classes. The line is brought to the height that the model declares."""
    height, width = line_size(crop.shape, model, profile)
    return read_classes(model(pixels.tensor(pixels.bilinear(crop, width, height), HALF, HALF))[0])


def line_size(shape: tuple[int, ...], model: Model, profile: str = "android") -> tuple[int, int]:
    """Height and width of a line's input to the recogniser."""
    height, _ = declared_size(model, 48, 320)
    width = height * shape[1] / max(1, shape[0])
    return height, min(max(int(width) if profile == "android" else int(width + 0.5), 1), WIDEST[profile])


def read_classes(out: np.ndarray) -> tuple[list[dict], int]:
    """Best class of each step and the number of classes, of a recogniser's output; nothing of one in no known shape."""
    return (best_classes(out[0].astype(np.float64)), out.shape[2]) if out.ndim == 3 else ([], 0)


def direction_input(crop: np.ndarray, height: int, width: int, profile: str = "android") -> np.ndarray:
    """The crop at the direction model's size: android stretches it, ios keeps its shape, at the left of a black canvas."""
    if profile == "android":
        return pixels.bilinear(crop, width, height)
    own = min(width, max(1, -(-height * crop.shape[1] // max(1, crop.shape[0]))))
    canvas = np.zeros((height, width, *crop.shape[2:]), crop.dtype)
    canvas[:, :own] = pixels.bilinear(crop, own, height)
    return canvas


def turned_upright(crop: np.ndarray, model: Model, profile: str = "android") -> tuple[np.ndarray, bool]:
    """The crop, by 180 degrees where class 1 beats class 0."""
    scores = np.ravel(model(pixels.tensor(direction_input(crop, *declared_size(model, 48, 192), profile), HALF, HALF))[0])
    turned = len(scores) > 1 and bool(scores[1] > scores[0])
    return (np.ascontiguousarray(crop[::-1, ::-1]) if turned else crop), turned


def upright(crops: DataFrame, model: Model, profile: str = "android") -> DataFrame:
    """Turns a crop by 180 degrees where class 1 beats class 0: image_id, content, turned."""

    def work(row: dict) -> tuple:
        image, turned = turned_upright(pixels.decode(row["content"]), model, profile)
        return pixels.encode(image), turned

    return _in_batches(crops, "content binary, turned boolean", _each(work), ("image_id",))


def capture_texts(photos: DataFrame, models: Mapping[str, Model | None], charset: list[str], profile: str = "android") -> DataFrame:
    """OCR rows of photos(capture_id, document_type, content, quad array<double> or null): lines, text, confidence, image.

    Rectified by the quad, searched for text lines in reading order; each line is cut out, turned upright and recognised.
    A line's box and text stay together in one struct. Photos are not shuffled. A photo that cannot be read gives its
    error; one whose text search fails has no lines. Needs text_detector, text_direction, text_recogniser and a charset.
    """
    missing = [n for n in REQUIRED[1:] if models.get(n) is None]
    if missing:
        raise ValueError(f"load the models {', '.join(missing)} before photos are read")
    if not charset:
        raise ValueError("the charset is empty; load it before photos are read")
    search, direction, recogniser = (models[n] for n in REQUIRED[1:])

    def upright_image(x: tuple[np.ndarray, list | None]):
        """What rectify() needs no warp for, or the image and its quad."""
        image, quad = x
        if not image.size:
            raise ValueError("the photo has no pixels")
        if quad is None:
            return image
        quad = np.array(quad, float).reshape(4, 2)
        if not np.isfinite(quad).all():
            raise ValueError("the quad is not finite")
        return rectify(image, quad, profile) if profile == "ios" else (image, quad)

    def searched(images: list[np.ndarray]) -> list:
        """What the text search finds in each image, all of one shape, and the scales; or an exception."""
        h, w = images[0].shape[:2]
        tw, th = pixels.text_size(h, w, profile=profile)
        x = pixels.tensors(pixels.bilinear_all(_stacked(images), tw, th))
        return _each(lambda k: (np.asarray(search(x[k : k + 1])[0]).reshape(th, tw), tw / w, th / h))(range(len(images)))

    def text_pixels(key: tuple) -> int:
        w, h = pixels.text_size(*key[:2], profile=profile)
        return w * h

    def in_model(crops: list, size: Callable, model: Model) -> list:
        """The model's output of each crop, brought to the size of its shape in stacks; size gives height and width."""

        def together(own: list[np.ndarray]) -> list:
            x = pixels.tensors(pixels.bilinear_all(_stacked(own), *size(own[0].shape)[::-1]), HALF, HALF)
            return _each(lambda k: np.asarray(model(x[k : k + 1])[0]))(range(len(own)))

        return _alike(crops, lambda c: c.shape, together, lambda k: int(np.prod(size(k))))

    def turned(crops: list) -> list:
        if profile == "ios":
            return _each(lambda c: _raised(c) if isinstance(c, Exception) else turned_upright(c, direction, profile)[0])(crops)
        scores = _each(lambda x: _raised(x) if isinstance(x, Exception) else x.ravel())(in_model(crops, lambda shape: declared_size(direction, 48, 192), direction))
        return [s if isinstance(s, Exception) else np.ascontiguousarray(c[::-1, ::-1]) if len(s) > 1 and bool(s[1] > s[0]) else c for c, s in zip(crops, scores, strict=True)]

    def shares(quads: np.ndarray, sizes: np.ndarray) -> list[list[float]]:
        """x, y, width and height of each quad's part in its image, of the image's size."""
        low, high = (np.clip(x, 0.0, sizes) for x in (quads.min(axis=1), quads.max(axis=1)))
        return np.concatenate([low / sizes, (high - low) / sizes], axis=1).tolist()

    def work(rows: list[dict]) -> list:
        images = _each(lambda row: upright_image((pixels.decode(row["content"]), row["quad"])))(rows)
        some = [i for i, x in enumerate(images) if isinstance(x, tuple)]
        for i, x in zip(some, warped([images[i][0] for i in some], [images[i][1] for i in some]), strict=True):
            images[i] = x
        found = _boxes(_alike(images, lambda x: x.shape, searched, text_pixels), profile)
        at = [(i, quad) for i, quads in enumerate(found) if not isinstance(quads, Exception) for quad in quads]
        crops = warped([images[i] for i, _ in at], [quad for _, quad in at])
        if profile == "ios":
            crops = [c if isinstance(c, Exception) or c.shape[0] < 1.5 * c.shape[1] else np.ascontiguousarray(np.rot90(c)) for c in crops]
        reads = _read_lines(in_model(turned(crops), lambda shape: line_size(shape, recogniser, profile), recogniser))
        boxes = shares(_stacked([quad for _, quad in at]), np.array([images[i].shape[1::-1] for i, _ in at], float)) if at else []
        lines: list = [x if isinstance(x, Exception) else [] for x in images]
        for (i, _), read, box in zip(at, reads, boxes, strict=True):
            if isinstance(read, Exception) or isinstance(lines[i], Exception):
                lines[i] = lines[i] if isinstance(lines[i], Exception) else read
                continue
            lines[i].append((*read, box))
        done = lambda x: _raised(x[1]) if isinstance(x[1], Exception) else (x[1], pixels.encode(x[2]) if x[0]["quad"] is not None else None)
        return _each(done)(list(zip(rows, lines, images, strict=True)))

    line = f"struct<steps:{_BEST},classes:int,x:double,y:double,width:double,height:double>"
    own = _in_batches(photos, f"raw array<{line}>, rectified binary", work, ("capture_id", "document_type"), {"raw": _line_arrays})
    symbols = F.array(*map(F.lit, charset))

    def spelled(r: Column) -> Column:
        read = tensors.collapsed(r["steps"], symbols, r["classes"], profile)
        return F.struct(read["text"].alias("text"), read["confidence"].alias("confidence"), *[r[k].alias(k) for k in ("x", "y", "width", "height")])

    own = own.withColumn("lines", F.transform(F.coalesce("raw", F.array().cast(f"array<{line}>")), spelled)).drop("raw")
    return frames.with_full_text(own.withColumn("lines", frames.readable(F.col("lines"), profile)))
