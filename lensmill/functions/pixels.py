"""Image arithmetic in numpy: buffers to gray, orientation, resampling, quality measures, warps, contours.

Images are uint8 arrays, height x width, or height x width x channels.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

GLARE_LEVEL = 250
WORKING_EDGE, MOTION_EDGE, TEXT_EDGE = 480, 160, 960
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def y_plane(data: bytes, width: int, height: int, stride: int) -> np.ndarray:
    """The luma plane, rows cropped from stride to width; short buffers and strides are errors."""
    if stride < width:
        raise ValueError(f"row stride {stride} is under the width {width}")
    if len(data) < stride * (height - 1) + width:
        raise ValueError(f"buffer of {len(data)} bytes is too short for {width}x{height} at stride {stride}")
    padded = np.frombuffer(data, np.uint8, min(len(data), stride * height))
    full = np.zeros(stride * height, np.uint8)
    full[: len(padded)] = padded
    return full.reshape(height, stride)[:, :width]


def rgb_to_gray(image: np.ndarray, order: str = "RGB") -> np.ndarray:
    r, g, b = (image[..., order.index(c)].astype(np.float64) for c in "RGB")
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint8)


def to_gray(data: bytes, width: int, height: int, stride: int, pixel_format: str) -> np.ndarray:
    """Gray image of an 8-bit YUV or an RGB-like buffer; other formats are errors."""
    if pixel_format in ("yuv", "yuv-420-8-bit-video", "yuv-420-8-bit-full", "nv12", "nv21"):
        return y_plane(data, width, height, stride)
    channels = {"rgb": "RGB", "rgba": "RGBA", "bgra": "BGRA"}.get(pixel_format)
    if channels is None:
        raise ValueError(f"unsupported pixel format {pixel_format}")
    rows = y_plane(data, width * len(channels), height, stride or width * len(channels))
    return rgb_to_gray(rows.reshape(height, width, len(channels)), channels)


def bgr_of(data: bytes, width: int, height: int, stride: int, pixel_format: str, roi: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """BGR image of a buffer, cropped to roi (x, y, w, h); empty for an unsupported format."""
    channels = {"rgb": "RGB", "rgba": "RGBA", "bgra": "BGRA"}.get(pixel_format)
    if channels:
        rows = y_plane(data, width * len(channels), height, stride or width * len(channels)).reshape(height, width, len(channels))
        out = rows[..., [channels.index(c) for c in "BGR"]]
    elif pixel_format == "nv12":
        luma = y_plane(data, width, height, stride).astype(np.float64)
        chroma = np.frombuffer(data, np.uint8, offset=stride * height)[: stride * (height // 2)].reshape(height // 2, stride)[:, :width]
        u, v = (np.repeat(np.repeat(chroma[:, k::2], 2, 0), 2, 1)[:height, :width].astype(np.float64) - 128 for k in (0, 1))
        parts = (luma + 1.772 * u, luma - 0.344136 * u - 0.714136 * v, luma + 1.402 * v)
        out = np.clip(np.round(np.stack(parts, axis=-1)), 0, 255).astype(np.uint8)
    else:
        return np.zeros((0, 0, 3), np.uint8)
    if roi:
        x, y, w, h = roi
        out = out[max(0, y) : y + h, max(0, x) : x + w]
    return np.ascontiguousarray(out)


def oriented(image: np.ndarray, orientation: str, mirrored: bool) -> np.ndarray:
    """Mirrors pixels, then turns them upright."""
    out = image[:, ::-1] if mirrored else image
    turns = {"up": 0, "right": 3, "down": 2, "left": 1}[orientation]
    return np.ascontiguousarray(np.rot90(out, turns))


def _overlaps(n: int, m: int) -> np.ndarray:
    """m x n weights that average n cells into m by area."""
    edges = np.linspace(0, n, m + 1)
    low = np.maximum(edges[:-1, None], np.arange(n)[None])
    high = np.minimum(edges[1:, None], np.arange(1, n + 1)[None])
    weights = np.maximum(0, high - low)
    return weights / weights.sum(axis=1, keepdims=True)


def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    out = np.tensordot(_overlaps(image.shape[0], height), image.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(_overlaps(image.shape[1], width), out, (1, 1)), 0, 1)
    return np.floor(out + 0.5).astype(np.uint8)


def downscale(image: np.ndarray, edge: int = WORKING_EDGE) -> np.ndarray:
    """Long edge at most ``edge``, aspect kept; smaller images stay."""
    h, w = image.shape[:2]
    scale = edge / max(h, w)
    return image if scale >= 1 else area_resize(image, max(1, round(w * scale)), max(1, round(h * scale)))


def squash(image: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """Square resize without aspect, and its scales."""
    h, w = image.shape[:2]
    return bilinear(image, size, size), size / w, size / h


@lru_cache(256)
def _steps(n: int, m: int, across: int) -> tuple[np.ndarray, ...]:
    """For each of m cells the two of n cells that it lies between, and their shares, repeated ``across`` times as a plain array."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    share = at - low
    return low, np.minimum(low + 1, n - 1), *(np.ascontiguousarray(np.repeat(x[:, None], across, axis=1)) for x in (1 - share, share))


def _between(cells: np.ndarray, m: int) -> np.ndarray:
    """The rows of a two-dimensional array, resized to m rows."""
    low, high, rest, share = _steps(len(cells), m, cells.shape[1])
    out, other = np.take(cells, low, 0), np.take(cells, high, 0)
    out *= rest
    other *= share
    out += other
    return out


def bilinear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize, edges repeated: rows first, then columns."""
    return bilinear_all(image[None], width, height)[0]


#: Sides of gray images that are resized by whole numbers, and what those stay under, as floats hold them all.
SMALL_SIDE, WHOLE_FLOATS = 64, 1 << 24


def _plain_steps(n: int, m: int) -> tuple[np.ndarray, ...]:
    return tuple(a.reshape(m) for a in _steps(n, m, 1))


@lru_cache(256)
def _whole_steps(n: int, m: int) -> np.ndarray:
    """m x n weights of _steps() times 2 m, which are whole numbers."""
    at = np.clip((2 * np.arange(m) + 1) * n - m, 0, (n - 1) * 2 * m)
    low, share = np.divmod(at, 2 * m)
    out = np.zeros((m, n), np.float32)
    out[np.arange(m), low] = 2 * m - share
    out[np.arange(m), np.minimum(low + 1, n - 1)] += share
    return out


def _bilinear_small(images: np.ndarray, width: int, height: int) -> np.ndarray:
    """bilinear_all() of small gray images as a product of whole numbers, exact in any order.

    Only where a value lies right between two others do the roundings of _between() decide, so those go its way.
    """
    n, h, w = images.shape
    rows = _whole_steps(h, height) @ images.astype(np.float32)
    own = (rows.reshape(-1, w) @ _whole_steps(w, width).T).reshape(n, height, width)
    own /= 4 * width * height
    own += 0.5
    whole = np.floor(own)
    out = whole.astype(np.uint8)
    between = own == whole
    if between.any():
        between = np.flatnonzero(between.ravel())
        at = between // width
        x, i = between - at * width, at // height
        y = at - i * height
        y0, y1, up, down = (a[y] for a in _plain_steps(h, height))
        x0, x1, left, right = (a[x] for a in _plain_steps(w, width))
        cells, top, low = images.ravel(), (i * h + y0) * w, (i * h + y1) * w
        column = lambda c: cells[top + c] * up + cells[low + c] * down
        out.ravel()[between] = (column(x0) * left + column(x1) * right + 0.5).astype(np.uint8)
    return out


def bilinear_all(images: np.ndarray, width: int, height: int) -> np.ndarray:
    """bilinear() of a stack of images of one size."""
    n, h, w = images.shape[:3]
    deep = images.shape[3:]
    if images.dtype == np.uint8 and not deep and 0 < min(h, w) and max(h, w) <= SMALL_SIDE and 255 * 4 * width * height < WHOLE_FLOATS:
        return _bilinear_small(images, width, height)
    # The axis that is resized comes first, so that whole rows are copied.
    rows = np.ascontiguousarray(np.moveaxis(images, 1, 0).astype(np.float64)).reshape(h, -1)
    rows = _between(rows, height).reshape(height, n, w, *deep)
    out = _between(np.ascontiguousarray(np.moveaxis(rows, 2, 0)).reshape(w, -1), width)
    out += 0.5
    return np.ascontiguousarray(out.astype(np.uint8).reshape(width, height, n, *deep).swapaxes(0, 2))


def sample(image: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Bilinear samples, edges repeated."""
    return sample_all(image[None], xs[None], ys[None])[0]


def sample_all(images: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """sample() of each of a stack of images at its own places."""
    h, w = images.shape[1:3]
    xs, ys = np.clip(xs, 0, w - 1), np.clip(ys, 0, h - 1)
    x0, y0 = np.floor(xs).astype(int), np.floor(ys).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = xs - x0, ys - y0
    cells = images.reshape(-1, *images.shape[3:])
    if images.ndim == 4:
        fx, fy = fx[..., None], fy[..., None]
    own = (np.arange(len(images)) * (h * w)).reshape(-1, *[1] * (xs.ndim - 1))
    y0, y1 = own + y0 * w, own + y1 * w
    top = cells[y0 + x0] * (1 - fx) + cells[y0 + x1] * fx
    low = cells[y1 + x0] * (1 - fx) + cells[y1 + x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def tensor(image: np.ndarray, mean=IMAGENET_MEAN, std=IMAGENET_STD, raw: bool = False) -> np.ndarray:
    """1 x C x H x W floats: (value / 255 - mean) / std, or the raw values."""
    return tensors(image[None], mean, std, raw)


def tensors(images: np.ndarray, mean=IMAGENET_MEAN, std=IMAGENET_STD, raw: bool = False) -> np.ndarray:
    """tensor() of each of a stack of images of one size, N x C x H x W."""
    x = images.astype(np.float32)
    if x.ndim == 3 and not raw and len(set(mean)) == len(set(std)) == 1:
        # Gray of which all channels are equal is worked out once.
        x /= 255
        x -= np.float32(mean[0])
        out = np.empty((len(x), 3, *x.shape[1:]), np.float32)
        np.divide(x, np.float32(std[0]), out=out[:, 0])
        out[:, 1:] = out[:, :1]
        return out
    planes = x.transpose(0, 3, 1, 2) if x.ndim == 4 else np.broadcast_to(x[:, None], (len(x), 3, *x.shape[1:]))
    if raw:
        return np.ascontiguousarray(planes)
    x /= 255
    of = lambda v: np.asarray(v, np.float32).reshape(-1, 1, 1)
    out = np.empty(planes.shape, np.float32)
    np.subtract(planes, of(mean), out=out)
    return np.divide(out, of(std), out=out)


def text_size(h: int, w: int, limit: int = TEXT_EDGE, profile: str = "android") -> tuple[int, int]:
    """Width and height of the text search's input: sides capped and brought to multiples of 32 (android up, ios to the nearest)."""
    scale = min(1.0, limit / max(h, w))
    fit = lambda n: max(32, (int(n * scale) + 31) // 32 * 32 if profile == "android" else int(n * scale / 32 + 0.5) * 32)
    return fit(w), fit(h)


def text_input(image: np.ndarray, limit: int = TEXT_EDGE, profile: str = "android") -> tuple[np.ndarray, float, float]:
    """The image at text_size(), and the scales."""
    h, w = image.shape[:2]
    tw, th = text_size(h, w, limit, profile)
    return bilinear(image, tw, th), tw / w, th / h


def laplacian_variance(gray: np.ndarray) -> np.ndarray:
    """Population variance of the 4-neighbour Laplacian of an image or of each of a stack, borders mirrored without the edge."""
    around = [(0, 0)] * (gray.ndim - 2) + [(1, 1), (1, 1)]
    p = np.pad(gray.astype(np.int32), around, mode="reflect" if min(gray.shape[-2:]) > 1 else "edge")
    return (p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * p[..., 1:-1, 1:-1]).var(axis=(-2, -1))


def brightness(gray: np.ndarray) -> np.ndarray:
    return gray.mean(axis=(-2, -1)) if gray.size else np.zeros(gray.shape[:-2])


def glare_ratio(gray: np.ndarray) -> np.ndarray:
    return (gray > GLARE_LEVEL).mean(axis=(-2, -1)) if gray.size else np.zeros(gray.shape[:-2])


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """3x3 matrix that takes four source points to four target points."""
    return homographies(np.asarray(source, float), np.asarray(target, float)[None])[0]


def homographies(source: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """homography() of the same source points to each of several targets (N x 4 x 2)."""
    m = np.zeros((len(targets), 8, 8))
    m[:, 0::2, 0:2] = m[:, 1::2, 3:5] = source
    m[:, 0::2, 2] = m[:, 1::2, 5] = 1
    m[:, 0::2, 6:] = -targets[..., :1] * source
    m[:, 1::2, 6:] = -targets[..., 1:] * source
    found = np.linalg.solve(m, targets.reshape(-1, 8, 1))[..., 0]
    return np.concatenate([found, np.ones((len(targets), 1))], axis=1).reshape(-1, 3, 3)


def warp_sizes(quads: np.ndarray) -> np.ndarray:
    """Width and height of each quad's rectangle (N x 4 x 2): the longer of its opposite edges."""
    edge = np.hypot(*np.moveaxis(quads - np.roll(quads, -1, axis=1), 2, 0))
    return np.maximum(1, np.rint(np.maximum(edge[:, :2], edge[:, 2:]))).astype(int)


def warp(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quad (4 points, clockwise from top left) as an upright rectangle as large as its longer opposite edges."""
    q = np.asarray(quad, float)[None]
    return warp_all(image[None], q, *warp_sizes(q)[0].tolist())[0]


def warp_all(images: np.ndarray, quads: np.ndarray, w: int, h: int) -> np.ndarray:
    """warp() of each of a stack of images by its own quad, all of one size before and of w x h after."""
    r, b = (w - 1, h - 1) if min(w, h) > 1 else (w, h)
    back = homographies(np.array([[0, 0], [r, 0], [r, b], [0, b]], float), quads)
    xs, ys = np.arange(w)[None, None], np.arange(h)[None, :, None]
    of = lambda k: back[:, k, 0, None, None] * xs + back[:, k, 1, None, None] * ys + back[:, k, 2, None, None]
    d = of(2)
    return sample_all(images, of(0) / d, of(1) / d)


def text_crop(image: np.ndarray, quad: np.ndarray, profile: str = "android") -> np.ndarray:
    """A line's crop; on ios one of at least 1.5 times its width in height is turned by 90 degrees."""
    out = warp(image, quad)
    return np.ascontiguousarray(np.rot90(out)) if profile == "ios" and out.shape[0] >= 1.5 * out.shape[1] else out


def runs_of(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """First and end place of each run of a mask's rows, its component and how many there are; a place is row * (width + 1) + column.

    Components are numbered from 1 in order of their first pixel. Runs of neighbouring rows are joined where they touch.
    """
    h, w = mask.shape
    turns = np.zeros(h * (w + 1) + 1, np.int8)
    turns[1:].reshape(h, w + 1)[:, :w] = mask
    turns = np.diff(turns)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    near, own = int(diagonal), np.arange(len(starts))
    # The runs of the row above that touch a run are neighbours in order, from ``above`` on.
    above = np.searchsorted(ends, starts - w - 1 - near, "right")
    n = np.maximum(np.minimum(np.searchsorted(starts, ends - w - 1 + near, "left"), own) - above, 0)
    low, high = _counted(above, n), np.repeat(own, n)
    while (own[low] != own[high]).any():
        a, b = own[low], own[high]
        np.minimum.at(own, np.maximum(a, b), np.minimum(a, b))
        while (own != own[own]).any():
            own = own[own]
    roots, number = np.unique(own, return_inverse=True)
    return starts, ends, number + 1, len(roots)


def _counted(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n whole numbers from each first on, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def labels_of(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Connected components of a mask, numbered from 1 in order of their first pixel, and how many there are."""
    starts, ends, own, n = runs_of(mask, diagonal)
    return _filled(mask, starts, ends, own), n


def _filled(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = np.zeros(mask.shape, int)
    out[mask] = np.repeat(own, ends - starts)
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the leftmost point."""
    return hulls(np.asarray(points, float), np.zeros(len(points), int))[0]


def hulls(points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hull() of each of several sets of points, and whose each corner is; ``own`` numbers the sets, in order."""
    if points.dtype.kind == "i":
        # Pixels go by one number each, which is sorted much faster.
        least = points.min(axis=0)
        across, down = (points.max(axis=0) - least + 1).tolist()
        at, y = np.divmod(np.sort((own * across + points[:, 0] - least[0]) * down + points[:, 1] - least[1]), down)
        own, x = np.divmod(at, across)
        p = np.stack([x, y], axis=1) + least
    else:
        order = np.lexsort((points[:, 1], points[:, 0], own))
        p, own = points[order], own[order]
    # Only the ends of each column can be corners: the lower ones from left to right, then the upper ones back.
    new = np.append(True, (own[1:] != own[:-1]) | (p[1:, 0] != p[:-1, 0]))
    low, high = p[new], p[np.append(new[1:], True)]
    own = own[new]
    columns = np.bincount(own)[own]
    first = np.searchsorted(own, own)
    at, back = np.arange(len(own)) + first, 3 * first + 2 * columns - 1 - np.arange(len(own))
    p, all_own = np.empty((2 * len(own), 2), points.dtype), np.empty(2 * len(own), int)
    p[at], p[back], all_own[at], all_own[back] = low, high, own, own
    # The first point and the last one are corners, even of a line; a column of one point at either end counts once.
    left, right = np.arange(len(own)) == first, np.arange(len(own)) == first + columns - 1
    ends, single = np.zeros(len(p), bool), (low == high).all(axis=1)
    ends[at[left]] = ends[at[right & single]] = ends[back[right & ~single]] = True
    keep = np.ones(len(p), bool)
    keep[back[(left | right) & single]] = False
    p, own, ends = p[keep], all_own[keep], ends[keep]
    while True:
        new = np.append(True, own[1:] != own[:-1])
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(own)) - 1
        before, after = np.arange(len(own)) - 1, np.arange(len(own)) + 1
        before[start], after[last] = last, start
        a, b = p - p[before], p[after] - p
        # A point that does not turn left between two others of its set is no corner, whatever becomes of those.
        keep = ends | (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] > 0)
        if keep.all():
            return p, own
        p, own, ends = p[keep], own[keep], ends[keep]


def polygon_area(p: np.ndarray) -> float:
    return float(polygon_areas(p, np.zeros(1, int))[0]) if len(p) > 2 else 0.0


def bends(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of several outlines, n of each, without those between two others on a straight line, and how many each keeps."""
    end = np.cumsum(n)
    first, last, own = end - n, end - 1, np.repeat(np.arange(len(n)), n)
    step = np.empty_like(p)
    step[:-1], step[last] = p[1:] - p[:-1], p[first] - p[last]
    keep = np.empty(len(p), bool)
    keep[1:], keep[first] = (step[1:] != step[:-1]).any(axis=1), (step[first] != step[last]).any(axis=1) | (n == 1)
    return p[keep], np.bincount(own[keep], minlength=len(n))


def polygon_areas(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Area of each of several closed lines, one after the other, that begin at the places ``first``."""
    after = np.arange(1, len(p) + 1)
    after[np.append(first[1:], len(p)) - 1] = first
    q = p[after]
    return np.abs(np.add.reduceat(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], first)) / 2


def _framed(mask: np.ndarray) -> np.ndarray:
    """A mask with a border of one pixel that is not in it."""
    out = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), bool)
    out[1:-1, 1:-1] = mask
    return out


def _first_turns() -> np.ndarray:
    """The direction to go for each heading and set of neighbours (bits of the eight directions), -1 where there is none."""
    # The pixel walked from lies at heading + 4: the next one clockwise from there keeps the outside to the left.
    return np.array([[next((d % 8 for d in range(k + 5, k + 13) if bits >> d % 8 & 1), -1) for bits in range(256)] for k in range(8)], np.int8).ravel()


_TURNS = _first_turns()
#: Outlines that are walked together at least; fewer are walked one after the other.
WALKED = 8


def _walked(cells: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Border pixels of several regions of a framed mask, and how many are whose: each is walked clockwise from its first
    pixel until the first step comes again. Pixels are places in the flattened mask; regions must not touch."""
    w = cells.shape[1]
    steps = np.array([1, w + 1, w, w - 1, -1, -w - 1, -w, 1 - w])
    flat, near = cells.ravel().view(np.uint8), np.zeros(cells.size, np.uint8)
    for d, step in enumerate(steps.tolist()):
        own = near[w + 1 : -w - 1]
        own |= flat[w + 1 + step : cells.size - w - 1 + step] << d
    at, who, heading = starts, np.arange(len(starts)), np.zeros(len(starts), int)
    first, begun, found, whose = None, starts, [], []
    while len(who) >= WALKED:
        turn = _TURNS[heading * 256 + near[at]]
        done = turn < 0 if first is None else (at == begun) & (turn == first)
        if first is None:
            first = turn
        if done.any():
            go = ~done
            at, who, turn, first, begun = at[go], who[go], turn[go], first[go], begun[go]
        found.append(at)
        whose.append(who)
        heading = turn.astype(int)
        at = at + steps[heading]
    if len(who):
        bits, turns, steps = near.tobytes(), _TURNS.tolist(), steps.tolist()
        known = [-2] * len(who) if first is None else first.tolist()
        for i, place, k, start, turn in zip(who.tolist(), at.tolist(), heading.tolist(), begun.tolist(), known, strict=True):
            line = []
            while (d := turns[k * 256 + bits[place]]) >= 0 and not (place == start and d == turn):
                line.append(place)
                turn = d if turn == -2 else turn
                k, place = d, place + steps[d]
            found.append(np.array(line, int))
            whose.append(np.full(len(line), i))
    at, who = np.concatenate([starts[:0], *found]), np.concatenate([starts[:0], *whose])
    alone = np.flatnonzero(np.bincount(who, minlength=len(starts)) == 0)
    at, who = np.append(at, starts[alone]), np.append(who, alone)
    return at[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(starts))


def outline(region: np.ndarray) -> np.ndarray:
    """Border pixels (x, y) of a connected region, walked clockwise until the first step comes again."""
    m = _framed(region)
    at = _walked(m, np.flatnonzero(m)[:1])[0]
    return np.stack([at % m.shape[1] - 1, at // m.shape[1] - 1], axis=1)


def outlines(mask: np.ndarray, least: float = 0.0, holes: bool = True) -> list[np.ndarray]:
    """Outlines of a mask's components and of the holes in them, which run over the pixels around the hole.

    Those whose bounding box is smaller than ``least`` are left out, as no area in them can reach it.
    """
    points, n, _ = outlines_all(mask[None], least)
    return np.split(points, np.cumsum(n)[:-1])[: len(n)] + (hole_outlines(mask, least) if holes else [])


def outlines_all(masks: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outlines of the components of each of a stack of masks: their points one after the other, how many each has, its mask."""
    k, h, w = masks.shape
    cells = np.zeros((k, h + 2, w + 2), bool)
    cells[:, 1:-1, 1:-1] = masks
    cells = cells.reshape(-1, w + 2)
    starts, ends, label, n = runs_of(cells)
    ys, xs = np.divmod(starts, w + 3)
    # Runs come row by row, so a component's first one holds its first pixel.
    first = np.searchsorted(np.maximum.accumulate(label), np.arange(1, n + 1))
    bottom, left, right = np.zeros(n, int), np.full(n, w + 2), np.zeros(n, int)
    np.maximum.at(bottom, label - 1, ys)
    np.minimum.at(left, label - 1, xs)
    np.maximum.at(right, label - 1, xs + ends - starts - 1)
    first = first[(bottom - ys[first]) * (right - left) >= least]
    at, n = _walked(cells, ys[first] * (w + 2) + xs[first])
    return np.stack([at % (w + 2) - 1, at // (w + 2) % (h + 2) - 1], axis=1), n, ys[first] // (h + 2)


def hole_outlines(mask: np.ndarray, least: float = 0.0) -> list[np.ndarray]:
    """Outlines around the holes of a mask; see outlines()."""
    h, w = mask.shape
    starts, ends, label, n = runs_of(~mask, diagonal=False)
    numbered = _filled(~mask, starts, ends, label)
    ys, xs = np.divmod(starts, w + 1)
    bounds: list[list[int]] = [[h, w, 0, 0] for _ in range(n + 1)]
    for i, y, x, x1 in zip(label.tolist(), ys.tolist(), xs.tolist(), (xs + ends - starts - 1).tolist(), strict=True):
        b = bounds[i]
        b[:] = min(b[0], y), min(b[1], x), max(b[2], y), max(b[3], x1)
    out = []
    for i in range(1, n + 1):
        top, left, bottom, right = (v + k for v, k in zip(bounds[i], (-1, -1, 1, 1), strict=True))
        if top < 0 or left < 0 or bottom == h or right == w or (bottom - top) * (right - left) < least:
            continue  # no hole, but the open background, or too small
        p = np.pad(numbered[top : bottom + 1, left : right + 1] == i, 1)
        out.append(outline(p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]) + [left, top])
    return out


def simplified(p: np.ndarray, share: float = 0.02) -> np.ndarray:
    """Corners of a closed line: it is split where it is farthest from its chords, beyond share of its length; then corners
    that close to their neighbours' line go."""
    p = np.asarray(p, float)
    reach = share * np.hypot(*(p - np.roll(p, -1, axis=0)).T).sum()

    def off(q, a, b):
        d = b - a
        base = np.hypot(*d)
        return np.hypot(*(q - a).T) if base < 1e-12 else np.abs(d[0] * (a[1] - q[:, 1]) - (a[0] - q[:, 0]) * d[1]) / base

    far = int(np.hypot(*(p - p[0]).T).argmax())
    start = int(np.hypot(*(p - p[far]).T).argmax())
    p = np.roll(p, -start, axis=0)
    far = (far - start) % len(p)
    closed = np.concatenate([p, p[:1]])
    keep, todo = {0, far}, [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            away = off(closed[a + 1 : b], closed[a], closed[b])
            if away.max() > reach:
                at = a + 1 + int(away.argmax())
                keep.add(at)
                todo += [(a, at), (at, b)]
    p = p[sorted(keep)]
    while len(p) > 3:
        away = np.array([off(p[i : i + 1], p[i - 1], p[(i + 1) % len(p)])[0] for i in range(len(p))])
        if away.min() > reach:
            break
        p = np.delete(p, away.argmin(), axis=0)
    return p


def is_convex(p: np.ndarray) -> bool:
    """Whether a closed line turns one way only."""
    a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    turn = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    return bool((turn > 0).all() or (turn < 0).all())


def ordered(points: np.ndarray) -> np.ndarray:
    return ordered_all(points[None])[0]


def ordered_all(quads: np.ndarray) -> np.ndarray:
    """ordered() of each of a stack of quads."""
    total, slope = quads.sum(axis=2), quads[..., 1] - quads[..., 0]
    at = np.stack([total.argmin(axis=1), slope.argmin(axis=1), total.argmax(axis=1), slope.argmax(axis=1)], axis=1)
    return np.take_along_axis(quads, at[..., None], axis=1)


def edges(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """5x5 binomial blur, Sobel gradient thinned along its direction, two thresholds joined where they touch."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    p = np.pad(gray.astype(float), 2, mode="edge")
    blurred = sum(k[i] * p[i : i + gray.shape[0]] for i in range(5))
    blurred = sum(k[i] * blurred[:, i : i + gray.shape[1]] for i in range(5))
    q = np.pad(blurred, 1, mode="edge")
    gx = q[:-2, 2:] + 2 * q[1:-1, 2:] + q[2:, 2:] - q[:-2, :-2] - 2 * q[1:-1, :-2] - q[2:, :-2]
    gy = q[2:, :-2] + 2 * q[2:, 1:-1] + q[2:, 2:] - q[:-2, :-2] - 2 * q[:-2, 1:-1] - q[:-2, 2:]
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    sector = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    h, w = gray.shape
    at = lambda dy, dx: m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    thin = np.zeros(gray.shape, bool)
    for s, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        thin |= (sector == s) & (size >= at(dy, dx)) & (size > at(-dy, -dx))
    weak, strong = thin & (size > low), thin & (size > high)
    numbered, n = labels_of(weak)
    keep = np.zeros(n + 1, bool)
    keep[np.unique(numbered[strong])] = True
    keep[0] = False
    return keep[numbered]


def dilated(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return np.logical_or.reduce([p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]] for dy in range(3) for dx in range(3)])


def contour_quad(gray: np.ndarray, profile: str = "android") -> tuple[np.ndarray, float] | None:
    """Largest convex four-cornered outline and its confidence, None if there is none."""
    low, high = (75, 200) if profile == "android" else (50, 150)
    frame, best = gray.size, None
    for line in outlines(dilated(edges(gray, low, high)), least=0.1 * gray.size):
        area = polygon_area(line)
        if area < 0.1 * frame or (profile == "ios" and area > 0.98 * frame) or (best is not None and area <= best[1]):
            continue
        corners = simplified(line)
        if len(corners) == 4 and is_convex(corners):
            best = (corners, area)
    if best is None:
        return None
    q = ordered(best[0])
    off = 0.0
    for i in range(4):
        a, b = q[i - 1] - q[i], q[(i + 1) % 4] - q[i]
        length = np.hypot(*a) * np.hypot(*b)
        off = max(off, abs(np.degrees(np.arccos(np.clip(a @ b / length, -1, 1))) - 90)) if length else off
    angle, share = max(0.0, 1 - off / 45), best[1] / frame
    if profile == "android":
        return q, 0.5 * min(1.0, share / 0.5) + 0.5 * angle
    return q, 0.5 * angle + 0.5 * (1 - min(1.0, abs(share - 0.55) / 0.55))


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, size and angle (radians) of the rectangle of least area around the points."""
    center, size, angle = least_rectangles(np.asarray(points), np.zeros(len(points), int))
    return center[0], size[0], float(angle[0])


def _turned_by(angles: np.ndarray) -> np.ndarray:
    """Matrices that turn points by the angles."""
    c, s = np.cos(angles), np.sin(angles)
    return np.stack([np.stack([c, -s], axis=-1), np.stack([s, c], axis=-1)], axis=-2)


def least_rectangles(points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """least_rectangle() of each of several sets of points; ``own`` numbers the sets from 0, in order, none left out."""
    corners, own = hulls(points, own)
    corners = corners.astype(float)
    n = np.bincount(own)
    center, size, angle = np.empty((len(n), 2)), np.empty((len(n), 2)), np.zeros(len(n))
    for m in np.unique(n).tolist():
        some = np.flatnonzero(n == m)
        h = corners[(n == m)[own]].reshape(-1, m, 2)
        if m < 3:
            lo, hi = h.min(axis=1), h.max(axis=1)
            center[some], size[some] = (lo + hi) / 2, hi - lo
            continue
        edge = np.roll(h, -1, axis=1) - h
        angles = np.sort(np.arctan2(edge[..., 1], edge[..., 0]) % (np.pi / 2), axis=1)
        turns = _turned_by(-angles)
        turned = h[:, None] @ turns.swapaxes(2, 3)
        lo, hi = turned.min(axis=2), turned.max(axis=2)
        best = np.arange(len(some)), np.prod(hi - lo, axis=2).argmin(axis=1)
        center[some] = (turns[best].swapaxes(1, 2) @ ((lo[best] + hi[best]) / 2)[..., None])[..., 0]
        size[some], angle[some] = (hi - lo)[best], angles[best]
    return center, size, angle


def text_boxes(prob: np.ndarray, scale_x: float, scale_y: float, profile: str = "android") -> list[np.ndarray]:
    """Quads of text lines in reading order: mask, components, least rectangles grown by a ratio, scaled back."""
    return text_boxes_all(prob[None], scale_x, scale_y, profile)[0]


def text_boxes_all(probs: np.ndarray, scale_x: float, scale_y: float, profile: str = "android") -> list[list[np.ndarray]]:
    """text_boxes() of each of a stack of maps of one size."""
    grow, least = (1.6, 16) if profile == "android" else (1.5, 4)
    masks, scale = probs > 0.3, np.array([scale_x, scale_y])
    points, n, own = outlines_all(masks, least)
    if profile == "ios":
        holes = [(i, line) for i, mask in enumerate(masks) for line in hole_outlines(mask, least)]
        points = np.concatenate([points, *[line for _, line in holes]])
        n, own = np.append(n, [len(line) for _, line in holes]).astype(int), np.append(own, [i for i, _ in holes]).astype(int)
    out: list[list[np.ndarray]] = [[] for _ in masks]
    # Neither an area nor a hull needs the others.
    points, n = bends(points, n)
    large = polygon_areas(points, np.cumsum(n) - n) >= least if len(n) else n > 0
    if not large.any():
        return out
    points, n, own = points[np.repeat(large, n)], n[large], own[large]
    center, size, angle = least_rectangles(points, np.repeat(np.arange(len(n)), n))
    half = size * grow / 2
    corners = center[:, None] + (np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * half[:, None]) @ _turned_by(angle).swapaxes(1, 2)
    quads = ordered_all(corners / scale)
    wide = (size * grow / scale).min(axis=1) >= 4 if profile == "ios" else np.ones(len(n), bool)
    for i in np.lexsort((quads[:, 0, 0], quads[..., 1].mean(axis=1), own)).tolist():
        if wide[i]:
            out[own[i]].append(quads[i])
    return out


#: Magic, width, height and greatest value of a PGM or PPM file, and the one byte before its pixels.
_NETPBM = re.compile(rb"P[56]\s*(\S+)\s+(\S+)\s+(\S+)(?:\s|\Z)")


def netpbm(content: bytes) -> np.ndarray:
    """Image of a PGM or PPM file."""
    if content[:2] not in (b"P5", b"P6"):
        raise ValueError("neither PGM nor PPM")
    head = _NETPBM.match(content)
    if head is None:
        raise ValueError("the head of this PGM or PPM is cut off")
    w, h, _ = map(int, head.groups())
    shape = (h, w) if content[1:2] == b"5" else (h, w, 3)
    return np.frombuffer(content, np.uint8, math.prod(shape), head.end()).reshape(shape)


def by_pillow(content: bytes) -> np.ndarray:
    """Image of a format that Pillow knows, turned upright as its metadata says."""
    import io

    try:
        from PIL import Image, ImageOps
    except ImportError as e:
        raise ValueError("this image format needs Pillow") from e
    return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB"))


def decode(content: bytes, decoders=(netpbm, by_pillow)) -> np.ndarray:
    """Image of an encoded file by the first decoder that reads it; an error of all of them if none does."""
    failed = []
    for read in decoders:
        try:
            return read(content)
        except Exception as e:
            failed.append(f"{read.__name__}: {e}")
    raise ValueError("no decoder reads this image: " + "; ".join(failed))


@lru_cache(1)
def _pillow():
    """Pillow's Image, or None; a failed import is not tried again for every image."""
    try:
        from PIL import Image
    except ImportError:
        return None
    return Image


def encode(image: np.ndarray, quality: int = 92) -> bytes:
    """JPEG by Pillow where it is installed, else PGM or PPM."""
    pillow = _pillow()
    if pillow is None:
        kind = b"P5" if image.ndim == 2 else b"P6"
        return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()
    import io

    out = io.BytesIO()
    pillow.fromarray(image).save(out, "JPEG", quality=quality)
    return out.getvalue()
