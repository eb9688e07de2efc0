"""Arrow batch functions over pixel columns.

Pixels are BINARY: row-major, interleaved, 8 bits per sample, colour in the
order of Spark's ``image`` source (blue, green, red[, alpha]).  Images of one
shape inside an Arrow batch are handled by one numpy call.  A row whose byte
count does not fit its shape gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.kernel import kernel

MEASURES = T.StructType([
    T.StructField("var_laplacian", T.DoubleType()), T.StructField("mean_luma", T.DoubleType()),
    T.StructField("dhash", T.LongType()),
])
SCORES = T.StructType([T.StructField("psnr", T.DoubleType()), T.StructField("ssim", T.DoubleType())])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat bytes, start and length of every value of a binary column."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, bounds[:-1].astype(np.int64), np.diff(bounds).astype(np.int64)


def _blocks(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, array (n, h, w, c))`` for each shape present in the batch."""
    flat, start, length = _bytes_of(px)
    dims = np.stack([np.asarray(a.fill_null(0)).astype(np.int64) for a in (h, w, c)], axis=1)
    size = dims.prod(axis=1)
    good = np.asarray(px.is_valid()) & (size > 0) & (length == size)
    rows = np.flatnonzero(good)
    if not len(rows):
        return
    shapes, which = np.unique(dims[rows], axis=0, return_inverse=True)
    for s, (hh, ww, cc) in enumerate(shapes):
        at = rows[which.ravel() == s]
        n = int(hh * ww * cc)
        yield at, flat[start[at][:, None] + np.arange(n)].reshape(len(at), hh, ww, cc)


def gray(block: np.ndarray) -> np.ndarray:
    """Integer luma of blue-green-red samples: (77 R + 150 G + 29 B + 128) div 256."""
    if block.shape[-1] < 3:
        return block[..., 0]
    b, g, r = (block[..., i].astype(np.int32) for i in range(3))
    return ((77 * r + 150 * g + 29 * b + 128) // 256).astype(np.uint8)


def _rounded(v: np.ndarray) -> np.ndarray:
    """Half up; float noise below 1e-9 does not move a tie."""
    return np.floor(np.round(v, 9) + 0.5).astype(np.uint8)


def resized(block: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with half-pixel centres and edge clamping, rounded half up."""
    _, h, w, _ = block.shape
    if (h, w) == (height, width):
        return block

    def taps(n_out: int, n_in: int):
        at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, n_in - 1), at - low

    y0, y1, fy = taps(height, h)
    x0, x1, fx = taps(width, w)
    src = block.astype(np.float64)
    fx = fx[None, None, :, None]
    fy = fy[None, :, None, None]
    top = src[:, y0][:, :, x0] * (1 - fx) + src[:, y0][:, :, x1] * fx
    bottom = src[:, y1][:, :, x0] * (1 - fx) + src[:, y1][:, :, x1] * fx
    return _rounded(top * (1 - fy) + bottom * fy)


def laplacian_variance(g: np.ndarray) -> np.ndarray:
    """Population variance of the 4-neighbour Laplacian over interior pixels."""
    n, h, w = g.shape
    if h < 3 or w < 3:
        return np.zeros(n)
    v = g.astype(np.int64)
    d = v[:, :-2, 1:-1] + v[:, 2:, 1:-1] + v[:, 1:-1, :-2] + v[:, 1:-1, 2:] - 4 * v[:, 1:-1, 1:-1]
    count = (h - 2) * (w - 2)
    mean = d.sum(axis=(1, 2)) / count
    return (d * d).sum(axis=(1, 2)) / count - mean * mean


def difference_hash(g: np.ndarray) -> np.ndarray:
    """64 bits, row by row: 1 where a pixel of the 9x8 thumbnail exceeds its right neighbour."""
    small = resized(g[..., None], 8, 9)[..., 0]
    bits = (small[:, :, :-1] > small[:, :, 1:]).reshape(len(g), 64)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()


def _doubles(n: int) -> np.ndarray:
    return np.full(n, np.nan)


@kernel(MEASURES)
def image_measures(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
    """Sharpness, brightness and hash in one pass, so pixels reach Python once."""
    n = len(px)
    sharp, luma, dhash, seen = _doubles(n), _doubles(n), np.zeros(n, np.int64), np.zeros(n, bool)
    for at, block in _blocks(px, h, w, c):
        g = gray(block)
        sharp[at] = laplacian_variance(g)
        luma[at] = g.sum(axis=(1, 2), dtype=np.int64) / (g.shape[1] * g.shape[2])
        dhash[at] = difference_hash(g)
        seen[at] = True
    absent = pa.array(~seen)
    fields = [pa.array(v, mask=~seen) for v in (sharp, luma, dhash)]
    return pa.StructArray.from_arrays(fields, ["var_laplacian", "mean_luma", "dhash"], mask=absent)


def custom_measure(fn: Callable[[np.ndarray], np.ndarray]):
    """Kernel of a user's own measure.

    ``fn`` takes the images of one shape as an array (n, height, width, channels) and
    returns n numbers; the result is called like the others, on (px, h, w, c).
    """
    @kernel(T.DoubleType())
    def measure(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
        out = np.full(len(px), np.nan)
        for at, block in _blocks(px, h, w, c):
            out[at] = fn(block)
        return pa.array(out, mask=np.isnan(out))
    return measure


def _image_map(change: Callable[..., np.ndarray], px, h, w, c, *args) -> pa.Array:
    """Binary column of ``change(block, *args)``; args are given per shape group."""
    out: list[bytes | None] = [None] * len(px)
    for at, block in _blocks(px, h, w, c):
        for row, image in zip(at, change(block, *args)):
            out[row] = np.ascontiguousarray(image).tobytes()
    return pa.array(out, pa.binary())


@kernel(T.BinaryType())
def gray_pixels(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
    return _image_map(gray, px, h, w, c)


def resize_pixels(px, h, w, c, height: int, width: int):
    """Column of pixels resized to one target size."""
    @kernel(T.BinaryType())
    def resize(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
        return _image_map(resized, px, h, w, c, height, width)
    return resize(px, h, w, c)


@kernel(T.BinaryType())
def flip_horizontal(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
    return _image_map(lambda b: b[:, :, ::-1], px, h, w, c)


@kernel(T.BinaryType())
def flip_vertical(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
    return _image_map(lambda b: b[:, ::-1], px, h, w, c)


@kernel(T.BinaryType())
def flip_both(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
    return _image_map(lambda b: b[:, ::-1, ::-1], px, h, w, c)


def _with_alpha(block: np.ndarray) -> np.ndarray:
    """Four channels; black becomes fully transparent, the rest keeps or gets alpha 255."""
    n, h, w, c = block.shape
    colour = block[..., :3] if c >= 3 else np.repeat(block[..., :1], 3, axis=3)
    alpha = block[..., 3] if c == 4 else np.full((n, h, w), 255, np.uint8)
    alpha = np.where((colour == 0).all(axis=3), 0, alpha).astype(np.uint8)
    return np.concatenate([colour, alpha[..., None]], axis=3)


@kernel(T.BinaryType())
def black_to_transparent(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
    return _image_map(_with_alpha, px, h, w, c)


def _turned(block: np.ndarray, degrees: float, h: int, w: int, x: np.ndarray, y: np.ndarray, first_row: int = 0) -> np.ndarray:
    """Pixels (x, y) of images of h x w turned about their centre; outside stays 0.

    ``block`` holds the images' rows from ``first_row`` on, as many as the pixels need."""
    a = np.deg2rad(degrees)
    s, c = np.sin(a), np.cos(a)
    width, height = int(w * abs(c) + h * abs(s)), int(w * abs(s) + h * abs(c))
    dx, dy = x + 0.5 - width / 2.0, y + 0.5 - height / 2.0
    # Inverse map to source coordinates about the exact centre.
    sx = c * dx + s * dy + w / 2.0 - 0.5
    sy = -s * dx + c * dy + h / 2.0 - 0.5
    sx, sy = np.round(sx, 9), np.round(sy, 9)
    inside = (sx > -0.5 - 1e-9) & (sy > -0.5 - 1e-9) & (sx < w - 0.5) & (sy < h - 0.5)
    cx, cy = np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)
    x0, y0 = np.floor(cx).astype(int), np.floor(cy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (cx - x0)[None, ..., None], (cy - y0)[None, ..., None]
    last = block.shape[1] - 1
    y0, y1 = (np.clip(r - first_row, 0, last) for r in (y0, y1))  # rows left out belong to pixels outside
    src = block.astype(np.float64)
    top = src[:, y0, x0] * (1 - fx) + src[:, y0, x1] * fx
    bottom = src[:, y1, x0] * (1 - fx) + src[:, y1, x1] * fx
    return np.where(inside[None, ..., None], _rounded(top * (1 - fy) + bottom * fy), 0).astype(np.uint8)


def rotate_block(block: np.ndarray, degrees: float) -> np.ndarray:
    """Rotate about the centre into the truncated bounding box; outside stays 0."""
    _, h, w, _ = block.shape
    a = np.deg2rad(degrees)
    s, c = abs(np.sin(a)), abs(np.cos(a))
    yy, xx = np.mgrid[0:int(w * s + h * c), 0:int(w * c + h * s)]
    return _turned(block, degrees, h, w, xx, yy)


@kernel(T.BinaryType())
def rotated_tiles(
    strip: pa.Array, first_row: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array, degrees: pa.Array,
    x: pa.Array, y: pa.Array, tile_w: pa.Array, tile_h: pa.Array,
) -> pa.Array:
    """Pixels of a tile at (x, y) of the turned image, from the strip of source rows below it.
    Tiles that lie alike over strips of one size are made together."""
    where = np.stack([np.asarray(v.cast(pa.float64())) for v in (first_row, h, w, c, degrees, x, y, tile_w, tile_h)], axis=1)
    out: list[bytes | None] = [None] * len(strip)
    order = np.lexsort(where.T)
    cuts = np.flatnonzero((where[order][1:] != where[order][:-1]).any(axis=1)) + 1 if len(order) else []
    for rows in np.split(order, cuts):
        rows = [int(r) for r in rows if strip[int(r)].is_valid]
        if not rows:
            continue
        top, height, width, channels, angle, left, up, tw, th = where[rows[0]].tolist()
        block = np.frombuffer(b"".join(strip[r].as_py() for r in rows), np.uint8).reshape(len(rows), -1, int(width), int(channels))
        yy, xx = np.mgrid[int(up):int(up + th), int(left):int(left + tw)]
        for r, tile in zip(rows, _turned(block, angle, int(height), int(width), xx, yy, int(top))):
            out[r] = tile.tobytes()
    return pa.array(out, pa.binary())


@kernel(T.BinaryType())
def rotate_pixels(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array, degrees: pa.Array) -> pa.Array:
    angle = np.asarray(degrees.cast(pa.float64()))
    out: list[bytes | None] = [None] * len(px)
    for at, block in _blocks(px, h, w, c):
        for a in np.unique(angle[at]):
            part = np.flatnonzero(angle[at] == a)
            for row, image in zip(at[part], rotate_block(block[part], float(a))):
                out[row] = image.tobytes()
    return pa.array(out, pa.binary())


@kernel(T.ArrayType(T.BinaryType()))
def cut_tiles(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array, boxes: pa.Array) -> pa.Array:
    """Pixels of every box of an image; a box is a struct (x, y, w, h) inside it.

    The image is decoded once for all its boxes.  A box outside gives null.
    """
    flat, start, length = _bytes_of(px)
    dims = [np.asarray(a.fill_null(0)) for a in (h, w, c)]
    out = []
    for i, wanted in enumerate(boxes.to_pylist()):
        hh, ww, cc = (int(d[i]) for d in dims)
        if wanted is None or not px[i].is_valid or length[i] != hh * ww * cc:
            out.append(None)
            continue
        image = flat[start[i]:start[i] + length[i]].reshape(hh, ww, cc)
        cut = []
        for b in wanted:
            ok = b["w"] > 0 and b["h"] > 0 and b["x"] >= 0 and b["y"] >= 0 \
                and b["x"] + b["w"] <= ww and b["y"] + b["h"] <= hh
            cut.append(image[b["y"]:b["y"] + b["h"], b["x"]:b["x"] + b["w"]].tobytes() if ok else None)
        out.append(cut)
    return pa.array(out, pa.list_(pa.binary()))


C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _psnr(a: np.ndarray, b: np.ndarray) -> float:
    d = a.astype(np.int64) - b.astype(np.int64)
    total = int((d * d).sum())
    return float("inf") if total == 0 else 10.0 * np.log10(65025.0 / (total / d.size))


def _ssim(a: np.ndarray, b: np.ndarray) -> float | None:
    """One global window with sample variances; undefined for fewer than two pixels."""
    x, y = a.astype(np.float64).ravel(), b.astype(np.float64).ravel()
    n = x.size
    if n < 2:
        return None
    dx, dy = x - x.mean(), y - y.mean()
    vx, vy, cov = (dx * dx).sum() / (n - 1), (dy * dy).sum() / (n - 1), (dx * dy).sum() / (n - 1)
    den = (x.mean() ** 2 + y.mean() ** 2 + C1) * (vx + vy + C2)
    return 1.0 if den == 0 else float((2 * x.mean() * y.mean() + C1) * (2 * cov + C2) / den)


@kernel(SCORES)
def pair_scores(
    pa_: pa.Array, ha: pa.Array, wa: pa.Array, ca: pa.Array,
    pb_: pa.Array, hb: pa.Array, wb: pa.Array, cb: pa.Array,
) -> pa.Array:
    """PSNR over colour and SSIM over gray, both at the common minimum size."""
    first = {int(r): b[k] for at, b in _blocks(pa_, ha, wa, ca) for k, r in enumerate(at)}
    second = {int(r): b[k] for at, b in _blocks(pb_, hb, wb, cb) for k, r in enumerate(at)}
    out = []
    for i in range(len(pa_)):
        a, b = first.get(i), second.get(i)
        if a is None or b is None:
            out.append({"psnr": None, "ssim": None})
            continue
        h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
        ga, gb = (resized(gray(v[None])[..., None], h, w)[0] for v in (a, b))
        ra, rb = (resized(v[None], h, w)[0] for v in (a, b))
        if ra.shape[-1] != rb.shape[-1] or ra.shape[-1] == 4:
            ra, rb = (v[..., :3] if v.shape[-1] >= 3 else np.repeat(v[..., :1], 3, axis=-1) for v in (ra, rb))
        out.append({"psnr": _psnr(ra, rb), "ssim": _ssim(ga, gb)})
    return pa.array(out, pa.struct([("psnr", pa.float64()), ("ssim", pa.float64())]))


def block_differences(images: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of whole 8x8 blocks, one row per gray image."""
    n, h, w = images.shape[0], images.shape[1] // 8 * 8, images.shape[2] // 8 * 8
    d = np.abs(images[:, :h, :w].astype(np.int16) - other[:h, :w].astype(np.int16))
    return d.reshape(n, h // 8, 8, w // 8, 8).sum(axis=(2, 4), dtype=np.int32).reshape(n, -1)


def near_identical(images: np.ndarray, other: np.ndarray, hi: int, lo: int, frac: float) -> np.ndarray:
    """Per image: no block differs by more than ``hi``, at most ``frac`` of them by more than ``lo``."""
    d = block_differences(images, other)
    return (d <= hi).all(axis=1) & ((d > lo).sum(axis=1) <= frac * d.shape[1])


def bytes_from_ints(values):
    """BINARY from an ARRAY of integers 0..255, in the JVM."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
