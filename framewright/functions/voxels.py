"""Arrow batch functions over slice columns (``ARRAY<DOUBLE>`` voxels).

Planes and strips travel packed as BINARY, many slices of a volume together, so that a
shuffle moves few rows and voxels in the narrowest type that holds them exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from framewright.functions.kernel import kernel

# Bytes of planes or slices that a task holds before it sends them on.
HELD_BYTES = 32 << 20
# Cells of one Arrow batch of a result.
BATCH_CELLS = 1 << 18

CONTENT = T.StructType([T.StructField("stddev", T.DoubleType()), T.StructField("dark_share", T.DoubleType())])


def normalised(v: np.ndarray) -> np.ndarray:
    """Min-max to [0, 1] over finite voxels; constant, empty or non-finite gives 0.5."""
    finite = np.isfinite(v)
    if not finite.any():
        return np.full(v.shape, 0.5)
    low, high = v[finite].min(), v[finite].max()
    if high == low:
        return np.full(v.shape, 0.5)
    return np.where(finite, (np.where(finite, v, low) - low) / (high - low), 0.5)


def quantised(v: np.ndarray) -> np.ndarray:
    """[0, 1] to 0..255 by truncation."""
    return np.clip((v * 255).astype(np.int64), 0, 255).astype(np.uint8)


def _rows(vox: pa.Array):
    values = np.asarray(vox.flatten().cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(np.asarray(vox.value_lengths().fill_null(0)))
    return zip(np.asarray(vox.is_valid()), np.split(values, ends[:-1])) if len(vox) else ()


def _lists(rows: list[np.ndarray], null: list[bool] | None = None) -> pa.ListArray:
    """Rows of doubles as one list array, no Python number made."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    values = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float64()), mask=None if null is None else pa.array(null, pa.bool_()))


@kernel(T.ArrayType(T.DoubleType()))
def normalised_voxels(vox: pa.Array) -> pa.Array:
    rows = list(_rows(vox))
    return _lists([normalised(v) if ok else v[:0] for ok, v in rows], [not ok for ok, _ in rows])


@kernel(T.BinaryType())
def slice_pixels(vox: pa.Array) -> pa.Array:
    """8-bit gray pixels of a slice: normalised, then quantised."""
    return pa.array([quantised(normalised(v)).tobytes() if ok else None for ok, v in _rows(vox)], pa.binary())


@kernel(CONTENT)
def gray_content(px: pa.Array, dark_level: pa.Array) -> pa.Array:
    """Population deviation and share of pixels below the dark level."""
    out = []
    for p, level in zip(px, dark_level.to_pylist()):
        v = np.frombuffer(p.as_py() or b"", np.uint8).astype(np.int64)
        if not v.size:
            out.append(None)
            continue
        mean = v.sum() / v.size
        out.append({"stddev": float(np.sqrt(max(0.0, (v * v).sum() / v.size - mean * mean))),
                    "dark_share": float((v < level).sum() / v.size)})
    return pa.array(out, pa.struct([("stddev", pa.float64()), ("dark_share", pa.float64())]))


def fold_planes(batches):
    """(volume_id, y, peak, total, n): what the slices of a task come to in each row of a plane,
    folded before anything is shuffled.  Rows of a plane hold the cells from x = 0 on."""
    held: dict[tuple, list[np.ndarray]] = {}
    size, kind = 0, None

    def emit():
        for (volume, width), (peak, total, n) in held.items():
            cuts = range(0, len(peak), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([volume] * len(cuts), kind), pa.array([a // width for a in cuts], pa.int32()),
                 *[pa.array([v[a:a + width].tobytes() for a in cuts], pa.binary()) for v in (peak, total, n)]],
                ["volume_id", "y", "peak", "total", "n"])

    for batch in batches:
        kind = batch.column(0).type
        for volume, width, (ok, v) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _rows(batch.column(2))):
            if not ok or not v.size:
                continue
            finite = np.isfinite(v)
            new = [np.where(finite, v, -np.inf), np.where(finite, v, 0.0), finite.astype(np.int64)]
            key = volume, width if width and width > 0 else v.size
            if key not in held:
                held[key] = new
                size += 3 * new[0].nbytes
            else:
                before = sum(a.nbytes for a in held[key])
                held[key] = _folded(held[key], new)
                size += sum(a.nbytes for a in held[key]) - before
            if size > HELD_BYTES:
                yield from emit()
                held, size = {}, 0
    yield from emit()


def _folded(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Peak, total and count of two planes or rows; the longer one's tail is its own."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    most = len(b[0])
    out = [v.copy() for v in a]
    np.maximum(out[0][:most], b[0], out=out[0][:most])
    out[1][:most] += b[1]
    out[2][:most] += b[2]
    return out


def merge_planes(batches):
    """(volume_id, y, x, max_v, avg_v) of rows sorted by volume and y."""
    at, row, done, cells = None, None, [], 0

    def emit(kind):
        lengths = [len(r[0]) for _, r in done]
        peak, total, n = (np.concatenate([r[k] for _, r in done]) for k in range(3))
        none = n == 0
        volumes = pa.array([v for (v, _), _ in done], kind).take(pa.array(np.repeat(np.arange(len(done)), lengths)))
        mean = np.divide(total, n, out=np.zeros(len(n)), where=~none)
        return pa.RecordBatch.from_arrays(
            [volumes, pa.array(np.repeat([y for (_, y), _ in done], lengths), pa.int32()),
             pa.array(np.concatenate([np.arange(k) for k in lengths]), pa.int32()), pa.array(peak, mask=none), pa.array(mean, mask=none)],
            ["volume_id", "y", "x", "max_v", "avg_v"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for volume, y, peak, total, n in zip(*(c.to_pylist() for c in batch.columns)):
            new = [np.frombuffer(peak), np.frombuffer(total), np.frombuffer(n, np.int64)]
            if row is not None and at == (volume, y):
                row = _folded(row, new)
                continue
            if row is not None:
                done.append((at, row))
                cells += len(row[0])
                if cells >= BATCH_CELLS:
                    yield emit(kind)
                    done, cells = [], 0
            at, row = (volume, y), new
    if row is not None:
        done.append((at, row))
        yield emit(kind)


def _narrowest(v: np.ndarray) -> np.ndarray:
    """The same voxels in the smallest of four types that holds them exactly."""
    whole = np.isfinite(v).all() and not np.signbit(v[v == 0]).any()
    for kind in ("<i2", "<i4", "<f4") if whole else ("<f4",):
        with np.errstate(all="ignore"):
            small = v.astype(kind)
        if np.array_equal(small.astype(np.float64), v, equal_nan=kind == "<f4"):
            return small
    return v


def strips(views: list[tuple[str, int]]):
    """Cut axial slices for other ``views``: (volume_id, view, index, across, zs, kind, vox), one
    row per slice of a view for all consecutive slices of a volume that a task holds."""
    def kernel(batches):
        at, planes, zs, size, kind = None, [], [], 0, None

        def emit():
            volume, width, height = at
            stack = _narrowest(np.stack(planes).reshape(len(planes), height, width))
            packed = np.array(zs, np.int64).tobytes()
            for view, axis in views:
                across, many = (width, height) if axis == 1 else (height, width)
                cut = [np.ascontiguousarray(stack[:, k, :] if axis == 1 else stack[:, :, k]).tobytes() for k in range(many)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([volume] * many, kind), pa.array([view] * many), pa.array(range(many), pa.int32()), pa.array([across] * many, pa.int32()),
                     pa.array([packed] * many, pa.binary()), pa.array([stack.dtype.str] * many), pa.array(cut, pa.binary())],
                    ["volume_id", "view", "index", "across", "zs", "kind", "vox"])

        for batch in batches:
            kind = batch.column(0).type
            shapes = zip(*(batch.column(k).to_pylist() for k in range(4)), _rows(batch.column(4)))
            for volume, z, width, height, (_, v) in shapes:
                if z is None or not width or not height or width < 0 or height < 0:
                    continue
                if planes and ((volume, width, height) != at or size > HELD_BYTES // 4):
                    yield from emit()
                    planes, zs, size = [], [], 0
                plane = np.full(width * height, np.nan)
                plane[:min(len(v), len(plane))] = v[:len(plane)]
                at = volume, width, height
                planes.append(plane)
                zs.append(z)
                size += plane.nbytes
        if planes:
            yield from emit()
    return kernel


def joined_strips(batches):
    """Slices of the other views from rows sorted by volume, view, index and width."""
    names = ["volume_id", "view", "index", "width", "height", "vox"]
    at, parts, done, cells, kind = None, [], [], 0, None

    def whole():
        zs, rows = np.concatenate([z for z, _ in parts]), np.concatenate([some for _, some in parts])
        order = np.argsort(zs, kind="stable").tolist()
        if len(set(zs.tolist())) < len(zs):
            # Slices of one place go by their voxels, those that are no number last.
            order.sort(key=lambda k: (zs[k], np.where(np.isnan(rows[k]), np.inf, rows[k]).tolist()))
        return rows[order].reshape(-1), len(order)

    def emit():
        keys, rows, heights = zip(*done)
        columns = list(zip(*keys))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()),
             pa.array(heights, pa.int32()), _lists(list(rows))], names)

    for batch in batches:
        kind = batch.column(0).type
        for volume, view, index, across, zs, told, vox in zip(*(c.to_pylist() for c in batch.columns)):
            if parts and (volume, view, index, across) != at:
                row, height = whole()
                done.append((at, row, height))
                parts, cells = [], cells + len(row)
                if cells >= BATCH_CELLS:
                    yield emit()
                    done, cells = [], 0
            at = volume, view, index, across
            z = np.frombuffer(zs, np.int64)
            parts.append((z, np.frombuffer(vox, told).astype(np.float64).reshape(len(z), across)))
    if parts:
        row, height = whole()
        done.append((at, row, height))
    if done:
        yield emit()
