"""Rotation geometry, rotated-tile plans and image augmentation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.constants import ROTATION_ANGLES
from framewright.functions import geometry as G
from framewright.functions.pixels import flip_both, flip_horizontal, flip_vertical, rotate_pixels, rotated_tiles

# Names of the geometry entries; one of them is spelt by the angle branch.
GEOMETRY = ("h", "h1", "Ya", "x0", "x1", "delta_y", "y1", "xb", "x2", "y2", "xmax", "x3", "Yc", "y3",
            "Xd", "Yd", "x4", "y4", "ymax")

# Flip names.
FLIPS = ("Flipped horizontal", "Flipped vertical", "Flipped both")


def with_angles(images: DataFrame, angles: Sequence[int] = ROTATION_ANGLES) -> DataFrame:
    return images.withColumn("angle", F.explode(F.array(*[F.lit(a) for a in angles])))


def with_geometry(rows: DataFrame, crop_w: int, crop_h: int) -> DataFrame:
    """Add struct ``g``: tile offsets of an image (width, height) rotated by ``angle``.

    Four grids start at the corners of the rotated outline; a flat rotation (up to
    45 degrees) steps along the crop width, a steep one along the crop height.
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    cw, ch = F.lit(float(crop_w)), F.lit(float(crop_h))
    flat = F.col("angle") <= 45
    turn = F.radians(F.col("angle").cast("double"))
    step1 = rows.withColumns({"_s": F.sin(turn), "_c": F.cos(turn), "_t": F.tan(turn)})
    s, c, t = F.col("_s"), F.col("_c"), F.col("_t")
    step2 = step1.withColumns({
        "_h": ch * F.when(flat, c).otherwise(s),
        "_Ya": w * s, "_Xb": w * c, "_Yc": h * c, "_Xd": h * s, "_Yd": w * s + h * c, "_wide": w * c + h * s,
        "_x0": F.when(flat, cw * t).otherwise(F.try_divide(ch, t)),
    })
    hh = F.col("_h")
    step3 = step2.withColumns({
        "_h1": hh * F.when(flat, c).otherwise(s), "_x1": hh * F.when(flat, s).otherwise(c),
    })
    h1, x1 = F.col("_h1"), F.col("_x1")
    dy = F.when(flat, x1 * t).otherwise(ch - h1)
    step4 = step3.withColumn("_dy", dy)
    dy = F.col("_dy")
    # What lies beside a corner swaps roles between the two branches.
    x2 = F.col("_Xb") - F.when(flat, h1).otherwise(dy)
    g = F.struct(
        hh.alias("h"), h1.alias("h1"), F.col("_Ya").alias("Ya"), F.col("_x0").alias("x0"), x1.alias("x1"),
        dy.alias("delta_y"), (F.col("_Ya") - F.when(flat, dy).otherwise(h1)).alias("y1"), F.col("_Xb").alias("xb"),
        x2.alias("x2"), x1.alias("y2"),
        F.when(flat, F.col("_Xb") - dy).otherwise(x2 + cw).alias("xmax"),
        (F.col("_wide") - x1 - cw).alias("x3"), F.col("_Yc").alias("Yc"),
        (F.col("_Yc") - F.when(flat, h1).otherwise(dy)).alias("y3"), F.col("_Xd").alias("Xd"),
        F.col("_Yd").alias("Yd"), (F.col("_Xd") - F.when(flat, dy).otherwise(h1)).alias("x4"),
        (F.col("_Yd") - x1 - ch).alias("y4"), (F.col("_Yd") - x1).alias("ymax"),
    )
    return step4.withColumn("g", g).select(*rows.columns, "g")


def geometry_map(row: Column | None = None) -> Column:
    """The 19-entry ``MAP<STRING, DOUBLE>`` of struct ``g`` (of ``row``, a struct with ``angle`` and ``g``, if given)."""
    angle, g = (F.col("angle"), F.col("g")) if row is None else (row["angle"], row["g"])
    entries = []
    for name in GEOMETRY:
        key = F.when(angle > 45, "Xb").otherwise("xb") if name == "xb" else F.lit(name)
        entries += [key, g[name]]
    return F.create_map(*entries)


# A grid step is (dx, dy); each corner walks it with its own signs: x down and across, y down and across.
_SIGNS = {1: (1, 1, 1, -1), 2: (1, -1, 1, 1), 3: (-1, -1, -1, 1), 4: (-1, 1, -1, -1)}


def with_grids(rows: DataFrame, crop_w: int, crop_h: int) -> DataFrame:
    """Add struct ``grid``: how many steps the grids of an image and angle have (``n_across``,
    ``n_down``), their regions (``n``), where each corner's begins (``x1`` ... ``y4``) and what a
    step adds (``ix``, ``iy``, ``jx``, ``jy``)."""
    g = with_geometry(rows, crop_w, crop_h)
    cw, ch, lean = F.lit(float(crop_w)), F.lit(float(crop_h)), F.col("g.x0")
    flat = F.col("angle") <= 45
    along = F.when(flat, (F.col("g.xmax") - F.col("g.x1")) / cw).otherwise((F.col("g.y1") + ch - F.col("g.y2")) / ch)
    down = F.when(flat, (F.col("g.ymax") - F.col("g.y1")) / cw).otherwise((F.col("g.x4") + ch - F.col("g.x1")) / cw)
    counted = g.withColumns({"_across": F.floor(along).cast("int"), "_down": F.floor(down).cast("int")})
    room = (F.col("_across") > 0) & (F.col("_down") > 0)
    grid = F.struct(
        F.col("_across").alias("n_across"), F.col("_down").alias("n_down"),
        F.when(room, F.col("_across").cast("long") * F.col("_down") * 4).otherwise(0).alias("n"),
        *[F.col(f"g.{c}{k}").alias(f"{c}{k}") for c in "xy" for k in _SIGNS],
        F.when(flat, cw).otherwise(lean).alias("ix"), F.when(flat, lean).otherwise(ch).alias("iy"),
        F.when(flat, lean).otherwise(cw).alias("jx"), F.when(flat, ch).otherwise(lean).alias("jy"))
    return counted.withColumn("grid", grid).select(*rows.columns, "g", "grid")


def _corner_xy(grid: Callable[[str], Column], n: int, i: Column, j: Column) -> tuple[Column, Column]:
    """Top left of the region that the grid of corner ``n`` has ``i`` steps across and ``j`` down."""
    jx, ix, jy, iy = _SIGNS[n]
    return (grid(f"x{n}") + jx * (j * grid("jx")) + ix * (i * grid("ix")),
            grid(f"y{n}") + jy * (j * grid("jy")) + iy * (i * grid("iy")))


def tile_regions(rows: DataFrame, crop_w: int, crop_h: int) -> DataFrame:
    """One row per region: grid position (j, i), corner 1..4 and top-left x, y.

    Regions may leave the rotated image; ``in_bounds`` tells.
    """
    steps = ("ix", "iy", "jx", "jy", *[f"{c}{n}" for c in "xy" for n in _SIGNS])
    grid = with_grids(rows, crop_w, crop_h).where("grid.n > 0").select(
        *rows.columns, "grid.n_across", "grid.n_down", *[F.col(f"grid.{c}").alias(f"_{c}") for c in steps]).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("n_down") - 1))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("n_across") - 1)))
    corners = []
    for n in _SIGNS:
        x, y = _corner_xy(lambda c: F.col(f"_{c}"), n, F.col("i"), F.col("j"))
        corners.append(F.struct(F.lit(n).alias("corner"), x.alias("x"), y.alias("y")))
    out_w, out_h = G.rotated_size("width", "height", "angle")
    regions = grid.select(*rows.columns, "n_across", "n_down", "j", "i", F.inline(F.array(*corners)))
    # Rounding first keeps float noise from moving a whole-pixel corner.
    px, py = F.round("x", 6).cast("int"), F.round("y", 6).cast("int")
    return regions.withColumns({
        "ordinal": (F.col("j") * F.col("n_across") + F.col("i")) * 4 + F.col("corner") - 1,
        "tile_w": F.lit(crop_w), "tile_h": F.lit(crop_h),
        "in_bounds": (px >= 0) & (py >= 0) & (px + crop_w <= out_w) & (py + crop_h <= out_h),
    })


def parts_of(n: Column, max_records: int) -> Column:
    """Numbers of the parts that ``n`` regions take; part 0 is there without any."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / F.lit(max_records)).cast("int")))


def regions_of(grid: Column, part: Column, crop_w: int, crop_h: int, max_records: int) -> Column:
    """Part of the regions of a ``grid`` in drawing order, as :func:`tile_regions` places them.

    A region follows from its grid and its ordinal alone, so regions need not travel: they are
    laid in the row that wants them, a bounded part at a time."""
    def region(k: Column) -> Column:
        cell, corner = F.floor(k / 4), k % 4 + 1
        i, j = (cell % grid["n_across"]).cast("int"), F.floor(cell / grid["n_across"]).cast("int")
        corners = [_corner_xy(lambda c: grid[c], n, i, j) for n in _SIGNS]
        x, y = (F.when(corner == 1, c1).when(corner == 2, c2).when(corner == 3, c3).otherwise(c4) for c1, c2, c3, c4 in zip(*corners))
        return F.struct(x.alias("x"), y.alias("y"), F.lit(crop_w).alias("width"), F.lit(crop_h).alias("height"))

    first = part.cast("long") * max_records
    end = F.least(grid["n"], first + max_records)
    # An ascending sequence cannot be empty.
    ordinals = F.slice(F.sequence(first, F.greatest(first, end - 1)), F.lit(1), F.greatest(F.lit(0), end - first).cast("int"))
    return F.transform(ordinals, region)


def tile_path() -> Column:
    return F.format_string(
        "cropped/angle/%d/%d_x_%d/%d_%d_%d_%d.png", "angle", "tile_w", "tile_h", "angle", "j", "i", "ordinal")


def flip_path(angle, w, h, name, index) -> Column:
    a, w, h, n, i = (F.col(v) if isinstance(v, str) else v for v in (angle, w, h, name, index))
    return F.format_string("cropped/augmented_data/%s/%s/%dx%d/%s_crop_%d.png", a, F.col("flip"), w, h, n, i)


def flips(images: DataFrame) -> DataFrame:
    """Three rows per image: mirrored left-right, top-bottom and both."""
    args = ("px", "height", "width", "n_channels")
    made = images.withColumns({
        "_h": flip_horizontal(*args), "_v": flip_vertical(*args), "_b": flip_both(*args)})
    pack = F.array(*[F.struct(F.lit(n).alias("flip"), F.col(c).alias("px")) for n, c in zip(FLIPS, ("_h", "_v", "_b"))])
    return made.select(*[c for c in images.columns if c != "px"], F.inline(pack))


def rotate(images: DataFrame) -> DataFrame:
    """Rotate pixels by the row's ``angle``; width and height become the new bounds."""
    new_w, new_h = G.rotated_size("width", "height", "angle")
    turned = rotate_pixels("px", "height", "width", "n_channels", "angle")
    out = images.withColumns({"_px": turned, "_w": new_w, "_h": new_h})
    rest = [c for c in images.columns if c not in ("px", "width", "height")]
    return out.select(*rest, F.col("_w").alias("width"), F.col("_h").alias("height"), F.col("_px").alias("px"))


def rotated_tile_pixels(images: DataFrame, crop_w: int, crop_h: int, angles: Sequence[int] = ROTATION_ANGLES, tasks: int | None = None) -> DataFrame:
    """The tiles of :func:`tile_regions` that lie inside the turned image, with their pixels
    (``px``, ``width``, ``height`` are the tile's).

    The turned image is never made.  A tile takes the strip of source rows that lies below
    its outline, a byte range of the image's pixels, and maps its own pixels back into it, so
    tiles of one image may be made by different tasks: ``tasks`` deals them out by image and
    place, and what travels is strips.  Without it tiles are made where the image is read.
    """
    regions = tile_regions(with_angles(images, angles), crop_w, crop_h).where("in_bounds")
    turn = F.radians(F.col("angle").cast("double"))
    s, c = F.sin(turn), F.cos(turn)
    w, h = F.col("width"), F.col("height")
    left, up = F.round("x", 6).cast("int"), F.round("y", 6).cast("int")
    mid_x, mid_y = (F.floor(v) / 2 for v in (w * F.abs(c) + h * F.abs(s), w * F.abs(s) + h * F.abs(c)))

    def source_row(x: Column, y: Column) -> Column:
        return -s * (x + 0.5 - mid_x) + c * (y + 0.5 - mid_y) + h / 2 - 0.5

    # The map is linear: a tile's first and last source rows lie below two of its corners.
    rows = [source_row(F.col("_left") + dx, F.col("_up") + dy) for dx in (0, crop_w - 1) for dy in (0, crop_h - 1)]
    placed = regions.withColumns({"_left": left, "_up": up}).withColumns({
        "_top": F.least(h - 1, F.greatest(F.lit(0), F.floor(F.least(*rows)) - 1)).cast("int"),
        "_end": F.least(h, F.greatest(F.lit(1), F.floor(F.greatest(*rows)) + 3)).cast("int")})
    line = w * F.col("n_channels")
    strips = placed.withColumn("_strip", F.substring(F.col("px"), F.col("_top") * line + 1, (F.col("_end") - F.col("_top")) * line)).drop("px")
    if tasks:
        strips = strips.repartition(tasks, "image_id", "angle", "ordinal")
    tile = rotated_tiles("_strip", "_top", "height", "width", "n_channels", "angle", "_left", "_up", "tile_w", "tile_h")
    rest = [c for c in images.columns if c not in ("px", "width", "height")]
    return strips.withColumn("px", tile).select(
        *rest, "angle", "j", "i", "corner", "ordinal", "tile_w", "tile_h", F.col("tile_w").alias("width"), F.col("tile_h").alias("height"), "px")
