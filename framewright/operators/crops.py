"""Crop requests, placement, tiling, rendering, numbering and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.constants import CROP_LEVELS
from framewright.functions import geometry as G
from framewright.functions import text as X
from framewright.functions.pixels import cut_tiles
from framewright.plans.ordered import MAX_GROUP_ROWS, number_rows, running_sum
from framewright.plans.skew import MAX_KEY_ROWS, salted_join

# Crops of one image that a single row may carry to be cut together.
MAX_CROPS_PER_DECODE = 512
# Such rows of one image that one join task may hold next to its pixels.
MAX_DECODES_PER_TASK = 256


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Resolve every spelling of a request to ``x, y, w, h``.

    Corners are inclusive, so a corner pair spans ``br - tl + 1``; a size that is
    given nowhere is the manifest default.  A request without an origin has
    ``complete = false``.
    """
    have = set(requests.columns)

    def first(*names):
        return F.coalesce(*[F.col(n) for n in names if n in have])

    x, y = first("x1", "cropX1", "tl_x"), first("y1", "cropY1", "tl_y")
    placed = requests.withColumns({"x": x, "y": y})
    both = F.col("br_x").isNotNull() & F.col("br_y").isNotNull()
    w = F.coalesce(first("w", "cropWidth"), F.when(both, F.col("br_x") - F.col("x") + 1), F.col("default_w"))
    h = F.coalesce(first("h", "cropHeight"), F.when(both, F.col("br_y") - F.col("y") + 1), F.col("default_h"))
    out = placed.withColumns({
        "w": F.coalesce(w, F.lit(0)).cast("int"), "h": F.coalesce(h, F.lit(0)).cast("int"),
        "complete": F.col("x").isNotNull() & F.col("y").isNotNull(),
    })
    return out.drop("x1", "y1", "tl_x", "tl_y", "br_x", "br_y", "cropX1", "cropY1", "cropWidth", "cropHeight")


def place_crops(points: DataFrame) -> DataFrame:
    """Primary rectangle for each point; a point outside the shown image gives none."""
    inside = (F.col("rel_x") >= 0) & (F.col("rel_y") >= 0) \
        & (F.col("rel_x") < F.col("disp_w")) & (F.col("rel_y") < F.col("disp_h"))
    return points.where(inside).withColumns({
        "x": G.primary_origin("rel_x", "disp_w", "image_width", "crop_w"),
        "y": G.primary_origin("rel_y", "disp_h", "image_height", "crop_h"),
    })


def large_enough(images: DataFrame, crop_w: int, crop_h: int) -> Column:
    return (F.col("width") >= crop_w) & (F.col("height") >= crop_h)


def tile_levels(primary: DataFrame, levels: Sequence[tuple[int, int]] = CROP_LEVELS) -> DataFrame:
    """Primary rectangle plus its 2x2 and 4x4 tiles, row by row, as rows."""
    specs = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(n).alias("per_side")) for lv, n in levels])
    leveled = primary.select("*", F.inline(specs))
    cells = leveled.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("per_side") * F.col("per_side") - 1)))
    row, col = F.floor(F.col("_i") / F.col("per_side")).cast("int"), F.pmod(F.col("_i"), F.col("per_side"))
    whole = F.col("level") == 0
    tw = F.when(whole, F.col("w")).otherwise(G.tile_side("w", "per_side"))
    th = F.when(whole, F.col("h")).otherwise(G.tile_side("h", "per_side"))
    sized = cells.withColumns({"_tw": tw, "_th": th, "tile": F.col("_i")})
    return sized.withColumns({
        "x": F.col("x") + col * F.col("_tw"), "y": F.col("y") + row * F.col("_th"),
        "w": F.col("_tw"), "h": F.col("_th"),
    }).drop("_i", "_tw", "_th", "per_side")


def describe(crops: DataFrame) -> DataFrame:
    """Inclusive corners and coordinates relative to the image."""
    ends = crops.withColumns({"x2": G.inclusive_end("x", "w"), "y2": G.inclusive_end("y", "h")})
    return ends.withColumns({
        "nx1": F.try_divide("x", F.col("image_width").cast("double")),
        "ny1": F.try_divide("y", F.col("image_height").cast("double")),
        "nx2": F.try_divide("x2", F.col("image_width").cast("double")),
        "ny2": F.try_divide("y2", F.col("image_height").cast("double")),
    })


def crop_outcomes(
    crops: DataFrame, images: DataFrame, on: str = "image_id", salt_by: Sequence[str] | None = None,
    max_key_rows: int = MAX_KEY_ROWS, at_most: int | None = None, keep: Sequence[Column] = (),
) -> DataFrame:
    """Outcome of every crop: ``done``, ``no image``, ``out of bounds``, ``incomplete``, or
    ``no path`` where the request names no image (column ``image_path``, if there is one).

    Only image sizes are joined, and columns of ``images`` to ``keep``; a heavily cropped
    image is spread over tasks.
    """
    sizes = images.select(on, F.col("width").alias("image_width"), F.col("height").alias("image_height"), *keep)
    joined = salted_join(crops, sizes, [on], "left", salt_by, max_key_rows, at_most)
    fits = G.inside_image("x", "y", "w", "h", "image_width", "image_height")
    nameless = X.blank_to_null("image_path").isNull() if "image_path" in crops.columns else F.lit(False)
    return joined.withColumn(
        "outcome",
        F.when(nameless, "no path").when(~F.col("complete"), "incomplete").when(F.col("image_width").isNull(), "no image")
        .when(fits, "done").otherwise("out of bounds"),
    )


def render(
    crops: DataFrame, images: DataFrame, on: str, key: Sequence[str], at_most: int | None = None,
) -> DataFrame:
    """Pixels of every crop, decoding an image once per ``MAX_CROPS_PER_DECODE`` crops.

    ``images`` holds the pixels under a unique ``on``; boxes of a heavily cropped
    image come in several rows of bounded size.
    """
    numbered = number_rows(crops, [on], [F.col(k) for k in key], "_n", at_most=at_most)
    part = F.floor((F.col("_n") - 1) / F.lit(MAX_CROPS_PER_DECODE)).cast("int").alias("_part")
    keys = F.struct(*key).alias("key")
    box = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")])
    boxed = numbered.groupBy(on, part).agg(F.collect_list(F.struct(keys, box.alias("box"))).alias("_items"))
    rows_of_one = None if at_most is None else -(-at_most // MAX_CROPS_PER_DECODE)
    joined = salted_join(boxed, images, [on], "inner", ["_part"], MAX_DECODES_PER_TASK, rows_of_one, wide_right=True)
    tiles = cut_tiles("px", "height", "width", "n_channels", F.transform("_items", lambda i: i["box"]))
    rows = joined.withColumn("_px", tiles).select(
        on, "n_channels", F.explode(F.arrays_zip("_items", "_px")).alias("z"))
    return rows.select(on, "z._items.key.*", "z._items.box.*", "n_channels", F.col("z._px").alias("px")).where(
        F.col("px").isNotNull())


def highest_numbers(listing: DataFrame, name: str = "name") -> DataFrame:
    """Highest number in use per prefix and size, from file names; prefixes of one spelling
    but for case are one, given in lower case."""
    pattern = r"(?i)^(.*)_(\d+)x(\d+)_.*\.png$"
    parsed = listing.select(
        F.lower(F.regexp_extract(name, pattern, 1)).alias("prefix"),
        F.regexp_extract(name, pattern, 2).try_cast("int").alias("w"),
        F.regexp_extract(name, pattern, 3).try_cast("int").alias("h"),
        X.sequence_in_name(name).alias("_n"),
    ).where(F.col("w").isNotNull())
    return parsed.groupBy("prefix", "w", "h").agg(F.coalesce(F.max("_n"), F.lit(0)).alias("highest"))


def number_crops(
    crops: DataFrame, order: Sequence[str], seeds: DataFrame | None = None, max_group_rows: int = MAX_GROUP_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Running ``number`` and ``file_name`` per prefix and size, after the seed of each."""
    group = ["prefix", "w", "h"]
    if seeds is None:
        seeded = crops.withColumn("highest", F.lit(0))
    else:
        folded = ["_folded", "w", "h"]
        seeded = salted_join(
            crops.withColumn("_folded", F.lower("prefix")), seeds.withColumnRenamed("prefix", "_folded"), folded, "left",
            salt_by=order, at_most=at_most).drop("_folded")
    numbered = number_rows(seeded, group, list(order), "number", max_group_rows, at_most).withColumn(
        "number", F.col("number") + F.coalesce("highest", F.lit(0))).drop("highest")
    return numbered.withColumn("file_name", X.crop_file_name("prefix", "w", "h", "number"))


def assign_output_names(
    crops: DataFrame, listing: DataFrame, order: Sequence[str], respect_saved: bool = True,
    max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """File name of every crop in its sink, never one that exists there.

    A wanted ``saved_as`` name is kept by the first crop that asks for it when the
    sink does not hold it; all others take the free numbers of their prefix and
    size in order, skipping numbers already used.  ``at_most`` bounds crops and
    listed names together.
    """
    position = F.struct(*order)
    want = X.blank_to_null(X.file_name("saved_as")) if respect_saved else F.lit(None).cast("string")
    rows = crops.withColumns({"_pos": position, "_want": want})
    existing = listing.select("sink", "name").distinct()
    asking = rows.where(F.col("_want").isNotNull())
    first = asking.groupBy("sink", "_want").agg(F.min("_pos").alias("_first"))
    free = first.join(existing.withColumnRenamed("name", "_want"), ["sink", "_want"], "left_anti")
    judged = salted_join(asking, free, ["sink", "_want"], "left", salt_by=["_pos"], at_most=at_most)
    won = F.col("_first").isNotNull() & (F.col("_pos") == F.col("_first"))
    kept = judged.where(won).select(*crops.columns, F.col("_want").alias("file_name"))
    rest = rows.where(F.col("_want").isNull()).drop("_want").unionByName(judged.where(~won).drop("_want", "_first"))

    group = ["sink", "prefix", "w", "h"]
    taken = existing.unionByName(free.select("sink", F.col("_want").alias("name")))
    pattern = r"^(.*)_(\d+)x(\d+)_(\d{5,})\.png$"
    used = taken.select(
        "sink", F.regexp_extract("name", pattern, 1).alias("prefix"),
        F.regexp_extract("name", pattern, 2).try_cast("int").alias("w"),
        F.regexp_extract("name", pattern, 3).try_cast("int").alias("h"),
        F.regexp_extract("name", pattern, 4).try_cast("int").alias("n"),
    ).where(F.col("n") > 0).distinct()
    ranked = number_rows(used, group, ["n"], "_i", max_group_rows, at_most)
    # A used number n of rank i has n - i free numbers before it, so it moves
    # every request beyond that many up by one.  Requests and steps go through one
    # running sum; a request carries its row along, so nothing is joined back.
    asks = number_rows(rest, group, ["_pos"], "_rank", max_group_rows, at_most)
    points = asks.select(*group, F.col("_rank").alias("_at"), F.lit(1).alias("_new"), F.col("_rank").alias("_tie"),
                         F.lit(0).alias("_up"), F.struct(*crops.columns).alias("_row"))
    steps = ranked.select(*group, (F.col("n") - F.col("_i") + 1).alias("_at"), F.lit(0).alias("_new"),
                          F.col("_i").alias("_tie"), F.lit(1).alias("_up"),
                          F.lit(None).cast(points.schema["_row"].dataType).alias("_row"))
    counted = running_sum(steps.unionByName(points), group, ["_at", "_new", "_tie"], "_up", "_skipped", max_group_rows, at_most)
    numbered = counted.where(F.col("_new") == 1).select("_row.*", (F.col("_at") + F.col("_skipped")).alias("_number"))
    named = numbered.withColumn("file_name", X.crop_file_name("prefix", "w", "h", "_number")).drop("_number")
    return kept.unionByName(named)


def batch_counters(manifests: DataFrame, outcomes: DataFrame, on: str = "manifest_id", force: bool = False) -> DataFrame:
    """The eight counters of a batch run as one row.

    ``manifests`` has ``done`` and ``has_crops``; ``outcomes`` are crop outcomes.
    A manifest with an incomplete crop fails as a whole.
    """
    per = outcomes.groupBy(on).agg(
        F.count(F.lit(1)).alias("_queued"), F.count_if(F.col("outcome") == "done").alias("_done"),
        F.count_if(F.col("outcome").isin("no image", "out of bounds")).alias("_failed"),
        F.count_if(F.col("outcome") == "incomplete").alias("_incomplete"),
    )
    seen = outcomes.where(F.col("image_width").isNotNull()).select(on, "image_id").distinct()
    images = seen.groupBy(on).agg(F.count(F.lit(1)).alias("_images"))
    m = manifests.join(per, on, "left").join(images, on, "left")
    run = F.lit(True) if force else ~F.col("done")
    parsed = run & F.col("has_crops")
    sound = parsed & (F.coalesce("_incomplete", F.lit(0)) == 0)

    def total(c, cond):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")

    return m.agg(
        F.count(F.lit(1)).alias("manifests_queued"), F.count_if(sound).alias("manifests_processed"),
        F.count_if(~run).alias("manifests_skipped"), F.count_if(run & ~sound).alias("manifests_failed"),
        total("_images", sound).alias("images_processed"), total("_queued", parsed).alias("crops_queued"),
        total("_done", sound).alias("crops_done"), total("_failed", sound).alias("crops_failed"),
    )


def size_metrics(crops: DataFrame, elapsed_seconds: float, *by: str) -> DataFrame:
    """Crops per size with rates, and one ``total`` row per group from the same pass."""
    seconds = F.lit(float(max(1, int(elapsed_seconds))))
    sized = crops.select(*by, X.size_label("w", "h").alias("size"))
    grouped = sized.groupingSets([[*by, "size"], list(by)], *by, "size")
    out = grouped.agg(F.count(F.lit(1)).alias("total"), F.grouping("size").alias("_all"))
    return out.select(
        *by, F.when(F.col("_all") == 1, "total").otherwise(F.col("size")).alias("size"), "total",
        (F.col("total") / seconds).alias("per_second"), (F.col("total") / seconds * 60).alias("per_minute"),
    )


def level_name(w, h, primary_w, primary_h, is_primary) -> Column:
    """Level of a crop by flag or size; null where it fits none."""
    w, h, pw, ph = (F.col(v) if isinstance(v, str) else v for v in (w, h, primary_w, primary_h))
    flag = F.col(is_primary) if isinstance(is_primary, str) else is_primary

    def same(n):
        return (w == G.tile_side(pw, F.lit(n))) & (h == G.tile_side(ph, F.lit(n)))

    return F.when(flag | ((w == pw) & (h == ph)), "primary").when(same(2), "secondary").when(same(4), "tertiary")
