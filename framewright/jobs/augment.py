"""Rotated tiles of the images of a folder, and their flips, as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.constants import ROTATION_ANGLES
from framewright.operators import rotation as R
from framewright.session import cut_lineage
from framewright.sinks.documents import write_json
from framewright.sinks.staged import write_png_staged
from framewright.sources.images import read_images


def run(
    spark: SparkSession, folder: str, out: str, crop_w: int, crop_h: int, angles: Sequence[int] = ROTATION_ANGLES,
    flip: bool = True, recursive: bool = False, tasks: int | None = None,
) -> DataFrame:
    """Cut the tiles of every image at every angle and write them below ``out``, all or none.

    Each image has a folder named after its path below ``folder``, with the tiles at
    ``cropped/angle/...`` and their three flips at ``cropped/augmented_data/...``; images that
    do not decode are listed in ``rejects``.  Returns the number of tiles per image and angle;
    an image without room for a tile at an angle has no row there.
    """
    images, rejects = read_images(spark, folder, recursive)
    root = folder.rstrip("/").removeprefix("file:").rstrip("/") + "/"
    beside = F.expr(f"substring(path, {len(root) + 1})")
    named = images.withColumn("_folder", F.when(F.col("path").startswith(root), beside).otherwise(F.col("name")))
    tiles = R.rotated_tile_pixels(named, crop_w, crop_h, angles, tasks)
    tiles = cut_lineage(tiles.select(
        "image_id", "path", "name", "_folder", "angle", "j", "i", "ordinal", "tile_w", "tile_h", "width", "height", "n_channels", "px"))
    write_png_staged(tiles, F.concat_ws("/", "_folder", R.tile_path()), out)
    if flip:
        flipped = R.flips(tiles).withColumn("angle", F.col("angle").cast("string"))
        write_png_staged(flipped, F.concat_ws("/", "_folder", R.flip_path("angle", "width", "height", "name", "ordinal")), out)
    write_json(rejects, f"{out.rstrip('/')}/rejects")
    return tiles.groupBy("image_id", "path", "angle").agg(F.count(F.lit(1)).alias("tiles"))
