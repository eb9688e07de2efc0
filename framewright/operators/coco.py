"""COCO instance tables from crop records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.functions import text as X
from framewright.plans.ordered import MAX_GROUP_ROWS, number_rows
from framewright.plans.skew import salted_join


def image_key(path="image_path", name="image_name") -> Column:
    return F.coalesce(X.blank_to_null(path), X.blank_to_null(name))


def category_name(annotation="annotation") -> Column:
    return F.coalesce(F.trim(X.blank_to_null(annotation)), F.lit("unlabeled"))


def first_appearance_ids(
    rows: DataFrame, key: str, order: Sequence[str], name: str, keep: Sequence[str] = (),
    max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Ids 1, 2, 3... of distinct keys by their first row; ``keep`` columns come from it.

    Keys are reduced before they are ranked, so the rank sees one row per key.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *keep)).alias("_first"))
    ranked = number_rows(first, [], [F.col("_first")], name, max_group_rows, at_most)
    return ranked.select(key, name, *[F.col(f"_first.{c}").alias(c) for c in keep])


def coco_tables(
    crops: DataFrame, order: Sequence[str], exact_bbox: bool = False, max_group_rows: int = MAX_GROUP_ROWS,
    at_most: int | None = None,
) -> dict[str, DataFrame]:
    """``images``, ``categories`` and ``annotations`` of crop records.

    ``order`` is a unique row order; it decides all ids.  A crop whose image is not known stays:
    an unknown side counts as 1, so its box has no size.
    """
    at_most = crops.count() if at_most is None else at_most
    rows = crops.withColumns({"_image": image_key(), "_category": category_name()})
    rows = rows.withColumn("_image", F.coalesce("_image", F.concat(F.lit("img_"), F.concat_ws("_", *order))))
    sized = [F.coalesce(c, F.lit(0)).alias(c) for c in ("image_width", "image_height")]
    narrow = rows.select(*order, "_image", "_category", "image_name", *sized, "x1", "y1", "x2", "y2")
    # Rows are numbered once; keys are ranked by the number of their first row.
    numbered = number_rows(narrow, [], list(order), "id", max_group_rows, at_most).drop(*order)
    image_ids = first_appearance_ids(
        numbered, "_image", ["id"], "image_id", ("image_name", "image_width", "image_height"), max_group_rows, at_most)
    category_ids = first_appearance_ids(numbered, "_category", ["id"], "category_id", (), max_group_rows, at_most)
    images = image_ids.select(
        F.col("image_id").alias("id"),
        F.coalesce(X.blank_to_null("image_name"), X.file_name("_image")).alias("file_name"),
        F.greatest(F.lit(1), "image_width").alias("width"), F.greatest(F.lit(1), "image_height").alias("height"),
    )
    categories = category_ids.select(
        F.col("category_id").alias("id"), F.col("_category").alias("name"), F.lit("default").alias("supercategory"))
    # Categories first: few and hot, they are sent to the rows, and no count of keys runs on a shuffled join.
    joined = salted_join(numbered, category_ids, ["_category"], "inner", ["id"], at_most=at_most)
    joined = salted_join(joined, image_ids.select("_image", "image_id"), ["_image"], "inner", ["id"], at_most=at_most)
    box = G.coco_box("x1", "y1", "x2", "y2", "image_width", "image_height", exact_bbox)
    annotations = joined.withColumn("bbox", box).select(
        "id", "image_id", "category_id", "bbox",
        (F.col("bbox")[2].cast("double") * F.col("bbox")[3]).alias("area"),
        F.lit(0).alias("iscrowd"), F.array().cast("array<double>").alias("segmentation"),
    )
    return {"images": images, "categories": categories, "annotations": annotations}


def coco_info(dataset: str, created_by: str, created_iso: str) -> dict[str, str]:
    return {
        "description": f"{dataset} (COCO instances)", "version": "1.0", "year": created_iso[:4],
        "contributor": created_by, "date_created": created_iso,
    }
