"""Window and ordered operators (WIN-*)."""

from pyspark.sql import functions as F

from framewright.fixtures import views as V
from framewright.fixtures.sql import with_views
from framewright.functions import text as X
from framewright.operators import coco as M
from framewright.operators import crops as C
from framewright.operators import curation as U
from framewright.operators import reports as Q
from framewright.operators import similarity as S
from framewright.operators import volumes as O
from framewright.plans.ordered import number_rows
from framewright.registry import query
from framewright.registry.filters import outcomes, requests

_PREFIX = "regexp_replace(CASE WHEN trim(annotation) = '' THEN 'Crop' ELSE annotation END, '[^A-Za-z0-9._-]', '_', 'g')"


@query("win1_running_numbers", with_views("crops existing_files", f"""
, seeds AS (SELECT lower(regexp_extract(name, '^(.*)_(\\d+)x(\\d+)_.*\\.png$', 1, 'i')) AS prefix, CAST(regexp_extract(name, '^(.*)_(\\d+)x(\\d+)_.*\\.png$', 2, 'i') AS INT) AS w,
  CAST(regexp_extract(name, '^(.*)_(\\d+)x(\\d+)_.*\\.png$', 3, 'i') AS INT) AS h, max(CAST(regexp_extract(name, '_(\\d+)\\.[a-zA-Z]+$', 1) AS INT)) AS highest
  FROM existing_files WHERE regexp_matches(name, '^(.*)_(\\d+)x(\\d+)_.*\\.png$', 'i') GROUP BY 1, 2, 3),
n AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 'LOW' ELSE {_PREFIX} END AS prefix FROM crops)
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, n.prefix,
  coalesce(highest, 0) + row_number() OVER (PARTITION BY n.prefix, n.w, n.h ORDER BY manifest_id, l_orderkey, l_linenumber, image_id, tiebreak) AS number
FROM n LEFT JOIN seeds s ON s.prefix = lower(n.prefix) AND s.w = n.w AND s.h = n.h"""))
def win1(spark, sf):
    r = requests(spark, sf).withColumn("prefix", F.when(F.col("l_orderkey") % 2 == 0, "LOW").otherwise(X.sanitized("annotation")))
    numbered = C.number_crops(r, V.CROP_KEY, C.highest_numbers(V.existing_files(spark, sf)),
                              at_most=V.rows(spark, sf, "lineitem"))
    return numbered.select(*V.CROP_KEY, "prefix", "number")


def coco_rows(spark, sf):
    """All crops, those of images that are not in the catalogue too."""
    d = C.describe(outcomes(spark, sf, keep=[F.col("path").alias("_known")]).fillna(0, ["image_width", "image_height"]))
    path = F.coalesce("_known", F.concat(F.lit("/gone/"), F.col("image_id").cast("string"), F.lit(".png")))
    return d.withColumn("image_path", path).select(
        *V.CROP_KEY, F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", "image_width", "image_height", "annotation",
        "image_path", X.file_name("image_path").alias("image_name"))


_IDS = """
, r AS (SELECT o.* EXCLUDE (image_width, image_height), CASE WHEN trim(o.annotation) = '' THEN 'unlabeled' ELSE trim(o.annotation) END AS category,
    coalesce(c.path, '/gone/' || o.image_id || '.png') AS image_path, greatest(1, coalesce(c.width, 0)) AS image_width, greatest(1, coalesce(c.height, 0)) AS image_height,
    row_number() OVER (ORDER BY manifest_id, l_orderkey, l_linenumber, o.image_id, tiebreak) AS id
  FROM outcomes o LEFT JOIN catalog c ON c.image_id = o.image_id),
img AS (SELECT image_path, min(image_width) AS width, min(image_height) AS height, row_number() OVER (ORDER BY min(id)) AS iid FROM r GROUP BY image_path),
cat AS (SELECT category, row_number() OVER (ORDER BY min(id)) AS cid FROM r GROUP BY category)"""


@query("win2_first_appearance_ids", with_views("outcomes", "") + _IDS + """
SELECT id, iid AS image_id, cid AS category_id FROM r JOIN img USING (image_path) JOIN cat USING (category)""")
def win2(spark, sf):
    return M.coco_tables(coco_rows(spark, sf), V.CROP_KEY, at_most=V.rows(spark, sf, "lineitem"))["annotations"].select("id", "image_id", "category_id")


@query("win3_previous_image", with_views("pairs", "SELECT folder, b_name AS name, a_name AS previous FROM pairs"))
def win3(spark, sf):
    pairs = S.consecutive_pairs(V.thumbs(spark, sf), at_most=V.rows(spark, sf, "embeddings", times=4))
    return pairs.select("folder", F.col("b_name").alias("name"), F.col("a_name").alias("previous"))


@query("win4_laplacian_stencil", with_views("measures", "SELECT folder, round(avg(var_laplacian), 6) AS mean_sharpness, count(*) AS images FROM measures GROUP BY folder"))
def win4(spark, sf):
    return U.measure(V.thumbs(spark, sf)).groupBy("folder").agg(
        F.round(F.avg("var_laplacian"), 6).alias("mean_sharpness"), F.count(F.lit(1)).alias("images"))


@query("win5_slice_rank", with_views("dicom_tags", """
SELECT path, series, row_number() OVER (PARTITION BY series ORDER BY position, name, path) AS slice_rank FROM (
  SELECT path, CASE WHEN series_uid <> '' THEN series_uid ELSE 'dir:' || parent END AS series, coalesce(slice_location, position_z, 0) AS position,
    regexp_replace(path, '^.*/', '') AS name FROM dicom_tags)"""))
def win5(spark, sf):
    return O.rank_in_series(V.dicom_tags(spark, sf), at_most=V.rows(spark, sf, "embeddings")).select("path", "series", "slice_rank")


@query("win6_slice_range", with_views("voxels", """
SELECT volume_id, z, round(min(CASE WHEN isnan(v) THEN NULL ELSE v END), 6) AS low, round(max(CASE WHEN isnan(v) THEN NULL ELSE v END), 6) AS high FROM voxels GROUP BY volume_id, z"""))
def win6(spark, sf):
    finite = F.filter("vox", lambda v: ~F.isnan(v))
    return V.voxel_slices(spark, sf).select(
        "volume_id", "z", F.round(F.array_min(finite), 6).alias("low"), F.round(F.array_max(finite), 6).alias("high"))


@query("win7_segment_ordinals", with_views("segments", """
SELECT video_id, 'segment_' || row_number() OVER (PARTITION BY video_id ORDER BY seg) AS name, start_s, end_s FROM segments"""))
def win7(spark, sf):
    numbered = number_rows(V.segments(spark, sf), ["video_id"], ["seg"], "n", at_most=V.rows(spark, sf, "events", times=2))
    return numbered.select("video_id", F.concat(F.lit("segment_"), F.col("n").cast("string")).alias("name"), "start_s", "end_s")
