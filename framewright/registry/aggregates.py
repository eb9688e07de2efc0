"""Aggregations (AGG-*)."""

from pyspark.sql import functions as F

from framewright.constants import ROTATION_ANGLES
from framewright.fixtures import views as V
from framewright.fixtures.sql import with_views
from framewright.functions import text as X
from framewright.operators import catalog as K
from framewright.operators import coco as M
from framewright.operators import crops as C
from framewright.operators import curation as U
from framewright.operators import frames as R
from framewright.operators import reports as Q
from framewright.operators import similarity as S
from framewright.operators import volumes as O
from framewright.registry import query
from framewright.registry.filters import distances, outcomes, requests


@query("agg1_kept_dropped", with_views("measures", """
SELECT folder, count_if(var_laplacian >= 120 AND mean_luma >= 20) AS kept, count_if(var_laplacian < 120 OR mean_luma < 20) AS dropped FROM measures GROUP BY folder"""))
def agg1(spark, sf):
    return U.decision_totals(U.decide(U.measure(V.thumbs(spark, sf))), "folder")


@query("agg2_near_duplicates", with_views("distances", "SELECT folder, count(*) AS pairs, count_if(distance <= 5) AS near_duplicates FROM distances GROUP BY folder"))
def agg2(spark, sf):
    return distances(spark, sf).groupBy("folder").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("distance") <= 5).alias("near_duplicates"))


@query("agg3_batch_counters", with_views("manifests outcomes", """
, per AS (SELECT manifest_id, count(*) AS q, count_if(outcome = 'done') AS d, count_if(outcome IN ('no image', 'out of bounds')) AS f, count_if(outcome = 'incomplete') AS bad,
    count(DISTINCT CASE WHEN image_width IS NOT NULL THEN image_id END) AS imgs FROM outcomes GROUP BY manifest_id),
m AS (SELECT *, NOT done AND has_crops AS parsed, NOT done AND has_crops AND coalesce(bad, 0) = 0 AS sound FROM manifests LEFT JOIN per USING (manifest_id))
SELECT count(*) AS manifests_queued, count_if(sound) AS manifests_processed, count_if(done) AS manifests_skipped, count_if(NOT done AND NOT sound) AS manifests_failed,
  CAST(coalesce(sum(CASE WHEN sound THEN imgs END), 0) AS BIGINT) AS images_processed, CAST(coalesce(sum(CASE WHEN parsed THEN q END), 0) AS BIGINT) AS crops_queued,
  CAST(coalesce(sum(CASE WHEN sound THEN d END), 0) AS BIGINT) AS crops_done, CAST(coalesce(sum(CASE WHEN sound THEN f END), 0) AS BIGINT) AS crops_failed FROM m"""))
def agg3(spark, sf):
    return C.batch_counters(V.manifests(spark, sf), outcomes(spark, sf))


@query("agg4_size_metrics", with_views("crops", """
SELECT manifest_id, coalesce(size, 'total') AS size, count(*) AS total, round(count(*) / 90.0, 9) AS per_second, round(count(*) / 90.0 * 60, 9) AS per_minute
FROM (SELECT manifest_id, w || 'x' || h AS size FROM crops) GROUP BY GROUPING SETS ((manifest_id, size), (manifest_id))"""))
def agg4(spark, sf):
    m = C.size_metrics(requests(spark, sf), 90, "manifest_id")
    return m.select("manifest_id", "size", "total", F.round("per_second", 9).alias("per_second"), F.round("per_minute", 9).alias("per_minute"))


@query("agg5_crops_by_level", with_views("crops", """
SELECT CASE WHEN l_orderkey % 7 = 0 OR (w = 256 AND h = 128) THEN 'primary' WHEN w = 128 AND h = 64 THEN 'secondary' WHEN w = 64 AND h = 32 THEN 'tertiary' END AS level, count(*) AS crops
FROM crops GROUP BY 1"""))
def agg5(spark, sf):
    level = C.level_name("w", "h", F.lit(256), F.lit(128), F.col("l_orderkey") % 7 == 0)
    return requests(spark, sf).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("crops"))


@query("agg6_voxel_statistics", with_views("voxels", """
SELECT volume_id, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS stddev_v, count(*) AS n_finite
FROM voxels WHERE NOT isnan(v) GROUP BY volume_id"""))
def agg6(spark, sf):
    s = O.voxel_statistics(V.voxel_slices(spark, sf))
    return s.select("volume_id", *[F.round(c, 6).alias(c) for c in ("min_v", "max_v", "mean_v", "stddev_v")], "n_finite")


@query("agg7_intensity_projection", with_views("normalised", """
SELECT volume_id, CAST(r AS INT) AS y, CAST(c AS INT) AS x, round(max(n), 9) AS max_v, round(avg(n), 9) AS avg_v FROM normalised WHERE view = 'axial' GROUP BY volume_id, r, c"""))
def agg7(spark, sf):
    p = O.project(V.voxel_slices(spark, sf))
    return p.select("volume_id", "y", "x", F.round("max_v", 9).alias("max_v"), F.round("avg_v", 9).alias("avg_v"))


@query("agg7_raw_projection", with_views("voxels", """
SELECT volume_id, y, x, round(max(CASE WHEN isnan(v) THEN NULL ELSE v END), 6) AS max_v, round(avg(CASE WHEN isnan(v) THEN NULL ELSE v END), 6) AS avg_v FROM voxels GROUP BY volume_id, y, x"""))
def agg7_raw(spark, sf):
    p = O.project(V.voxel_slices(spark, sf), "none")
    return p.select("volume_id", "y", "x", F.round("max_v", 6).alias("max_v"), F.round("avg_v", 6).alias("avg_v"))


def matched(spark, sf):
    return R.frames_in_segments(V.frames(spark, sf), V.segments(spark, sf))


@query("agg8_frames_per_segment", with_views("matched", """
SELECT video_id, seg, count(*) AS frames FROM matched GROUP BY GROUPING SETS ((video_id, seg), (video_id))"""))
def agg8(spark, sf):
    return R.frames_per_segment(matched(spark, sf))


_RUNS = """
runs AS (SELECT f.video_id, f.frames, coalesce(d.dropped, 0) AS dropped, f.duration_s, 120.0 AS elapsed_s, f.source_bytes, f.frame_bytes FROM
  (SELECT video_id, count(*) AS frames, max(pts_s) - min(pts_s) AS duration_s, count(*) * 5000 AS source_bytes, count_if(y_avg > 20) * 900 AS frame_bytes FROM frames GROUP BY video_id) f
  LEFT JOIN (SELECT video_id, sum(coalesce(TRY_CAST(regexp_extract(line, 'drop_count[^:]*:\\s*(\\d+)', 1) AS INT), 0)) AS dropped FROM decoder_log GROUP BY video_id) d USING (video_id))"""


def runs(spark, sf):
    f = V.frames(spark, sf).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"), (F.max("pts_s") - F.min("pts_s")).alias("duration_s"),
        (F.count(F.lit(1)) * 5000).alias("source_bytes"), (F.count_if(R.bright()) * 900).alias("frame_bytes"))
    d = R.dropped_totals(V.decoder_log(spark, sf))
    return f.join(d, "video_id", "left").withColumns(
        {"dropped": F.coalesce("dropped", F.lit(0)), "elapsed_s": F.lit(120.0)})


@query("agg9_extraction_rates", with_views("frames decoder_log", "").rstrip() + "," + _RUNS + """
SELECT video_id, round(CASE WHEN duration_s > 0 THEN frames / duration_s ELSE 0 END, 9) AS frames_per_second, round(frames / elapsed_s, 9) AS processing_rate,
  round(CASE WHEN frames + dropped > 0 THEN dropped * 100.0 / (frames + dropped) ELSE 0 END, 9) AS duplicate_rate,
  round(CASE WHEN duration_s > 0 THEN elapsed_s / duration_s ELSE 0 END, 9) AS real_time_factor, round(CAST(frame_bytes AS DOUBLE) / source_bytes, 9) AS compression_ratio FROM runs""")
def agg9(spark, sf):
    r = R.extraction_rates(runs(spark, sf))
    return r.select("video_id", *[F.round(c, 9).alias(c) for c in (
        "frames_per_second", "processing_rate", "duplicate_rate", "real_time_factor", "compression_ratio")])


_EXPORTS = """
exports AS (SELECT path, view, CASE WHEN ok THEN n_slices - n_slices // 7 ELSE 0 END AS n_exported, CASE WHEN ok THEN n_slices // 7 ELSE 0 END AS n_low
  FROM (SELECT *, least(slice_w, slice_h) >= 64 AND CAST(greatest(slice_w, slice_h) AS DOUBLE) / least(slice_w, slice_h) <= 4 AS ok FROM view_list))"""


def exports(spark, sf):
    """Exported and low-quality slices per volume and view; a seventh counts as low quality."""
    v = O.views_of(V.volume_headers(spark, sf))
    low = F.floor(F.col("n_slices") / 7).cast("int")
    ok = O.view_worth_exporting("slice_w", "slice_h")
    return v.select("path", "view", F.when(ok, F.col("n_slices") - low).otherwise(0).alias("n_exported"),
                    F.when(ok, low).otherwise(0).alias("n_low_quality"))


@query("agg10_volume_run", with_views("view_list", "").rstrip() + "," + _EXPORTS + """
SELECT count(*) AS files_processed, CAST(sum(n) AS BIGINT) AS slices_exported, CAST(sum(low) AS BIGINT) AS low_quality, round(count(*) / 30.0, 9) AS files_per_second,
  round(sum(n) / 30.0, 9) AS slices_per_second, round(CAST(sum(n) AS DOUBLE) / count(*), 9) AS slices_per_file
FROM (SELECT path, sum(n_exported) AS n, sum(n_low) AS low FROM exports GROUP BY path)""")
def agg10(spark, sf):
    t = Q.volume_totals(exports(spark, sf), 30)
    return t.select("files_processed", "slices_exported", "low_quality", *[
        F.round(c, 9).alias(c) for c in ("files_per_second", "slices_per_second", "slices_per_file")])


_VERDICT = """SELECT path, folder, CASE WHEN length < 132 THEN 'file too small' WHEN magic THEN 'ok' ELSE 'not a valid DICOM file' END AS verdict
FROM heads WHERE regexp_matches(lower(path), '\\.dcm$')"""


@query("agg11_dicom_totals", with_views("heads", f"""
SELECT folder, count(*) AS found, count_if(verdict = 'ok') AS ok, count_if(verdict <> 'ok') AS skipped FROM ({_VERDICT}) GROUP BY folder"""))
def agg11(spark, sf):
    return K.dicom_totals(K.dicom_screen(V.file_heads(spark, sf)), "folder")


@query("agg12_highest_numbers", with_views("existing_files", """
SELECT lower(regexp_extract(name, '^(.*)_(\\d+)x(\\d+)_.*\\.png$', 1, 'i')) AS prefix, CAST(regexp_extract(name, '^(.*)_(\\d+)x(\\d+)_.*\\.png$', 2, 'i') AS INT) AS w,
  CAST(regexp_extract(name, '^(.*)_(\\d+)x(\\d+)_.*\\.png$', 3, 'i') AS INT) AS h, max(CAST(regexp_extract(name, '_(\\d+)\\.[a-zA-Z]+$', 1) AS INT)) AS highest
FROM existing_files WHERE regexp_matches(name, '^(.*)_(\\d+)x(\\d+)_.*\\.png$', 'i') GROUP BY 1, 2, 3"""))
def agg12(spark, sf):
    return C.highest_numbers(V.existing_files(spark, sf))


@query("agg13_dropped_frames", with_views("decoder_log", """
SELECT video_id, CAST(sum(coalesce(TRY_CAST(regexp_extract(line, 'drop_count[^:]*:\\s*(\\d+)', 1) AS INT), 0)) AS BIGINT) AS dropped FROM decoder_log GROUP BY video_id"""))
def agg13(spark, sf):
    return R.dropped_totals(V.decoder_log(spark, sf))


@query("agg14_distinct_images_categories", with_views("crops", """
SELECT CASE WHEN trim(annotation) = '' THEN 'unlabeled' ELSE trim(annotation) END AS category, count(*) AS crops, count(DISTINCT image_id) AS images,
  min(l_orderkey) AS first_order FROM crops GROUP BY 1"""))
def agg14(spark, sf):
    """Images are made distinct per category first, so no group holds a set in memory."""
    r = requests(spark, sf).withColumn("category", M.category_name())
    per = r.groupBy("category", "image_id").agg(F.count(F.lit(1)).alias("_n"), F.min("l_orderkey").alias("_o"))
    return per.groupBy("category").agg(F.sum("_n").alias("crops"), F.count(F.lit(1)).alias("images"), F.min("_o").alias("first_order"))


@query("agg15_regions_per_angle", with_views("regions", """
SELECT image_id, angle, 0 AS part, CAST(count(*) AS INT) AS n, round(arg_min(x, (j * nh + i) * 4 + corner), 5) AS first_x, round(arg_max(y, (j * nh + i) * 4 + corner), 5) AS last_y
FROM regions GROUP BY image_id, angle"""))
def agg15(spark, sf):
    plans = Q.rotation_plans_of(V.catalog(spark, sf), 128, 96, ROTATION_ANGLES)
    c = F.col("cropRegions")
    return plans.select("image_id", "angle", "part", F.size(c).alias("n"), F.round(c[0]["x"], 5).alias("first_x"),
                        F.round(F.element_at(c, -1)["y"], 5).alias("last_y"))


@query("agg15_crops_per_manifest", with_views("crops", """
SELECT manifest_id, CAST((rn - 1) // 500 AS INT) AS "exportSequence", CAST(count(*) AS INT) AS count, CAST(sum(w) AS BIGINT) AS total_w, arg_min(l_orderkey, rn) AS first_order
FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY l_orderkey, l_linenumber, image_id, tiebreak) AS rn FROM crops) GROUP BY 1, 2"""))
def agg15_manifests(spark, sf):
    record = F.struct("l_orderkey", "image_id", "x", "y", "w", "h")
    parts = Q.crop_manifest_parts(requests(spark, sf), ["manifest_id"], list(V.CROP_KEY[1:]), record, 500, V.rows(spark, sf, "lineitem"))
    total = F.aggregate("crops", F.lit(0).cast("long"), lambda a, r: a + r["w"].cast("long"))
    return parts.select("manifest_id", "exportSequence", "count", total.alias("total_w"), F.col("crops")[0]["l_orderkey"].alias("first_order"))
