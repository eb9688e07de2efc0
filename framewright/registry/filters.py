"""Predicates and filters (FIL-*)."""

from pyspark.sql import functions as F

from framewright.fixtures import views as V
from framewright.fixtures.sql import with_views
from framewright.operators import catalog as K
from framewright.operators import crops as C
from framewright.operators import curation as U
from framewright.operators import frames as R
from framewright.operators import similarity as S
from framewright.operators import volumes as O
from framewright.registry import query


@query("fil1_blur_rule", with_views("measures", """
SELECT image_id, round(var_laplacian, 6) AS var_laplacian, var_laplacian < 120 AS blurry FROM measures"""))
def fil1(spark, sf):
    m = U.measure(V.thumbs(spark, sf))
    return m.select("image_id", F.round("var_laplacian", 6).alias("var_laplacian"), U.blurry().alias("blurry"))


@query("fil2_dark_rule", with_views("measures", """
SELECT image_id, round(mean_luma, 6) AS mean_luma, mean_luma < 20 AS dark FROM measures"""))
def fil2(spark, sf):
    m = U.measure(V.thumbs(spark, sf))
    return m.select("image_id", F.round("mean_luma", 6).alias("mean_luma"), U.dark().alias("dark"))


@query("fil3_decision_reason", with_views("measures", """
SELECT image_id, folder, name, trim(CASE WHEN var_laplacian < 120 THEN 'blurry ' ELSE '' END || CASE WHEN mean_luma < 20 THEN 'dark' ELSE '' END) AS reason,
  CASE WHEN var_laplacian < 120 OR mean_luma < 20 THEN 'drop' ELSE 'keep' END AS decision FROM measures"""))
def fil3(spark, sf):
    return U.decide(U.measure(V.thumbs(spark, sf))).select("image_id", "folder", "name", "reason", "decision")


@query("fil4_focus_presets", with_views("measures", """
SELECT image_id, preset, var_laplacian >= threshold AS sharp_enough
FROM measures CROSS JOIN (VALUES ('loose', 80), ('medium', 120), ('strict', 180)) AS p(preset, threshold)"""))
def fil4(spark, sf):
    return U.focus_flags(U.measure(V.thumbs(spark, sf))).select("image_id", "preset", "sharp_enough")


_SCORES = """
pixel_pairs AS (SELECT p.a_image_id, p.b_image_id, a.v AS va, b.v AS vb
  FROM pairs p JOIN thumbs a ON a.image_id = p.a_image_id JOIN thumbs b ON b.image_id = p.b_image_id AND a.x = b.x AND a.y = b.y),
scores AS (SELECT a_image_id, b_image_id,
    CASE WHEN sum((va-vb)*(va-vb)) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(65025.0 / (CAST(sum((va-vb)*(va-vb)) AS DOUBLE) / count(*))) END AS psnr,
    (2*avg(va)*avg(vb) + 6.5025) * (2*covar_samp(va, vb) + 58.5225) / ((avg(va)*avg(va) + avg(vb)*avg(vb) + 6.5025) * (var_samp(va) + var_samp(vb) + 58.5225)) AS ssim
  FROM pixel_pairs GROUP BY ALL)"""


def _views_and(extra: str, names: str, body: str) -> str:
    return with_views(names, "").rstrip() + "," + extra + body


@query("fil5_near_duplicate_by_metric", _views_and(_SCORES, "pairs distances", """
SELECT d.a_image_id, d.b_image_id, metric, CASE metric WHEN 'DHASH' THEN distance <= 5 WHEN 'PSNR' THEN psnr >= 40 ELSE ssim >= 0.98 END AS near_duplicate
FROM distances d JOIN scores s USING (a_image_id, b_image_id) CROSS JOIN (VALUES ('DHASH'), ('PSNR'), ('SSIM')) AS m(metric)"""))
def fil5(spark, sf):
    images = V.thumbs(spark, sf)
    scored = S.score_pairs(distances(spark, sf), images)
    each = scored.withColumn("metric", F.explode(F.array(F.lit("DHASH"), F.lit("PSNR"), F.lit("SSIM"))))
    return each.select("a_image_id", "b_image_id", "metric",
                       S.is_near(F.col("metric"), "distance", "psnr", "ssim").alias("near_duplicate"))


@query("fil6_threshold_presets", """
SELECT p_partkey AS run_id, CASE WHEN d = 8 AND p = 35 AND abs(s - 0.95) < 1e-9 THEN 'Loose' WHEN d = 5 AND p = 40 AND abs(s - 0.98) < 1e-9 THEN 'Medium'
  WHEN d = 3 AND p = 45 AND abs(s - 0.99) < 1e-9 THEN 'Strict' ELSE 'Custom' END AS preset
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 8 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 10 END AS d,
  CASE p_size % 4 WHEN 0 THEN 35.0 WHEN 1 THEN 40.0 WHEN 2 THEN 45.0 ELSE 30.0 END AS p,
  CAST(CASE p_partkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.98 ELSE 0.99 END AS DOUBLE) AS s FROM part)""")
def fil6(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")

    def pick(c, n, *values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (c % n + 1).cast("int"))

    d, p, s = pick(size, 4, 8, 5, 3, 10), pick(size, 4, 35.0, 40.0, 45.0, 30.0), pick(key, 3, 0.95, 0.98, 0.99)
    return V.table(spark, sf, "part").select(key.alias("run_id"), S.preset_name(d, p, s).alias("preset"))


@query("fil7_large_enough", with_views("catalog", """
SELECT folder, count_if(width >= 256 AND height >= 128) AS usable, count_if(NOT (width >= 256 AND height >= 128)) AS too_small FROM catalog GROUP BY folder"""))
def fil7(spark, sf):
    fits = C.large_enough(V.catalog(spark, sf), 256, 128)
    return V.catalog(spark, sf).groupBy("folder").agg(F.count_if(fits).alias("usable"), F.count_if(~fits).alias("too_small"))


def distances(spark, sf):
    return S.hash_distances(U.measure(V.thumbs(spark, sf)), at_most=V.rows(spark, sf, "embeddings", times=4))


def requests(spark, sf):
    r = V.crop_requests(spark, sf)
    return C.normalise_requests(r.withColumns({"default_w": F.lit(V.DEFAULT_W), "default_h": F.lit(V.DEFAULT_H)}))


def outcomes(spark, sf, keep=()):
    return C.crop_outcomes(requests(spark, sf), V.catalog(spark, sf), salt_by=V.CROP_KEY, at_most=V.rows(spark, sf, "lineitem"), keep=keep)


@query("fil8_crop_bounds", with_views("outcomes", """
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, x, y, w, h, outcome = 'done' AS in_bounds FROM outcomes"""))
def fil8(spark, sf):
    return outcomes(spark, sf).select(*V.CROP_KEY, "x", "y", "w", "h", (F.col("outcome") == "done").alias("in_bounds"))


@query("fil9_view_worth", with_views("view_list", """
SELECT path, view, slice_w, slice_h, least(slice_w, slice_h) >= 64 AND CAST(greatest(slice_w, slice_h) AS DOUBLE) / least(slice_w, slice_h) <= 4 AS worth FROM view_list"""))
def fil9(spark, sf):
    v = O.views_of(V.volume_headers(spark, sf))
    return v.select("path", "view", "slice_w", "slice_h", O.view_worth_exporting("slice_w", "slice_h").alias("worth"))


@query("fil10_slice_content", with_views("gray", """
SELECT volume_id, view, CAST(idx AS INT) AS "index", round(sqrt(greatest(0, q / n - (s / n) * (s / n))), 6) AS stddev, round(d / n, 6) AS dark_share,
  sqrt(greatest(0, q / n - (s / n) * (s / n))) >= 5 AND d / n <= 0.95 AS worth
FROM (SELECT volume_id, view, idx, CAST(sum(p) AS DOUBLE) AS s, CAST(sum(p*p) AS DOUBLE) AS q, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(p < 10) AS DOUBLE) AS d
      FROM gray GROUP BY ALL)"""))
def fil10(spark, sf):
    g = O.slice_content(O.gray_slices(O.all_views(V.voxel_slices(spark, sf))))
    return g.select("volume_id", "view", "index", F.round("stddev", 6).alias("stddev"),
                    F.round("dark_share", 6).alias("dark_share"), "worth")


@query("fil11_scene_change", with_views("frames", "SELECT video_id, frame_id, scene FROM frames WHERE scene > 0.02"))
def fil11(spark, sf):
    return V.frames(spark, sf).where(R.scene_change()).select("video_id", "frame_id", "scene")


@query("fil12_bright_frames", with_views("frames", "SELECT video_id, frame_id, y_avg FROM frames WHERE y_avg > 20"))
def fil12(spark, sf):
    return V.frames(spark, sf).where(R.bright()).select("video_id", "frame_id", "y_avg")


# The walk over kept frames as SQL: one step per frame of a video.
WALK = """
leveled AS (SELECT *, {levels}, row_number() OVER (PARTITION BY video_id ORDER BY pts_s, frame_id) AS rn FROM {source}),
walk AS (
  SELECT video_id, rn, frame_id, pts_s, true AS kept, l0, l1, l2, l3 FROM leveled WHERE rn = 1
  UNION ALL
  SELECT n.video_id, n.rn, n.frame_id, n.pts_s, NOT same, CASE WHEN same THEN w.l0 ELSE n.l0 END, CASE WHEN same THEN w.l1 ELSE n.l1 END,
    CASE WHEN same THEN w.l2 ELSE n.l2 END, CASE WHEN same THEN w.l3 ELSE n.l3 END
  FROM walk w JOIN leveled n ON n.video_id = w.video_id AND n.rn = w.rn + 1,
  LATERAL (SELECT greatest(abs(n.l0-w.l0), abs(n.l1-w.l1), abs(n.l2-w.l2), abs(n.l3-w.l3)) * 64 <= 512
    AND CAST(abs(n.l0-w.l0) * 64 > 192 AS INT) + CAST(abs(n.l1-w.l1) * 64 > 192 AS INT) + CAST(abs(n.l2-w.l2) * 64 > 192 AS INT)
      + CAST(abs(n.l3-w.l3) * 64 > 192 AS INT) <= 0.3 * 4 AS same))"""
_LEVELS = ", ".join(
    f"CAST(100 + (frame_id // 400) * {k + 1} % 5 * 2 + CASE WHEN y_avg > 60 THEN 20 ELSE 0 END AS INT) AS l{k}" for k in range(4))


def walk_sql(source: str, body: str) -> str:
    text = with_views("frames", "").rstrip() + "," + WALK.format(levels=_LEVELS, source=source) + body
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("fil13_rule_order", walk_sql("(SELECT * FROM frames WHERE scene > 0.02 AND y_avg > 20)", """
SELECT video_id, CAST(floor(pts_s * 0.0005) AS BIGINT) AS slot, min(frame_id) AS frame_id FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, floor(pts_s * 0.0005) ORDER BY pts_s, frame_id) AS k FROM walk WHERE kept) WHERE k = 1 GROUP BY ALL"""))
def fil13(spark, sf):
    out = R.select_frames(V.pixel_frames(spark, sf), fps=0.0005, at_most=V.rows(spark, sf, "events"))
    return out.select("video_id", "slot", "frame_id")


@query("fil14_mode_validation", with_views("volume_headers", """
SELECT path, CASE WHEN ndim < 2 THEN 'unsupported dimension ' || ndim END AS multi_view_skip,
  CASE WHEN 2 >= ndim THEN 'dimension 2 is invalid for ' || ndim || 'D' END AS axis2_skip FROM volume_headers"""))
def fil14(spark, sf):
    both = O.mode_check(V.volume_headers(spark, sf), None).withColumnRenamed("skip_reason", "multi_view_skip")
    return O.mode_check(both, 2).select("path", "multi_view_skip", F.col("skip_reason").alias("axis2_skip"))


@query("fil15_segment_validation", """
SELECT o_orderkey AS segment_id, s AS start_s, e AS end_s, s < 0 OR e < 0 AS is_full
FROM (SELECT o_orderkey, CAST(o_custkey % 120 - 5 AS INT) AS s, CAST(o_orderkey % 100 AS INT) AS e FROM orders) WHERE e >= s OR s < 0 OR e < 0""")
def fil15(spark, sf):
    s = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("segment_id"), (F.col("o_custkey") % 120 - 5).cast("int").alias("start_s"),
        (F.col("o_orderkey") % 100).cast("int").alias("end_s"))
    return R.valid_segments(s).withColumn("is_full", R.whole_video())
