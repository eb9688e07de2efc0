"""Joins and pairings (JON-*), sorts (SRT-*) and set operations (SET-*)."""

from pyspark.sql import functions as F

from framewright.constants import SIMILARITY_PRESETS
from framewright.fixtures import views as V
from framewright.fixtures.sql import with_views
from framewright.functions import text as X
from framewright.operators import catalog as K
from framewright.operators import crops as C
from framewright.operators import curation as U
from framewright.operators import frames as R
from framewright.operators import similarity as S
from framewright.operators import volumes as O
from framewright.plans.spread import in_tasks
from framewright.registry import query
from framewright.registry.filters import distances, outcomes, requests


@query("jon1_consecutive_dhash", with_views("distances", "SELECT folder, a_image_id, a_name, b_image_id, b_name, distance FROM distances"))
def jon1(spark, sf):
    return distances(spark, sf)


@query("jon2_crops_with_images", with_views("outcomes", """
SELECT manifest_id, image_id, count(*) AS crops, count_if(outcome = 'done') AS ok, count_if(outcome <> 'done') AS failed FROM outcomes GROUP BY manifest_id, image_id"""))
def jon2(spark, sf):
    done = F.col("outcome") == "done"
    # Almost every row is a group, so what a task gathers before the shuffle grows with its rows.
    return in_tasks(outcomes(spark, sf).select("manifest_id", "image_id", "outcome"), V.rows(spark, sf, "lineitem")).groupBy("manifest_id", "image_id").agg(
        F.count(F.lit(1)).alias("crops"), F.count_if(done).alias("ok"), F.count_if(~done).alias("failed"))


@query("jon3_frames_in_segments", with_views("matched", "SELECT video_id, seg, frame_id, pts_s FROM matched"))
def jon3(spark, sf):
    return R.frames_in_segments(V.frames(spark, sf), V.segments(spark, sf)).select("video_id", "seg", "frame_id", "pts_s")


@query("jon4_pending_manifests", with_views("manifests", "SELECT manifest_id, path FROM manifests WHERE NOT done"))
def jon4(spark, sf):
    m = V.manifests(spark, sf)
    return K.pending(m, m.where("done")).select("manifest_id", "path")


def _plan(spark, sf):
    o = V.objects(spark, sf)
    local = o.where("mirrored").select("key", F.col("local_size").alias("size"))
    return K.sync_plan(o.select("key", "size"), local, at_most=V.rows(spark, sf, "pages"))


_PLAN = """SELECT key, size, CASE WHEN mirrored AND local_size > 0 THEN 'skip' WHEN size > 0 THEN 'download' ELSE 'failed' END AS action FROM objects"""


@query("jon5_sync_plan", with_views("objects", _PLAN))
def jon5(spark, sf):
    return _plan(spark, sf).select("key", "size", "action")


@query("jon5_sync_totals", with_views("objects", f"""
SELECT count(*) AS total, count_if(action = 'download') AS downloaded, count_if(action = 'skip') AS skipped, count_if(action = 'failed') AS failed FROM ({_PLAN})"""))
def jon5_totals(spark, sf):
    return K.sync_totals(_plan(spark, sf))


@query("jon6_series_members", with_views("dicom_tags", """
SELECT CASE WHEN series_uid <> '' THEN series_uid ELSE 'dir:' || parent END AS series, count(*) AS files, min(path) AS first_path, max(path) AS last_path FROM dicom_tags GROUP BY 1"""))
def jon6(spark, sf):
    return V.dicom_tags(spark, sf).groupBy(O.series_key().alias("series")).agg(
        F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def collision_crops(spark, sf):
    """Crops with the prefixes and sizes of files that exist, some asking for a name."""
    n = F.col("l_orderkey")
    size = F.element_at(F.array(F.lit(64), F.lit(128), F.lit(200)), (n % 3 + 1).cast("int"))
    side = F.element_at(F.array(F.lit(64), F.lit(64), F.lit(160)), (n % 3 + 1).cast("int"))
    status = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("manifest_id"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("image_id"),
        F.col("l_extendedprice").alias("tiebreak"), F.concat(F.lit("/sink/"), status).alias("sink"), F.lit("LOW").alias("prefix"),
        size.alias("w"), side.alias("h"),
        F.when(n % 10 == 0, F.concat(F.lit("old/LOW_64x64_"), F.lpad((n % 900).cast("string"), 5, "0"), F.lit(".png"))).alias("saved_as"))


_COLLISION = """
, c AS (SELECT l_suppkey AS manifest_id, l_orderkey, l_linenumber, l_partkey AS image_id, l_extendedprice AS tiebreak,
    '/sink/' || CASE l_suppkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS sink, 'LOW' AS prefix,
    CASE l_orderkey % 3 WHEN 0 THEN 64 WHEN 1 THEN 128 ELSE 200 END AS w, CASE l_orderkey % 3 WHEN 0 THEN 64 WHEN 1 THEN 64 ELSE 160 END AS h,
    CASE WHEN l_orderkey % 10 = 0 THEN 'LOW_64x64_' || lpad(CAST(l_orderkey % 900 AS VARCHAR), 5, '0') || '.png' END AS want FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sink, want ORDER BY manifest_id, l_orderkey, l_linenumber, image_id, tiebreak) AS k FROM c),
marked AS (SELECT *, want IS NOT NULL AND k = 1 AND NOT EXISTS (SELECT 1 FROM existing_files e WHERE e.sink = r.sink AND e.name = r.want) AS kept FROM ranked r),
taken AS (SELECT DISTINCT sink, name FROM existing_files UNION SELECT sink, want FROM marked WHERE kept),
used AS (SELECT DISTINCT sink, CAST(regexp_extract(name, '^LOW_(\\d+)x(\\d+)_(\\d{5,})\\.png$', 1) AS INT) AS w,
    CAST(regexp_extract(name, '^LOW_(\\d+)x(\\d+)_(\\d{5,})\\.png$', 2) AS INT) AS h, CAST(regexp_extract(name, '^LOW_(\\d+)x(\\d+)_(\\d{5,})\\.png$', 3) AS BIGINT) AS n
  FROM taken WHERE regexp_matches(name, '^LOW_(\\d+)x(\\d+)_(\\d{5,})\\.png$')),
slots AS (SELECT g.sink, g.w, g.h, s.n FROM (SELECT sink, w, h, count(*) AS m FROM marked WHERE NOT kept GROUP BY ALL) g,
  LATERAL (SELECT unnest(range(1, g.m + 20000)) AS n) s),
free AS (SELECT s.*, row_number() OVER (PARTITION BY sink, w, h ORDER BY n) AS r FROM slots s ANTI JOIN used u USING (sink, w, h, n)),
asks AS (SELECT *, row_number() OVER (PARTITION BY sink, w, h ORDER BY manifest_id, l_orderkey, l_linenumber, image_id, tiebreak) AS r FROM marked WHERE NOT kept)
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, sink, want AS file_name FROM marked WHERE kept
UNION ALL
SELECT a.manifest_id, a.l_orderkey, a.l_linenumber, a.image_id, a.tiebreak, a.sink, 'LOW_' || a.w || 'x' || a.h || '_' || lpad(CAST(f.n AS VARCHAR), 5, '0') || '.png'
FROM asks a JOIN free f USING (sink, w, h, r)"""


@query("jon7_name_collisions", with_views("existing_files", "") + _COLLISION)
def jon7(spark, sf):
    named = C.assign_output_names(collision_crops(spark, sf), V.existing_files(spark, sf), V.CROP_KEY,
                                 at_most=V.rows(spark, sf, "lineitem", "orders"))
    return named.select(*V.CROP_KEY, "sink", "file_name")


@query("jon8_options_to_rows", with_views("distances", """
SELECT a_image_id, b_image_id, preset, distance <= m AS near_duplicate FROM distances CROSS JOIN (VALUES ('Loose', 8), ('Medium', 5), ('Strict', 3)) AS p(preset, m)"""))
def jon8(spark, sf):
    presets = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(d).alias("dhash_max")) for n, d, _, _ in SIMILARITY_PRESETS])
    each = distances(spark, sf).select("*", F.inline(presets))
    return each.select("a_image_id", "b_image_id", "preset", (F.col("distance") <= F.col("dhash_max")).alias("near_duplicate"))


@query("srt1_names_ignoring_case", with_views("existing_files", """
SELECT name, sink, row_number() OVER (ORDER BY lower(name), name, sink) AS position FROM (SELECT DISTINCT sink, name FROM existing_files)"""))
def srt1(spark, sf):
    from framewright.plans.ordered import number_rows
    listing = V.existing_files(spark, sf).distinct()
    return number_rows(listing, [], [*X.ignoring_case("name"), F.col("sink")], "position", at_most=V.rows(spark, sf, "orders")).select(
        "name", "sink", "position")


@query("srt2_index_head", with_views("objects", """
SELECT key FROM objects WHERE starts_with(key, 'Images/') AND regexp_matches(lower(key), '\\.(png|jpe?g|bmp|gif)$') ORDER BY lower(key), key LIMIT 25"""))
def srt2(spark, sf):
    return K.head_of(K.image_index(V.objects(spark, sf), "/store/Images", "store"), 25).select("key")


@query("srt3_slice_order", with_views("dicom_tags", """
SELECT path, coalesce(slice_location, position_z, 0) AS position FROM dicom_tags ORDER BY position, path"""))
def srt3(spark, sf):
    return V.dicom_tags(spark, sf).select("path", O.slice_position().alias("position")).orderBy("position", "path")


_PRIMARY = "(SELECT image_id, CAST(width // 2 AS INT) AS x, CAST(height // 3 AS INT) AS y, 256 AS w, 160 AS h FROM catalog)"
_TILES = f"""
SELECT image_id, 0 AS level, 0 AS tile, x, y, w, h FROM {_PRIMARY}
UNION ALL SELECT image_id, lv, CAST(t AS INT), CAST(x + (t % n) * (w // n) AS INT), CAST(y + (t // n) * (h // n) AS INT), CAST(w // n AS INT), CAST(h // n AS INT)
FROM {_PRIMARY} CROSS JOIN (VALUES (1, 2), (2, 4)) AS s(lv, n), range(0, n * n) AS r(t)"""


def primaries(spark, sf):
    return V.catalog(spark, sf).select(
        "image_id", F.floor(F.col("width") / 2).cast("int").alias("x"), F.floor(F.col("height") / 3).cast("int").alias("y"),
        F.lit(256).alias("w"), F.lit(160).alias("h"))


def tiles(spark, sf):
    return C.tile_levels(primaries(spark, sf)).select("image_id", "level", "tile", "x", "y", "w", "h")


@query("set1_crop_levels_union", with_views("catalog", _TILES))
def set1(spark, sf):
    return tiles(spark, sf)


@query("set2_views_union", with_views("view_voxels", """
SELECT volume_id, view, CAST(idx AS INT) AS "index", CAST(count(*) AS INT) AS n, round(sum(CASE WHEN isnan(v) THEN 0 ELSE v END), 3) AS total,
  count_if(isnan(v)) AS n_nan FROM view_voxels GROUP BY volume_id, view, idx"""))
def set2(spark, sf):
    s = O.all_views(V.voxel_slices(spark, sf))
    zero = F.transform("vox", lambda v: F.nanvl(v, F.lit(0.0)))
    return s.select(
        "volume_id", "view", "index", F.size("vox").alias("n"),
        F.round(F.aggregate(zero, F.lit(0.0), lambda a, v: a + v), 3).alias("total"),
        F.size(F.filter("vox", F.isnan)).cast("long").alias("n_nan"))


@query("set3_unique_files", with_views("catalog", """
SELECT DISTINCT path FROM catalog"""))
def set3(spark, sf):
    c = V.catalog(spark, sf)
    return K.add_unique(c.select("path"), c.select("path"))


@query("set4_multi_scale", with_views("catalog", f"""
SELECT level, w || 'x' || h AS size, count(*) AS tiles FROM ({_TILES}) GROUP BY level, size"""))
def set4(spark, sf):
    return tiles(spark, sf).groupBy("level", X.size_label("w", "h").alias("size")).agg(F.count(F.lit(1)).alias("tiles"))
