"""Scalar and pixel projections (PRJ-*)."""

from pyspark.sql import functions as F

from framewright.fixtures import views as V
from framewright.fixtures.sql import with_views
from framewright.functions import geometry as G
from framewright.functions import pixels as P
from framewright.functions import text as X
from framewright.operators import crops as C
from framewright.operators import curation as U
from framewright.operators import rotation as T
from framewright.operators import similarity as S
from framewright.operators import volumes as O
from framewright.registry import query
from framewright.registry.filters import distances, requests

IMAGE = ("px", "height", "width", "n_channels")


def _hex(values: str, order: str) -> str:
    return f"string_agg(printf('%02X', CAST({values} AS INT)), '' ORDER BY {order})"


@query("prj1_gray_pixels", with_views("colour", f"""
SELECT image_id, {_hex("g", "y, x")} AS px FROM (
  SELECT image_id, y, x, (77 * max(CASE WHEN c = 2 THEN s END) + 150 * max(CASE WHEN c = 1 THEN s END) + 29 * max(CASE WHEN c = 0 THEN s END) + 128) // 256 AS g
  FROM colour GROUP BY image_id, y, x) GROUP BY image_id"""))
def prj1(spark, sf):
    return V.colour_thumbs(spark, sf).select("image_id", F.hex(P.gray_pixels(*IMAGE)).alias("px"))


@query("prj2_laplacian_variance", with_views("measures", "SELECT image_id, round(var_laplacian, 6) AS var_laplacian FROM measures"))
def prj2(spark, sf):
    return U.measure(V.thumbs(spark, sf)).select("image_id", F.round("var_laplacian", 6).alias("var_laplacian"))


@query("prj3_mean_luma", with_views("measures", "SELECT image_id, round(mean_luma, 6) AS mean_luma FROM measures"))
def prj3(spark, sf):
    return U.measure(V.thumbs(spark, sf)).select("image_id", F.round("mean_luma", 6).alias("mean_luma"))


@query("prj4_difference_hash", with_views("bits", """
SELECT image_id, string_agg(CAST(bit AS VARCHAR), '' ORDER BY pos) AS bits FROM bits GROUP BY image_id"""))
def prj4(spark, sf):
    return U.measure(V.thumbs(spark, sf)).select("image_id", F.lpad(F.bin("dhash"), 64, "0").alias("bits"))


@query("prj5_hamming_distance", with_views("distances", "SELECT a_image_id, b_image_id, distance FROM distances"))
def prj5(spark, sf):
    return distances(spark, sf).select("a_image_id", "b_image_id", "distance")


_COLOUR_PAIRS = """, pp AS (SELECT p.a_image_id, p.b_image_id, a.s AS va, b.s AS vb
  FROM pairs p JOIN colour a ON a.image_id = p.a_image_id JOIN colour b ON b.image_id = p.b_image_id AND a.x = b.x AND a.y = b.y AND a.c = b.c)
SELECT a_image_id, b_image_id, CASE WHEN sum((va-vb)*(va-vb)) = 0 THEN CAST('Infinity' AS DOUBLE)
  ELSE round(10 * log10(65025.0 / (CAST(sum((va-vb)*(va-vb)) AS DOUBLE) / count(*))), 6) END AS psnr FROM pp GROUP BY ALL"""


@query("prj6_psnr", with_views("pairs colour", "") + _COLOUR_PAIRS)
def prj6(spark, sf):
    images = V.colour_thumbs(spark, sf)
    return S.score_pairs(S.consecutive_pairs(images, at_most=V.rows(spark, sf, "embeddings", times=4)), images).select("a_image_id", "b_image_id", F.round("psnr", 6).alias("psnr"))


_GRAY_PAIRS = """, pp AS (SELECT p.a_image_id, p.b_image_id, CAST(a.v AS DOUBLE) AS va, CAST(b.v AS DOUBLE) AS vb
  FROM pairs p JOIN thumbs a ON a.image_id = p.a_image_id JOIN thumbs b ON b.image_id = p.b_image_id AND a.x = b.x AND a.y = b.y)
SELECT a_image_id, b_image_id, round((2*avg(va)*avg(vb) + 6.5025) * (2*covar_samp(va, vb) + 58.5225)
  / ((avg(va)*avg(va) + avg(vb)*avg(vb) + 6.5025) * (var_samp(va) + var_samp(vb) + 58.5225)), 6) AS ssim FROM pp GROUP BY ALL"""


@query("prj7_ssim", with_views("pairs", "") + _GRAY_PAIRS)
def prj7(spark, sf):
    images = V.thumbs(spark, sf)
    return S.score_pairs(S.consecutive_pairs(images, at_most=V.rows(spark, sf, "embeddings", times=4)), images).select("a_image_id", "b_image_id", F.round("ssim", 6).alias("ssim"))


@query("prj8_bilinear_resize", with_views("thumbs", f"""
, ox AS (SELECT o, greatest(0, least(8, (o + 0.5) * 9 / 6 - 0.5)) AS at FROM range(0, 6) AS r(o)),
oy AS (SELECT o, greatest(0, least(7, (o + 0.5) * 8 / 5 - 0.5)) AS at FROM range(0, 5) AS r(o)),
taps AS (SELECT t.image_id, oy.o AS oy, ox.o AS ox,
    sum(t.v * (1 - abs(oy.at - t.y)) * (1 - abs(ox.at - t.x))) AS s
  FROM thumbs t JOIN ox ON abs(ox.at - t.x) < 1 JOIN oy ON abs(oy.at - t.y) < 1 GROUP BY ALL)
SELECT image_id, {_hex("floor(round(s, 9) + 0.5)", "oy, ox")} AS px FROM taps GROUP BY image_id"""))
def prj8(spark, sf):
    return V.thumbs(spark, sf).select("image_id", F.hex(P.resize_pixels(*map(F.col, IMAGE), 5, 6)).alias("px"))


@query("prj9_primary_rectangle", with_views("catalog", """
, p AS (SELECT image_id, width, height, CAST(width // 2 + 1 AS INT) AS dw, CAST(height // 2 + 1 AS INT) AS dh,
  CAST(bytes * 13 % 600 AS INT) AS rx, CAST(bytes * 7 % 500 AS INT) AS ry FROM catalog)
SELECT image_id, CAST(least(greatest(0, floor((rx - 128 / 2.0) * (CAST(width AS DOUBLE) / dw))), width - 128) AS INT) AS x,
  CAST(least(greatest(0, floor((ry - 96 / 2.0) * (CAST(height AS DOUBLE) / dh))), height - 96) AS INT) AS y
FROM p WHERE rx < dw AND ry < dh"""))
def prj9(spark, sf):
    c = V.catalog(spark, sf)
    points = c.select(
        "image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"),
        (F.floor(F.col("width") / 2) + 1).cast("int").alias("disp_w"), (F.floor(F.col("height") / 2) + 1).cast("int").alias("disp_h"),
        (F.col("bytes") * 13 % 600).cast("int").alias("rel_x"), (F.col("bytes") * 7 % 500).cast("int").alias("rel_y"),
        F.lit(128).alias("crop_w"), F.lit(96).alias("crop_h"))
    return C.place_crops(points).select("image_id", "x", "y")


@query("prj10_child_tiles", with_views("crops", """
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, level, CAST(t AS INT) AS tile,
  CAST(x + (t % n) * greatest(1, w // n) AS INT) AS x, CAST(y + (t // n) * greatest(1, h // n) AS INT) AS y,
  CAST(greatest(1, w // n) AS INT) AS w, CAST(greatest(1, h // n) AS INT) AS h
FROM crops CROSS JOIN (VALUES (1, 2), (2, 4)) AS s(level, n), range(0, n * n) AS r(t)"""))
def prj10(spark, sf):
    tiles = C.tile_levels(requests(spark, sf), ((1, 2), (2, 4)))
    return tiles.select(*V.CROP_KEY, "level", "tile", "x", "y", "w", "h")


@query("prj11_corners_normalised", with_views("outcomes", """
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, CAST(x + w - 1 AS INT) AS x2, CAST(y + h - 1 AS INT) AS y2,
  round(CAST(x AS DOUBLE) / image_width, 9) AS nx1, round(CAST(y AS DOUBLE) / image_height, 9) AS ny1,
  round(CAST(x + w - 1 AS DOUBLE) / image_width, 9) AS nx2, round(CAST(y + h - 1 AS DOUBLE) / image_height, 9) AS ny2
FROM outcomes"""))
def prj11(spark, sf):
    from framewright.registry.filters import outcomes
    d = C.describe(outcomes(spark, sf))
    return d.select(*V.CROP_KEY, "x2", "y2", *[F.round(c, 9).alias(c) for c in ("nx1", "ny1", "nx2", "ny2")])


def _boxes(spark, sf):
    """Three boxes per thumbnail, one of them outside."""
    i = F.col("image_id")
    b = F.array(*[F.struct(F.lit(n).alias("box"), x.cast("int").alias("x"), y.cast("int").alias("y"),
                           F.lit(w).alias("w"), F.lit(h).alias("h"))
                  for n, x, y, w, h in ((0, i % 4, i % 3, 5, 4), (1, F.lit(0), F.lit(0), 9, 8), (2, i % 2 + 6, F.lit(1), 3, 2))])
    return V.thumbs(spark, sf).select("image_id", F.inline(b))


@query("prj12_crop_pixels", with_views("thumbs", f"""
SELECT image_id, box, {_hex("v", "y, x")} AS px FROM thumbs t,
  (VALUES (0, 5, 4), (1, 9, 8), (2, 3, 2)) AS b(box, w, h),
  LATERAL (SELECT CASE box WHEN 0 THEN image_id % 4 WHEN 1 THEN 0 ELSE image_id % 2 + 6 END AS bx, CASE box WHEN 0 THEN image_id % 3 WHEN 1 THEN 0 ELSE 1 END AS bby)
WHERE bx + w <= 9 AND bby + h <= 8 AND x >= bx AND x < bx + w AND y >= bby AND y < bby + h GROUP BY image_id, box"""))
def prj12(spark, sf):
    out = C.render(_boxes(spark, sf), V.thumbs(spark, sf), "image_id", ["box"], V.rows(spark, sf, "embeddings", times=12))
    return out.select("image_id", "box", F.hex("px").alias("px"))


_NUMBERED = """, n AS (SELECT *, regexp_replace(CASE WHEN trim(annotation) = '' THEN 'Crop' ELSE annotation END, '[^A-Za-z0-9._-]', '_', 'g') AS prefix FROM crops)"""


@query("prj13_file_names", with_views("crops", "") + _NUMBERED + """
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, prefix || '_' || w || 'x' || h || '_' || lpad(CAST(l_orderkey % 100000 AS VARCHAR), 5, '0') || '.png' AS file_name FROM n""")
def prj13(spark, sf):
    r = requests(spark, sf).withColumn("prefix", X.sanitized("annotation"))
    return r.select(*V.CROP_KEY, X.crop_file_name("prefix", "w", "h", F.col("l_orderkey") % 100000).alias("file_name"))


@query("prj14_sanitised_text", """
SELECT doc_id, CASE WHEN trim(t) = '' THEN 'Crop' ELSE regexp_replace(t, '[^A-Za-z0-9._-]', '_', 'g') END AS clean
FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS t FROM documents)""")
def prj14(spark, sf):
    t = F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", X.sanitized(t).alias("clean"))


@query("prj15_stamps", """
SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def prj15(spark, sf):
    stamped = V.table(spark, sf, "events").select("event_id", X.utc_stamp("ts").alias("stamp"))
    return stamped.select("event_id", "stamp", X.stamp_to_iso("stamp").alias("iso"))


@query("prj16_sha256", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def prj16(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query("prj17_volume_base_name", with_views("volume_headers", """
SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.nii(\\.gz)?$', '', 'i') AS base FROM volume_headers"""))
def prj17(spark, sf):
    return V.volume_headers(spark, sf).select("path", X.volume_base_name(X.file_name("path")).alias("base"))


@query("prj18_storage_keys", with_views("crops", "") + _NUMBERED + """
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, k AS key, 'cloud://images/' || k AS saved_as,
  CASE WHEN trim(annotation) = '' THEN 'image' ELSE annotation END || '/' || w || 'x' || h || '/f.png' AS local_key
FROM n, LATERAL (SELECT prefix || '/' || w || 'x' || h || '/f.png' AS k)""")
def prj18(spark, sf):
    r = requests(spark, sf).withColumn("key", X.storage_key(X.sanitized("annotation"), "w", "h", F.lit("f.png")))
    return r.select(*V.CROP_KEY, "key", X.saved_as("cloud", "images", "key").alias("saved_as"),
                    X.local_key("annotation", "w", "h", F.lit("f.png")).alias("local_key"))


@query("prj19_path_resolution", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 4 = 0 THEN p ELSE '/data/' || o_orderstatus || '/' || p END AS location,
  CASE WHEN o_orderkey % 5 = 0 THEN '/override' WHEN o_orderkey % 7 <> 0 THEN '/m' || o_custkey ELSE '/fallback' END AS sink
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '/abs/' ELSE '' END || 'i' || o_custkey || '.png' AS p FROM orders)""")
def prj19(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    p = F.concat(F.when(o % 3 == 0, "/abs/").otherwise(""), F.lit("i"), c, F.lit(".png"))
    root = F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("/data/"), "o_orderstatus", F.lit("/")))
    override = F.when(o % 5 == 0, "/override").otherwise(" ")
    manifest = F.when(o % 7 != 0, F.concat(F.lit("/m"), c))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", X.image_location(p, root).alias("location"),
        X.sink_location(override, manifest, F.lit("/fallback")).alias("sink"))


_CLAMP = "least(greatest({v}, 0), greatest(1, {side}) - 1)"


@query("prj20_coco_boxes", with_views("outcomes", f"""
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, CASE WHEN trim(annotation) = '' THEN 'unlabeled' ELSE trim(annotation) END AS category,
  CAST(x1 AS INT) AS bx, CAST(y1 AS INT) AS "by", CAST(x2 - x1 AS INT) AS bw, CAST(y2 - y1 AS INT) AS bh, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area
FROM (SELECT *, {_CLAMP.format(v="least(x, x + w - 1)", side="coalesce(image_width, 0)")} AS x1, {_CLAMP.format(v="greatest(x, x + w - 1)", side="coalesce(image_width, 0)")} AS x2,
  {_CLAMP.format(v="least(y, y + h - 1)", side="coalesce(image_height, 0)")} AS y1, {_CLAMP.format(v="greatest(y, y + h - 1)", side="coalesce(image_height, 0)")} AS y2
  FROM outcomes)"""))
def prj20(spark, sf):
    from framewright.operators.coco import category_name
    from framewright.registry.filters import outcomes
    # A crop whose image is not known has a side of 0, which counts as 1.
    d = C.describe(outcomes(spark, sf).fillna(0, ["image_width", "image_height"]))
    b = d.withColumn("b", G.coco_box("x", "y", "x2", "y2", "image_width", "image_height"))
    return b.select(*V.CROP_KEY, category_name().alias("category"), *[F.col("b")[i].alias(n) for i, n in enumerate(("bx", "by", "bw", "bh"))],
                    (F.col("b")[2].cast("double") * F.col("b")[3]).alias("area"))


@query("prj21_rotated_size", with_views("catalog angles", """
SELECT image_id, angle, CAST(trunc(width * abs(cos(radians(angle))) + height * abs(sin(radians(angle)))) AS INT) AS w,
  CAST(trunc(width * abs(sin(radians(angle))) + height * abs(cos(radians(angle)))) AS INT) AS h FROM catalog CROSS JOIN angles"""))
def prj21(spark, sf):
    w, h = G.rotated_size("width", "height", "angle")
    return T.with_angles(V.catalog(spark, sf)).select("image_id", "angle", w.alias("w"), h.alias("h"))


@query("prj21_rotated_pixels", with_views("thumbs", f"""
, turned AS (SELECT image_id, angle, CASE angle WHEN 90 THEN 7 - y ELSE x END AS tx, CASE angle WHEN 90 THEN x ELSE y END AS ty, v
  FROM thumbs CROSS JOIN (VALUES (0), (90)) AS a(angle))
SELECT image_id, angle, {_hex("v", "ty, tx")} AS px FROM turned GROUP BY image_id, angle"""))
def prj21_pixels(spark, sf):
    """Right angles move whole pixels; an odd side is placed at its whole-pixel half."""
    square = V.thumbs(spark, sf)
    turned = T.rotate(T.with_angles(square, (0, 90)))
    return turned.select("image_id", "angle", F.hex("px").alias("px"))


@query("prj22_rotation_geometry", with_views("geometry", """
SELECT image_id, angle, name, round(value, 6) AS value FROM (
  SELECT image_id, angle, h, h1, Ya, x0, x1, dy AS delta_y, y1, Xb AS xb, x2, y2, xmax, x3, Yc, y3, Xd, Yd, x4, y4, ymax FROM geometry)
UNPIVOT (value FOR name IN (h, h1, Ya, x0, x1, delta_y, y1, xb, x2, y2, xmax, x3, Yc, y3, Xd, Yd, x4, y4, ymax))"""))
def prj22(spark, sf):
    g = T.with_geometry(T.with_angles(V.catalog(spark, sf)), 128, 96).withColumn("m", T.geometry_map())
    # The box entry carries another capital in each angle branch; compare one spelling.
    rows = g.select("image_id", "angle", F.explode("m").alias("name", "value"))
    return rows.select("image_id", "angle", F.when(F.col("name") == "Xb", "xb").otherwise(F.col("name")).alias("name"),
                       F.round("value", 6).alias("value"))


@query("prj23_rotated_regions", with_views("regions", """
SELECT image_id, angle, CAST(j AS INT) AS j, CAST(i AS INT) AS i, corner, round(x, 5) AS x, round(y, 5) AS y FROM regions"""))
def prj23(spark, sf):
    r = T.tile_regions(T.with_angles(V.catalog(spark, sf)), 128, 96)
    return r.select("image_id", "angle", "j", "i", "corner", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("prj24_black_to_transparent", with_views("colour", """
SELECT image_id, string_agg(CASE WHEN b = 0 AND g = 0 AND r = 0 THEN '00000000' ELSE printf('%02X%02X%02XFF', b, g, r) END, '' ORDER BY y, x) AS px FROM (
  SELECT image_id, y, x, CAST(max(CASE WHEN c = 0 THEN s END) AS INT) AS b, CAST(max(CASE WHEN c = 1 THEN s END) AS INT) AS g, CAST(max(CASE WHEN c = 2 THEN s END) AS INT) AS r
  FROM colour GROUP BY image_id, y, x) GROUP BY image_id"""))
def prj24(spark, sf):
    return V.colour_thumbs(spark, sf).select("image_id", F.hex(P.black_to_transparent(*IMAGE)).alias("px"))


@query("prj25_flips", with_views("thumbs", f"""
SELECT image_id, flip, CASE flip WHEN 'Flipped horizontal' THEN {_hex("v", "y, 8 - x")} WHEN 'Flipped vertical' THEN {_hex("v", "7 - y, x")} ELSE {_hex("v", "7 - y, 8 - x")} END AS px
FROM thumbs CROSS JOIN (VALUES ('Flipped horizontal'), ('Flipped vertical'), ('Flipped both')) AS f(flip) GROUP BY image_id, flip"""))
def prj25(spark, sf):
    return T.flips(V.thumbs(spark, sf)).select("image_id", "flip", F.hex("px").alias("px"))


@query("prj26_slices_along_axes", with_views("view_voxels", """
SELECT volume_id, view, CAST(idx AS INT) AS "index", CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) END AS v FROM view_voxels"""))
def prj26(spark, sf):
    s = O.all_views(V.voxel_slices(spark, sf)).select("volume_id", "view", "index", "width", F.posexplode("vox").alias("p", "v"))
    return s.select("volume_id", "view", "index", F.floor(F.col("p") / F.col("width")).cast("int").alias("r"),
                    F.pmod("p", "width").alias("c"), F.round(F.nanvl("v", F.lit(None).cast("double")), 6).alias("v"))


@query("prj27_normalised_voxels", with_views("normalised", """
SELECT volume_id, CAST(idx AS INT) AS z, CAST(r * 8 + c AS INT) AS p, round(n, 9) AS n FROM normalised WHERE view = 'axial'"""))
def prj27(spark, sf):
    s = O.normalise_slices(V.voxel_slices(spark, sf)).select("volume_id", "z", F.posexplode("vox").alias("p", "n"))
    return s.select("volume_id", "z", "p", F.round("n", 9).alias("n"))


@query("prj28_quantised_slices", with_views("gray", f"""
SELECT volume_id, CAST(idx AS INT) AS z, {_hex("p", "r, c")} AS px FROM gray WHERE view = 'axial' GROUP BY volume_id, idx"""))
def prj28(spark, sf):
    return O.gray_slices(V.voxel_slices(spark, sf)).select("volume_id", "z", F.hex("px").alias("px"))


@query("prj29_voxel_to_world", with_views("volume_headers", """
SELECT path, CASE WHEN doc_id % 3 = 0 THEN 1.5 * i - 10 - n_chars % 7 ELSE i END AS wx, CASE WHEN doc_id % 3 = 0 THEN 2 * j + 0.25 * k - 20 - n_chars % 7 ELSE j END AS wy,
  CASE WHEN doc_id % 3 = 0 THEN 0.5 * j + 3 * k + 5 - n_chars % 7 ELSE k END AS wz
FROM (SELECT *, CAST(d1 - 1 AS DOUBLE) AS i, CAST(d2 - 1 AS DOUBLE) AS j, CAST(d3 - 1 AS DOUBLE) AS k FROM volume_headers)"""))
def prj29(spark, sf):
    h = V.volume_headers(spark, sf)
    last = [F.col("dim")[n] - 1 for n in (1, 2, 3)]
    x, y, z = G.voxel_to_world(*last, rows=("srow_x", "srow_y", "srow_z"))
    return h.select("path", x.alias("wx"), y.alias("wy"), z.alias("wz"))


@query("prj30_voxel_counts", with_views("volume_headers", """
SELECT path, CAST(n AS BIGINT) AS voxels, CAST(n * (bitpix // 8) AS BIGINT) AS bytes FROM (SELECT *, d1 * d2 * d3 * d4 AS n FROM volume_headers)"""))
def prj30(spark, sf):
    h = V.volume_headers(spark, sf).withColumn("voxels", G.voxel_count("dim"))
    return h.select("path", "voxels", (F.col("voxels") * F.floor(F.col("bitpix") / 8)).cast("long").alias("bytes"))


CURVE = [(0.0, 0.0), (0.25, 0.1), (0.5, 0.8), (1.0, 1.0)]


@query("prj31_intensity_curve", """
SELECT event_id, round(CASE WHEN v <= 0.25 THEN v / 0.25 * 0.1 WHEN v <= 0.5 THEN 0.1 + (v - 0.25) / 0.25 * 0.7 ELSE 0.8 + (v - 0.5) / 0.5 * 0.2 END, 9) AS mapped
FROM (SELECT event_id, greatest(0, least(1, value / 200)) AS v FROM events)""")
def prj31(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", F.round(G.intensity_curve(F.col("value") / 200, CURVE), 9).alias("mapped"))


@query("prj32_slice_position", with_views("dicom_tags", """
SELECT path, coalesce(slice_location, position_z, 0) AS position FROM dicom_tags"""))
def prj32(spark, sf):
    return V.dicom_tags(spark, sf).select("path", O.slice_position().alias("position"))


@query("prj33_export_names", with_views("catalog", """
SELECT path, 'exp_' || regexp_replace(n, '^(.+)\\.[^.]*$', '\\1') || '.png' AS output
FROM (SELECT path, regexp_replace(path, '^.*/', '') AS n FROM catalog)"""))
def prj33(spark, sf):
    return V.catalog(spark, sf).select("path", X.export_name(F.lit(" exp_ "), X.file_name("path"), "png").alias("output"))
