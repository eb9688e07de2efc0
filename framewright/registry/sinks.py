"""Documents and plans that sinks write (SNK-*)."""

from pyspark.sql import functions as F

from framewright.constants import ROTATION_ANGLES
from framewright.fixtures import views as V
from framewright.fixtures.sql import with_views
from framewright.functions import text as X
from framewright.operators import catalog as K
from framewright.operators import coco as M
from framewright.operators import crops as C
from framewright.operators import curation as U
from framewright.operators import reports as Q
from framewright.operators import rotation as T
from framewright.operators import volumes as O
from framewright.registry import query
from framewright.registry.aggregates import _EXPORTS, _RUNS, _VERDICT, exports, runs
from framewright.registry.filters import outcomes, requests
from framewright.registry.windows import _IDS, coco_rows
from framewright.operators import frames as R
from framewright.sinks import documents as D
from framewright.session import cut_lineage, work_folder
from framewright.sinks.png import encode_png, write_files
from framewright.sources.manifests import read_crop_manifests


@query("snk1_curation_manifest", with_views("measures", """
SELECT name AS filename, 9 AS width, 8 AS height, CAST(72 AS BIGINT) AS bytes, sha256(name) AS sha256, round(var_laplacian, 6) AS var_laplacian, round(mean_luma, 6) AS mean_luma, 'curation' AS metric,
  CASE WHEN var_laplacian < 120 OR mean_luma < 20 THEN 'drop' ELSE 'keep' END AS decision,
  trim(CASE WHEN var_laplacian < 120 THEN 'blurry ' ELSE '' END || CASE WHEN mean_luma < 20 THEN 'dark' ELSE '' END) AS reason FROM measures"""))
def snk1(spark, sf):
    images = V.thumbs(spark, sf).withColumns({
        "bytes": F.length("px").cast("long"), "sha256": F.sha2(F.col("name").cast("binary"), 256), "near_duplicate": F.lit(None).cast("boolean")})
    rows = U.curation_rows(U.decide(U.measure(images)))
    return rows.select("filename", "width", "height", "bytes", "sha256", F.round("var_laplacian", 6).alias("var_laplacian"),
                       F.round("mean_luma", 6).alias("mean_luma"), "metric", "decision", "reason")


@query("snk2_crop_manifest_json", with_views("crops", """
SELECT '{"manifest_id":' || manifest_id || ',"exportSequence":' || ((rn - 1) // 400) || ',"count":' || count(*) || ',"crops":[' ||
  string_agg('{"image":' || image_id || ',"cropX1":' || x || ',"cropY1":' || y || ',"cropWidth":' || w || ',"cropHeight":' || h || '}', ',' ORDER BY rn) || ']}' AS document
FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY l_orderkey, l_linenumber, image_id, tiebreak) AS rn FROM crops) GROUP BY manifest_id, (rn - 1) // 400"""))
def snk2(spark, sf):
    record = F.struct(F.col("image_id").alias("image"), F.col("x").alias("cropX1"), F.col("y").alias("cropY1"),
                      F.col("w").alias("cropWidth"), F.col("h").alias("cropHeight"))
    return D.json_rows(Q.crop_manifest_parts(requests(spark, sf), ["manifest_id"], list(V.CROP_KEY[1:]), record, 400, V.rows(spark, sf, "lineitem")))


@query("snk2_written_crop_manifests", with_views("outcomes", """
SELECT manifest_id, CAST((rn - 1) // 400 AS INT) AS "exportSequence", CAST((rn - 1) % 400 AS INT) AS place, 'p' AS project, 'u' AS "user", '/src' AS "sourceDir", '/snk/' || manifest_id AS "sinkDir",
  's' || manifest_id AS "sessionId", 256 AS dw, 128 AS dh, '2024-01-01T00:00:00Z' AS "exportedAtUtc", CAST(count(*) OVER (PARTITION BY manifest_id, (rn - 1) // 400) AS INT) AS count,
  'img_' || image_id || '.png' AS "imageName", '/src/img_' || image_id || '.png' AS "imagePath", image_width AS "imageWidth", image_height AS "imageHeight", x AS "cropX1", y AS "cropY1",
  x + w - 1 AS "cropX2", y + h - 1 AS "cropY2", w AS "cropWidth", h AS "cropHeight", annotation, round(CAST(x AS DOUBLE) / image_width, 6) AS nx1, round(CAST(y + h - 1 AS DOUBLE) / image_height, 6) AS ny2,
  l_linenumber = 1 AS designated, CASE WHEN l_linenumber = 2 THEN w || 'x' || h END AS operation
FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY l_orderkey, l_linenumber, image_id, tiebreak) AS rn FROM outcomes)"""))
def snk2_written(spark, sf):
    """Whole manifests are written as files and read back by the manifest reader: every field of envelope and records."""
    name = F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".png"))
    crops = C.describe(outcomes(spark, sf)).withColumnsRenamed({
        "x": "cropX1", "y": "cropY1", "x2": "cropX2", "y2": "cropY2", "w": "cropWidth", "h": "cropHeight", "image_width": "imageWidth",
        "image_height": "imageHeight"}).withColumns({
            "project": F.lit("p"), "user": F.lit("u"), "sourceDir": F.lit("/src"), "imageName": name,
            "sinkDir": F.concat(F.lit("/snk/"), F.col("manifest_id").cast("string")), "imagePath": F.concat(F.lit("/src/"), name),
            "designated": F.col("l_linenumber") == 1}).withColumns({
            "crop_operations": F.when(F.col("l_linenumber") == 2, F.array(
                F.struct(F.lit(0).alias("level"), X.size_label("cropWidth", "cropHeight").alias("dimensions"))))})
    session = F.concat(F.lit("s"), F.col("manifest_id").cast("string"))
    documents = Q.crop_manifest_documents(
        crops, ["manifest_id"], list(V.CROP_KEY[1:]), session, F.lit("2024-01-01T00:00:00Z"), F.lit("20240101T000000Z"), (256, 128), 400,
        V.rows(spark, sf, "lineitem"))
    with work_folder(spark, "exports") as root:
        target = Q.crop_manifest_path(F.concat(F.lit(f"{root}/"), F.col("manifest_id").cast("string")), "sessionFolderUtc", "exportSequence")
        body = F.to_json(F.struct(*[c for c in documents.columns if c != "manifest_id"]))
        write_files(documents.select(target.alias("target"), body.cast("binary").alias("data"))).count()
        good, _ = read_crop_manifests(spark, root, ordered=False)  # rows of all documents come out, in no order
        r = good.select(
            F.regexp_extract("sessionId", r"(\d+)", 1).cast("long").alias("manifest_id"), "project", "user", "sourceDir", "sinkDir", "sessionId",
            "exportSequence", F.col("defaultCropSize.w").alias("dw"), F.col("defaultCropSize.h").alias("dh"), "exportedAtUtc", "count",
            F.posexplode("crops").alias("place", "c"))
        fields = ("imageName", "imagePath", "imageWidth", "imageHeight", "cropX1", "cropY1", "cropX2", "cropY2", "cropWidth", "cropHeight",
                  "annotation", "designated")
        return cut_lineage(r.select(
            *[c for c in r.columns if c != "c"], *[F.col(f"c.{f}").alias(f) for f in fields], F.round("c.nx1", 6).alias("nx1"),
            F.round("c.ny2", 6).alias("ny2"), F.col("c.crop_operations")[0]["dimensions"].alias("operation")))


@query("snk3_coco_lines", with_views("outcomes", "") + _IDS + """
, b AS (SELECT id, iid, cid, least(greatest(least(x, x + w - 1), 0), image_width - 1) AS x1, least(greatest(greatest(x, x + w - 1), 0), image_width - 1) AS x2,
    least(greatest(least(y, y + h - 1), 0), image_height - 1) AS y1, least(greatest(greatest(y, y + h - 1), 0), image_height - 1) AS y2
  FROM r JOIN img USING (image_path) JOIN cat USING (category)),
f AS (SELECT * FROM (VALUES (0, '{"info": {"contributor": "u", "date_created": "2024-01-01T00:00:00Z", "description": "demo (COCO instances)", "version": "1.0", "year": "2024"}, "licenses": []'),
  (1, ', "images": ['), (3, '], "annotations": ['), (5, '], "categories": ['), (7, ']}')) AS v(section, line))
SELECT section, CAST(0 AS BIGINT) AS id, line FROM f
UNION ALL SELECT 2, iid, CASE WHEN iid > 1 THEN ',' ELSE '' END || '{"id":' || iid || ',"file_name":"' || regexp_replace(image_path, '^.*/', '') || '","width":' || width || ',"height":' || height || '}'
  FROM img
UNION ALL SELECT 4, id, CASE WHEN id > 1 THEN ',' ELSE '' END || '{"id":' || id || ',"image_id":' || iid || ',"category_id":' || cid || ',"bbox":[' || x1 || ',' || y1 || ',' || (x2 - x1) || ',' || (y2 - y1)
  || '],"area":' || CAST((x2 - x1) * (y2 - y1) AS BIGINT) || '.0,"iscrowd":0,"segmentation":[]}' FROM b
UNION ALL SELECT 6, cid, CASE WHEN cid > 1 THEN ',' ELSE '' END || '{"id":' || cid || ',"name":"' || category || '","supercategory":"default"}' FROM cat""")
def snk3(spark, sf):
    tables = M.coco_tables(coco_rows(spark, sf), V.CROP_KEY, at_most=V.rows(spark, sf, "lineitem"))
    return D.coco_lines(tables, M.coco_info("demo", "u", "2024-01-01T00:00:00Z"))


@query("snk4_encoded_images", with_views("thumbs", """
SELECT DISTINCT 'out/9x8/' || name AS target, '89504E470D0A1A0A' AS signature, 9 AS width, 8 AS height, '0802000000' AS colour_rgb8 FROM thumbs"""))
def snk4(spark, sf):
    """Header fields inside the PNG bytes of every colour thumbnail; tests read whole files back."""
    png = V.colour_thumbs(spark, sf).withColumn("png", encode_png("px", "height", "width", "n_channels"))

    def number(at):
        return F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")

    return png.select(
        F.concat_ws("/", F.lit("out"), X.size_label("width", "height"), "name").alias("target"),
        F.hex(F.substring("png", 1, 8)).alias("signature"), number(17).alias("width"), number(21).alias("height"),
        F.hex(F.substring("png", 25, 5)).alias("colour_rgb8"))


@query("snk5_decision_split", with_views("measures", """
SELECT CASE WHEN var_laplacian < 120 OR mean_luma < 20 THEN 'rejected' ELSE 'accepted' END || '/' || name AS target FROM measures"""))
def snk5(spark, sf):
    d = U.decide(U.measure(V.thumbs(spark, sf)))
    folder = F.when(F.col("decision") == "keep", "accepted").otherwise("rejected")
    return d.select(F.concat_ws("/", folder, "name").alias("target"))


@query("snk6_rotation_plans", with_views("regions", """
SELECT image_id, angle, CAST(count(*) AS INT) AS regions, count_if(CAST(trunc(x) AS INT) >= 0 AND CAST(trunc(y) AS INT) >= 0 AND CAST(trunc(x) AS INT) + 128 <= ow AND CAST(trunc(y) AS INT) + 96 <= oh) AS in_bounds
FROM (SELECT image_id, angle, round(x, 6) AS x, round(y, 6) AS y, ow, oh FROM regions) GROUP BY image_id, angle"""))
def snk6(spark, sf):
    r = T.tile_regions(T.with_angles(V.catalog(spark, sf)), 128, 96)
    return r.groupBy("image_id", "angle").agg(
        F.count(F.lit(1)).cast("int").alias("regions"), F.count_if("in_bounds").alias("in_bounds"))


@query("snk6_plan_documents", with_views("regions", """
, sums AS (SELECT image_id, angle, CAST(count(*) AS INT) AS n, CAST(sum(CAST(round(x * 1000000) AS BIGINT)) AS BIGINT) AS sum_x, CAST(sum(CAST(round(y * 1000000) AS BIGINT)) AS BIGINT) AS sum_y,
    round(arg_min(x, (j * nh + i) * 4 + corner), 5) AS first_x, round(arg_max(y, (j * nh + i) * 4 + corner), 5) AS last_y FROM regions GROUP BY image_id, angle),
paths AS (SELECT image_id, path FROM catalog)
SELECT image_id, 0 AS part, '2024-01-01T00:00:00Z' AS created, path, width AS image_w, height AS image_h, 128 AS crop_w, 96 AS crop_h, true AS all_angles, angle,
  19 AS parameters, round(h1, 5) AS h1, round(x1, 5) AS x1, round(ymax, 5) AS ymax, coalesce(n, 0) AS regions, sum_x, sum_y, first_x, last_y, CASE WHEN n > 0 THEN 128 END AS region_w, CASE WHEN n > 0 THEN 96 END AS region_h
FROM geometry JOIN paths USING (image_id) LEFT JOIN sums USING (image_id, angle)"""))
def snk6_documents(spark, sf):
    """Whole rotation plans, one JSON document per image, written and read back angle by angle."""
    catalog = V.catalog(spark, sf)
    documents = Q.rotation_documents(catalog, None, 128, 96, ROTATION_ANGLES, "2024-01-01T00:00:00Z")
    with work_folder(spark, "plans") as root:
        D.write_json(documents, root, compression="gzip")
        read = spark.read.schema(documents.schema).json(root)
        a, r = F.col("a"), F.col("a.cropRegions")
        rounded = F.aggregate(r, F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), lambda t, v: F.struct(
            (t.x + F.round(v.x * 1_000_000).cast("long")).alias("x"), (t.y + F.round(v.y * 1_000_000).cast("long")).alias("y")))
        some = F.size(r) > 0
        return cut_lineage(read.select("*", F.explode("angles").alias("a")).withColumn("_t", rounded).select(
            "image_id", "part", F.col("Creation time").alias("created"), F.col("Image path").alias("path"), F.col("originalImage.width").alias("image_w"),
            F.col("originalImage.height").alias("image_h"), F.col("cropSettings.width").alias("crop_w"), F.col("cropSettings.height").alias("crop_h"),
            F.col("cropSettings.includeAllAngles").alias("all_angles"), a["angle"].alias("angle"), F.size(a["geometricParameters"]).alias("parameters"),
            *[F.round(a["geometricParameters"][k], 5).alias(k) for k in ("h1", "x1", "ymax")], F.size(r).alias("regions"),
            F.when(some, F.col("_t.x")).alias("sum_x"), F.when(some, F.col("_t.y")).alias("sum_y"), F.round(F.get(r, F.lit(0))["x"], 5).alias("first_x"),
            F.round(F.try_element_at(r, F.lit(-1))["y"], 5).alias("last_y"), F.get(r, F.lit(0))["width"].alias("region_w"), F.get(r, F.lit(0))["height"].alias("region_h")))


_VIDEO_OPTIONS = """
, o AS (SELECT DISTINCT video_id, video_id % 2 = 0 AS dup, video_id % 4 = 0 AS custom, video_id % 3 = 0 AS uniform, video_id % 5 = 0 AS scenes, video_id % 7 = 0 AS dark,
    CASE WHEN video_id % 2 = 0 THEN 2.0 ELSE 2.5 END AS fps FROM segments)"""


def _videos(spark, sf):
    """What a run was told about each video: paths and options, values given whether their switch is on or not."""
    v = F.col("video_id")
    options = F.struct(
        (v % 2 == 0).alias("dropDuplicates"), F.lit(None).cast("boolean").alias("advancedDropDuplicates"), (v % 4 == 0).alias("useCustomMpdecimateParams"),
        F.lit(600).alias("mpdecimateHi"), F.lit(None).cast("int").alias("mpdecimateLo"), F.lit(0.25).alias("mpdecimateFrac"), (v % 3 == 0).alias("useUniformSampling"),
        F.when(v % 2 == 0, 2.0).otherwise(2.5).alias("uniformSamplingFps"), (v % 5 == 0).alias("useSceneChanges"), F.lit(0.02).alias("sceneThreshold"),
        (v % 7 == 0).alias("skipDarkFrames"), F.lit(20.0).alias("minLumaYavg"))
    return V.segments(spark, sf).select("video_id").distinct().select(
        "video_id", F.format_string("/in/%d.mp4", "video_id").alias("videoPath"), F.format_string("/out/%d", "video_id").alias("sinkDirectory"),
        F.lit("p").alias("project"), F.lit("u").alias("user"), options.alias("options"))


@query("snk11_video_documents", with_views("segments", "") + _VIDEO_OPTIONS + """
, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg) AS rn FROM segments)
SELECT video_id, 0 AS part, '/in/' || video_id || '.mp4' AS "videoPath", '/out/' || video_id AS "sinkDirectory", 'p' AS project, 'u' AS "user", '2024-01-01T00:00:00Z' AS "extractionDateTime",
  dup AS "dropDuplicates", custom AS "useCustomMpdecimateParams", uniform AS "useUniformSampling", scenes AS "useSceneChanges", dark AS "skipDarkFrames",
  CASE WHEN custom THEN 600 END AS "mpdecimateHi", CAST(NULL AS INT) AS "mpdecimateLo", CASE WHEN custom THEN 0.25 END AS "mpdecimateFrac", CASE WHEN uniform THEN fps END AS "uniformSamplingFps",
  CASE WHEN scenes THEN 0.02 END AS "sceneThreshold", CASE WHEN dark THEN 20.0 END AS "minLumaYavg",
  nullif(concat_ws(',', CASE WHEN scenes THEN 'select=gt(scene\\,0.02)' END, CASE WHEN dark THEN 'signalstats,select=gt(metadata(''lavfi.signalstats.YAVG'')\\,20)' END,
    CASE WHEN dup THEN CASE WHEN custom THEN 'mpdecimate=hi=600:frac=0.25' ELSE 'mpdecimate' END END, CASE WHEN uniform THEN 'fps=' || CASE fps WHEN 2 THEN '2' ELSE '2.5' END END), '') AS "filterString",
  'segment_' || rn AS segment, start_s AS "start", end_s AS "end", prefix, start_s < 0 OR end_s < 0 AS "isFull" FROM n JOIN o USING (video_id)""")
def snk11_documents(spark, sf):
    """Whole segment documents, written as JSON and read back segment by segment."""
    documents = Q.video_documents(V.segments(spark, sf), _videos(spark, sf), "2024-01-01T00:00:00Z", at_most=V.rows(spark, sf, "events", times=2))
    with work_folder(spark, "videos") as root:
        D.write_json(documents, root)
        read = spark.read.schema(documents.schema).json(root)
        return cut_lineage(read.select(
            "video_id", "part", "videoPath", "sinkDirectory", "project", "user", "extractionDateTime", "extractionOptions.*", "filterString",
            F.explode("segments").alias("segment", "s")).select("*", "s.*").drop("s"))


@query("snk11_metrics_documents", with_views("frames decoder_log", "").rstrip() + "," + _RUNS + """
SELECT video_id, '/in/' || video_id || '.mp4' AS "videoPath", '/out/' || video_id AS "sinkDirectory", frames AS "totalFramesExtracted", round(duration_s, 6) AS "videoDurationSeconds",
  1000 AS "extractionStartTime", 121000 AS "extractionEndTime", 120.0 AS "extractionTimeSeconds", 2.0 AS "extractionTimeMinutes",
  round(CASE WHEN duration_s > 0 THEN frames / duration_s ELSE 0 END, 9) AS "framesPerSecond", round(CASE WHEN duration_s > 0 THEN frames / duration_s ELSE 0 END * 60, 9) AS "framesPerMinute",
  round(frames / 120.0, 9) AS "processingRate", round(CASE WHEN frames + dropped > 0 THEN dropped * 100.0 / (frames + dropped) ELSE 0 END, 9) AS "duplicateFrameRate",
  round(CASE WHEN duration_s > 0 THEN 120.0 / duration_s ELSE 0 END, 9) AS "realTimeFactor", CAST(dropped AS BIGINT) AS "droppedFrames", source_bytes AS "originalVideoSizeBytes",
  frame_bytes AS "totalExtractedFramesSizeBytes", round(CAST(frame_bytes AS DOUBLE) / source_bytes, 9) AS "compressionRatio" FROM runs""")
def snk11_metrics(spark, sf):
    """Metrics documents of all runs, written as JSON and read back."""
    told = runs(spark, sf).drop("elapsed_s").withColumns({
        "videoPath": F.format_string("/in/%d.mp4", "video_id"), "sinkDirectory": F.format_string("/out/%d", "video_id"),
        "started_ms": F.lit(1000).cast("long"), "ended_ms": F.lit(121_000).cast("long")})
    documents = Q.extraction_metrics_documents(told)
    with work_folder(spark, "metrics") as root:
        D.write_json(documents, root)
        read = spark.read.schema(documents.schema).json(root)
        rates = ("framesPerSecond", "framesPerMinute", "processingRate", "duplicateFrameRate", "realTimeFactor", "compressionRatio")
        return cut_lineage(read.withColumns({c: F.round(c, 9) for c in rates} | {"videoDurationSeconds": F.round("videoDurationSeconds", 6)}))


@query("snk9_volume_report", with_views("gray", """
, judged AS (SELECT volume_id, idx, sqrt(greatest(0, q / n - (s / n) * (s / n))) >= 5 AND d / n <= 0.95 AS worth
  FROM (SELECT volume_id, idx, CAST(sum(p) AS DOUBLE) AS s, CAST(sum(p*p) AS DOUBLE) AS q, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(p < 10) AS DOUBLE) AS d
    FROM gray WHERE view = 'axial' GROUP BY ALL)),
files AS (SELECT volume_id, count(*) AS depth, count_if(worth) AS good, count_if(NOT worth) AS low FROM judged GROUP BY volume_id),
runs AS (SELECT count(*) AS files, CAST(sum(good) AS BIGINT) AS slices FROM files),
views(view, axis) AS (VALUES ('axial', 2), ('coronal', 1), ('sagittal', 0)),
-- a view of 8 x 8 is cut; one of 8 by the depth only where its sides differ by a factor of 4 at most
rows AS (SELECT *, 'v' || volume_id AS base, axis = 2 OR (least(8, depth) >= 8 AND greatest(8, depth) <= 4 * least(8, depth)) AS worth_view FROM files CROSS JOIN views)
SELECT '/vol/v' || volume_id || '.nii' AS "originalImagePath", base || '.nii' AS "originalFilename", '/out/' || base AS "sinkDir",
  '/out/' || base || '/' || view || '_slices' AS "savedAs", 'NIfTI_' || base || '_' || view AS annotation, 8 AS "originalWidth", 8 AS "originalHeight",
  CAST(depth AS INT) AS "originalDepth", 3 AS "numDimensions", axis AS "exportDimension", CASE WHEN axis = 2 THEN good ELSE 0 END AS "numSlicesExported",
  CASE WHEN axis = 2 THEN low ELSE 0 END AS "lowQualitySlicesSkipped", 'float64' AS "dataType", CAST(352 + depth * 512 AS BIGINT) AS "fileSizeBytes", view AS "viewName",
  CASE WHEN NOT worth_view THEN 'slice size not suitable' END AS "skipReason",
  CASE WHEN worth_view THEN CASE axis WHEN 2 THEN '8x8' ELSE '8x' || depth END END AS dimensions, files AS "totalFilesProcessed", slices AS "totalSlicesExported",
  round(files / 30.0, 9) AS "filesProcessedPerSecond", round(slices / 30.0, 9) AS "slicesExportedPerSecond", round(CAST(slices AS DOUBLE) / files, 9) AS "averageSlicesPerFile",
  CAST((row_number() OVER (ORDER BY '/vol/v' || volume_id || '.nii', axis) - 1) // 5 AS INT) AS "exportSequence" FROM rows CROSS JOIN runs"""))
def snk9_report(spark, sf):
    """The report of a run over the axial slices of all volumes, written as JSON in parts and read back entry by entry."""
    slices = V.voxel_slices(spark, sf).withColumn("volume_id", F.concat(F.lit("/vol/v"), F.col("volume_id").cast("string"), F.lit(".nii")))
    n = F.col("depth").cast("int")
    headers = slices.groupBy(F.col("volume_id").alias("path")).agg(F.count(F.lit(1)).alias("depth")).select(
        "path", F.array(F.lit(3), F.lit(8), F.lit(8), n).alias("dim"), (352 + F.col("depth") * 512).alias("length"),
        F.lit("float64").alias("type_name"), X.file_name("path").alias("name"))
    views = O.views_of(headers).withColumn("worth_view", O.view_worth_exporting("slice_w", "slice_h", min_side=8))
    judged = O.slice_content(O.gray_slices(O.slices_along(slices, 2)))
    report = Q.volume_report(O.view_exports(views, judged), X.volume_base_name(X.file_name("path")), "/vol", "/out", 30_000,
                             "2024-01-01T000000Z", "s", "p", "u", max_records=5)
    with work_folder(spark, "report") as root:
        D.write_json(report, root)
        read = spark.read.schema(report.schema).json(root)
        entry = read.select("*", F.explode("exports").alias("e"))
        return cut_lineage(entry.select(
            *[f"e.{c}" for c in ("originalImagePath", "originalFilename", "sinkDir", "savedAs", "annotation", "originalWidth", "originalHeight", "originalDepth",
                                 "numDimensions", "exportDimension", "numSlicesExported", "lowQualitySlicesSkipped", "dataType", "fileSizeBytes", "viewName", "skipReason")],
            F.col("e.crop_operations")[0]["dimensions"].alias("dimensions"), "totalFilesProcessed", "totalSlicesExported",
            *[F.round(c, 9).alias(c) for c in ("filesProcessedPerSecond", "slicesExportedPerSecond", "averageSlicesPerFile")], "exportSequence"))


@query("snk7_rotated_tile_paths", with_views("regions", """
SELECT image_id, 'cropped/angle/' || angle || '/128_x_96/' || angle || '_' || j || '_' || i || '_' || ((j * nh + i) * 4 + corner - 1) || '.png' AS path FROM regions"""))
def snk7(spark, sf):
    return T.tile_regions(T.with_angles(V.catalog(spark, sf)), 128, 96).select("image_id", T.tile_path().alias("path"))


# Tiles of 3 x 2 of the 9 x 8 images, each pixel looked up in the image it was turned from.
_TILE_PIXELS = with_views("thumbs regions", """
, images AS (SELECT image_id, list(v ORDER BY y, x) AS px FROM thumbs GROUP BY image_id),
placed AS (SELECT image_id, angle, j, i, corner, CAST(trunc(round(x, 6)) AS INT) AS tx, CAST(trunc(round(y, 6)) AS INT) AS ty, ow, oh FROM regions),
tiles AS (SELECT * FROM placed WHERE tx >= 0 AND ty >= 0 AND tx + 3 <= ow AND ty + 2 <= oh),
spots AS (SELECT t.*, a, b, round(cos(radians(angle)) * dx + sin(radians(angle)) * dy + 4, 9) AS sx, round(-sin(radians(angle)) * dx + cos(radians(angle)) * dy + 3.5, 9) AS sy
  FROM (SELECT tiles.*, a, b, tx + a + 0.5 - ow / 2.0 AS dx, ty + b + 0.5 - oh / 2.0 AS dy FROM tiles, range(0, 3) AS ra(a), range(0, 2) AS rb(b)) t),
near AS (SELECT *, least(8, greatest(0, sx)) AS cx, least(7, greatest(0, sy)) AS cy, sx > -0.500000001 AND sy > -0.500000001 AND sx < 8.5 AND sy < 7.5 AS inside FROM spots),
cells AS (SELECT *, CAST(floor(cx) AS INT) AS x0, CAST(floor(cy) AS INT) AS y0 FROM near),
samples AS (SELECT c.*, cx - x0 AS fx, cy - y0 AS fy, px[y0 * 9 + x0 + 1] AS p, px[y0 * 9 + least(8, x0 + 1) + 1] AS q,
    px[least(7, y0 + 1) * 9 + x0 + 1] AS r, px[least(7, y0 + 1) * 9 + least(8, x0 + 1) + 1] AS s FROM cells c JOIN images USING (image_id)),
made AS (SELECT *, CASE WHEN inside THEN CAST(floor(round((p * (1 - fx) + q * fx) * (1 - fy) + (r * (1 - fx) + s * fx) * fy, 9) + 0.5) AS INT) ELSE 0 END AS v FROM samples)
SELECT image_id, angle, j, i, corner, string_agg(printf('%02X', v), '' ORDER BY b, a) AS px FROM made GROUP BY image_id, angle, j, i, corner""").replace(
    "FROM catalog CROSS JOIN angles", "FROM (SELECT DISTINCT image_id, 9 AS width, 8 AS height FROM thumbs) CROSS JOIN (VALUES (0), (30), (60), (90)) AS a(angle)").replace(
    "128.0::DOUBLE AS cw, 96.0::DOUBLE AS chh", "3.0::DOUBLE AS cw, 2.0::DOUBLE AS chh")


@query("snk7_rotated_tile_pixels", _TILE_PIXELS)
def snk7_pixels(spark, sf):
    """Every tile of every small image at four angles, each made from the strip of source rows below it."""
    tiles = T.rotated_tile_pixels(V.thumbs(spark, sf), 3, 2, (0, 30, 60, 90))
    return tiles.select("image_id", "angle", "j", "i", "corner", F.hex("px").alias("px"))


@query("snk8_flip_layout", with_views("thumbs", """
SELECT 'cropped/augmented_data/0/' || flip || '/9x8/' || name || '_crop_' || (image_id % 4) || '.png' AS path
FROM (SELECT DISTINCT image_id, name FROM thumbs) CROSS JOIN (VALUES ('Flipped horizontal'), ('Flipped vertical'), ('Flipped both')) AS f(flip)"""))
def snk8(spark, sf):
    flips = T.flips(V.thumbs(spark, sf)).withColumns({"angle": F.lit("0"), "n": (F.col("image_id") % 4)})
    return flips.select(T.flip_path("angle", "width", "height", "name", "n").alias("path"))


@query("snk9_volume_exports", with_views("view_list", "").rstrip() + "," + _EXPORTS + """
SELECT path, view, '/out/' || base || '/' || view || '_slices' AS saved_as, 'NIfTI_' || base || '_' || view AS annotation, n_exported, n_low AS n_low_quality
FROM (SELECT *, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.nii(\\.gz)?$', '', 'i') AS base FROM exports)""")
def snk9(spark, sf):
    e = exports(spark, sf).withColumn("base", X.volume_base_name(X.file_name("path")))
    return e.select(
        "path", "view", F.concat(F.lit("/out/"), "base", F.lit("/"), "view", F.lit("_slices")).alias("saved_as"),
        F.concat_ws("_", F.lit("NIfTI"), "base", "view").alias("annotation"), "n_exported", "n_low_quality")


@query("snk10_dicom_report", with_views("heads", f"""
SELECT count(*) AS found, count_if(verdict = 'ok') AS ok, count_if(verdict <> 'ok') AS skipped, round(count_if(verdict = 'ok') / 12.5, 6) AS per_second, round(count_if(verdict = 'ok') / 12.5 * 60, 6) AS per_minute,
  true AS recursive FROM ({_VERDICT})"""))
def snk10(spark, sf):
    totals = K.dicom_totals(K.dicom_screen(V.file_heads(spark, sf)))
    r = Q.dicom_report(totals, 12.5, {"recursive": True, "preserve_structure": False, "skip_validation": False})
    t = "data_tracking."
    return r.select(
        F.col(t + "total_images_found").alias("found"), F.col(t + "total_images_processed_successfully").alias("ok"),
        F.col(t + "total_images_skipped").alias("skipped"), F.round(t + "processing_rate_images_per_second", 6).alias("per_second"),
        F.round(t + "processing_rate_images_per_minute", 6).alias("per_minute"), F.col("provenance.processing_parameters.recursive").alias("recursive"))


@query("snk11_segment_documents", with_views("segments", """
SELECT '{"video_id":' || video_id || ',"part":0,"segments":{' || string_agg('"segment_' || rn || '":{"start":' || start_s || ',"end":' || end_s || ',"prefix":"' || prefix || '","isFull":' || CASE WHEN start_s < 0 OR end_s < 0 THEN 'true' ELSE 'false' END || '}', ',' ORDER BY rn) || '}}' AS document
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg) AS rn FROM segments) GROUP BY video_id"""))
def snk11(spark, sf):
    return D.json_rows(Q.segment_documents(V.segments(spark, sf), at_most=V.rows(spark, sf, "events", times=2)))


@query("snk12_session_metrics", with_views("crops", """
SELECT size, count(*) AS total, round(count(*) / 90.0, 3) AS per_second, (SELECT count(*) FROM crops) AS overall, 1.5 AS minutes FROM (SELECT w || 'x' || h AS size FROM crops) GROUP BY size"""))
def snk12(spark, sf):
    r = Q.session_report(C.size_metrics(requests(spark, sf), 90), "2024-01-01T00:00:00Z", 90, "p", "u")
    return r.select(F.col("totals.overall").alias("overall"), F.col("session.durationMinutes").alias("minutes"), F.explode("by_size").alias("size", "m")).select(
        "size", "m.total", F.col("m.perSecond").alias("per_second"), "overall", "minutes")


@query("snk13_upload_plan", with_views("catalog", """
SELECT path, 'backup/' || substr(path, 10) AS key, bytes FROM catalog WHERE starts_with(path, '/ds/src0/')"""))
def snk13(spark, sf):
    return K.upload_plan(V.catalog(spark, sf).select("path", "bytes"), "/ds/src0", "backup/")
