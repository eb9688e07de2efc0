"""Source operators over listing tables (SRC-*); file readers have their own tests."""

from pyspark.sql import functions as F

from framewright.fixtures import views as V
from framewright.fixtures.sql import with_views
from framewright.functions import text as X
from framewright.operators import catalog as K
from framewright.operators import curation as U
from framewright.plans.ordered import number_rows
from framewright.registry import query
from framewright.registry.aggregates import _VERDICT
from framewright.registry.filters import requests
from framewright.schemas import SEGMENT_MANIFEST
from framewright.session import cut_lineage, work_folder
from framewright.sinks.png import write_files, write_png
from framewright.sources import manifests as N
from framewright.sources.files import list_objects
from framewright.sources.images import read_images
from framewright.sources.volumes import decode_header

_IMAGE = "regexp_matches(lower({c}), '\\.(png|jpe?g|bmp|gif)$')"


@query("src1_image_listing", with_views("catalog", f"SELECT path, regexp_replace(path, '^.*/', '') AS name FROM catalog WHERE {_IMAGE.format(c='path')}"))
def src1(spark, sf):
    return K.image_listing(V.catalog(spark, sf).select("path"))


@query("src2_discovery_without_sink", with_views("catalog", f"""
SELECT path, regexp_replace(path, '^.*/', '') AS name FROM catalog WHERE {_IMAGE.format(c='path')} AND NOT starts_with(path, '/ds/src1/')"""))
def src2(spark, sf):
    return K.image_listing(V.catalog(spark, sf).select("path"), sink="/ds/src1/")


@query("src3_decode_images", with_views("colour", """
SELECT name, 9 AS width, 8 AS height, 3 AS n_channels, round(avg(g), 6) AS mean_luma FROM (
  SELECT image_id, name, (77 * max(CASE WHEN c = 2 THEN s END) + 150 * max(CASE WHEN c = 1 THEN s END) + 29 * max(CASE WHEN c = 0 THEN s END) + 128) // 256 AS g
  FROM colour GROUP BY image_id, name, y, x) GROUP BY image_id, name"""))
def src3(spark, sf):
    """Round trip: every thumbnail is written as a PNG file and decoded from it."""
    with work_folder(spark, "pictures") as root:
        target = F.concat(F.lit(f"{root}/f "), F.col("folder").cast("string"), F.lit("/"), "name")
        written = write_png(V.colour_thumbs(spark, sf), target).count()
        images, _ = read_images(spark, root, n_files=written)
        return cut_lineage(U.measure(images).select(
            "name", "width", "height", "n_channels", F.round("mean_luma", 6).alias("mean_luma")))


def _written_manifests(spark, sf, root):
    """One JSON file per supplier, some without crops and some cut short."""
    m = V.manifests(spark, sf)
    crops = F.array(F.struct(F.lit("a.png").alias("imagePath"), F.col("manifest_id").alias("x1"), F.lit(2).alias("y1")))
    whole = F.when(F.col("has_crops"), F.to_json(F.struct(crops.alias("crops")))).otherwise('{"sourceDir": "/x"}')
    text = F.when(F.col("manifest_id") % 7 == 3, F.substr(whole, F.lit(1), F.lit(9))).otherwise(whole)
    write_files(m.select(F.concat(F.lit(root), "path").alias("target"), text.cast("binary").alias("data"))).count()
    good, bad = N.read_crop_manifests(spark, root)
    place = F.regexp_extract("manifest", "(/meta/.*)$", 1)
    return good.withColumn("path", place), bad.withColumn("path", place)


@query("src4_manifest_order", with_views("manifests", """
SELECT path, row_number() OVER (ORDER BY lower(path), path) AS position, manifest_id AS first_x
FROM manifests WHERE has_crops AND manifest_id % 7 <> 3"""))
def src4(spark, sf):
    """Manifest files are written, discovered, read and put in path order."""
    with work_folder(spark, "manifests") as root:
        good, _ = _written_manifests(spark, sf, root)
        ordered = number_rows(good, [], X.ignoring_case("path"), "position", at_most=V.rows(spark, sf, "supplier"))
        return cut_lineage(ordered.select("path", "position", F.col("crops")[0]["x1"].cast("long").alias("first_x")))


@query("src5_manifest_rejects", with_views("manifests", """
SELECT path, CASE WHEN manifest_id % 7 = 3 THEN 'not JSON' ELSE 'missing key ''crops''' END AS reason
FROM manifests WHERE NOT has_crops OR manifest_id % 7 = 3"""))
def src5(spark, sf):
    """Manifest files are written, some cut short or without crops; the reader tells why it rejects them."""
    with work_folder(spark, "manifests") as root:
        _, bad = _written_manifests(spark, sf, root)
        return cut_lineage(bad.select("path", "reason"))


@query("src6_request_normalisation", with_views("crops", "SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, x, y, w, h FROM crops"))
def src6(spark, sf):
    return requests(spark, sf).select(*V.CROP_KEY, "x", "y", "w", "h")


@query("src7_object_listing", with_views("objects", "SELECT regexp_extract(key, '^([^/]*)/', 1) AS top, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objects GROUP BY 1"))
def src7(spark, sf):
    return V.objects(spark, sf).groupBy(F.regexp_extract("key", "^([^/]*)/", 1).alias("top")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


@query("src7_listed_files", """
SELECT 'm ' || (s_nationkey % 3) || '/n' || s_suppkey || '.json' AS key, CAST(length(s_name) AS BIGINT) AS size FROM supplier""")
def src7_files(spark, sf):
    """Objects are written below a folder and listed with their keys and sizes."""
    with work_folder(spark, "objects") as root:
        s = V.table(spark, sf, "supplier")
        key = F.concat(F.lit("m "), (F.col("s_nationkey") % 3).cast("string"), F.lit("/n"), F.col("s_suppkey").cast("string"), F.lit(".json"))
        write_files(s.select(F.concat(F.lit(root + "/"), key).alias("target"), F.col("s_name").cast("binary").alias("data"))).count()
        return cut_lineage(list_objects(spark, root).select("key", "size"))


@query("src8_image_key_index", with_views("objects", f"SELECT key, size FROM objects WHERE starts_with(key, 'Images/') AND {_IMAGE.format(c='key')}"))
def src8(spark, sf):
    return K.image_index(V.objects(spark, sf), " /store/Images ", "store").select("key", "size")


@query("src9_volume_listing", with_views("volume_headers", "SELECT path FROM volume_headers WHERE regexp_matches(lower(path), '\\.nii(\\.gz)?$')"))
def src9(spark, sf):
    return V.volume_headers(spark, sf).where(X.has_extension("path", ("nii", "nii.gz"))).select("path")


@query("src10_volume_headers", """
SELECT doc_id AS volume_id, CASE WHEN doc_id % 13 = 12 THEN 'invalid header size' WHEN doc_id % 7 = 6 THEN 'unsupported type int64' END AS reject,
  CASE WHEN ok THEN doc_id % 2 = 1 END AS big_endian, CASE WHEN ok THEN nd END AS ndim, CASE WHEN ok THEN 16 + n_chars % 500 END AS d1,
  CASE WHEN ok THEN greatest(1, n_chars * 3 % 400) END AS d2, CASE WHEN ok THEN CASE WHEN nd >= 3 THEN greatest(1, n_chars % 90 - 20) ELSE 1 END END AS d3,
  CASE WHEN ok THEN CAST(CASE WHEN n_chars % 5 = 1 THEN 1.5 ELSE 1.0 END AS DOUBLE) END AS spacing,
  CASE WHEN ok THEN CASE doc_id % 3 WHEN 0 THEN 352 WHEN 1 THEN 512 ELSE 352 END END AS vox_offset
FROM (SELECT *, doc_id % 13 <> 12 AS ok, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 3 END AS nd FROM documents)""")
def src10(spark, sf):
    h = V.header_bytes(spark, sf).withColumn("h", decode_header("head"))
    return h.select("volume_id", "h.reject", "h.big_endian", F.col("h.dim")[0].alias("ndim"), *[F.col("h.dim")[i].alias(f"d{i}") for i in (1, 2, 3)],
                    F.col("h.pixdim")[1].cast("double").alias("spacing"), "h.vox_offset")


@query("src11_dicom_screening", with_views("heads", _VERDICT))
def src11(spark, sf):
    return K.dicom_screen(V.file_heads(spark, sf)).select("path", "folder", "verdict")


@query("src12_segment_manifests", """
SELECT '/v/' || conv_id || '_' || turn || '.mp4' AS video, 'segment_' || n AS segment, CAST(CASE WHEN turn % 4 <> 3 THEN length(text) % 100 ELSE -1 END AS INT) AS start_s,
  CAST(CASE WHEN turn % 4 <> 3 THEN length(text) % 100 + 10 ELSE -1 END AS INT) AS end_s, CASE WHEN turn % 2 = 0 THEN role ELSE 'Frame_' END AS prefix,
  conv_id % 2 = 0 AS drop_duplicates, CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 600 ELSE 512 END END AS hi,
  CAST(CASE WHEN conv_id % 5 = 0 THEN CASE WHEN conv_id % 10 = 0 THEN 2.5 ELSE 1.0 END END AS DOUBLE) AS fps,
  CAST(CASE WHEN turn % 3 = 0 THEN 20.0 END AS DOUBLE) AS min_luma
FROM conversations CROSS JOIN (VALUES (1), (2)) AS u(n)""")
def src12(spark, sf):
    docs = V.segment_json(spark, sf).select(F.from_json("document", SEGMENT_MANIFEST).alias("d")).select("d.*")
    s = N.segments_of(N.with_option_defaults(docs))
    return s.select(F.col("videoPath").alias("video"), "segment", "start_s", "end_s", "prefix", "drop_duplicates", "hi", "fps", "min_luma")
