"""Sinks, read back."""

import csv
import glob
import json

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import catalog as K
from framewright.operators import coco as M
from framewright.operators import crops as C
from framewright.sinks import documents as D
from framewright.sinks.png import write_png
from framewright.sources import images


def test_curation_csv_quotes_only_where_needed(spark, tmp_path):
    row = ("a,\"b\".png", 9, 8, 72, None, None, 1.5, 2.0, "curation", "m", None, None, None, "keep", "")
    cols = list(D.CURATION_HEADER)
    kinds = "filename string, width int, height int, bytes long, sha256 string, dhash long, var_laplacian double, mean_luma double, metric string, metric_value string, near_duplicate boolean, source_video string, timecode_sec double, decision string, reason string"
    D.write_curation_csv(spark.createDataFrame([row], kinds).coalesce(1), str(tmp_path / "m"))
    text = open(glob.glob(str(tmp_path / "m" / "part-*"))[0]).read()
    assert text.splitlines()[0] == ",".join(cols)
    assert text.splitlines()[1] == '"a,""b"".png",9,8,72,,,1.5,2.0,curation,m,,,,keep,'
    assert list(csv.reader(text.splitlines()))[1][0] == 'a,"b".png'


def test_coco_parts_form_one_document(spark, tmp_path):
    rows = [(i, f"/d/i{i % 3}.png", f"i{i % 3}.png", 100, 80, i, i, i + 9, i + 9, "cat" if i % 2 else " ") for i in range(20)]
    crops = spark.createDataFrame(rows, "ord int, image_path string, image_name string, image_width int, image_height int, x1 int, y1 int, x2 int, y2 int, annotation string")
    for limit in (1_000_000, 4):
        t = M.coco_tables(crops, ["ord"], max_group_rows=limit)
        out = str(tmp_path / f"coco{limit}")
        D.write_coco(t, M.coco_info("set", "me", "2024-05-06T00:00:00Z"), out)
        doc = json.loads("".join(open(p).read() for p in sorted(glob.glob(out + "/part-*"))))
        assert [i["id"] for i in doc["images"]] == [1, 2, 3] and doc["images"][0]["file_name"] == "i0.png"
        assert [c["name"] for c in doc["categories"]] == ["unlabeled", "cat"]
        assert [a["id"] for a in doc["annotations"]] == list(range(1, 21))
        assert doc["annotations"][4] == {"id": 5, "image_id": 2, "category_id": 1, "bbox": [4, 4, 9, 9], "area": 81.0, "iscrowd": 0, "segmentation": []}
        assert doc["info"]["year"] == "2024" and doc["licenses"] == []


def test_png_files_come_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"{tmp_path}/p/{c}x{i}/{i}.png", 6 + i, 5, c, rng.integers(1, 256, (6 + i, 5, c), np.uint8).tobytes()) for i, c in enumerate((1, 3))]
    df = spark.createDataFrame(rows, "target string, height int, width int, n_channels int, px binary")
    written = write_png(df, F.col("target")).collect()
    assert len(written) == 2 and all(r.bytes > 0 for r in written)
    assert write_png(df, F.col("target")).count() == 2  # a retry replaces, leaves no parts
    assert glob.glob(f"{tmp_path}/p/**/*.part", recursive=True) == []
    good, bad = images.read_images(spark, f"{tmp_path}/p")
    assert {bytes(r.px) for r in good.collect()} == {r[4] for r in rows} and bad.count() == 0


def test_decisions_are_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", "keep"), ("b", "drop")], "name string, decision string")
    D.write_decisions(df, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split" / "decision=drop")).first().name == "b"


def test_names_skip_what_exists_on_both_routes(spark):
    crops = spark.createDataFrame([(i, "s", "p", 4, 4, w) for i, w in enumerate([None, "z/p_4x4_00003.png", "keep.png", "keep.png", None, "old.png"])],
                                  "ord int, sink string, prefix string, w int, h int, saved_as string")
    listing = spark.createDataFrame([("s", "p_4x4_00001.png"), ("s", "old.png"), ("s", "p_4x4_00004.png"), ("t", "p_4x4_00002.png")], "sink string, name string")
    want = ["p_4x4_00002.png", "p_4x4_00003.png", "keep.png", "p_4x4_00005.png", "p_4x4_00006.png", "p_4x4_00007.png"]
    for limit in (1_000_000, 1):
        got = C.assign_output_names(crops, listing, ["ord"], max_group_rows=limit).orderBy("ord").collect()
        assert [r.file_name for r in got] == want
    plain = C.assign_output_names(crops, listing, ["ord"], respect_saved=False).orderBy("ord").collect()
    assert [r.file_name for r in plain] == [f"p_4x4_{n:05d}.png" for n in (2, 3, 5, 6, 7, 8)]


def test_hot_image_is_salted(spark):
    crops = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("image_id"),
                                    F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(4).alias("w"), F.lit(4).alias("h"), F.lit(True).alias("complete"))
    images_ = spark.range(0, 400).select(F.col("id").alias("image_id"), (F.col("id") % 8).cast("int").alias("width"), F.lit(5).alias("height"))
    a = C.crop_outcomes(crops, images_).groupBy("outcome").count().collect()
    b = C.crop_outcomes(crops, images_, salt_by=["k"], max_key_rows=20).groupBy("outcome").count().collect()
    assert sorted(a) == sorted(b)


def test_upload_plan(spark):
    f = spark.createDataFrame([("/r/a/b.png",), ("/r/c.png",), ("/rx/d.png",)], "path string")
    assert {(r.path, r.key) for r in K.upload_plan(f, "/r/", "pre/").collect()} == {("/r/a/b.png", "pre/a/b.png"), ("/r/c.png", "pre/c.png")}
