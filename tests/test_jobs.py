"""Whole runs over small real files."""

import csv
import glob
import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.jobs import crop_batch, curate_folder, slice_volumes
from framewright.sinks.png import png_bytes
from framewright.sources.images import read_images
from tests.test_sources import nifti


def picture(path, px):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(png_bytes(px.tobytes(), *px.shape))


def test_crop_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    photo = rng.integers(1, 256, (20, 30, 3), np.uint8)
    picture(tmp_path / "img" / "a.png", photo)
    sink = tmp_path / "sink"
    sink.mkdir()
    (sink / "cat_4x5_00001.png").write_bytes(b"taken")
    meta = tmp_path / "meta"
    meta.mkdir()

    def manifest(n, crops, **more):
        (meta / f"crop_metadata_{n}.json").write_text(json.dumps({"crops": crops, **more}))

    box = {"imagePath": "a.png", "annotation": "cat", "x1": 2, "y1": 3, "w": 4, "h": 5}
    manifest(1, [box, {**box, "x1": 6}, {**box, "x1": 29}, {**box, "imagePath": "gone.png"}, {**box, "savedAs": "mine.png"}])
    manifest(2, [box, {"imagePath": "a.png"}])
    (meta / "crop_metadata_3.json").write_text("{}")
    args = (spark, str(meta), str(tmp_path / "img"), str(sink), str(tmp_path / "ledger"))
    dry = crop_batch.run(*args, dry_run=True).first()
    first = crop_batch.run(*args, respect_saved=True).first()
    assert tuple(dry) == tuple(first) == (3, 1, 0, 2, 1, 7, 3, 2)
    assert sorted(os.listdir(sink)) == ["cat_4x5_00001.png", "cat_4x5_00002.png", "cat_4x5_00003.png", "mine.png"]
    good, _ = read_images(spark, str(sink))
    got = {r.name: bytes(r.px) for r in good.collect()}
    assert got["cat_4x5_00002.png"] == photo[3:8, 2:6].tobytes() and got["cat_4x5_00003.png"] == photo[3:8, 6:10].tobytes()
    again = crop_batch.run(*args).first()
    assert (again.manifests_skipped, again.manifests_failed, again.crops_done) == (1, 2, 0)


def test_crop_batch_loses_nothing(spark, tmp_path):
    """Foreign sinks, images by absolute path and by fallback, odd names, and blank paths."""
    rng = np.random.default_rng(18)
    photo = rng.integers(1, 256, (20, 30, 3), np.uint8)
    picture(tmp_path / "img" / "a b+100%.png", photo)
    picture(tmp_path / "far" / "away.png", photo)
    picture(tmp_path / "own" / "c.png", photo)
    meta = tmp_path / "meta folder"
    meta.mkdir()
    box = {"annotation": "cat", "x1": 2, "y1": 3, "w": 4, "h": 5}
    crops = [{**box, "imagePath": "a b+100%.png"}, {**box, "imagePath": str(tmp_path / "far" / "away.png"), "sinkDir": str(tmp_path / "other")},
             {**box, "imagePath": " "}, {"annotation": "cat"}]
    (meta / "crop_metadata_1.json").write_text(json.dumps({"crops": crops, "sourceDir": str(tmp_path / "gone")}))
    (meta / "crop_metadata_2.json").write_text(json.dumps({"crops": [{**box, "imagePath": "c.png"}], "sourceDir": str(tmp_path / "own")}))
    got = crop_batch.run(spark, str(meta), str(tmp_path / "img"), str(tmp_path / "sink"), str(tmp_path / "ledger"), by_size=True).first()
    assert tuple(got) == (2, 2, 0, 0, 3, 5, 3, 0)
    assert sorted(os.listdir(tmp_path / "sink" / "cat" / "4x5")) == ["cat_4x5_00001.png", "cat_4x5_00002.png"]
    assert os.listdir(tmp_path / "other" / "cat" / "4x5") == ["cat_4x5_00001.png"]


def test_curate_folder(spark, tmp_path):
    rng = np.random.default_rng(9)
    noisy = rng.integers(0, 256, (12, 12, 1), np.uint8)
    picture(tmp_path / "in" / "a.png", noisy)
    picture(tmp_path / "in" / "B.png", noisy)
    picture(tmp_path / "in" / "c.png", np.full((12, 12, 1), 5, np.uint8))
    (tmp_path / "in" / "d.png").write_bytes(b"broken")
    picture(tmp_path / "in" / "e f%41.png", noisy[:, ::-1].copy())
    totals = curate_folder.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    assert tuple(totals) == (3, 1)
    rejects = spark.read.json(str(tmp_path / "out" / "rejects")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rejects] == ["d.png"]
    rows = {}
    for part in glob.glob(str(tmp_path / "out" / "manifest" / "part-*")):
        rows.update({r["filename"]: r for r in csv.DictReader(open(part))})
    assert set(rows) == {"a.png", "B.png", "c.png", "e f%41.png"} and int(rows["e f%41.png"]["bytes"]) > 0
    assert rows["c.png"]["reason"] == "blurry dark" and rows["a.png"]["decision"] == "keep"
    assert (rows["a.png"]["near_duplicate"], rows["B.png"]["near_duplicate"]) == ("false", "true")
    assert rows["a.png"]["sha256"] == rows["B.png"]["sha256"] and int(rows["a.png"]["bytes"]) > 0
    assert spark.read.parquet(str(tmp_path / "out" / "decisions")).where(F.col("decision") == "drop").count() == 1


def test_slice_volumes(spark, tmp_path):
    rng = np.random.default_rng(10)
    big = rng.integers(0, 1000, (6, 70, 66)).astype("i2")
    big[2] = 7
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "scan.nii").write_bytes(nifti(big, 4))
    (tmp_path / "v" / "odd.nii").write_bytes(nifti(big, 1024))
    whole = nifti(big, 4)
    (tmp_path / "v" / "short.nii").write_bytes(whole[:-3 * 70 * 66 * 2])
    (tmp_path / "v" / "torn.nii.gz").write_bytes(gzip.compress(whole)[:-4000])
    (tmp_path / "v" / "line.nii").write_bytes(nifti(big, 4, dim=(1, 9, 0, 0, 0, 0, 0, 0)))
    rows = {(r.path.rsplit("/", 1)[1], r.view): r for r in slice_volumes.run(spark, str(tmp_path / "v"), str(tmp_path / "out")).collect()}
    axial = rows[("scan.nii", "axial")]
    assert (axial.n_slices, axial.n_exported, axial.n_low_quality, axial.skip_reason) == (6, 5, 1, None)
    assert rows[("scan.nii", "coronal")].skip_reason == "slice size not suitable"
    assert rows[("odd.nii", None)].skip_reason == "unsupported type int64"
    assert rows[("line.nii", None)].skip_reason == "unsupported dimension 1"
    assert rows[("short.nii", None)].skip_reason == rows[("torn.nii.gz", None)].skip_reason == "volume cut short"
    assert not (tmp_path / "out" / "short").exists() and not (tmp_path / "out" / "torn").exists()
    made = sorted(os.listdir(tmp_path / "out" / "scan" / "axial_slices"))
    assert made == [f"scan_slice_{z:04d}.png" for z in (0, 1, 3, 4, 5)]
    assert glob.glob(str(tmp_path / "out" / "exports" / "part-*"))
    report = spark.read.json(str(tmp_path / "out" / "report")).first()
    assert (report.totalFilesProcessed, report.totalSlicesExported, report.exportSequence, report.defaultExportSize.w) == (1, 5, 0, "varies by slice")
    entries = {e.viewName: e for e in report.exports}
    assert set(entries) == {"axial", "coronal", "sagittal"} and entries["coronal"].skipReason == "slice size not suitable"
    e = entries["axial"]
    assert (e.numSlicesExported, e.lowQualitySlicesSkipped, e.dataType, e.originalWidth, e.originalDepth) == (5, 1, "int16", 66, 6)
    assert e.fileSizeBytes == len(whole) and e.savedAs == f"{tmp_path}/out/scan/axial_slices" and e.crop_operations[0].dimensions == "66x70"
    assert report.processingTimeMs > 0 and abs(report.averageSlicesPerFile - 5) < 1e-9


@pytest.mark.parametrize("mode, size", [(0, (5, 6)), (1, (4, 6)), (2, (4, 5))])
def test_slice_volumes_along_one_axis(spark, tmp_path, mode, size):
    data = np.arange(6 * 5 * 4).reshape(6, 5, 4).astype("i2")
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.nii").write_bytes(nifti(data, 4))
    (tmp_path / "v" / "flat.nii").write_bytes(nifti(data[:1], 4, dim=(2, 4, 5, 0, 0, 0, 0, 0)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in slice_volumes.run(spark, str(tmp_path / "v"), str(tmp_path / "out"), mode=mode).collect()}
    n = data.shape[2 - mode]
    assert (rows["a.nii"].n_exported, rows["a.nii"].n_low_quality, rows["a.nii"].skip_reason) == (n, 0, None)
    assert sorted(os.listdir(tmp_path / "out" / "a")) == [f"a_slice_{i:04d}_dim{mode}.png" for i in range(n)]
    made, _ = read_images(spark, str(tmp_path / "out" / "a"))
    assert {(r.width, r.height) for r in made.collect()} == {size}
    assert rows["flat.nii"].skip_reason == ("dimension 2 is invalid for 2D" if mode == 2 else None)
    report = spark.read.json(str(tmp_path / "out" / "report")).first()
    assert report.totalFilesProcessed == (1 if mode == 2 else 2)
    e = {x.originalFilename: x for x in report.exports}["a.nii"]
    assert (e.savedAs, e.exportDimension, e.annotation) == (f"{tmp_path}/out/a", mode, "NIfTI_a")
    assert "viewName" not in e or e.viewName is None
