"""Readers over small real files."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import text as X
from framewright.operators import crops as C
from framewright.operators import volumes as O
from framewright.sinks.png import png_bytes, write_png
from framewright.sources import dicom, files, images, manifests, volumes


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(1)
    made = {}
    for name, (h, w, c) in {"b.png": (5, 7, 3), "A.PNG": (4, 4, 1), "sub/c.png": (3, 2, 4), "out/done.png": (2, 2, 1)}.items():
        px = rng.integers(1, 256, (h, w, c), np.uint8)
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(png_bytes(px.tobytes(), h, w, c))
        made[name] = px
    (root / "broken.png").write_bytes(b"\x89PNG nothing")
    (root / "notes.txt").write_text("no image")
    return root, made


def test_listing_order_and_suffixes(spark, pictures):
    root, _ = pictures
    assert [r.name for r in files.list_images(spark, str(root)).collect()] == ["A.PNG", "b.png", "broken.png"]
    deep = files.list_images(spark, str(root), recursive=True, sink=f"{root}/out")
    assert [r.name for r in deep.collect()] == ["A.PNG", "b.png", "broken.png", "c.png"]


def test_listing_reads_no_content(spark, pictures):
    plan = files.list_files(spark, str(pictures[0]))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_decode_and_rejects(spark, pictures):
    root, made = pictures
    good, bad = images.read_images(spark, str(root))
    got = {r.name: r for r in good.collect()}
    assert set(got) == {"A.PNG", "b.png", "c.png", "done.png"}
    assert got["b.png"].px == made["b.png"].tobytes() and got["A.PNG"].px == made["A.PNG"].tobytes()
    assert (got["c.png"].n_channels, got["c.png"].height) == (4, 3)
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["broken.png"]


def test_digests(spark, pictures):
    import hashlib
    root, _ = pictures
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in images.file_digests(spark, str(root)).collect()}
    assert got["b.png"] == hashlib.sha256((root / "b.png").read_bytes()).hexdigest() and "notes.txt" not in got


def test_objects_have_relative_keys(spark, pictures):
    keys = {r.key for r in files.list_objects(spark, str(pictures[0])).collect()}
    assert {"b.png", "sub/c.png", "notes.txt"} <= keys


def test_crop_manifests(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    good = {"sourceDir": "/src", "sinkDir": "/snk", "defaultCropSize": {"w": 64, "h": 32}, "crops": [
        {"imagePath": "a.png", "annotation": "cat 1", "x1": 3, "y1": 4, "w": 5, "h": 6},
        {"imagePath": "/abs/b.png", "cropTopLeft": {"x": 10, "y": 20}, "cropBottomRight": {"x": 19, "y": 24}},
        {"imagePath": "c.png", "cropX1": 1, "cropY1": 2, "cropWidth": 7, "cropHeight": 8, "annotation": " "},
        {"imagePath": "d.png", "x1": 0, "y1": 0}, {"imagePath": "e.png"}, {"imagePath": " "}]}
    (tmp_path / "deep" / "crop_metadata_1.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "crop_metadata_2.json").write_text('{"sourceDir": "/x"}')
    (tmp_path / "crop_metadata_3.json").write_text("{ not json")
    (tmp_path / "other.json").write_text(json.dumps(good))
    docs, bad = manifests.read_crop_manifests(spark, str(tmp_path))
    assert {(r.manifest.rsplit("_", 1)[1], r.reason) for r in bad.collect()} == {("2.json", "missing key 'crops'"), ("3.json", "not JSON")}
    rows = C.normalise_requests(manifests.crop_requests(docs)).orderBy("ordinal").collect()
    assert [(r.x, r.y, r.w, r.h, r.complete) for r in rows] == [
        (3, 4, 5, 6, True), (10, 20, 10, 5, True), (1, 2, 7, 8, True), (0, 0, 64, 32, True), (None, None, 64, 32, False),
        (None, None, 64, 32, False)]
    assert [r.prefix for r in rows][:3] == ["cat_1", "Crop", "Crop"]
    placed = C.normalise_requests(manifests.crop_requests(docs)).select("ordinal", X.image_location("image_path", "source_dir").alias("p"))
    assert [r.p for r in placed.orderBy("ordinal").collect()][:2] == ["/src/a.png", "/abs/b.png"]


def test_segment_manifests(spark, tmp_path):
    doc = {"videoPath": "/v.mp4", "extractionOptions": {"useCustomMpdecimateParams": True, "mpdecimateHi": 700, "useSceneChanges": False,
           "sceneThreshold": 0.5, "skipDarkFrames": True}, "segments": {"segment_1": {"start": 1, "end": 4}, "segment_2": {"prefix": "X"}}}
    (tmp_path / "video_frame_extraction_segments_1.json").write_text(json.dumps(doc, indent=1))
    rows = manifests.read_segment_manifests(spark, str(tmp_path)).orderBy("segment").collect()
    assert [(r.start_s, r.end_s, r.prefix) for r in rows] == [(1, 4, "Frame_"), (-1, -1, "X")]
    r = rows[0]
    assert (r.hi, r.lo, r.frac, r.scene_threshold, r.min_luma, r.fps, r.drop_duplicates) == (700, 192, 0.3, None, 20.0, None, False)


def nifti(data: np.ndarray, code: int, order="<", dim=None, offset=352.0, pixdim=(1, 2, 3, 4, 1, 1, 1, 1)) -> bytes:
    d, h, w = data.shape
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, *(dim or (3, w, h, d, 0, 0, 0, 0)))
    struct.pack_into(order + "hh", head, 70, code, data.dtype.itemsize * 8)
    struct.pack_into(order + "8f", head, 76, *pixdim)
    struct.pack_into(order + "f", head, 108, offset)
    return bytes(head) + data.astype(data.dtype.newbyteorder(order)).tobytes()


@pytest.fixture(scope="module")
def scans(tmp_path_factory):
    root = tmp_path_factory.mktemp("scans")
    a = np.arange(2 * 3 * 4, dtype="i2").reshape(2, 3, 4)
    b = (np.arange(5 * 2 * 2, dtype="f4") / 3).reshape(5, 2, 2)
    (root / "a.nii").write_bytes(nifti(a, 4))
    (root / "B.NII.GZ").write_bytes(gzip.compress(nifti(b, 16, ">", offset=-1.0, pixdim=(9, 0.5, float("nan"), -2, 1, 1, 1, 1))))
    (root / "c.nii").write_bytes(nifti(a, 1024))
    (root / "d.nii").write_bytes(b"tiny")
    (root / "e.nii").write_bytes(bytes(400))
    return root, a, b


def test_volume_headers(spark, scans):
    root, _, _ = scans
    h = {r.path.rsplit("/", 1)[1]: r for r in volumes.read_headers(spark, str(root)).collect()}
    assert list(h["a.nii"].dim) == [3, 4, 3, 2, 1, 1, 1, 1] and list(h["a.nii"].pixdim)[:4] == [1.0, 2.0, 3.0, 4.0]
    b = h["B.NII.GZ"]
    assert b.big_endian and b.vox_offset == 352 and list(b.pixdim)[:4] == [3.0, 0.5, 1.0, 1.0]
    assert {n: r.reject for n, r in h.items() if r.reject} == {
        "c.nii": "unsupported type int64", "d.nii": "unexpected end of file", "e.nii": "invalid header size"}


def test_volume_slices(spark, scans):
    root, a, b = scans
    s = volumes.read_slices(volumes.read_headers(spark, str(root)), slices_per_task=2)
    got = {(r.volume_id.rsplit("/", 1)[1], r.z): r for r in s.collect()}
    assert len(got) == 7
    for name, data in (("a.nii", a), ("B.NII.GZ", b)):
        for z in range(len(data)):
            assert np.allclose(got[(name, z)].vox, data[z].ravel()) and got[(name, z)].width == data.shape[2]
    views = {(r.volume_id.rsplit("/", 1)[1], r.view, r["index"]): r for r in O.all_views(s).collect()}
    assert np.allclose(views[("a.nii", "coronal", 1)].vox, a[:, 1, :].ravel())
    assert np.allclose(views[("a.nii", "sagittal", 3)].vox, a[:, :, 3].ravel())


def test_dicom_screen(spark, tmp_path):
    body = bytes(128) + b"DICM" + bytes(20)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "ok.DCM").write_bytes(body)
    (tmp_path / "bad.dcm").write_bytes(bytes(200))
    (tmp_path / "small.dcm").write_bytes(b"DICM")
    (tmp_path / "x.bin").write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r.verdict for r in dicom.screen_files(spark, str(tmp_path)).collect()}
    assert got == {"ok.DCM": "ok", "bad.dcm": "not a valid DICOM file", "small.dcm": "file too small"}
    assert dicom.screen_files(spark, str(tmp_path), skip_validation=True).where("verdict = 'ok'").count() == 3
    out = dicom.screen_files(spark, str(tmp_path)).where("verdict = 'ok'").select(
        dicom.output_path(F.col("path"), str(tmp_path), "/out", True).alias("p")).first().p
    assert out == "/out/sub/ok.png"


def test_text_helpers(spark):
    assert X.scope_prefix(" /b/x/y ", "b") == "x/y/" and X.scope_prefix("b/", "b") == "" and X.scope_prefix("", "b") == ""
    df = spark.createDataFrame([("a_64x64_00012.png",), ("a_1_x.png",), ("noext",), (".hidden",)], "n string")
    assert [r.s for r in df.select(X.sequence_in_name("n").alias("s")).collect()] == [12, None, None, None]
    assert [r.s for r in df.select(X.export_name(F.lit(None), "n", "png").alias("s")).collect()][2:] == ["noext.png", ".hidden.png"]


def test_manifests_that_need_no_order_are_not_shuffled(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"crop_metadata_{k}.json").write_text(json.dumps({"sourceDir": f"/{k}", "crops": [{"imagePath": "a.png"}]}))
    ordered, _ = manifests.read_crop_manifests(spark, str(tmp_path))
    plain, _ = manifests.read_crop_manifests(spark, str(tmp_path), ordered=False)
    assert sorted(r.sourceDir for r in plain.collect()) == [r.sourceDir for r in ordered.collect()]
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_small_images_come_many_to_a_task(spark, tmp_path):
    """A scan counts 4 MB a file; where their number is known, files are not dealt 32 to a task."""
    rows = spark.range(400).selectExpr("id", "unhex(repeat('7F', 12)) as px", "2 as height", "2 as width", "3 as n_channels")
    target = F.concat(F.lit(f"{tmp_path}/"), F.col("id").cast("string"), F.lit(".png"))
    n = write_png(rows, target).count()
    found, _ = images.read_images(spark, str(tmp_path), n_files=n)
    assert n == 400 and found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.select("name").distinct().count() == 400
