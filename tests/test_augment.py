"""Rotated tiles and flips as files, and the commit of written files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions.pixels import rotate_block
from framewright.jobs import augment
from framewright.operators import rotation as R
from framewright.registry import ORACLE, QUERIES, load
from framewright.sinks import staged
from framewright.sinks.png import png_bytes
from tests.oracle import compare

SCHEMA = "image_id long, width int, height int, n_channels int, px binary"


def files_below(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


@pytest.mark.parametrize("tasks", [None, 5])
def test_tiles_are_cut_from_the_turned_image(spark, tasks):
    rng = np.random.default_rng(1)
    shapes = [(40, 61, 1), (64, 48, 3), (33, 33, 4), (7, 200, 1)]
    images = {k: rng.integers(0, 256, s, dtype=np.uint8) for k, s in enumerate(shapes)}
    df = spark.createDataFrame([(k, s[1], s[0], s[2], images[k].tobytes()) for k, s in enumerate(shapes)], SCHEMA)
    angles = (0, 10, 30, 45, 60, 80, 90)
    got = R.rotated_tile_pixels(df, 7, 5, angles, tasks).collect()
    places = {(r.image_id, r.angle, r.ordinal): (int(round(r.x, 6)), int(round(r.y, 6))) for r in
              R.tile_regions(R.with_angles(df.drop("px"), angles), 7, 5).where("in_bounds").collect()}
    assert {(r.image_id, r.angle, r.ordinal) for r in got} == set(places) and len(got) > 300
    turned = {(k, a): rotate_block(images[k][None], a)[0] for k in images for a in angles}
    for r in got:
        x, y = places[r.image_id, r.angle, r.ordinal]
        want = turned[r.image_id, r.angle][y:y + 5, x:x + 7]
        assert want.shape[:2] == (r.height, r.width) and want.tobytes() == r.px, (r.image_id, r.angle, r.ordinal)


def test_a_tile_travels_with_the_rows_below_it_only(spark):
    df = spark.createDataFrame([(1, 400, 300, 1, bytes(120_000))], SCHEMA)
    tiles = R.rotated_tile_pixels(df, 20, 10, (0, 30), 4)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(image_id" in plan and "substring(px" in plan
    assert tiles.count() > 100


def test_query(spark, sf):
    load()
    assert compare(spark, sf, QUERIES["snk7_rotated_tile_pixels"], ORACLE["snk7_rotated_tile_pixels"]) == []


def test_files_of_a_folder(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "deep").mkdir(parents=True)
    px = np.arange(40 * 30, dtype=np.int64).reshape(30, 40).astype(np.uint8)
    for p in ("a.png", "deep/a.PNG"):
        (src / p).write_bytes(png_bytes(px.tobytes(), 30, 40, 1))
    (src / "bad.png").write_bytes(b"no image")
    counts = {(r.path.rpartition("in/")[2], r.angle): r.tiles for r in
              augment.run(spark, str(src), str(out), 8, 6, (0, 90), recursive=True).collect()}
    assert set(counts) == {("a.png", 0), ("a.png", 90), ("deep/a.PNG", 0), ("deep/a.PNG", 90)}
    names = [n for n in files_below(out) if n.endswith(".png")]
    tiles = [n for n in names if "/cropped/angle/" in n]
    assert len(tiles) == sum(counts.values()) and len(names) == 4 * len(tiles)
    assert any(n.startswith("deep/a.PNG/cropped/augmented_data/90/Flipped both/8x6/") for n in names)
    tile = spark.read.format("image").load(f"{out}/a.png/cropped/angle/0/8_x_6").select("image.data", "image.origin").collect()
    places = {r.ordinal: (int(round(r.x, 6)), int(round(r.y, 6))) for r in R.tile_regions(
        spark.createDataFrame([(40, 30, 0)], "width int, height int, angle int"), 8, 6).where("in_bounds").collect()}
    for r in tile:
        x, y = places[int(r.origin.rpartition("_")[2].removesuffix(".png"))]
        assert bytes(r.data) == px[y:y + 6, x:x + 8].tobytes()
    assert not [n for n in os.listdir(out) if n.startswith("._staging")]


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    root = tmp_path / "sink"
    rows = spark.range(0, 40, 1, 4).select(F.format_string("d%d/%d.bin", F.col("id") % 3, "id").alias("path"), F.col("id").cast("string").cast("binary").alias("data"))
    broken = rows.withColumn("data", F.when(F.col("path") == "d0/39.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        staged.write_staged(broken, str(root))
    assert not root.exists() or os.listdir(root) == []
    staged.write_staged(rows, str(root))
    assert files_below(root) == sorted(f"d{i % 3}/{i}.bin" for i in range(40)) and (root / "d0" / "39.bin").read_bytes() == b"39"
    again = rows.limit(1).withColumn("data", F.lit(b"new")).unionByName(spark.createDataFrame([(None, b"x"), ("n", None)], "path string, data binary"))
    staged.write_staged(again, str(root))
    assert (root / "d0" / "0.bin").read_bytes() == b"new" and len(files_below(root)) == 40
    staged.write_staged(rows.where("1 = 0"), str(tmp_path / "nothing"))


def test_only_the_attempt_that_counts_is_committed(tmp_path):
    import pyarrow as pa
    writer = staged.StagedWriter({"root": str(tmp_path)})
    batch = pa.RecordBatch.from_pydict({"path": ["a/x"], "data": [b"first"]})
    lost = writer.write(iter([batch]))
    taken = writer.write(iter([batch.set_column(1, "data", pa.array([b"second"]))]))
    assert files_below(tmp_path)[0].startswith("._staging") and lost.names != taken.names
    writer.commit([taken, None])
    assert files_below(tmp_path) == ["a/x"] and (tmp_path / "a" / "x").read_bytes() == b"second"


def test_a_task_that_outlives_the_abort_leaves_no_file(spark, tmp_path):
    """Spark aborts while other tasks still run, and some begin later."""
    import pyarrow as pa
    writer = staged.StagedWriter({"root": str(tmp_path)})
    batch = pa.RecordBatch.from_pydict({"path": ["a/x"], "data": [b"first"]})

    def aborted_meanwhile():
        yield batch
        writer.abort([])
        yield batch
    for late in (aborted_meanwhile(), iter([batch])):
        with pytest.raises(Exception):
            writer.write(late)
        assert os.listdir(tmp_path) == []
    rows = spark.range(0, 8, 1, 4).select(F.format_string("%d.bin", "id").alias("path"), F.lit(b"x").alias("data"))
    lost = rows.withColumn("path", F.when(F.col("path") == "7.bin", F.raise_error(F.lit("lost"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="lost"):
        staged.write_staged(lost.repartition(3, "path"), str(tmp_path))
    assert os.listdir(tmp_path) == []
