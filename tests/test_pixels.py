"""Pixel kernels: hand-made values and algebraic properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.fixtures import views
from framewright.functions import pixels as P
from framewright.functions import geometry as G
from framewright.operators import crops as C
from framewright.operators import curation as U
from framewright.operators import rotation as T
from framewright.operators import similarity as S

IMAGE = ("px", "height", "width", "n_channels")


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i, (h, w, c) in enumerate([(8, 9, 1), (17, 12, 3), (5, 4, 4), (2, 2, 1), (30, 40, 3), (8, 9, 1)]):
        rows.append((i, h, w, c, rng.integers(0, 256, (h, w, c), np.uint8).tobytes()))
    rows.append((6, 3, 3, 1, b"short"))
    rows.append((7, 3, 3, 1, None))
    return spark.createDataFrame(rows, "image_id long, height int, width int, n_channels int, px binary")


def test_bad_rows_become_null_and_good_ones_stay(images):
    m = {r.image_id: r for r in U.measure(images).collect()}
    assert m[6].var_laplacian is None and m[7].mean_luma is None
    assert m[3].var_laplacian == 0.0 and m[0].var_laplacian > 0
    assert {r.image_id for r in U.unreadable(U.measure(images)).collect()} == {6, 7}


def test_measures_match_plain_loops(images):
    for r in images.where("image_id < 6").collect():
        px = np.frombuffer(r.px, np.uint8).reshape(r.height, r.width, r.n_channels).astype(int)
        g = px[..., 0] if r.n_channels < 3 else (77 * px[..., 2] + 150 * px[..., 1] + 29 * px[..., 0] + 128) // 256
        lap = [g[y - 1, x] + g[y + 1, x] + g[y, x - 1] + g[y, x + 1] - 4 * g[y, x]
               for y in range(1, r.height - 1) for x in range(1, r.width - 1)]
        got = U.measure(images.where(F.col("image_id") == r.image_id)).first()
        assert got.mean_luma == pytest.approx(g.mean())
        assert got.var_laplacian == pytest.approx(np.var(lap) if lap else 0.0)


def test_users_can_add_a_measure(images):
    rows = U.with_measure(images, "top", lambda block: block.max(axis=(1, 2, 3))).orderBy("image_id").collect()
    assert [r.top for r in rows][:6] == [max(r.px) for r in rows[:6]] and rows[6].top is None and rows[7].top is None


def test_flips_undo_themselves(images):
    once = images.where("image_id < 6").withColumns({
        "hh": P.flip_horizontal(P.flip_horizontal(*IMAGE), *IMAGE[1:]), "vv": P.flip_vertical(P.flip_vertical(*IMAGE), *IMAGE[1:]),
        "hv": P.flip_vertical(P.flip_horizontal(*IMAGE), *IMAGE[1:]), "b": P.flip_both(*IMAGE)})
    for r in once.collect():
        assert r.hh == r.px and r.vv == r.px and r.hv == r.b


def test_four_quarter_turns_are_identity(images):
    out = images.where("image_id < 6").withColumn("angle", F.lit(90))
    for _ in range(4):
        out = T.rotate(out)
    got = {r.image_id: r for r in out.collect()}
    for r in images.where("image_id < 6").collect():
        assert got[r.image_id].px == r.px and got[r.image_id].width == r.width


def test_an_image_equals_itself(images):
    a = [F.col(c) for c in IMAGE]
    for r in images.where("image_id < 6").select(P.pair_scores(*a, *a).alias("s")).collect():
        assert math.isinf(r.s.psnr) and r.s.ssim == pytest.approx(1.0)


def test_scores_use_the_common_minimum_size(spark):
    big = np.full((6, 8, 1), 10, np.uint8).tobytes()
    small = np.full((3, 4, 1), 20, np.uint8).tobytes()
    df = spark.createDataFrame([(big, 6, 8, 1, small, 3, 4, 1)], "a binary, ah int, aw int, ac int, b binary, bh int, bw int, bc int")
    s = df.select(P.pair_scores(*df.columns).alias("s")).first().s
    assert s.psnr == pytest.approx(10 * math.log10(65025 / 100))
    one = spark.createDataFrame([(b"\x01", 1, 1, 1)], "px binary, height int, width int, n_channels int")
    assert one.select(P.pair_scores(*IMAGE, *IMAGE).alias("s")).first().s.ssim is None


def test_black_becomes_transparent(spark):
    df = spark.createDataFrame([(bytes([0, 0, 0, 1, 2, 3]), 1, 2, 3)], "px binary, height int, width int, n_channels int")
    assert df.select(P.black_to_transparent(*IMAGE).alias("p")).first().p == bytes([0, 0, 0, 0, 1, 2, 3, 255])


@pytest.mark.parametrize("decodes", [2, 256])
def test_render_cuts_hot_images_in_parts(spark, images, monkeypatch, decodes):
    monkeypatch.setattr(C, "MAX_CROPS_PER_DECODE", 3)
    monkeypatch.setattr(C, "MAX_DECODES_PER_TASK", decodes)
    boxes = spark.createDataFrame([(4, i, i % 30, i % 20, 5, 6) for i in range(40)] + [(1, 99, 0, 0, 12, 17), (1, 98, 5, 5, 90, 2)],
                                  "image_id long, box int, x int, y int, w int, h int")
    got = {(r.image_id, r.box): r for r in C.render(boxes, images, "image_id", ["box"]).collect()}
    src = {r.image_id: np.frombuffer(r.px, np.uint8).reshape(r.height, r.width, r.n_channels) for r in images.where("image_id in (1,4)").collect()}
    assert len(got) == 41 and (1, 98) not in got
    for (i, _), r in got.items():
        assert r.px == src[i][r.y:r.y + r.h, r.x:r.x + r.w].tobytes()


def test_curation_goldens(spark):
    decided = U.decide(U.measure(views.thumbs(spark, "/root/testdata/sf0.01")))
    counts = {r.reason: r["count"] for r in decided.groupBy("reason").count().collect()}
    assert counts == {"": 1444, "blurry": 290, "blurry dark": 210, "dark": 56}


def test_distance_goldens_on_both_routes(spark):
    measured = U.measure(views.thumbs(spark, "/root/testdata/sf0.01")).persist()
    for limit in (1_000_000, 100):
        d = S.hash_distances(measured, max_group_rows=limit)
        row = d.agg(F.count("*"), *[F.count_if(F.col("distance") <= t) for t in (3, 5, 8)]).first()
        assert tuple(row) == (1995, 1052, 1207, 1353)
    measured.unpersist()


def test_screened_pairs_keep_near_hashes_only(spark, sf):
    images = views.thumbs(spark, sf)
    screened = S.screened_pairs(U.measure(images), images)
    assert screened.where("distance > 8").count() == 0
    assert screened.where("psnr is null").count() == 0


def test_rotation_goldens(spark):
    one = spark.createDataFrame([(1, 1000, 800)], "image_id long, width int, height int")
    per = T.tile_regions(T.with_angles(one), 256, 256).groupBy("angle").count().orderBy("angle").collect()
    assert [r["count"] for r in per] == [36, 24, 24, 16, 16, 16, 24, 24, 24, 36]


@pytest.mark.parametrize("angle", [60, 80])
def test_rotation_count_of_oblong_tiles(spark, angle):
    """Steep turns: rows step by the tile's height across and by its width down, and the
    last row is measured by the tile's height."""
    width, height, cw, ch = 1600, 1186, 128, 96
    s, c = math.sin(math.radians(angle)), math.cos(math.radians(angle))
    h1, x1 = ch * s * s, ch * s * c
    across = int((width * s - h1 + ch - x1) / ch)
    down = int((height * s - h1 + ch - x1) / cw)
    one = spark.createDataFrame([(1, width, height)], "image_id long, width int, height int")
    got = T.tile_regions(T.with_angles(one, (angle,)), cw, ch).first()
    assert (got.n_across, got.n_down) == (across, down)
    assert down != int((height * s - h1 + cw - x1) / cw) or angle == 80


def test_geometry_map_spelling(spark):
    one = spark.createDataFrame([(1, 1000, 800)], "image_id long, width int, height int")
    rows = T.with_geometry(T.with_angles(one, (10, 50)), 256, 256).select("angle", T.geometry_map().alias("m")).collect()
    maps = {r.angle: r.m for r in rows}
    assert len(maps[10]) == len(maps[50]) == 19 and "xb" in maps[10] and "Xb" in maps[50]


@pytest.mark.parametrize("box, ok", [((0, 0, 10, 8), True), ((0, 0, 11, 8), False), ((-1, 0, 2, 2), False), ((9, 7, 1, 1), True),
                                     ((9, 7, 2, 1), False), ((0, 0, 0, 3), False)])
def test_bounds_edges(spark, box, ok):
    df = spark.createDataFrame([(*box, 10, 8)], "x int, y int, w int, h int, iw int, ih int")
    assert df.select(G.inside_image("x", "y", "w", "h", "iw", "ih").alias("ok")).first().ok is ok


def test_coco_box_options(spark):
    df = spark.createDataFrame([(5, 9, 2, -4, 6, 20)], "x1 int, y1 int, x2 int, y2 int, w int, h int")
    plain, exact = (df.select(G.coco_box("x1", "y1", "x2", "y2", "w", "h", e).alias("b")).first().b for e in (False, True))
    assert plain == [2, 0, 3, 9] and exact == [2, 0, 4, 10]


def test_tiles_never_vanish(spark):
    df = spark.createDataFrame([(1, 0, 0, 3, 3)], "id int, x int, y int, w int, h int")
    tiles = C.tile_levels(df)
    assert tiles.count() == 21 and tiles.agg(F.min("w"), F.min("h")).first() == (1, 1)
