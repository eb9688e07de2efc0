"""Views and projections of volumes against plain arrays."""

import numpy as np
import pytest

from framewright.functions import voxels
from framewright.operators import volumes


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def cubes():
    rng = np.random.default_rng(8)
    out = {"whole": rng.integers(-900, 900, (7, 4, 5)).astype(float), "big": rng.integers(0, 1 << 20, (3, 6, 2)).astype(float),
           "real": rng.normal(size=(5, 3, 4)), "single": rng.normal(size=(4, 2, 2)).astype(np.float32).astype(float)}
    out["real"][1, 2, 3] = np.nan
    out["real"][:, 0, 1] = np.nan
    out["single"][0, 0, 0] = np.inf
    return out


@pytest.fixture(params=[1 << 25, 200])
def slices(request, spark, cubes, monkeypatch):
    """Slices out of order in several partitions; the second time tasks hold next to nothing."""
    rows = [(name, z, c.shape[2], c.shape[1], c[z].reshape(-1).tolist()) for name, c in cubes.items() for z in range(len(c))]
    rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    if request.param == 200:
        monkeypatch.setattr(voxels, "HELD_BYTES", 200)
    return spark.createDataFrame(rows, "volume_id string, z int, width int, height int, vox array<double>").repartition(3)


def test_views_like_transposed_arrays(slices, cubes):
    got = {(r.volume_id, r.view, r["index"]): r for r in volumes.all_views(slices).collect()}
    assert len(got) == sum(sum(c.shape) for c in cubes.values())
    for name, c in cubes.items():
        for view, axis in (("axial", 0), ("coronal", 1), ("sagittal", 2)):
            for k in range(c.shape[axis]):
                want = c.take(k, axis)
                r = got[name, view, k]
                assert (r.height, r.width) == want.shape
                np.testing.assert_array_equal(np.array(r.vox).reshape(want.shape), want)


def test_one_exchange_serves_both_views(spark):
    given = spark.range(1).selectExpr("id volume_id", "0 z", "1 width", "1 height", "array(1D) vox")
    assert exchanges(volumes.all_views(given)) == 1 == exchanges(volumes.project(given))


@pytest.mark.filterwarnings("ignore:All-NaN", "ignore:Mean of empty")
def test_projection_like_plain_arrays(slices, cubes):
    got = {(r.volume_id, r.y, r.x): (r.max_v, r.avg_v) for r in volumes.project(slices, "none").collect()}
    assert len(got) == sum(c.shape[1] * c.shape[2] for c in cubes.values())
    for (name, y, x), (peak, mean) in got.items():
        v = cubes[name][:, y, x]
        v = v[np.isfinite(v)]
        assert (peak, mean) == ((None, None) if not len(v) else (v.max(), pytest.approx(v.mean(), abs=1e-9)))


def test_odd_slices(spark):
    rows = [(None, 0, 2, 2, [1.0, 2.0, 3.0]), (None, 0, 2, 2, [5.0, None, 7.0, 8.0, 9.0]), (1, None, 2, 2, [1.0] * 4), (2, 0, None, 2, [1.0, 2.0]),
            (3, 0, 2, 1, None)]
    odd = spark.createDataFrame(rows, "volume_id long, z int, width int, height int, vox array<double>")
    cut = {(r.volume_id, r["index"], r.height): r.vox for r in volumes.slices_along(odd, 1).collect()}
    assert set(cut) == {(None, 0, 2), (None, 1, 2), (3, 0, 1)}
    np.testing.assert_array_equal(cut[None, 0, 2], [1, 2, 5, np.nan])
    np.testing.assert_array_equal(cut[None, 1, 2], [3, np.nan, 7, 8])
    flat = {(r.volume_id, r.y, r.x): (r.max_v, r.avg_v) for r in volumes.project(odd, "none").collect()}
    assert flat[None, 0, 0] == (5, 3) and flat[None, 0, 1] == (2, 2) and flat[None, 2, 0] == (9, 9)
    assert flat[1, 1, 1] == (1, 1) and flat[2, 0, 1] == (2, 2) and not any(k[0] == 3 for k in flat)
    assert volumes.all_views(odd.where("1 = 0")).count() == volumes.project(odd.where("1 = 0")).count() == 0


def test_voxels_travel_in_the_narrowest_exact_type():
    kinds = {"<i2": [1.0, -5.0], "<i4": [1e6, 2.0], "<f4": [0.5, np.nan], "<f8": [0.1, 3.0]}
    assert {voxels._narrowest(np.array(v)).dtype.str for v in kinds.values()} == set(kinds)
    assert voxels._narrowest(np.array([-0.0, 1.0])).dtype.str == "<f4"
