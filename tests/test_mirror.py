"""Head-first mirror: order, offsets, replays, late objects, outcomes."""

import os
import random
import time

import pyarrow.fs as pafs
import pytest

from framewright.registry import QUERIES, load
from framewright.registry import ORACLE
from framewright.sources import head_first as H
from framewright.streaming import mirror
from tests.oracle import compare

PNG = b"\x89PNG\r\n\x1a\n...."


def put(root, key, data=PNG, at=None):
    path = os.path.join(root, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    if at is not None:
        os.utime(path, (at, at))


@pytest.fixture
def store(tmp_path):
    root = str(tmp_path / "store")
    rng = random.Random(3)
    keys = {f"{rng.choice('aAbB')}{rng.choice(['', '.', '-x', 'z/'])}{rng.choice(['', 'C/', 'c/', 'c.d/'])}{rng.choice('aAbB')}{i}.{rng.choice(['png', 'PNG', 'jpg', 'txt'])}"
            for i in range(120)}
    for k in keys | {"Readme.md", "b.png", "B/a.gif", "b/a.gif", "b/Z.bmp"}:
        put(root, k)
    return root


def images(root):
    found = []
    for d, _, names in os.walk(root):
        found += [os.path.relpath(os.path.join(d, n), root) for n in names]
    return sorted((k for k in found if k.lower().endswith(H._SUFFIXES)), key=H.in_order)


def test_walk_is_in_key_order_from_any_place(store):
    fs = pafs.LocalFileSystem()
    every = [k for k, _, _ in H.walk(fs, store)]
    assert [k for k in every if k.lower().endswith(H._SUFFIXES)] == images(store) and every == sorted(every, key=H.in_order)
    for k in every[::7]:
        assert [o[0] for o in H.walk(fs, store, after=H.in_order(k))] == every[every.index(k) + 1:]


def test_walk_opens_no_folder_that_lies_behind(store, monkeypatch):
    opened = []

    class Counting:
        def get_file_info(self, selector):
            opened.append(selector.base_dir)
            return pafs.LocalFileSystem().get_file_info(selector)
    list(H.walk(Counting(), store, after=H.in_order("b/zz")))
    assert not any(os.path.relpath(d, store).lower().startswith("a") for d in opened)


def rows_of(reader, offset):
    rows, end = reader.read(offset)
    rows = list(rows)
    assert list(reader.readBetweenOffsets(offset, end)) == rows  # a batch that runs again is the same one
    return rows, end


def test_admissions_and_later_passes(store):
    reader = H.HeadFirstReader({"path": store, "head": "5", "tail": "30", "settle": "0"})
    time.sleep(0.01)
    offset, got, sizes = reader.initialOffset(), [], []
    while True:
        rows, end = rows_of(reader, offset)
        if not rows:
            assert end == offset
            break
        got += rows
        sizes.append(len(rows))
        offset = end
    assert [r[0] for r in got] == images(store) and sizes[0] == 5 and set(sizes[1:-1]) <= {30}
    assert {r[4] for r in got[:5]} == {"head"} and {r[4] for r in got[5:]} == {"tail"}
    time.sleep(0.01)
    put(store, "0first.png")  # sorts before all that was given
    put(store, "b.png")  # changed
    time.sleep(0.01)
    rows, offset = rows_of(reader, offset)
    assert [r[0] for r in rows] == ["0first.png", "b.png"] and rows[0][4] == "tail"
    put(store, "fresh.png", at=time.time() + 50)  # not before it has settled
    assert rows_of(reader, offset)[0] == []


def test_what_comes_while_a_pass_runs_is_in_the_next_one(store):
    reader = H.HeadFirstReader({"path": store, "head": "5", "tail": "1000", "settle": "0"})
    time.sleep(0.01)
    _, offset = rows_of(reader, reader.initialOffset())
    time.sleep(0.01)
    put(store, "0late.png")
    put(store, "zzlate.png")
    time.sleep(0.01)
    rest, offset = rows_of(reader, offset)
    assert "zzlate.png" not in {r[0] for r in rest}
    late, offset = rows_of(reader, offset)
    assert [r[0] for r in late] == ["0late.png", "zzlate.png"] and rows_of(reader, offset)[0] == []


def test_scope_and_wrong_options(store):
    reader = H.HeadFirstReader({"path": store, "scope": "b/", "settle": "0"})
    time.sleep(0.01)
    assert [r[0] for r in reader.read(reader.initialOffset())[0]] == [k for k in images(store) if k.startswith("b/")][:20]
    with pytest.raises(ValueError):
        H.HeadFirstReader({"path": store, "head": "0"})
    assert list(H.HeadFirstReader({"path": store + "-none"}).read({"since": -1, "until": -1, "fold": "", "key": "", "admission": 0})[0]) == []


def test_mirror_goes_on_after_a_stop(spark, store, tmp_path):
    put(store, "a/empty.png", b"")
    put(store, "a/text.png", b"no image")
    held = str(tmp_path / "mirror")
    put(held, "b.png", b"already here")
    put(held, "b/a.gif", b"")
    time.sleep(0.01)
    args = (spark, store, held, str(tmp_path / "out"), str(tmp_path / "cp"), 5, 40)
    for _ in range(5):
        mirror.mirror_stream(*args, settle_ms=0).awaitTermination(120)
    got = {r.key: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got, key=H.in_order) == images(store)
    assert {k for k, r in got.items() if r.outcome == "failed"} == {"a/empty.png", "a/text.png"}
    assert {k for k, r in got.items() if r.outcome == "skipped"} == {"b.png"}
    assert set(images(held)) == set(got) - {"a/empty.png", "a/text.png"} and open(f"{held}/b/a.gif", "rb").read() == PNG
    assert not [n for _, _, names in os.walk(held) for n in names if n.endswith(".part")]
    totals = {r.phase: (r.total, r.downloaded + r.skipped + r.failed) for r in mirror.mirror_totals(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert totals["head"] == (5, 5) and sum(t for t, _ in totals.values()) == len(got)


def test_query(spark, sf):
    load()
    assert compare(spark, sf, QUERIES["str3_stream_mirror"], ORACLE["str3_stream_mirror"]) == []
