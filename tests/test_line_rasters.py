"""Rasters read line by line: in many tasks, of the exact size, with a row for each that can't be read."""

import numpy as np

from orbitweave.sources import line_rasters as lr


def test_lines_are_read_in_many_tasks(spark, tmp_path):
    r = np.random.default_rng(5)
    images = {1: r.integers(-30000, 30000, (300, 40)).astype(">i2"), 2: r.integers(0, 255, (7, 5)).astype("u1"), 3: r.random((20, 3)).astype("<f4")}
    layouts = []
    for k, a in images.items():
        path = tmp_path / f"{k}.img"
        path.write_bytes(a.tobytes())
        layouts.append(lr.Layout(k, path.as_uri(), *a.shape, a.dtype.str))
    (tmp_path / "short.img").write_bytes(b"x" * 11)
    bad = [lr.Layout(4, (tmp_path / "short.img").as_uri(), 3, 4, "u1"), lr.Layout(5, (tmp_path / "none.img").as_uri(), 3, 4, "u1"), lr.Layout(6, layouts[0].path, None, 4, "u1"), lr.Layout(7, layouts[0].path, 3, 4, "colour")]
    table = spark.createDataFrame([(x.image_id, x.path, x.lines, x.samples, x.dtype) for x in layouts + bad], "image_id long, path string, lines int, samples int, dtype string")
    pixels, issues = lr.read(spark, lr.layouts_of(table), split=2000)
    got = {k: np.zeros(a.shape) for k, a in images.items()}
    n = 0
    for p in pixels.collect():
        got[p["image_id"]][p["y"], p["x"]] = p["v"]
        n += 1
    assert n == sum(a.size for a in images.values()) and all((got[k] == a.astype(float)).all() for k, a in images.items())
    assert {(i["image_id"], i["reason"]) for i in issues.collect()} == {(4, "size_11_label_12"), (5, "file_missing"), (6, "label_incomplete"), (7, "sample_type_unknown")}
    assert lr.lines_of(spark, layouts[0], 2000).rdd.getNumPartitions() >= 12
    assert [tuple(c) for c in lr.covered(pixels).where("image_id = 2").collect()] == [(2, 35, 7, 5)]
    none, _ = lr.read(spark, bad)
    assert none.count() == 0
