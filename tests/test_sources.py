"""Sources, sinks and streams through files."""

import struct
import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from orbitweave.sources import images, labels, orbit, tables
from orbitweave.streaming import runs


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿pair_id,source_path,reference_path\np1,a,b\n", "utf-8")
    assert rows(tables.read_csv(spark, str(tmp_path / "t.csv"), tables.PAIRS)) == [("p1", "a", "b")]
    assert tables.read_optional(spark, str(tmp_path / "none.csv"), tables.MANIFEST).count() == 0
    (tmp_path / "g.csv").write_text("Pixel,Scan,Longitude,Latitude\n0,0,10,20\n1,0,11,20\n")
    assert rows(tables.read_grid(spark, str(tmp_path / "g.csv")).select("pixel", "longitude")) == [(0.0, 10.0), (1.0, 11.0)]
    (tmp_path / "e.csv").write_text("Pixel,Scan,Longitude,Latitude\n")
    with pytest.raises(ValueError):
        tables.read_grid(spark, str(tmp_path / "e.csv"))
    points = tables.tie_points(spark.createDataFrame([(1.5, True, "available")], "source_x double, inlier boolean, status string"))
    assert points.columns == tables.TIE_POINTS
    tables.write_csv(points, str(tmp_path / "tie"))
    back = tables.coerced(tables.read_text_columns(spark, str(tmp_path / "tie"))).first()
    assert (back["source_x"], back["inlier"], back["status"], back["confidence"]) == (1.5, True, "available", None)
    tables.write_csv(points.limit(0), str(tmp_path / "empty"))
    assert len(tables.TIE_POINTS) == 27
    h = spark.range(1).select(tables.homography(F.lit("[[1,0,2],[0,1,3],[0,0,1]]")).alias("a"), tables.homography(F.lit("x")).alias("b")).first()
    assert h["a"] == [1, 0, 2, 0, 1, 3, 0, 0, 1] and h["b"] is None
    (tmp_path / "m.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("no")
    assert sorted(str(r["document"]) for r in tables.read_json(spark, str(tmp_path / "*.json"), "a int").collect()) == ["Row(a=1)", "Row(a=None)"]


def test_labels(spark, tmp_path):
    (tmp_path / "x.lbl").write_text('LINES = 2\nLINE_SAMPLES = 3 <px>\nSAMPLE_TYPE = "MSB_UNSIGNED"\nSAMPLE_BITS = 16\nnoise\nDUMMY = -1\nLINES = 4\n')
    got = labels.raster_layout(labels.read(spark, str(tmp_path / "x.lbl"))).first()
    assert (got["lines"], got["samples"], got["dtype"], got["dummy"], got["scaling"]) == (4, 3, ">u2", -1.0, 1.0)
    (tmp_path / "y.xml").write_text('<p:Product xmlns:p="u"><File><file_name>y.img</file_name></File><p:Array_2D_Image><offset unit="byte">8</offset><Axis_Array><axis_name>Sample</axis_name><elements>5</elements><sequence_number>2</sequence_number></Axis_Array><Axis_Array><axis_name>Line</axis_name><elements>7</elements><sequence_number>1</sequence_number></Axis_Array><Element_Array><data_type>UnsignedLSB2</data_type></Element_Array></p:Array_2D_Image></p:Product>')
    got = labels.xml_layout(spark, str(tmp_path / "y.xml")).first()
    assert (got["lines"], got["samples"], got["dtype"], got["byte_offset"], got["file_name"]) == (7, 5, "<u2", 8, "y.img")


def oat_line(number=7):
    line = [" "] * orbit.LENGTH
    put = lambda a, s: line.__setitem__(slice(a, a + len(s)), list(s))
    put(0, orbit.TAG)
    put(8, f"{number:6d}")
    for (a, b), v in zip(orbit.TIME, (2024, 2, 29, 13, 5, 59, 250)):
        put(a, f"{v:{b - a}d}")
    for k, (a, b) in enumerate(orbit.NUMBERS.values()):
        put(a, f"{k + 0.5:{b - a}.2f}")
    put(516, "12345")
    return "".join(line)


def test_orbit(spark, tmp_path):
    import datetime as dt

    (tmp_path / "o.txt").write_text("header\n" + oat_line() + "\n" + orbit.TAG + " short\n")
    got = {r["valid"]: r for r in orbit.read(spark, str(tmp_path / "o.txt")).collect()}
    ok = got[True]
    assert ok["record_number"] == 7 and ok["time"] == dt.datetime(2024, 2, 29, 13, 5, 59, 250000) and ok["orbit_number"] == 12345
    assert [ok[n] for n in orbit.NUMBERS] == [k + 0.5 for k in range(len(orbit.NUMBERS))] and got[False]["px"] is None
    head = orbit.header(spark.createDataFrame([("x" * 99 + "    12" + "   600" + "1" + "z",)], "value string")).first()
    assert (head["record_count"], head["record_length"], head["attitude_flag"], head["phase_flag"]) == (12, 600, 1, None)


def tiff(a):
    data = a.astype("<i2").tobytes()
    tags = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(data)), (339, 3, 2)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return b"II" + struct.pack("<HI", 42, 8 + len(data)) + data + ifd


def filtered_png(a, kind):
    """A PNG whose rows use one filter."""
    h, w = a.shape
    out, above = b"", np.zeros(w, int)
    for row in a.astype(int):
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: np.choose(d.argmin(0), [left, above, corner])}[kind]
        out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (20, 30))
    assert (images.decode_png(images.encode_png(a)) == a).all()
    for kind in range(5):
        assert (images.decode_png(filtered_png(a, kind)) == a).all()
    assert (images.decode_tiff(tiff(a - 100))[0] == a - 100).all()
    assert (images.decode_pgm(b"P5\n30 20\n255\n" + a.astype(np.uint8).tobytes()) == a).all()
    assert (images.decode_raw(b"head" + a.astype(">u2").tobytes(), 20, 30, ">u2", 4) == a).all()
    with pytest.raises(ValueError):
        images.decode_raw(b"x", 20, 30, ">u2")
    (tmp_path / "a.png").write_bytes(images.encode_png(a))
    (tmp_path / "b.img").write_bytes(a.astype(">u2").tobytes())
    (tmp_path / "bad.png").write_bytes(b"junk")
    layout = spark.createDataFrame([("b", 20, 30, ">u2")], "stem string, lines int, samples int, dtype string")
    px = images.tile_pixels(images.read_tiles(spark, str(tmp_path), layout, tile=16))
    for name in ("a.png", "b.img"):
        got = {(x["y"], x["x"]): x["v"] for x in px.where(F.col("path").endswith(name)).collect()}
        assert len(got) == 600 and all(got[y, x] == a[y, x] for y in range(20) for x in range(30))
    assert px.where(F.col("path").endswith("bad.png")).count() == 0


def test_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    data = [(f"r{i % 5}", f"2024-01-01 0{i}:00:00", "completed", float(i)) for i in range(6)]
    df = spark.createDataFrame(data, "run_id string, created_at string, status string, total_seconds double").withColumn("created_at", F.col("created_at").cast("timestamp"))
    df.write.parquet(source)
    q = runs.start(runs.unique(runs.read(spark, source), "12 hours"), sink, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(sink).count() == 5
    q = runs.counts(runs.unique(runs.read(spark, source), "12 hours")).writeStream.format("memory").queryName("counted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").columns == ["window_start", "status", "runs", "mean_seconds"]


def test_inputs(spark, tmp_path):
    for p in ("data/c/data/x_d_img_1.img", "data/c/geometry/x_g_grd_1.csv", "data/c/data/x_d_img_1.xml", "dem/b.tif", "dem/a.TIFF", "dtm/1.lbl", "dtm/1.img", "dtm/2.lbl"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    files = tables.listing(spark, str(tmp_path / "*" / "*")).unionByName(tables.listing(spark, str(tmp_path / "data" / "*" / "*" / "*"))).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    assert tables.listing(spark, str(tmp_path / "none")).count() == 0
    root = str(tmp_path)
    manifest = spark.createDataFrame([(f"{root}/dtm/1.lbl", f"{root}/dtm/1.img"), (f"{root}/dtm/2.lbl", f"{root}/dtm/2.img")], tables.MANIFEST)
    got = tables.elevation_sources(manifest, files).orderBy("ordinal").collect()
    assert [(r["kind"], r["path"].removeprefix(root)) for r in got] == [("polar_dtm", "/dtm/1.img"), ("geotiff", "/dem/a.TIFF"), ("geotiff", "/dem/b.tif")]
    assert tables.elevation_sources(manifest.limit(0), files).count() == 2
    catalog = spark.createDataFrame([(1, f"{root}/data/c/data/x_d_img_1.img", "/b.png", "prod", "cam")], "ordinal int, " + tables.CATALOG)
    images_ = spark.createDataFrame([(1, "/b.png"), (2, "/other.png")], "image_id int, path string")
    rows_ = {r["image_id"]: r for r in tables.inputs(images_, catalog, files).collect()}
    assert rows_[1]["geometry_path"].endswith("x_g_grd_1.csv") and rows_[1]["label_path"].endswith(".xml") and rows_[1]["sensor"] == "cam"
    assert rows_[2]["native_path"] == "/other.png" and rows_[2]["label_path"] is None and rows_[2]["product_id"] is None


def test_written_tables_are_shared_and_cleared(spark, monkeypatch):
    from orbitweave import storage

    one = storage.written(spark.range(3), "own")
    assert one.count() == 3 and storage._paths
    kept, storage._paths[:] = storage._paths[:-1], storage._paths[-1:]
    assert storage.clear_written(spark) == 1 and storage.clear_written(spark) == 0
    storage._paths[:] = kept

    class Session:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session)
