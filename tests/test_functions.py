"""Column functions on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.functions import camera, geometry, projection, text


def one(spark, **columns):
    return tuple(spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first())


L = lambda x: F.lit(None).cast("double") if x is None else F.lit(float(x))


def test_homography(spark):
    h = [1.02, 0.01, 5, -0.01, 0.98, -3, 0.0001, 0.0002, 1]
    x, y = geometry.project(L(10), L(20), h)
    p = np.array(h).reshape(3, 3) @ [10, 20, 1]
    assert one(spark, x=x, y=y) == pytest.approx(tuple(p[:2] / p[2]))
    x, y = geometry.project(L(0), L(5), [1, 0, 0, 0, 1, 0, 1, 0, 0])
    assert one(spark, x=x, y=y) == (0.0, 0.0)
    x, y = geometry.project(L(1), L(1), F.lit(None).cast("array<double>"))
    assert one(spark, x=x, y=y) == (None, None)
    composed = geometry.compose_scales(h, (0.5, 0.25), (2.0, 4.0))
    want = np.diag([1 / 2, 1 / 4, 1]) @ np.array(h).reshape(3, 3) @ np.diag([0.5, 0.25, 1])
    back = geometry.working_homography(composed, (0.5, 0.25), (2.0, 4.0))
    got = one(spark, c=composed, b=back)
    assert got[0] == pytest.approx(want.ravel().tolist()) and got[1] == pytest.approx(h)


def test_cells_bounds_thresholds(spark):
    assert one(spark, a=geometry.cell(L(-5), 100, 8), b=geometry.cell(L(99.9), 100, 8), c=geometry.cell(L(100), 100, 8), d=geometry.cell(L(12.5), 100, 8)) == (0, 7, 7, 1)
    assert one(spark, a=geometry.finite(L(1), L(2)), b=geometry.finite(L(1), L("nan")), c=geometry.finite(L(None)), d=geometry.finite(L("inf"))) == (True, False, False, False)
    assert one(spark, a=geometry.native_threshold(0.5, 1.0), b=geometry.native_threshold(0.0, 0.0), c=geometry.native_threshold(1.0, 0.25, 1.5)) == (5.0, 2.5, 6.0)
    assert one(spark, a=geometry.refinement_branch(L(0.75), F.lit(False), F.lit(False)), b=geometry.refinement_branch(L(0.5), F.lit(True), F.lit(True)), c=geometry.refinement_branch(L(None), F.lit(True), F.lit(False))) == ("classical", "dem_physical", "classical_fallback")
    assert one(spark, a=geometry.refinement_accepted(L(1), L(1), 10, 10, L(1), L(1 + 1e-7)), b=geometry.refinement_accepted(L(10), L(1), 10, 10, L(1), L(0)), c=geometry.refinement_accepted(L(1), L(None), 10, 10, L(1), L(0))) == (True, False, False)


def test_longitudes(spark):
    assert one(spark, a=projection.normalize_longitude(L(-10)), b=projection.normalize_longitude(L(720))) == (350.0, 0.0)
    for x, ref in [(350, 0), (-170, 180), (180, 0), (-180, 0), (725, -10), (-1000, 30)]:
        got = one(spark, a=projection.unwrap_longitude(L(x), L(ref)))[0]
        assert -180 <= got - ref <= 180 and math.isclose((got - x) % 360 % 360, 0, abs_tol=1e-9)
    assert one(spark, a=projection.unwrap_longitude(L(180), L(0)), b=projection.unwrap_longitude(L(-180), L(0))) == (180.0, -180.0)


@pytest.mark.parametrize("hemisphere", [1, -1])
def test_polar_round_trips(spark, hemisphere):
    m = projection.PolarStereographic(1737.4, 0.5, 1000, 1000, 2001, 2001, 30.0, hemisphere)
    for x, y in [(0, 0), (1500, 700), (1000.5, 999)]:
        assert one(spark, r=m.pixel_residual(L(x), L(y)))[0] < 1e-6
    assert one(spark, r=m.latlon_residual(L(85 * hemisphere), L(200)))[0] < 1e-9
    lat, lon = m.latlon(L(1000), L(1000))
    assert one(spark, a=lat, b=lon) == (90.0 * hemisphere, 30.0)
    x, _ = m.pixel(L(-10 * hemisphere), L(0))
    y, _ = m.pixel(L(0), L(0))
    z, _ = m.pixel(L(95 * hemisphere), L(0))
    assert one(spark, x=x, y=y, z=z) == (None, None, None)


def test_projection_from_label():
    label = {"MAP_PROJECTION_TYPE": "POLAR STEREOGRAPHIC", "CENTER_LATITUDE": "-90", "CENTER_LONGITUDE": 0, "A_AXIS_RADIUS": 1737.4, "MAP_SCALE": 0.5, "LINE_PROJECTION_OFFSET": 9, "SAMPLE_PROJECTION_OFFSET": 8, "LINES": 20, "LINE_SAMPLES": 30}
    m = projection.PolarStereographic.from_label(label)
    assert (m.hemisphere, m.lines, m.samples) == (-1, 20, 30)
    for change in ({"MAP_PROJECTION_TYPE": "MERCATOR"}, {"CENTER_LATITUDE": 45}, {"MAP_SCALE": "x"}):
        with pytest.raises(ValueError):
            projection.PolarStereographic.from_label(label | change)


def test_cartesian(spark):
    x, y, z = projection.to_cartesian(L(30), L(200), L(1000))
    p = one(spark, x=x, y=y, z=z)
    back = one(spark, **dict(zip("abc", projection.from_cartesian(*map(L, p)))))
    assert back == pytest.approx((30, 200, 1000), abs=1e-6)
    x, _, _ = projection.to_cartesian(L(0), L(0), L(-2_000_000))
    t = projection.terrain_point(L(1), L(2), L(None))
    got = one(spark, x=x, t=t)
    assert got[0] is None and not got[1]["valid"] and got[1]["reason"] == "elevation_unavailable"
    assert one(spark, **dict(zip("abc", projection.from_cartesian(L(0), L(0), L(0))))) == (None, None, None)


def test_camera(spark):
    m = camera.quaternion_matrix(L(0.2), L(-0.4), L(0.8), L(1.2))
    got = one(spark, m=m, ok=camera.is_rotation(m), zero=camera.quaternion_matrix(L(0), L(0), L(0), L(0)), bad=camera.is_rotation(F.array(*[L(1)] * 9)))
    r = np.array(got[0]).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3)) and got[1] and got[2] is None and not got[3]
    cam = camera.Camera(1000, 1000, 500, 500, (0.1, 0.01, 0.001, -0.001))
    eye = F.array(*(L(i == j) for i in range(3) for j in range(3)))
    zero = (L(0), L(0), L(0))
    p = camera.project_point((L(1), L(2), L(10)), zero, eye, cam)
    hit = one(spark, p=p, behind=camera.project_point((L(0), L(0), L(-1)), zero, eye, cam))
    assert hit[0]["valid"] and not hit[1]["valid"] and hit[1]["reason"] == "point_behind_camera" and hit[1]["x"] is None
    ray = camera.pixel_ray(L(hit[0]["x"]), L(hit[0]["y"]), eye, cam)
    d = one(spark, **dict(zip("abc", ray)))
    assert np.allclose(np.array(d) * 10 / d[2], (1, 2, 10), atol=1e-6) and np.isclose(np.linalg.norm(d), 1)
    assert one(spark, a=camera.ray_sphere((L(5), L(0), L(0)), (L(-1), L(0), L(0)), 2.0), b=camera.ray_sphere((L(5), L(0), L(0)), (L(1), L(0), L(0)), 2.0), c=camera.ray_sphere((L(0), L(0), L(0)), (L(1), L(0), L(0)), 2.0)) == (3.0, None, 2.0)
    assert camera.focal_pixels(10, 0.01) == pytest.approx(1000)
    with pytest.raises(ValueError):
        camera.focal_pixels(10, 0)
    assert camera.Camera(0, 1, 0, 0).missing() == ["focal_length"]


def test_text(spark):
    S = F.lit
    assert one(spark, a=text.label_key(S("  A_B = 1.5 <km>")), b=text.label_value(S("  A_B = 1.5 <km>")), c=text.label_number(S("A = 1.5 <km>")), d=text.label_value(S('N="x y"')), e=text.label_key(S("/* c */")), f=text.label_number(S("N = abc"))) == ("A_B", "1.5", 1.5, "x y", None, None)
    assert one(spark, a=text.sample_type(S("MSB_INTEGER"), S(16)), b=text.sample_type(S("SignedLSB"), S(32)), c=text.sample_type(S("x"), S(8)), d=text.sample_bits(S("UnsignedLSB2")), e=text.sample_bits(S("Byte"))) == (">u2", "<i4", "u1", 16, 8)
    assert one(spark, a=text.coerced_number(S("")), b=text.coerced_number(S("x")), c=text.coerced_number(S("2.5")), d=text.coerced_boolean(S("True")), e=text.coerced_boolean(S("")), f=text.unparsed(S("x"))) == (None, None, 2.5, True, None, "x")
    assert one(spark, a=text.stem(S("/d/a_b.c.png")), b=text.safe_suffix(S("x.PNG"), S("")), c=text.safe_suffix(S("x.exe"), S("image/jpeg")), d=text.safe_suffix(S("x"), S("a/b"))) == ("a_b.c", ".png", ".jpg", ".bin")
    assert one(spark, a=text.geometry_path(S("/m/data/c/data/x_d_img_1.png")), b=text.geometry_path(S("/x/y.png")), c=text.label_path(S("/a/b.img"))) == ("/m/data/c/geometry/x_g_grd_1.csv", None, "/a/b.xml")
    assert one(spark, e=text.coerced_boolean(S("yes")), f=text.unparsed_boolean(S("yes")), g=text.unparsed_boolean(S("TRUE"))) == (None, "yes", None)
    label = S("Spacecraft body\nposition, optical axis, DISTORTION, payload to camera alignment, reference frame")
    assert one(spark, a=text.missing_metadata(label), b=text.missing_metadata(label, orbit=F.lit(True)), c=text.missing_metadata(S(None).cast("string"))) == (["spacecraft_position"], [], list(text.NO_LABEL))
    assert one(spark, a=text.percent_text(L(0.5)), b=text.percent_text(L(None)), c=text.file_size_text(S(2560)), d=text.stage_label(S("image_ransac")), e=text.stage_label(S("a_b")), f=text.is_run_id(S("0" * 32)), g=text.is_run_id(S("G" * 32)), h=text.is_unavailable(S("None"))) == ("50.00%", "—", "3 KB", "RANSAC", "a b", True, False, True)
    assert one(spark, a=text.cell_text(L(0.125)), b=text.cell_text(L(-0.125)), c=text.cell_text(L(1.005)), d=text.cell_text(L(None)), e=text.unit_text(L(1234.5), "px"), f=text.file_size_text(S(0)), g=text.file_size_text(S(1_310_720)), h=text.status_text(S("success"))) == ("0.13", "-0.13", "1.00", "Not available", "1234.50 px", "—", "1.3 MB", "Successful")
    assert one(spark, a=text.row_matches([S("Abc"), S(12)], "BC"), b=text.row_matches([S("Abc"), S(12)], "12"), c=text.row_matches([S("a"), S(None).cast("string")], "z"), d=text.row_matches([S("a")], "  ")) == (True, True, False, True)
    with pytest.raises(Exception, match="required field X"):
        one(spark, a=text.required(S(None).cast("string"), "X"))
