"""Expressions against NumPy and hand-made values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoorlens.functions import geometry as G
from spoorlens.functions.distances import METRICS, all_distances, distance
from spoorlens.functions.labels import base_trail, flag_true, label_form
from spoorlens.functions.numbers import decimal_comma, measurement
from spoorlens.functions.overlap import chi2_quantile, circle_overlap, cloud_moments, ellipse_overlap, pooled_overlap, region_shape, rhombus_overlap
from spoorlens.functions.texts import parsed_list, short_label, standard_sex, stem_parts, subsample_size, trailing_number, truth_flag


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize("text, want", [(None, "unknown"), ("", ""), ("  A b\t", "a_b"), ("Größe (cm)", "größe_cm_"), (" x ", "x"), ("a--b", "a_b")])
def test_label_form(spark, text, want):
    assert one(spark, label_form(F.lit(text).cast("string"))) == (want,)


@pytest.mark.parametrize("text, want", [("Eo - kb_t01\t", "eo_kb_t01"), ("eo_kb_t01_sub2_sample1", "eo_kb_t01"), ("Unknown", None), (" ", None), (None, None)])
def test_base_trail(spark, text, want):
    assert one(spark, base_trail(F.lit(text).cast("string"))) == (want,)


def test_small_expressions(spark):
    assert one(spark, flag_true(F.lit(" TRUE ")), flag_true(F.lit("yes")), flag_true(F.lit(None))) == (True, False, False)
    assert one(spark, decimal_comma(F.lit("1,5")), decimal_comma(F.lit("x"))) == (1.5, None)
    assert one(spark, *[measurement(F.lit(v)) for v in (3.0, -999.0, float("nan"), float("inf"), 0.0)]) == (3.0, None, None, None, None)
    assert one(spark, subsample_size(F.lit("a_sub5_sample1")), subsample_size(F.lit("a")), trailing_number(F.lit("trail12"))) == (5, None, "12")
    assert one(spark, parsed_list(F.lit("[1.0, 2]")), parsed_list(F.lit("bad"))) == ([1.0, 2.0], [])
    assert one(spark, short_label(F.lit("fit_genetik_probe_12_x"), []), short_label(F.lit("a_b_c_d"), ["d"])) == ("GEN12", "b_c")
    assert tuple(one(spark, stem_parts(F.lit("red_fox_train")))[0]) == ("red_fox", "train")
    assert one(spark, *[standard_sex(F.lit(x)) for x in ("F", "1", "x")]) == ("Female", "Male", "Unknown")
    assert one(spark, *[truth_flag(F.lit(x)) for x in ("Same", "no", None)]) == (1, 0, None)


def numpy_distances(a, b):
    d = np.abs(a - b)
    s = np.abs(a) + np.abs(b)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    w = np.abs(a + b).sum()
    return [math.sqrt((d**2).sum()), d.sum(), 1 - a @ b / n if n else math.nan, d.max(), np.where(s > 0, d / np.where(s > 0, s, 1), 0).sum(), d.sum() / w if w else math.nan]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=6))
def test_distances(spark, pairs):
    a, b = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    got = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(*all_distances("a", "b")).first()
    np.testing.assert_allclose([float(x) for x in got], numpy_distances(a, b), atol=1e-9)


def test_distance_cases(spark):
    df = spark.createDataFrame([(None, [1.0])], "a array<double>, b array<double>")
    assert df.select(*[distance(m, "a", "b") for m in METRICS]).first()[0] is None
    with pytest.raises(ValueError):
        distance("hamming", "a", "b")


def test_geometry(spark):
    p = G.point
    assert one(spark, G.point_distance(p(0, 0), p(3, 4)), G.angle(p(1, 0), p(0, 0), p(0, 2)), G.triangle_area(p(0, 0), p(4, 0), p(0, 3))) == (5.0, 90.0, 6.0)
    assert one(spark, G.angle(p(0, 0), p(0, 0), p(1, 1)), G.rotation_between(p(0, 0), p(0, 2)), G.decimal_degrees(F.lit(10), F.lit(30), F.lit(36.0), F.lit("s"))) == (None, 90.0, -10.51)
    marks = F.array(*[p(k, 2 * k) for k in range(11)])
    d = one(spark, G.with_derived(marks))[0]
    assert len(d) == 17 and [tuple(d[k]) for k in (11, 15)] == [(0.5, 1.0), (5.5, 11.0)]
    with pytest.raises(Exception, match="11 expected"):
        one(spark, G.with_derived(F.array(p(0, 0))))
    spec = {"w": ("distance", (1, 2)), "a": ("angle", (1, 2, 3)), "far": ("distance", (1, 99)), "odd": ("circle", (1, 2))}
    w, a, far, odd = one(spark, *G.measurement_columns(marks, spec))
    assert abs(w - math.sqrt(5)) < 1e-12 and abs(a - 180) < 1e-4 and far is None and odd is None


def test_affine_chains(spark):
    m = lambda x: F.array(*[F.lit(float(v)) for v in x])
    chain = F.array(m(G.translation_matrix(2, -1)), m(G.rotation_matrix(90, 1, 1)))
    x, y = one(spark, G.apply_chain(chain, G.point(1, 3)))[0]
    assert abs(x) < 1e-12 and abs(y - 3) < 1e-12
    x, y = one(spark, G.apply_chain(G.invert_chain(chain), G.apply_chain(chain, G.point(7, -2))))[0]
    assert abs(x - 7) < 1e-9 and abs(y + 2) < 1e-9
    assert one(spark, G.inverse_affine(m([0] * 9))) == (None,)
    n = one(spark, G.normalised(F.array(G.point(3, 4)), F.array(m(G.translation_matrix(1, 2))), F.lit(10.0), F.lit(4.0)))[0]
    assert tuple(n[0]) == (0.2, 0.5)


def test_chi2(spark):
    assert abs(one(spark, chi2_quantile(0.95))[0] - 5.991464547107979) < 1e-12
    assert one(spark, chi2_quantile(1.0)) == (math.inf,)


def reference_ellipse(a, b, p):
    chi = -2 * math.log(1 - p)
    (wa, va), (wb, _) = np.linalg.eigh(np.cov(a.T)), np.linalg.eigh(np.cov(b.T))
    gap = a.mean(axis=0) - b.mean(axis=0)
    return all(abs(gap @ va[:, i]) <= math.sqrt(max(wa[i], 0) * chi) + math.sqrt(max(wb[i], 0) * chi) for i in (0, 1))


def test_overlap_tests(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(40):
        clouds = [rng.normal(rng.uniform(0, 4, 2), rng.uniform(0.2, 2, 2), (int(rng.integers(3, 9)), 2)) for _ in range(2)]
        rows += [(k, s, float(x), float(y)) for s, c in zip("ab", clouds) for x, y in c]
        want[k] = reference_ellipse(*clouds, 0.8)
    rows += [(99, "a", 0.0, 0.0), (99, "b", 0.0, 0.0), (99, "b", 1.0, 1.0)]
    want[99] = False  # one point makes no region
    m = cloud_moments(spark.createDataFrame(rows, "k int, s string, x double, y double"), ["k", "s"])
    p = m.filter("s = 'a'").select("k", F.col("moments").alias("a")).join(m.filter("s = 'b'").select("k", F.col("moments").alias("b")), "k")
    out = p.select("k", ellipse_overlap(F.col("a"), F.col("b"), 0.8).alias("e"), *[f(F.col("a"), F.col("b"), 1.0).alias(n) for n, f in (("c", circle_overlap), ("r", rhombus_overlap), ("p", pooled_overlap))], region_shape(F.col("a"), 0.5).alias("g")).collect()
    assert {r["k"]: r["e"] for r in out} == want
    assert all(r["c"] and r["r"] and r["p"] for r in out if r["k"] != 99)
    assert [r["g"]["width"] for r in out if r["k"] == 99] == [0.0]
