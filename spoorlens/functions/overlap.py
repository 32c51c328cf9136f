"""Do the confidence regions of two point clouds overlap?  Expressions on their moments.

A cloud's moments are a struct: n, mx, my, vx, vy, cxy (sample variances and covariance) and sr, s1
(sample standard deviations of the Euclidean and L1 distances of its points from the centre).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chi2_quantile(p: float | Column) -> Column:
    """Quantile of the chi-square distribution with two degrees of freedom, in closed form; infinite at 1."""
    p = p if isinstance(p, Column) else F.lit(float(p))
    return F.when(p >= 1, F.lit(float("inf"))).otherwise(-2 * F.log(1 - p))


def cloud_moments(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, moments) of each group of points; the distances from the centre need the centre first."""
    w = Window.partitionBy(*keys)
    d = points.withColumns({"_dx": F.col(x) - F.avg(x).over(w), "_dy": F.col(y) - F.avg(y).over(w)})
    return d.groupBy(*keys).agg(
        F.struct(
            F.count(x).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"),
            F.stddev_samp(F.hypot("_dx", "_dy")).alias("sr"), F.stddev_samp(F.abs("_dx") + F.abs("_dy")).alias("s1"),
        ).alias("moments")
    )


def _both(a: Column, b: Column, test: Column) -> Column:
    """False where a cloud has fewer than two points."""
    return F.coalesce((a["n"] >= 2) & (b["n"] >= 2) & test, F.lit(False))


def _axes(m: Column) -> tuple[Column, Column, Column, Column]:
    """Eigenvalues, smaller first, and the unit vector of the larger one, of a 2 x 2 covariance."""
    half, mean = (m["vx"] - m["vy"]) / 2, (m["vx"] + m["vy"]) / 2
    root = F.hypot(half, m["cxy"])
    turn = F.atan2(m["cxy"], half) / 2
    return F.greatest(mean - root, F.lit(0.0)), mean + root, F.cos(turn), F.sin(turn)


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot(a["mx"] - b["mx"], a["my"] - b["my"])


def ellipse_overlap(a: Column, b: Column, p: float | Column) -> Column:
    """On both axes of the first ellipse the centres are no further apart than the half axes together."""
    root = F.sqrt(chi2_quantile(p))
    a0, a1, cx, cy = _axes(a)
    b0, b1, _, _ = _axes(b)
    dx, dy = a["mx"] - b["mx"], a["my"] - b["my"]
    large = F.abs(dx * cx + dy * cy) <= root * (F.sqrt(a1) + F.sqrt(b1))
    small = F.abs(dy * cx - dx * cy) <= root * (F.sqrt(a0) + F.sqrt(b0))
    return _both(a, b, large & small)


def circle_overlap(a: Column, b: Column, p: float | Column) -> Column:
    """Radii are the root of the quantile times the deviation of the radial distances."""
    return _both(a, b, centre_distance(a, b) <= F.sqrt(chi2_quantile(p)) * (a["sr"] + b["sr"]))


def rhombus_overlap(a: Column, b: Column, p: float | Column) -> Column:
    """Half diagonals are the quantile itself times the deviation of the L1 distances."""
    return _both(a, b, centre_distance(a, b) <= chi2_quantile(p) * (a["s1"] + b["s1"]))


def pooled_overlap(a: Column, b: Column, p: float | Column) -> Column:
    """Circles of one pooled deviation."""
    pooled = F.sqrt((a["sr"] * a["sr"] + b["sr"] * b["sr"]) / 2)
    return _both(a, b, centre_distance(a, b) <= 2 * F.sqrt(chi2_quantile(p)) * pooled)


def region_shape(m: Column, p: float | Column) -> Column:
    """Geometry to draw: ellipse width, height and angle in degrees, circle radius, rhombus half diagonal; 0 for one point."""
    q = chi2_quantile(p)
    e0, e1, cx, cy = _axes(m)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(
        zero(2 * F.sqrt(q * e1)).alias("width"), zero(2 * F.sqrt(q * e0)).alias("height"), zero(F.degrees(F.atan2(cy, cx))).alias("angle"),
        zero(F.sqrt(q) * m["sr"]).alias("radius"), zero(q * m["s1"]).alias("half_diagonal"),
    )
