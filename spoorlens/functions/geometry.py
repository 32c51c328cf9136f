"""Plane geometry on landmarks (structs with x and y), affine chains and camera positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of manual landmarks (from 0) whose midpoints are the derived landmarks.
MIDPOINT_PAIRS = ((0, 1), (1, 2), (2, 3), (3, 4), (5, 6), (6, 7))
MANUAL_LANDMARKS = 11


def point(x, y) -> Column:
    return F.struct((x if isinstance(x, Column) else F.lit(float(x))).alias("x"), (y if isinstance(y, Column) else F.lit(float(y))).alias("y"))


def point_distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at ``b`` in degrees, 0 to 180; null if ``a`` or ``c`` lies on ``b``."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    n = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(n > 0, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ux * vx + uy * vy) / n)))))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])) / 2


def midpoint(p: Column, q: Column) -> Column:
    return point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)


def with_derived(landmarks: Column) -> Column:
    """The eleven manual landmarks followed by the six derived midpoints; an error for any other number."""
    derived = F.array(*[midpoint(landmarks[i], landmarks[j]) for i, j in MIDPOINT_PAIRS])
    plain = F.transform(landmarks, lambda p: point(p["x"], p["y"]))
    return F.when(F.size(landmarks) == MANUAL_LANDMARKS, F.concat(plain, derived)).otherwise(F.raise_error(F.lit(f"landmarks: {MANUAL_LANDMARKS} expected")))


def measured(kind: Column, points: Column) -> Column:
    """Distance, angle or triangle of a list of points; null for another kind or too few points."""
    p = [F.try_element_at(points, F.lit(i)) for i in (1, 2, 3)]
    return F.when(kind == "distance", point_distance(p[0], p[1])).when(kind == "angle", angle(*p)).when(kind == "triangle", triangle_area(*p))


def rotation_between(p: Column, q: Column) -> Column:
    """Direction from ``p`` to ``q`` in degrees."""
    return F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"]))


# affine maps are arrays of nine numbers, row by row
def apply_affine(matrix: Column, p: Column) -> Column:
    x = matrix[0] * p["x"] + matrix[1] * p["y"] + matrix[2]
    y = matrix[3] * p["x"] + matrix[4] * p["y"] + matrix[5]
    w = matrix[6] * p["x"] + matrix[7] * p["y"] + matrix[8]
    return point(x / w, y / w)


def apply_chain(matrices: Column, p: Column) -> Column:
    """Apply the maps of a list one after the other."""
    return F.aggregate(matrices, point(p["x"], p["y"]), lambda q, m: apply_affine(m, q))


def inverse_affine(m: Column) -> Column:
    """Inverse by cofactors; null where the determinant is zero."""
    c = lambda i, j, k, n: m[i] * m[j] - m[k] * m[n]
    cof = [c(4, 8, 5, 7), c(2, 7, 1, 8), c(1, 5, 2, 4), c(5, 6, 3, 8), c(0, 8, 2, 6), c(2, 3, 0, 5), c(3, 7, 4, 6), c(1, 6, 0, 7), c(0, 4, 1, 3)]
    det = m[0] * cof[0] + m[1] * cof[3] + m[2] * cof[6]
    return F.when(det != 0, F.array(*[x / det for x in cof]))


def invert_chain(matrices: Column) -> Column:
    """The list of inverses in reverse order, which undoes ``apply_chain``."""
    return F.transform(F.reverse(matrices), inverse_affine)


def rotation_matrix(degrees: float, cx: float = 0.0, cy: float = 0.0) -> list[float]:
    """Rotation around a centre as nine numbers."""
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    return [c, -s, cx - c * cx + s * cy, s, c, cy - s * cx - c * cy, 0.0, 0.0, 1.0]


def translation_matrix(dx: float, dy: float) -> list[float]:
    return [1.0, 0.0, dx, 0.0, 1.0, dy, 0.0, 0.0, 1.0]


def normalised(landmarks: Column, matrices: Column, width: Column, height: Column) -> Column:
    """Landmarks drawn on a turned image, moved back and divided by the image's size."""
    back = invert_chain(matrices)

    def one(p: Column) -> Column:
        q = apply_chain(back, p)
        return point(q["x"] / width, q["y"] / height)

    return F.transform(landmarks, one)


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds to signed degrees; south and west are negative."""
    v = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)


def measurement_columns(landmarks: Column, spec: dict[str, tuple[str, Sequence[int]]]) -> list[Column]:
    """One column for each entry name -> (kind, landmark numbers from 1); null where a landmark is missing."""
    return [measured(F.lit(kind), F.array(*[F.try_element_at(landmarks, F.lit(i)) if i > 0 else F.lit(None) for i in at])).alias(name) for name, (kind, at) in spec.items()]
