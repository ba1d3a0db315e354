"""Points, planes and transforms as column expressions; points are structs of x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def squared_distance(a: Column, b: Column) -> Column:
    return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def lifted(p: Column) -> Column:
    """x^2 + y^2 + z^2."""
    return p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]


def minus(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) / 2


def plane(a: Column, b: Column, c: Column) -> Column:
    """struct(n, d): n . p = d on the plane."""
    n = cross(minus(b, a), minus(c, a))
    return F.struct(n.alias("n"), dot(n, a).alias("d"))


def plane_distance(p: Column, pl: Column) -> Column:
    """Signed distance; null for a degenerate plane."""
    return (dot(pl["n"], p) - pl["d"]) / F.nullif(norm(pl["n"]), F.lit(0.0))


def det2(a, b, c, d) -> Column:
    return a * d - b * c


def det3(r1: Column, r2: Column, r3: Column) -> Column:
    """Determinant of three rows."""
    return dot(r1, cross(r2, r3))


def orientation(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Six times the signed volume of a tetrahedron."""
    return det3(minus(b, a), minus(c, a), minus(d, a))


def circumsphere(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(centre, radius) of four points; null if they are in a plane."""
    u, v, w = minus(b, a), minus(c, a), minus(d, a)
    det = 2 * det3(u, v, w)
    uu, vv, ww = dot(u, u), dot(v, v), dot(w, w)
    vw, wu, uv = cross(v, w), cross(w, u), cross(u, v)
    part = lambda k: (uu * vw[k] + vv * wu[k] + ww * uv[k]) / det
    o = point(part("x"), part("y"), part("z"))
    return F.when(F.abs(det) > TOLERANCE, F.struct(point(a["x"] + o["x"], a["y"] + o["y"], a["z"] + o["z"]).alias("centre"), norm(o).alias("radius")))


def circumcircle(a: Column, b: Column, c: Column) -> Column:
    """Radius of a triangle's circumcircle; null if it is degenerate."""
    area = triangle_area(a, b, c)
    return F.when(area > TOLERANCE, distance(a, b) * distance(b, c) * distance(c, a) / (4 * area))


def transformed(p: Column, t: Column, u: Column) -> Column:
    """t + U p for a translation (three numbers) and a rotation matrix (nine, row by row), as arrays."""
    row = lambda k: t[k] + u[3 * k] * p["x"] + u[3 * k + 1] * p["y"] + u[3 * k + 2] * p["z"]
    return point(row(0), row(1), row(2))


def euler(alpha: Column, beta: Column, gamma: Column) -> Column:
    """Rotation matrix Rz(gamma) Ry(beta) Rx(alpha), row by row."""
    ca, sa, cb, sb, cg, sg = F.cos(alpha), F.sin(alpha), F.cos(beta), F.sin(beta), F.cos(gamma), F.sin(gamma)
    return F.array(cg * cb, cg * sb * sa - sg * ca, cg * sb * ca + sg * sa, sg * cb, sg * sb * sa + cg * ca, sg * sb * ca - cg * sa, -sb, cb * sa, cb * ca)


def sphere_points(centre: Column, radius: Column, n: int) -> Column:
    """Array of n points spread over a sphere along a golden spiral."""
    i = lambda k: k + F.lit(0.5)
    z = lambda k: 1 - 2 * i(k) / n
    turn = 3.141592653589793 * (3 - 5**0.5)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: point(centre["x"] + radius * F.sqrt(1 - z(k) * z(k)) * F.cos(turn * k), centre["y"] + radius * F.sqrt(1 - z(k) * z(k)) * F.sin(turn * k), centre["z"] + radius * z(k)))


def line_sphere(origin: Column, direction: Column, centre: Column, radius: Column) -> Column:
    """struct(near, far): the line's parameters where it meets the sphere; null if it doesn't."""
    o = minus(origin, centre)
    a, b, c = dot(direction, direction), 2 * dot(o, direction), dot(o, o) - radius * radius
    q = b * b - 4 * a * c
    return F.when(q >= 0, F.struct(((-b - F.sqrt(q)) / (2 * a)).alias("near"), ((-b + F.sqrt(q)) / (2 * a)).alias("far")))


def offset(p: Column, direction: Column, length: Column) -> Column:
    """p moved along a direction."""
    k = length / norm(direction)
    return point(p["x"] + k * direction["x"], p["y"] + k * direction["y"], p["z"] + k * direction["z"])


def to_pixels(value: Column, unit: str, dpi: Column) -> Column:
    """Millimetres or inches as pixels; null without a resolution."""
    return value * dpi / (25.4 if unit == "mm" else 1.0)
