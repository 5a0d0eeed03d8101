"""Rotations as Column expressions.

Vectors, quaternions (w, x, y, z) and matrices are plain lists of Columns, so everything stays inside one
generated stage.  Numbers are accepted wherever Columns are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = Sequence
Matrix = Sequence[Sequence]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _sum(terms: list) -> Column:
    """Sum of products, leaving out factors that are plainly 0 or 1."""
    out = None
    for a, b in terms:
        if (not isinstance(a, Column) and a == 0) or (not isinstance(b, Column) and b == 0):
            continue
        t = b if not isinstance(a, Column) and a == 1 else a if not isinstance(b, Column) and b == 1 else a * b
        out = t if out is None else out + t
    return 0.0 if out is None else out


def mat_mul(a: Matrix, b: Matrix) -> Matrix:
    return [[_sum([(a[i][k], b[k][j]) for k in range(len(b))]) for j in range(len(b[0]))] for i in range(len(a))]


def mat_vec(a: Matrix, v: Vector) -> Vector:
    return [_sum([(row[k], v[k]) for k in range(len(v))]) for row in a]


def transpose(a: Matrix) -> Matrix:
    return [list(x) for x in zip(*a, strict=True)]


def add(a: Vector, b: Vector) -> Vector:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def norm(v: Vector) -> Column:
    return F.sqrt(col(sum(x * x for x in v)))


def _trig(a):
    return (F.cos(a), F.sin(a)) if isinstance(a, Column) else (math.cos(a), math.sin(a))


def about_x(a) -> Matrix:
    """Passive rotation about the x axis."""
    c, s = _trig(a)
    return [[1, 0, 0], [0, c, s], [0, -s, c]]


def about_y(a) -> Matrix:
    c, s = _trig(a)
    return [[c, 0, -s], [0, 1, 0], [s, 0, c]]


def about_z(a) -> Matrix:
    c, s = _trig(a)
    return [[c, s, 0], [-s, c, 0], [0, 0, 1]]


def ned_to_ecef(lat, lon, degrees: bool = False) -> Matrix:
    """Local north-east-down axes in the earth-fixed frame."""
    if degrees:
        lat, lon = (F.radians(x) if isinstance(x, Column) else math.radians(x) for x in (lat, lon))
    (ca, sa), (co, so) = _trig(lat), _trig(lon)
    return [[-sa * co, -so, -ca * co], [-sa * so, co, -ca * so], [ca, 0, -sa]]


def enu_ned() -> Matrix:
    """East-north-up to north-east-down, and back."""
    return [[0, 1, 0], [1, 0, 0], [0, 0, -1]]


def body_to_ned(roll, pitch, yaw) -> Matrix:
    """(about_x(roll) about_y(pitch) about_z(yaw)) transposed."""
    return transpose(mat_mul(mat_mul(about_x(roll), about_y(pitch)), about_z(yaw)))


def sensor_to_body(roll: float, pitch: float, yaw: float, mount: Matrix) -> Matrix:
    """Boresight angles (radians) applied to the mount matrix; constants fold on the driver."""
    return mat_mul(body_to_ned(roll, pitch, yaw), mount)


def matrix_to_quaternion(r: Matrix) -> Vector:
    """The robust form: the largest of trace and diagonal decides."""
    r = [[col(x) for x in row] for row in r]
    trace = r[0][0] + r[1][1] + r[2][2]
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    s = [2 * root(1 + trace)] + [2 * root(1 + r[i][i] - r[j][j] - r[k][k]) for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1))]
    d = [(r[2][1] - r[1][2]), (r[0][2] - r[2][0]), (r[1][0] - r[0][1])]
    m = [(r[0][1] + r[1][0]), (r[0][2] + r[2][0]), (r[1][2] + r[2][1])]
    by = lambda x, k: F.try_divide(x, s[k])
    cases = [
        [s[0] / 4, by(d[0], 0), by(d[1], 0), by(d[2], 0)],
        [by(d[0], 1), s[1] / 4, by(m[0], 1), by(m[1], 1)],
        [by(d[1], 2), by(m[0], 2), s[2] / 4, by(m[2], 2)],
        [by(d[2], 3), by(m[1], 3), by(m[2], 3), s[3] / 4],
    ]
    first = trace > 0
    second = (r[0][0] > r[1][1]) & (r[0][0] > r[2][2])
    third = r[1][1] > r[2][2]
    return [F.when(first, cases[0][i]).when(second, cases[1][i]).when(third, cases[2][i]).otherwise(cases[3][i]) for i in range(4)]


def matrix_to_quaternion_by_trace(r: Matrix) -> Vector:
    """The plain form, null where the trace is -1."""
    r = [[col(x) for x in row] for row in r]
    w = F.sqrt(F.greatest(1 + r[0][0] + r[1][1] + r[2][2], F.lit(0.0))) / 2
    return [w] + [F.try_divide(x, 4 * w) for x in (r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1])]


def quaternion_to_matrix(q: Vector) -> Matrix:
    """Without normalising."""
    w, x, y, z = q
    return [
        [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
    ]


def euler_to_quaternion(roll, pitch, yaw) -> Vector:
    """Of body_to_ned, by half angles: the sign is that of a positive w for small angles."""
    (cr, sr), (cp, sp), (cy, sy) = (_trig(a / 2) for a in (roll, pitch, yaw))
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def quaternion_to_euler(q: Vector) -> Vector:
    w, x, y, z = normalized(q)
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    return [F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))]


def inverse(q: Vector) -> Vector:
    return [q[0], -q[1], -q[2], -q[3]]


def multiply(p: Vector, q: Vector) -> Vector:
    a, b, c, d = p
    w, x, y, z = q
    return [a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w]


def normalized(q: Vector) -> Vector:
    """Unit length; null for a zero quaternion."""
    n = norm(q)
    return [F.try_divide(col(x), n) for x in q]


def slerp(p: Vector, q: Vector, u) -> Vector:
    """Spherical interpolation along the shorter arc; linear where the arc vanishes."""
    dot = sum(a * b for a, b in zip(p, q, strict=True))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    cos = F.least(F.abs(dot), F.lit(1.0))
    arc = F.acos(cos)
    small = cos > 1 - 1e-12
    sin = F.sin(arc)
    a = F.when(small, 1 - u).otherwise(F.try_divide(F.sin((1 - u) * arc), sin))
    b = sign * F.when(small, u).otherwise(F.try_divide(F.sin(u * arc), sin))
    return normalized([a * x + b * y for x, y in zip(p, q, strict=True)])


def with_slerp(df: DataFrame, p: Sequence[str], q: Sequence[str], u: Column, out: Sequence[str]) -> DataFrame:
    """slerp() of named columns by steps, which keeps the plan small."""
    a, b = [F.col(c) for c in p], [F.col(c) for c in q]
    rows = df.withColumns({"_u": u, "_dot": sum(x * y for x, y in zip(a, b, strict=True))})
    rows = rows.withColumn("_arc", F.acos(F.least(F.abs("_dot"), F.lit(1.0)))).withColumn("_sin", F.sin("_arc"))
    small = F.least(F.abs("_dot"), F.lit(1.0)) > 1 - 1e-12
    fa = F.when(small, 1 - F.col("_u")).otherwise(F.try_divide(F.sin((1 - F.col("_u")) * F.col("_arc")), F.col("_sin")))
    fb = F.when(F.col("_dot") < 0, -1.0).otherwise(1.0) * F.when(small, F.col("_u")).otherwise(F.try_divide(F.sin(F.col("_u") * F.col("_arc")), F.col("_sin")))
    rows = rows.withColumns({"_fa": fa, "_fb": fb})
    rows = rows.withColumns({c: F.col("_fa") * x + F.col("_fb") * y for c, x, y in zip(out, a, b, strict=True)})
    rows = rows.withColumn("_norm", norm([F.col(c) for c in out]))
    return rows.withColumns({c: F.try_divide(F.col(c), F.col("_norm")) for c in out}).drop("_u", "_dot", "_arc", "_sin", "_fa", "_fb", "_norm")


def rotation_vector(r: Matrix) -> Vector:
    """Logarithm of a rotation matrix, for angles below pi."""
    r = [[col(x) for x in row] for row in r]
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0][0] + r[1][1] + r[2][2] - 1) / 2))
    angle = F.acos(cos)
    factor = F.when(angle < 1e-6, F.lit(0.5)).otherwise(F.try_divide(angle, 2 * F.sin(angle)))
    return [factor * x for x in (r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1])]


def small_angle_error(p: Vector, q: Vector) -> Vector:
    """Small rotation between two attitudes, degrees about x, y and z."""
    r = quaternion_to_matrix(multiply(inverse(p), q))
    return [F.degrees(r[1][2]), F.degrees(r[2][0]), F.degrees(r[0][1])]
