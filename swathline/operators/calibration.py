"""Mounting and time alignment of sensors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rotations as rot
from .trajectory import interpolate


def mean_rotation(rotations: DataFrame, matrix: list[list[str]], rounds: int = 50, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The mean rotation (its tangents sum to zero) and the deviation of the tangents per axis.

    Each round is one aggregate of three averages over the rows; only the estimate lives on the driver."""
    mean = np.eye(3)
    std = np.zeros(3)
    rows = [[F.col(c) for c in row] for row in matrix]
    for _ in range(rounds):
        back = [[float(x) for x in r] for r in mean.T]
        v = rot.rotation_vector(rot.mat_mul(back, rows))
        got = rotations.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(v)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(v))).first()
        step = np.array([got[f"m{i}"] or 0.0 for i in range(3)])
        std = np.array([got[f"s{i}"] or 0.0 for i in range(3)])
        mean = mean @ exponential(step)
        if np.linalg.norm(step) < tolerance:
            break
    return mean, std


def exponential(v: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    a = float(np.linalg.norm(v))
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if a < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / (a * a) * k @ k


def orthogonality(rotations: DataFrame, matrix: list[list[str]]) -> DataFrame:
    """The greatest deviation of M Mt from the identity."""
    m = [[F.col(c) for c in row] for row in matrix]
    p = rot.mat_mul(m, rot.transpose(m))
    worst = [F.max(F.abs(p[i][j] - float(i == j))) for i in range(3) for j in range(3)]
    return rotations.agg(F.greatest(*worst).alias("deviation"))


def align_attitudes(first: DataFrame, second: DataFrame, width: float, block: float, compat: bool = False) -> DataFrame:
    """The second sensor's roll, pitch and yaw at the first's times; times outside its range are left out.  Angles are
    interpolated by sine and cosine, or as plain numbers with `compat`."""
    names = ["roll", "pitch", "yaw"]
    if compat:
        return interpolate(first, second, names, width, block, clamp=False)
    parts = second.select("t", *(f(c).alias(f"{n}{c}") for c in names for n, f in (("c", F.cos), ("s", F.sin))))
    rows = interpolate(first, parts, [c for c in parts.columns if c != "t"], width, block, clamp=False)
    return rows.select(*first.columns, *(F.atan2(f"trj_s{c}", f"trj_c{c}").alias(f"trj_{c}") for c in names))


def lag(a: np.ndarray, b: np.ndarray, step: float) -> float:
    """The delay, in units of step, at which two evenly sampled series correlate most in magnitude."""
    a, b = ((x - x.mean()) / (x.std() or 1.0) for x in (np.asarray(a, float), np.asarray(b, float)))
    n = 1 << (len(a) + len(b) - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)
    c = np.concatenate([c[-(len(b) - 1) :] if len(b) > 1 else c[:0], c[: len(a)]])
    return float((int(np.abs(c).argmax()) - (len(b) - 1)) * step)


def lever_arm(passes: list[tuple[tuple[float, float, float], np.ndarray]], old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New lever arm and half the difference of two passes; a pass is its attitude (roll, pitch, yaw) to local
    north-east-down and the offset seen in east, north, up."""
    found = []
    for (r, p, y), offset in passes:
        m = np.array([[float(x) for x in row] for row in rot.mat_mul(rot.enu_ned(), rot.body_to_ned(r, p, y))])
        found.append(m.T @ np.asarray(offset, float))
    mean = np.mean(found, axis=0)
    half = (found[0] - found[-1]) / 2
    return np.asarray(old, float) + mean, half


def mean_attitude(trajectory: DataFrame, lo: float, hi: float) -> DataFrame:
    """Circular means of roll, pitch and heading between two times."""
    rows = trajectory.where(F.col("t").between(lo, hi))
    return rows.agg(*(F.atan2(F.avg(F.sin(c)), F.avg(F.cos(c))).alias(c) for c in ("roll", "pitch", "heading")), F.count(F.lit(1)).alias("n"))
