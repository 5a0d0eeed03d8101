"""Scalar expressions: time, grids, strings and densities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def finite(*cols: Column) -> Column:
    """Neither null, NaN nor infinite, for each of them."""
    out = F.lit(True)
    for c in cols:
        out &= F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def week_seconds_to_time(t: Column, day_shift: float = 0, leap: float | None = 0) -> Column:
    """Seconds of a week to seconds on the trajectory's scale."""
    return t + float(day_shift) * DAY + float(leap or 0)


def overlap(lo1, hi1, lo2, hi2) -> Column:
    """Length shared by two intervals, 0 if none."""
    return F.greatest(F.lit(0), F.least(hi1, hi2) - F.greatest(lo1, lo2))


def cell(x: Column, origin, size) -> Column:
    return F.floor((x - origin) / size).cast("long")


def range_corrected(intensity: Column, distance: Column, nearest: float = 3.0, power: float = 0.5) -> Column:
    return intensity * F.pow(F.greatest(distance, F.lit(nearest)), power)


def cylinder_density(n: Column, radius: float) -> Column:
    return F.round(n / (math.pi * radius * radius), 1)


def any_window(t: Column, windows: list[tuple[float, float]], margin: float = 0) -> Column:
    """t lies in one of [start - margin, start + duration + margin]."""
    out = F.lit(False)
    for start, duration in windows:
        out |= t.between(start - margin, start + duration + margin)
    return out


def outside(t: Column, zones: list[tuple[float, float]]) -> Column:
    """t lies in none of the closed zones."""
    out = F.lit(True)
    for lo, hi in zones:
        out &= ~t.between(lo, hi)
    return out


def range_bin(x: Column, edges: tuple[float, ...] = (0, 10, 20, 30)) -> Column:
    """The label of the half-open bin that holds x, null beyond the edges."""
    out = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        label = f"[{lo:g},{hi:g})"
        out = F.when((x >= lo) & (x < hi), label) if out is None else out.when((x >= lo) & (x < hi), label)
    return out


def raw_scan_id(name: Column) -> Column:
    """The second number of a raw file's name, e.g. 101010_002000_x.las."""
    return F.regexp_extract(name, r"^(\d{6})_(\d{6})", 2).try_cast("long")


def merged_scan_id(name: Column) -> Column:
    """The number after merged_, else the first number in the name."""
    merged = F.regexp_extract(name, r"merged_(\d+)", 1).try_cast("long")
    return F.coalesce(merged, F.regexp_extract(name, r"(\d+)", 1).try_cast("long"))


def pair_ids(name: Column) -> tuple[Column, Column]:
    """Both numbers of a patch file's name, Patch_from_scan_<a>_with_<b>.las."""
    pattern = r"Patch_from_scan_(\d+)_with_(\d+)\.las"
    return F.regexp_extract(name, pattern, 1).try_cast("long"), F.regexp_extract(name, pattern, 2).try_cast("long")


def pair_key(a: Column, b: Column) -> Column:
    """An unordered pair of ids, in string order."""
    return F.concat_ws("_", F.least(a.cast("string"), b.cast("string")), F.greatest(a.cast("string"), b.cast("string")))


def uncertainty(cfg: dict, low=None, high=None, scalar=None) -> dict:
    """A matcher's settings with the search radius replaced: a range if both ends are given, else a scalar, else as
    they are."""
    out = dict(cfg)
    if low is not None and high is not None:
        out.pop("uncertainty_r", None)
        return out | {"uncertainty_r_min": float(low), "uncertainty_r_max": float(high)}
    if scalar is not None:
        out.pop("uncertainty_r_min", None)
        out.pop("uncertainty_r_max", None)
        return out | {"uncertainty_r": float(scalar)}
    return out
