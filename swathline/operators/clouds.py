"""Point clouds: time scales, filters, georeferencing, merging and scan manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy, scalars
from ..functions import rotations as rot
from .ordered import first_of_each
from .partners import longest, partners
from .range_join import range_join
from .trajectory import interpolate


class EmptyResult(ValueError):
    """A step that must keep something kept nothing."""


def required(df: DataFrame, what: str) -> DataFrame:
    """The frame itself; raises if it has no row."""
    if df.isEmpty():
        raise EmptyResult(what)
    return df


def day_shift(points: DataFrame, trajectory: DataFrame, t: str = "t", keys: list[str] = ("file",), day: float = scalars.DAY, leap: float = 0) -> DataFrame:
    """Shift each file's times by whole days onto the trajectory's, by the medians of the finite times, then add
    the leap seconds.  Halves round to even."""
    middle = trajectory.where(scalars.finite(F.col(t).cast("double"))).agg(F.median(t).alias("_trj"))
    own = points.where(scalars.finite(F.col(t).cast("double"))).groupBy(*keys).agg(F.median(t).alias("_own"))
    shift = own.crossJoin(F.broadcast(middle)).select(*keys, F.rint((F.col("_trj") - F.col("_own")) / day).alias("day_shift"))
    return points.join(shift, list(keys)).withColumn(t, F.col(t) + F.col("day_shift") * day + leap)


def within_manifest(manifest: DataFrame, windows: list[tuple[float, float]], margin: float = 0, lo: str = "t_min", hi: str = "t_max") -> DataFrame:
    """Files whose time range meets any of the windows (start, duration)."""
    keep = F.lit(False)
    for start, duration in windows:
        keep |= (F.col(hi) >= start - margin) & (F.col(lo) <= start + duration + margin)
    return manifest.where(keep)


def near_trajectory(points: DataFrame, trajectory: DataFrame, distance: float, width: float, block: float, xy: tuple[str, str] = ("x", "y"), t: str = "t", keys: list[str] = ()) -> DataFrame:
    """Points within a horizontal distance of the vehicle at their time; adds the distance."""
    rows = interpolate(points, trajectory, list(xy), width, block, t, keys)
    d = F.sqrt(F.pow(F.col(xy[0]) - F.col(f"trj_{xy[0]}"), 2) + F.pow(F.col(xy[1]) - F.col(f"trj_{xy[1]}"), 2))
    return rows.withColumn("distance", d).where(F.col("distance") <= distance).select(*points.columns, "distance")


def georeference(vectors: DataFrame, trajectory: DataFrame, sensor_to_body, lever_arm, width: float, block: float, frame: str = "swiss", origin=None, height: str = "local", body_vector: bool = False) -> DataFrame:
    """Laser vectors (t, sx, sy, sz, intensity_raw) to map points (x, y, z).

    frame: `swiss`, `ecef`, or `enu` about origin (lat, lon, alt in radians and metres)."""
    rows = interpolate(vectors, trajectory, ["ex", "ey", "ez"], width, block, attitude=True)
    v = [F.col("sx"), F.col("sy"), F.col("sz")]
    turned = rot.mat_vec(sensor_to_body, v)
    body = rot.add(turned, list(map(float, lever_arm)))
    q = [F.col(f"trj_{c}") for c in ("qw", "qx", "qy", "qz")]
    ecef = rot.add(rot.mat_vec(rot.quaternion_to_matrix(q), body), [F.col(f"trj_{c}") for c in ("ex", "ey", "ez")])
    out = dict(zip(("x", "y", "z"), ecef, strict=True)) | {"intensity": scalars.range_corrected(F.col("intensity_raw"), rot.norm(v))}
    extra = dict(zip(("lvx", "lvy", "lvz"), turned, strict=True)) if body_vector else {}
    rows = rows.select(*vectors.columns, *(rot.col(c).alias(n) for n, c in (out | extra).items()))
    if frame == "enu":
        lat, lon, alt = map(float, origin)
        at = geodesy.geodetic_to_ecef(F.lit(lat), F.lit(lon), F.lit(alt))
        xyz = geodesy.ecef_to_enu([F.col(c) for c in "xyz"], at, lat, lon)
        return rows.withColumns(dict(zip(("x", "y", "z"), xyz, strict=True)))
    return geodesy.with_swiss(rows, ("x", "y", "z"), ("x", "y", "z"), height) if frame == "swiss" else rows


def normalize_intensity(points: DataFrame, value: str = "intensity", keys: list[str] = ("file",), index: str | None = None, block_rows: int = 10_000_000, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Stretch the low and high percentiles of each file, or of each block of its rows, to 0 and 65535, clipped and
    cut to whole numbers; 0 where they are equal."""
    rows = points.withColumn("_block", F.floor(F.col(index) / block_rows) if index else F.lit(0))
    by = [*keys, "_block"]
    ends = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_p"))
    rows = rows.join(ends, by)
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    x = F.least(F.greatest((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 65535
    return rows.select(*points.columns, F.coalesce(F.when(hi > lo, F.floor(x)), F.lit(0)).cast("int").alias("intensity_u16"))


def quantize(points: DataFrame, scale: float = 0.001, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Coordinates as a scaled-integer file would hold them."""
    return points.withColumns({c: F.rint(F.col(c) / scale) * scale for c in cols})


def union_clouds(first: DataFrame, *more: DataFrame, strict: bool = True, source: dict | None = None) -> DataFrame:
    """All rows of all clouds.  `strict` wants equal columns; otherwise missing ones are null."""
    for other in more if strict else ():
        if set(other.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(other.columns) ^ set(first.columns))}")
    out = first
    for other in more:
        out = out.unionByName(other, allowMissingColumns=not strict)
    return out


def pair_scans(*scanners: DataFrame, key: str = "scan_id", order: str = "filename") -> DataFrame:
    """Files of several scanners by scan id, in order of the id and relabelled 1000, 2000, ...; of an id that repeats
    within a scanner the first file counts, and ids that any scanner lacks are left out."""
    firsts = [first_of_each(s.select(key, order), [key], [order]).withColumnRenamed(order, f"file_{n}") for n, s in enumerate(scanners)]
    out = firsts[0]
    for f in firsts[1:]:
        out = out.join(f, key)
    place = F.row_number().over(Window.orderBy(key))  # one row per file pair
    return out.withColumn("label", 1000 + (place - 1) * 1000)


def of_scanner(points: DataFrame, scanner, window: tuple[float, float] | None = None, source: str = "scanner_src", t: str = "t") -> DataFrame:
    """The points of one scanner, in a time window (borders included) if one is given."""
    rows = points.where(F.col(source) == F.lit(scanner))
    return rows.where(F.col(t).between(*window)) if window else rows


def scan_manifest(points: DataFrame, keys: list[str] = ("scan_id",), t: str = "t", source: str | None = None, names: dict | None = None) -> DataFrame:
    """Time range and counts per scan, by source if its values are named."""
    counts = [F.count_if(F.col(source) == v).alias(f"n_{n}") for n, v in (names or {}).items()] if source else []
    return points.groupBy(*keys).agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), *counts, F.count("*").alias("n_total"))


def time_bounds(points: DataFrame, keys: list[str] = ("file",), t: str = "t", index: str | None = None) -> DataFrame:
    """Least and greatest time per file, or with an index the first and last row's."""
    if index:
        return points.groupBy(*keys).agg(F.min_by(t, index).alias("t_first"), F.max_by(t, index).alias("t_last"))
    return points.groupBy(*keys).agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"))


def las_offsets(points: DataFrame, keys: list[str] = ()) -> DataFrame:
    return points.groupBy(*keys).agg(*(F.floor(F.min(c)).cast("double").alias(f"offset_{c}") for c in ("x", "y", "z")))


def slices(manifest: DataFrame, lo: str = "t_start", hi: str = "t_end") -> DataFrame:
    """Half-open ranges (prev_end, t_end] that share the time line among scans; the first is open below, the last
    above.  Ends must rise with the starts."""
    w = Window.orderBy(lo)  # one row per scan
    out = manifest.withColumn("prev_end", F.lag(hi).over(w)).withColumn("_last", F.lead(hi).over(w).isNull())
    if not out.where(F.col(hi) < F.col("prev_end")).isEmpty():
        raise ValueError("scan ends don't rise")
    return out


def slice_onto_scans(points: DataFrame, manifest: DataFrame, width: float, t: str = "t", lo: str = "t_start", hi: str = "t_end", key: str = "scan_id") -> DataFrame:
    """Give each point the scan whose slice holds its time."""
    whole = points.agg(F.min(t).alias("_min"), F.max(t).alias("_max"))
    cut = slices(manifest, lo, hi).crossJoin(F.broadcast(whole))
    low = F.coalesce("prev_end", F.least(F.col("_min"), F.col(hi)) - 1)
    high = F.when(F.col("_last"), F.greatest("_max", hi)).otherwise(F.col(hi))
    cut = cut.select(F.col(key).alias("slice_scan"), low.alias("_lo"), high.alias("_hi"))
    return range_join(points, cut, t, "_lo", "_hi", width, closed="right").drop("_lo", "_hi")


def best_overlap(targets: DataFrame, references: DataFrame, width: float, target: str = "target", order: str = "ref_pos") -> DataFrame:
    """For each target (t_start, t_end) the reference (r_start, r_end) that shares most time; the first on ties."""
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long")))
    sides = targets.withColumn("_bucket", buckets("t_start", "t_end")), references.withColumn("_bucket", buckets("r_start", "r_end"))
    met = partners(*sides, longest(("t_start", "t_end"), ("r_start", "r_end")), [order])
    shared = scalars.overlap(F.col("t_start"), F.col("t_end"), F.col("r_start"), F.col("r_end"))
    met = met.withColumn("overlap", shared)
    rest = [c for c in met.columns if c != target]
    best = met.groupBy(target).agg(F.min_by(F.struct(*rest), F.struct(-F.col("overlap"), F.col(order))).alias("_b"))
    return best.select(target, *(F.col(f"_b.{c}").alias(c) for c in rest))
