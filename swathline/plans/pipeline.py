"""The survey pipeline: georeference, merge, chunk, match.

Each step takes and returns DataFrames.  A step's result goes through a store, which writes it to a folder: later steps then read columns, and don't carry the expressions that made them.
Times are seconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Chunk, Match, Merge, Pipeline, Scanner, Spatial
from ..functions import geodesy, scalars
from ..functions import rotations as rot
from ..operators import chunking, clouds, ordered, pairs
from ..operators.trajectory import with_ecef_attitude

BLOCK = 3600.0  # seconds of a trajectory that one task orders
WIDTH = 1.0  # seconds of the narrowest time bucket


def keep(name: str, df: DataFrame) -> DataFrame:
    """The default store: Parquet below spark.checkpoint.dir, which outlives executors; a session without that setting
    keeps the rows itself."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    return folder(f"{base}/survey-{uuid.uuid4().hex}")(name, df) if base else df.persist()


def folder(path: str) -> Callable[[str, DataFrame], DataFrame]:
    """A store that writes Parquet below a path."""

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return df.sparkSession.read.parquet(f"{path}/{name}")

    return put


def prepared_trajectory(trajectory: DataFrame) -> DataFrame:
    """Earth-fixed positions and attitudes of poses given as lat, lon, alt, roll, pitch, heading; map coordinates besides."""
    ecef = geodesy.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    rows = with_ecef_attitude(trajectory.withColumns(dict(zip(("ex", "ey", "ez"), ecef, strict=True))))
    return geodesy.with_swiss(rows, ("ex", "ey", "ez"), ("x", "y", "z"))


def georef(cfg: Pipeline, scanner: Scanner, vectors: DataFrame, trajectory: DataFrame, store: Callable = keep) -> DataFrame:
    """Map points of one scanner's vectors."""
    rows = vectors.where(scalars.finite(*(F.col(c) for c in ("t", "sx", "sy", "sz"))))
    rows = clouds.day_shift(rows, trajectory, keys=["file"], leap=scanner.leapsec or 0).drop("day_shift")
    if cfg.window.enable and cfg.outage:
        rows = rows.where(scalars.any_window(F.col("t"), [tuple(cfg.outage)], cfg.window.margin_s))
    ends = trajectory.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    rows = rows.crossJoin(F.broadcast(ends)).where("t between _lo and _hi").drop("_lo", "_hi")
    clouds.required(rows, f"{scanner.name}: no vector within the trajectory and window")
    turn = rot.sensor_to_body(*scanner.boresight, scanner.r_mount)
    points = clouds.georeference(rows, trajectory, turn, scanner.lever_arm, WIDTH, BLOCK, cfg.frame, cfg.origin, body_vector=scanner.body_vector)
    points = store(f"georef_{scanner.name}", points)
    if cfg.distance.enable:
        points = clouds.near_trajectory(points, trajectory, cfg.distance.max_distance_m, WIDTH, BLOCK).drop("distance")
    return points.withColumn("scanner_src", F.lit(scanner.source).cast("short"))


def merge(cfg: Merge, vux: DataFrame, puck: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged cloud with scan_id, and its manifest.  vux has scan_id; puck points get the scan whose time slice holds
    them."""
    vux = vux.withColumn("scanner_src", F.lit(cfg.scanner_src_vux).cast("short"))
    merged = vux
    if cfg.preset != "vux_only" and puck is not None:
        scans = clouds.scan_manifest(vux)
        sliced = clouds.slice_onto_scans(puck.drop("scan_id"), scans, 60.0).withColumnRenamed("slice_scan", "scan_id")
        merged = clouds.union_clouds(vux, sliced.withColumn("scanner_src", F.lit(cfg.scanner_src_puck).cast("short")), strict=False)
    return merged, clouds.scan_manifest(merged, source="scanner_src", names={"vux": cfg.scanner_src_vux, "puck": cfg.scanner_src_puck})


def chunk(cfg: Chunk, points: DataFrame, trajectory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with scan_id and chunk_k, and the chunks' boxes from the trajectory."""
    least = cfg.min_last_m if cfg.min_last_m is not None else chunking.least_last(cfg.length_m)
    cut = chunking.chunk_points(points, trajectory, cfg.length_m, least, BLOCK, WIDTH, ["scan_id"], min_points=cfg.min_points)
    return cut, chunking.trajectory_boxes(cut, trajectory, ["scan_id", "chunk_k"], WIDTH, BLOCK)


def chunk_pairs(cfg: Match, boxes: DataFrame) -> DataFrame:
    """Chunk pairs to match: kind, scan_a, k_a, scan_b, k_b."""
    key = F.struct("scan_id", "chunk_k")
    rows = boxes.withColumn("chunk", key)
    out = lambda df, kind, a="a", b="b": df.select(F.lit(kind).alias("kind"), F.col(f"{a}.scan_id").alias("scan_a"), F.col(f"{a}.chunk_k").alias("k_a"), F.col(f"{b}.scan_id").alias("scan_b"), F.col(f"{b}.chunk_k").alias("k_b"))
    found = out(pairs.neighbours(rows, max(cfg.neighbor_k, 1), "scan_id"), "neighbour").where(F.lit(cfg.neighbor_k > 0))
    if cfg.do_cross_scan:
        found = found.unionByName(out(pairs.across_scans(rows, "scan_id"), "across"))
    if cfg.do_spatial_crossings:
        found = found.unionByName(out(pairs.crossings(rows, cfg.crossing_min_separation, cfg.crossing_overlap_margin_m, 50.0), "crossing"))
    return found


def match(found: DataFrame, points: DataFrame, cfg: dict, matcher: Callable = pairs.nearest_matcher) -> DataFrame:
    """Correspondences of every pair of chunks."""
    cols = ["t", "x", "y", "z"]
    keys = ["kind", "scan_a", "k_a", "scan_b", "k_b"]
    side = lambda s: found.join(points.select(F.col("scan_id").alias(f"scan_{s}"), F.col("chunk_k").alias(f"k_{s}"), *cols), [f"scan_{s}", f"k_{s}"]).select(*keys, *cols)
    return pairs.match_clouds(side("a"), side("b"), keys, cfg, matcher)


def spatial_pairs(cfg: Spatial, forward: DataFrame, backward: DataFrame, trajectory: DataFrame, matcher: Callable = pairs.nearest_matcher) -> DataFrame:
    """Correspondences of opposite passes (pair, t, x, y, z each), chunked along the forward pass's axis."""
    mean = lambda df, n: df.groupBy("pair").agg(F.avg("t").alias(n), F.min("t").alias(f"{n}_lo"), F.max("t").alias(f"{n}_hi"))
    both = pairs.separated(mean(forward, "mean_a").join(mean(backward, "mean_b"), "pair"), cfg.min_time_sep)
    own = trajectory.join(F.broadcast(both.select("pair", "mean_a_lo", "mean_a_hi")), F.col("t").between(F.col("mean_a_lo"), F.col("mean_a_hi")))  # one row per pair
    axes = chunking.axis(own, ["pair"]).where("tx is not null")
    least = cfg.min_last_m if cfg.min_last_m is not None else chunking.least_last(cfg.length_m)
    fwd, bwd = chunking.project(forward, axes, ["pair"]), chunking.project(backward, axes, ["pair"])
    extent = chunking.project(own.select("pair", "t", "x", "y"), axes, ["pair"]).groupBy("pair").agg(F.min("proj").alias("s_min"), F.max("proj").alias("s_max"))
    cut = lambda df: chunking.chunk_by_axis(df, extent, cfg.length_m, least, ["pair"])
    fwd, bwd = cut(fwd), cut(bwd)
    if cfg.min_points > 1:
        enough = lambda df: df.join(df.groupBy("pair", "chunk_k").count().where(F.col("count") >= cfg.min_points).drop("count"), ["pair", "chunk_k"], "left_semi")
        fwd, bwd = enough(fwd), enough(bwd)
    common = chunking.common_chunks(fwd, bwd, ["pair"])
    keep = lambda df: df.join(common, ["pair", "chunk_k"], "left_semi")
    return pairs.match_clouds(keep(fwd), keep(bwd), ["pair", "chunk_k"], scalars.uncertainty({}, scalar=cfg.uncertainty_r), matcher)


def run(cfg: Pipeline, vectors: dict[str, DataFrame], trajectory: DataFrame, matcher: Callable = pairs.nearest_matcher, store: Callable = keep) -> dict[str, DataFrame]:
    """All enabled steps.  vectors: laser vectors with scan_id, by scanner name."""
    out: dict[str, DataFrame] = {"trajectory": trajectory}
    found = {}
    if cfg.steps["georef"]:
        found = {s.name: georef(cfg, s, vectors[s.name], trajectory, store) for s in cfg.scanners}
        out |= {f"points_{n}": p for n, p in found.items()}
    if cfg.steps["merge"]:
        vux = [found[n] for n in (cfg.merge.vux or [n for n in found if n != cfg.merge.puck])]
        merged, out["manifest"] = merge(cfg.merge, clouds.union_clouds(*vux), found.get(cfg.merge.puck or ""))
        out["merged"] = store("merged", merged)
    if cfg.steps["chunk"]:
        chunks, boxes = chunk(cfg.chunk, out["merged"], trajectory)
        out["chunks"], out["boxes"] = store("chunks", chunks), store("boxes", boxes)
        out["pairs"] = chunk_pairs(cfg.chunk.match, out["boxes"])
        m = cfg.chunk.match
        settings = scalars.uncertainty({}, m.uncertainty_r_min, m.uncertainty_r_max, m.uncertainty_r)
        out["matches"] = match(out["pairs"], out["chunks"], settings, matcher)
    return out


def thinned(points: DataFrame, every: int) -> DataFrame:
    return ordered.every_nth(points, every, "point_idx", ["file"])
