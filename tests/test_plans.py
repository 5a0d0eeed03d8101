"""The pipeline end to end on a straight drive, settings, and streaming forms."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline import config, streaming
from swathline.plans import pipeline


def drive(spark):
    lat, lon = math.radians(46.5), math.radians(6.6)
    poses = [(float(t), lat + t * 1e-6, lon, 400.0, 0.0, 0.0, 0.0) for t in range(0, 61)]
    return pipeline.prepared_trajectory(spark.createDataFrame(poses, "t double, lat double, lon double, alt double, roll double, pitch double, heading double")).persist()


def test_pipeline(spark, tmp_path):
    trajectory = drive(spark)
    at = [(f, s, i, 0.5 + i * 0.29 - 18, 0.0, 5.0, 2.0, 100.0) for f, s in (("a", 1),) for i in range(200)]
    vectors = spark.createDataFrame(at, "file string, scan_id long, rec_idx long, t double, sx double, sy double, sz double, intensity_raw double")
    cfg = config.load({
        "steps": {"georef": True, "merge": True, "chunk": True}, "scanners": [{"name": "ha"}, {"name": "puck", "source": 1}], "merge": {"vux": ["ha"], "puck": "puck"},
        "chunk": {"length_m": 50.0, "match": {"neighbor_k": 1, "uncertainty_r": 60.0}}, "distance": {"enable": True, "max_distance_m": 6.0},
    })
    out = pipeline.run(cfg, {"ha": vectors, "puck": vectors.where("rec_idx % 5 = 0")}, trajectory, store=pipeline.folder(str(tmp_path)))
    pts = out["points_ha"].join(trajectory.select(F.col("t").alias("pt"), "x", "y").withColumnsRenamed({"x": "px", "y": "py"}), F.floor("t") == F.col("pt")).collect()
    assert len(pts) == 200
    for r in pts:  # 5 m to the right of a northward drive, seen on the map
        assert math.hypot(r["x"] - r["px"], 0) == pytest.approx(5.0, abs=0.5)
    m = out["manifest"].first()
    assert (m["n_vux"], m["n_puck"], m["n_total"]) == (200, 40, 240)
    chunks = {r["chunk_k"]: r["count"] for r in out["chunks"].groupBy("chunk_k").count().collect()}
    assert len(chunks) >= 5 and sum(chunks.values()) > 200
    assert out["boxes"].count() == len(chunks) and out["pairs"].count() == len(chunks) - 1
    assert "d_xyz" in out["matches"].columns and out["matches"].count() > 0


def test_opposite_passes(spark):
    trajectory = spark.createDataFrame([(float(t), 10.0 * t, 0.0) for t in range(21)] + [(float(t), 400.0 - 10.0 * t, 1.0) for t in range(21, 41)], "t double, x double, y double")
    mk = lambda lo, y: spark.createDataFrame([("p", lo + i * 0.5, (10.0 * (lo + i * 0.5)) if lo == 0 else 400 - 10 * (lo + i * 0.5), y, 0.0) for i in range(40)], "pair string, t double, x double, y double, z double")
    got = pipeline.spatial_pairs(config.Spatial(length_m=20.0, uncertainty_r=2.0), mk(0.0, 0.0), mk(20.5, 1.0), trajectory)
    rows = got.collect()
    assert rows and all(abs(r["d_xyz"] - 1.0) < 0.01 or r["d_xyz"] <= 2.0 for r in rows)
    none = pipeline.spatial_pairs(config.Spatial(length_m=20.0, min_time_sep=100.0), mk(0.0, 0.0), mk(20.5, 1.0), trajectory)
    assert none.count() == 0


def test_settings():
    c = config.load({})
    assert (c.chunk.length_m, c.s2s.length_m, c.merge.preset, c.window.margin_s, c.chunk.match.crossing_min_separation) == (15.0, 20.0, "all", 30.0, 10)
    with pytest.raises(ValueError):
        config.load({"chunk": {"lenght": 3}})
    with pytest.raises(ValueError):
        config.load({"merge": {"preset": "none"}})


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i % 2, float(i), f"2024-01-0{1 + i // 10} 00:00:{i % 10:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "scan int, e double, s string").withColumn("ts", F.to_timestamp("s")).drop("s")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = streaming.append_metrics(stream, str(tmp_path / "sums"), str(tmp_path / "cp"), ["scan"])
    q.awaitTermination(60)
    got = {r["scan"]: (r["n"], r["rmse"], r["max"]) for r in streaming.running_summary(spark.read.parquet(str(tmp_path / "sums")), ["scan"]).collect()}
    for k in (0, 1):
        e = np.array([x for s, x, _ in rows if s == k])
        assert got[k] == (15, pytest.approx(float(np.sqrt((e**2).mean()))), e.max())
    m = streaming.manifest_stream(stream).writeStream.format("memory").queryName("man").outputMode("complete").trigger(availableNow=True).start()
    m.awaitTermination(60)
    time.sleep(0.1)
    assert spark.sql("select sum(n), count(*) from man").first()[0] == 30
