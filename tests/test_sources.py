"""Formats: round trips and fixed layouts."""

import struct
import tarfile

import numpy as np
import pytest

from swathline import sources
from swathline.sources import files, las, sbet, sdc, sinks, text


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    sources.register(spark)


def test_sbet_round_trip(spark, tmp_path):
    rows = [(float(i), 0.8, 0.1, 400.0, 0.01, 0.02, 0.5) for i in range(7)]
    df = spark.createDataFrame(rows, "time double, lat double, lon double, alt double, roll double, pitch double, heading double").coalesce(1)
    df.write.format("sbet").mode("append").save(str(tmp_path / "s"))
    back = spark.read.format("sbet").option("recordsPerTask", 3).load(str(tmp_path / "s"))
    assert back.rdd.getNumPartitions() == 3
    got = sbet.as_trajectory(back, utc=True).orderBy("t").collect()
    assert [r["t"] for r in got] == [18.0 + i for i in range(7)] and got[0]["heading"] == 0.5
    (tmp_path / "bad.out").write_bytes(b"12345")
    with pytest.raises(Exception, match="136-byte"):
        spark.read.format("sbet").load(str(tmp_path / "bad.out")).count()


@pytest.mark.parametrize("size", [45, 40, 33])
def test_sdc(spark, tmp_path, size):
    n = 50
    body = bytearray(n * size)
    for i in range(n):
        struct.pack_into("<dfffffH", body, i * size, 50000.0 + i, 0, 0, float(i), 2.0, float("nan") if i == 3 else 3.0, 7)
    (tmp_path / "a.sdc").write_bytes(struct.pack("<I", 20) + bytes(16) + bytes(body))
    df = spark.read.format("sdc").option("recordsPerTask", 16).load(str(tmp_path))
    got = df.orderBy("rec_idx").collect()
    assert len(got) == n - 1 and got[0]["t"] == 50000.0 and got[-1]["sx"] == 49.0 and got[5]["intensity_raw"] == 7.0
    m = sdc.manifest(df, day_shift=1, leap=18).first()
    assert (m["filename"], m["t_min_sow"], m["t_max"], m["n_records"]) == ("a.sdc", 50000.0, 50049.0 + 86400 + 18, 49)


@pytest.mark.parametrize("fmt", [1, 6])
def test_las_round_trip(spark, tmp_path, fmt):
    rows = [(100.0 + i, 2_700_000.1234 + i, 1_100_000.5, 600.25, i, 0.5, 0.25, -1.0, i % 3) for i in range(10)]
    df = spark.createDataFrame(rows, "t double, x double, y double, z double, intensity int, lvx float, lvy float, lvz float, scanner_src short").coalesce(1)
    df.write.format("las").mode("append").option("pointFormat", fmt).save(str(tmp_path))
    back = spark.read.format("las").option("recordsPerTask", 4).load(str(tmp_path)).orderBy("point_idx").collect()
    for r, w in zip(back, rows, strict=True):
        assert (r["t"], r["intensity"], r["lvx"], r["scanner_src"], r["e3d"]) == (w[0], w[4], 0.5, w[8], None)
        assert r["x"] == pytest.approx(w[1], abs=5.1e-4) and r["z"] == 600.25
    h = las.headers(spark, str(tmp_path)).first()
    assert h["n_points"] == 10 and h["point_format"] == fmt and h["x_min"] == pytest.approx(2_700_000.123)
    (tmp_path / "x.laz").write_bytes(open(h["file"], "rb").read())
    with pytest.raises(Exception, match="unsupported"):
        spark.read.format("las").load(str(tmp_path / "x.laz")).count()


def test_text_clouds(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# head\n1,2,3,4\n1.5,2,3,4,9\n\n2\t2\t3\t4\t.1\t.2\t.3\n3,1,1,1,.1,.2,.3,77\nbad,1,2,3\n1,2\n")
    got = text.ascii_cloud(spark, str(tmp_path / "c.txt")).orderBy("t").collect()
    assert [(r["t"], r["lvx"], r["intensity"]) for r in got] == [(1.0, None, None), (1.5, None, 9.0), (2.0, 0.1, None), (3.0, 0.1, 77.0)]
    text.write_cloud(text.ascii_cloud(spark, str(tmp_path / "c.txt")).where("t = 3"), str(tmp_path / "o"), ("lvx", "lvy", "lvz"), "intensity")
    assert spark.read.text(str(tmp_path / "o")).first()[0] == "3.000000000,1.000,1.000,1.000,0.100,0.200,0.300,77"
    (tmp_path / "v.csv").write_text("x,y,z,t,i\n1,2,3,4,5\n6,7,8,9,10\n")
    assert text.laser_vectors(spark, str(tmp_path / "v.csv")).orderBy("t").first()["sx"] == 1.0


def test_trajectories_and_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 90 0 5\n1 45 0 6\n2 0 0 7\n")
    got = text.ascii_trajectory(spark, str(tmp_path / "t.txt"), {"t": 0, "lat": 1, "lon": 2, "alt": 3}, degrees=True, utc=True).orderBy("t").collect()
    assert [(r["t"], round(r["lat"], 6), r["alt"]) for r in got] == [(19.0, round(np.pi / 2, 6), 5.0), (20.0, 0.0, 7.0)]
    log = tmp_path / "PoseSE3(W).log"
    log.write_text("".join(f"{i},0,1,2,3,1,0,0,0\n" for i in range(6)))
    with tarfile.open(tmp_path / "dn.tar.gz", "w:gz") as t:
        t.add(log, "d/PoseSE3(W).log")
    poses = text.pose_log(spark, str(tmp_path / "dn.tar.gz"), (10, 0, 0), every=2)
    assert [(r["t"], r["ex"]) for r in poses.orderBy("t").collect()] == [(0.0, 11.0), (2.0, 11.0), (4.0, 11.0)]
    (tmp_path / "m.csv").write_text("filename,t_min,t_max\na,1,2\nb,x,3\n")
    assert [tuple(r) for r in text.manifest(spark, str(tmp_path / "m.csv")).orderBy("filename").collect()] == [("a", 1.0, 2.0), ("b", None, 3.0)]
    (tmp_path / "n.csv").write_text("filename,t_min\na,1\n")
    with pytest.raises(ValueError):
        text.manifest(spark, str(tmp_path / "n.csv"))
    (tmp_path / "p.yml").write_text("lcps:\n- {id: A, gps_time: 5}\n- {id: B, gps_time: 6.5, note: x}\n")
    assert sorted((r["id"], r["gps_time"], r["note"]) for r in text.control_points(spark, str(tmp_path / "p.yml")).collect()) == [("A", 5.0, None), ("B", 6.5, "x")]
    (tmp_path / "q.txt").write_text("h,h,h,h,h,h,h,h,h,h,h,h\n" + ", ".join(map(str, range(12))) + "\n1,2\n")
    assert text.correspondences(spark, str(tmp_path / "q.txt")).first()["d_xyz"] == 8.0


def test_discovery(tmp_path):
    for n in ("flight_7_a.las", "flight_12_a.las", "other.las", "z.txt"):
        (tmp_path / n).write_bytes(b"")
    assert sorted(files.templated(f"{tmp_path}/flight_{{flight_id}}_a.las")) == ["12", "7"]
    assert files.format_of(str(tmp_path)) == "las"
    with pytest.raises(FileNotFoundError):
        files.listing(str(tmp_path / "none"), (".las",))


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0, 3.5, None), ("a", 1.0, 2.0, float("nan"))], "filename string, t_min double, t_max double, extra double").repartition(4)
    sinks.write_manifest(rows, str(tmp_path / "m"), raw=True)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*"))).split()
    assert lines == ["filename,t_min,t_max,extra", "a,1.000000,2.000000,", "b,2.000000,3.500000,"]
    assert [r["t_max"] for r in text.manifest(spark, str(tmp_path / "m")).orderBy("filename").collect()] == [2.0, 3.5]
    boxes = spark.createDataFrame([(f"c{i}.las", 9.0 - i, 10.0, 0.0, 1.0, 0.0, 1.0) for i in range(5)], text.BOXES)
    for _ in range(2):  # replaces
        sinks.write_boxes(boxes, str(tmp_path / "b"))
    assert [r["chunk_file"] for r in text.boxes(spark, [str(tmp_path / "b")]).collect()] == [f"c{i}.las" for i in range(4, -1, -1)]
    sinks.write_summary(rows.drop("extra").limit(0), str(tmp_path / "e"), ["filename"])


def test_windows_and_errors(spark, tmp_path):
    rows = [(1, 2, "v" if i % 2 else "w", i / 3, 1.0 * i, 2.0, 3.0, 0.5) for i in range(40)]
    points = spark.createDataFrame(rows, "fi int, fj int, flight string, t double, x double, y double, z double, e3d double")
    sinks.write_windows(points, str(tmp_path / "w"))
    back = spark.read.parquet(str(tmp_path / "w"))
    assert sorted(map(tuple, back.select(points.columns).collect())) == sorted(rows)
    sinks.write_window_text(points, str(tmp_path / "t"))
    lines = [x for p in (tmp_path / "t").glob("fi=1/fj=2/flight=v/part-*") for x in p.read_text().split()]
    assert len(lines) == 20 and "0.3333333333,1.0000000000,2.0000000000,3.0000000000" in lines
    sinks.write_errors(points.withColumnRenamed("flight", "method"), str(tmp_path / "e"))
    assert text.error_points(spark, str(tmp_path / "e")).where("method = 'v'").count() == 20


def test_error_files(spark, tmp_path):
    points = spark.createDataFrame([(i * 1.0, 10.0 + i, 20.0, 5.0, 0.25 * i) for i in range(30)], "t double, x double, y double, z double, e3d double")
    for method in ("a", "b"):
        sinks.write_error_files(points, str(tmp_path / method))
        for i, p in enumerate(sorted((tmp_path / method).glob("*.las"))):
            p.rename(p.with_name(f"rmse_{i}.las"))
    (tmp_path / "a" / "other.las").write_bytes((tmp_path / "a" / "rmse_0.las").read_bytes())
    got = text.error_files(spark, str(tmp_path))
    assert got.groupBy("method").count().orderBy("method").collect() == [("a", 30), ("b", 30)]
    assert [r["e3d"] for r in got.where("method = 'a'").orderBy("t").limit(3).collect()] == [0.0, 0.25, 0.5]
    with pytest.raises(FileNotFoundError):
        text.error_files(spark, str(tmp_path / "a"))


def test_writers_commit(spark, tmp_path):
    """Files appear when the job commits; what a lost attempt left is not read, and overwriting replaces."""
    root = tmp_path / "c"
    df = spark.createDataFrame([(i * 1.0, 1.0, 2.0, 3.0, 7) for i in range(50)], "t double, x double, y double, z double, intensity int").repartition(3)
    df.write.format("las").mode("append").save(str(root))
    (root / "part-lost.las.pending").write_bytes(next(root.glob("*.las")).read_bytes())
    assert spark.read.format("las").load(str(root)).count() == 50
    df.limit(20).write.format("las").mode("overwrite").save(str(root))
    assert spark.read.format("las").load(str(root)).count() == 20
    writer = las._Writer({"path": str(root)}, None, False)
    done = writer.write(iter(df.limit(5).toArrow().to_batches()))
    writer.abort([done, None])
    assert spark.read.format("las").load(str(root)).count() == 20


def test_trajectory_kinds(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 0.5 0.6 7\n2 0.5 0.6 8\n")
    got = text.trajectory(spark, str(tmp_path / "t.txt"), "ASCII", columns={"t": 0, "lat": 1, "lon": 2, "alt": 3})
    assert [r["alt"] for r in got.orderBy("t").collect()] == [7.0, 8.0]
    with pytest.raises(ValueError, match="XYZ"):
        text.trajectory(spark, "x", "XYZ")
