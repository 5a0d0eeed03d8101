"""Point files of the LAS format, versions 1.2 to 1.4, point formats 0 to 3 and 6 to 8, with extra bytes.

Compressed files (LAZ) need a codec that isn't here and raise.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

from . import files

# The format's layouts.  Point formats: size, and places of intensity, time (if any).
POINT = {0: (20, 12, None), 1: (28, 12, 20), 2: (26, 12, None), 3: (34, 12, 20), 6: (30, 12, 22), 7: (36, 12, 22), 8: (38, 12, 22)}
KINDS = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
EXTRA = {"lvx": ("lasvec_x", "<f4"), "lvy": ("lasvec_y", "<f4"), "lvz": ("lasvec_z", "<f4"), "scanner_src": ("scanner_src", "u1"), "e3d": ("e3d", "<f4")}
HEADER_12, HEADER_14 = 227, 375


def header(root: str, path: str) -> dict:
    """The header of a file: layout, counts, scales, bounds and extra dimensions (name: kind, place)."""
    raw = files.read(root, path, 0, HEADER_14)
    if raw[:4] != b"LASF":
        raise ValueError(f"{path}: no LAS file")
    minor, size, offset, n_vlr, kind, length, count = raw[25], *struct.unpack("<HIIBHI", raw[94:111])
    if kind & 0x80 or path.lower().endswith(".laz"):
        raise ValueError(f"{path}: compressed LAS is unsupported")
    if kind not in POINT:
        raise ValueError(f"{path}: point format {kind} is unsupported")
    numbers = struct.unpack("<12d", raw[131:227])
    if minor >= 4 and size >= HEADER_14:
        count = struct.unpack("<Q", raw[247:255])[0] or count
    extra, at = {}, size
    for _ in range(n_vlr):
        _, user, record, length_after, _ = struct.unpack("<H16sHH32s", files.read(root, path, at, 54))
        if user.rstrip(b"\0") == b"LASF_Spec" and record == 4:
            body, place = files.read(root, path, at + 54, length_after), POINT[kind][0]
            for i in range(0, len(body), 192):
                what = body[i + 2]
                if what == 0:
                    place += body[i + 3]
                elif what in KINDS:
                    extra[body[i + 4 : i + 36].rstrip(b"\0").decode()] = (KINDS[what], place)
                    place += np.dtype(KINDS[what]).itemsize
                else:
                    raise ValueError(f"{path}: extra dimension of kind {what} is unsupported")
        at += 54 + length_after
    return {"version": f"1.{minor}", "offset": offset, "format": kind, "length": length, "count": count, "scale": numbers[0:3], "shift": numbers[3:6], "max": numbers[6::2], "min": numbers[7::2], "extra": extra}


class LasSource(DataSource):
    """format("las").load(path): file, point_idx, t, x, y, z, intensity and the known extra dimensions (null where a file has
    none).  Written frames have t, x, y, z, intensity and any of these; each task writes one file of point format 1 (or 6 with
    option pointFormat), version 1.4; option prefix begins the files' names."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "file string, point_idx long, t double, x double, y double, z double, intensity int, lvx float, lvy float, lvz float, scanner_src short, e3d float"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size, self.pattern = options["path"], int(options.get("recordsPerTask", files.RANGE)), options.get("pattern")

    def partitions(self) -> list[files.Records]:
        return [r for f in files.listing(self.root, (".las", ".laz"), self.pattern) for r in files.ranges(self.root, f, header(self.root, f)["count"], self.size)]

    def read(self, part: files.Records) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, files.Records):
            return
        h = header(self.root, part.path)
        _, intensity, time = POINT[h["format"]]
        places = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "intensity": ("<u2", intensity)} | ({"t": ("<f8", time)} if time else {}) | {f"extra:{n}": k for n, k in h["extra"].items()}
        kind = np.dtype({"names": list(places), "formats": [k for k, _ in places.values()], "offsets": [o for _, o in places.values()], "itemsize": h["length"]})
        x = np.frombuffer(files.read(self.root, part.path, h["offset"] + part.first * h["length"], part.count * h["length"]), dtype=kind)
        n = len(x)
        cols = [pa.array([part.path] * n), pa.array(np.arange(part.first, part.first + n)), pa.array(x["t"].copy()) if time else pa.nulls(n, pa.float64())]
        cols += [pa.array(x[c] * h["scale"][i] + h["shift"][i]) for i, c in enumerate("XYZ")]
        cols.append(pa.array(x["intensity"].astype(np.int32)))
        for c, (name, k) in EXTRA.items():
            to = pa.int16() if k == "u1" else pa.float32()
            cols.append(pa.array(x[f"extra:{name}"].astype(np.int16 if k == "u1" else np.float32)) if name in h["extra"] else pa.nulls(n, to))
        yield pa.RecordBatch.from_arrays(cols, ["file", "point_idx", "t", "x", "y", "z", "intensity", *EXTRA])


def encode(cols: dict[str, np.ndarray], fmt: int = 1, scale: float = 0.001) -> bytes:
    """A whole file of points."""
    extra = [(c, *EXTRA[c]) for c in EXTRA if c in cols]
    base, intensity, time = POINT[fmt]
    places = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "intensity": ("<u2", intensity), "flags": ("u1", 14), "t": ("<f8", time)}
    at, described = base, b""
    for c, name, k in extra:
        places[c] = (k, at)
        at += np.dtype(k).itemsize
        described += bytes(2) + bytes([next(i for i, v in KINDS.items() if v == k), 0]) + name.encode().ljust(32, b"\0") + bytes(192 - 36)
    n = len(cols["t"])
    points = np.zeros(n, dtype=np.dtype({"names": list(places), "formats": [k for k, _ in places.values()], "offsets": [o for _, o in places.values()], "itemsize": at}))
    shift = [float(np.floor(cols[c].min())) if n else 0.0 for c in "xyz"]
    for c, up, s in zip("xyz", "XYZ", shift, strict=True):
        points[up] = np.rint((cols[c] - s) / scale)
    points["intensity"], points["t"], points["flags"] = cols["intensity"], cols["t"], 0x11 if fmt >= 6 else 0x09
    for c, _, _ in extra:
        points[c] = cols[c]
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(described), b"extra bytes") + described if extra else b""
    ends = [v for c, up, s in zip("xyz", "XYZ", shift, strict=True) for v in ((float(points[up].max()) * scale + s, float(points[up].min()) * scale + s) if n else (0.0, 0.0))]
    head = bytearray(HEADER_14)
    head[0:4], head[24:26] = b"LASF", bytes((1, 4))
    head[26:90] = b"swathline".ljust(32, b"\0") + b"swathline".ljust(32, b"\0")
    struct.pack_into("<HHHIIBHI", head, 90, 1, 2024, HEADER_14, HEADER_14 + len(vlr), int(bool(vlr)), fmt, at, n if n < 2**32 and fmt < 6 else 0)
    struct.pack_into("<12d", head, 131, scale, scale, scale, *shift, *ends)
    struct.pack_into("<QQIQ", head, 227, 0, 0, 0, n)
    struct.pack_into("<Q", head, 255, n)
    return bytes(head) + vlr + points.tobytes()


class _Writer(files.FileWriter):
    suffix = ".las"

    def __init__(self, options: dict, schema, overwrite: bool):
        super().__init__(options["path"], overwrite, options.get("prefix", "part-"))
        self.fmt, self.scale = int(options.get("pointFormat", 1)), float(options.get("scale", 0.001))

    def encoded(self, columns: dict[str, np.ndarray]) -> bytes:
        cols = {c: columns[c] for c in ("t", "x", "y", "z", "intensity", *EXTRA) if c in columns}
        cols.setdefault("intensity", np.zeros(len(cols["t"])))
        return encode(cols, self.fmt, self.scale)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file from its header alone."""
    rows = []
    for f in files.listing(path, (".las",)):
        h = header(path, f)
        rows.append((f, h["version"], h["format"], h["count"], *map(float, h["min"]), *map(float, h["max"])))
    return spark.createDataFrame(rows, "file string, version string, point_format int, n_points long, x_min double, y_min double, z_min double, x_max double, y_max double, z_max double")
