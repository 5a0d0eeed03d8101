"""Smoothed trajectories: records of 17 doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

from . import files

# The fields of a record, in order.
FIELDS = "time lat lon alt vx vy vz roll pitch wander_heading wander_angle ax ay az wx wy wz".split()
SIZE = 8 * len(FIELDS)


class SbetSource(DataSource):
    """format("sbet").load(path): file, rec_idx and the record's fields.  Written rows need time, lat, lon, alt, roll, pitch
    and heading; the heading goes to wander_heading and the other fields are zero unless given."""

    @classmethod
    def name(cls) -> str:
        return "sbet"

    def schema(self) -> str:
        return "file string, rec_idx long, " + ", ".join(f"{f} double" for f in FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.size = int(options.get("recordsPerTask", files.RANGE))

    def partitions(self) -> list[files.Records]:
        out = []
        for f in files.listing(self.root, (".out", ".sbet", ".bin")):
            total, rest = divmod(files.size_of(self.root, f), SIZE)
            if rest:
                raise ValueError(f"{f}: not a whole number of {SIZE}-byte records")
            out += files.ranges(self.root, f, total, self.size)
        return out

    def read(self, part: files.Records) -> Iterator[pa.RecordBatch]:
        if part is None or not isinstance(part, files.Records):
            return
        x = np.frombuffer(files.read(self.root, part.path, part.first * SIZE, part.count * SIZE), dtype="<f8").reshape(-1, len(FIELDS))
        n = len(x)
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(part.first, part.first + n)), *(pa.array(x[:, i]) for i in range(len(FIELDS)))], ["file", "rec_idx", *FIELDS])


class _Writer(files.FileWriter):
    suffix = ".out"

    def encoded(self, columns: dict[str, np.ndarray]) -> bytes:
        columns = {"wander_heading": columns["heading"]} | columns if "heading" in columns else columns
        n = len(columns["time"])
        return np.column_stack([columns.get(f, np.zeros(n)) for f in FIELDS]).astype("<f8").tobytes()


def as_trajectory(sbet: DataFrame, utc: bool = False, leap: float = 18.0) -> DataFrame:
    """Poses of the records: t (moved by the leap seconds if in UTC), lat, lon, alt, roll, pitch, heading."""
    t = F.col("time") + (leap if utc else 0.0)
    return sbet.select(t.alias("t"), "lat", "lon", "alt", "roll", "pitch", (F.col("wander_heading") - F.col("wander_angle")).alias("heading"), F.col("rec_idx").alias("point_idx"))
