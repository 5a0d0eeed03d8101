"""Raw laser vectors: a header whose length comes first, then records of one size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

from ..functions.scalars import finite, week_seconds_to_time
from . import files

# Where a record holds its values, sizes tried for a record, and times that are plausible in it.
LAYOUT = {"t": ("<f8", 0), "sx": ("<f4", 16), "sy": ("<f4", 20), "sz": ("<f4", 24), "intensity_raw": ("<u2", 28)}
SIZES, PROBED, ENOUGH, FALLBACK = range(30, 60), 20, 18, 40
TIMES = (40_000.0, 700_000.0)
WRITTEN, HEADER = 45, 20  # sizes of a record and of the header in written files


def record_size(probe: bytes, payload: int) -> int:
    """The smallest size at which nearly all probed times are plausible and that divides the payload; else the one with most
    plausible times."""
    best, most = FALLBACK, 0
    for size in SIZES:
        times = [np.frombuffer(probe[i * size : i * size + 8], dtype="<f8")[0] for i in range(PROBED) if i * size + 8 <= len(probe)]
        good = sum(TIMES[0] < t < TIMES[1] for t in times)
        if good >= ENOUGH and payload % size == 0:
            return size
        if good > most:
            best, most = size, good
    return best


class SdcSource(DataSource):
    """format("sdc").load(path): file, rec_idx, t, sx, sy, sz, intensity_raw; records with a value that isn't finite are left
    out.  Option recordSize fixes the size.  Written frames have t, sx, sy, sz and intensity_raw."""

    @classmethod
    def name(cls) -> str:
        return "sdc"

    def schema(self) -> str:
        return "file string, rec_idx long, t double, sx double, sy double, sz double, intensity_raw double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("recordSize", 0))
        self.per_task = int(options.get("recordsPerTask", files.RANGE))

    def _shape(self, path: str) -> tuple[int, int, int]:
        whole = files.size_of(self.root, path)
        head = int.from_bytes(files.read(self.root, path, 0, 4), "little")
        size = self.size or record_size(files.read(self.root, path, head, min(60 * 30, max(0, whole - head))), whole - head)
        return head, size, (whole - head) // size

    def partitions(self) -> list[files.Records]:
        return [r for f in files.listing(self.root, (".sdc",)) for r in files.ranges(self.root, f, self._shape(f)[2], self.per_task)]

    def read(self, part: files.Records) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, files.Records):
            return
        head, size, _ = self._shape(part.path)
        kind = np.dtype({"names": list(LAYOUT), "formats": [k for k, _ in LAYOUT.values()], "offsets": [o for _, o in LAYOUT.values()], "itemsize": size})
        x = np.frombuffer(files.read(self.root, part.path, head + part.first * size, part.count * size), dtype=kind)
        cols = {n: x[n].astype(np.float64) for n in LAYOUT}
        keep = np.isfinite(cols["t"]) & np.isfinite(cols["sx"]) & np.isfinite(cols["sy"]) & np.isfinite(cols["sz"])
        at = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(at)), pa.array(at + part.first), *(pa.array(cols[n][at]) for n in LAYOUT)], ["file", "rec_idx", *LAYOUT])


class _Writer(files.FileWriter):
    suffix = ".sdc"

    def encoded(self, columns: dict[str, np.ndarray]) -> bytes:
        kind = np.dtype({"names": list(LAYOUT), "formats": [k for k, _ in LAYOUT.values()], "offsets": [o for _, o in LAYOUT.values()], "itemsize": WRITTEN})
        rows = np.zeros(len(columns["t"]), dtype=kind)
        for n in LAYOUT:
            rows[n] = columns[n]
        return HEADER.to_bytes(4, "little") + bytes(HEADER - 4) + rows.tobytes()


def manifest(vectors: DataFrame, day_shift: float = 0, leap: float = 0) -> DataFrame:
    """(filename, t_min_sow, t_max_sow, t_min, t_max, n_records) from plausible times."""
    ok = vectors.where(finite(F.col("t")) & (F.col("t") > 0) & (F.col("t") < 1e8))
    rows = ok.groupBy(F.regexp_extract("file", r"([^/]+)$", 1).alias("filename")).agg(F.min("t").alias("t_min_sow"), F.max("t").alias("t_max_sow"), F.count("*").alias("n_records"))
    moved = lambda c: week_seconds_to_time(F.col(c), day_shift, leap)
    return rows.select("filename", "t_min_sow", "t_max_sow", moved("t_min_sow").alias("t_min"), moved("t_max_sow").alias("t_max"), "n_records")
