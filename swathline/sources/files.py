"""Files of binary sources: finding, opening, and cutting into ranges of records."""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

RANGE = 500_000  # records read by one task


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listing(path: str, suffixes: tuple[str, ...], pattern: str | None = None) -> list[str]:
    """The files of a folder with one of the suffixes, in order, or the file itself."""
    fs, root = resolve(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File]
    keep = [n for n in names if n.lower().endswith(suffixes) and (not pattern or fnmatch.fnmatch(n.rsplit("/", 1)[-1], pattern))]
    return sorted(keep)


def templated(template: str, suffixes: tuple[str, ...] = (".las", ".txt", ".txyzs")) -> dict[str, str]:
    """Files of a path that holds {flight_id}, by the id found in its place."""
    folder, _, name = template.rpartition("/")
    if "{flight_id}" not in name:
        raise ValueError("the file name must hold {flight_id}")
    before, after = name.split("{flight_id}", 1)
    rule = re.compile(re.escape(before) + r"(.+?)" + re.escape(after) + (r"(?:\.\w+)?" if not after.lower().endswith(suffixes) else "") + "$", re.I)
    found = {}
    for f in listing(folder or ".", suffixes):
        m = rule.match(f.rsplit("/", 1)[-1])
        if m:
            found.setdefault(m[1], f)
    return found


def format_of(path: str) -> str:
    """The first of las, laz and txt that a folder has."""
    for kind in ("las", "laz", "txt"):
        if listing(path, (f".{kind}",)):
            return kind
    raise FileNotFoundError(f"no cloud in {path}")


@dataclass
class Records(InputPartition):
    """A range of a file's records."""

    path: str
    first: int
    count: int


def ranges(root: str, path: str, total: int, size: int = RANGE) -> list[Records]:
    return [Records(path, at, min(size, total - at)) for at in range(0, total, size)]


def read(root: str, path: str, offset: int, length: int) -> bytes:
    fs, _ = resolve(root)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def size_of(root: str, path: str) -> int:
    return resolve(root)[0].get_file_info(path).size


PENDING = ".pending"
FILE_ROWS = 2_000_000  # a task begins a new file beyond this


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, under their pending names."""

    paths: tuple[str, ...]


class FileWriter(DataSourceArrowWriter):
    """Writes batches of numeric columns as files under pending names, which get their own when the job commits: a
    task that ran twice leaves nothing that a reader sees.  Null counts as 0."""

    suffix = ""

    def __init__(self, root: str, overwrite: bool = False, prefix: str = "part-"):
        self.root, self.overwrite, self.prefix = root, overwrite, prefix

    def encoded(self, columns: dict[str, np.ndarray]) -> bytes:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = resolve(self.root)
        fs.create_dir(folder, recursive=True)
        held, size, paths = [], 0, []

        def flush() -> None:
            table = pa.Table.from_batches(held)
            columns = {c: pc.fill_null(table.column(c).cast(pa.float64()), 0.0).to_numpy() for c in table.column_names if is_number(table.schema.field(c).type)}
            paths.append(f"{folder}/{self.prefix}{uuid.uuid4().hex}{self.suffix}{PENDING}")
            with fs.open_output_stream(paths[-1], compression=None) as f:
                f.write(self.encoded(columns))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= FILE_ROWS:
                flush()
                held, size = [], 0
        if held:
            flush()
        return Written(tuple(paths))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = resolve(self.root)
        fs.create_dir(folder, recursive=True)
        for old in listing(self.root, (self.suffix,)) if self.overwrite else []:
            fs.delete_file(old)
        for m in messages:
            for path in m.paths if m else ():
                fs.move(path, path.removesuffix(PENDING))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = resolve(self.root)
        for m in messages:
            for path in m.paths if m else ():
                fs.delete_file(path)


def is_number(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_floating(kind)
