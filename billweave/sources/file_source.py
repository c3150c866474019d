"""Files below a folder as a Spark data source, for batches and for streams.

    register(spark)
    spark.read.format("billweave_files").load("hdfs:///in").where("file_type = 'pdf'")
    spark.readStream.format("billweave_files").load("hdfs:///in")

Rows are those of ``files.scan_files``. The driver cuts the tree into subtrees, opening no more folders than it takes to
find enough of them; tasks list the subtrees, so no list of files is held anywhere. Hidden names count as files.

Options: ``path``, ``skip`` (names of folders to pass over, by comma), ``headers`` (``true`` reads the first bytes of supported files),
``partitions`` (subtrees wanted), ``settle`` (seconds, streams only).
"""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
)

from billweave import fixed_values as fv
from billweave.sources.folders import handle, relative

NAME = "billweave_files"
SCHEMA = ("rel_path string, abs_path string, ext string, file_type string, route string, magic_valid boolean, "
          "length bigint, modification_time timestamp")
ARROW = pa.schema([
    ("rel_path", pa.string()), ("abs_path", pa.string()), ("ext", pa.string()), ("file_type", pa.string()),
    ("route", pa.string()), ("magic_valid", pa.bool_()), ("length", pa.int64()),
    ("modification_time", pa.timestamp("us", "UTC"))])
ALWAYS_FILLED = {"rel_path", "abs_path", "ext", "file_type", "route", "length"}
BATCH = 10_000
ROUTES = {"ofd": "ofd", fv.UNSUPPORTED: fv.UNSUPPORTED}


@dataclass
class Subtree(InputPartition):
    """A folder, with or without what lies below its sub-folders, and a span of modification times in microseconds."""

    folder: str
    deep: bool
    after: int | None = None
    until: int | None = None


@dataclass
class Wanted:
    """Pushed conditions: values of a column, prefixes of the relative path, and bounds of the size."""

    values: list[tuple[str, frozenset]]
    prefixes: list[str]
    sizes: list[tuple[str, int]]

    def path(self, rel_path: str) -> bool:
        return all(rel_path.startswith(p) for p in self.prefixes)

    def folder(self, rel_path: str) -> bool:
        """Can a file below this folder have a wanted path?"""
        inside = f"{rel_path}/" if rel_path else ""
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)

    def size(self, length: int) -> bool:
        return all({"<": length < v, "<=": length <= v, ">": length > v, ">=": length >= v, "=": length == v}[op]
                   for op, v in self.sizes)

    def row(self, row: dict) -> bool:
        return all(row[column] in values for column, values in self.values)


def pushed(filters: list[Filter], wanted: Wanted) -> Iterator[Filter]:
    """Take over the conditions that a listing can decide; the others are given back."""
    compared = {LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", EqualTo: "="}
    for condition in filters:
        column = condition.attribute[0] if len(getattr(condition, "attribute", ())) == 1 else None
        if column in ("ext", "file_type", "route", "rel_path") and isinstance(condition, EqualTo):
            wanted.values.append((column, frozenset([condition.value])))
            if column == "rel_path":
                wanted.prefixes.append(condition.value)
        elif column in ("ext", "file_type", "route") and isinstance(condition, In):
            wanted.values.append((column, frozenset(condition.value)))
        elif column == "rel_path" and isinstance(condition, StringStartsWith):
            wanted.prefixes.append(condition.value)
        elif column == "length" and type(condition) in compared:
            wanted.sizes.append((compared[type(condition)], condition.value))
        elif not (column in ALWAYS_FILLED and isinstance(condition, IsNotNull)):
            yield condition


def type_of(name: str) -> tuple[str, str]:
    """Extension, lower case with its dot, and file type of a name."""
    found = re.match(r"(?s)\.*[^.].*(\.[^.]*)$", name)
    ext = found.group(1).lower() if found else ""
    return ext, fv.EXTENSION_TYPES.get(ext, fv.UNSUPPORTED)


class Tree:
    """The tree below a root, as both readers see it."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the data source needs a path")
        self.root = options["path"]
        self.skip = set(filter(None, options.get("skip", ",".join(fv.SKIP_DIRECTORIES)).split(",")))
        self.headers = options.get("headers", "false").lower() == "true"
        self.partitions = int(options.get("partitions", "64"))
        self.wanted = Wanted([], [], [])

    def entries(self, folder: str) -> Iterator[fs.FileInfo]:
        """What lies in a folder; nothing, if it went away or can't be listed."""
        try:
            found = handle(self.root)[0].get_file_info(fs.FileSelector(folder, allow_not_found=True))
        except PermissionError:
            return
        for info in found:
            if info.type != fs.FileType.Directory or info.base_name not in self.skip:
                yield info

    def rel(self, path: str) -> str:
        base = handle(self.root)[1]
        return "" if path == base else relative(path, base)

    def folders(self, entries: Iterator[fs.FileInfo]) -> Iterator[str]:
        return (i.path for i in entries if i.type == fs.FileType.Directory and self.wanted.folder(self.rel(i.path)))

    def subtrees(self, after: int | None = None, until: int | None = None) -> list[Subtree]:
        """Folders are opened breadth first until there are enough subtrees or no more folders."""
        closed, left = [], deque([handle(self.root)[1]])
        while left and len(closed) + len(left) < self.partitions:
            folder = left.popleft()
            closed.append(Subtree(folder, False, after, until))
            left.extend(self.folders(self.entries(folder)))
        return closed + [Subtree(folder, True, after, until) for folder in left]

    def files(self, part: Subtree) -> Iterator[fs.FileInfo]:
        left = [part.folder]
        while left:
            entries = list(self.entries(left.pop()))
            yield from (i for i in entries if i.type == fs.FileType.File)
            if part.deep:
                left.extend(self.folders(iter(entries)))

    def head(self, path: str) -> str:
        try:
            with handle(self.root)[0].open_input_file(path) as file:
                return file.read(4).hex().upper()
        except OSError:
            return ""

    def rows(self, part: Subtree) -> Iterator[dict]:
        wanted = self.wanted
        for info in self.files(part):
            rel_path, changed = self.rel(info.path), (info.mtime_ns or 0) // 1000
            if part.until is not None and not part.after < changed <= part.until:
                continue
            ext, kind = type_of(info.base_name)
            row = {"rel_path": rel_path, "abs_path": info.path, "ext": ext, "file_type": kind,
                   "route": ROUTES.get(kind, "ocr"), "magic_valid": None, "length": info.size or 0,
                   "modification_time": changed}
            if wanted.path(rel_path) and wanted.size(row["length"]) and wanted.row(row):
                if self.headers and kind != fv.UNSUPPORTED:
                    row["magic_valid"] = self.head(info.path).startswith(fv.HEADER_HEX[kind])
                yield row

    def batches(self, part: Subtree) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in self.rows(part):
            rows.append(row)
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class Listing(DataSourceReader):
    """One pass over the tree; conditions on type, path and size are part of it."""

    def __init__(self, options: dict[str, str]):
        self.tree = Tree(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return pushed(filters, self.tree.wanted)

    def partitions(self) -> list[Subtree]:
        return self.tree.subtrees()

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        return self.tree.batches(partition)


class Arrivals(DataSourceStreamReader):
    """Files by the time at which they were last modified.

    An offset is a time, so a stream holds no names, and a batch that is repeated lists the same span again. A span ends
    ``settle`` seconds before now, so that files whose time is a little behind the clock are not missed; a file that
    changes later comes again. A tool that moves files in has to give them a new time.
    """

    def __init__(self, options: dict[str, str]):
        self.tree = Tree(options)
        self.settle = float(options.get("settle", "1"))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int((time.time() - self.settle) * 1e6)}

    def partitions(self, start: dict, end: dict) -> list[Subtree]:
        return self.tree.subtrees(start["until"], end["until"]) if start["until"] < end["until"] else []

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        return self.tree.batches(partition)


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Listing:
        return Listing(dict(self.options))

    def streamReader(self, schema) -> Arrivals:
        return Arrivals(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileSource)


def read_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Files below a root; conditions on type, route, extension, path prefix and size are decided while listing."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(root)


def arriving_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Stream of files that arrive below a root, those already there first."""
    register(spark)
    return spark.readStream.format(NAME).options(**options).load(root)
