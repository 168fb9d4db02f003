"""Saved pages of portals as a data source: ``spark.read.format("saved_pages").load(folder)``.

The folder has a page a file, as ``key=<portal>/page=<n>/...``, or a run of
pages a file, one JSON object a line, as ``key=<portal>/page=<first>-<last>/...``;
``save`` writes either.  Every file is a partition of its own up to ``SINGLE``
files; more are dealt into about so many partitions by their sizes.  Filters on
the portal and the page number choose files while the scan is planned, and
pages of a file while it is read; the others go back to Spark.  A page with fewer records than a full one is a portal's last: pages
behind it are of an earlier, longer crawl and are not taken (``whole``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from io import TextIOWrapper

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

FORMAT, SCHEMA = "saved_pages", "key string, page int, payload string"
_ROWS = pa.schema([("key", pa.string()), ("page", pa.int32()), ("payload", pa.string())])
_PLACE = re.compile(r"key=([^/]*)/page=(\d+)(?:-(\d+))?/[^/_.][^/]*$")
#: Files that are partitions of their own, bytes that more files of a partition may have, bytes of a batch of rows.
SINGLE, MOST, BATCH = 512, 64 << 20, 4 << 20
_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass
class File:
    key: str
    first: int
    last: int
    path: str
    size: int
    packed: bool


@dataclass
class Part(InputPartition):
    files: list[File]


class SavedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SavedPagesReader:
        return SavedPagesReader(self.options["path"])


class SavedPagesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("key",), ("page",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _may(self, file: File) -> bool:
        """Whether a page of the file may pass the filters."""
        for name, kind, value in self.tests:
            if name == "key" or file.first == file.last:
                if not _TESTS[kind](file.key if name == "key" else file.first, value):
                    return False
            elif kind is In and not any(file.first <= v <= file.last for v in value) or kind is EqualTo and not file.first <= value <= file.last:
                return False
            elif kind in (GreaterThan, GreaterThanOrEqual) and not _TESTS[kind](file.last, value) or kind in (LessThan, LessThanOrEqual) and not _TESTS[kind](file.first, value):
                return False
        return True

    def partitions(self) -> list[Part]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = ((_PLACE.search(f.path), f.size or 0) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File)
        files = [File(m[1], int(m[2]), int(m[3] or m[2]), m.string, size, m[3] is not None) for m, size in found if m]
        files = sorted((f for f in files if self._may(f)), key=lambda f: (f.key, f.first, f.path))
        if len(files) <= SINGLE:
            return [Part([f]) for f in files]
        # a file counts at least as its share of the files, so that many small ones are dealt evenly too
        most, least, parts, room = min(MOST, sum(f.size for f in files) // SINGLE + 1), -(-len(files) // SINGLE), [], 0
        for f in files:
            if not parts or room < f.size or len(parts[-1].files) >= 2 * least:
                parts.append(Part([]))
                room = most
            parts[-1].files.append(f)
            room -= f.size
        return parts

    def _pages(self, store: fs.FileSystem, file: File) -> Iterator[tuple[str, int, str]]:
        with store.open_input_stream(file.path) as stream:
            if not file.packed:
                yield file.key, file.first, stream.read().decode(errors="replace").removesuffix("\n")
                return
            numbers = [(kind, value) for name, kind, value in self.tests if name == "page"]
            for line in TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n"):
                one = json.loads(line)
                if all(_TESTS[kind](one["page"], value) for kind, value in numbers):
                    yield file.key, one["page"], one["payload"]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows, size = [], 0
        for row in (row for file in partition.files for row in self._pages(store, file)):
            if rows and size + len(row[2]) > BATCH:
                yield _batch(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The pages below ``folder``, with push-down of filters for this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedPages)
    return spark.read.format(FORMAT).load(folder)


def save(pages: DataFrame, folder: str, per_file: int = 1) -> None:
    """Writes (key, page, payload), a page a file or ``per_file`` pages a file: a large crawl has too many pages for a file each."""
    if per_file == 1:
        pages.select("key", "page", "payload").repartition("key", "page").write.partitionBy("key", "page").mode("overwrite").text(folder)
        return
    first = F.floor(F.col("page") / per_file) * per_file
    line = F.to_json(F.struct("page", F.coalesce("payload", F.lit("")).alias("payload")))
    packed = pages.select("key", F.concat_ws("-", first.cast("string"), (first + per_file - 1).cast("string")).alias("_pages"), line.alias("value"))
    packed.withColumnRenamed("_pages", "page").repartition("key", "page").write.partitionBy("key", "page").mode("overwrite").text(folder)


def whole(pages: DataFrame, records: Column, full: int) -> DataFrame:
    """The pages of each portal up to its first with fewer than ``full`` ``records`` (a count by page)."""
    last = pages.where(F.coalesce(records, F.lit(0)) < full).groupBy("key").agg(F.min("page").alias("_last"))
    return pages.join(F.broadcast(last), "key", "left").where(F.col("_last").isNull() | (F.col("page") <= F.col("_last"))).select(pages.columns)
