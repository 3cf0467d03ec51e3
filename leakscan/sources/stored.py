"""Stored records as a Python data source: batch and stream, by files, with filters pushed down.

Reads the tables of sources/checkpoints.py. In batch the rows that stand, a partition for each file; conditions that a
filter on the key rules out are not listed, and other filters on plain values go to the Parquet scan. As a stream
every complete write once, replaced later or not: an offset is the list of the writes seen, so a write that is late in the log is
not lost, and a query that starts again goes on after its last offset.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "stored_records"
#: Rows of a batch, of which one is read ahead: a task holds little of a file of any size.
BATCH = 10_000
#: Columns of stored answers, if the option schema doesn't name others.
ANSWERS = "model string, pid long, category string, template_id string, condition string, type string, expected string, output string, hit boolean, match_method string"


@dataclass
class File(InputPartition):
    path: str


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _log(path: str) -> list[dict]:
    """The log's rows (checkpoints.LOG), in the order of writes."""
    where, root = _open(path)
    found = where.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True, recursive=True))
    rows = []
    for f in found:
        # a job's files lie in _temporary until it is committed
        if f.base_name.endswith(".json") and "/_temporary/" not in f.path:
            with where.open_input_stream(f.path) as s:
                rows += [json.loads(line) for line in s.readall().splitlines() if line.strip()]
    return sorted(rows, key=lambda r: (r["version"], r["write"]))


def _files(path: str, parts: list[dict]) -> list[File]:
    """The files of conditions of writes."""
    where, root = _open(path)
    out = []
    for r in parts:
        if r["rows"]:
            folder = fs.FileSelector(f"{root}/data/_write={r['write']}/_slot={r['slot']}")
            out += [File(f.path) for f in where.get_file_info(folder) if f.base_name.endswith(".parquet")]
    return out


def _slot(v) -> str:
    return hashlib.md5(str(v).encode()).hexdigest()


class _Scan:
    """Reads files in the columns of a schema."""

    def __init__(self, options: dict, schema: StructType):
        if not options.get("path"):
            raise ValueError("the option path must name a table of checkpoints")
        self.path, self.key, self.schema = options["path"], options.get("key", "key"), to_arrow_schema(schema)
        self.slots: set[str] | None = None
        self.filters: list[tuple] = []

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        where, _ = _open(self.path)
        cond = None
        for column, values in self.filters:
            one = ds.field(column).is_valid() if values is None else ds.field(column).isin(values)
            cond = one if cond is None else cond & one
        yield from ds.dataset(partition.path, schema=self.schema, format="parquet", filesystem=where).to_batches(filter=cond, batch_size=BATCH, batch_readahead=1, fragment_readahead=1)


class _Batch(_Scan, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column is None or not isinstance(f, EqualTo | In | IsNotNull):
                yield f
                continue
            values = None if isinstance(f, IsNotNull) else [f.value] if isinstance(f, EqualTo) else list(f.value)
            if values is not None and not all(isinstance(v, str | int | bool) for v in values):
                yield f
                continue
            self.filters.append((column, values))
            if column == self.key and values is not None:
                own = {_slot(v) for v in values if not isinstance(v, bool)}
                self.slots = own if self.slots is None else self.slots & own

    def partitions(self) -> list[File]:
        stand = {r["slot"]: r for r in _log(self.path)}
        return _files(self.path, [r for s, r in sorted(stand.items()) if self.slots is None or s in self.slots])


class _Stream(_Scan, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"writes": []}

    def latestOffset(self) -> dict:
        return {"writes": sorted({r["write"] for r in _log(self.path)})}

    def partitions(self, start: dict, end: dict) -> list[File]:
        new = set(end["writes"]) - set(start["writes"])
        return _files(self.path, [r for r in _log(self.path) if r["write"] in new])

    def commit(self, end: dict) -> None:
        pass


class StoredRecords(DataSource):
    """spark.read.format("stored_records").option("key", ...).load(path). Options: key, the column that names conditions; schema, as DDL."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return self.options.get("schema", ANSWERS)

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(self.options, schema)

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters go down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredRecords)
