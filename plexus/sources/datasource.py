"""A Spark DataSource for NDJSON documents: ``spark.read.format("plexus-ndjson").option("table", "columns").load(path)``.

A table of the document (see TABLES) is read by splits of ``splitBytes`` (64 MB if not given), each by one task: a split has the lines that begin in
it. A record without a schema of its own belongs to the last schema record before it; where that lies before the split, the task looks for it
backwards from the split's start. Paths are what pyarrow's file systems open: local or shared folders, hdfs, s3 and so on; several files of
a folder are read in the order of their names, each with schema records of its own.

A DataSource gives rows and no document: the header and the trailer are checked by ``document.read_ndjson``, not here. Lines that are not JSON,
and records of other tables, give no rows.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "plexus-ndjson"
#: The tables and their columns, as in ``document.TABLES``; ``records`` has every record as it is.
TABLES = {
    "schemas": "schema string",
    "objects": "schema string, name string, kind string, body string, n_columns int",
    "columns": "schema string, object string, name string, data_type string, nullable boolean, default string, ordinal int, pk_position int",
    "constraints": "schema string, object string, name string, kind string, columns array<string>, ref_schema string, ref_table string, ref_columns array<string>",
    "indexes": "schema string, object string, name string, unique boolean, columns array<string>, definition_complete boolean, predicate string, has_predicate boolean",
    "triggers": "schema string, object string, name string, body string",
    "routines": "schema string, name string, kind string, language string, body string, signature string, member_of string, source string",
    "records": "schema string, type string, value string",
}
_PARTS = {"columns": "columns", "constraints": "constraints", "indexes": "indexes", "triggers": "triggers"}


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def _open(path: str) -> tuple:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def _to_line_end(file, at: int) -> bytes:
    """What lies from ``at`` to the end of its line, with the line end."""
    file.seek(at)
    out = b""
    while more := file.read(1 << 16):
        cut = more.find(b"\n")
        if cut >= 0:
            return out + more[: cut + 1]
        out += more
    return out


def lines(file, start: int, end: int) -> list[bytes]:
    """The lines that begin at ``start`` or later and before ``end``."""
    begin = max(0, start - 1)
    file.seek(begin)
    data = file.read(end - begin)
    if not data.endswith(b"\n"):
        data += _to_line_end(file, end)
    if start:  # the line that began before, or its end alone
        data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
    return data.split(b"\n")


def schema_before(file, start: int) -> str | None:
    """The name of the last schema record that begins before ``start``, read backwards block by block."""
    file.seek(start - 1)
    tail = b"" if file.read(1) == b"\n" else _to_line_end(file, start)
    at = start
    while at > 0:
        step = min(1 << 20, at)
        at -= step
        file.seek(at)
        first, *whole = (file.read(step) + tail).split(b"\n")
        for line in reversed([first, *whole] if at == 0 else whole):
            record = parsed(line) if b'"schema"' in line else None
            if record and record.get("type") == "schema":
                return record.get("name")
        tail = first + b"\n"
    return None


def parsed(line: bytes) -> dict | None:
    try:
        value = json.loads(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def rows_of(table: str, schema: str | None, record: dict) -> Iterator[tuple]:
    kind, data = record.get("type"), record.get("data") or {}
    if table == "records":
        yield schema, kind, json.dumps(record, ensure_ascii=False, sort_keys=True)
    elif table == "schemas" and kind == "schema":
        yield (record.get("name"),)
    elif table == "routines" and kind == "routine":
        yield (schema, *(data.get(c) for c in ("name", "kind", "language", "body", "signature", "member_of", "source")))
    elif kind == "object" and table == "objects":
        yield schema, data.get("name"), data.get("kind"), data.get("body"), len(data.get("columns") or [])
    elif kind == "object" and table in _PARTS:
        for x in data.get(_PARTS[table]) or []:
            if table == "columns":
                own = tuple(x.get(c) for c in ("name", "data_type", "nullable", "default", "ordinal", "pk_position"))
            elif table == "constraints":
                far = x.get("referenced") or {}
                own = (x.get("name"), x.get("kind"), x.get("columns"), far.get("schema"), far.get("table"), far.get("columns"))
            elif table == "indexes":
                own = tuple(x.get(c) for c in ("name", "unique", "columns", "definition_complete", "predicate", "has_predicate"))
            else:
                own = (x.get("name"), x.get("body"))
            yield (schema, data.get("name"), *own)


class NdjsonReader(DataSourceReader):
    def __init__(self, table: str, path: str, split: int) -> None:
        self.table, self.path, self.split = table, path, split

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        system, inner = _open(self.path)
        found = system.get_file_info(inner)
        if found.type == fs.FileType.Directory:
            files = sorted((f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        elif found.type == fs.FileType.File:
            files = [found]
        else:
            raise FileNotFoundError(self.path)
        return [Split(f.path, a, min(a + self.split, f.size)) for f in files for a in range(0, f.size, self.split)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as file:
            schema, looked = None, partition.start == 0
            for line in lines(file, partition.start, partition.end):
                record = parsed(line)
                if record is None:
                    continue
                if record.get("type") == "schema":
                    schema, looked = record.get("name"), True
                own = record.get("schema") or schema
                if own is None and not looked and record.get("type") in ("object", "routine"):
                    schema, looked = schema_before(file, partition.start), True
                    own = schema
                yield from rows_of(self.table, own, record)


class NdjsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "objects")
        if table not in TABLES:
            raise ValueError(f"no such table: {table}; there are {', '.join(TABLES)}")
        return table

    def schema(self) -> StructType:
        return TABLES[self._table()]

    def reader(self, schema: StructType) -> NdjsonReader:
        return NdjsonReader(self._table(), self.options["path"], int(self.options.get("splitbytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session. The classes travel with it, so workers need no installation."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(NdjsonSource)
