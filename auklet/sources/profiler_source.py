"""Profiler databases as a data source of its own: tasks read ranges of a table's rows, and only the columns and rows that are asked for.

    spark.dataSource.register(ProfilerSource)
    spark.read.format("profiler").option("relation", "tasks").option("folder", "file:///profiles").load()

Databases in a folder that all machines see (a mounted file system) are read in place: SQLite fetches the pages of a range, so a
file of any size is shared by many tasks. Others (any store that Arrow knows) are copied by each task that reads them, as
SQLite needs a local file; they are one partition each. A lost task repeats its range. A schema with fewer columns, given to
`schema()`, is all that is read of a row. Simple comparisons of columns become part of SQLite's query where Spark offers them
(spark.sql.python.filterPushdown.enabled, which `auklet.session` sets); those of `rank` leave out whole files.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from auklet.sources.profiler_db import FILE, RELATIONS

#: Rows of a range.
ROWS = 1_000_000
#: Rows of a batch that a task hands on.
FETCH = 20_000
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


@dataclass
class Range(InputPartition):
    """Rows lo to hi (not included) of a rank's database by rowid; all of them without bounds."""

    rank: int
    path: str
    lo: int | None = None
    hi: int | None = None


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")


def _columns(relation: str) -> dict[str, str]:
    """Columns of a relation, and what each is called in its database."""
    _, query, kinds = RELATIONS[relation]
    names = query[len("select ") : query.index(" from ")].split(", ")
    return dict(zip((c.split()[0] for c in kinds.split(", ")), names, strict=True))


def _connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


class ProfilerReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.relation, self.folder, self.rows = options["relation"], options["folder"], int(options.get("rows", ROWS))
        self.table, self.names = RELATIONS[self.relation][0], _columns(self.relation)
        self.wanted = [f.name for f in schema.fields]
        self.arrow = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()]) for f in schema.fields])
        self.where: list[tuple[str, str, list]] = []

    def pushFilters(self, filters: list) -> Iterable:
        """Takes comparisons of the relation's columns and of rank; gives back the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            name = "rank" if column == "rank" else self.names.get(column)
            if name and type(f) in _COMPARED and isinstance(f.value, (int, str)):
                self.where.append((name, f"{_COMPARED[type(f)]} ?", [f.value]))
            elif name and isinstance(f, ds.In) and all(isinstance(v, (int, str)) for v in f.value):
                self.where.append((name, f"in ({', '.join('?' * len(f.value))})", list(f.value)))
            elif name and isinstance(f, (ds.IsNull, ds.IsNotNull)):
                self.where.append((name, "is null" if isinstance(f, ds.IsNull) else "is not null", []))
            else:
                yield f

    def _of_rank(self, rank: int) -> bool:
        """Whether the filters of rank let a file's rows through; SQLite itself compares."""
        con = sqlite3.connect(":memory:")
        with contextlib.closing(con):
            return all(con.execute(f"select ? {cond}", [rank, *values]).fetchone()[0] for name, cond, values in self.where if name == "rank")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((int(m[1]), f.path) for f in found if (m := FILE.search(f.path)) and f.is_file)
        out: list[InputPartition] = []
        for rank, path in files:
            if not self._of_rank(rank):
                continue
            if not isinstance(system, fs.LocalFileSystem):
                out.append(Range(rank, path))
                continue
            with contextlib.closing(_connected(path)) as con:
                if con.execute("select 1 from sqlite_master where type = 'table' and name = ?", [self.table]).fetchone():
                    first, last = con.execute(f"select min(rowid), max(rowid) from {self.table}").fetchone()
                    out += [Range(rank, path, lo, min(lo + self.rows, last + 1)) for lo in range(first, last + 1, self.rows)] if first is not None else []
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is nothing to read
            return
        with contextlib.ExitStack() as held:
            path = partition.path
            if partition.lo is None:
                system, _ = _filesystem(self.folder)
                path = os.path.join(held.enter_context(tempfile.TemporaryDirectory()), "rank.db")  # gone with the task; nobody else reads it
                with system.open_input_stream(partition.path) as source, open(path, "wb") as own:
                    while block := source.read(1 << 24):
                        own.write(block)
            con = held.enter_context(contextlib.closing(_connected(path)))
            if not con.execute("select 1 from sqlite_master where type = 'table' and name = ?", [self.table]).fetchone():
                return
            listed = [self.names[c] for c in self.wanted if c != "rank"] or ["1"]
            bounds = [] if partition.lo is None else [("rowid", ">= ?", [partition.lo]), ("rowid", "< ?", [partition.hi])]
            conditions = [x for x in [*bounds, *self.where] if x[0] != "rank"]
            query = f"select {', '.join(listed)} from {self.table}" + (" where " + " and ".join(f"{n} {c}" for n, c, _ in conditions) if conditions else "")
            got = con.execute(query, [v for _, _, values in conditions for v in values])
            while rows := got.fetchmany(FETCH):
                columns = iter(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([partition.rank] * len(rows) if f.name == "rank" else next(columns), f.type) for f in self.arrow], schema=self.arrow)


class ProfilerSource(DataSource):
    """Options: relation (one of profiler_db.RELATIONS), folder (all databases below it), rows (of a range)."""

    @classmethod
    def name(cls) -> str:
        return "profiler"

    def schema(self) -> str:
        return "rank int, " + RELATIONS[self.options["relation"]][2]

    def reader(self, schema: StructType) -> ProfilerReader:
        return ProfilerReader(dict(self.options), schema)
