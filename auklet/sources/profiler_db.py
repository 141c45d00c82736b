"""Profiler databases, one SQLite file for each rank, as a Spark data source: a partition reads one table of one file."""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auklet.session import settled

# The databases' tables and how they become the profiler operators' relations
FILE = re.compile(r"ascend_pytorch_profiler_(\d+)\.db$")
RELATIONS = {
    "meta": ("META_DATA", "select name, value from META_DATA", "name string, value string"),
    "hosts": ("HOST_INFO", "select hostUid, rowid from HOST_INFO", "host string, rowid bigint"),
    "strings": ("STRING_IDS", "select id, value from STRING_IDS", "id bigint, value string"),
    "steps": ("STEP_TIME", "select startNs, endNs from STEP_TIME", "start bigint, stop bigint"),
    "comm": ("COMMUNICATION_OP", "select connectionId, groupName, startNs, endNs, count, rowid from COMMUNICATION_OP", "conn bigint, group_id bigint, start bigint, stop bigint, cnt bigint, rowid bigint"),
    "host": ("CANN_API", "select connectionId, startNs, endNs, rowid from CANN_API", "conn bigint, start bigint, stop bigint, rowid bigint"),
    "marks": ("MSTX_EVENTS", "select message, connectionId, startNs, endNs, rowid from MSTX_EVENTS", "message bigint, conn bigint, start bigint, stop bigint, rowid bigint"),
    "tasks": ("TASK", "select taskType, connectionId, startNs, endNs, rowid from TASK", "type_id bigint, conn bigint, start bigint, stop bigint, rowid bigint"),
}


def rows_of(path: str, table: str, query: str, fetch: int = 10_000) -> Iterator[tuple]:
    """Rows of a query, fetched in runs; none if the file has no such table."""
    con = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    try:
        if con.execute("select 1 from sqlite_master where type = 'table' and name = ?", [table]).fetchone():
            got = con.execute(query)
            while run := got.fetchmany(fetch):
                yield from run
    finally:
        con.close()


def read_profiles(spark: SparkSession, folder: str, relation: str) -> DataFrame:
    """(rank, columns of the relation) of all databases below a folder that Spark can read, the rank from the file's name.

    Spark ships each file's bytes to the task that reads it, which needs a local copy for SQLite and deletes it at once; files
    are spread over tasks one by one, and a lost task only repeats its file.
    """
    return _read(spark, folder, [relation])[relation]


def read_all(spark: SparkSession, folder: str, relations: list[str] | None = None) -> dict[str, DataFrame]:
    """Several relations (all by default) in one pass over the files: each is copied once, and its rows are kept for all readers."""
    return _read(spark, folder, relations or list(RELATIONS))


def _read(spark: SparkSession, folder: str, relations: list[str]) -> dict[str, DataFrame]:
    kinds = {c.split()[0]: c.split()[1] for r in relations for c in RELATIONS[r][2].split(", ")}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "ascend_pytorch_profiler_*.db").load(folder).select("path", "content")

    def read(batches):
        import pandas as pd

        def frame(rank: str, relation: str, run: list[tuple]) -> pd.DataFrame:
            own = pd.DataFrame(run, columns=[c.split()[0] for c in RELATIONS[relation][2].split(", ")], dtype=object)
            return own.reindex(columns=list(kinds)).astype(object).where(lambda x: x.notna(), None).assign(rank=int(rank), relation=relation)[["rank", "relation", *kinds]]

        for f in batches:
            for path, content in zip(f["path"], f["content"], strict=True):
                found = FILE.search(path)
                if not found:
                    continue
                with tempfile.TemporaryDirectory() as own:
                    at = os.path.join(own, "rank.db")
                    with open(at, "wb") as out:
                        out.write(content)
                    for relation in relations:
                        run = []
                        for row in rows_of(at, *RELATIONS[relation][:2]):
                            run.append(row)
                            if len(run) == 50_000:
                                yield frame(found[1], relation, run)
                                run = []
                        if run:
                            yield frame(found[1], relation, run)

    wide = files.mapInPandas(read, "rank int, relation string, " + ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    wide = settled(wide) if len(relations) > 1 else wide
    return {r: wide.where(F.col("relation") == r).select("rank", *[c.split()[0] for c in RELATIONS[r][2].split(", ")]) for r in relations}
