"""Events as a streaming sink: `writeStream.format("event_push")` sends each event once, also when a micro-batch is repeated.

A task marks every event that was taken in a folder that all machines see, by the event's id, before it goes on. A
micro-batch that failed half-way is run again by Spark: its tasks skip what is marked and send the rest. Once all tasks have ended, commit()
removes the marks, as the micro-batch won't come again. An event that was taken but not marked (the task was lost between the two) is
sent again under the same id.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from auklet.sinks.push import attempts, post


@dataclass
class Sent(WriterCommitMessage):
    """What a task has marked, and how many events it sent and skipped."""

    marks: list[str]
    sent: int
    skipped: int


class PushWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["marks"].rstrip("/")
        self.retries, self.backoff_s, self.timeout_s = int(options.get("retries", 3)), float(options.get("backoff_s", 0.5)), float(options.get("timeout_s", 30.0))

    def _system(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(f"{root}/sent", recursive=True)
        return system, root

    def write(self, iterator: Iterator[Row]) -> Sent:
        from pyarrow import fs

        system, root = self._system()
        out = Sent([], 0, 0)
        for row in iterator:
            event = row.asDict(recursive=True)
            endpoint = event.pop("endpoint")
            mark = f"{root}/sent/{hashlib.sha256(f'{endpoint} {event["event_id"]}'.encode()).hexdigest()}"
            if system.get_file_info(mark).type == fs.FileType.File:
                out.skipped += 1
            else:
                tries, ok = attempts(endpoint, json.dumps(event, default=str), self.retries, self.backoff_s, self.timeout_s, post)
                if not ok:
                    raise OSError(f"{endpoint} didn't take event {event['event_id']} in {tries} attempts")
                with system.open_output_stream(mark):
                    pass
                out.sent += 1
            out.marks.append(mark)
        return out

    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        """Tells what became of the micro-batch, and then forgets its marks."""
        system, root = self._system()
        done = [m for m in messages if m]
        system.create_dir(f"{root}/committed", recursive=True)
        with system.open_output_stream(f"{root}/committed/{batchId:012d}.json") as out:
            out.write(json.dumps({"batch": batchId, "sent": sum(m.sent for m in done), "skipped": sum(m.skipped for m in done)}).encode())
        for mark in (x for m in done for x in m.marks):
            system.delete_file(mark)

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        """Marks stay: the micro-batch comes again."""


class EventPush(DataSource):
    """Rows have event_id and endpoint; all other columns but endpoint are the body. Options: marks (a folder), retries, backoff_s, timeout_s.

    An event that isn't taken in 1 + retries attempts ends the query, which goes on with it when it is started again.
    """

    @classmethod
    def name(cls) -> str:
        return "event_push"

    def schema(self) -> str:
        return "event_id string, endpoint string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> PushWriter:
        return PushWriter(dict(self.options))
