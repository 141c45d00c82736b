"""Pushing events to subscribers: one POST for each row, with retries, from the tasks that hold the rows."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.session import settled


def with_event_ids(events: DataFrame, keys: list[str]) -> DataFrame:
    """Adds event_id, a hash of the event's own keys: a repeated delivery carries the same id."""
    return events.withColumn("event_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256).substr(1, 32))


def post(endpoint: str, body: str, timeout_s: float) -> bool:
    request = urllib.request.Request(endpoint, body.encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as got:  # noqa: S310
            return 200 <= got.status < 300
    except OSError:
        return False


def attempts(endpoint: str, body: str, retries: int, backoff_s: float, timeout_s: float, send: Callable[[str, str, float], bool]) -> tuple[int, bool]:
    """How often a body was sent, and whether it was taken; the k-th retry waits k * backoff_s."""
    tries, ok = 0, False
    while not ok and tries <= retries:
        time.sleep(backoff_s * tries)
        tries, ok = tries + 1, send(endpoint, body, timeout_s)
    return tries, ok


def pushed(pairs: DataFrame, retries: int = 3, backoff_s: float = 0.5, timeout_s: float = 30.0, send: Callable[[str, str, float], bool] = post) -> DataFrame:
    """(event_id, endpoint, attempts, delivered) of event rows with an endpoint; all other columns but it are the body.

    Rows are sent when the result is computed, so compute it once: `delivered` does that. The k-th retry waits k * backoff_s. Delivery is at least once: a lost task sends its rows again, under the same event_id.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = []
            for event, endpoint, body in f.itertuples(index=False, name=None):
                done.append((event, endpoint, *attempts(endpoint, body, retries, backoff_s, timeout_s, send)))
            yield pd.DataFrame(done, columns=["event_id", "endpoint", "attempts", "delivered"])

    body = F.to_json(F.struct(*[F.col(c) for c in pairs.columns if c != "endpoint"]))
    return pairs.select("event_id", "endpoint", body.alias("body")).mapInPandas(run, "event_id string, endpoint string, attempts int, delivered boolean")


def delivered(pairs: DataFrame, **how) -> DataFrame:
    """Sends now, and gives pushed()'s rows, which can be read any number of times without sending again."""
    out = settled(pushed(pairs, **how))
    out.count()  # where it is kept and not written, this is what sends
    return out
