"""The store of a session's latest values: guidance, stage, result and error, each kept by the time of what set it.

An event sets fields at its time; of two that set the same field the later one holds (equal times by event_id). A result
clears the error, a reset sets every field to nothing. So the store does not depend on the order in which events arrive, and
is one aggregate a field, combined before the shuffle, in batch as in a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("guidance", "stage", "result", "error")
EVENT = "session_id bigint, timestamp_ms bigint, event_id bigint, kind string, value string"
OUTPUT = "session_id bigint, " + ", ".join(f"{f} string" for f in FIELDS) + ", timestamp_ms bigint"
#: What each kind of event sets: to its value, or to nothing.
SETS = {"guidance": ("guidance",), "stage": ("stage",), "result": ("result",), "error": ("error",), "reset": ()}
CLEARS = {"result": ("error",), "reset": FIELDS}


def latest_values(events: DataFrame) -> DataFrame:
    """The store of each session over a batch of EVENT rows."""
    version = F.struct("timestamp_ms", "event_id")
    columns = []
    for f in FIELDS:
        sets = [k for k, own in SETS.items() if f in own]
        clears = [k for k, own in CLEARS.items() if f in own]
        touched = F.col("kind").isin(*sets, *clears)
        columns.append(F.max(F.when(touched, F.struct(version.alias("at"), F.when(F.col("kind").isin(*sets), F.col("value")).alias("value")))).alias(f))
    newest = F.max(F.when(F.col("kind").isin(*SETS), F.col("timestamp_ms"))).alias("timestamp_ms")
    out = events.groupBy("session_id").agg(*columns, newest)
    return out.select("session_id", *[F.col(f"{f}.value").alias(f) for f in FIELDS], "timestamp_ms")


def stored_values(events: DataFrame) -> DataFrame:
    """The store as a stream of EVENT rows in update mode: the last row of a session is its store.

    The batch twin's aggregate: a batch's events are combined before the shuffle, the state is one row a session.
    """
    return latest_values(events)
