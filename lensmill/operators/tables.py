"""The session folds as table functions, and the parsers as views, for callers that write SQL.

    tables.register(spark)
    SELECT * FROM gated_frames(TABLE(judged) PARTITION BY session_id ORDER BY (timestamp_ms, event_id), window_ms => 1000)

The table needs session_id, event_id and timestamp_ms; the gate is_valid too, and kind if it holds control events. Spark
deals the sessions out, each in one task, and hands them over in the order asked for; a fold keeps one session's state.
Rows without a time are left out; a null is_valid is false; extra columns are ignored; an empty table gives no rows.

    tables.parsed_views(spark, "captures")
    SELECT nationality, count(*) FROM parsed_cards WHERE ok GROUP BY nationality

The views are column expressions over the named table, so filters and unused fields are pruned through them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from lensmill.functions import documents, mrz
from lensmill.streaming.capture import step


@udtf(returnType="session_id bigint, event_id bigint, timestamp_ms bigint", useArrow=False)
class ThrottledFrames:
    """The frames that are forwarded: each at least interval_ms after the one before."""

    def __init__(self):
        self.last = 0

    def eval(self, frames: Row, interval_ms: int = 66) -> Iterator[tuple]:
        t = frames["timestamp_ms"]
        if t is not None and t - self.last >= interval_ms:
            self.last = t
            yield frames["session_id"], frames["event_id"], t


@udtf(returnType="session_id bigint, event_id bigint, timestamp_ms bigint, stage string, stability_progress double", useArrow=False)
class GatedFrames:
    """Stage and progress after each forwarded frame and control event; frames beside a capture keep its stage, progress 1."""

    def __init__(self):
        self.state = {"last_forwarded": 0, "stage": "idle", "since": None, "latch": False}

    def eval(self, frames: Row, window_ms: int = 1000, interval_ms: int = 66) -> Iterator[tuple]:
        t = frames["timestamp_ms"]
        kind = frames["kind"] if "kind" in frames else None
        if t is None or (kind is None and t - self.state["last_forwarded"] < interval_ms):
            return
        progress = step(self.state, kind, bool(frames["is_valid"]), t, window_ms, interval_ms)
        if progress is None:
            progress = 0.0 if self.state["stage"] in ("idle", "failed") else 1.0
        yield frames["session_id"], frames["event_id"], t, self.state["stage"], progress


def parsed_views(spark: SparkSession, captures: str, as_of_year: int = 2026) -> None:
    """Views over a table or view of captures (capture_id, document_type, text, lines, confidence), kept under its own columns:
    extracted_documents, one row a capture by its type; parsed_zones, parsed_licences and parsed_cards, each parser over all."""
    own = spark.table(captures)
    found = {
        "extracted_documents": documents.extract(own, as_of_year),
        "parsed_zones": mrz.with_mrz(own, "text", as_of_year),
        "parsed_licences": documents.with_licence(own, as_of_year=as_of_year),
        "parsed_cards": documents.with_id_card(own, as_of_year=as_of_year),
    }
    for name, df in found.items():
        df.createOrReplaceTempView(name)


def register(spark: SparkSession) -> None:
    """throttled_frames and gated_frames in the session's SQL."""
    spark.udtf.register("throttled_frames", ThrottledFrames)
    spark.udtf.register("gated_frames", GatedFrames)
