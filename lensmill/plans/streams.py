"""Queries of streams that arrive out of order, of the capture loop, of the store of latest values, and of one long session."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.operators import registry, sequences, vision
from lensmill.plans import queries as plans
from lensmill.plans.fixtures import projected
from lensmill.plans.queries import r6
from lensmill.sources.stored import shared_folder, stored
from lensmill.streaming import ordered, store

#: Frames are delivered by their time in parts of so many milliseconds; the watermark trails by DELAY.
BEGIN, PART, DELAY = 1_000_000, 1500, 1000
#: The loop's gate, how long after it fires the photo is there, and how long reading takes.
WINDOW, SHUTTER, READING = 400, 120, 180


def delivered(late: bool):
    """The delivery of each frame: that of its time, but some come one earlier or later, and, if late, some far too late."""
    at = F.col("timestamp_ms") - BEGIN
    part = F.floor(at / PART)
    out = F.when((part >= 1) & (at % PART < 300) & (F.col("event_id") % 7 == 0), part - 1).when((at % PART >= 1200) & (F.col("event_id") % 5 == 0), part + 1).otherwise(part)
    return F.when((part == 0) & (F.col("event_id") % 23 == 0), 2).otherwise(out) if late else out


def _parts(spark, sf_dir, late: bool) -> tuple[DataFrame, int, int]:
    """Frames by delivery, the last delivery, and how many groups of sessions there are."""
    own = plans.judged(spark, sf_dir)
    own = stored(ordered.frame_events(own).withColumn("delivery", delivered(late)), "deliveries", "delivery")
    last, sessions = own.agg(F.max("delivery"), F.approx_count_distinct("session_id")).first()
    return own, last or 0, ordered.groups_for(sessions, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stream_out_of_order(spark, sf_dir):
    """Frames in shuffled files over several deliveries, some too late: the stages that they give in order, and the late ones."""
    own, last, groups = _parts(spark, sf_dir, True)
    folder = f"{shared_folder(spark)}/lensmill/out-of-order-{uuid.uuid4().hex}"
    session = ordered.stateful_session(spark)
    for k in range(last + 1):
        part = own.where(F.col("delivery") == k).drop("delivery").orderBy(F.xxhash64("event_id"))
        # The source's last word, after which nothing is waited for.
        (part.unionByName(ordered.heartbeat(spark, BEGIN * 1000)) if k == last else part).write.mode("append").parquet(f"{folder}/in")
        stages = ordered.ordered_stages(ordered.folder_stream(session, f"{folder}/in"), DELAY, groups=groups)
        stages.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(ordered.OUTPUT).parquet(f"{folder}/out")
    return found.select("session_id", "timestamp_ms", "stage", r6(F.col("stability_progress")).alias("stability_progress"))


def capture_loop(spark, sf_dir):
    """The gate fires, the capture's answers come back through a second source; failures latch and are tried again.

    Every row of stage processing has the time and a corner of the last forwarded frame's quad.
    """
    own, last, groups = _parts(spark, sf_dir, False)
    folder = f"{shared_folder(spark)}/lensmill/loop-{uuid.uuid4().hex}"
    session = ordered.stateful_session(spark)
    ordered.control_events(spark.createDataFrame([], "session_id bigint, timestamp_ms bigint, kind string")).write.parquet(f"{folder}/controls/none")
    shot = F.floor((F.col("timestamp_ms") - SHUTTER) / 50)
    extract = lambda begun: begun.withColumn("success", (F.col("session_id") + shot) % 3 != 0)
    sink = ordered.loop_sink(extract, f"{folder}/stages", f"{folder}/controls", SHUTTER, READING)
    asked = []

    def answered(batch: DataFrame, batch_id: int) -> None:
        asked.append(sink(batch, batch_id))

    def run() -> None:
        stages = ordered.ordered_stages(ordered.folder_stream(session, f"{folder}/in", f"{folder}/controls"), DELAY, WINDOW, holds=True, groups=groups)
        stages.writeStream.foreachBatch(answered).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    for k in range(last + 1):
        part = own.where(F.col("delivery") == k).drop("delivery")
        (part.unionByName(ordered.heartbeat(spark, BEGIN * 1000)) if k == last else part).write.mode("append").parquet(f"{folder}/in")
        asked.clear()
        run()
    # The last run's answers, if there are any, are still to be read.
    while any(asked):
        asked.clear()
        run()
    found = spark.read.schema(ordered.OUTPUT).option("recursiveFileLookup", "true").parquet(f"{folder}/stages")
    return found.select(
        "session_id", "timestamp_ms", "stage", r6(F.col("stability_progress")).alias("stability_progress"), F.coalesce("frame_ms", F.lit(-1)).alias("frame_ms"), F.coalesce(F.get("quad", F.lit(0)), F.lit(-1.0)).alias("tl_x"),
    )


def store_events(spark, sf_dir):
    """Guidance of every frame; results, errors, stages and resets of some, a little later."""
    f = plans.judged(spark, sf_dir).select("session_id", "timestamp_ms", "event_id", "code")
    e = F.col("event_id")
    event = lambda kind, after, value: F.struct((F.col("timestamp_ms") + after).alias("timestamp_ms"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    some = lambda when, own: F.when(when, own)
    all_of = F.array(
        event("guidance", 0, F.col("code")), some(e % 3 == 0, event("stage", 0, F.when(e % 2 == 0, "stabilizing").otherwise("idle"))), some(e % 5 == 0, event("result", 10, F.concat(F.lit("r"), e))),
        some(e % 7 == 0, event("error", 20, F.concat(F.lit("e"), e))), some(e % 41 == 0, event("reset", 30, F.lit(None))),
    )
    return f.select("session_id", "event_id", F.explode(F.array_compact(all_of)).alias("x")).select("session_id", "x.timestamp_ms", "event_id", "x.kind", "x.value")


def _shown(values: DataFrame) -> DataFrame:
    return values.select("session_id", "timestamp_ms", *[F.coalesce(f, F.lit("")).alias(f) for f in store.FIELDS])


def store_latest(spark, sf_dir):
    return _shown(store.latest_values(store_events(spark, sf_dir)))


def stream_store(spark, sf_dir):
    """The same as a stream in update mode, in two deliveries that are not in order of time."""
    own = stored(store_events(spark, sf_dir), "store-events")
    folder = f"{shared_folder(spark)}/lensmill/store-{uuid.uuid4().hex}"
    session = ordered.stateful_session(spark)
    for k in range(2):
        own.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{folder}/in")
        values = store.stored_values(session.readStream.schema(store.EVENT).parquet(f"{folder}/in"))

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/{batch_id}")

        values.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(f"{store.OUTPUT}, batch_id int").option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    last = found.groupBy("session_id").agg(F.max_by(F.struct(*store.FIELDS, "timestamp_ms"), "batch_id").alias("s"))
    return _shown(last.select("session_id", "s.*"))


#: All events as one session; two share each time.
ONE_SESSION_SQL = "SELECT CAST(1 AS BIGINT) AS session_id, event_id, CAST(1000000 + 20 * (event_id - event_id % 2) AS BIGINT) AS timestamp_ms FROM events"


def throttle_one_session(spark, sf_dir):
    """One session over all events, throttled in even blocks."""
    return sequences.throttle_in_blocks(projected(spark, sf_dir, ONE_SESSION_SQL))


def motion_one_session(spark, sf_dir):
    """Motion of one session over all events; each block is lent the thumbnail before it."""
    own = vision.thumbnails(plans.images(spark, sf_dir), carry=("event_id", "timestamp_ms")).withColumn("session_id", F.lit(1).cast("long"))
    return sequences.motion_in_blocks(own).select("session_id", "event_id", r6(F.col("motion_score")).alias("motion_score"))


ACTIVATIONS_SQL = """
SELECT app_id, seq, nth, CAST((nth - 1 - (nth - 1) % 2) * 500 + CASE WHEN (nth - 1) % 2 = 0 THEN 0 WHEN seq % 3 = 0 THEN 600 ELSE 100 END AS BIGINT) AS started_ms, CAST(400 AS BIGINT) AS load_ms, seq % 5 <> 0 AS succeeds,
  CONCAT('m', CAST(CASE WHEN seq % 4 < 2 THEN (nth - 1 - (nth - 1) % 2) % 6 ELSE (seq * 7) % 60 END AS VARCHAR(4))) AS model_id
FROM (SELECT o_custkey % 100 AS app_id, o_orderkey AS seq, ROW_NUMBER() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS nth FROM orders) numbered_log"""


def registry_loads(spark, sf_dir):
    """Activations of which every second may start while the one before it is loading."""
    return registry.loads(projected(spark, sf_dir, ACTIVATIONS_SQL), registry.latest_models(plans.registrations(spark, sf_dir)))


def registry_loaded(spark, sf_dir):
    """The model that each app has loaded at last, the one that it would activate, and whether that is loaded."""
    own = registry.loaded_models(registry_loads(spark, sf_dir)).withColumn("active_id", F.coalesce("loaded_id", F.lit(registry.DEFAULT_MODEL["id"])))
    return own.select("app_id", F.coalesce("loaded_id", F.lit("")).alias("loaded_id"), "active_id", registry.is_loaded(F.col("active_id"), F.col("loaded_id")).alias("is_loaded"))


QUERIES = (stream_out_of_order, capture_loop, store_latest, stream_store, throttle_one_session, motion_one_session, registry_loads, registry_loaded)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


