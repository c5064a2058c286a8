"""Helpers shared by the corpus operators: the shared folder, Arrow batches, prefix sums."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[str, DataFrame]] = []

#: Rows and bytes of a batch that Python works on at a time; Spark's own batches hold up to 64 MB.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN_DIR.setdefault("dir", tempfile.mkdtemp(prefix="lensmill-"))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut and a lost executor costs nothing.

    The write's own shuffle files go as soon as it has ended, and not when the driver's memory happens to be collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lensmill/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.append((path, out))
    return out


def numbered(df: DataFrame, tag: str) -> DataFrame:
    """df stored with row_at, a number of its own for each row. It is written once and read by all later scans, which cut
    the files differently when executors come or go."""
    return materialise(df.withColumn("row_at", F.monotonically_increasing_id()), tag)


def written() -> int:
    """How many tables materialise() has written and release() has left."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: Sequence[DataFrame] = ()) -> None:
    """Deletes what materialise() wrote since written() was ``since``, but for the tables in keep, once nothing else needs it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    own, _WRITTEN[since:] = _WRITTEN[since:], []
    for path, df in own:
        if any(df is k for k in keep):
            _WRITTEN.append((path, df))
        else:
            place = hadoop(path)
            place.getFileSystem(conf).delete(place, True)


def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to ARROW_ROWS rows and, by their mean, ARROW_BYTES, for operators that hold whole texts in Python."""
    for batch in batches:
        step = max(1, min(ARROW_ROWS, ARROW_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The values of some columns row by row, without a Python list of the whole batch."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def to_batch(schema: pa.Schema, columns: Iterable[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str], tag: str, ranges: int | None = None) -> DataFrame:
    """df with ``nth`` (0 for the first row in order) and, for sums {new: column}, the sum of the column over the rows before.

    Rows are range-partitioned by the order (by default into as many ranges as shuffle partitions) and written out; only
    the ranges' totals, one row each, are summed in one task. Rows that tie in the order lie in one range, so the order
    should be fine enough.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, tag)
    totals = ranged.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("n_in"), *[F.sum(c).alias(f"in_{new}") for new, c in sums.items()])
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("p", F.coalesce(F.sum("n_in").over(before), F.lit(0)).alias("n_before"), *[F.coalesce(F.sum(f"in_{new}").over(before), F.lit(0)).alias(f"before_{new}") for new in sums])
    within = Window.partitionBy("part").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({"nth": F.row_number().over(within) - 1, **{new: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for new, c in sums.items()}})
    out = out.join(F.broadcast(ahead), F.col("part") == F.col("p"))
    placed = {"nth": (F.col("nth") + F.col("n_before")).cast("long"), **{new: F.col(new) + F.col(f"before_{new}") for new in sums}}
    return out.withColumns(placed).drop("part", "p", "n_before", *[f"before_{new}" for new in sums])


def stretch(text: str, pick: str, most: int):
    """A column: the text, or ``most`` code points of it from a hashed place, for fits of a bounded sample alone."""
    spare = F.length(text) - most
    return F.when(spare <= 0, F.col(text)).otherwise(F.substring(text, 1 + F.pmod(F.col(pick), spare + 1).cast("int"), F.lit(most)))


def trained(rows: DataFrame, train: Callable[[list[tuple]], object]) -> object:
    """What train(list of rows) returns, run in one task over rows of a proven bound, so the driver holds the result only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(rows_of(batch, *batch.schema.names))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(held))], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else train([])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def held_out(name: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 0 by 5; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
