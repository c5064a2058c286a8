"""What a step leaves on disk once its table is written."""

import os
import time
import uuid

from pyspark.sql import functions as F

from lensmill.llm import common, suffixes


def shuffle_files(spark):
    """Files of shuffles in the block manager's folders."""
    tops = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    return {f"{at}/{f}" for top in tops for at, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("s"), (F.col("id") % 97).alias("k"))
    out = common.materialise(rows.repartition(4, "k").sortWithinPartitions("k"), f"disk-{uuid.uuid4().hex}")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 20_000


def test_suffix_tables_go_once_the_runs_are_stored(spark):
    since = common.written()
    docs = [(i, f"{i} " + "the same passage of over a hundred bytes that every one of the documents has in it, word for word and more " * 2) for i in range(20)]
    out = suffixes.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string"))
    kept = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path, _ in common._WRITTEN[since:]]
    assert sorted(kept) == ["suffix-rows", "suffix-runs"]
    assert out.where("n_removed > 0").count() == 20
