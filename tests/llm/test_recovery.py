"""What lost executors, repeated ids and repeated labels must not change."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lensmill.llm import common, mixing, toxicity


@pytest.fixture
def stored(spark, tmp_path):
    """Near copies in groups of three, in one file of several row groups."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.col("g") * 97 + i * i).cast("string"))), " ")
    own = spark.range(3000).select((F.col("id") % 1000).alias("g"), F.col("id").alias("doc_id")).select(
        F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")).alias("doc_id"), F.concat(words, F.lit(" end "), F.floor(F.col("doc_id") / 1000).cast("string")).alias("text"), F.lit("en").alias("lang"),
        F.concat(F.lit("s"), F.col("g") % 3).alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    own.coalesce(1).write.option("parquet.block.size", 65536).parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


@pytest.mark.parametrize("stage", [corpus_pipeline.simhash_stage, corpus_pipeline.mixing_stage])
def test_other_splits_between_the_scans(spark, stored, stage):
    """The rows that a stage chose are the rows that it returns, however the files are cut by then."""
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        own = stage(spark, stored, "")
        want = sorted(map(tuple, own.collect()), key=repr)
        # A fresh plan over the same stored tables, as a retry would make it.
        spark.conf.set(setting, "20000")
        spark.catalog.clearCache()
        again = stage(spark, stored, "")
        spark.conf.set(setting, "50000")
        assert sorted(map(tuple, again.collect()), key=repr) == want
    finally:
        spark.conf.set(setting, before)
    if stage is corpus_pipeline.simhash_stage:
        assert len(want) == 1000 and len({w[1].rsplit(" ", 1)[0] for w in want}) == 1000


def test_tables_are_released(spark, stored):
    since = common.written()
    mixing.apply(stored).count()
    assert common.written() == since + 2
    common.release(spark, since)
    assert common.written() == since


def test_repeated_ids_and_labels_teach_once(spark):
    docs = spark.range(5000).select(F.when(F.col("id") < 1000, F.col("id")).otherwise(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(3000).select(F.when(F.col("id") < 1000, F.col("id")).otherwise(8).alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    taught = toxicity.sample(docs, labels).collect()
    out = {r.doc_id for r in spark.range(1000).select(F.col("id").alias("doc_id")).where(common.held_out()).collect()}
    assert len({r.pick for r in taught}) == 1000 - len(out)
    # The id 8 has either label.
    assert len(taught) == 1000 - len(out) + (8 not in out)


def test_marginals_by_enumeration():
    """Forward-backward against the sum over all label paths, for texts of 8 tokens and less, one after another."""
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(2, 2))
    lengths = [8, 1, 5, 8, 2] + [8] * 12
    scores = rng.normal(scale=2, size=sum(lengths))
    starts = np.zeros(len(scores), bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    p, pairs = toxicity.marginals(scores, starts, trans)
    want, joint, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        own = scores[at : at + n]
        paths = np.array(list(product((0, 1), repeat=n)))
        weight = np.exp(paths @ own + sum(trans[paths[:, i], paths[:, i + 1]] for i in range(n - 1)))
        weight /= weight.sum()
        want += list(weight @ paths)
        for i in range(n - 1):
            for a, b in product((0, 1), repeat=2):
                joint[a, b] += weight[(paths[:, i] == a) & (paths[:, i + 1] == b)].sum()
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, joint)
