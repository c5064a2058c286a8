"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

toxicity: documents that the model rejects (score >= 0.5) go. simhash: of each group of near copies the row of
least id stays. secrets: live-looking secrets are replaced by a mark. mixing: each source is brought to its target;
a document stands in the table as often as the mix takes it, each copy at its training position. bpe: ids of each text, decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.llm import bpe, mixing, secrets, simhash, toxicity
from lensmill.llm.common import materialise, numbered, read, release, written
from lensmill.llm.queries import tokenizer_paths

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the model, fitted on the labels of what it is given, does not call toxic."""
    model = toxicity.fit(toxicity.sample(docs, read(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (likeness 0.8 on five words): that of least id, null last, then of least number."""
    since = written()
    own = numbered(docs.select(*COLUMNS), "simhash-docs")
    kept = materialise(simhash.near_duplicates(own, row_col="row_at").where("stays").select(F.col("row_at").alias("kept_at")), "kept-rows")
    release(spark, since, (own, kept))
    return own.join(kept.hint("merge"), F.col("row_at") == F.col("kept_at"), "left_semi").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking secrets; n_chars follows the text."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times), range-sorted by the training position of each copy."""
    return mixing.apply(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.digests(docs, *tokenizer_paths())


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SimHash components and the fitted classifier are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = read(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
