"""Trimming by a list of characters, and captures in order without a compared lambda."""

from pyspark.sql import functions as F

from lensmill.functions import frames, mrz


def test_trimmed_takes_what_the_pattern_takes(spark):
    """The characters that the pattern (?U)\\s matches, at the ends alone."""
    own = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    own = own.withColumn("s", F.concat("c", "c", F.lit("a"), "c", F.lit("b\n"), "c"))
    wrong = own.where(mrz.trimmed(F.col("s")) != F.regexp_replace("s", "^(?U)\\s+|(?U)\\s+$", ""))
    assert wrong.count() == 0 and own.where(mrz.trimmed(F.col("s")).startswith("a")).count() == 26  # 25 of them, and the letter a itself


def test_parsers_run_no_pattern_or_lambda_where_none_is_needed(spark):
    lines = "array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>"
    given = [("b", 0.5, 0.4, 0.1, 0.1, 0.1), ("a", 0.7, 0.1, 0.1, 0.1, 0.1), ("c", 0.7, 0.1, 0.1, 0.1, 0.1), ("top", 0.9, 0.9, 0.0, 0.1, 0.1)]
    own = spark.createDataFrame([(given,)], f"lines {lines}").select(frames.in_reading_order(F.col("lines")).alias("o"))
    assert [x.text for x in own.first().o] == ["top", "a", "c", "b"]
    assert "array_sort" not in own._jdf.queryExecution().optimizedPlan().toString().lower()
    # A line grows when it is made upper case, and only then is it as long as a zone's.
    text = "ß" * 14 + "\n" + "x" * 27
    found = mrz.with_mrz(spark.createDataFrame([(text,), (None,), ("",)], "text string"), "text")
    assert [r.ok for r in found.collect()] == [False] * 3
