"""Sinks: what failed and repeated tasks leave, and settings as one file."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lensmill.sources import media

IMAGE = b"P5\n1 1\n255\nx"


def files(folder):
    return sorted(f"{d}/{f}" for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def images(spark, n):
    return spark.range(n).repartition(4).select(F.col("id").alias("image_id"), F.lit(IMAGE).alias("content"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    where = str(tmp_path / "images")
    broken = images(spark, 40).withColumn("content", F.when(F.col("image_id") == 17, F.raise_error(F.lit("broken image")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken image|aborted|ABORT"):
        media.write_image_files(broken, where)
    assert files(where) == []
    found = media.write_image_files(images(spark, 40), where)
    assert {r.image_id for r in found.collect()} == set(range(40)) and found.count() == 40 == len(files(where))
    media.write_image_files(images(spark, 3), where)
    assert len(files(where)) == 43 and os.listdir(where) and not any(x.startswith("_") for x in os.listdir(where))


def test_no_image_no_file(spark, tmp_path):
    assert media.write_image_files(images(spark, 5).withColumn("content", F.lit(None).cast("binary")), str(tmp_path / "none")).count() == 0


KILLED = """
import os, signal, sys
from pyspark.sql import SparkSession, functions as F
from lensmill.sources import media
where = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def once(batches):
    for batch in batches:
        if 7 in batch["image_id"].values and not os.path.exists(where + "/killed"):
            open(where + "/killed", "w").close()
            yield batch[batch.image_id < 7]
            os.kill(os.getpid(), signal.SIGKILL)
        yield batch

own = spark.range(0, 20, 1, 2).select(F.col("id").alias("image_id"), F.lit(b"P5x").alias("content")).mapInPandas(once, "image_id bigint, content binary")
found = media.write_image_files(own, where + "/images")
print("FOUND", sorted(r.image_id for r in found.collect()))
"""


def test_a_killed_task_is_run_again(tmp_path):
    """The worker dies after it has handed on images; the task's second attempt leaves each image once."""
    done = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], capture_output=True, text=True, timeout=240, env=os.environ | {"PYTHONPATH": os.pathsep.join([os.getcwd(), *sys.path])})
    assert f"FOUND {list(range(20))}" in done.stdout, done.stderr[-2000:]
    assert (tmp_path / "killed").exists()
    assert sorted(int(os.path.basename(f).split(".")[0]) for f in files(tmp_path / "images")) == list(range(20))


def test_a_thousand_settings_are_one_file(spark, tmp_path):
    where = str(tmp_path / "settings")
    for i in range(1000):
        media.write_setting(spark, where, f"k{i % 3}", f"value {i} é")
    assert [os.path.basename(f) for f in files(where)] == ["settings.json"]
    assert media.read_settings(spark, f"file://{where}") == {"k0": "value 999 é", "k1": "value 997 é", "k2": "value 998 é"}
    assert media.read_setting(spark, where, "k0") == "value 999 é" and media.read_setting(spark, where, "none", "x") == "x"
    assert media.read_document_type(spark, where) == "PASSPORT"
