import time
from pathlib import Path

from pyspark.sql import functions as F

from findery.session import stage


def shuffle_files(spark):
    """A session of one process has one block manager, whose folders hold what is shuffled."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_what_a_step_has_shuffled_goes_with_it(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffle_files(spark), spark.conf.get(setting)
    done = stage(spark.range(1000).repartition(3, F.col("id") % 7), "r")
    for _ in range(50):  # files go a moment after the step
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(setting) == was
    assert done.count() == 1000
