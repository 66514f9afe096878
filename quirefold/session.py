"""Session settings that operators depend on."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a private folder only where it names none (tests, one machine)."""
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_SETTING, None)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quirefold-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither recompute it nor depend on one executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, over as many tasks as can run if its files give fewer.

    A small table in one file is read by one task, which then does all the work on its texts.  Where files give
    enough tasks, as they do for anything large, nothing is shuffled.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
