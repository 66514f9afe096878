"""Reading the Parquet tables of one data directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of ``directory``; a missing table is an error of Spark's."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
