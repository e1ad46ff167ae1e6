"""Scratch tables in the folder that all executors share, and size checks for broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import work_path

#: A side is broadcast only below this many rows of one number each (about 64 MB).
BROADCAST_ROWS = 2_000_000


class Scratch:
    """Parquet tables of one operator run, under the shared folder.

    A written table cuts lineage: when an executor is lost, later stages read
    the files again and recompute nothing before them.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = work_path(spark, what)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
