"""Settings of a session, and the folder for what queries write on the way."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that work_path has given out, in order.
_given: list[str] = []


def build(app: str = "grantmill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; settings override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=base | settings).getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only on a local master without such a setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="grantmill-")
        spark.conf.set("spark.checkpoint.dir", shared)
    _given.append(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders, wherever they are."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Working folders that are made within are deleted at the end; by then results must have been written elsewhere."""
    begin = len(_given)
    try:
        yield
    finally:
        delete(spark, *_given[begin:])
        del _given[begin:]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: lineage ends here, and what follows survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
