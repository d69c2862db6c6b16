"""Where jobs may put intermediate tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_STEP = {
    # shuffle files serve the write only; else they stay until the driver happens to collect its garbage, and a
    # run needs the disk of all its steps at once
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # the JVM interprets longer methods, unless it is told otherwise when it starts; Spark then makes shorter ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can read.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if root:
        return f"{root.rstrip('/')}/stallbook-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="stallbook-")


@contextmanager
def step_settings(spark: SparkSession) -> Iterator[None]:
    """Settings for a write of one step that is done within; see ``_STEP``."""
    before = {k: spark.conf.get(k, None) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def packed_parquet(df: DataFrame) -> DataFrameWriter:
    """A Parquet writer for tables of a run, whose files count more for their size than for the time they take."""
    return df.write.format("parquet").option("compression", "zstd")


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Writes the frame as Parquet and reads it back: lineage is cut and the
    result survives the loss of executors."""
    with step_settings(df.sparkSession):
        packed_parquet(df).mode("overwrite").save(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a stored step that nothing reads any more."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
