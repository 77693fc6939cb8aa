"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder in the warehouse, or on one machine (tests) a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return os.path.join(tempfile.gettempdir(), "scribelake-scratch")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scribelake-scratch"


def materialize(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    replaces: a table of an earlier call that only df has read; it is deleted when df is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        discard(replaces)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of materialize that nothing reads any more."""
    spark = table.sparkSession
    own = shared_folder(spark).partition(":")[2].lstrip("/") or shared_folder(spark).lstrip("/")
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        if f"/{own}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
