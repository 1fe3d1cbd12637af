"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; on a local master (tests) a temporary one where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(spark.sparkContext, "_barloom_shared", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext._barloom_shared = folder
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._barloom_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote, once nothing reads it any more."""
    path = getattr(df, "_barloom_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like ``names`` that ``df`` doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(free)
    return tuple(out)
