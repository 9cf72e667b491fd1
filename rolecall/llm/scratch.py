"""Tables written to the folder that all executors share.

A written table cuts the lineage: later steps read files that outlive any executor.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def _root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that executors share")
    root = "file://" + tempfile.mkdtemp(prefix="rolecall-llm-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(table: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``table``, written as Parquet to the shared folder and read again.

    ``forget`` removes it, unless it is ``lasting``.
    """
    spark = table.sparkSession
    path = f"{_root(spark)}/rolecall-llm/{name}-{uuid.uuid4().hex}"
    table.write.option("compression", "zstd").parquet(path)
    if not lasting:
        _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    # Shuffle files of what led here go once the driver has collected its garbage.
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(table.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Remove this application's tables; only when no frame over them is needed."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
