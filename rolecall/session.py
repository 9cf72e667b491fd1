"""A session for tests and single-machine runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str, name: str, **settings: str) -> SparkSession:
    """A local session; ``settings`` are Spark settings with ``__`` for the dots.

    On a cluster use the session that ``spark-submit`` gives. The reports need nothing
    but the defaults: adaptive execution joins small partitions, splits skewed ones
    and chooses broadcasts by measured size.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the caller of each column expression costs more than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
