"""Tables that Spark derives once and every later query reads."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rolecall.sources.ingest import release_shuffles, write_postings

_written: dict[tuple[str, str], tuple[str, StructType]] = {}
_temporary: dict[str, str] = {}
_lock = Lock()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in this process, as in tests, it is a
    temporary folder of this machine.
    """
    application = spark.conf.get("spark.app.id")
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that executors share")
        with _lock:
            if application not in _temporary:
                _temporary[application] = tempfile.mkdtemp(prefix="rolecall-")
            root = f"file://{_temporary[application]}"
    return f"{root.rstrip('/')}/rolecall/{application}"


def label_of(name: str) -> str:
    """A short name for a folder."""
    return hashlib.sha1(name.encode()).hexdigest()[:16]


# A task joins narrow rows and then sorts whole ones, some ten times as wide.
_TASK_BYTES = "16m"


@contextmanager
def _small_tasks(spark: SparkSession) -> Iterator[None]:
    """Smaller shuffle partitions than Spark's usual 64 MB, where the session sets no size."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(size, None):
        yield
        return
    spark.conf.set(size, _TASK_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(size)


def derived_once(
    spark: SparkSession, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """``build()``, written once per application to the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; a table there outlives lost
    executors and cuts the lineage. Without that setting nothing is written and the
    lazy plan is returned. ``spark.rolecall.ingest.files`` fixes the number of files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return build()
    application = spark.conf.get("spark.app.id")
    with _lock:
        if (application, name) not in _written:
            path = f"{root.rstrip('/')}/rolecall/{application}/{label_of(name)}"
            files = spark.conf.get("spark.rolecall.ingest.files", None)
            table = build()
            with _small_tasks(spark):
                write_postings(
                    table, path, files=int(files) if files else None, compression="zstd"
                )
            _written[application, name] = path, table.schema
            del table
            release_shuffles(spark)
        path, schema = _written[application, name]
    return spark.read.schema(schema).parquet(path)
