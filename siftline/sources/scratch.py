"""Lineage cuts that survive lost executors: reliable checkpoints and tables in the folder the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_held: dict[str, object] = {}  # path of each stored table to the Hadoop settings that reach it


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, as ``spark.checkpoint.dir`` names it.

    Where none is set a single-process session (tests) gets a temporary folder; on a
    cluster that would be a folder other machines cannot see, so it is an error there.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftline-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and return it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in a new folder under the shared one, and read again; deleted by release() or when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    keep_until_exit(spark, path)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when Python ends."""
    _held[path] = spark.sparkContext._jsc.hadoopConfiguration()


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        _delete(table.sparkSession.sparkContext._jvm, table._stored_at)


def _delete(jvm, path: str) -> None:
    settings = _held.pop(path, None)
    if settings is not None:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(settings).delete(place, True)


@atexit.register
def _delete_all() -> None:
    from pyspark import SparkContext

    if SparkContext._jvm is not None:
        for path in list(_held):
            with contextlib.suppress(Py4JError, OSError):
                _delete(SparkContext._jvm, path)
