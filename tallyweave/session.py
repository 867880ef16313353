"""Session helpers: the shared folder and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach.

    Where a session on one machine names none (as in tests), a scratch folder is
    made once and kept in the same setting. A cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, whose files go when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def _place(spark: SparkSession, path: str):
    """A path and the file system that it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    place, system = _place(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written."""
    place, system = _place(spark, path)
    system.delete(place, True)


def put_if_absent(spark: SparkSession, path: str, write: Callable[[str], None]) -> bool:
    """A folder that appears whole or not at all, and once: ``write(folder)`` fills a hidden one, which is then renamed.

    False if ``path`` is there already, from another writer or an earlier try; it is left as it is. The
    rename is atomic where the file system has atomic renames that do not replace.
    """
    place, system = _place(spark, path)
    if system.exists(place):
        return False
    parent, name = path.rstrip("/").rsplit("/", 1)
    hidden, _ = _place(spark, f"{parent}/.{name}-{uuid.uuid4().hex}")
    try:
        write(hidden.toString())
        fs = spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
        # No option, so that an existing folder is not replaced.
        context.rename(hidden, place, spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False
    finally:
        system.delete(hidden, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now, so that later steps read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(scan: DataFrame) -> DataFrame:
    """Deal out a stored table that has fewer splits than the cluster has cores.

    For work that is heavy per row. A large table has splits enough and is
    returned as it is. ``scan`` must be a plain scan, since its plan is asked
    for the number of its splits.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
