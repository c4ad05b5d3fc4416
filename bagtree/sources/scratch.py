"""Intermediate tables in the shared checkpoint folder.

Loops that run several jobs write each step as a parquet table and go on from there. The plan stays short,
and a lost executor costs a re-read instead of a re-run of all earlier steps. ``unstage`` deletes a step once a later one
is written; what is left goes when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_roots: dict[str, SparkSession] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and the master is local, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="bagtree-")
    return _own_dir[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    root = f"{checkpoint_root(spark)}/bagtree/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
        atexit.register(_clear, root)
    return f"{root}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; tables that were not staged are left alone."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path:
            delete_path(table.sparkSession, path.rpartition("/")[0])


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system Spark reads it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _clear(root: str) -> None:
    spark = _roots.pop(root, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        delete_path(spark, root)
