"""Cutting lineage with tables written to the shared folder of the cluster.

Every multi-stage operator writes its intermediate results as Parquet under ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local one is set only where none is and the master is
    local (tests). Executors of a cluster share no local folder, so there the setting is required."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder, in this application's part of it, that nothing else uses."""
    return f"{scratch_root(spark)}/quillgrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that no later step reads."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        folder = file.rpartition("/")[0]
        if "/quillgrid/" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
            return


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    """The folders run-* under ``path`` that hold a marker of success, in order of their names."""
    p, fs = _folder(spark, path)
    found = [x.getPath().toString() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(x for x in found if x.rpartition("/")[2].startswith("run-") and fs.exists(_folder(spark, x + "/_SUCCESS")[0]))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds, sorted."""
    p, fs = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p))


def mark_finished(spark: SparkSession, path: str) -> None:
    """Put the marker of success into a run of several tables, once all of them are written."""
    p, fs = _folder(spark, path + "/_SUCCESS")
    fs.create(p, True).close()


def delete_folder(spark: SparkSession, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/quillgrid/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
