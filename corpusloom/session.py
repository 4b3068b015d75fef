"""Session helpers: table readers and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs on this machine, as in
    local tests, a folder of it is chosen.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
    spark.conf.set("spark.checkpoint.dir", here)
    return here


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and read again.

    Survives the loss of executors, unlike a checkpoint kept on their disks.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        _delete_at_end(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints that no DataFrame refers to any more.

    Spark removes them once the driver's garbage is collected, which may be long after an iterative job has filled the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, removed when the application ends.

    Cuts lineage as ``cut`` does, on a fraction of the disk where rows are narrow or texts repeat.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more, before the application ends."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the number tasks are sized by."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every Python worker this package, once an application, wherever the job was started from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corpusloom-")  # of the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "corpusloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
