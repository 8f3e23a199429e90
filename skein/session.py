"""Session helpers: a local session for tests, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join shuffles.
SMALL_ROWS = 200_000


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers: the folder goes to them as one archive, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="skein-"), os.path.basename(root))
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(root), os.path.basename(root)))
    sc._skein_shipped = True


def checkpoint_folder(master: str, named: str | None) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors must share; a temporary one only where none is
    named and everything runs on one machine."""
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="skein-checkpoint-")


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder; what is written there is deleted when the driver ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(checkpoint_folder(sc.master, named))
    path = f"{sc.getCheckpointDir()}/skein-{uuid.uuid4().hex}"
    fs, target = _file(spark, path)
    fs.deleteOnExit(target)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read from there, so that lost executors lose no result
    and what reads it again prunes columns and filters. The table is deleted when the driver ends, or by ``forget``."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._skein_path = path
    return kept


def forget(df: DataFrame) -> None:
    """Deletes the table of a ``checkpointed`` DataFrame that nothing will read again, such as a loop's last round."""
    fs, target = _file(df.sparkSession, df._skein_path)
    fs.delete(target, True)


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast when counting shows at most ``limit`` rows, else unmarked (a shuffled join follows)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
