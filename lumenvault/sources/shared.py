"""What driver and executors share: the folder for intermediate tables, and the code of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this setting Spark removes the shuffle files of a query when it ends; otherwise they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; where neither is set, a folder of our own in local
    mode, and an error on a cluster, whose machines share none."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lumenvault-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one, to be removed when it has ended."""
    return f"{shared_dir(spark)}/lumenvault-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cut lineage that survives lost executors.

    Nothing reads the write's shuffle files again, so they go with it. discard() removes the table before the application ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes written() tables that nothing still to run reads."""
    for df in tables:
        remove(df.sparkSession, df._written)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(table: DataFrame, most: int = 8 << 20) -> DataFrame:
    """A table that is cheap to read, to be broadcast if its rows take `most` bytes at most as measured; else dealt() out."""
    each = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if t.startswith(("array", "struct", "map")) else F.lit(0) for c, t in table.dtypes]
    taken = table.agg(F.sum(sum(each, F.lit(16 * len(each))).cast("long"))).first()[0] or 0
    return F.broadcast(table) if taken <= most else dealt(table)


def dealt(table: DataFrame) -> DataFrame:
    """A table whose next join deals out both sides, whatever size Spark takes them for.

    Spark counts neither the rows that an explode adds nor the lengths of arrays, and a written table by its compressed bytes;
    so a table of many rows can seem small, and building it for a broadcast exhausts the driver.
    """
    return table.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """written(), where the lineage is cut so that what follows is planned from a table and not worked out again."""
    return written(df)


def clean_up(spark: SparkSession) -> None:
    """Removes all tables of this application, when nothing still to run reads them."""
    remove(spark, work_dir(spark))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever folder the driver was started in. Called before a Python function is made."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
