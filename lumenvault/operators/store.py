"""The stored inventory, rewritten where it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, remove, written
from .reconcile import FP_VERSION

COLUMNS = ("key", "file_id", "size", "sha1", "fp_version", "phash")


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create(rows: DataFrame, path: str, parts: int) -> None:
    """A store of `rows` (COLUMNS) in `parts` folders by a hash of the key."""
    rows.select(*COLUMNS, part_of(F.col("key"), parts).alias("part")).repartition("part").write.partitionBy("part").parquet(path)


def rewrite(spark: SparkSession, path: str, remote: DataFrame, parts: int) -> int:
    """Brings the store at `path` to `remote` (key, file_id, size, sha1) and says how many folders were touched.

    Rows of `remote` replace stored ones; a fingerprint stays where file id, size, digest and version are as they
    were; keys that are gone go. Only folders with a change are written, from a copy made before, so the store is read as
    it was; the others keep their files. Done again, or after a run that broke off, it ends with the same store.
    """
    kind = ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, ("string", "string", "long", "string", "int", "long")))
    stored = spark.read.schema(f"{kind}, part int").parquet(path)
    o, n = stored.alias("o"), remote.select("key", "file_id", "size", "sha1", part_of(F.col("key"), parts).alias("part")).alias("n")
    same = (F.col("o.file_id") == F.col("n.file_id")) & (F.col("o.size") == F.col("n.size")) & (F.col("o.sha1") == F.col("n.sha1"))
    kept = F.coalesce(same & (F.col("o.fp_version") == FP_VERSION), F.lit(False))
    dropped = ~kept & (F.col("o.fp_version").isNotNull() | F.col("o.phash").isNotNull())
    feed = o.join(n, "key", "full_outer").select(
        "key", F.coalesce("n.part", "o.part").alias("part"), F.col("n.key").isNull().alias("gone"), (~F.coalesce(same, F.lit(False)) | dropped).alias("changed"),
        "n.file_id", "n.size", "n.sha1", F.when(kept, F.col("o.fp_version")).alias("fp_version"), F.when(kept, F.col("o.phash")).alias("phash"),
    )
    feed = written(feed)
    touched = feed.groupBy("part").agg(F.bool_or("changed").alias("changed"), F.count_if(~F.col("gone")).alias("left")).where("changed")
    found = {r.part: r["left"] for r in touched.collect()}  # `parts` rows at most
    rows = feed.where(~F.col("gone") & F.col("part").isin([p for p, left in found.items() if left])).select(*COLUMNS, "part")
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for p, left in found.items():
        if not left:  # a folder that gets no row is not overwritten
            remove(spark, f"{path}/part={p}")
    discard(feed)
    return len(found)
