"""Writers of manifests, shard plans, indexes and run summaries as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Writes `df` in folders by columns; those that it has rows for are replaced, so a write tried again doubles nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def manifest(entries: DataFrame, header: DataFrame, path: str) -> None:
    """Entries and header row (see manifest_header) under their generation. Invalid manifests raise before anything is written."""
    from ..operators.summary import valid_manifest

    _replace(valid_manifest(entries, header), f"{path}/entries", "generation")
    _replace(header, f"{path}/headers", "generation")


def shard_plan(plan: DataFrame, path: str) -> None:
    """One folder for each generation, round and shard, so that a worker reads its own only."""
    _replace(plan.repartition("generation", "round", "shard"), path, "generation", "round", "shard")


def gallery_index(entries: DataFrame, generated_at: int, path: str) -> None:
    """Index rows in order of the key they are published under, and version, time and number of rows beside them."""
    from ..operators.summary import gallery_header, gallery_items

    gallery_items(entries).write.mode("overwrite").parquet(f"{path}/items")
    gallery_header(entries, generated_at).write.mode("overwrite").parquet(f"{path}/header")


def run_summary(runs: DataFrame, run: str, path: str) -> None:
    """The counters of one run under its id."""
    from ..operators.summary import acquisition

    _replace(acquisition(runs).withColumn("run", F.lit(run)), path, "run")


def canonical_index(objects: DataFrame, path: str) -> None:
    """The canonical index: its items as JSON lines in order of their key, and its header beside them."""
    from ..operators.summary import canonical_header, canonical_items

    canonical_items(objects).orderBy("key").select("item").write.mode("overwrite").text(f"{path}/items")
    canonical_header(objects).write.mode("overwrite").json(f"{path}/header")
