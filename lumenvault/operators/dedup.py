"""Exact deduplication by content, key or name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import survivor_quality
from ..sources.readers import first_of_each


def with_quality(objects: DataFrame) -> DataFrame:
    c = F.col
    return objects.withColumn("quality", survivor_quality(c("width"), c("height"), c("duration_ms"), c("media_kind"), c("extension"), c("size")))


def exact_duplicates(objects: DataFrame) -> DataFrame:
    """(key, file_id, kept_key) of every object that has a better copy of the same content.

    The best copy comes from a partial aggregate and is joined back, so a content with very many
    copies does not meet in one task (adaptive execution splits the join).
    """
    rated = with_quality(objects)
    # best: highest quality, then least key; max_by cannot descend on text, so quality first and the key by min
    top = rated.groupBy("sha256").agg(F.max("quality").alias("best"), F.count("*").alias("n")).where("n > 1")
    keep = rated.join(top, "sha256").where("quality = best").groupBy("sha256").agg(F.min("key").alias("kept_key"))
    return objects.join(keep, "sha256").where("key <> kept_key").select("key", "file_id", "kept_key")


def distinct_sources(sources: DataFrame, rule) -> DataFrame:
    """Normalised names, case-insensitively distinct; the first position wins and keeps its case.

    required_sources() refuses a result without rows.
    """
    named = sources.select("position", rule(F.col("value")).alias("source")).where("source <> ''")
    first = first_of_each(named.withColumn("folded", F.lower("source")), "folded", "position")
    return first.select("position", "source")


def required_sources(found: DataFrame) -> DataFrame:
    """`found`, or an error if it has no rows: a run needs a source."""
    if not found.limit(1).count():
        raise ValueError("no valid source")
    return found


def new_keys(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of keys not known yet, the first position of each."""
    return first_of_each(batch.join(known, "key", "left_anti"), "key", "position")


def duplicate_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
