"""Decisions on review cards: which still hold, and what they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt


def checked(decisions: DataFrame, queue: DataFrame, live: DataFrame) -> DataFrame:
    """`decisions` with `state`: accepted, or why not.

    decisions: (left_key, right_key, decision, seen, file_id): `keep both`, `delete left` or `delete right`, the generation of the card and the file id that
    it showed of the object to go. queue: the pending cards with their generation. live: (key, file_id) of what is stored now.
    Any other decision is invalid, a pair without a card unknown, a card of another generation stale; a deletion is refused as changed if its object is gone or has another file id.
    """
    target = F.when(F.col("decision") == "delete left", F.col("left_key")).when(F.col("decision") == "delete right", F.col("right_key"))
    met = decisions.withColumn("target", target).join(dealt(queue.select("left_key", "right_key", F.col("generation").alias("__now"))), ["left_key", "right_key"], "left")
    met = met.join(dealt(live.select(F.col("key").alias("target"), F.col("file_id").alias("__live"))), "target", "left")
    changed = F.col("target").isNotNull() & ~F.coalesce(F.col("__live") == F.col("file_id"), F.lit(False))
    known = F.coalesce(F.col("decision").isin("keep both", "delete left", "delete right"), F.lit(False))
    state = F.when(~known, "invalid").when(F.col("__now").isNull(), "unknown").when(~F.col("seen").eqNullSafe(F.col("__now")), "stale").when(changed, "changed").otherwise("accepted")
    return met.select("left_key", "right_key", "decision", "target", "file_id", state.alias("state"))


def applied(judged: DataFrame, stored: DataFrame) -> DataFrame:
    """(action, key, other, file_id) of the accepted decisions: distinct deletions with the file id they are for, and exclusions that are not `stored` (first_key, second_key)."""
    good = judged.where("state = 'accepted'")
    nothing = F.lit(None).cast("string")
    deleted = good.where("target is not null").select(F.lit("delete").alias("action"), F.col("target").alias("key"), nothing.alias("other"), "file_id").distinct()
    pairs = good.where("target is null").select(F.least("left_key", "right_key").alias("key"), F.greatest("left_key", "right_key").alias("other")).distinct()
    fresh = pairs.join(dealt(stored.select(F.col("first_key").alias("key"), F.col("second_key").alias("other"))), ["key", "other"], "left_anti")
    return deleted.unionByName(fresh.select(F.lit("exclude").alias("action"), "key", "other", nothing.alias("file_id")))
