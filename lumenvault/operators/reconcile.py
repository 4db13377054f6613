"""Snapshots against snapshots: classification, change data, verification, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fingerprints of another version than this are made anew.
FP_VERSION = 2
DAY = 86_400


def classified(staged: DataFrame, inventory: DataFrame) -> DataFrame:
    """Staged rows as known (same key, size, digest), changed or new."""
    old = inventory.select("key", F.col("size").alias("old_size"), F.col("sha1").alias("old_sha1"))
    same = (F.col("size") == F.col("old_size")) & (F.col("sha1") == F.col("old_sha1"))
    return staged.join(old, "key", "left").select("key", "size", F.when(F.col("old_size").isNull(), "new").when(same, "known").otherwise("changed").alias("state"))


def reconciled(stored: DataFrame, remote: DataFrame) -> DataFrame:
    """Change class and surviving fingerprint of every key of either side. Fingerprints survive if file id, size and digest all agree and the version is current."""
    o, n = stored.alias("o"), remote.alias("n")
    both = o.join(n, "key", "full_outer")
    same = (F.col("o.file_id") == F.col("n.file_id")) & (F.col("o.size") == F.col("n.size")) & (F.col("o.sha1") == F.col("n.sha1"))
    kept = same & (F.col("o.fp_version") == FP_VERSION)
    change = F.when(F.col("n.file_id").isNull(), "gone").when(F.col("o.file_id").isNull(), "new").when(same, "same").otherwise("changed")
    return both.select("key", change.alias("change"), F.col("n.file_id").alias("file_id"), F.col("n.size").alias("size"), F.when(kept, F.col("o.phash")).alias("phash"))


def surviving_exclusions(exclusions: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of which neither key vanished or changed its file id."""
    stale = old.select("key", F.col("file_id").alias("was")).join(new.select("key", "file_id"), "key", "left").where("file_id is null or file_id <> was").select("key")
    left = exclusions.join(stale.withColumnRenamed("key", "first_key"), "first_key", "left_anti")
    return left.join(stale.withColumnRenamed("key", "second_key"), "second_key", "left_anti").select("first_key", "second_key")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose key, file id, size or digest differ between two inventories."""
    o, n = old.select("key", F.struct("file_id", "size", "sha1").alias("a")), new.select("key", F.struct("file_id", "size", "sha1").alias("b"))
    both = o.join(n, "key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("key", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def remapped_tags(items: DataFrame, prior: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tag items of the previous generation under their keys of the next one.

    A published key maps to its source (or stays), must be in the gallery, and the last of repeated keys wins.
    """
    source = prior.select(F.col("destination_key").alias("key"), "source_key")
    mapped = items.join(source, "key", "left").select(F.coalesce("source_key", "key").alias("source_key"), "tags", "position").where(F.col("source_key").startswith("gallery/"))
    last = mapped.groupBy("source_key").agg(F.max_by("tags", "position").alias("tags"))
    return last.join(manifest.select("source_key", "destination_key", "extension"), "source_key").select(F.col("destination_key").alias("key"), F.col("extension").alias("ext"), "tags").orderBy("key")


def verified(manifest: DataFrame, published: DataFrame, generation: str) -> DataFrame:
    """Manifest entries with `ok`: published with the same size, digest and generation.

    An empty expected digest (or generation) is not asked for; a published object without one fails where it is expected.
    """
    p = published.select(F.col("key").alias("destination_key"), F.col("size").alias("found"), F.col("sha1").alias("found_sha1"), F.col("generation"))
    expected = F.coalesce("sha1", F.lit(""))
    ok = (F.col("size") == F.col("found")) & ((expected == "") | (F.coalesce("found_sha1", F.lit("")) == expected)) & (F.lit(not generation) | (F.coalesce("generation", F.lit("")) == generation))
    return manifest.join(p, "destination_key", "left").select("source_key", "destination_key", "size", F.coalesce(ok, F.lit(False)).alias("ok"))


def completed(progress: DataFrame) -> DataFrame:
    return progress.where("outcome = 'completed'").select("key").distinct()


def unfinished(manifest: DataFrame, progress: DataFrame) -> DataFrame:
    return manifest.join(completed(progress).withColumnRenamed("key", "source_key"), "source_key", "left_anti")


def recovery(manifest: DataFrame, progress: DataFrame, published: DataFrame, generation: str) -> DataFrame:
    """Unfinished entries as recognised (published all the same) or missing, with totals."""
    checked = verified(unfinished(manifest, progress), published, generation)
    return checked.groupBy(F.when(F.col("ok"), "recognised").otherwise("missing").alias("state")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def recovery_shards(manifest: DataFrame, progress: DataFrame, published: DataFrame, generation: str, shards: int) -> DataFrame:
    """(generation, key, size, shard): the entries of a recovery round, those missing dealt anew by bytes."""
    from .selection import byte_shards

    missing = verified(unfinished(manifest, progress), published, generation).where("not ok")
    return byte_shards(missing.select(F.lit(generation).alias("generation"), F.col("source_key").alias("key"), "size"), shards)


def cleanup(old_index: DataFrame, new: DataFrame, backlog: DataFrame, protected: DataFrame) -> DataFrame:
    """Keys to delete: of the old index and not of the new, and the backlog, less the protected ones."""
    return old_index.join(new, "key", "left_anti").unionByName(backlog).distinct().join(protected, "key", "left_anti")


def retried(backlog: DataFrame, active: DataFrame, now: int) -> DataFrame:
    return backlog.where(F.col("not_before") <= now).join(active, "key", "left_anti").select("key")


def abandoned(latest: DataFrame, preserved: DataFrame, now: int, ttl: int = DAY) -> DataFrame:
    """Generations to sweep: failed or abandoned ones, and idle unfinished ones; never the preserved."""
    age = F.lit(now) - F.coalesce("updated_at", "created_at", F.lit(now))
    dead = F.col("status").isin("failed", "abandoned") | (F.col("status").isin("building", "recovering", "ready") & (age >= ttl))
    return latest.join(preserved, "generation", "left_anti").where(dead).select("generation", "status")


def abandoned_keys(dead: DataFrame, listing: DataFrame, prefix: str = "gallery/generations/") -> DataFrame:
    """(generation, key) of what is listed under the generations to sweep; the generation is read from the key, so the join is by equality."""
    under = listing.where(F.col("key").startswith(prefix)).select("key", F.substring_index(F.substring("key", len(prefix) + 1, 1 << 20), "/", 1).alias("generation")).where(F.col("key").startswith(F.concat(F.lit(prefix), F.col("generation"), F.lit("/"))))
    return under.join(dead.where("generation <> ''").select("generation").distinct(), "generation", "left_semi").select("generation", "key")


def journal(operations: DataFrame, live: DataFrame) -> DataFrame:
    """What recovery does with each journalled deletion."""
    found = live.select(F.col("key").alias("target_key"), F.col("file_id").alias("target_file_id"), F.lit(True).alias("live"))
    state = F.col("state")
    action = F.when(state == "remote_deleted", "complete").when(state != "prepared", "error").when(F.col("live"), "delete").otherwise("already done")
    return operations.join(found, ["target_key", "target_file_id"], "left").select("id", "target_key", action.alias("action"))


def deletable(targets: DataFrame, live: DataFrame) -> DataFrame:
    """One row: whether every distinct target still has the file id it was chosen with, and how many do not."""
    targets = targets.select("target_key", "target_file_id").distinct()
    found = live.select(F.col("key").alias("target_key"), "file_id")
    bad = F.count_if(F.col("file_id").isNull() | (F.col("file_id") != F.col("target_file_id")))
    return targets.join(found, "target_key", "left").agg(F.count("*").alias("targets"), bad.alias("stale")).withColumn("refused", F.col("stale") > 0)


def obsolete_versions(versions: DataFrame, keep: DataFrame) -> DataFrame:
    return versions.join(keep.select("key", F.col("file_id").alias("keep_id")), "key").where("file_id <> keep_id").select("key", "file_id")
