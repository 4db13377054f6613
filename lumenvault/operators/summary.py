"""Totals, gates and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose digests are put together at a time.
DIGEST_ROWS = 100_000
#: What manifests say of their form and of how entries were chosen.
MANIFEST_VERSION, ALGORITHM = 1, "seeded-digest-order-under-budget-v1"


def gate(inventory: DataFrame) -> DataFrame:
    """One row: objects, those without a full digest, and whether publication must refuse."""
    found = inventory.agg(F.count("*").alias("objects"), F.count_if(F.length("sha1") != 40).alias("unverifiable"))
    return found.withColumn("refused", (F.col("objects") == 0) | (F.col("unverifiable") > 0))


def manifest_totals(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    chosen = manifest.agg(F.count("*").alias("selected_objects"), F.sum("size").alias("selected_bytes"))
    return chosen.join(inventory.agg(F.count("*").alias("inventory_objects"), F.sum("size").alias("inventory_bytes")))


def refused_if_unverifiable(inventory: DataFrame) -> DataFrame:
    """`inventory`, or an error where gate() refuses it."""
    found = gate(inventory).first()
    if found.refused:
        raise ValueError(f"inventory cannot be published: {found.asDict()}")
    return inventory


def manifest_header(entries: DataFrame, inventory: DataFrame, generation: str, created_at: int, seed: str, target_bytes: int) -> DataFrame:
    """The header row of a manifest: what was asked for, and its totals."""
    given = [F.lit(generation).alias("generation"), F.lit(MANIFEST_VERSION).alias("version"), F.lit(created_at).cast("long").alias("created_at"), F.lit(seed).alias("seed"), F.lit(ALGORITHM).alias("selection_algorithm"), F.lit(target_bytes).cast("long").alias("target_bytes")]
    totals = manifest_totals(entries, inventory)
    return totals.select(*given, *[F.coalesce(c, F.lit(0)).alias(c) for c in totals.columns])


def manifest_violations(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """Per generation of `headers` (or of entries that have none): what is wrong with its manifest, and whether it is refused.

    entries: (generation, source_key, destination_key, size). headers: (generation, version, target_bytes, inventory_objects, selected_objects, selected_bytes).
    Counted are repeated sources and destinations and destinations outside the generation's folder; the header is judged by version,
    target, inventory and declared totals.
    """
    inside = F.col("destination_key").startswith(F.concat(F.lit("gallery/generations/"), F.col("generation"), F.lit("/")))
    found = entries.groupBy("generation").agg(
        F.count("*").alias("entries"), F.sum("size").alias("bytes"), (F.count("*") - F.count_distinct("source_key")).alias("repeated_sources"),
        (F.count("*") - F.count_distinct("destination_key")).alias("repeated_destinations"), F.count_if(~inside).alias("foreign"),
    )
    both = headers.join(found, "generation", "full_outer")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("entries", "bytes", "repeated_sources", "repeated_destinations", "foreign")}
    bad = {
        "bad_version": (F.col("version") != MANIFEST_VERSION) | (F.col("generation") == ""), "bad_target": F.col("target_bytes") < 1, "bad_inventory": F.col("inventory_objects") < n["entries"],
        "bad_objects": F.col("selected_objects") != n["entries"], "bad_bytes": F.col("selected_bytes") != n["bytes"],
    }
    out = both.select("generation", *[n[c].alias(c) for c in ("entries", "repeated_sources", "repeated_destinations", "foreign")], *[F.coalesce(x, F.lit(True)).alias(c) for c, x in bad.items()])
    refused = (F.col("repeated_sources") + F.col("repeated_destinations") + F.col("foreign") > 0) | F.greatest(*bad)
    return out.withColumn("refused", refused)


def valid_manifest(entries: DataFrame, header: DataFrame) -> DataFrame:
    """`entries`, or an error if a manifest among them is refused by manifest_violations()."""
    found = manifest_violations(entries, header).where("refused").limit(1).collect()
    if found:
        raise ValueError(f"invalid manifest: {found[0].asDict()}")
    return entries


def shard_totals(plan: DataFrame, shards: int) -> DataFrame:
    """Objects and bytes of every shard, empty ones included."""
    found = plan.groupBy("shard").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    every = plan.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(found, "shard", "left").select("shard", F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def source_counts(runs: DataFrame) -> DataFrame:
    """Per source: items discovered, return code, whether all its items failed, and `refused`: whether the run staged nothing and no source succeeded."""
    found = runs.groupBy("source_number").agg(F.count("status").alias("discovered"), F.max("return_code").alias("return_code"), F.bool_and(F.col("return_code") != 0).alias("all_failed"))
    every = Window.partitionBy(F.lit(0))  # a row for each source
    return found.withColumn("refused", (F.sum("discovered").over(every) == 0) & F.bool_and("all_failed").over(every))


def acquisition(runs: DataFrame) -> DataFrame:
    """One row of counters over all items of a run; a source fails in part by its return code or a failed item, and then the history is rolled back."""
    state = F.col("status")
    count = lambda s: F.count_if(state == s).alias(s)
    bad = F.count_distinct(F.when((F.col("return_code") != 0) | (state == "failed"), F.col("source_number"))).alias("source_partial_failures")
    found = runs.agg(F.count_distinct("source_number").alias("attempted"), bad, F.count("status").alias("discovered"), F.count_if(state != "rejected").alias("staged"), *(count(s) for s in ("uploaded", "known", "rejected", "failed")), F.coalesce(F.sum(F.when(state == "uploaded", F.col("bytes"))), F.lit(0)).alias("uploaded_bytes"))
    return found.withColumn("history_rolled_back", F.col("source_partial_failures") > 0)


def failing(runs: DataFrame) -> DataFrame:
    """Sources that failed, or have a failed item, each with the first such number: the rollback point."""
    bad = runs.where("return_code <> 0 or status = 'failed'").select("source_number").distinct()
    least = bad.agg(F.min("source_number").alias("rollback"))
    return bad.join(least)


def worker_report(plan: DataFrame, progress: DataFrame) -> DataFrame:
    """Per shard: planned, planned_bytes, completed (of the plan), uploaded and recognized among these, failed, bytes (completed) and bytes_transferred (uploaded)."""
    is_done = F.col("outcome") == "completed"
    latest = progress.groupBy(F.col("key").alias("source_key")).agg(F.bool_or(is_done).alias("done"), F.bool_or(is_done & (F.col("how") == "uploaded")).alias("sent"), F.bool_or(F.col("outcome") == "failed").alias("lost"))
    done, sent, lost = (F.coalesce(x, F.lit(False)) for x in ("done", "sent", "lost"))
    met = plan.join(latest, "source_key", "left")
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("size"))), F.lit(0))
    return met.groupBy("shard").agg(
        F.count("*").alias("planned"), F.sum("size").alias("planned_bytes"), F.count_if(done).alias("completed"), F.count_if(sent).alias("uploaded"), F.count_if(done & ~sent).alias("recognized"),
        F.count_if(lost & ~done).alias("failed"), total(done).alias("bytes"), total(sent).alias("bytes_transferred"),
    )


def startup(reconciled: DataFrame, objects: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: inventory, reused and to_compute fingerprints, converged, exact copies beside the first, and candidates waiting for review."""
    live = reconciled.where("change <> 'gone'")
    found = live.agg(F.count("*").alias("inventory"), F.count("phash").alias("reused"), F.count_if(F.col("phash").isNull()).alias("to_compute"), F.bool_and(F.col("phash").isNotNull()).alias("converged"))
    exact = objects.groupBy("sha256").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("exact"))
    return found.join(exact).join(queue.agg(F.count("*").alias("candidates")))  # single rows


def canonical_items(objects: DataFrame) -> DataFrame:
    """(key, item): the JSON of each row of the canonical index, fields in alphabetical order."""
    return objects.select("key", F.to_json(F.struct("content_type", F.col("extension").alias("ext"), "file_id", "key", "sha1", "size", "upload_timestamp")).alias("item"))


def canonical_header(objects: DataFrame) -> DataFrame:
    """One row: version, number of items and digest of the canonical index."""
    return digest(objects).select(F.lit(1).alias("version"), F.col("objects").alias("count"), F.col("digest").alias("inventory_digest"))


def gallery_items(entries: DataFrame) -> DataFrame:
    """(key, ext, size): the published index, in order of the key that an entry is published under."""
    return entries.select(F.col("destination_key").alias("key"), F.col("extension").alias("ext"), "size").orderBy("key")


def gallery_header(entries: DataFrame, generated_at: int) -> DataFrame:
    return entries.agg(F.count("*").alias("count")).select(F.lit(1).alias("version"), F.lit(generated_at).cast("long").alias("generated_at"), "count")


def digest(objects: DataFrame, rows: int = DIGEST_ROWS) -> DataFrame:
    """Digest of an inventory without a global sort: rows are digested, then buckets of sorted digests, then the sorted bucket digests.

    Buckets are as many as the table needs (two hexadecimal digits at least) for about `rows` rows each.
    """
    digits = max(2, math.ceil(math.log(max(1, objects.count() / rows), 16)))
    line = F.concat_ws("\0", "key", "file_id", F.col("size").cast("string"), "sha1")
    lines = objects.select(F.sha2(line, 256).alias("d")).select("d", F.substring("d", 1, digits).alias("bucket"))
    groups = lines.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.count("*").alias("n"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.sum("n").alias("objects"))


#: Pieces of a row's SHA-256 that are summed up, and the digits of each.
PIECES, PIECE_DIGITS = 4, 15


def _pieces() -> list:
    line = F.sha2(F.concat_ws("\0", "key", "file_id", F.col("size").cast("string"), "sha1"), 256)
    return [F.conv(F.substring(line, 1 + PIECE_DIGITS * k, PIECE_DIGITS), 16, 10).cast("decimal(38,0)").alias(f"s{k}") for k in range(PIECES)]


def _summed(rows: DataFrame, sign) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(sign * F.col(c)), F.lit(0)).cast("decimal(38,0)")
    return rows.agg(F.coalesce(F.sum(sign), F.lit(0)).cast("long").alias("objects"), *[total(f"s{k}").alias(f"s{k}") for k in range(PIECES)])


def multiset_digest(objects: DataFrame) -> DataFrame:
    """One row (objects, s0..s3): an order-free digest of an inventory, sums of 60-bit pieces of each row's SHA-256.

    Equal inventories have equal digests in any order, and the digest of a changed one follows from the old one and the changes alone.
    """
    return _summed(objects.select(*_pieces()), F.lit(1))


def updated_digest(digest: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The multiset_digest() after rows came and went, from the one before; a changed row is removed as it was and added as it is."""
    rows = added.select(F.lit(1).alias("sign"), *_pieces()).unionByName(removed.select(F.lit(-1).alias("sign"), *_pieces()))
    both = digest.unionByName(_summed(rows, F.col("sign")))
    return both.agg(F.sum("objects").alias("objects"), *[F.sum(f"s{k}").cast("decimal(38,0)").alias(f"s{k}") for k in range(PIECES)])


def unchanged_since(before: DataFrame, now: DataFrame) -> bool:
    """Whether an inventory is as it was analysed: two digests of one row agree. A queue made in between is valid only then."""
    return before.first() == now.select(*before.columns).first()
