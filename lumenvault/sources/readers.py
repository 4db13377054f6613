"""Readers and writers of listings, indexes and reports as tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Bytes that opening a scanned file counts as, and the setting that says so.
OPEN_COST, _OPEN_COST = 64 << 10, "spark.sql.files.openCostInBytes"


def inventory(listing: DataFrame) -> DataFrame:
    """Uploads with content: the digest is the listed one or else that of the metadata."""
    kept = listing.where("action = 'upload' and content_length > 0")
    sha1 = F.coalesce(F.nullif("content_sha1", F.lit("")), "large_file_sha1", F.lit(""))
    return kept.select(F.col("file_name").alias("key"), F.col("content_length").alias("size"), sha1.alias("sha1"), "file_id", "content_type")


def inventory_sorted(listing: DataFrame) -> DataFrame:
    """The variant that asks the metadata only where the listed digest is 'none' ('' if it has none), adds the extension and sorts by key."""
    from ..functions.rules import extension_of

    kept = listing.where("action = 'upload' and content_length > 0")
    sha1 = F.when(F.col("content_sha1") == "none", F.coalesce("large_file_sha1", F.lit(""))).otherwise(F.coalesce("content_sha1", F.lit("")))
    return kept.select(F.col("file_name").alias("key"), F.col("content_length").alias("size"), sha1.alias("sha1"), "file_id", F.coalesce("content_type", F.lit("application/octet-stream")).alias("content_type"), extension_of(F.col("file_name")).alias("extension"), "upload_timestamp").orderBy("key")


def index_items(documents: DataFrame, strict: bool) -> DataFrame:
    """(key, ext, size) from JSON index documents, a list of items or an object that holds one.

    A row is bad whose key does not start with gallery/. Strict: a bad row raises. Lenient: it is dropped.
    """
    item = "struct<key:string,ext:string,size:bigint>"
    body = F.col("body")
    items = F.when(body.startswith("["), F.from_json(body, f"array<{item}>")).otherwise(F.col("doc")["items"])
    rows = documents.withColumn("doc", F.from_json(body, f"struct<items:array<{item}>>")).select(F.explode(items).alias("item")).select("item.*")
    good = F.coalesce(F.col("key").startswith("gallery/"), F.lit(False))
    if not strict:
        return rows.where(good)
    return rows.withColumn("key", F.when(good, F.col("key")).otherwise(F.raise_error(F.lit("bad row in gallery index")).cast("string")))


def tag_index(documents: DataFrame, most_tags: int = 20_000, most_items: int = 250_000, most_of_item: int = 512) -> DataFrame:
    """(index_id, item, key, ext, tags) of JSON tag indexes (index_id, body): items [key, extension, [tag ids]].

    An index of another version than 1 or beyond a limit counts as empty. Kept is an item of three fields with a
    gallery key, a known extension (lower-cased) and at most `most_of_item` tags, all of the catalogue; a tag of
    it counts if it has a name and a positive count, and its id is its place.
    """
    doc = F.from_json("body", "struct<version:int,catalog:array<array<string>>,items:array<array<string>>>")
    good = documents.select("index_id", doc.alias("doc")).where((F.col("doc.version") == 1) & (F.size("doc.catalog") <= most_tags) & (F.size("doc.items") <= most_items))
    counted = F.transform("doc.catalog", lambda x, i: F.when((F.get(x, F.lit(0)) != "") & (F.get(x, F.lit(1)).try_cast("bigint") > 0), i.cast("bigint")))
    rows = good.select("index_id", F.array_compact(counted).alias("known"), F.posexplode("doc.items").alias("item", "x"))
    at = lambda i: F.get("x", F.lit(i))
    rows = rows.select("index_id", F.col("item").cast("bigint").alias("item"), F.size("x").alias("n"), at(0).alias("key"), F.lower(at(1)).alias("ext"), F.from_json(at(2), "array<bigint>").alias("tags"), "known")
    from ..functions.rules import MEDIA

    valid = (F.col("n") == 3) & F.col("key").startswith("gallery/") & F.col("ext").isin(*MEDIA) & (F.size("tags") <= most_of_item) & (F.size(F.array_except("tags", "known")) == 0)
    return rows.where(valid & F.col("tags").isNotNull()).select("index_id", "item", "key", "ext", "tags")


def source_list(documents: DataFrame) -> DataFrame:
    """(position, value) of a JSON list of names, or of an object with `sources`. Another shape raises."""
    body = F.col("body")
    found = F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(F.from_json(body, "struct<sources:array<string>>")["sources"])
    checked = F.when(found.isNull(), F.raise_error(F.lit("not a source list")).cast("array<string>")).otherwise(found)
    return documents.select("list_id", F.posexplode(checked).alias("position", "value"))


def latest_states(states: DataFrame) -> DataFrame:
    """The last state of each generation, by time and then sequence."""
    last = F.max_by(F.struct("status", "seq", "updated_at", "created_at"), F.struct(F.coalesce("updated_at", F.lit(-1)), "seq")).alias("s")
    return states.groupBy("generation").agg(last).select("generation", "s.*")


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows by key, later ones winning; `new` comes after `old`."""
    both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    last = F.max_by(F.struct("ext", "size"), F.struct("turn", "position")).alias("x")
    return both.groupBy("key").agg(last).select("key", "x.*")


def first_of_each(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row of least `order` of each group, by a partial aggregate, so a group of any size meets no single task."""
    others = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.min_by(F.struct(*others), order).alias("_x")).select(by, "_x.*").select(*df.columns)


def scanned_files(spark: SparkSession, folder: str, found: Callable[[DataFrame], DataFrame], at_once: int = 128) -> DataFrame:
    """found(files) of all files in the folders within `folder`; files: (path, modificationTime, length, content).

    `at_once` folders are scanned at a time, so the driver never holds the names of all files. A file counts as OPEN_COST bytes
    beside its own; as Spark counts 4 MB, tasks would hold few small files each.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    parts = sorted(x.getPath().toString() for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place) if x.isDirectory())
    files = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    was = spark.conf.get(_OPEN_COST, None)
    spark.conf.set(_OPEN_COST, str(OPEN_COST))
    try:
        done = [written(found(files(parts[k : k + at_once]))) for k in range(0, len(parts), at_once)]
    finally:
        spark.conf.unset(_OPEN_COST) if was is None else spark.conf.set(_OPEN_COST, was)
    return reduce(DataFrame.unionByName, done) if done else found(files([folder]))
