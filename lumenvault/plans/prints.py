"""Fingerprint, frame and pixel tables derived from `embeddings`, for Spark and (as SQL) for the oracle.

Bit i of a hash is set where the i-th of 64 values exceeds the median. Near copies are planted: copies
of even vectors differ in an even number of bits, second copies in an odd one, so all limits occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ship
from .fixtures import derived

STEP = 1234567891011

#: Bit number {0} as BIGINT; shifts to the sign are refused by the oracle's engine.
_POWER = "CASE WHEN {0} = 63 THEN (-9223372036854775807 - 1) ELSE 1::BIGINT << least({0}, 62)::BIGINT END"

SQL = f"""
SELECT *, 'gallery/v' || CAST(base AS STRING) || '-' || CAST(copy AS STRING) || CASE WHEN kind = 1 THEN '.jpg' ELSE '.mp4' END AS key, 1000 + id % 5000 AS size, sha256('v' || CAST(id AS STRING)) AS sha256,
 [phash, phash, phash, phash] AS hash256, CAST(64 + id % 1000 AS INT) AS width, CAST(48 + id % 700 AS INT) AS height, 'w-' || CAST(id AS STRING) AS file_id,
 CASE WHEN kind = 1 OR base % 9 = 0 THEN NULL WHEN copy > 0 AND base % 4 = 0 THEN 6000 ELSE 10000 END AS duration_ms, CAST(CASE WHEN kind = 1 THEN NULL WHEN copy > 0 AND base % 4 = 0 THEN 29 ELSE 48 END AS BIGINT) AS frame_count,
 list_transform(range(1, 8), lambda k: CASE WHEN k = 1 AND copy > 0 AND base % 5 = 0 THEN basehash ELSE xor(phash, k * {STEP}) END) AS crop_hashes,
 CASE WHEN kind = 1 THEN NULL WHEN copy > 0 AND base % 4 = 0 THEN list_transform(range(10, 39), lambda i: xor(phash, (1::BIGINT << (i % 32)))) ELSE list_transform(range(0, 48), lambda i: xor(phash, (1::BIGINT << (i % 32)))) END AS timeline
FROM (
 SELECT base, copy, basehash, base * 3 + copy AS id, CASE WHEN base % 14 = 0 AND copy = 1 THEN 4 - k0 ELSE k0 END AS kind,
  xor(basehash, CAST(coalesce(list_sum(list_transform(range(0, CASE copy WHEN 0 THEN 0 WHEN 1 THEN base % 18 ELSE (base + 1) % 18 END), lambda j: {_POWER.format('((base * 7 + 5 * j) % 64)')})), 0) AS BIGINT)) AS phash
 FROM (SELECT vec_id AS base, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 3 END AS k0,
   CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1]::DOUBLE > med THEN {_POWER.format('i')} ELSE 0 END)) AS BIGINT) AS basehash
   FROM (SELECT vec_id, embedding, (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 AS med FROM embeddings) e) b
 CROSS JOIN (SELECT unnest([0, 1, 2]) AS copy) c WHERE copy = 0 OR base % 2 = 0) p
"""


def _bit(at):
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An original (copy 0) of each vector and two copies of each even one. Ids and keys say both, so they are distinct for any number of vectors."""
    e = derived(spark, sf_dir, "embeddings")
    ordered = F.sort_array("embedding")
    med = (F.get(ordered, F.lit(31)).cast("double") + F.get(ordered, F.lit(32)).cast("double")) / 2
    e = e.select("vec_id", "embedding", med.alias("med"))
    bits = F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(x.cast("double") > F.col("med"), _bit(i)).otherwise(F.lit(0).cast("bigint")))
    b = e.select(F.col("vec_id").alias("base"), F.when(F.col("vec_id") % 3 != 0, 1).otherwise(3).alias("k0"), F.aggregate(bits, F.lit(0).cast("bigint"), lambda z, x: z.bitwiseOR(x)).alias("basehash"))
    p = b.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy")).where("copy = 0 or base % 2 = 0")
    flips = F.when(F.col("copy") == 0, 0).when(F.col("copy") == 1, F.col("base") % 18).otherwise((F.col("base") + 1) % 18).cast("int")
    masks = F.when(flips > 0, F.transform(F.sequence(F.lit(0), flips - 1), lambda j: _bit((F.col("base") * 7 + 5 * j) % 64)))
    p = p.select("base", "copy", "basehash", (F.col("base") * 3 + F.col("copy")).alias("id"), F.when((F.col("base") % 14 == 0) & (F.col("copy") == 1), 4 - F.col("k0")).otherwise(F.col("k0")).alias("kind"), F.coalesce(F.aggregate(masks, F.lit(0).cast("bigint"), lambda z, x: z.bitwiseOR(x)), F.lit(0).cast("bigint")).alias("flip"))
    p = p.withColumn("phash", F.col("basehash").bitwiseXOR(F.col("flip")))
    short = (F.col("copy") > 0) & (F.col("base") % 4 == 0)
    line = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.col("phash").bitwiseXOR(_bit(i % 32)))
    crops = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.when((k == 1) & (F.col("copy") > 0) & (F.col("base") % 5 == 0), F.col("basehash")).otherwise(F.col("phash").bitwiseXOR(k.cast("bigint") * STEP)))
    return p.select(
        "base", "copy", "id", "kind", "phash", F.concat(F.lit("gallery/v"), F.col("base").cast("string"), F.lit("-"), F.col("copy").cast("string"), F.when(F.col("kind") == 1, ".jpg").otherwise(".mp4")).alias("key"),
        (1000 + F.col("id") % 5000).alias("size"), F.sha2(F.concat(F.lit("v"), F.col("id").cast("string")), 256).alias("sha256"), F.array(*["phash"] * 4).alias("hash256"),
        (64 + F.col("id") % 1000).cast("int").alias("width"), (48 + F.col("id") % 700).cast("int").alias("height"),
        F.concat(F.lit("w-"), F.col("id").cast("string")).alias("file_id"), F.when((F.col("kind") == 1) | (F.col("base") % 9 == 0), None).when(short, 6000).otherwise(10000).alias("duration_ms"),
        F.when(F.col("kind") == 1, None).when(short, 29).otherwise(48).cast("long").alias("frame_count"), crops.alias("crop_hashes"), F.when(F.col("kind") == 1, None).when(short, line(10, 38)).otherwise(line(0, 47)).alias("timeline"),
    )


def rated(found: DataFrame) -> DataFrame:
    """(key, quality) of the fingerprinted objects."""
    from ..functions.rules import extension_of, survivor_quality

    c = F.col
    return found.select("key", survivor_quality(c("width"), c("height"), c("duration_ms"), c("kind"), extension_of(c("key")), c("size")).alias("quality"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, frame_index, timestamp_ns, h, total_ns): 96 frames of each moving original, unevenly timed."""
    p = prints(spark, sf_dir).where("kind = 3 and copy = 0")
    f = p.select("key", "id", "phash", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(95).cast("bigint"))).alias("frame_index"))
    time = F.col("frame_index") * 100_000_000 + (F.col("frame_index") * F.col("frame_index") * 7919) % 90_000_000
    return f.select("key", "frame_index", time.alias("timestamp_ns"), F.col("phash").bitwiseXOR(_bit((F.col("frame_index") * (F.col("id") % 7 + 1)) % 64)).alias("h"), F.lit(10_000_000_000).alias("total_ns"))


def wide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames() with hashes of 256 bits (h256, four words) and crop hashes."""
    step = lambda k: F.col("h").bitwiseXOR(k.cast("bigint") * STEP)
    series = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), step)
    return frames(spark, sf_dir).select("*", series(0, 3).alias("h256"), series(1, 7).alias("crops"))


FRAMES_SQL = f"""
SELECT key, frame_index, frame_index * 100000000 + (frame_index * frame_index * 7919) % 90000000 AS timestamp_ns, xor(phash, {_POWER.format('((frame_index * (id % 7 + 1)) % 64)')}) AS h, 10000000000 AS total_ns
FROM (SELECT key, id, phash, unnest(range(0, 96)) AS frame_index FROM ({SQL}) q WHERE kind = 3 AND copy = 0) f
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, width, height, pixels): each vector as an 8 x 8 image of 0..255, every value a block of 8 x 8 pixels."""
    return _drawn(derived(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("key"), "embedding"))


def frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames() without hashes, every fifth vector's as of a GIF."""
    f = frames(spark, sf_dir)
    base = F.regexp_extract("key", r"v([0-9]+)-", 1).cast("long")
    return f.select("key", "frame_index", "timestamp_ns", "total_ns", F.lit(100_000_000).alias("duration_ns"), F.when(base % 5 == 0, "gif").otherwise("video").alias("way"))


def stored_frames(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """(key, frame_index, width, height, pixels) of all frames, written in folders by frame_index: the vector, turned by frame_index values, as an image of 16 x 16 pixels."""
    import numpy as np
    import pandas as pd

    def work(batches):
        for pdf in batches:
            out = []
            for x, turn in zip(pdf.embedding, pdf.frame_index):
                v = np.roll(np.asarray(x, np.float64), int(turn)).reshape(8, 8)
                out.append(np.kron(np.floor((v - v.min()) / (np.ptp(v) or 1.0) * 255), np.ones((2, 2))).astype(np.uint8).tobytes())
            yield pd.DataFrame({"key": pdf.key, "frame_index": pdf.frame_index, "width": 16, "height": 16, "pixels": out}).astype({"width": "int32", "height": "int32"})

    ship(spark)
    kept = prints(spark, sf_dir).where("kind = 3 and copy = 0").select("base", "key")
    rows = kept.join(derived(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("base"), "embedding"), "base")
    rows = rows.select("key", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(95).cast("bigint"))).alias("frame_index"))
    rows.mapInPandas(work, "key string, frame_index long, width int, height int, pixels binary").repartition("frame_index").write.partitionBy("frame_index").parquet(path)
    return spark.read.schema("key string, width int, height int, pixels binary, frame_index long").parquet(path)


def vectors(spark: SparkSession, sf_dir: str) -> int:
    return derived(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]


def object_pixels(keys: DataFrame, sf_dir: str, count: int) -> DataFrame:
    """The images of objects by key (as in pixels()): the number in a key, modulo the `count` of vectors, is its vector."""
    e = derived(keys.sparkSession, sf_dir, "embeddings").select("vec_id", "embedding")
    number = F.regexp_extract("key", r"([0-9]+)[.][^.]*$", 1).cast("bigint")
    return _drawn(keys.withColumn("vec_id", number % F.lit(count)).join(e, "vec_id").select("key", "embedding"))


def _drawn(vectors: DataFrame) -> DataFrame:
    import numpy as np
    import pandas as pd

    def work(batches):
        for pdf in batches:
            out = []
            for x in pdf.embedding:
                v = np.asarray(x, np.float64).reshape(8, 8)
                g = np.floor((v - v.min()) / (np.ptp(v) or 1.0) * 255)
                out.append(np.kron(g, np.ones((8, 8))).astype(np.uint8).tobytes())
            yield pd.DataFrame({"key": pdf.key, "width": 64, "height": 64, "pixels": out}).astype({"width": "int32", "height": "int32"})

    ship(vectors.sparkSession)
    return vectors.mapInPandas(work, "key string, width int, height int, pixels binary")
