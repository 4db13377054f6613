"""A stored index of hashes: new ones are compared with all without dealing out the stored ones again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, small, written
from .similarity import BANDS, WIDTH, _bands, near_hashes


class HashIndex:
    """Distinct 64-bit hashes as a bucketed table of (slot, h): a row for each band value within half the radius of the hash's own.

    A slot is a band and its value. The table is dealt by slot once, when hashes are put in; a comparison deals out the
    new hashes alone and joins them bucket by bucket.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, radius: int, buckets: int = 32):
        """The index in the folder `path`, which need not exist, under a table name of this session; radius and buckets stay as they were when it was begun."""
        self.spark, self.table, self.radius, self.buckets = spark, table, radius, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (slot BIGINT, h BIGINT) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {buckets} BUCKETS LOCATION '{path}'")

    def _slots(self, hashes: DataFrame, radius: int, name: str) -> DataFrame:
        return _bands(hashes, radius, (name, "k")).select((F.col("band") * (1 << WIDTH) + F.col("k")).cast("long").alias("slot"), name)

    def put(self, hashes: DataFrame) -> None:
        """Adds those of `hashes` (h) that are not in the index; a put that is tried again adds nothing."""
        fresh = written(hashes.select("h").distinct().join(self.stored(), "h", "left_anti"))
        self._slots(fresh, self.radius // 2, "h").repartition(self.buckets, "slot").write.insertInto(self.table)
        discard(fresh)

    def stored(self) -> DataFrame:
        """(h) of the index: each once, from the slots that hold it unchanged in its first band."""
        return self.spark.table(self.table).where(F.col("slot") == F.col("h").bitwiseAND(F.lit((1 << WIDTH) - 1))).select("h")

    def near(self, hashes: DataFrame, distance: int, most: int = 8 << 20) -> DataFrame:
        """Pairs (x, y, d) of `hashes` (h, as x) with those of the index at `distance` bits or less.

        Band values of new hashes that take `most` bytes at most, as measured, are sent to all; more are dealt out to the buckets.
        """
        if distance > BANDS * (self.radius + 1) - 1:
            raise ValueError("distance is beyond what the bands can find")
        asked = small(written(self._slots(hashes.select("h").distinct(), self.radius - self.radius // 2, "x")), most)
        stored = self.spark.table(self.table).select("slot", F.col("h").alias("y"))
        d = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
        return asked.join(stored.hint("merge"), "slot").where(d <= distance).select("x", "y", d.alias("d")).distinct()

    def near_new(self, hashes: DataFrame, distance: int) -> DataFrame:
        """near() and the pairs among `hashes` themselves: what they add to the pairs of the index."""
        return self.near(hashes, distance).unionByName(near_hashes(hashes.select("h"), hashes.select("h"), self.radius, distance)).distinct()
