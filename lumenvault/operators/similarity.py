"""Hamming similarity join over banded hashes, and the scores of candidate pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut, dealt, ship

#: Limits and weights of the score rules.
STILL_PHASH, STILL_H256, CROP_PHASH, CROP_H256, MOVING_PHASH, TIMELINE, LEAST_SCORE = 10, 48, 7, 64, 12, 12.0, 0.76
LEAST_OVERLAP = 0.60
#: Fixed texts that say why a pair is an edge.
SAME_IMAGE, CROP, SAME_MOVING, EXCERPT = "same image after resize or recompression", "convincing crop or reframe", "same moving media after re-encode or resize", "strongly matched moving-media excerpt"
BANDS, WIDTH = 4, 16


def _ball(radius: int) -> list[int]:
    """Masks of all values of WIDTH bits with at most `radius` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(WIDTH), r)]


def _bands(hashes: DataFrame, radius: int, names: tuple[str, str]) -> DataFrame:
    value = [F.shiftrightunsigned("h", WIDTH * b).bitwiseAND(F.lit((1 << WIDTH) - 1)) for b in range(BANDS)]
    near = [F.struct(F.lit(b).alias("band"), v.alias("v")) for b, v in enumerate(value)]
    rows = hashes.select("h", F.inline(F.array(*near)))
    masks = F.array(*[F.lit(m).cast("bigint") for m in _ball(radius)])
    return rows.select(F.col("h").alias(names[0]), "band", F.explode(F.transform(masks, lambda m: F.col("v").bitwiseXOR(m))).alias(names[1]))


def near_hashes(left: DataFrame, right: DataFrame, radius: int, distance: int) -> DataFrame:
    """Pairs (x, y, d) of distinct hash values (column h) at `distance` bits or less, equal ones included.

    Complete if distance <= 4 * (radius + 1) - 1: then some band of 16 bits differs in `radius` bits
    at most. The radius is shared out: one side lists the values within half of it, the other within the rest.
    Both sides are dealt out: a hash becomes up to 548 rows, which Spark's sizes leave out.
    """
    if distance > BANDS * (radius + 1) - 1:
        raise ValueError("distance is beyond what the bands can find")
    a, b = _bands(left.distinct(), radius // 2, ("x", "k")), _bands(right.distinct(), radius - radius // 2, ("y", "k"))
    d = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return a.join(dealt(b), (a.band == b.band) & (a.k == b.k) & (d <= distance)).select("x", "y", d.alias("d")).distinct()


def classes(owners: DataFrame, radius: int, distance: int) -> DataFrame:
    """(key, h, copies, links) of owners (key, h) of one hash each: how many keys share the hash, and how many others
    are at `distance` or less. Copies are counted, never paired, so a hash of very many keys costs one row a near hash.
    """
    sizes = owners.groupBy("h").agg(F.count("*").alias("copies"))
    near = near_hashes(sizes.select("h"), sizes.select("h"), radius, distance).join(dealt(sizes.select(F.col("h").alias("y"), F.col("copies").alias("n"))), "y")
    links = near.groupBy(F.col("x").alias("h")).agg(F.sum("n").alias("links"))
    return owners.join(dealt(sizes.join(dealt(links), "h")), "h").select("key", "h", "copies", (F.col("links") - 1).alias("links"))


def pairs(left: DataFrame, right: DataFrame, radius: int, distance: int) -> DataFrame:
    """Pairs (a, b), a < b, of owners with near hashes, all of them; classes() has their number without listing copies.
    left and right: (key, h), a key may have several."""
    met = near_hashes(left.select("h"), right.select("h"), radius, distance)
    x, y = left.select(F.col("key").alias("kx"), F.col("h").alias("x")), right.select(F.col("key").alias("ky"), F.col("h").alias("y"))
    both = met.join(dealt(x), "x").join(dealt(y), "y").where("kx <> ky")
    return both.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b")).distinct()


def media_classes(prints: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """(key, class, evidence): media whose prints agree in all that edges depend on are a class, named by its least key.

    All members are linked to one another (evidence says as what) and have the same edges, so edges between the members that name a class stand for all,
    and a print of very many keys costs one row a key. Keys that an exclusion names are classes of their own, as their edges differ; so are
    moving media without a timeline, which have no edges.
    """
    text = lambda *cs: F.concat_ws("|", *[F.concat_ws(",", F.col(c).cast("array<string>")) if dict(prints.dtypes)[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cs])
    moving = F.when(F.size("timeline") > 0, text("phash", "hash256", "duration_ms", "frame_count", "timeline")).otherwise(F.concat(F.lit("alone|"), F.col("key")))
    media = prints.select("key", F.when(F.col("kind") == 1, F.concat(F.lit("still|"), text("phash", "hash256", "crop_hashes"))).otherwise(moving).alias("print"), F.when(F.col("kind") == 1, SAME_IMAGE).otherwise(SAME_MOVING).alias("evidence"))
    if exclusions is not None:
        named = exclusions.select(F.col("first_key").alias("key")).unionByName(exclusions.select(F.col("second_key").alias("key"))).distinct()
        alone = named.select("key", F.lit(True).alias("alone"))
        media = media.join(alone, "key", "left").select("key", F.when(F.col("alone"), F.concat("print", F.lit("|"), "key")).otherwise(F.col("print")).alias("print"), "evidence")
    first = media.groupBy("print").agg(F.min("key").alias("class"))
    return media.join(dealt(first), "print").select("key", "class", "evidence")


def still_classes(prints: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """media_classes() of stills: (key, class)."""
    return media_classes(prints.where("kind = 1"), exclusions).select("key", "class")


def class_graph(prints: DataFrame, exclusions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """media_classes(), and the edges between classes: all edges less exclusions, with no pair of one class listed."""
    members = cut(media_classes(prints, exclusions))
    first = cut(prints.join(dealt(members.where("key = class").select("key")), "key", "left_semi"))
    return members, cut(_edges(first, exclusions))


def still_candidates(prints: DataFrame) -> DataFrame:
    h = prints.where("kind = 1").select("key", F.col("phash").alias("h"))
    return pairs(h, h, 2, STILL_PHASH)


def crop_candidates(prints: DataFrame) -> DataFrame:
    h = prints.where("kind = 1").select("key", F.explode(F.array_distinct(F.concat("crop_hashes", F.array("phash")))).alias("h"))
    return pairs(h, h, 1, CROP_PHASH)


def moving_candidates(prints: DataFrame) -> DataFrame:
    h = prints.where("kind <> 1").select("key", F.col("phash").alias("h"))
    return pairs(h, h, 3, MOVING_PHASH)


def without_excluded(candidates: DataFrame, exclusions: DataFrame) -> DataFrame:
    return candidates.join(exclusions.select(F.col("first_key").alias("a"), F.col("second_key").alias("b")), ["a", "b"], "left_anti")


def _bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _with_prints(candidates: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs of unlike content with both fingerprints (structs l and r) and their distances p and h."""
    side = lambda key, name: prints.select(F.col("key").alias(key), F.struct("phash", "hash256", "crop_hashes", "kind", "sha256", "duration_ms", "frame_count", "timeline").alias(name))
    both = candidates.join(dealt(side("a", "l")), "a").join(dealt(side("b", "r")), "b").where("l.sha256 <> r.sha256 and (l.kind = 1) = (r.kind = 1)")
    wide = F.aggregate(F.zip_with("l.hash256", "r.hash256", _bits), F.lit(0), lambda z, x: z + x)
    return both.withColumn("p", _bits(F.col("l.phash"), F.col("r.phash"))).withColumn("h", wide)


def _bounded(score: Column) -> Column:
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 9)


def still_edges(candidates: DataFrame, prints: DataFrame) -> DataFrame:
    both = _with_prints(candidates, prints).where((F.col("l.kind") == 1) & (F.col("p") <= STILL_PHASH) & (F.col("h") <= STILL_H256))
    score = _bounded(1.0 - (0.55 * F.col("p") / 64.0 + 0.45 * F.col("h") / 256.0))
    return both.select("a", "b", score.alias("score"), F.lit(SAME_IMAGE).alias("evidence")).where(F.col("score") >= LEAST_SCORE)


def crop_edges(candidates: DataFrame, prints: DataFrame, still: DataFrame) -> DataFrame:
    """Pairs that are no still edge, by the nearest of: hash to crop, crop to hash, crop to crop (never hash to hash)."""
    both = _with_prints(candidates, prints).where((F.col("l.kind") == 1) & (F.col("h") <= CROP_H256)).join(dealt(still.select("a", "b")), ["a", "b"], "left_anti")
    l, r = F.col("l.crop_hashes"), F.col("r.crop_hashes")
    cross = F.flatten(F.transform(l, lambda x: F.transform(r, lambda y: _bits(x, y))))
    c = F.array_min(F.concat(cross, F.transform(r, lambda y: _bits(F.col("l.phash"), y)), F.transform(l, lambda x: _bits(x, F.col("r.phash")))))
    score = _bounded(0.96 - 0.45 * F.col("c") / 64.0 - 0.25 * F.col("h") / 256.0)
    return both.withColumn("c", c).where(F.col("c") <= CROP_PHASH).select("a", "b", score.alias("score"), F.lit(CROP).alias("evidence")).where(F.col("score") >= LEAST_SCORE)


def alignment_distance(first: np.ndarray, second: np.ndarray, ratio: float) -> float:
    """Least mean bit distance of the shorter series to a stretch of the longer one, whose length is about `ratio` of it."""
    short, long = (first, second) if len(first) <= len(second) else (second, first)
    if not len(short):
        return 64.0
    half_up = lambda x: np.floor(np.asarray(x) + 0.5).astype(np.int64)
    n, floor = len(long), min(2, len(long))
    expected = int(np.clip(half_up(n * ratio), floor, n))
    cost = np.bitwise_count(short[:, None] ^ long[None, :]).astype(np.float64)
    row, best = np.arange(len(short)), 64.0
    for length in range(max(floor, int(np.floor(expected * 0.82))), min(n, int(np.ceil(expected * 1.18))) + 1):
        at = np.minimum(length - 1, half_up(row * (length - 1) / max(1, len(short) - 1)))
        starts = np.arange(n - length + 1)
        best = min(best, cost[row[:, None], at[:, None] + starts].mean(0).min())
    return float(best)


@F.pandas_udf(T.DoubleType())
def _aligned(first: pd.Series, second: pd.Series, ratio: pd.Series) -> pd.Series:
    as_bits = lambda x: np.asarray(x if x is not None else [], np.int64).view(np.uint64)
    return pd.Series([alignment_distance(as_bits(a), as_bits(b), r) for a, b, r in zip(first, second, ratio)], dtype="float64")


def timeline_distance(first, second, ratio) -> Column:
    """alignment_distance() of columns: two arrays of frame hashes and the ratio of the durations."""
    ship(SparkSession.active())
    return _aligned(first, second, ratio)


def length_ratio() -> Column:
    """Of a pair (structs l and r): the shorter duration by the longer, of frame counts where a duration is missing, else 1."""
    part = lambda c: (F.col(f"l.{c}") > 0) & (F.col(f"r.{c}") > 0)
    ratio = lambda c: F.least(f"l.{c}", f"r.{c}") / F.greatest(f"l.{c}", f"r.{c}")
    return F.when(part("duration_ms"), ratio("duration_ms")).when(part("frame_count"), ratio("frame_count")).otherwise(1.0)


def moving_edges(candidates: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges of moving media. The cheap bounds come first, so only pairs that pass them are aligned."""
    both = _with_prints(candidates, prints).where((F.col("l.kind") != 1) & (F.col("p") <= MOVING_PHASH) & (F.col("h") <= CROP_H256))
    both = both.withColumn("ratio", length_ratio()).withColumn("t", timeline_distance("l.timeline", "r.timeline", "ratio"))
    good = (F.col("t") <= TIMELINE) & ((F.col("ratio") >= LEAST_OVERLAP) | (F.col("t") <= 0.65 * TIMELINE))
    score = _bounded(1.0 - 0.30 * F.col("p") / 64.0 - 0.25 * F.col("h") / 256.0 - 0.45 * F.col("t") / 64.0)
    return both.where(good).select("a", "b", score.alias("score"), F.when(F.col("ratio") < 0.9, EXCERPT).otherwise(SAME_MOVING).alias("evidence")).where(F.col("score") >= LEAST_SCORE)


def _edges(prints: DataFrame, exclusions: DataFrame | None) -> DataFrame:
    keep = (lambda c: without_excluded(c, exclusions)) if exclusions is not None else (lambda c: c)
    stills = cut(keep(still_candidates(prints).unionByName(crop_candidates(prints)).distinct()))
    still = cut(still_edges(stills, prints))
    return still.unionByName(crop_edges(stills, prints, still)).unionByName(moving_edges(keep(moving_candidates(prints)), prints))


def all_edges(prints: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Edges of all media, best first. Exclusions are taken out before any pair is scored."""
    return _edges(prints, exclusions).orderBy(F.desc("score"), "a", "b")
