"""Mixing sources to target weights, in DataFrame functions only.

Documents get hash-random keys and are sorted by them within their source, in ranges; prefix sums of their sizes come from the
sums of ranges; a source is cut exactly where its budget is reached. A budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered, running_sums
from .common import small, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Epochs that a source gives at most.
EPOCHS = 3
#: Documents a key range is meant to hold.
RANGE_ROWS = 10_000
#: Bits of a document's key.
KEY_BITS = 60
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text: Column) -> Column:
    """The number of words: each becomes one letter, blanks go, letters are counted; so memory grows with the text alone."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), _SPACES, "")).cast("long")


def draw(key: Column, text: Column) -> Column:
    """A number of KEY_BITS bits by a digest of key and text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_tag(source: Column) -> Column:
    """The source's name in an order where null comes last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """`sources` (src, source_size) with `target`: words to take of each.

    The sum of all sizes is shared by weight; no target is above `most` times its source's size, and what that leaves is shared
    among the others by weight. So a target is its weight times one level, or its ceiling; the level is the greatest of
    those that result if the sources whose ceilings are lowest for their weight are at their ceilings.
    """
    of = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        of = F.when((F.col("__place") - 1) % len(weights) == k, F.lit(w)).otherwise(of)
    scale = math.lcm(*weights)
    placed = numbered(sources, [F.col("src")], "__place").select("src", "source_size", of.cast("long").alias("w"), (F.col("source_size") * most).alias("ceiling"))
    placed = placed.withColumn("steep", F.call_function("div", F.col("ceiling") * scale, F.col("w")))
    total, shares = placed.agg(F.sum("source_size"), F.sum("w")).first()
    held = running_sums(placed, [F.col("steep"), F.col("src")], ceilings="ceiling", ws="w")
    level = held.agg(F.max((F.lit(total) - (F.col("ceilings") - F.col("ceiling"))) / (F.lit(shares) - (F.col("ws") - F.col("w"))))).first()[0]
    return placed.select("src", "source_size", F.least(F.col("ceiling").cast("double"), F.lit(level).cast("double") * F.col("w")).alias("target"))


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of `docs`: key, size, source_size, target, taken, and draw (its key in the order).

    size: words of the text, a null one has none. taken: words that the mix takes, repeats counted: whole epochs, then documents by
    their draw until the source's target, rounded to whole words, is reached; the last of them is taken in part. Rows that
    agree in key, source and text tie and are counted together before the sort, so very many copies meet in no task; each keeps a row.
    Equal inputs give equal results in any row order. An empty table gives an empty result. Other columns play no part.
    """
    rows = docs.select(source_tag(F.col(source)).alias("src"), F.col(key).alias("__id"), draw(F.col(key), F.col(text)).alias("draw"), words(F.col(text)).alias("size"))
    entries = written(rows.groupBy("src", "__id", "draw", "size").agg(F.count("*").alias("rows")).withColumn("weight", F.col("size") * F.col("rows")))
    plan = written(targets(written(entries.groupBy("src").agg(F.sum("weight").alias("source_size"))), weights, most))
    bits = max(0, math.ceil(math.log2(max(1, entries.count()) / RANGE_ROWS)))
    ranged = entries.withColumn("range", F.shiftright("draw", KEY_BITS - bits))
    sums = ranged.groupBy("src", "range").agg(F.sum("weight").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.call_function("div", budget, F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    starts = written(sums.select("src", "range", before.alias("start")).join(small(plan), "src").select("*", epochs.alias("epochs"), budget.alias("budget")))
    # sorted by range within the source, so the sums within a range need no further exchange
    upto = F.sum("weight").over(Window.partitionBy("src", "range").orderBy("draw", "__id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = ranged.repartitionByRange("src", "range").select("*", (upto - F.col("weight")).alias("upto"))
    met = summed.join(small(starts), ["src", "range"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
    ahead = F.col("start") + F.col("upto") + F.col("copy") * F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - ahead))
    return met.select(F.col("__id").alias(key), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "draw", "src")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: (key, source, epoch, text), a row for each time that a document is taken; the one at the cut has its first words only."""
    plan = planned(docs, weights, most, text, key, source).where("taken > 0").groupBy("src", F.col(key).alias("__id"), "draw", "size").agg(F.sum("taken").alias("__words"))
    own = docs.select(F.col(key).alias("__key"), F.col(source).alias("__source"), F.col(text).alias("__text"), source_tag(F.col(source)).alias("__src"), draw(F.col(key), F.col(text)).alias("__draw")).dropDuplicates(["__src", "__key", "__draw"])
    met = own.join(plan, (F.col("src") == F.col("__src")) & (F.col("draw") == F.col("__draw")) & F.col("__id").eqNullSafe(F.col("__key")))
    times = met.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.call_function("div", F.col("__words") + F.col("size") - 1, F.col("size")))).alias("epoch"))
    left = F.least(F.col("size"), F.col("__words") - (F.col("epoch") - 1) * F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all("__text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), left.cast("int")), "")
    return times.select(F.col("__key").alias(key), F.col("__source").alias(source), "epoch", F.when(left == F.col("size"), F.col("__text")).otherwise(head).alias(text))
