"""Picks from a selection by several terms, over bitmaps: matches are counted and picked, never listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .ordering import numbered

#: Bytes and bits of a bitmap, as Spark's bitmap functions make them.
BYTES = 4096
BITS = 8 * BYTES
_BLOCK = 64


def posting_lists(terms: DataFrame) -> DataFrame:
    """(term, segment, bits) from rows (term, pos), pos from 1: for each term and run of BITS positions that has any of its items, a bitmap of them.

    A list is as many rows as it has such runs, made from partial bitmaps, so a term that most items have meets no single task.
    """
    return terms.groupBy("term", F.bitmap_bucket_number("pos").alias("segment")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits"))


def intersected(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(terms, segment, bits, n) for each distinct array in `terms` of `sets`: the bitmap of the items that have all its terms, and their number; runs without any are left out.

    A set looks only at the runs of its rarest term, the one with the fewest.
    """
    distinct = cut(sets.select("terms").distinct())
    runs = lists.groupBy("term").agg(F.count("*").alias("runs"))
    each = distinct.select("terms", F.explode("terms").alias("term"))
    rarest = each.join(runs, "term", "left").groupBy("terms").agg(F.min_by("term", F.struct(F.coalesce("runs", F.lit(0)), "term")).alias("term"))
    seen = lists.select("term", "segment").join(rarest, "term").select("terms", "segment")
    wanted = seen.select("terms", "segment", F.explode("terms").alias("term"))
    met = wanted.join(lists, ["term", "segment"]).groupBy("terms", "segment").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("have"))
    return met.where(F.col("have") == F.size("terms")).select("terms", "segment", "bits", F.bitmap_count("bits").alias("n")).where("n > 0")


def nth_bit(bits: Column, n: Column) -> Column:
    """Position (from 0) of the n-th set bit (from 1) of a bitmap: by the counts of its blocks, of the bytes of a block and of the bits of a byte."""

    def find(counts: Column, of: Column) -> Column:
        start = F.struct(of.cast("long").alias("left"), F.lit(0).alias("at"), F.lit(False).alias("found"))
        return F.aggregate(counts, start, lambda z, x: F.when(z["found"], z).when(z["left"] <= x, F.struct(z["left"].alias("left"), z["at"].alias("at"), F.lit(True).alias("found"))).otherwise(F.struct((z["left"] - x).alias("left"), (z["at"] + 1).alias("at"), F.lit(False).alias("found"))))

    def counts_of(start: Column, step: int, many: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.bitmap_count(F.substring(bits, start + i * step + 1, F.lit(step))))

    one = lambda x: F.conv(F.hex(x), 16, 10).cast("int")
    block = find(counts_of(F.lit(0), _BLOCK, BYTES // _BLOCK), n)
    byte = _bound(block, lambda b: _bound(find(counts_of(b["at"] * _BLOCK, 1, _BLOCK), b["left"]), lambda y: F.struct((b["at"] * _BLOCK + y["at"]).alias("at"), y["left"].alias("left"))))

    def bit(y: Column) -> Column:
        value = one(F.substring(bits, y["at"] + 1, F.lit(1)))
        flags = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.call_function("shiftright", value, k).bitwiseAND(F.lit(1)).cast("long"))
        return y["at"] * 8 + find(flags, y["left"])["at"]

    return _bound(byte, bit)


def _bound(value: Column, make) -> Column:
    """make(value) with `value` computed once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def picked(items: DataFrame, terms: DataFrame, requests: DataFrame, seed: str) -> DataFrame:
    """(request, key, total) per request (request, terms): one of the items that have all its terms, uniform by digest, and how many have them.

    items: (item, key), an item once; terms: (item, term); a request's terms are an array of one term at least. Items are
    numbered by a digest of `item`; a request draws a number below the total of its terms and meets the one run of positions
    that holds it, then the one item; so neither matches nor pairs of items and requests are listed. Requests that nothing matches are left out.
    """
    ordered = numbered(items.select("item", "key", F.sha2(F.col("item").cast("string"), 256).alias("__ord")), [F.col("__ord"), F.col("item")])
    ordered = cut(ordered.drop("__ord"))
    lists = cut(posting_lists(terms.distinct().join(ordered.select("item", "pos"), "item").select("term", "pos")))
    asked = cut(requests.select("request", F.array_sort(F.array_distinct("terms")).alias("terms")))
    found = cut(intersected(lists, asked))
    before = F.sum("n").over(Window.partitionBy("terms").orderBy("segment")) - F.col("n")
    runs = cut(found.select("terms", "segment", "n", before.alias("before")))
    totals = cut(runs.groupBy("terms").agg(F.sum("n").alias("total"), F.count("*").alias("runs")))
    # ranks are dealt in pages of about one run each, so a request meets few runs and the requests for one set many pages
    size = F.ceil(F.col("total") / F.col("runs"))
    pages = runs.join(totals, "terms").select("terms", "segment", "n", "before", F.explode(F.sequence(F.floor(F.col("before") / size), F.floor((F.col("before") + F.col("n") - 1) / size))).alias("page"))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws("\0", F.lit(seed), F.col("request").cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    draws = asked.join(totals, "terms").select("request", "terms", "total", (drawn % F.col("total")).alias("rank"), F.floor((drawn % F.col("total")) / size).alias("page"))
    met = draws.join(pages, ["terms", "page"]).where("rank >= before and rank < before + n").select("request", "terms", "total", "segment", (F.col("rank") - F.col("before") + 1).alias("nth"))
    chosen = met.join(found.select("terms", "segment", "bits"), ["terms", "segment"]).select("request", "total", ((F.col("segment") - 1) * BITS + nth_bit(F.col("bits"), F.col("nth")) + 1).alias("pos"))
    return chosen.join(ordered.select("pos", "key"), "pos").select("request", "key", "total")
