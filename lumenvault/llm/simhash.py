"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, components, dealt, written

#: A bucket with more fingerprints than this is linked through midpoints instead of pair by pair.
HOT_BUCKET = 1000
#: Shingles hashed at a time.
BLOCK = 1 << 16


def simhash(text: str, words: int = 4) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half of the shingle hashes; no words give 0."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(first[at : at + BLOCK], last[at : at + BLOCK])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4) -> DataFrame:
    """`docs` with `fp`: the fingerprint's 64 bits as a BIGINT. A null text has no words; an `fp` of `docs` is replaced."""

    def build():
        return lambda texts: [(fp - (1 << 64) if fp >> 63 else fp,) for fp in (simhash(t, words) for t in texts)]

    return append_columns(docs, text, [T.StructField("fp", T.LongType())], build)


def _ball(word, bits: int, offset: int):
    """Structs (flip, key) of a 32-bit segment value and its one-bit neighbours; flip -1 is the value itself."""
    return F.array(*[F.struct(F.lit(j - offset if j >= 0 else -1).alias("flip"), (word.bitwiseXOR(F.lit(1 << j)) if j >= 0 else word).alias("key")) for j in range(-1, bits)])


def links(fps: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all those at distance 4 or less.

    With distance 4 or less, the high halves differ in at most 2 bits or the low halves in at most 1.
    High halves: both sides list the one-bit ball, so halves 2 apart meet at a midpoint. Low halves:
    one side lists the ball, the other its value. A pair meets in one bucket of each half only (the
    rule on flips), and the join condition verifies the whole distance. In a bucket of more than
    `hot` fingerprints pairs are not listed: its members list all values within 2 bits of the
    whole fingerprint, and members that share such a value (so are within 4) link to its smallest.
    Both sides are dealt out, as a fingerprint becomes up to 66 rows (2081 at midpoints), which Spark's sizes leave out.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    top = fps.select("fp", F.lit(0).alias("seg"), F.inline(_ball(high, 32, 0)))
    probe = fps.select("fp", F.lit(1).alias("seg"), F.inline(_ball(low, 32, 0)))
    held = fps.select("fp", F.lit(1).alias("seg"), F.lit(-1).alias("flip"), low.alias("key"))
    left, right = top.unionByName(probe), top.unionByName(held)
    full = written(right.groupBy("seg", "key").count().where(F.col("count") > hot).select("seg", "key"))
    many = full.limit(1).count()
    if many:
        members = right.join(full, ["seg", "key"], "left_semi").select("fp").unionByName(left.join(full, ["seg", "key"], "left_semi").select("fp")).distinct()
        left, right = (x.join(full, ["seg", "key"], "left_anti") for x in (left, right))
    x, y = left.select("seg", "key", F.col("fp").alias("a"), F.col("flip").alias("ia")), right.select("seg", "key", F.col("fp").alias("b"), F.col("flip").alias("ib"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 4
    once = ((F.col("x.seg") == 0) & (F.col("a") < F.col("b")) & ((F.col("ia") < F.col("ib")) | ((F.col("ia") == -1) & (F.col("ib") == -1)))) | ((F.col("x.seg") == 1) & (F.col("a") != F.col("b")) & ((F.col("ia") >= 0) | (F.col("a") < F.col("b"))))
    edges = x.alias("x").join(dealt(y.alias("y")), (F.col("x.seg") == F.col("y.seg")) & (F.col("x.key") == F.col("y.key")) & once & near).select("a", "b")
    return edges.unionByName(midpoint_links(written(members))) if many else edges


def midpoint_links(members: DataFrame) -> DataFrame:
    """Star edges (a, b) that connect all `members` (fp) at distance 4 or less, without listing pairs."""
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j))
    masks = F.concat(F.array(F.lit(0).cast("long")), one, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))))
    near = members.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    least = written(near.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a"))
    return near.join(dealt(least), "mid").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def _classes(fps: DataFrame, hot: int) -> DataFrame:
    """(fp, class) of every row of `fps`: the least fingerprint that each one reaches."""
    groups = components(links(fps, hot)).select(F.col("node").alias("fp"), F.col("component").alias("class"))
    return written(fps.select("fp").join(dealt(groups), "fp", "left").select("fp", F.coalesce("class", "fp").alias("class")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT_BUCKET) -> DataFrame:
    """(key, fp, component_id) for every row of `docs`; component_id is the smallest key reachable.

    Copies share a fingerprint, so links are sought between distinct fingerprints only. A null text
    has no words and the fingerprint 0; empty texts link like any other. A null key stays null and names
    no group: component_id is null where all keys of a group are. Repeated rows each keep their row.
    Other columns play no part. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    marked = written(fingerprints(rows, "__text").select("__id", "fp"))
    fps = written(marked.groupBy("fp").agg(F.min("__id").alias("least")))
    classes = _classes(fps, hot)
    names = classes.join(fps, "fp").groupBy("class").agg(F.min("least").alias("component_id"))
    named = written(classes.join(names, "class").select("fp", "component_id"))
    return marked.join(named, "fp").select(F.col("__id").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT_BUCKET) -> DataFrame:
    """One document of each near-duplicate group: that of the least key, and of the least text hash among rows that share it.

    Unlike texts under one key are documents of their own, so none is lost. A null key orders after all
    others. Rows that agree in key and text are one document, of which any row stays.
    """
    of = lambda c: (F.col(key).isNull().alias("__null"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("__k"), F.xxhash64(F.coalesce(F.col(c), F.lit(""))).alias("__th"))
    rows = docs.select(*of(text), F.col(text).alias("__text"))
    marked = written(fingerprints(rows, "__text").select("__null", "__k", "__th", "fp"))
    first = written(marked.groupBy("fp").agg(F.min(F.struct("__null", "__k", "__th")).alias("first")))
    stay = written(_classes(first, hot).join(first, "fp").groupBy("class").agg(F.min("first").alias("first")).select("first.*"))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *of(text)).join(stay, ["__null", "__k", "__th"], "left_semi")
    return kept.dropDuplicates(["__null", "__k", "__th"]).select(*[f"`{c}`" for c in docs.columns])
