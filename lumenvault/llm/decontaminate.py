"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, small, written

#: A run of this many consecutive item words is a hit; an item of fewer words is one window.
WINDOW = 13
#: Words of a k-gram. A window holds WINDOW - GRAM + 1 k-grams, and the least hash of each such run is kept.
GRAM = 5
#: Words beside a kept k-gram that a window with it can reach.
REACH = WINDOW - GRAM
#: Item fingerprints of this many bytes at most, as measured, are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Item fingerprints up to this number are also looked up before the join, so that few of the documents' leave their row.
LOOKUP_ROWS = 20_000
#: Words are runs of other characters than these: ASCII without digits and letters, A-Z lower-cased first.
GAPS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER = "".join(map(chr, range(0x41, 0x5B)))
#: A kept k-gram is one BIGINT: 33 bits of hash, then 30 bits of position, so least means leftmost on ties.
AT_BITS = 30
_MARKS = "array<struct<h:bigint,p:int,left:int,near:string>>"


def words_of(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + GAPS, _UPPER.lower() + " " * len(GAPS))
    return F.array_remove(F.split(plain, " "), "")


def winnowed(w: Column, among: list[int] | None = None) -> Column:
    """Structs (h, p, left, near) of the winnowed k-grams of an array of words; none for fewer than WINDOW words.

    near: the words within REACH of the k-gram at p (from 0), joined; left: how many come before it.
    among: the hashes that can match at all, if these are few enough to list.
    Each step is bound, so it is computed once a row and the work grows with the words.
    """
    n = F.size(w)
    at = lambda x: x.bitwiseAND(F.lit((1 << AT_BITS) - 1)).cast("int")
    first = lambda x: F.greatest(at(x) - REACH, F.lit(0))

    def grams(hw: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - GRAM),
            lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[F.get(hw, i + j) for j in range(GRAM)]), AT_BITS + 1), AT_BITS).bitwiseOR(i.cast("long")),
        )

    def least(g: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - REACH - 1), lambda i: F.least(*[F.get(g, i + j) for j in range(REACH + 1)])))

    def kept(m: Column) -> Column:
        if among is not None:
            m = F.filter(m, lambda x: F.shiftright(x, AT_BITS).isin(among))
        return F.transform(
            m,
            lambda x: F.struct(
                F.shiftright(x, AT_BITS).alias("h"),
                at(x).alias("p"),
                (at(x) - first(x)).alias("left"),
                F.array_join(F.slice(w, first(x) + 1, at(x) - first(x) + GRAM + REACH), " ").alias("near"),
            ),
        ).cast(_MARKS)

    made = bound(F.transform(w, lambda x: F.xxhash64(x)), lambda hw: bound(grams(hw), lambda g: bound(least(g), kept)))
    return F.when(n >= WINDOW, made).otherwise(F.array().cast(_MARKS))


def _phrase_hash(phrase: Column) -> Column:
    """Negative, so it differs from the hash of any k-gram."""
    return F.xxhash64(phrase).bitwiseOR(F.lit(-(1 << 63)))


def phrases(w: Column, m: int, among: list[int] | None = None) -> Column:
    """Structs (h, p, left, near) of all runs of m words: near is the run, left its number of words."""
    run = lambda i: F.struct(i.alias("i"), F.array_join(F.slice(w, i + 1, m), " ").alias("near"))
    mark = lambda x: F.struct(_phrase_hash(x["near"]).alias("h"), x["i"].alias("p"), F.lit(m).alias("left"), x["near"].alias("near"))
    found = F.transform(F.transform(F.sequence(F.lit(0), F.size(w) - m), run), mark)
    if among is not None:
        found = F.filter(found, lambda x: x["h"].isin(among))
    return F.when(F.size(w) >= m, found.cast(_MARKS)).otherwise(F.array().cast(_MARKS))


def _same(a: Column, b: Column) -> Column:
    """How many leading elements of two word arrays agree."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(equal, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(equal)).cast("int")


def _judged(docs: DataFrame, items: DataFrame, text: str, key: str, item_key: str, share: int) -> DataFrame:
    """One row per distinct (key, text) of `docs`: key, __th (hash of the text), __rows (how many rows it stands for) and the counts of contamination()."""
    bench = written(items.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0).distinct())
    phrase = F.array_join("w", " ")
    whole = F.array(F.struct(_phrase_hash(phrase).alias("h"), F.lit(0).alias("p"), F.size("w").alias("left"), phrase.alias("near"))).cast(_MARKS)
    marks = written(bench.select("item", F.inline(F.when(F.size("w") >= WINDOW, winnowed(F.col("w"))).otherwise(whole))).select("item", F.col("h").alias("ih"), F.col("left").alias("ileft"), F.col("near").alias("inear")))
    size = marks.count()
    listed = [r[0] for r in marks.select("ih").distinct().collect()] if size <= LOOKUP_ROWS else None
    long, short = ([h for h in listed if h >= 0], [h for h in listed if h < 0]) if listed is not None else (None, None)
    lengths = sorted(r[0] for r in bench.where(F.size("w") < WINDOW).select(F.size("w").alias("m")).distinct().collect())  # 12 numbers at most

    rows = docs.select(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__th"), words_of(F.col(text)).alias("w"))
    # one row for the document itself (p negative) and one for each of its fingerprints; where it goes in a shuffle follows from the document
    own = F.array(F.struct(F.xxhash64(key, "__th").alias("h"), F.lit(-1).alias("p"), F.lit(0).alias("left"), F.lit("").alias("near"))).cast(_MARKS)
    w = F.col("w")
    grams = rows.select(key, "__th", F.size("w").cast("long").alias("n_words"), F.inline(F.concat(own, winnowed(w, long), *[phrases(w, m, short) for m in lengths])))
    met = grams.join(small(marks, BROADCAST_BYTES), (F.col("h") == F.col("ih")) & (F.col("p") >= 0), "left").where("p < 0 or ih is not null")
    before = lambda x, left: F.reverse(F.slice(x, F.lit(1), left))
    after = lambda x, left: F.slice(x, left + 1, F.lit(GRAM + REACH))
    met = met.withColumn("dw", F.split("near", " ")).withColumn("iw", F.split("inear", " "))
    met = met.withColumn("a", _same(before(F.col("dw"), F.col("left")), before(F.col("iw"), F.col("ileft")))).withColumn("b", _same(after(F.col("dw"), F.col("left")), after(F.col("iw"), F.col("ileft"))))
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    run = F.when((F.col("p") >= 0) & (F.col("h") < 0) & (F.col("near") == F.col("inear")), span(F.col("p"), F.col("p") + F.col("left")))
    run = run.when((F.col("p") >= 0) & (F.col("h") >= 0) & (F.col("b") >= GRAM) & (F.col("a") + F.col("b") >= WINDOW), span(F.col("p") - F.col("a"), F.col("p") + F.col("b")))
    met = met.select(key, "__th", "n_words", (F.col("p") < 0).alias("own"), run.alias("run"), "item").where("own or run is not null")
    found = met.groupBy(key, "__th", "n_words").agg(F.count_if("own").alias("__rows"), F.collect_set("run").alias("runs"), F.collect_set(F.when(F.col("run").isNotNull(), F.col("item"))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(F.array_sort("runs"), zero, lambda z, r: F.struct(F.greatest(z["end"], r["e"]).alias("end"), (z["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(z["end"], r["s"]))).alias("n")))["n"].cast("long")
    out = found.select(key, "__th", "__rows", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", share: int = 20) -> DataFrame:
    """One row per row of `docs`: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Both sides keep the least k-gram hash of every run of WINDOW - GRAM + 1 k-grams, so a shared
    window shares a kept k-gram. Matches are extended word by word over the words that travel with
    it, so neither text is read again; a run of WINDOW words or more is a hit. An item of fewer words
    matches as a whole phrase. A document is contaminated if share * n_hit >= n_words and n_hit > 0.

    A null or wordless text has no words: n_words 0, not contaminated. Items with a null key or no
    words are left out; repeated items count once. Rows of `docs` are told apart by key and text, so
    nothing depends on where a row lies; repeated rows get a row each, null keys too. Only the named columns are read.
    """
    found = _judged(docs, items, text, key, item_key, share)
    return found.select(key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.explode(F.array_repeat(F.lit(0), F.col("__rows").cast("int"))).alias("__row")).drop("__row")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that are not contaminated; rows that share a key are judged each by its own text."""
    bad = written(_judged(docs.select(key, text), items, text, key, "item_id", 20).where("contaminated").select(F.col(key).alias("__k"), F.col("__th").alias("__t")))
    th = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs[key].eqNullSafe(bad["__k"]) & (th == bad["__t"]), "left_anti")
