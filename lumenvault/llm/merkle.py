"""Merkle fingerprints of documents over sections, paragraphs and phrases, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

#: A section ends with a blank line, a paragraph with its line, a phrase with its sentence or after eight words.
#: The pieces of each level, put together, give the text again.
SECTION = r"(?s).+?(?:\n\n+|\z)"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
PHRASE = r"(?:[^ \t\r\n]*[^ \t\r\n.!?][ \t\r\n]+){0,7}(?:[^ \t\r\n]+[ \t\r\n]*|[ \t\r\n]+)"
LEAF = r"\.([0-9a-f]{12})"
#: Documents that are put in order together, and key ranges at most (their bounds go to the driver). Beyond
#: BUCKET_ROWS * MOST_BUCKETS documents the ranges grow; each is sorted by Spark, which spills, so results are the same.
BUCKET_ROWS = 1024
MOST_BUCKETS = 4096


def tree(text: Column) -> Column:
    """Sections as structs (d, ps), paragraphs as structs (d, ls); d and the leaves in ls are SHA-256 digests."""
    pieces = lambda x, pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    leaves = lambda p: F.transform(pieces(p, PHRASE), lambda s: F.sha2(s, 256))
    node = lambda ls: F.struct(F.sha2(F.array_join(ls, ""), 256).alias("d"), ls.alias("ls"))
    paragraphs = lambda s: F.transform(F.transform(pieces(s, PARAGRAPH), leaves), node)
    return F.transform(F.transform(pieces(text, SECTION), paragraphs), lambda ps: F.struct(F.sha2(F.array_join(ps["d"], ""), 256).alias("d"), ps.alias("ps")))


def written_tree(sections: Column) -> Column:
    """The fingerprint: the root digest, then per section `/` and its digest, per paragraph `;`, per phrase `.`, cut short."""
    leaf = lambda x: F.concat(F.lit("."), F.substring(x, 1, 12))
    paragraph = lambda p: F.concat(F.lit(";"), F.substring(p["d"], 1, 16), F.array_join(F.transform(p["ls"], leaf), ""))
    section = lambda s: F.concat(F.lit("/"), F.substring(s["d"], 1, 16), F.array_join(F.transform(s["ps"], paragraph), ""))
    return F.concat(F.sha2(F.array_join(sections["d"], ""), 256), F.array_join(F.transform(sections, section), ""))


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the fingerprint of a string column. Null counts as empty. Equal texts and only those share a root.

    A column of the name `out` is replaced; others pass through.
    """
    return df.withColumn("__tree", tree(F.coalesce(F.col(text), F.lit("")))).withColumn(out, written_tree(F.col("__tree"))).drop("__tree")


def leaves_of(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(print_, F.lit(LEAF), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of phrase digests that two fingerprints have in common, 0 to 1 (Dice); 1 for equal ones.

    a and b: arrays from leaves_of().
    """
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def _level(a: Column, b: Column, deeper, place):
    """Compares two arrays of subtrees: without a common head and tail of equal ones, what is left was changed.

    One subtree left on each side: deeper(i, x, y) looks into it; else place(i, removed, added) says where.
    """
    least = F.least(F.size(a), F.size(b))
    unlike = lambda i: F.get(a, i) != F.get(b, i)
    heads = F.sequence(F.lit(0), least - 1)
    head = F.when(least == 0, 0).otherwise(F.coalesce(F.get(F.filter(heads, unlike), F.lit(0)), least))

    def from_head(i: Column) -> Column:
        tails = F.sequence(F.lit(0), least - i - 1)
        apart = F.filter(tails, lambda k: F.get(a, F.size(a) - 1 - k) != F.get(b, F.size(b) - 1 - k))
        tail = F.when(least == i, 0).otherwise(F.coalesce(F.get(apart, F.lit(0)), least - i))

        def judged(k: Column) -> Column:
            removed, added = F.size(a) - i - k, F.size(b) - i - k
            here = place(i, removed, added)
            return here if deeper is None else F.when((removed == 1) & (added == 1), deeper(i, F.get(a, i), F.get(b, i))).otherwise(here)

        return bound(tail, judged)

    return bound(head, from_head)


def differing(a: Column, b: Column) -> Column:
    """Where fingerprint `b` differs from `a`: struct (level, section, paragraph, phrase, removed, added), null if they are equal.

    Equal roots end the search; else it descends by digests as long as one branch alone differs, and names the
    first changed child there and how many children of `a` gave way to how many of `b`: removals have added 0,
    insertions removed 0. Numbers start at 0 and are null below the level named.
    """
    children = lambda x, sign: F.slice(F.split(x, sign), F.lit(2), F.size(F.split(x, sign)))
    none = F.lit(None).cast("int")

    def named(level: str, section: Column, paragraph: Column, phrase: Column, removed: Column, added: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), section.cast("int").alias("section"), paragraph.cast("int").alias("paragraph"), phrase.cast("int").alias("phrase"), removed.cast("int").alias("removed"), added.cast("int").alias("added"))

    def in_paragraph(s: Column, p: Column, x: Column, y: Column) -> Column:
        return _both(children(x, r"\."), children(y, r"\."), lambda xs, ys: _level(xs, ys, None, lambda i, r, n: named("phrase", s, p, i, r, n)))

    def in_section(s: Column, x: Column, y: Column) -> Column:
        return _both(children(x, ";"), children(y, ";"), lambda xs, ys: _level(xs, ys, lambda p, u, v: in_paragraph(s, p, u, v), lambda i, r, n: named("paragraph", s, i, none, r, n)))

    whole = _both(children(a, "/"), children(b, "/"), lambda xs, ys: _level(xs, ys, in_section, lambda i, r, n: named("section", i, none, none, r, n)))
    return F.when(F.substring(a, 1, 64) != F.substring(b, 1, 64), whole)


def written_place(place: Column) -> Column:
    text = lambda x: F.concat_ws(":", x["level"], x["section"].cast("string"), x["paragraph"].cast("string"), x["phrase"].cast("string"))
    return bound(place, lambda x: F.coalesce(F.concat(text(x), F.lit("-"), x["removed"].cast("string"), F.lit("+"), x["added"].cast("string")), F.lit("")))


def _both(x: Column, y: Column, make) -> Column:
    return bound(x, lambda xs: bound(y, lambda ys: make(xs, ys)))


def bounds(docs: DataFrame, key: str) -> list[int]:
    """Greatest keys of ranges of about BUCKET_ROWS rows, ascending: MOST_BUCKETS numbers at most."""
    ids = docs.select(F.col(key).alias("k"))
    n = min(MOST_BUCKETS, max(1, math.ceil(ids.count() / BUCKET_ROWS)))
    found = ids.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("k")).collect()
    return sorted({r.k for r in found if r.k is not None})


def with_next(docs: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """`docs` with next_<column> of the document that follows by descending key; the last is followed by the first.

    Documents are dealt by key range, so one shuffle puts neighbours together; a range's greatest
    document is also sent to the end of the range above it, where it is the follower of the last one.
    """
    from pyspark.sql import Window

    tops = bounds(docs, key)
    if not tops:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    tops_column = F.split(F.lit(",".join(map(str, tops))), ",").cast("array<bigint>")
    n = len(tops)

    def halve(state, _):
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        up = F.get(tops_column, mid) < F.col(key)
        return F.struct(F.when(up, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(up, state["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")), halve)["lo"]
    dealt = docs.withColumn("__at", at)
    last = F.get(tops_column, F.col("__at")) == F.col(key)
    places = F.filter(F.array(F.struct(F.col("__at").alias("__bucket"), F.lit(False).alias("__guest")), F.when(last, F.struct(((F.col("__at") + 1) % n).alias("__bucket"), F.lit(True).alias("__guest")))), lambda x: x.isNotNull())
    dealt = dealt.select(*docs.columns, F.inline(places))
    window = Window.partitionBy("__bucket").orderBy("__guest", F.desc(key), *order)
    return dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).where("not __guest").drop("__bucket", "__guest")


def edited_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every document and its edited text, with likenesses (see op5), and in edit_at the place of the edit.

    edit_at is written as level:section:paragraph:phrase-removed+added of differing(), '' for equal texts. A null text is empty. A null key orders as the least BIGINT. Rows that share a key follow one
    another by their text, and lie in one partition of the window, as do all null keys: keys are taken to tell documents apart. A lone document is followed by itself.
    """
    rows = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = fingerprint(rows, "__text", "fingerprint")
    found = with_next(rows, "__k", ["__text", "fingerprint"], [F.col("__text")])
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    found = found.withColumn("n_chars", n.cast("long")).withColumn("__edited", F.concat(F.substring("__text", F.lit(1), n - half), F.substring("next___text", F.lit(1), half))).drop("__text", "next___text")
    found = fingerprint(found, "__edited", "edited_fingerprint")
    for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        found = found.withColumn(f"__l_{c}", leaves_of(F.col(c)))
    own = F.col("__l_fingerprint")
    return found.select(
        F.col("__id").alias(key), "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(own, F.col("__l_edited_fingerprint")).alias("near_edited"), likeness(own, F.col("__l_next_fingerprint")).alias("near_next"), written_place(differing(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("edit_at"),
    )
