"""Audit of how the sources of a language differ in their terms, by ranking cells of equal counts.

A term's share in a group follows from its count alone, so terms are never compared one by one: those of equal counts
form a cell, the divergence is worked out once a cell, and a cell weighs as many terms as it has. Only cells that reach
the ranks asked for are expanded into terms. Arithmetic is in integers throughout.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import ship
from .common import SLICE_BYTES, small, written

#: A language keeps the terms in at least this many of its documents.
MIN_DOCS = 3
#: Ranks of terms that are listed a group.
TOP = 200
#: Shares are counted in parts of this.
UNIT = 1_000_000_000
#: Counters of a task are handed on from this many entries.
HELD = 400_000
#: Terms are runs of other bytes than these: ASCII without letters, A-Z lower-cased first.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))


def term_runs(raw: bytes):
    """The terms of a UTF-8 text, a list for each stretch of SLICE_BYTES or little more."""
    plain, at = raw.translate(_TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) from (lang, source, text): occurrences and documents of a term in a group, in parts to be summed up."""
    ship(docs.sparkSession)
    names = ["lang", "source", "term", "n", "d"]

    def run(batches):
        seen, within = defaultdict(Counter), defaultdict(Counter)
        fresh = 0

        def handed_on():
            for group, counts in seen.items():
                docs_of, terms = within[group], list(counts)
                for at in range(0, len(terms), 65536):
                    part = terms[at : at + 65536]
                    columns = [pa.array([group[0]] * len(part), pa.string()), pa.array([group[1]] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([counts[t] for t in part], pa.int64()), pa.array([docs_of[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            seen.clear()
            within.clear()

        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                group, own = (lang.as_py(), source.as_py()), set()
                for terms in term_runs(text.as_py()):
                    seen[group].update(terms)
                    own.update(terms)
                within[group].update(own)
                fresh += len(own)
                if fresh > HELD:
                    fresh = sum(map(len, seen.values()))
                    if fresh > HELD:
                        yield from handed_on()
                        fresh = 0
        yield from handed_on()

    parts = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, "lang string, source string, term binary, n long, d long")
    return parts.withColumn("term", F.col("term").cast("string"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(count + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + terms)) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _weighted(m: Column, f: Column) -> Column:
    return m.cast("decimal(19,0)") * f.cast("decimal(19,0)")


def pair_values(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language the divergence of the first from the second, over all kept terms.

    A sum over all kept terms is split by whether a source has the term. With f(x, y) for a cell of x and y occurrences, it is
    V f(0, 0), plus f(x, 0) - f(0, 0) over the first source's terms, plus f(0, y) - f(0, 0) over the second's, plus
    f(x, y) - f(x, 0) - f(0, y) + f(0, 0) over those of both; absent terms are never listed.
    """
    side = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other"), F.col("p0").alias("q0"))
    pairs = written(groups.select("lang", "source", "total", "terms", "p0").join(small(side), "lang").where("source <> item"))
    some = small(pairs.where("terms > 0"))
    col, f = F.col, divergence
    p0, q0, m = col("p0"), col("q0"), col("m")
    spread = vectors.select("lang", F.inline("entries")).groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(small(groups), ["lang", "source"])
    spread = written(spread.select("lang", "source", "m", share(col("n"), col("total"), col("terms")).alias("p")))
    first = spread.join(some, ["lang", "source"]).select("lang", "source", "item", _weighted(m, f(col("p"), q0) - f(p0, q0)).alias("v"))
    second = spread.withColumnRenamed("source", "item").join(some, ["lang", "item"]).select("lang", "source", "item", _weighted(m, f(p0, col("p")) - f(p0, q0)).alias("v"))
    # terms with the same sources and counts are one row before their sources are paired: each two once, as both directions have the same cells
    alike = vectors.groupBy("lang", "entries").agg(F.count("*").alias("m")).where(F.size("entries") > 1)
    first_of = F.explode(F.transform("entries", lambda a, i: F.struct(a.alias("a"), F.slice("entries", i + 2, F.size("entries")).alias("rest"))))
    cells = alike.select("lang", "m", first_of.alias("z")).select("lang", "m", "z.a", F.explode("z.rest").alias("b"))
    cells = cells.groupBy("lang", col("a.source").alias("source"), col("b.source").alias("item"), col("a.n").alias("x"), col("b.n").alias("y")).agg(F.sum("m").alias("m"))
    cells = cells.join(some, ["lang", "source", "item"]).select("lang", "source", "item", "m", "p0", "q0", share(col("x"), col("total"), col("terms")).alias("p"), share(col("y"), col("other"), col("terms")).alias("q"))
    p, q = col("p"), col("q")
    there, back = f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), f(q, p) - f(q, p0) - f(q0, p) + f(q0, p0)
    met = cells.groupBy("lang", "source", "item").agg(F.sum(_weighted(m, there)).alias("there"), F.sum(_weighted(m, back)).alias("back"))
    both = met.select("lang", F.inline(F.array(F.struct("source", "item", col("there").alias("v")), F.struct(col("item").alias("source"), col("source").alias("item"), col("back").alias("v")))))
    neither = pairs.select("lang", "source", "item", F.when(col("terms") > 0, _weighted(col("terms"), f(p0, q0))).otherwise(F.lit(0).cast("decimal(38,0)")).alias("v"))
    parts = neither.unionByName(first).unionByName(second).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))


def top_terms(vectors: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, by divergence, down to rank `top`."""
    uses = vectors.select("lang", "term", "n_lang", F.inline("entries"))
    cells = uses.groupBy("lang", "source", "n", "n_lang").agg(F.count("*").alias("m")).join(small(groups), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    cells = written(cells.select("lang", "source", "n", "n_lang", "m", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "n", "n_lang", "m", divergence(F.col("p"), F.col("q")).alias("value")))
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # every value has a term at least, so `top` values are enough
    best = merged.withColumn("k", F.row_number().over(down)).where(F.col("k") <= top)
    best = best.withColumn("before", F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")).where(F.col("before") < top)
    asked = written(cells.join(small(written(best.select("lang", "source", "value", "before"))), ["lang", "source", "value"]).drop("m"))
    met = uses.join(small(asked), ["lang", "source", "n", "n_lang"])
    within = Window.partitionBy("lang", "source", "value").orderBy("term")
    ranked = met.withColumn("k", F.row_number().over(within)).where(F.col("k") <= top)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", (F.col("before") + F.col("k")).cast("int").alias("rank")).where(F.col("rank") <= top)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` compares each source with the others of its language, part `term` lists what sets it off.

    Null texts, languages and sources are ''. A group whose texts hold no kept term has shares of 1 / V each; where a
    language keeps no term, pairs are worth 0 and no term is listed. Repeated rows are documents of their own. Equal values
    are ranked by item in UTF-8 order. Other columns play no part. An empty table gives an empty result.
    A row of the term table holds one count for each source of its language, so it grows with the sources, not the texts.
    """
    clean = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = counted(clean).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    merged = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("d").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("entries"))
    vectors = written(merged.where(F.col("docs") >= min_docs).drop("docs"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("lang_total"))
    own = vectors.select("lang", F.inline("entries")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = clean.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.na.fill(0, ["total", "terms", "lang_total"])
    groups = written(groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))))
    pairs = pair_values(vectors, groups)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(top_terms(vectors, groups, top).withColumn("part", F.lit("term")).select(*columns))
