"""URL filter: stated rules, and association rules mined from URL tokens by FP-growth, in DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: (verdict, host, path prefix): fixed rules of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.6
#: Tokens of rules up to this number are looked for in the row.
LISTED = 5000
#: Items of a url up to which FP-growth lists their sets; where a url has more, only the sets that can be rules are made.
WIDEST = 16
#: Verdict of a url that no mined rule matches.
OTHERWISE = "allow"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def stated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: top-level domain, registered name, other labels, all path folders (numbers as `#`), and query names."""
    labels = F.split(host, r"\.")
    folders = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), "#").otherwise(x))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    parts = F.concat(
        F.array(F.concat(F.lit("tld:"), F.substring_index(host, ".", -1)), F.concat(F.lit("site:"), F.substring_index(host, ".", -2))),
        F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.concat(F.lit("sub:"), x)),
        F.transform(folders, lambda x: F.concat(F.lit("folder:"), x)),
        names,
    )
    return F.array_sort(F.array_distinct(parts))


def token_classes(rows: DataFrame, least: int) -> DataFrame:
    """(class, label, tokens, n, n_label): tokens that occur in the same rows are a class, named by its least token, with its rows of each label.

    rows: (tokens, label, w), w equal rows a row. Only tokens with `least` rows of one label or more are classed. Rows are compared by
    count and two 64-bit sums of their hashes.
    """
    each = rows.select(F.explode("tokens").alias("t"), "label", "w", *[F.xxhash64(F.lit(k), "tokens", "label").cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)])
    counts = written(each.groupBy("t", "label").agg(F.sum("w").alias("n_label"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")))
    whole = counts.groupBy("t").agg(F.sum("n_label").alias("n"), F.max("n_label").alias("most"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("most") >= least)
    classes = whole.groupBy("n", "h1", "h2").agg(F.sort_array(F.collect_list("t")).alias("tokens")).select(F.get("tokens", F.lit(0)).alias("class"), "tokens", "n")
    return written(classes.join(counts.select(F.col("t").alias("class"), "label", "n_label"), "class"))


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (classes, verdict, confidence, support) from rows (tokens, label), by FP-growth, and the classes (class, tokens) of tokens that they name.

    A rule is a frequent token set whose rows carry one verdict in a share of at least `confidence`. Pruned is a rule that has a more general one (fewer
    tokens) for the same verdict with no less confidence. So no rule has two tokens of one class, nor beside others a token of all
    rows or one whose rows have one label only: the set without it, or it alone, says as much. Those sets are never made: FP-growth gets
    one item a class, and only classes of several labels that some rows lack; if a url has more than WIDEST of these, least_sets() makes the sets. A rule stands for all its choices of one token a class, which are not listed here.
    """
    rows = written(labelled.select(F.array_distinct("tokens").alias("tokens"), "label").groupBy("tokens", "label").agg(F.count("*").alias("w")))
    total = rows.agg(F.sum("w")).first()[0] or 0
    least = max(1, math.ceil(support * total))
    classes = token_classes(rows, least)
    share = lambda n, of: F.round(n / of, 9)
    single = classes.where(F.col("n_label") >= least).select(F.array("class").alias("classes"), F.col("label").alias("verdict"), share(F.col("n_label"), F.col("n")).alias("confidence"), share(F.col("n_label"), F.lit(max(1, total))).alias("support")).where(F.col("confidence") >= confidence)
    mixed = classes.groupBy("class").agg(F.max("n_label").alias("most"), F.max("n").alias("n")).where((F.col("most") < F.col("n")) & (F.col("n") < total)).select(F.col("class").alias("t"))
    items = rows.select("tokens", "label", "w", F.explode_outer("tokens").alias("t")).join(mixed.withColumn("item", F.col("t")), "t", "left").groupBy("tokens", "label", "w").agg(F.collect_list("item").alias("items"))
    items = written(items.select(F.array_sort("items").alias("items"), "label", "w"))
    if (items.agg(F.max(F.size("items"))).first()[0] or 0) <= WIDEST:
        marked = items.select(F.concat("items", F.array(F.concat(F.lit("verdict="), "label"))).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("w"))).alias("copy")).drop("copy")
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(marked)
        several = model.associationRules.where(F.get("consequent", F.lit(0)).startswith("verdict=") & ~F.exists("antecedent", lambda x: x.startswith("verdict=")) & (F.size("antecedent") > 1))
        several = several.select(F.array_sort("antecedent").alias("classes"), F.expr("substring(consequent[0], 9)").alias("verdict"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
    else:
        found = least_sets(items, least)
        several = found.where(F.col("n_label") >= least).select("classes", F.col("label").alias("verdict"), share(F.col("n_label"), F.col("n")).alias("confidence"), share(F.col("n_label"), F.lit(total)).alias("support")).where(F.col("confidence") >= confidence)
    rules = written(single.unionByName(several))
    # a more general rule shares its first class with the rule, so it is found by that
    general = rules.select(F.get("classes", F.lit(0)).alias("t"), F.col("verdict"), F.col("classes").alias("g"), F.col("confidence").alias("gc"))
    each = rules.where(F.size("classes") > 1).select("*", F.explode("classes").alias("t"))
    beaten = each.join(general, ["t", "verdict"]).where((F.size("g") < F.size("classes")) & (F.col("gc") >= F.col("confidence")) & (F.size(F.array_except("g", "classes")) == 0)).select("classes", "verdict").distinct()
    kept = written(rules.join(beaten, ["classes", "verdict"], "left_anti"))
    return kept, classes.select("class", "tokens").distinct().join(kept.select(F.explode("classes").alias("class")).distinct(), "class", "left_semi")


def least_sets(items: DataFrame, least: int) -> DataFrame:
    """(classes, label, n, n_label): the sets of two classes or more that no smaller one has the rows of, with their rows of each label.

    items: (items, label, w). Only such sets can be rules, all their subsets are of that kind too, and one of a single label need not
    grow; so they are made size by size from those of the size before. Where classes lie within one another (folders of different
    depth) they are few, when the frequent sets are not.
    """
    counts = items.select("label", "w", F.explode("items").alias("c")).groupBy(F.array("c").alias("classes"), "label").agg(F.sum("w").alias("n_label"))
    out, size = [], 1
    while True:
        whole = Window.partitionBy("classes")
        counts = written(counts.select("classes", "label", "n_label", F.sum("n_label").over(whole).alias("n"), F.max("n_label").over(whole).alias("most")).where(F.col("most") >= least))
        if size > 1:
            out.append(counts.select("classes", "label", "n", "n_label"))
        grow = counts.where(F.col("most") < F.col("n")).select("classes", "n").distinct()
        head = lambda c: F.slice(c, 1, size - 1)
        a = grow.select(F.col("classes").alias("a"), head("classes").alias("head"))
        b = grow.select(F.element_at("classes", -1).alias("last"), head("classes").alias("head"))
        pairs = a.join(b, "head").where(F.col("last") > F.element_at("a", -1)).select(F.concat("a", F.array("last")).alias("classes"))
        parts = pairs.select("classes", F.explode(F.transform("classes", lambda x: F.array_except("classes", F.array(x)))).alias("part"))
        fewest = parts.join(grow.withColumnRenamed("classes", "part"), "part").groupBy("classes").agg(F.min("n").alias("bound"), F.count("*").alias("k")).where(F.col("k") == size + 1)
        fewest = written(fewest.select("classes", "bound", F.get("classes", F.lit(0)).alias("c")))
        if not fewest.limit(1).count():
            return functools.reduce(DataFrame.unionByName, out) if out else counts.where("false").select("classes", "label", "n", "n_label")
        met = items.select("items", "label", "w", F.explode("items").alias("c")).join(fewest, "c").where(F.size(F.array_except("classes", "items")) == 0)
        met = met.groupBy("classes", "label", "bound").agg(F.sum("w").alias("n_label"))
        counts = met.withColumn("all", F.sum("n_label").over(whole)).where(F.col("all") < F.col("bound")).select("classes", "label", "n_label")
        size += 1


def token_rules(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """The rules of mine() by tokens: (rule_tokens, verdict, confidence, support), one for each choice of a token a class."""
    named = rules.select("*", F.explode("classes").alias("class")).join(classes, "class").groupBy("classes", "verdict", "confidence", "support").agg(F.collect_list("tokens").alias("lists"))
    start = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("lists", start, lambda made, tokens: F.flatten(F.transform(made, lambda m: F.transform(tokens, lambda t: F.concat(m, F.array(t))))))
    return named.select(F.explode(choices).alias("rule_tokens"), "verdict", "confidence", "support").withColumn("rule_tokens", F.array_sort("rule_tokens"))


def match(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, mined, mined_rule) of the distinct arrays in column `tokens` of `sets`: the best rule of an inverted index.

    The index lists each rule under its first class; rules met there are verified as a whole. Best is the highest confidence, then
    support, then fewest tokens, then the greatest tokens in order; of a class the greatest token that the set has is named.
    """
    index = rules.select(F.get("classes", F.lit(0)).alias("class"), "classes", "verdict", "confidence", "support")
    of = classes.select("class", F.explode("tokens").alias("t"))
    held = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("t")).join(of, "t").groupBy("tokens", "class").agg(F.max("t").alias("t"))
    have = held.groupBy("tokens").agg(F.collect_list(F.struct("class", "t")).alias("have"))
    met = have.select("tokens", "have", F.explode("have.class").alias("class")).join(index, "class").where(F.size(F.array_except("classes", "have.class")) == 0)
    named = F.array_sort(F.transform(F.filter("have", lambda x: F.array_contains("classes", x["class"])), lambda x: x["t"]))
    best = F.max(F.struct("confidence", "support", (-F.size("classes")).alias("short"), named.alias("rule"), "verdict")).alias("best")
    return met.groupBy("tokens").agg(best).select("tokens", F.col("best.verdict").alias("mined"), F.array_join("best.rule", "+").alias("mined_rule"))


def judge(pages: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row: key, host, path, rule, verdict, mined_rule. Stated rules decide first and label the urls that rules are mined from.

    A null url or one without `://` has an empty host and path, so no stated rule fits and its tokens
    are those of an empty host. Repeated rows and null keys keep their rows. Without labelled urls all
    others get OTHERWISE. Other columns play no part. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), F.col(url).alias("__url"), host.alias("host"), path.alias("path"))
    rule, verdict = stated(F.col("host"), F.col("path"))
    rows = rows.select(key, "host", "path", rule.alias("rule"), verdict.alias("__stated"), tokens(F.col("__url"), F.col("host"), F.col("path")).alias("tokens"))
    rules, classes = mine(rows.where("rule is not null").select("tokens", F.col("__stated").alias("label")))
    classes = written(classes)
    # tokens of rules are each in MIN_SUPPORT of the labelled urls; few of them are looked for in the row, more by the join in match()
    listed = classes.select(F.explode("tokens").alias("t"))
    if listed.count() <= LISTED:
        known = [r.t for r in listed.collect()]
        rows = rows.withColumn("tokens", F.filter("tokens", lambda x: x.isin(known)))
    found = written(match(rows.where("rule is null"), rules, classes))
    out = rows.join(found, "tokens", "left")
    return out.select(key, "host", "path", "rule", F.coalesce("__stated", "mined", F.lit(OTHERWISE)).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule"))
