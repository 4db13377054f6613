"""Graph consolidation: which objects survive among near copies, and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, dealt, discard, written
from .ordering import numbered


def settled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """survivors(), and the number of rounds it took.

    A node survives if none of its better neighbours does: it is the NOR of those. Each round
    puts what the last one found into these terms. A decided neighbour settles the node or leaves its terms. A neighbour
    with one term left is that term, negated or not, and is replaced by it; so along a chain of such nodes the terms
    reach twice as far each round, and a chain of n nodes settles in about log2 n rounds. Terms always name a better node, so they never go round.
    A round writes its terms and what it settled; those of the round before are removed. Joins deal out both sides, as written keys take few bytes.
    """
    rank = nodes.select("key", "quality")
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct()
    both = sides.join(dealt(rank.select(F.col("key").alias("u"), F.col("quality").alias("qu"))), "u").join(dealt(rank.select(F.col("key").alias("v"), F.col("quality").alias("qv"))), "v")
    better = (F.col("qv") > F.col("qu")) | ((F.col("qv") == F.col("qu")) & (F.col("v") < F.col("u")))
    # terms (x, t, no): x may have `t survives`, or its contrary where no is true, among its better neighbours
    terms = written(both.select(F.col("u").alias("x"), F.when(better, F.col("v")).alias("t"), F.lit(False).alias("no"), F.lit(False).alias("hit")).distinct())
    known, rounds = [_judged(terms)], 0
    while known[-1].where("value is null").limit(1).count():
        last, rounds = known[-1], rounds + 1
        decided = last.where("value is not null").select(F.col("x").alias("y"), "value")
        alone = last.where("value is null and n = 1").select(F.col("x").alias("y"), F.col("only.t").alias("to"), (~F.col("only.no")).alias("turned"))
        # one whose term is decided already is about to be decided itself
        alone = alone.join(dealt(decided.select(F.col("y").alias("to"))), "to", "left_anti")
        facts = decided.select("y", "value", F.lit(None).cast("string").alias("to"), F.lit(None).cast("boolean").alias("turned")).unionByName(alone.select("y", F.lit(None).cast("boolean").alias("value"), "to", "turned"))
        open_ = terms.where("t is not null").join(dealt(decided.select(F.col("y").alias("x"))), "x", "left_anti")
        met = open_.join(dealt(facts), F.col("t") == F.col("y"), "left")
        term = F.when(F.col("value").isNull(), F.coalesce("to", "t"))
        no = F.when(F.col("to").isNotNull(), F.col("no") != F.col("turned")).otherwise(F.col("no"))
        put = met.select("x", term.alias("t"), no.alias("no"), F.coalesce(F.col("value") != F.col("no"), F.lit(False)).alias("hit"))
        # a term and its contrary: one of them holds
        merged = put.groupBy("x", "t").agg(F.bool_or("hit").alias("h"), F.min("no").alias("no"), F.max("no").alias("most"))
        old, terms = terms, written(merged.select("x", "t", "no", (F.col("h") | (F.col("t").isNotNull() & (F.col("no") != F.col("most")))).alias("hit")))
        known.append(_judged(terms))
        discard(old)
    out = known[0]
    for k in known[1:]:
        out = out.unionByName(k)
    done = written(out.where("value is not null").select(F.col("x").alias("key"), F.col("value").alias("survives")))
    discard(terms, *known)
    return done, rounds


def _judged(terms: DataFrame) -> DataFrame:
    """(x, value, n, only) of the terms (x, t, no, hit): whether x survives, if that is clear; else how many terms it has, and one of them."""
    of = terms.groupBy("x").agg(F.bool_or("hit").alias("dead"), F.count("t").alias("n"), F.max(F.when(F.col("t").isNotNull(), F.struct("t", "no"))).alias("only"))
    return written(of.select("x", F.when(F.col("dead"), False).when(F.col("n") == 0, True).alias("value"), "n", "only"))


def survivors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, survives) for every node that has an edge: the greedy walk by quality, best first.

    nodes: (key, quality); edges: (a, b). Each node still active survives and takes its active
    neighbours out (never theirs). With distinct priorities the rounds of settled() end where the sequential walk does.
    """
    return settled(nodes, edges)[0]


def review_queue(nodes: DataFrame, edges: DataFrame, generation: str) -> DataFrame:
    """(left_key, right_key, score, evidence, generation, pos): each redundant object with its best adjacent survivor, best survivors first, then by key."""
    return numbered(_cards(nodes, edges, generation).join(dealt(nodes.select(F.col("key").alias("left_key"), "quality")), "left_key"), [F.desc("quality"), F.col("left_key"), F.col("right_key")]).drop("quality")


def _cards(nodes: DataFrame, edges: DataFrame, generation: str) -> DataFrame:
    state = survivors(nodes, edges)
    alive = state.where("survives").select("key").join(dealt(nodes), "key")
    sides = edges.select(F.col("a").alias("left_key"), F.col("b").alias("right_key"), "score", "evidence").unionByName(edges.select(F.col("b").alias("left_key"), F.col("a").alias("right_key"), "score", "evidence"))
    met = sides.join(dealt(alive.select(F.col("key").alias("left_key"), F.col("quality").alias("q"))), "left_key").join(dealt(state.where("not survives").select(F.col("key").alias("right_key"))), "right_key")
    # highest quality, then least key: first the quality, then the least key that has it
    top = met.groupBy("right_key").agg(F.max("q").alias("q"))
    first = met.join(dealt(top), ["right_key", "q"]).groupBy("right_key").agg(F.min_by(F.struct("left_key", "score", "evidence"), "left_key").alias("x"))
    return first.select("x.*", "right_key", F.lit(generation).alias("generation"))


def _class_graph(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, nodes, edges): each class (class, best, quality, n) with its best member, which stands for it in the graph."""
    rated = members.join(dealt(nodes.select("key", "quality")), "key")
    top = rated.groupBy("class").agg(F.max("quality").alias("quality"), F.count("*").alias("n"))
    best = rated.join(dealt(top), ["class", "quality"]).groupBy("class").agg(F.min("key").alias("best"))
    classes = cut(top.join(dealt(best), "class"))
    side = lambda own, to: classes.select(F.col("class").alias(own), F.col("best").alias(to))
    named = edges.join(dealt(side("a", "x")), "a").join(dealt(side("b", "y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "score", "evidence")
    return classes, classes.select(F.col("best").alias("key"), "quality"), cut(named)


def class_survivors(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """survivors() of a graph given by classes: members (key, class, evidence) and edges (a, b, score, evidence) between classes.

    Members of a class are linked to one another and have the same links to others, so only its best one can survive,
    and does so if the class survives among the classes. No pair of members is listed. Objects of equal content are one object here: exact copies go before.
    """
    classes, graph, links = _class_graph(nodes, members, edges)
    state = survivors(graph, links).select(F.col("key").alias("best"), "survives")
    settled = classes.join(dealt(state), "best", "left").where("n > 1 or survives is not null").select("class", "best", F.coalesce("survives", F.lit(True)).alias("survives"))
    return members.join(dealt(settled), "class").select("key", ((F.col("key") == F.col("best")) & F.col("survives")).alias("survives"))


def class_review_queue(nodes: DataFrame, members: DataFrame, edges: DataFrame, generation: str) -> DataFrame:
    """review_queue() of a graph given by classes, as in class_survivors(); members also say why their class is one (evidence).

    A member of a class that survives meets its best member; one of a class that does not meets what its class meets.
    """
    classes, graph, links = _class_graph(nodes, members, edges)
    met = cut(_cards(graph, links, generation).select(F.col("right_key").alias("best"), "left_key", "score", "evidence"))
    cards = members.join(dealt(classes.select("class", "best", "n")), "class").join(dealt(met.withColumnRenamed("evidence", "why")), "best", "left").where("left_key is not null or (n > 1 and key <> best)")
    cards = cards.select(F.coalesce("left_key", "best").alias("left_key"), F.col("key").alias("right_key"), F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("why", "evidence").alias("evidence"), F.lit(generation).alias("generation"))
    return numbered(cards.join(dealt(nodes.select(F.col("key").alias("left_key"), "quality")), "left_key"), [F.desc("quality"), F.col("left_key"), F.col("right_key")]).drop("quality")
