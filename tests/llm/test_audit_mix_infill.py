"""Source audit, source mix and fill-in-middle against brute force, on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvault.llm import divergence, infill, mixing, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("n", "d", "m", "p", "q", "form", "src", "draw", "size", "rows", "rank", "value", "entries", "term")


def odd_rows(seed, many=120):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "É", "é", "straße", "x1y", "日本", "zz", "delta's"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, rng.choice([" ", "\t", "  "]).join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "ä", "\U0001f600", None])) for i in range(many)]
    rows += [(9001, None, "en", "a"), (9002, "", "en", "empty"), (9003, None, None, None), (None, "alpha beta", "en", "b"), (None, "alpha beta", "en", "b"), (9004, "same words twice", "de", "a"), (9004, "same words twice", "de", "a")]
    rows += [(9005, "solo terms only here", "xx", "a"), (9006, "long " * 5000, "de", "c"), (9007, "!!! 123", "yy", "b"), (9007, "!!! 123", "yy", "a"), (9008, "x" * 9000, "en", "c"), (9009, "a\x00b   c", "en", "c")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("extra").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- op11


def brute_audit(rows, top=200, min_docs=3):
    count, total, within, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        total[lang].update(terms)
        within[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, d in within[lang].items() if d >= min_docs]
        share = lambda c, of: 1 + 10**9 * (c + 1) // (of + len(kept))
        own = lambda s: {t: share(count[lang, s][t], sum(count[lang, s][x] for x in kept)) for t in kept}
        p, q = own(source), {t: share(total[lang][t], sum(total[lang][x] for x in kept)) for t in kept}
        parts = {"pair": [], "term": [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, source][t] and p[t] > q[t]]}
        for l, other in groups:
            if l == lang and other != source:
                o = own(other)
                parts["pair"].append((sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other))
        for part, found in parts.items():
            for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item, v, rank))
    return out


@pytest.mark.parametrize("top", [200, 5, 1])
def test_audit_equals_brute_force(docs, rows, top):
    got = divergence.audit(docs, top=top).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, top) and len(got) == len({tuple(r) for r in got})


def test_audit_of_one_hot_source_and_many_equal_terms(spark):
    words = [f"t{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklm"]
    rows = [(i, " ".join(words[i % 3 :: 2]), "en", "hot") for i in range(30)] + [(100 + i, " ".join(words[:40]), "en", f"s{i}") for i in range(4)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute_audit(rows)


def test_audit_hands_counters_on_and_reads_long_texts_in_stretches(spark, rows, monkeypatch):
    raw = ("word beta É9x " * 4000).encode()
    monkeypatch.setattr(divergence, "SLICE_BYTES", 1000)
    runs = list(divergence.term_runs(raw))
    assert len(runs) > 10 and sum(runs, []) == re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+".encode("latin1"), raw.lower())
    assert list(divergence.term_runs(b"x" * 5000)) == [[b"x" * 5000]]


def test_audit_of_large_counts_is_exact(spark):
    given = [(3_000_000_000_000, 7_000_000_000_000, 12345), (1, 10**15, 999), (0, 0, 1)]
    got = spark.createDataFrame(given, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in given]


# ---------------------------------------------------------------- op12


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), set(names)
    target, left = {}, total
    while True:
        shared = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if shared[s] > 3 * sizes[s]}
        if not above:
            return target | shared
        for s in above:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= above


def check_mix(rows, got):
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    want = brute_targets(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, size(t)) for i, t, _, _ in rows)
    taken, goal = Counter(), {}
    for r in got:
        source = r.src[1:] if r.src[0] == "0" else None
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
        goal[source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)


def test_mix_meets_targets(docs, rows):
    check_mix(rows, mixing.planned(docs).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_of_skewed_sources(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, None]), " ".join(["w"] * rng.randrange(40)), None, rng.choice(["big"] * 12 + ["a", "b", "c", "d", None])) for i in range(300)] + [(7, "one two three", None, "big")] * 60
    got = mixing.planned(spark.createDataFrame(rows, SCHEMA)).collect()
    check_mix(rows, got)
    key = lambda r: (r.doc_id or -1, r.size, r.src, r.taken)
    again = mixing.planned(spark.createDataFrame(sorted(rows, key=repr), SCHEMA).repartition(7)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_sorts_in_one_exchange_of_rows(docs):
    plan = mixing.planned(docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan


def test_mixed_texts_are_what_the_plan_takes(docs, rows):
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    taken, got = Counter(), Counter()
    for r in mixing.planned(docs).collect():
        taken[r.doc_id] += r.taken
    made = mixing.mixed(docs).collect()
    for r in made:
        got[r.doc_id] += words(r.text)
    assert +got == +taken
    whole = {t for _, t, _, _ in rows}
    assert sum(r.text not in whole for r in made) <= len({r.source for r in made})


# ---------------------------------------------------------------- op13


def brute_infill(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, n, "plain", None, None
    if h[3] % 100 < 20:
        return f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", n, "spm", a, b - a
    return f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", n, "psm", a, b - a


MORE = [(1, "a <P> b"), (2, "<S>"), (3, "x<M>"), (4, "<P <S< <M < >"), (5, "<" * 50), (6, "M>" * 40), (7, "é" * 9000), (8, "a" * 500 + "語" * 500 + "🙂" * 500 + "b" * 700), (9, "é ‍"), (10, "\x00"), (11, " ")]


def test_infill_equals_brute_force(spark, rows):
    given = [(i, t) for i, t, _, _ in rows] + MORE + [(1000 + i, t) for i in range(40) for t in ("<P <S> no", "mixed é語🙂 text < S>", "a")]
    docs = spark.createDataFrame(given, "doc_id long, text string").select("*", *[F.lit("extra").alias(c) for c in CLASH], F.lit(1).alias("Prefix_Chars"))
    out = infill.transformed(docs)
    got = out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars").collect()
    want = [(i, *brute_infill(i, t)) for i, t in given]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r[3] for r in want} == {"plain", "psm", "spm"}
    back = out.select("doc_id", infill.restored(F.col("text"), F.col("form")).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=repr) == sorted(((i, t or "") for i, t in given), key=repr)
    assert {"m", "src", "entries"} <= set(out.columns) and out.columns.count("n") == 1 and "Prefix_Chars" not in out.columns


@pytest.mark.parametrize("block", [64, 1000, 1 << 22])
def test_rank_index_is_exact(monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK", block)
    rng = random.Random(block)
    pools = ["abc ", "aé語🙂", "é", "語", "a" * 30 + "🙂"]
    for size in (0, 1, 2, 63, 64, 65, 500, 4000):
        text = "".join("".join(rng.choices(rng.choice(pools), k=rng.randrange(1, 400))) for _ in range(size // 100 + 1))[:size]
        raw = text.encode()
        index = infill.RankIndex(raw)
        want = np.cumsum([0] + [len(c.encode()) for c in text])
        assert (index.offsets(np.arange(len(text) + 1)) == want).all()
        assert (index.ranks(want) == np.arange(len(text) + 1)).all()
        assert index.residuals.dtype == np.int8


def test_rank_index_needs_few_segments():
    assert len(infill.RankIndex(b"plain text " * 100_000).first) == 1
    mixed = ("a" * 5000 + "語" * 5000) * 10
    assert len(infill.RankIndex(mixed.encode()).first) < 300
    assert infill.RankIndex(b"\x80\x80ab\xff").ranks(np.array([5])).tolist() == [3]


# ---------------------------------------------------------------- all three


def test_empty_tables(none):
    assert divergence.audit(none).count() == 0
    assert mixing.planned(none).count() == 0 and mixing.mixed(none).count() == 0
    assert infill.transformed(none).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_source_mix", "op13_fill_in_middle"])
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    docs = f"(SELECT * FROM '{sf}/documents.parquet')"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM {docs}")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    pick = lambda names, r: tuple(round(x, 6) if isinstance(x, float) else x for _, x in sorted(zip(names, r)))
    assert Counter(pick(got.columns, r) for r in got.collect()) == Counter(pick(want.columns, r) for r in want.fetchall())
