"""The text operators against brute force, on small tables with odd rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenvault.llm import bpe, chunks, decontaminate, merkle, pii, queries, simhash, suffixes, toxicity, urls
from lumenvault.llm.spans import keyed

ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "a" * 3000), (9005, "ab cd " * 400), (None, "no key at all"), (None, None), (9006, "same text twice"), (9006, "same text twice"), (9007, "ÄÖ ß é İ Σ 🙂 x"), (9008, "x\x00y")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    """Given documents, odd rows and extra columns whose names clash with those that operators add."""
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return some.unionByName(odd).select("*", *[F.lit("extra").alias(c) for c in ("score", "spans", "w", "h", "fp", "rid", "n_words", "size")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- op1


def test_stated_rules(spark):
    given = {
        "http://a.com/x": "com/", "https://example.com/en/1": "example.com/en/", "http://www.EXAMPLE.com/en/": "www.example.com/en/", "http://x.www.example.com/en/a": "www.example.com/en/",
        "http://m.example.com/en/q": "example.com/en/", "http://a.net/es/1": "net/es/", "http://net/fr/": "net/fr/", "http://a.com": None, "http://a.com?x=/": None, "a.com/x": None, "http://notcom/": None, None: None, "": None,
    }
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert [got[i].rule for i in range(len(given))] == list(given.values())
    assert got[2].host == "www.example.com" and got[7].path == "" and got[11].host == "" and all(r.verdict in ("allow", "block") for r in got.values())


@pytest.mark.parametrize("widest", [16, 0])
def test_mined_rules_match_enumeration(spark, monkeypatch, widest):
    monkeypatch.setattr(urls, "WIDEST", widest)
    rng = random.Random(4)
    rows = [(sorted({f"t{rng.randrange(6)}" for _ in range(4)}), rng.choice(["allow", "block", "block"])) for _ in range(80)]
    support, confidence = 0.05, 0.6
    seen, both = Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, 1 << len(tokens)):
            part = tuple(t for i, t in enumerate(tokens) if k >> i & 1)
            seen[part] += 1
            both[part, label] += 1
    rules = {(p, v): both[p, v] / seen[p] for p, v in both if both[p, v] >= support * len(rows) and both[p, v] / seen[p] >= confidence}
    want = {k for k, conf in rules.items() if not any(set(p) < set(k[0]) and v == k[1] and round(c, 9) >= round(conf, 9) for (p, v), c in rules.items())}
    got = urls.token_rules(*urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), support, confidence))
    assert {(tuple(r.rule_tokens), r.verdict) for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_tokens_that_go_together_match_enumeration(spark, monkeypatch, seed):
    """Tokens in all rows, tokens always in company, nested ones and those of one label only."""
    monkeypatch.setattr(urls, "WIDEST", 16 * (seed % 2))
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        deep = rng.randrange(4)
        tokens = {"every", "also"} | {f"deep{k}" for k in range(deep)} | ({"a1", "a2", "a3"} if rng.random() < 0.5 else set()) | ({"b1", "b2"} if rng.random() < 0.4 else set())
        label = "block" if deep == 3 or rng.random() < 0.5 else "allow"
        rows.append((sorted(tokens | ({"only"} if label == "allow" and rng.random() < 0.3 else set())), label))
    support, confidence = 0.05, 0.6
    seen, both = Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, 1 << len(tokens)):
            part = tuple(t for i, t in enumerate(tokens) if k >> i & 1)
            seen[part] += 1
            both[part, label] += 1
    rules = {k: both[k] / seen[k[0]] for k in both if both[k] >= support * len(rows) and both[k] / seen[k[0]] >= confidence}
    by_verdict = {v: [(frozenset(p), round(c, 9)) for (p, w), c in rules.items() if w == v] for v in ("allow", "block")}
    want = {(p, v) for (p, v), conf in rules.items() if not any(q < set(p) and c >= round(conf, 9) for q, c in by_verdict[v])}
    got = urls.token_rules(*urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), support, confidence)).collect()
    assert {(tuple(r.rule_tokens), r.verdict) for r in got} == want and len(got) == len(want)
    assert all(r.confidence == round(rules[tuple(r.rule_tokens), r.verdict], 9) for r in got)


def test_many_common_folders_are_one_item(spark):
    """300 urls that share 30 folders, of both verdicts, and 30 more that a third of them share."""
    import time

    shared, more = "/".join(f"f{k}" for k in range(30)), "/".join(f"g{k}" for k in range(30))
    given = [f"http://{'www.' if i % 2 else ''}example.com/en/{shared}/{more if i % 3 == 0 else 'x'}/{i}" for i in range(300)] + [f"http://other.org/en/{shared}", "http://other.org/q"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert time.time() - began < 60 and len(got) == 302  # some seconds alone; 2^30 token sets would take years
    assert {got[i].verdict for i in range(0, 300, 2)} == {"block"} and got[301].mined_rule is None


def test_rules_on_deep_folders(spark):
    deep = lambda host, last, n: [f"http://{host}/{k}{last}" for k in (f"en/a/b/{i}/" for i in range(n))]
    given = deep("example.com", "ads", 30) + deep("www.example.com", "news", 30) + deep("other.org", "ads", 2) + deep("other.org", "news", 2)
    got = urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.rule is None for r in got] == [False] * 60 + [True] * 4
    assert [r.verdict for r in got[60:]] == ["block", "block", "allow", "allow"] and "folder:ads" in got[60].mined_rule


def test_folders_within_folders(spark):
    """400 urls, 30 folders deep at most, of both verdicts: 2^30 frequent sets, but only 30 that differ in their rows."""
    import time

    given = [f"http://{'www.' if i % 2 else ''}example.com/en/" + "/".join(f"d{k}" for k in range(i // 2 % 31)) for i in range(400)]
    began = time.time()
    got = urls.judge(spark.createDataFrame(list(enumerate([*given, "http://other.org/d0/d1"])), "page_id long, url string")).collect()
    assert time.time() - began < 60 and len(got) == 401


def brute_tokens(host, path, url):
    labels = host.split(".")
    out = {"tld:" + labels[-1], "site:" + ".".join(labels[-2:])} | {"sub:" + x for x in labels[:-2]}
    out |= {"folder:" + ("#" if re.fullmatch("[0-9]+", x) else x) for x in path.split("/") if x}
    return out | {"query:" + x for x in re.findall(r"[?&]([^=&#]+)", url or "")}


def brute_verdicts(pages):
    """{page: (rule, verdict, mined rule)} by listing all token sets of all labelled urls."""
    read = {}
    for i, url in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, kind) for kind, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        read[i] = (*max(fits, default=(0, None, None))[1:], frozenset(brute_tokens(host, path, url)))
    labelled = [(t, v) for r, v, t in read.values() if r]
    seen, both = Counter(), Counter()
    for t, v in labelled:
        for k in range(1, 1 << len(t)):
            part = frozenset(x for j, x in enumerate(sorted(t)) if k >> j & 1)
            seen[part] += 1
            both[part, v] += 1
    least = -(-len(labelled) * 10**6 * urls.MIN_SUPPORT // 10**6)
    rules = {k: (round(n / seen[k[0]], 9), round(n / len(labelled), 9)) for k, n in both.items() if n >= least and n / seen[k[0]] >= urls.MIN_CONFIDENCE}
    kept = {k: c for k, c in rules.items() if not any(p < k[0] and v == k[1] and d[0] >= c[0] for (p, v), d in rules.items())}
    out = {}
    for i, (rule, verdict, t) in read.items():
        best = max(((*c, -len(p), sorted(p), v) for (p, v), c in kept.items() if p <= t), default=None)
        out[i] = (rule, verdict, None) if rule else (None, best[-1] if best else urls.OTHERWISE, "+".join(best[-2]) if best else None)
    return out


def test_verdicts_equal_enumeration(spark, sf):
    rng = random.Random(14)
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").limit(120).collect()]
    pages += [(10_000 + i, f"http://{rng.choice(['www.example.com', 'a.example.com', 'b.net', 'c.net', 'd.org', 'e.info'])}/{rng.choice(['en', 'es', 'fr', 'x'])}/{rng.choice('pqr')}/{i % 7}?k{i % 3}=1") for i in range(120)]
    pages += [(20_000, None), (20_001, ""), (20_002, "no scheme"), (20_003, "http://"), (20_004, "x://h?a=1&a=2#f")]
    want = brute_verdicts(pages)
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string").withColumn("verdict", F.lit("extra"))).collect()
    assert {r.page_id: (r.rule, r.verdict, r.mined_rule) for r in got} == want and len(got) == len(pages)
    assert {"allow", "block"} <= {v for r, v, m in want.values() if m}


def test_urls_without_rows(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# ---------------------------------------------------------------- op2


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps):
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_near_duplicates(spark, docs):
    got = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    every = simhash.near_duplicates(docs).collect()
    nameless = [r for r in every if r.doc_id is None]
    assert len(every) == docs.count() and len(nameless) == 2 and {r.component_id for r in nameless if r.fp == 0} == {9001} and {r.component_id for r in nameless if r.fp != 0} == {None}
    want = {i: brute_fingerprint(t) for i, t in rows_of(docs) if i is not None}
    named = brute_components(want)
    assert len(got) == docs.where("doc_id is not null").count()
    assert all(r.fp % (1 << 64) == want[r.doc_id] and r.component_id == named[r.doc_id] for r in got)


@pytest.mark.parametrize("hot", [1000, 2])
def test_links_connect_planted_distances(spark, hot):
    rng = random.Random(7)
    values = set()
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(15):
            values.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])))
    fps = {i: v for i, v in enumerate(sorted(values, key=lambda v: hashlib.md5(str(v).encode()).digest()))}
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in fps.items()}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    from lumenvault.llm.common import components

    found = {r.node: r.component for r in components(simhash.links(df, hot)).collect()}
    named = brute_components(fps)
    classes = {}
    for i, v in signed.items():
        classes.setdefault(named[i], set()).add(v)
    assert all({found.get(v, v) for v in group} == {min(group)} for group in classes.values())


@pytest.mark.parametrize("many", [simhash.links, simhash.midpoint_links])
def test_links_send_no_side_whole(spark, many):
    """A small table of fingerprints becomes very many rows, so neither side is to be built on the driver."""
    from lumenvault.llm.common import written

    fps = written(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    plan = many(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_chain_and_a_star(spark):
    from lumenvault.llm.common import components

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 200)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {1, 100} and got[60] == 1 and got[199] == 100 and 300 not in got


def test_one_of_each_group_stays(spark, docs):
    kept = simhash.keep_one(docs)
    groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert kept.columns == docs.columns and kept.count() == groups  # one group has null keys only


def test_unlike_texts_under_one_key_all_stay(spark):
    rng = random.Random(21)
    text = lambda: " ".join(rng.choice("abcdefghijkl") * rng.randrange(1, 9) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, c), (1, a), (2, b), (3, c), (None, a), (None, "alone here")]
    kept = sorted(rows_of(simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))), key=str)
    assert kept == sorted([(1, a), (1, b), (1, c), (None, "alone here")], key=str)


# ---------------------------------------------------------------- op3


def test_toxicity_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    pairs = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert pairs / (len(toxic) * len(clean)) > 0.8 and all(0 <= r.score <= 1 for r in out)


def test_toxicity_never_learns_from_held_out_labels(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    from zlib import crc32

    used = toxicity.training_rows(docs, labels, "toxic", "doc_id", "text", 100).collect()
    assert {r.text for r in used} == {f"text {i}" for i in range(40) if crc32(str(i).encode()) % 4 != 2}


def test_toxicity_fit_equals_newton_steps(spark):
    """The whole fit on a small table: counts, ratios, selection and coefficients by plain sums and exact Newton steps."""
    import numpy as np

    rng = random.Random(23)
    word = lambda bad: rng.choice(["vile", "nasty", "awful"] if bad and rng.random() < 0.5 else ["garden", "river", "table", "music", "stone"])
    texts = [(i, " ".join(word(i % 3 == 0) for _ in range(rng.randrange(3, 12)))) for i in range(160)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    from zlib import crc32

    mark = np.zeros(1 << toxicity.BITS, np.int32)
    sets = [np.sort(toxicity.features(t, mark)) for _, t in texts]
    used = [i for i, _ in texts if crc32(str(i).encode()) % 4 != 2]
    y = np.array([i % 3 == 0 for i in used], float)
    names = sorted({int(f) for i in used for f in sets[i]})
    x = np.array([[f in s for f in names] for s in (set(sets[i].tolist()) for i in used)], float)
    n1, n0 = x[y == 1].sum(0), x[y == 0].sum(0)
    r = np.log((n1 + 1) / (y.sum() + 2)) - np.log((n0 + 1) / ((1 - y).sum() + 2))
    r[np.abs(r) < toxicity.SIGNIFICANT * np.sqrt(1 / (n1 + 1) + 1 / (n0 + 1))] = 0
    z, w = np.c_[x * r, np.ones(len(used))], np.zeros(len(names) + 1)
    ridge = np.diag([toxicity.RIDGE] * len(names) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
    want = {int(i): 1 / (1 + np.exp(-(np.isin(names, sets[i]) * r) @ w[:-1] - w[-1])) for i, _ in texts}
    got = {r_.doc_id: r_.score for r_ in toxicity.scored(docs, model).collect()}
    assert np.count_nonzero(model.weight) > 10 and all(got[i] == pytest.approx(want[i], abs=2e-3) for i in want)


def test_toxicity_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0), (4, 0), (5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    out = toxicity.scored(docs, model)
    assert out.where("score between 0 and 1").count() == docs.count() and sorted(out.columns) == sorted(docs.columns)
    assert toxicity.scored(none, model).count() == 0
    blank = toxicity.fit(none, labels)
    assert blank.score(toxicity.features("anything", __import__("numpy").zeros(1 << toxicity.BITS, "int32"))) == pytest.approx(0.5)


# ---------------------------------------------------------------- op4


def brute_contamination(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = find(t)
        k = min(13, len(w))
        for a in range(len(w) - k + 1 if k and i is not None else 0):
            windows.setdefault((k, tuple(w[a : a + k])), set()).add(str(i))
    for i, t in docs:
        w, hit, own = find(t), set(), set()
        for k in {k for k, _ in windows}:
            for a in range(len(w) - k + 1):
                if found := windows.get((k, tuple(w[a : a + k]))):
                    hit |= set(range(a, a + k))
                    own |= found
        yield i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limits", [(1 << 25, 20_000), (0, 0)])
def test_contamination(spark, sf, docs, monkeypatch, limits):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limits[0])
    monkeypatch.setattr(decontaminate, "LOOKUP_ROWS", limits[1])
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bench += [(500, "cd ab"), (501, None), (502, ""), (None, "same text twice"), (503, "same TEXT twice"), (503, "same TEXT twice"), (504, " ".join(f"w{i % 5}" for i in range(40)))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    extra = spark.createDataFrame([(7001, " ".join(f"w{i % 5}" for i in range(60))), (7002, "junk " * 30 + " ".join(f"w{i % 5}" for i in range(13)) + " junk"), (7003, " ".join(f"w{i % 5}" for i in range(12)))], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = decontaminate.contamination(every.withColumn("item", F.lit(1)), items).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_contamination(rows_of(every), bench)))
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns


def test_documents_spread_over_a_shuffled_join(spark, monkeypatch):
    """With items too many to broadcast every document still sends its own row, by a key of its own."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontaminate, "LOOKUP_ROWS", 0)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(14)]).alias("text"))
    seen = []
    join = type(docs).join

    def spy(self, other, *on):
        if "ih" in other.columns:
            seen.append(self)
        return join(self, other, *on)

    monkeypatch.setattr(type(docs), "join", spy)
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, " ".join(f"w{k}x7" for k in range(14)))], "item_id long, text string"))
    assert [r.doc_id for r in found.where("contaminated").collect()] == [7]
    own = seen[0].where("p < 0")
    assert own.where("h is null").count() == 0 and own.select("h").distinct().count() == 3000


def test_long_items_take_linear_time(spark):
    import time

    rng = random.Random(31)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(2000))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + " ".join(text.split()[700:760]) + " after"), (2, "other words")], "doc_id long, text string")
    decontaminate.contamination(docs, items).collect()
    began = time.time()
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: 60, 2: 0} and time.time() - began < 5


def test_the_plan_of_winnowing_stays_short(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(30)))], "item_id long, text string")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") < 20 and len(plan) < 40_000


def test_rows_under_one_key_are_judged_each_by_its_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, passage), (1, "clean text"), (None, passage), (None, "clean too"), (1, "clean text")], "doc_id long, text string")
    assert sorted(rows_of(decontaminate.drop_contaminated(docs, items)), key=str) == sorted([(1, "clean text"), (1, "clean text"), (None, "clean too")], key=str)
    assert decontaminate.contamination(docs, items).count() == 5


def test_contamination_without_rows(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, empty).where("contaminated or n_items > 0").count() == 0
    assert decontaminate.contamination(none, empty).count() == 0


# ---------------------------------------------------------------- op5


def test_merkle_edits(spark, docs):
    given = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    order = sorted(rows_of(given), key=lambda r: -r[0])
    got = {r.doc_id: r for r in merkle.edited_report(given).collect()}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest() and got[i].n_chars == len(t)
    prints = {}
    for i, t in order:
        assert prints.setdefault(got[i].fingerprint, t or "") == (t or "")
    assert len(prints) == len({t or "" for _, t in order})


def test_merkle_pieces_give_the_text_again(spark, docs):
    for pattern in (merkle.SECTION, merkle.PARAGRAPH, merkle.PHRASE):
        whole = F.array_join(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "")
        assert docs.where("text is not null").where(whole != F.col("text")).count() == 0


def test_merkle_odd_tables(spark, docs, none):
    assert merkle.edited_report(docs).count() == docs.count()
    assert merkle.edited_report(none).count() == 0
    [one] = merkle.edited_report(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def brute_place(a, b):
    """differing() on two fingerprints by plain lists."""
    if a[:64] == b[:64]:
        return None
    place, x, y = [], a, b
    for level, sign in (("section", "/"), ("paragraph", ";"), ("phrase", ".")):
        x, y = x.split(sign)[1:], y.split(sign)[1:]
        i = 0
        while i < min(len(x), len(y)) and x[i] == y[i]:
            i += 1
        k = 0
        while k < min(len(x), len(y)) - i and x[-1 - k] == y[-1 - k]:
            k += 1
        place.append(i)
        removed, added = len(x) - i - k, len(y) - i - k
        if level == "phrase" or (removed, added) != (1, 1):
            return (level, *place, *[None] * (3 - len(place)), removed, added)
        x, y = x[i], y[i]


def test_merkle_locates_edits_both_ways(spark, docs):
    base = "One.\nTwo.\n\nThree.\nFour. More of it.\n\nFive."
    edits = {
        "One.\nTwo.\n\nThree.\nFour. Less of it.\n\nFive.": ("phrase", 1, 1, 1, 1, 1), "One.\nTwo.\n\nFive.": ("section", 1, None, None, 1, 0), "One.\nTwo.\n\nThree.\nFour. More of it.\n\nNew.\n\nFive.": ("section", 2, None, None, 0, 1),
        "One.\nTwo.\n\nFour. More of it.\n\nFive.": ("paragraph", 1, 0, None, 1, 0), "One.\nTwo.\n\nThree.\nFour. \n\nFive.": ("phrase", 1, 1, 0, 2, 1), "": ("section", 0, None, None, 3, 0), base: None,
    }
    df = spark.createDataFrame([(base, t) for t in edits], "a string, b string")
    both = merkle.fingerprint(merkle.fingerprint(df, "a", "pa"), "b", "pb").select("a", "b", "pa", "pb", merkle.differing(F.col("pa"), F.col("pb")).alias("d"), merkle.differing(F.col("pb"), F.col("pa")).alias("back"))
    for r in both.collect():
        assert r.d == edits[r.b] == brute_place(r.pa, r.pb) and r.back == brute_place(r.pb, r.pa)
    for r in merkle.edited_report(docs).collect():
        d = brute_place(r.fingerprint, r.edited_fingerprint)
        assert r.edit_at == ("" if d is None else ":".join(str(x) for x in d[:4] if x is not None) + f"-{d[4]}+{d[5]}")


def test_merkle_neighbours_do_not_depend_on_ranges(spark, docs, monkeypatch):
    given = docs.where("doc_id is not null").select("doc_id", "text")
    want = {tuple(r) for r in merkle.edited_report(given).collect()}
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    assert {tuple(r) for r in merkle.edited_report(given).collect()} == want
    monkeypatch.setattr(merkle, "MOST_BUCKETS", 5)
    assert {tuple(r) for r in merkle.edited_report(given).collect()} == want


# ---------------------------------------------------------------- op6, op9


TEXTS = ["", "ΣΑΣ ΣΣ. Σ", "a" * 3000, " " * 700, "<|endoftext|> hi <|startoftext|><|endoftext|>", "İstanbul ǅ é \x00\x01 ﬁ", "1234567 ½ ²", "日本語テキスト 🙂👨‍👩‍👧", "\n\n \t  x", "don't I'LL 'S 's", "ab" * 5000, "xyzzy" * 60]
#: Code points on which the tables of the libraries differ.
RARE = ["".join(f"x{chr(c)}1{chr(c)}{chr(c)}! " for c in (0xA7CB, 0xA7DC, 0x58C, 0x16FD, 0x18FC4, 0x10D50, 0x16EA0, 0xA7CE, 0x3D000, 0x33479)), "ʛ\ua7dc ꟊ\ua7cb", "\U00010d55\U00010d75"]


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")[0]
    texts = TEXTS + RARE + [t for _, t in rows_of(docs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit(1))
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r for r in bpe.count_tokens(df, path).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 2048) for i, t in enumerate(texts))


def test_byte_bpe_equals_the_library_and_decodes(spark, docs):
    import tiktoken

    path, pattern = queries.tokenizer("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = TEXTS + [t for _, t in rows_of(docs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(df, path, pattern).collect()}
    ids = {r.doc_id: r.token_ids for r in bpe.encode_column(df, path, pattern).collect()}
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_matrix_and_heap_agree():
    path, pattern = queries.tokenizer("byte_bpe_multi_50k.tiktoken")
    coder, rng = bpe.byte_bpe(path, pattern), random.Random(1)
    pieces = [bytes(rng.choice(b"theanring ") for _ in range(rng.randrange(2, 60))) for _ in range(300)]
    assert [i for i, p in zip(coder.encode_pieces(pieces), pieces) if p not in coder.ranks] == [coder.encode_long(p) for p in pieces if p not in coder.ranks]


# ---------------------------------------------------------------- op7, op10


def test_chunks_remove_repeated_passages(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    passage = words(60)
    texts = [words(80) + " " + passage + " " + words(70) for _ in range(6)] + [words(200) for _ in range(6)]
    df = spark.createDataFrame([*enumerate(texts), (50, None), (51, ""), (52, texts[6]), (53, "z" * 5000), (53, "z" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in chunks.report(df).collect()}
    assert all(got[i].n_removed > len(passage) / 2 for i in range(1, 6)) and got[0].n_repeated > len(passage) / 2
    assert all(got[i].n_removed == 0 for i in [0, *range(6, 12), 50, 51]) and got[52].n_removed == got[52].n_bytes
    kept = {r.doc_id: r.text for r in chunks.deduplicated(df).collect()}
    assert all(got[i].kept_sha256 == hashlib.sha256(kept[i].encode()).hexdigest() for i in kept)


def test_repeated_rows_count_as_one_document(spark):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    passage = words(25)
    once = [(i, words(60) + " " + passage + " " + words(50)) for i in range(6)] + [(6, words(90))]
    again = once + [once[3]] * 3 + [once[0]] * 2 + [once[6]]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    want, got = {tuple(r) for r in chunks.report(make(once)).collect()}, chunks.report(make(again).repartition(3)).collect()
    assert len(got) == len(again) and {tuple(r) for r in got} == want
    assert all(r.n_removed > len(passage) / 3 for r in got if 0 < r.doc_id < 6) and all(r.n_removed == 0 for r in got if r.doc_id in (0, 6))


def brute_chunks(docs):
    """{(key, text): removed spans} by a plain scan: gear hashes byte by byte, dictionaries for digests and places."""
    table = [int(x) for x in chunks.gear()]

    def cuts(raw):
        gear = [0] * len(raw)
        for i in range(len(raw)):
            for k in range(min(chunks.WINDOW, i + 1)):
                gear[i] = (gear[i] + (table[raw[i - k]] << k)) & 0xFFFFFFFF
        mask = ((1 << chunks.MASK_BITS) - 1) << (chunks.WINDOW - chunks.MASK_BITS)
        ends, last = [], 0
        while last < len(raw):
            natural = [x for x in range(last + chunks.MIN, min(last + chunks.BACKUP, len(raw)) + 1) if gear[x - 1] & mask == 0]
            early = [x for x in range(last + 1, len(raw) + 1) if gear[x - 1] & mask == 0]
            if natural:
                near = [x for x in early if natural[0] <= x < natural[0] + chunks.MIN]
                last = min(near, key=lambda x: (gear[x - 1], x))
            elif (upto := next((x for x in early if x - last > chunks.BACKUP), len(raw))) - last > chunks.BACKUP:
                last = min(range(last + chunks.MIN, last + chunks.BACKUP + 1), key=lambda x: (gear[x - 1], x))
            else:
                last = upto
            ends.append(last)
        return ends

    places = {}
    for k, th, raw in docs:
        last = 0
        for end in cuts(raw):
            places.setdefault(raw[last:end], {}).setdefault((k, th), []).append((last, end))
            last = end
    lined = {}
    for where in places.values():
        if sum(map(len, where.values())) > 1:
            first = (min(where), min(where[min(where)]))
            for doc, spans in where.items():
                lined.setdefault(doc, []).extend((s, e, (doc, (s, e)) != first) for s, e in spans)
    out = {}
    for doc, spans in lined.items():
        runs, removed = [], set()
        for x in sorted(spans):
            runs[-1].append(x) if runs and runs[-1][-1][1] == x[0] else runs.append([x])
        for run in runs:
            if run[-1][1] - run[0][0] >= chunks.MIN_RUN:
                removed |= {i for s, e, drop in run if drop for i in range(s, e)}
        out[doc] = removed
    return out


def test_substring_dedup_equals_a_plain_scan(spark, docs):
    rng = random.Random(19)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    passage, other = words(40), words(25)
    extra = [(1, words(30) + passage), (1, other + words(20) + passage), (2, passage + words(10) + other), (3, "again and again " * 40), (4, other * 3)]
    every = spark.createDataFrame(extra + [(i, t) for i, t in rows_of(docs) if i is not None and len(t or "") < 6000][:60] + ODD, "doc_id long, text string")
    rows = [tuple(r) for r in keyed(every, "doc_id", "text").collect()]
    want = brute_chunks({(k, th, t.encode()) for k, th, _, t in rows})
    expected = []
    for k, th, i, t in rows:
        gone, raw = want.get((k, th), set()), t.encode()
        expected.append((i, len(raw), len(gone), hashlib.sha256(bytes(b for at, b in enumerate(raw) if at not in gone)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in chunks.report(every.withColumn("len", F.lit(1))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and sum(x[2] > 0 for x in expected) > 5


def test_unlike_texts_under_one_key_have_one_first_place(spark):
    rng = random.Random(20)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    passage = words(40)
    got = chunks.report(spark.createDataFrame([(1, words(30) + passage), (1, words(25) + passage), (2, passage + words(30))], "doc_id long, text string")).collect()
    assert sorted(r.n_removed > len(passage) / 2 for r in got) == [False, True, True]


def test_chunk_cuts_resist_insertions():
    rng = random.Random(3)
    raw = bytes(rng.randrange(256) for _ in range(20000))
    table = chunks.gear()
    split = lambda b: {b[s:e] for s, e in zip([0, *chunks.cut_points(b, table)], chunks.cut_points(b, table))}
    assert b"".join(raw[s:e] for s, e in zip([0, *chunks.cut_points(raw, table)], chunks.cut_points(raw, table))) == raw
    assert len(split(raw) & split(b"inserted" + raw)) > 0.95 * len(split(raw))


def test_chunk_cuts_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(6)
    raw = bytes(rng.randrange(97, 123) for _ in range(6000)) + b"a" * 3000 + b"red green blue " * 200
    table = chunks.gear()
    want = chunks.cut_points(raw, table)
    assert max(e - s for s, e in zip([0, *want], want)) < chunks.BACKUP + chunks.MIN
    for block in (100, 777, 3000):
        monkeypatch.setattr(chunks, "BLOCK", block)
        assert chunks.cut_points(raw, table) == want


def test_passages_that_repeat_words_are_cut_alike():
    rng, table, found = random.Random(7), chunks.gear(), 0
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))

    def split(text):
        ends = chunks.cut_points(text.encode(), table)
        return [text.encode()[s:e] for s, e in zip([0, *ends], ends)]

    for _ in range(50):
        passage = " ".join([words(rng.randrange(2, 6))] * 51)[:300]
        a, b = set(split(words(40) + passage + words(40))), split(words(30) + passage + words(50))
        best = run = 0
        for x in b:
            run = run + len(x) if x in a else 0
            best = max(best, run)
        found += best >= chunks.MIN_RUN
    assert found >= 47


def brute_repeats(docs, length):
    seen, raw = Counter(), [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    for i, b in raw:
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        yield i, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [500, 3])
def test_suffixes(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    planted = [base[:1000], "x" + base[100:700] + "y", base[300:699], base[1500:1900] + "q", "z" + base[1500:1900], base[:450] + "é" + base[451:1200], *(c + base[1000:1000 + 395 + k] for k, c in enumerate("mnopqrstuv"))]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(planted, 8000)), "doc_id long, text string"))
    got = suffixes.report(every.withColumn("h", F.lit(0))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_repeats(rows_of(every), suffixes.LENGTH)))


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(6)
    raw = bytes(rng.randrange(97, 101) for _ in range(9000)) + b"a" * 3000
    want = [x.tolist() for x in suffixes.anchors(raw)]
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    assert [x.tolist() for x in suffixes.anchors(raw)] == want


def test_merged_transforms_order_as_a_sort_does():
    import numpy as np

    rng = np.random.default_rng(8)
    strings = [rng.integers(1, 4, rng.integers(1, 30)).astype(np.uint16) for _ in range(40)]
    depth = 6
    of, breaks = suffixes.merge_transforms([suffixes.shard_transform(strings[a : a + 8]) for a in range(0, 40, 8)], depth)
    whole = Counter(tuple(s[i : i + depth].tolist()) for s in strings for i in range(len(s) - depth + 1))
    sizes = np.diff(np.append(np.flatnonzero(breaks), len(breaks)))
    assert len(of) == sum(len(s) + 1 for s in strings) and not Counter(whole.values()) - Counter(sizes.tolist())


def test_suffixes_and_chunks_without_rows(none):
    assert suffixes.report(none).count() == 0 and chunks.report(none).count() == 0


def test_repetitive_texts_are_few_rows(spark):
    """Texts that repeat themselves every byte or every few, alone and within others."""
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["a" * 3000, noise + "xyz" * 500 + noise[:300], "xyz" * 200, "a" * 400, "a" * 401, "ab" * 450 + "c", noise[100:600] + "a" * 450, ("word " * 300) + noise[::-1], noise[::-1][:450], "q" * 399]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, suffixes.report(df).collect()))) == sorted(map(str, brute_repeats(rows, suffixes.LENGTH)))
    assert suffixes.places(keyed(df, "doc_id", "text").where("__id = 0")).count() == 1


def test_ten_megabytes_of_one_letter(spark):
    import time

    df = spark.createDataFrame([(1, 10), (2, 1)], "doc_id long, n int").select("doc_id", F.repeat(F.lit("a"), F.col("n") * 1_000_000).alias("text"))
    began = time.time()
    assert [(r.doc_id, r.n_removed, r.n_spans) for r in suffixes.report(df).orderBy("doc_id").collect()] == [(1, 10_000_000, 1), (2, 1_000_000, 1)]
    assert time.time() - began < 60  # half that alone


# ---------------------------------------------------------------- op8

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(d[::-1])) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data(spark, docs):
    rng = random.Random(9)
    odd = ["a@b.c_x@d.e 1.2.3.4.5.6.7.8 1..2.3.4.5 🙂 +1 (858) 555-2128, 300.1.1.1 a@b", ("1.2.3.4 x@y.z ") * 700, "4495589438270767 4495589438270768 +49 (30) 1234567 000255.1.1.1", "1." * 3000, "a@" + "b." * 3000 + "c", "7" * 4000]
    odd += ["".join(rng.choice("0123456789.@+ -ab()") for _ in range(400)) for _ in range(40)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 6000)), "doc_id long, text string"))
    want = []
    for i, t in rows_of(every):
        own = brute_spans(t)
        want.append((i, *(sum(s[3] == k for s in own) for k in BASE), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in own).encode()).hexdigest()))
    got = [tuple(r)[:6] for r in pii.report(every.withColumn("base", F.lit(1))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    left = pii.redacted(every)
    assert all(not brute_spans(t) for _, t in rows_of(left.where("length(text) < 2000"))) and left.where("text is null").count() == every.where("text is null").count()


def test_added_kinds_and_context(spark):
    df = spark.createDataFrame([(1, "GB82 WEST 1234 5698 7654 32"), (2, "GB83 WEST 1234 5698 7654 32"), (3, "ssn 123-45-6789"), (4, "no 123-45-6789")], "doc_id long, text string")
    assert [r.spans for r in pii.report(df).orderBy("doc_id").collect()] == ["iban:0:27", "", "ssn:4:15", ""]
    [s] = pii.spans(df.where("doc_id = 3")).first().spans
    assert s.score == pytest.approx(0.8)


def test_added_kinds_next_to_others(spark):
    texts = ["SSN: 123-45-6789, 987-65-4321", "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 BIC X", "BE68 5390 0754 7034 BIC COBA", "ssn 123-45-6789" + " " * 30 + "987-65-4321", "ssn 123-45-6789" + "." * 12 + "987-65-4321"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.report(df).orderBy("doc_id").collect()] == ["ssn:5:16,ssn:18:29", "iban:5:32", "iban:0:22", "iban:0:19", "ssn:4:15", "ssn:4:15,ssn:27:38"]
    left = [r.text for r in pii.redacted(df).orderBy("doc_id").collect()]
    assert left[1] == "IBAN [IBAN] BIC COBADEFFXXX" and left[3] == "[IBAN] BIC COBA"


def test_added_kinds_by_sql(spark, docs):
    """The registered SQL on the rows that decide: country lengths, context over earlier matches, scores of all kinds."""
    import duckdb

    from lumenvault.llm import oracles

    texts = ["SSN: 123-45-6789, 987-65-4321", "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 BIC X", "BE68 5390 0754 7034 BIC COBA", "ssn 123-45-6789" + " " * 30 + "987-65-4321", "ssn 123-45-6789" + "." * 12 + "987-65-4321"]
    texts += ["GB82 WEST 1234 5698 7654 32", "ZZ12 3456 7890 1234 5678 X", "host 10.0.0.1, ip 1.2.3.4 5.6.7.8", "write to a@b.co or call +49 30 12345678, visa 4111 1111 1111 1111", "", None, "é 🙂 mail x@y.zz"]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(oracles.OP8)
    names, got = want.columns, pii.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())
    by = {r.doc_id: (r.spans, r.scores) for r in got.collect()}
    assert by[0] == ("ssn:5:16,ssn:18:29", "80,80") and by[1] == ("iban:5:32", "100") and by[8][1] == "90,90,90"


def test_one_context_rule_for_spans_and_redaction(spark):
    far, near = "ssn " + "." * 60 + " 123-45-6789", "12 34 56 78 90 12 SSN 1 2 123-45-6789 and 223-45-6789"
    df = spark.createDataFrame([(1, far), (2, near), (3, "ssn DE89 3704 0044 0532 0130 00 123-45-6789"), (4, None)], "doc_id long, text string").withColumn("spans", F.lit("extra"))
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert [s.kind for s in got[1].spans] == [] and [s.kind for s in got[2].spans] == ["ssn", "ssn"] and got[4].spans == []
    left = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert left[1] == far and left[2] == "12 34 56 78 90 12 SSN 1 2 [SSN] and [SSN]" and left[3] == "ssn [IBAN] [SSN]" and left[4] is None
    card = spark.createDataFrame([(1, "visa " + "1 a " * 8 + "4111111111111111")], "doc_id long, text string")
    assert [(s.kind, round(s.score, 2)) for s in pii.spans(card).first().spans] == [("card", 1.0)]


# ---------------------------------------------------------------- hot groups


def test_a_third_of_all_rows_are_copies(spark):
    """One text is a third of all rows, and another passage is in half of the rest."""
    rng = random.Random(41)
    noise = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(n))
    copy, passage = noise(90), noise(70)
    rows = [(i, copy) for i in range(60)] + [(100 + i, f"{noise(20)} {passage if i % 2 else noise(30)} {noise(20)}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert sorted(map(str, map(tuple, suffixes.report(df).collect()))) == sorted(map(str, brute_repeats(rows, suffixes.LENGTH)))
    named = brute_components({i: brute_fingerprint(t) for i, t in rows})
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == named and named[59] == 0
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in chunks.report(df).collect()}
    assert cut[0][1] == 0 and all(cut[i][0] == cut[i][1] for i in range(1, 60))
    within = [cut[100 + i][1] for i in range(120)]
    assert within[1] == 0 and not any(within[::2]) and all(n > 0.8 * len(passage) for n in within[3::2])
