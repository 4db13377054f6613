"""The pipeline against brute force, stage by stage and as a whole, with odd rows, and all operators on odd tables."""

import base64

import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, brute_components, brute_contamination, brute_fingerprint, brute_spans

import corpus_pipeline
from lumenvault.llm import bpe, chunks, decontaminate, merkle, pii, queries, simhash, suffixes, toxicity, urls
from lumenvault.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """Given tables with odd rows, an extra column that clashes with one that a stage adds, and repeated keys."""
    path = tmp_path_factory.mktemp("pipeline")
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame(ODD + [(9006, "another text under a key of its own kind"), (9009, "ssn 123-45-6789 and a@b.example")], "doc_id long, text string")
    odd = odd.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    docs.select(*COLUMNS).unionByName(odd).withColumn("score", F.lit("extra")).withColumn("token_ids", F.lit("extra")).coalesce(3).write.parquet(str(path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_stages_equal_brute_force(spark, folder):
    import tiktoken

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "encoding"]
    stage = dict(corpus_pipeline.STAGES)
    given = table(spark, folder, "documents")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)

    model = toxicity.fit(given, table(spark, folder, "labels"))
    import numpy as np

    mark = np.zeros(1 << toxicity.BITS, np.int32)
    calm = stage["toxicity"](spark, given, folder).cache()
    assert pairs(calm) == [(i, t) for i, t in pairs(given) if model.score(toxicity.features(t or "", mark)) < corpus_pipeline.TOXIC]
    assert calm.columns == given.columns and calm.where("score = 'extra'").count() == calm.count() < given.count()

    single = stage["near_dedup"](spark, calm, folder).cache()
    rows = pairs(calm)
    named = brute_components({n: brute_fingerprint(t) for n, (_, t) in enumerate(rows)})
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(named[n], set()).add((i, t or ""))
    kept = [(i, t or "") for i, t in pairs(single)]
    assert len(kept) == len(groups) and single.columns == given.columns
    for group in groups.values():
        least = min((i for i, _ in group if i is not None), default=None)
        [own] = [x for x in kept if x in group]
        assert own[0] == least

    clean = stage["decontamination"](spark, single, folder).cache()
    bench = [tuple(r) for r in table(spark, folder, "benchmark").select("item_id", "text").collect()]
    judged = list(brute_contamination(pairs(single), bench))
    assert pairs(clean) == [x for x, j in zip(pairs(single), judged) if not j[-1]] and any(j[-1] for j in judged)

    safe = stage["pii"](spark, clean, folder).cache()
    before, after = {i: t for i, t in pairs(clean)}, {i: t for i, t in pairs(safe)}
    assert safe.count() == clean.count() and safe.columns == given.columns and after[9009] == "ssn [SSN] and [EMAIL]"
    for i, t in before.items():
        assert (after[i] is None) == (t is None) and not brute_spans(after[i]) and (after[i] == t or brute_spans(t) or "[SSN]" in after[i] or "[IBAN]" in after[i])

    done = stage["encoding"](spark, safe, folder)
    path, pattern = queries.tokenizer("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = [(i, t, library.encode_ordinary(t or "")) for i, t in pairs(safe)]
    assert sorted(((r.doc_id, r.text, r.token_ids) for r in done.collect()), key=str) == sorted(want, key=str)

    whole = corpus_pipeline.run(spark, folder)
    assert sorted(((r.doc_id, r.text, r.token_ids) for r in whole.collect()), key=str) == sorted(want, key=str)
    assert whole.where("n_tokens <> size(token_ids) or n_chars <> length(text)").count() == 0 and whole.columns == [c for c in given.columns if c != "token_ids"] + ["token_ids", "n_tokens"]


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


VOCABULARY = queries.tokenizer("byte_bpe_multi_50k.tiktoken")
#: Each operator that gives a row for each row, as a function of (documents, benchmark, labels).
ROWWISE = {
    "op2": lambda d, b, y: simhash.near_duplicates(d),
    "op3": lambda d, b, y: toxicity.scored(d, toxicity.fit(d, y)),
    "op4": lambda d, b, y: decontaminate.contamination(d, b),
    "op5": lambda d, b, y: merkle.edited_report(d),
    "op6": lambda d, b, y: bpe.count_tokens(d, queries.tokenizer("word_bpe_49k.json")[0]),
    "op7": lambda d, b, y: chunks.report(d),
    "op8": lambda d, b, y: pii.report(d),
    "op9": lambda d, b, y: bpe.digests(d, *VOCABULARY),
    "op9 ids": lambda d, b, y: bpe.encode_column(d, *VOCABULARY),
    "op10": lambda d, b, y: suffixes.report(d),
}


@pytest.fixture(scope="module")
def clashing(spark, folder):
    names = ("score", "fp", "component_id", "n_tokens", "n_bytes", "token_ids", "over_limit", "ids_sha256", "decoded_sha256", "spans", "fingerprint", "edit_at", "n_hit", "items_sha256", "n_removed", "kept_sha256", "N_Words", "Score_", "h", "w", "run", "item", "class", "first")
    return table(spark, folder, "documents").select("doc_id", "text", *[F.lit("extra").alias(n) for n in names])


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_clashing_columns_change_nothing(spark, folder, clashing, name):
    others = table(spark, folder, "benchmark"), table(spark, folder, "labels")
    plain, odd = (ROWWISE[name](d, *others) for d in (clashing.select("doc_id", "text"), clashing))
    assert len({c.lower() for c in odd.columns}) == len(odd.columns)
    rounded = lambda x: round(x, 6) if isinstance(x, float) else x
    rows = lambda df: sorted(str([rounded(r[c]) for c in plain.columns]) for r in df.select(*plain.columns).collect())
    assert rows(odd) == rows(plain) and odd.count() == clashing.count()


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_empty_tables(spark, name):
    docs, bench, labels = (spark.createDataFrame([], s) for s in ("doc_id long, text string, score string", "item_id long, text string", "doc_id long, toxic int"))
    assert ROWWISE[name](docs, bench, labels).count() == 0


@pytest.fixture(scope="module")
def huge(spark):
    """A text of over 10 MB, its near copy, and a short one."""
    words = F.transform(F.sequence(F.lit(1), F.lit(1_500_000)), lambda i: F.concat(F.substring(F.md5(i.cast("string")), 1, 6), F.when(i % 40 == 0, ".\n").otherwise("")))
    text = F.array_join(words, " ")
    return spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 2, "short").otherwise(F.concat(text, F.col("id").cast("string"))).alias("text")).repartition(3)


@pytest.mark.parametrize("name", sorted(set(ROWWISE) - {"op9 ids"}))
def test_a_text_of_ten_megabytes(spark, huge, name):
    bench = spark.createDataFrame([(1, "no such words here")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    if name == "op8":  # a million numbers take a minute: a fifth of them here
        huge = huge.withColumn("text", F.substring("text", 1, 2_000_000))
    got = {r.doc_id: r for r in ROWWISE[name](huge, bench, labels).collect()}
    assert len(got) == 3
    if name == "op2":
        assert got[0].component_id == got[1].component_id == 0 and got[2].component_id == 2
    if name == "op4":
        assert got[0].n_words == 1_500_001 and not got[0].contaminated
    if name == "op7":
        assert got[1].n_removed > 10_000_000 > got[0].n_removed
    if name == "op10":
        assert got[0].n_removed > 10_000_000 and got[1].n_removed > 10_000_000 and got[2].n_removed == 0


def test_urls_of_odd_tables(spark):
    long = "http://a.example.com/" + "x/" * 200_000
    got = urls.judge(spark.createDataFrame([(1, long), (None, long), (1, None), (1, long)], "page_id long, url string").withColumn("host", F.lit(3))).collect()
    assert len(got) == 4 and sum(r.rule == "com/" for r in got) == 3


def test_near_copies_are_found_without_sending_a_side_whole(spark, sf, monkeypatch):
    """The listed fingerprints are many more rows than their table shows, so they are not built on the driver."""
    plans, links = [], simhash.links

    def seen(fps, hot):
        out = links(fps, hot)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "links", seen)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < corpus_pipeline.drop_near_copies(spark, docs, sf).count() <= docs.count()
    assert plans and all("SortMergeJoin" in x and "Broadcast" not in x for x in plans)
