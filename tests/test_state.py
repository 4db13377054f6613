"""What lasts between runs: streaming state, versions of a sink, a stored index, a store rewritten in place."""

import os
import random

from pyspark.sql import functions as F

from lumenvault.operators import reconcile, similarity, store, summary
from lumenvault.operators.hash_index import HashIndex
from lumenvault.operators.postings import BITS, nth_bit, picked
from lumenvault.plans.fixtures import derived
from lumenvault.streaming import ingest
from lumenvault.streaming.batches import BatchLog

STATES = "generation string, status string, seq long, updated_at long, created_at long"


def test_a_later_event_sets_the_timer_anew(spark, tmp_path):
    day, folder = 86_400, str(tmp_path / "s")
    first = [("a", "building", 1, 1000, None), ("b", "building", 2, 1000, None), ("c", "active", 3, 1000, None), ("d", "ready", 4, None, 1000), ("e", "building", 5, 500_000, None)]
    run = lambda rows, now: sorted((r.generation, r.status, r.at) for r in ingest.idle_generations(spark, spark.createDataFrame(rows, STATES), now, day, 10_000_000, folder).collect())
    assert run(first, 1000 + day - 1) == []
    # `a` goes on; an event from before the time that was reached comes too late and changes nothing
    assert run([("a", "recovering", 6, 1000 + day, None), ("b", "ready", 9, 900, None)], 1000 + day) == [("b", "building", 1000), ("d", "ready", 1000)]
    assert run([], 1000 + 2 * day - 1) == [("b", "building", 1000), ("d", "ready", 1000)]
    assert run([], 1000 + 2 * day) == [("a", "recovering", 1000 + day), ("b", "building", 1000), ("d", "ready", 1000)]
    state = lambda: spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/offsets").count()
    assert state() == 1  # `e`
    assert run([], 500_000 + day)[-1] == ("e", "building", 500_000) and state() == 0


def test_acquisition_goes_on_from_its_state(spark, tmp_path):
    """What earlier batches wrote is taken away in between: a key is still known, so no batch reads it."""
    folder, schema = str(tmp_path / "a"), "key string, extension string, size long"
    known = spark.createDataFrame([("d",)], "key string")
    run = lambda rows: sorted(r.key for r in ingest.acquire(spark, spark.createDataFrame(rows, schema), known, 10, folder).collect())
    assert run([("a", "jpg", 5), ("d", "jpg", 5), ("c", "png", 11)]) == ["a"]
    for name in os.listdir(f"{folder}/sink"):
        os.rename(f"{folder}/sink/{name}", tmp_path / name)
    os.rename(tmp_path / "batch=-1", f"{folder}/sink/batch=-1")
    assert run([("a", "jpg", 7), ("b", "gif", 5), ("b", "gif", 5)]) == ["b"]


def test_sources_keep_the_first_of_their_names(spark):
    raw = spark.createDataFrame([(9, "r/Alpha"), (2, "ALPHA"), (5, "alpha"), (1, "beta_x"), (7, "bad name!")], "position long, value string")
    assert sorted(tuple(r) for r in ingest.upsert_sources(spark, raw).collect()) == [("alpha", "ALPHA", 2), ("beta_x", "beta_x", 1)]


def test_a_hundred_batches_are_few_folders(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), "n long", most=8)
    assert log.read().count() == 0
    rows = lambda n: spark.range(n, n + 1).select(F.col("id").alias("n"))
    held = None
    for n in range(100):
        log.add(rows(n), n)
        if n == 60:
            held = log.version()
            assert log.read(held).count() == 61
            log.add(rows(n), n)  # tried again
            assert log.version() == held
    assert {r.n for r in log.read().collect()} == set(range(100)) and log.read().count() == 100
    assert len(log.version()["folders"]) <= 9 and len(os.listdir(tmp_path / "log/data")) <= 20


def test_readers_see_one_version_while_folders_are_put_together(spark, tmp_path, monkeypatch):
    log = BatchLog(spark, str(tmp_path / "log"), "n long", most=3)
    rows = lambda n: spark.range(n, n + 1).select(F.col("id").alias("n"))
    seen, commit = [], BatchLog._commit

    def slow(self, last, **new):
        seen.append(sorted(r.n for r in log.read().collect()))  # between the writing of folders and of the version
        commit(self, last, **new)
        assert sorted(r.n for r in log.read(last).collect()) == seen[-1]

    monkeypatch.setattr(BatchLog, "_commit", slow)
    for n in range(6):
        log.add(rows(n), n)
    assert all(x == list(range(len(x))) for x in seen) and any(a == b for a, b in zip(seen[1:], seen[2:]))


def test_incremental_edges_equal_the_whole_join(spark, tmp_path):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(8)]
    near = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(13))) for b in base for _ in range(20)]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i % 3) for i, v in enumerate(near)], "h long, turn int").cache()
    got = set()
    for turn in range(3):
        index = HashIndex(spark, f"hashes_test_{turn}", str(tmp_path / "index"), 2, buckets=5)  # found again in its folder
        fresh = df.where(F.col("turn") == turn).select("h")
        plan_of = lambda most: index.near(fresh, 11, most)._jdf.queryExecution().executedPlan().toString()
        dealt, sent = plan_of(0), plan_of(8 << 20)
        assert "Bucketed: true" in dealt and dealt.count("Exchange hashpartitioning(slot") == 1  # the new side only
        assert "Exchange hashpartitioning(slot" not in sent and "BroadcastHashJoin" in sent
        assert {tuple(r) for r in index.near(fresh, 11, 0).collect()} == {tuple(r) for r in index.near(fresh, 11).collect()}
        found = {tuple(r) for r in index.near_new(fresh, 11).collect()}
        got |= found | {(y, x, d) for x, y, d in found}
        index.put(fresh)
        index.put(fresh)
        assert index.stored().count() == df.where(F.col("turn") <= turn).select("h").distinct().count()
    assert got == {tuple(r) for r in similarity.near_hashes(df.select("h"), df.select("h"), 2, 11).collect()}


def test_a_store_is_rewritten_where_it_changed(spark, tmp_path):
    path, parts = str(tmp_path / "store"), 8
    rows = [(f"k{i}", f"f{i}", i, "s", 2 if i % 7 else None, i * 3 if i % 7 else None) for i in range(200)]
    kind = "key string, file_id string, size long, sha1 string, fp_version int, phash long"
    stored = spark.createDataFrame(rows, kind)
    store.create(stored, path, parts)
    files = lambda: {p: sorted(f for f in os.listdir(f"{path}/part={p}") if f.endswith(".parquet")) for p in range(parts) if os.path.isdir(f"{path}/part={p}")}
    held = lambda: sorted((tuple(r) for r in spark.read.schema(kind).parquet(path).select(*store.COLUMNS).collect()), key=str)
    before, part = files(), {r.key: r.p for r in stored.select("key", store.part_of(F.col("key"), parts).alias("p")).collect()}
    remote = stored.select("key", "file_id", "size", "sha1")
    assert store.rewrite(spark, path, remote, parts) == 0 and files() == before
    gone = {k for k, p in part.items() if p == 3}
    moved = next(k for k, p in part.items() if p == 5)
    now = remote.where(~F.col("key").isin(list(gone))).withColumn("size", F.when(F.col("key") == moved, 10**6).otherwise(F.col("size")))
    assert store.rewrite(spark, path, now, parts) == 2
    after = files()
    assert {p for p in before if before[p] != after.get(p)} == {3, 5} and 3 not in after
    want = sorted(((k, f, 10**6 if k == moved else n, s, None if k == moved else v, None if k == moved else h) for k, f, n, s, v, h in rows if k not in gone), key=str)
    assert held() == want and store.rewrite(spark, path, now, parts) == 0 and held() == want


def test_digests_follow_changes_and_guard_the_queue(spark, sf):
    old, new = derived(spark, sf, "objects"), derived(spark, sf, "objects_v2")
    a, b = summary.multiset_digest(old), summary.multiset_digest(new)
    changes = reconcile.difference(old, new)
    side = lambda rows, *kinds: rows.join(changes.where(F.col("change").isin(*kinds)).select("key"), "key", "left_semi")
    moved = summary.updated_digest(a, side(new, "added", "changed"), side(old, "removed", "changed"))
    assert moved.first() == b.first() and summary.unchanged_since(moved, b) and not summary.unchanged_since(a, b)
    assert summary.unchanged_since(a, summary.multiset_digest(old.repartition(7))) and not summary.unchanged_since(a, summary.multiset_digest(old.unionByName(old.limit(1))))
    assert summary.multiset_digest(old.where("false")).first().objects == 0


def test_bits_are_found_by_rank(spark):
    rng = random.Random(2)
    marked = sorted(rng.sample(range(BITS), 300)) + []
    bits = spark.createDataFrame([(p,) for p in marked], "p long").agg(F.bitmap_construct_agg("p").alias("bits"))
    got = bits.select("bits", F.explode(F.sequence(F.lit(1), F.lit(len(marked)))).alias("n")).select("n", nth_bit(F.col("bits"), F.col("n")).alias("at")).collect()
    assert [r["at"] for r in sorted(got)] == marked


def test_tagged_picks_are_of_their_selection(spark):
    rng = random.Random(4)
    own = {i: {t for t in "abcde" if rng.random() < 0.5} | {"all"} for i in range(400)}
    items = spark.createDataFrame([(i, f"k{i}") for i in own], "item long, key string")
    terms = spark.createDataFrame([(i, t) for i, ts in own.items() for t in ts] * 2, "item long, term string")
    asked = {r: rng.choice([["all"], ["a"], ["a", "b"], ["b", "a", "c", "all"], ["a", "none"]]) for r in range(1500)}
    got = {r.request: r for r in picked(items, terms, spark.createDataFrame(list(asked.items()), "request long, terms array<string>"), "s").collect()}
    for r, ts in asked.items():
        fit = {f"k{i}" for i, have in own.items() if set(ts) <= have}
        assert (r in got) == bool(fit) and (not fit or (got[r].key in fit and got[r].total == len(fit)))
    assert len({got[r].key for r, ts in asked.items() if ts == ["all"]}) > 150


def test_batches_do_not_list_or_read_the_versions_before(spark, tmp_path, monkeypatch):
    log = BatchLog(spark, str(tmp_path / "log"), "n long", most=4)
    rows = lambda n: spark.range(n, n + 1).select(F.col("id").alias("n"))
    log.add(rows(0), 0)
    listed, names = [], BatchLog._names
    monkeypatch.setattr(BatchLog, "_names", lambda self, folder: listed.append(folder) or names(self, folder))
    for n in range(1, 12):
        log.add(rows(n), n)
    assert "versions" not in listed
    other = BatchLog(spark, str(tmp_path / "log"), "n long", most=4)
    assert other.version() == log.version() and {r.n for r in other.read().collect()} == set(range(12))
    other.add(rows(12), 12)  # another writer goes on, and the first one sees it
    assert log.version() == other.version() and log.version()["batch"] == 12
