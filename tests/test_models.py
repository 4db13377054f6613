"""Operators against short sequential models, on random and skewed inputs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvault.operators import consolidate, decisions, fingerprint, selection, similarity
from lumenvault.plans import prints, queries
from lumenvault.sources import readers, shared


@pytest.mark.parametrize("seed", [1, 2])
def test_near_hashes_are_complete(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << x for x in rng.sample(range(64), d)) for b in base for d in range(18)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "h long")
    for radius, distance in ((1, 7), (2, 11), (3, 15)):
        got = {(r.x, r.y) for r in similarity.near_hashes(df, df, radius, distance).collect()}
        assert got == {(a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}


@pytest.mark.parametrize("joined", [lambda h: similarity.near_hashes(h, h, 2, 11), lambda h: similarity.classes(h.select(F.col("h").cast("string").alias("key"), "h"), 2, 11), lambda h: similarity.moving_candidates(h.select(F.col("h").cast("string").alias("key"), F.lit(3).alias("kind"), F.col("h").alias("phash")))])
def test_near_hashes_send_no_side_whole(spark, joined):
    """A hash becomes up to 548 rows, which the size of its table does not show."""
    h = shared.written(spark.range(3000).select(F.xxhash64("id").alias("h")))
    plan = joined(h)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_prints_and_decisions_send_no_table_whole(spark, sf):
    """Prints hold arrays and written keys repeat, so both take far more than their tables show."""
    p = shared.written(prints.prints(spark, sf))
    met = shared.written(similarity.moving_candidates(p))
    cards = shared.written(met.select(F.col("a").alias("left_key"), F.col("b").alias("right_key"), F.lit("g1").alias("generation")))
    made = cards.select("left_key", "right_key", F.lit("delete left").alias("decision"), F.lit("g1").alias("seen"), F.lit("w").alias("file_id"))
    live = shared.written(p.select("key", "file_id"))
    rated = p.select("key", F.col("size").cast("double").alias("quality"))
    for df in (similarity.moving_edges(met, p), decisions.checked(made, cards, live), consolidate._cards(rated, met.withColumns({"score": F.lit(1.0), "evidence": F.lit("e")}), "g1")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_distance_beyond_the_bands_is_refused(spark):
    df = spark.createDataFrame([(1,)], "h long")
    with pytest.raises(ValueError):
        similarity.near_hashes(df, df, 1, 8)


def test_many_equal_hashes_join_as_one_value(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 1800, 5).otherwise(F.col("id") * 7919).cast("long").alias("h"))
    assert similarity.near_hashes(rows.select("h"), rows.select("h"), 2, 3).where("x = 5").count() >= 1


def test_very_many_copies_are_counted_and_not_paired(spark):
    """90 % of all keys share one hash; a row a key and none a pair comes out."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 18_000, -1).when(F.col("id") < 18_010, -2).otherwise(F.xxhash64("id")).cast("long").alias("h"))
    got = similarity.classes(rows, 2, 1)
    assert got.count() == 20_000
    assert {(r.copies, r.links) for r in got.where("h in (-1, -2)").collect()} == {(18_000, 18_009), (10, 18_009)}


@pytest.mark.parametrize("seed", range(2))
def test_classes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    owners = [(f"k{i}", rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7)))) for i in range(120)]
    signed = [(k, h - (1 << 64) if h >> 63 else h) for k, h in owners]
    got = {r.key: (r.copies, r.links) for r in similarity.classes(spark.createDataFrame(signed, "key string, h long"), 2, 8).collect()}
    assert got == {k: (sum(x == h for _, x in owners), sum((x ^ h).bit_count() <= 8 for _, x in owners) - 1) for k, h in owners}


@pytest.mark.parametrize("seed", range(3))
def test_survivors_follow_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    n = 40
    quality = {f"k{i:02}": rng.randrange(6) / 2 for i in range(n)}
    edges = {tuple(sorted(rng.sample(sorted(quality), 2))) for _ in range(60)}
    order = sorted(quality, key=lambda k: (-quality[k], k))
    near = {k: {b if a == k else a for a, b in edges if k in (a, b)} for k in quality}
    gone, kept = set(), {}
    for k in order:
        if k not in gone:
            kept[k] = True
            gone |= near[k] - set(kept)
    want = {k: k in kept and k not in gone for k in quality if near[k]}
    nodes = spark.createDataFrame(list(quality.items()), "key string, quality double")
    got = {r.key: r.survives for r in consolidate.survivors(nodes, spark.createDataFrame(list(edges), "a string, b string")).collect()}
    assert got == want


def walked(quality, edges):
    """{key: survives} of the keys that have an edge, by the walk from the best on."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept, gone = set(), set()
    for k in sorted(near, key=lambda k: (-quality[k], k)):
        if k not in gone:
            kept.add(k)
            gone |= near[k] - kept
    return {k: k in kept for k in near}


def test_a_long_chain_settles_in_few_rounds(spark):
    """10,000 nodes in order of quality, and shorter chains that meet in nodes with several better neighbours."""
    n = 10_000
    quality = {f"k{i:05}": float(n - i) for i in range(n)}
    edges = [(f"k{i:05}", f"k{i + 1:05}") for i in range(n - 1)]
    nodes = spark.createDataFrame(list(quality.items()), "key string, quality double")
    done, rounds = consolidate.settled(nodes, spark.createDataFrame(edges, "a string, b string"))
    assert {r.key: r.survives for r in done.collect()} == walked(quality, edges) and rounds < 20


@pytest.mark.parametrize("seed", range(3))
def test_chains_that_meet_follow_the_walk(spark, seed):
    rng = random.Random(seed)
    quality = {f"k{i:03}": float(rng.randrange(400)) for i in range(300)}
    order = sorted(quality, key=lambda k: (-quality[k], k))
    edges = [(order[i], order[j]) for i in range(300) for j in [i + rng.choice([1, 1, 1, 2, 7, 40])] if j < 300] + [tuple(rng.sample(order, 2)) for _ in range(40)] + [(order[5], k) for k in order[100:160]]
    done, rounds = consolidate.settled(spark.createDataFrame(list(quality.items()), "key string, quality double"), spark.createDataFrame(edges, "a string, b string"))
    assert {r.key: r.survives for r in done.collect()} == walked(quality, edges) and rounds < 60


def test_rounds_leave_no_tables_behind(spark):
    from lumenvault.sources.shared import work_dir

    held = lambda: set(os.listdir(work_dir(spark).removeprefix("file://"))) if os.path.isdir(work_dir(spark).removeprefix("file://")) else set()
    before = held()
    nodes = spark.createDataFrame([(f"k{i}", float(i)) for i in range(30)], "key string, quality double")
    consolidate.settled(nodes, spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(29)], "a string, b string"))
    assert len(held() - before) == 1


PRINTS = "key string, phash long, hash256 array<long>, crop_hashes array<long>, kind int, sha256 string, duration_ms long, frame_count long, timeline array<long>"


def test_moving_media_without_duration_are_compared_by_frames(spark):
    line = [(1 << (i % 40)) * 3 for i in range(48)]
    rows = [("a", 5, [5] * 4, [], 3, "s1", None, 48, line), ("b", 5, [5] * 4, [], 3, "s2", None, 29, line[10:39]), ("c", 5, [5] * 4, [], 3, "s3", 9000, 48, line), ("d", 5, [5] * 4, [], 3, "s4", 9000, 48, line), ("e", 5, [5] * 4, [], 3, "s5", None, None, []), ("f", 5, [5] * 4, [], 3, "s6", None, None, [])]
    p = spark.createDataFrame(rows, PRINTS)
    got = {(r.a, r.b): r.evidence for r in similarity.all_edges(p).collect()}
    assert got["a", "b"] == similarity.EXCERPT and got["c", "d"] == got["a", "c"] == similarity.SAME_MOVING
    assert not any("e" in k or "f" in k for k in got)
    classes = {r.key: r["class"] for r in similarity.media_classes(p).collect()}
    assert classes == {"a": "a", "b": "b", "c": "c", "d": "c", "e": "e", "f": "f"}
    out = similarity.all_edges(p, spark.createDataFrame([("c", "d")], "first_key string, second_key string"))
    assert {(r.a, r.b) for r in out.collect()} == set(got) - {("c", "d")}


def test_cards_are_numbered_by_survivor(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", 2.0), ("d", 0.5), ("e", 9.0), ("f", 0.1)], "key string, quality double")
    edges = spark.createDataFrame([("a", "b", 0.9, "x"), ("b", "d", 0.8, "x"), ("c", "f", 0.8, "x"), ("e", "f", 0.9, "x")], "a string, b string, score double, evidence string")
    got = sorted((r.pos, r.left_key, r.right_key) for r in consolidate.review_queue(nodes, edges, "g").collect())
    assert got == [(1, "b", "a"), (2, "b", "d"), (3, "e", "f")]


def test_decisions_hold_for_what_the_card_showed(spark):
    from lumenvault.operators import decisions

    queue = spark.createDataFrame([("a", "b", "g2"), ("a", "c", "g2"), ("a", "d", "g2"), ("e", "f", "g2")], "left_key string, right_key string, generation string")
    live = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3x"), ("e", "5"), ("f", "6")], "key string, file_id string")
    asked = [
        ("a", "b", "delete right", "g2", "2", "accepted"), ("a", "c", "delete right", "g2", "3", "changed"), ("a", "d", "delete right", "g2", "4", "changed"), ("a", "b", "delete right", "g1", "2", "stale"), ("x", "y", "keep both", "g2", None, "unknown"),
        ("e", "f", "keep both", "g2", None, "accepted"), ("a", "c", "keep both", "g2", None, "accepted"), ("a", "c", "keep both", None, None, "stale"), ("e", "f", "burn", "g2", "5", "invalid"), ("e", "f", None, "g2", None, "invalid"), ("a", "b", "delete right", "g2", None, "changed"),
    ]
    given = spark.createDataFrame([r[:5] for r in asked] * 2, "left_key string, right_key string, decision string, seen string, file_id string")
    judged = decisions.checked(given, queue, live)
    pick = lambda r: tuple(map(str, r))
    assert sorted(pick((r.left_key, r.right_key, r.decision, r.file_id, r.state)) for r in judged.collect()) == sorted(pick((a, b, d, f, s)) for a, b, d, _, f, s in asked * 2)
    out = decisions.applied(judged, spark.createDataFrame([("a", "c")], "first_key string, second_key string"))
    assert sorted(tuple(r) for r in out.collect()) == [("delete", "b", None, "2"), ("exclude", "e", "f", None)]


def test_deletion_is_not_transitive(spark):
    nodes = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "key string, quality double")
    edges = spark.createDataFrame([("a", "b", 0.95, "x"), ("b", "c", 0.94, "x")], "a string, b string, score double, evidence string")
    queue = consolidate.review_queue(nodes, edges, "g").collect()
    assert [(r.left_key, r.right_key) for r in queue] == [("a", "b")]


@pytest.mark.parametrize("seed", range(3))
def test_budget_selection_skips_and_goes_on(spark, seed):
    import hashlib

    rng = random.Random(seed)
    sizes = {f"gallery/{i}": int(rng.paretovariate(0.7) * 10) for i in range(150)} | {"other/x": 1}
    budget, left, want = 900, 900, set()
    for k in sorted((k for k in sizes if k.startswith("gallery/")), key=lambda k: hashlib.sha256(f"s\0{k}".encode()).hexdigest()):
        if sizes[k] <= left:
            want.add(k)
            left -= sizes[k]
    rows = spark.createDataFrame(list(sizes.items()), "key string, size long")
    assert {r.key for r in selection.budget_select(rows.repartition(7), budget, "s").collect()} == want


def test_budget_too_small_takes_the_smallest(spark):
    rows = spark.createDataFrame([("gallery/b", 5), ("gallery/a", 5), ("gallery/c", 9)], "key string, size long")
    assert [r.key for r in selection.budget_select(rows, 1, "s").collect()] == ["gallery/a"]


def test_a_key_listed_twice_is_refused(spark):
    with pytest.raises(ValueError, match="duplicate"):
        selection.budget_select(spark.createDataFrame([("gallery/a", 5), ("gallery/a", 6)], "key string, size long"), 10, "s")


def test_tag_sets_equal_brute_force(spark):
    rng = random.Random(5)
    items = {i: {t for t in range(9) if rng.random() < (0.95 if t == 0 else 0.3)} for i in range(200)}
    asked = {r: set(rng.sample(range(10), rng.randrange(1, 4))) for r in range(30)}
    asked[30] = asked[0]
    found = selection.with_all_tags(spark.createDataFrame([(i, t) for i, ts in items.items() for t in ts], "item long, tag long"), spark.createDataFrame([(r, t) for r, ts in asked.items() for t in ts] * 2, "request long, tag long"))
    want = sorted((r, i) for r, ts in asked.items() for i, own in items.items() if ts <= own)
    assert sorted(tuple(r) for r in found.collect()) == want and want


def test_picks_are_spread_and_of_their_bucket(spark):
    items = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("bucket"))
    asks = spark.range(4000).select(F.col("id").alias("request"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("bucket"))
    got = selection.random_pick(items, asks, "s").collect()
    own = {r.key: r.bucket for r in items.collect()}
    assert len(got) == 4000 and all(own[r.key] == ("a" if r.request % 2 == 0 else "b") and r.total == (100 if r.request % 2 == 0 else 200) for r in got)
    assert len({r.key for r in got}) > 290
    assert selection.random_pick(items, spark.createDataFrame([(1, "none")], "request long, bucket string"), "s").count() == 0


def test_picks_do_not_meet_whole_buckets(spark):
    items = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.lit("all").alias("bucket"))
    asks = spark.range(2000).select(F.col("id").alias("request"), F.lit("all").alias("bucket"))
    plan = selection.random_pick(items, asks, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "upto" in plan[plan.index("Join Inner") : plan.index("Join Inner") + 200]


@pytest.mark.parametrize("seed", range(3))
def test_shards_follow_the_heap(spark, seed):
    import heapq

    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), f"k{i:03}", rng.choice([0, 1, 1, 2, 7, 7, 7, 40, rng.randrange(300)])) for i in range(600)]
    want, shards = set(), 5
    for g in ("a", "b", None):
        loads = [(0, i) for i in range(shards)]
        for _, key, size in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            load, i = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, i))
            want.add((g, key, size, i))
    got = [tuple(r) for r in selection.byte_shards(spark.createDataFrame(rows, "generation string, key string, size long").repartition(5), shards).collect()]
    assert len(got) == len(want) and set(got) == want


def test_packing_sees_a_row_for_each_size():
    loads = [0, 10**12, 5]
    steps = selection._turns(loads, 3, 10**12)
    assert len(steps) <= len(loads) and sum(loads) == 10**12 + 5 + 3 * 10**12 and max(loads) - min(loads) <= 3


def test_index_documents_are_bounded(spark):
    n = 9000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("gallery/hot/"), F.col("id").cast("string"), F.lit(".jpg")).alias("key"), F.lit("jpg").alias("extension"), F.lit(5).cast("long").alias("size"))
    made = queries._index_documents(lambda name: rows)
    assert made.count() == 9 and made.agg(F.max(F.length("body"))).first()[0] < 1000 * 80


def test_scaled_shards_stay_within_one_object(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", rng.randrange(1, 1000)) for i in range(500)]
    got = selection.byte_shards_scaled(spark.createDataFrame(rows, "key string, size long"), 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    share = sum(s for _, s in rows) / 8
    assert len(got) == 8 and all(abs(r.n - share) <= 1000 for r in got)


def test_alignment_finds_the_excerpt():
    rng = np.random.default_rng(0)
    long = rng.integers(0, 2**63, 48).astype(np.uint64)
    at = 10 + np.floor(np.arange(48) * 28 / 47 + 0.5).astype(int)
    assert similarity.alignment_distance(long[at], long, 0.6) == 0
    assert similarity.alignment_distance(long[:0], long, 1.0) == 64


def test_perceptual_hash_survives_resizing(spark):
    image = np.round(fingerprint.resized(np.random.default_rng(1).integers(0, 256, (12, 12)).astype(float), 128)).astype(np.uint8)
    small = np.round(fingerprint.resized(image.astype(float), 64)).astype(np.uint8)
    assert (fingerprint.phash(image) ^ fingerprint.phash(small)).bit_count() <= 10
    rows = spark.createDataFrame([("a", 128, 128, bytearray(image.tobytes())), ("b", 20000, 20000, bytearray(b"x"))], "key string, width int, height int, pixels binary")
    [row] = fingerprint.fingerprint_stills(rows).collect()
    assert row.key == "a" and row.phash == fingerprint.phash(image) and len(row.hash256) == 4 and len(row.crop_hashes) == 7


def plain_bits(image, size, kept):
    """Low frequencies of an image by plain sums: bilinear samples, cosine sums, upper median."""
    import math

    h, w = len(image), len(image[0])

    def at(n, k):
        x = min(max((k + 0.5) * n / size - 0.5, 0), n - 1)
        low = int(x)
        return low, min(low + 1, n - 1), x - low

    grid = []
    for j in range(size):
        y0, y1, fy = at(h, j)
        row = []
        for i in range(size):
            x0, x1, fx = at(w, i)
            row.append((image[y0][x0] * (1 - fx) + image[y0][x1] * fx) * (1 - fy) + (image[y1][x0] * (1 - fx) + image[y1][x1] * fx) * fy)
        grid.append(row)
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / size)
    cos = [[math.cos(math.pi * (2 * x + 1) * k / (2 * size)) * scale(k) for x in range(size)] for k in range(kept)]
    half = [[sum(cos[u][y] * grid[y][x] for y in range(size)) for x in range(size)] for u in range(kept)]
    values = [sum(cos[v][x] * half[u][x] for x in range(size)) for u in range(kept) for v in range(kept)][1:]
    middle = sorted(values)[len(values) // 2]
    return values, middle


def test_registered_fingerprints_equal_plain_sums(spark, sf):
    """fingerprint_stills on the given vectors against cosine sums without arrays; bits at the median itself are left open."""
    got = {r.key: r for r in queries.QUERIES["fingerprint_stills"](spark, sf).collect()}
    from lumenvault.plans import prints

    images = {r.key: np.frombuffer(r.pixels, np.uint8).reshape(64, 64).tolist() for r in prints.pixels(spark, sf).collect()}
    assert got.keys() == images.keys()
    for key in sorted(images)[:3]:
        for bits, size, kept in (([got[key].phash], 32, 8), (got[key].hash256, 64, 16)):
            values, middle = plain_bits(images[key], size, kept)
            for n, v in enumerate(values):
                if abs(v - middle) > 1e-6:
                    assert (bits[n // 64] >> n % 64) & 1 == (v > middle)
        side = int(64 * 0.75)
        off = (64 - side) // 2
        values, middle = plain_bits([row[off : off + side] for row in images[key][off : off + side]], 32, 8)
        assert all((got[key].crop_hashes[1] >> n) & 1 == (v > middle) for n, v in enumerate(values) if abs(v - middle) > 1e-6)


def test_registered_gif_samples_equal_a_walk(spark, sf):
    from lumenvault.plans import prints

    frames = {}
    for r in prints.frames(spark, sf).collect():
        frames.setdefault(r.key, []).append((r.frame_index, r.timestamp_ns))
    want = set()
    for key, rows in frames.items():
        rows.sort()
        total, last = 100_000_000 * len(rows), -1
        for k in range(min(32, len(rows))):
            at = max(i for i, (_, t) in enumerate(rows) if t <= total * k // 32 or i == 0)
            at += at == last and at + 1 < len(rows)
            want.add((key, k, rows[at][0]))
            last = at
    assert {tuple(r) for r in queries.QUERIES["frame_sample_gif"](spark, sf).collect()} == want


def test_majorities_of_wide_hashes(spark):
    rng = random.Random(8)
    rows = [("a", i, rng.getrandbits(64) - (1 << 63), [rng.getrandbits(64) - (1 << 63) for _ in range(4)], [i]) for i in range(5)] + [("b", 3, -1, [-1, 0, 1, -2], [7]), ("b", 2, 0, [0, 0, 0, 0], [8])]
    got = {r.key: r for r in fingerprint.timelines(spark.createDataFrame(rows, "key string, frame_index long, h long, h256 array<long>, crops array<long>")).collect()}
    most = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) >= len(hs))
    for key in "ab":
        own = sorted(r for r in rows if r[0] == key)
        assert got[key].majority % (1 << 64) == most([r[2] for r in own]) and [x % (1 << 64) for x in got[key].majority256] == [most([r[3][w] for r in own]) for w in range(4)]
        assert got[key].timeline == [r[2] for r in own] and got[key].crop_hashes == own[0][4]


def test_gif_sampling_repeats_no_frame_while_others_are_left(spark):
    rows = spark.createDataFrame([("g", 0, 0, 100), ("g", 1, 100, 200)], "key string, frame_index long, start_ns long, duration_ns long")
    assert [(r["sample"], r.frame_index) for r in fingerprint.sampled_frames_gif(rows).orderBy("sample").collect()] == [(0, 0), (1, 1)]


def test_strict_readers_raise(spark):
    bad = spark.createDataFrame([('[{"key":"gallery/a"},{"key":"a","size":1},{"ext":"jpg"}]',)], "body string")
    assert [tuple(r) for r in readers.index_items(bad, strict=False).collect()] == [("gallery/a", None, None)]
    assert readers.index_items(spark.createDataFrame([('{"items":[{"key":"gallery/a"}]}',), ("{}",)], "body string"), strict=True).count() == 1
    with pytest.raises(Exception, match="bad row"):
        readers.index_items(bad, strict=True).collect()
    with pytest.raises(Exception, match="not a source list"):
        readers.source_list(spark.createDataFrame([(1, '{"sources":"x"}')], "list_id int, body string")).collect()


def test_classes_of_copies_consolidate_as_their_pairs(spark):
    """Most stills share one print: the class graph gives what the graph of all pairs gives, from far fewer edges."""
    rng = random.Random(12)
    base = rng.getrandbits(63)
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(63), n))
    prints = [base] * 60 + [flip(base, n) for n in (1, 2, 4, 6, 8, 10, 12)] + [flip(base, 14)] * 5 + [rng.getrandbits(63) for _ in range(5)] + [rng.getrandbits(63)] * 3
    rows = [(f"k{i:03d}", h, [h] * 4, [h ^ 1 << 40, h ^ 3], 1, f"s{i}", None, None, None) for i, h in enumerate(prints)]
    p = spark.createDataFrame(rows, PRINTS).cache()
    nodes = spark.createDataFrame([(r[0], float(rng.randrange(9))) for r in rows], "key string, quality double")
    apart = spark.createDataFrame([("k003", "k010"), ("k004", "k061")], "first_key string, second_key string")

    def linked(of):
        pairs = similarity.without_excluded(similarity.still_candidates(of).unionByName(similarity.crop_candidates(of)).distinct(), apart).cache()
        still = similarity.still_edges(pairs, of)
        return still.unionByName(similarity.crop_edges(pairs, of, still)).cache()

    members = similarity.media_classes(p, apart).cache()
    every, few = linked(p), linked(p.join(members.where("key = class").select("key"), "key", "left_semi"))
    rows_of = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows_of(consolidate.class_survivors(nodes, members, few)) == rows_of(consolidate.survivors(nodes, every))
    assert rows_of(consolidate.class_review_queue(nodes, members, few, "g")) == rows_of(consolidate.review_queue(nodes, every, "g"))
    assert every.count() > 1700 and few.count() < 150
