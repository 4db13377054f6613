"""Derived print and pixel tables: ids that pass a million, fingerprints of changes."""

import os

import numpy as np
from pyspark.sql import functions as F

from lumenvault.operators import fingerprint
from lumenvault.plans import prints, queries
from lumenvault.plans.fixtures import derived
from lumenvault.sources import shared
from lumenvault.streaming import ingest


def test_originals_and_keys_of_any_size(spark, tmp_path):
    ids = [0, 2, 3, 18, 999_999, 1_000_000, 1_000_002, 1_000_008, 2_000_002, 3_000_000]
    rows = [(v, [float((v * 31 + i * i * 7919) % 1009) for i in range(64)]) for v in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    p = prints.prints(spark, str(tmp_path)).collect()
    assert len(p) == len({r.id for r in p}) == len({r.key.split(".")[0] for r in p}) == len(ids) + 2 * sum(v % 2 == 0 for v in ids)
    moving = {r.key for r in p if r.copy == 0 and r.base % 3 == 0}
    assert len(moving) == sum(v % 3 == 0 for v in ids)
    counted = {r.key: r["count"] for r in prints.frames(spark, str(tmp_path)).groupBy("key").count().collect()}
    assert counted == dict.fromkeys(moving, 96)
    keys = {(r.base, r.copy): r.key for r in p}
    want = {tuple(sorted((keys[v, 0], keys[v, 1]))) for v in ids if v % 18 == 0}
    assert {tuple(r) for r in queries._excluded(spark, str(tmp_path)).collect()} == want


def test_changes_get_the_fingerprints_of_their_pixels(spark, sf):
    stored, remote = derived(spark, sf, "stored"), derived(spark, sf, "objects_v2")
    got = {r.key: r for r in queries.QUERIES["stream_fingerprint_hashes"](spark, sf).collect()}
    batch = {r.key: r.phash for r in queries.QUERIES["fingerprint_stills"](spark, sf).select("key", "phash").collect()}
    was = {r.key: r.phash for r in stored.collect()}
    assert len(got) == remote.count() and any(r.computed for r in got.values()) and not all(r.computed for r in got.values())
    for key, r in got.items():
        number = int(key.split("/")[-1].split(".")[0])
        assert r.phash == (batch[f"v{number % len(batch)}"] if r.computed else was[key])


def test_changes_without_an_image_are_not_called_computed(spark, sf):
    none = lambda keys: prints.object_pixels(keys.where("false"), sf, 1)
    got = ingest.fingerprint_changes(spark, derived(spark, sf, "stored"), derived(spark, sf, "objects_v2"), none)
    assert got.where("computed").count() == 0 and got.where("phash is null").count() > 0


def test_moving_fingerprints_come_from_chosen_frames_only(spark, tmp_path):
    """Against a walk over all frames; the files of frames that nothing chooses are spoilt before."""
    rows = [(v, [float((v * 31 + i * i * 7919) % 1009) for i in range(64)]) for v in (3, 9, 15, 30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    meta, path = prints.frame_metadata(spark, str(tmp_path)), str(tmp_path / "frames")
    pixels = prints.stored_frames(spark, str(tmp_path), path)
    images = {(r.key, r.frame_index): np.frombuffer(r.pixels, np.uint8).reshape(16, 16) for r in pixels.collect()}
    chosen = {}
    for r in fingerprint.chosen_frames(meta).collect():
        chosen.setdefault(r.key, {})[r.sample] = r.frame_index
    assert {k: len(v) > 32 for k, v in chosen.items()} == {"gallery/v3-0.mp4": True, "gallery/v9-0.mp4": True, "gallery/v15-0.mp4": False, "gallery/v30-0.mp4": False}
    used = {f for own in chosen.values() for f in own.values()}
    spoilt = set(range(96)) - used
    assert len(spoilt) > 20
    for f in spoilt:
        for name in os.listdir(f"{path}/frame_index={f}"):
            with open(f"{path}/frame_index={f}/{name}", "wb") as out:
                out.write(b"no parquet")
    got = {r.key: r for r in fingerprint.moving_fingerprints(meta, pixels).collect()}
    most = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) >= len(hs))
    for key, own in chosen.items():
        shown = [images[key, own[k]] for k in sorted(own)]
        assert got[key].timeline == [fingerprint.phash(x) for x in shown] and got[key].samples == len(shown)
        assert got[key].majority % (1 << 64) == most(got[key].timeline) and got[key].crop_hashes == fingerprint.crop_hashes(shown[0])
        assert [x % (1 << 64) for x in got[key].majority256] == [most([fingerprint.hash256(x)[w] for x in shown]) for w in range(4)]
    assert got.keys() == chosen.keys()


def test_choices_that_are_not_small_are_not_sent_whole(spark):
    """Written choices repeat so much that their files are small; what counts is what their rows take."""
    chosen = shared.written(spark.range(50_000).select((F.col("id") % 7).cast("string").alias("key"), (F.col("id") % 48).alias("frame_index")))
    pixels = spark.range(100).select(F.col("id").cast("string").alias("key"), F.col("id").alias("frame_index"))
    plan = lambda most: pixels.join(shared.small(chosen, most), ["key", "frame_index"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(8 << 20) and "Broadcast" not in plan(1 << 20)
