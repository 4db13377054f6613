"""Files: the image source, partitioned sinks and the streaming jobs' repeats."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvault.operators import fingerprint, summary
from lumenvault.plans import queries
from lumenvault.sources import readers, sinks
from lumenvault.streaming import ingest


def png(pixels: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_stills_from_the_image_source(spark, tmp_path):
    pixels = np.random.default_rng(2).integers(0, 256, (40, 56, 3))
    (tmp_path / "a.png").write_bytes(png(pixels))
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = spark.read.format("image").option("dropInvalid", "true").load(str(tmp_path))
    [gray] = fingerprint.gray_of_image_source(images).collect()
    want = fingerprint.gray(pixels[:, :, 0], pixels[:, :, 1], pixels[:, :, 2]).astype(np.uint8)
    assert bytes(gray.pixels) == want.tobytes()
    [row] = fingerprint.fingerprint_stills(fingerprint.gray_of_image_source(images)).collect()
    assert row.phash == fingerprint.phash(want) and row.hash256 == fingerprint.hash256(want)


def test_red_is_gray_77():
    one = np.array([255])
    assert fingerprint.gray(one, 0 * one, 0 * one)[0] == 77


def test_manifest_and_shard_sinks(spark, tmp_path):
    inventory = spark.createDataFrame([("gallery/a", 5), ("gallery/b", 6)], "key string, size long")
    entries = inventory.select(F.lit("g1").alias("generation"), F.col("key").alias("source_key"), F.concat(F.lit("gallery/generations/g1/"), "key").alias("destination_key"), "size", F.lit("jpg").alias("extension"))
    header = summary.manifest_header(entries, inventory, "g1", 7, "s", 100)
    for _ in range(2):  # tried again, nothing is doubled
        sinks.manifest(entries, header, str(tmp_path / "m"))
        sinks.shard_plan(entries.select("source_key", "generation", F.lit(0).alias("round"), F.lit(3).alias("shard")), str(tmp_path / "s"))
        sinks.gallery_index(entries, 9, str(tmp_path / "i"))
        sinks.run_summary(spark.createDataFrame([(1, "uploaded", 5, 0)], "source_number int, status string, bytes long, return_code int"), "r1", str(tmp_path / "r"))
    other = entries.select(F.lit("g2").alias("generation"), "source_key", F.replace("destination_key", F.lit("g1"), F.lit("g2")).alias("destination_key"), "size", "extension")
    sinks.manifest(other, summary.manifest_header(other, inventory, "g2", 8, "s", 100), str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m/entries"))
    assert {r.generation: r["count"] for r in back.groupBy("generation").count().collect()} == {"g1": 2, "g2": 2}
    kept = spark.read.parquet(str(tmp_path / "m/headers")).where("generation = 'g1'").collect()
    assert [(r.version, r.created_at, r.seed, r.target_bytes, r.selected_objects, r.selected_bytes, r.inventory_bytes) for r in kept] == [(1, 7, "s", 100, 2, 11, 11)]
    assert (tmp_path / "s/generation=g1/round=0/shard=3").is_dir() and spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert [r.key for r in spark.read.parquet(str(tmp_path / "i/items")).collect()] == ["gallery/generations/g1/gallery/a", "gallery/generations/g1/gallery/b"]
    assert tuple(spark.read.parquet(str(tmp_path / "i/header")).first()) == (1, 9, 2) and spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_faulty_manifests_are_refused(spark, tmp_path):
    inventory = spark.createDataFrame([("gallery/a", 5), ("gallery/b", 6)], "key string, size long")
    entries = inventory.select(F.lit("g1").alias("generation"), F.col("key").alias("source_key"), F.concat(F.lit("gallery/generations/g1/"), "key").alias("destination_key"), "size")
    header = summary.manifest_header(entries, inventory, "g1", 7, "s", 100)
    assert not summary.manifest_violations(entries, header).first().refused
    faults = [header.withColumn(c, F.lit(v)) for c, v in (("version", 2), ("target_bytes", 0), ("inventory_objects", 1), ("selected_objects", 3), ("selected_bytes", 10), ("generation", ""))]
    for given, of in [(entries, h) for h in faults] + [(entries.unionByName(entries), header), (entries.withColumn("destination_key", F.concat(F.lit("gallery/generations/g2/"), "source_key")), header)]:
        with pytest.raises(ValueError, match="invalid manifest"):
            sinks.manifest(given, of, str(tmp_path / "m"))
    assert not (tmp_path / "m").exists()
    with pytest.raises(ValueError, match="cannot be published"):
        summary.refused_if_unverifiable(inventory.withColumn("sha1", F.lit("x")))


def test_acquisition_takes_a_key_once(spark):
    staged = spark.createDataFrame([("a", "jpg", 5), ("a", "jpg", 5), ("b", "exe", 5), ("c", "gif", 0), ("d", "png", 5), ("e", "png", 50)], "key string, extension string, size long")
    known = spark.createDataFrame([("d",)], "key string")
    assert [tuple(r) for r in ingest.acquire(spark, staged, known, 10).collect()] == [("a", 5)]


def test_too_many_sources_are_refused(spark):
    raw = spark.range(6).select(F.col("id").alias("position"), F.concat(F.lit("name"), "id").alias("value"))
    assert ingest.upsert_sources(spark, raw, 6).count() == 6
    with pytest.raises(Exception, match="more than 5 sources"):
        ingest.upsert_sources(spark, raw, 5)


def test_workers_find_the_package(spark):
    from lumenvault.operators import similarity
    from lumenvault.sources.shared import ROOT

    rows = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([0], [7])], "a array<long>, b array<long>")
    assert sorted(r[0] for r in rows.select(similarity.timeline_distance("a", "b", F.lit(1.0))).collect()) == [0.0, 3.0]
    assert ROOT in spark.sparkContext.environment["PYTHONPATH"].split(":")


def test_staged_folders_are_scanned_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """Against a plain walk; no scan lists more folders than it may, and tasks hold more than a few files."""
    want = set()
    for k in range(700):
        place = tmp_path / "staged" / f"part={k // 100}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{k}.txt").write_bytes(b"x" * (k + 1))
        want.add((f"{k}.txt", k + 1))
    tasks, written = [], readers.written
    monkeypatch.setattr(readers, "written", lambda df: tasks.append((len({p.rsplit("/", 2)[1] for p in df.inputFiles()}), df.rdd.getNumPartitions())) or written(df))
    found = readers.scanned_files(spark, str(tmp_path / "staged"), lambda files: files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length"), at_once=3)
    assert {tuple(r) for r in found.collect()} == want and found.count() == 700
    assert [n for n, _ in tasks] == [3, 3, 1] and all(p <= 8 for _, p in tasks)
    (tmp_path / "empty").mkdir()
    assert readers.scanned_files(spark, str(tmp_path / "empty"), lambda files: files.select("path")).count() == 0


def test_an_empty_table_stages_nothing(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["staged_scan"](spark, str(tmp_path)).count() == 0
