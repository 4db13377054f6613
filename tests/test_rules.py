"""Column rules, readers and gates on inputs whose results are known."""

import pytest
from pyspark.sql import functions as F

from lumenvault.functions import rules
from lumenvault.operators import dedup, reconcile, similarity, summary
from lumenvault.sources import readers, sinks
from lumenvault.streaming import ingest

c = F.col


def asked(spark, given, rule):
    df = spark.createDataFrame(list(enumerate(given)), "position long, value string")
    return [r.x for r in df.select("position", rule(c("value")).alias("x")).orderBy("position").collect()]


def test_source_names(spark):
    given = {
        "r/TestSource": "TestSource", "testsource": "testsource", "https://old.reddit.com/r/OtherSource/": "OtherSource", " /r/Name/new/ ": "Name", "name/": "name", "/name/": "name", "http://reddit.com/r/abc": "abc",
        "https://www.reddit.com/r/abc?x=1": "", "https://www.reddit.com/r/abc/top/?x=1": "abc", "https://m.reddit.com/r/abc": "", "name/more": "", "ab": "", "bad-name": "", "": "", None: "", "R/Upper/x": "Upper", "https://example.org/r/abc/": "",
    }
    assert asked(spark, given, rules.normalised_source) == [f"https://www.reddit.com/r/{n}/new/" if n else "" for n in given.values()]


def test_source_names_of_requests(spark):
    given = {
        "r/TestSource": "TestSource", "name/": "name", "name/more": "name", "HTTPS://OLD.reddit.com:443//r//abc/x": "abc", "https://me@reddit.com/r/abc": "abc", "https://reddit.com/r/abc?x=1": "abc", "https://reddit.com/x/r/abc": "",
        "https://evilreddit.com/r/abc": "", "https://reddit.com/r": "", "": "", None: "", "r/ab": "", "/r/abc/": "abc",
    }
    assert asked(spark, given, rules.normalised_source_api) == list(given.values())


def test_source_lists(spark):
    rows = spark.createDataFrame(list(enumerate(["r/TestSource", "testsource", "https://old.reddit.com/r/OtherSource/"])), "position long, value string")
    found = dedup.required_sources(dedup.distinct_sources(rows, rules.normalised_source))
    assert sorted(r.source for r in found.collect()) == ["https://www.reddit.com/r/OtherSource/new/", "https://www.reddit.com/r/TestSource/new/"]
    with pytest.raises(ValueError, match="no valid source"):
        dedup.required_sources(dedup.distinct_sources(rows.limit(0), rules.normalised_source))


def test_recipients(spark):
    big, ok = rules.MAX_MESSAGE + 1, 10
    given = [("no-at", big, "too large"), ("no-at", ok, "malformed"), ("@example.org", ok, "malformed"), ("a@", ok, "malformed"), ("x-k9@other.org", ok, "foreign"), ("DMCA@Example.ORG", ok, "fixed"), ("x-K9@example.org", ok, "no suffix"), ("x@example.org", ok, "no suffix")]
    given += [("-k9@example.org", ok, "bad alias"), (".x-k9@example.org", ok, "bad alias"), ("x.-k9@example.org", ok, "bad alias"), ("a b-k9@example.org", ok, "bad alias"), ("O'Hara+x/y=1{~}-k9@example.org", ok, "alias"), ("a@b-k9@example.org", ok, "bad alias")]
    df = spark.createDataFrame(given, "recipient string, size long, want string")
    assert df.where(rules.recipient_verdict(c("recipient"), c("size"), "example.org", "-k9") != c("want")).count() == 0


def test_html(spark):
    given = {"<STYLE>a</script>b</style>c": "c", "<script>x</style>y</SCRIPT>z": "z", "a<br/>b<BR >c</p>d": "a\nb\nc\n\nd", " &NBSP;x&Amp;lt; ": "  x< ", "<styles>x</style>": "", "a < b": "a < b"}
    assert asked(spark, given, rules.html_text) == list(given.values())


def test_null_keys_and_records_are_invalid(spark):
    df = spark.createDataFrame([(None, 5, ""), ("a", None, ""), ("a", 5, None), ("a", 5, "none")], "key string, size long, sha1 string")
    assert [r.x for r in df.select(rules.safe_key(c("key")).alias("x")).collect()] == [False, True, True, True]
    assert df.where(~rules.valid_record(c("size"), c("sha1"))).count() == 2


def test_buckets(spark):
    assert asked(spark, ["JPG", "gif", "txt", None], rules.buckets_of) == [["all", "stills", "jpg"], ["all", "clips", "gif"], ["all"], ["all"]]
    assert asked(spark, ["Stills", "webm", "odd", "all"], rules.requested_bucket) == ["stills", "webm", "all", "all"]


def test_weights_of_the_copy_to_keep(spark):
    df = spark.createDataFrame([(1024, 1024, 1000, 3, "mp4", 1 << 20), (1024, 1024, None, 1, "png", 1 << 20), (1, 1, None, None, "txt", 1)], "w long, h long, d long, k int, e string, s long")
    rate = lambda **kw: [r.q for r in df.select(rules.survivor_quality(*map(c, "whdkes"), **kw).alias("q")).collect()]
    assert rate() == pytest.approx([20 + 0.9 * 9.965784284662087 + 1.6, 20 + 0.12 + 1.6, float("-inf")])
    assert rate(lasting=0.0, bytes_=0.0, lossless=1.0) == pytest.approx([20, 21, float("-inf")])


def test_published_objects_without_metadata_fail(spark):
    entries = spark.createDataFrame([(f"s{i}", f"d{i}", 5, sha) for i, sha in enumerate(["x", "x", "x", "x", "", "x"])], "source_key string, destination_key string, size long, sha1 string")
    listed = spark.createDataFrame([("d0", 5, "x", "g"), ("d1", 5, None, "g"), ("d2", 5, "x", None), ("d3", 6, "x", "g"), ("d4", 5, None, "g")], "key string, size long, sha1 string, generation string")
    good = lambda g: sorted(r.source_key for r in reconcile.verified(entries, listed, g).where("ok").collect())
    assert good("g") == ["s0", "s4"] and good("") == ["s0", "s2", "s4"]


def test_listings(spark):
    rows = spark.createDataFrame([("a/b.JPG", 5, "upload", "none", None, None), ("a/c", 5, "upload", "none", "d", "x/y"), ("a/d", 5, "upload", "", "d", "x/y")], "file_name string, content_length long, action string, content_sha1 string, large_file_sha1 string, content_type string")
    got = readers.inventory_sorted(rows.withColumn("file_id", F.lit("f")).withColumn("upload_timestamp", F.lit(1))).collect()
    assert [(r.key, r.sha1, r.content_type, r.extension) for r in got] == [("a/b.JPG", "", "application/octet-stream", "jpg"), ("a/c", "d", "x/y", ""), ("a/d", "", "x/y", "")]


def test_tag_index(spark):
    body = '{"version":1,"catalog":[["a",2],["",5],["c",0],["d",1]],"items":[["gallery/1","JPG",[0,3]],["gallery/2","jpg",[1]],["gallery/3","jpg",[2]],["gallery/4","jpg",[9]],["gallery/5","jpg"],["x/6","jpg",[0]],["gallery/7","txt",[0]],["gallery/8","webm",[]]]}'
    df = spark.createDataFrame([(1, body), (2, body.replace('"version":1', '"version":2')), (3, "no json")], "index_id long, body string")
    assert [tuple(r) for r in readers.tag_index(df).collect()] == [(1, 0, "gallery/1", "jpg", [0, 3]), (1, 7, "gallery/8", "webm", [])]
    assert readers.tag_index(df, most_of_item=1).count() == 1 and readers.tag_index(df, most_tags=3).count() == 0


def pair(spark, **sides):
    """Prints of keys with the fields given, others plain."""
    plain = {"hash256": [0, 0, 0, 0], "crop_hashes": [0], "kind": 1, "duration_ms": None, "frame_count": None, "timeline": None}
    order = ["phash", "hash256", "crop_hashes", "kind", "sha256", "duration_ms", "frame_count", "timeline"]
    schema = "key string, phash long, hash256 array<long>, crop_hashes array<long>, kind int, sha256 string, duration_ms long, frame_count long, timeline array<long>"
    return spark.createDataFrame([(k, *[{**plain, "sha256": k, **v}[n] for n in order]) for k, v in sides.items()], schema)


def test_edges_and_their_evidence(spark):
    crop = pair(spark, a={"phash": 0, "crop_hashes": [0xFFFF]}, b={"phash": 0xFFFF, "crop_hashes": [0xAAAAAAAAAAAAAAAA - (1 << 64)]})
    assert [(r.a, r.b, r.evidence) for r in similarity.all_edges(crop).collect()] == [("a", "b", "convincing crop or reframe")]
    same = pair(spark, a={"phash": 0}, b={"phash": 0b111 | 0b111 << 16 | 0b111 << 32 | 0b1 << 48})
    [edge] = similarity.all_edges(same).collect()
    assert edge.evidence == "same image after resize or recompression" and edge.score == pytest.approx(1 - 0.55 * 10 / 64)
    long = [(i * 0x9E3779B97F4A7C15) % (1 << 62) for i in range(48)]
    short = [long[10 + int(i * 28 / 47 + 0.5)] for i in range(48)]
    moving = pair(spark, a={"kind": 3, "phash": 0, "duration_ms": 6_000, "timeline": short}, b={"kind": 3, "phash": 0, "duration_ms": 10_000, "timeline": long})
    assert [r.evidence for r in similarity.all_edges(moving).collect()] == ["strongly matched moving-media excerpt"]
    whole = pair(spark, a={"kind": 3, "phash": 0, "duration_ms": 10_000, "timeline": long}, b={"kind": 3, "phash": 1, "duration_ms": 10_000, "timeline": long})
    assert [r.evidence for r in similarity.all_edges(whole).collect()] == ["same moving media after re-encode or resize"]


def test_runs_that_staged_nothing_are_refused(spark):
    none = spark.createDataFrame([(1, None, 1), (2, None, 3)], "source_number int, status string, return_code int")
    assert {r.refused for r in summary.source_counts(none).collect()} == {True}
    some = none.unionByName(spark.createDataFrame([(3, None, 0)], none.schema))
    assert {r.refused for r in summary.source_counts(some).collect()} == {False}


def test_inventory_digest_grows_its_buckets(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("f").alias("file_id"), F.col("id").alias("size"), F.lit("s").alias("sha1"))
    one, other = summary.digest(rows).first(), summary.digest(rows.repartition(7)).first()
    assert one == other and summary.digest(rows, rows=1).first().objects == 3000
    assert summary.digest(rows.where("id > 0")).first().digest != one.digest and summary.digest(rows.limit(0)).count() == 1


def test_canonical_index_sink(spark, tmp_path):
    rows = spark.createDataFrame([("gallery/b", "f2", 5, "s", "t", "jpg", 7), ("gallery/a", "f1", 4, "s", "t", "gif", 8)], "key string, file_id string, size long, sha1 string, content_type string, extension string, upload_timestamp long")
    sinks.canonical_index(rows, str(tmp_path / "i"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "i/items")).collect()]
    assert sorted(lines)[0] == '{"content_type":"t","ext":"gif","file_id":"f1","key":"gallery/a","sha1":"s","size":4,"upload_timestamp":8}' and len(lines) == 2
    assert spark.read.json(str(tmp_path / "i/header")).first()["count"] == 2


def test_a_batch_that_is_tried_again_replaces_its_rows(spark, tmp_path):
    sink = ingest._begin(spark, str(tmp_path / "sink"), "key string, size long")
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "key string, size long")
    ingest._put(batch, sink, 0)
    ingest._put(batch, sink, 0)
    ingest._put(batch.limit(1), sink, 1)
    assert ingest._taken(spark, sink, "key string, size long").count() == 3 and ingest._taken(spark, sink, "key string, size long", 1).count() == 2


def test_index_checkpoints(spark):
    index = spark.createDataFrame([("a", "jpg", 1), ("z", "gif", 9)], "key string, ext string, size long")
    done = spark.createDataFrame([("a", "jpg", 10 + i, i) if i % 2 else (f"k{i}", "png", i, i) for i in range(20)], "key string, ext string, size long, position long")
    got = {r.key: r["size"] for r in ingest.checkpoint_index(spark, index, done.repartition(5), 4).collect()}
    assert got == {"a": 29, "z": 9} | {f"k{i}": i for i in range(0, 20, 2)}
