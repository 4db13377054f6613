"""Registered queries of the catalogue operators, each with its oracle in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import consolidate, decisions, dedup, fingerprint, postings, reconcile, selection, similarity, store, summary
from ..operators.hash_index import HashIndex
from ..sources import readers
from ..sources.shared import cut, dealt
from ..streaming import ingest
from . import prints as P
from .fixtures import BUDGET, NOW, SEED, SHARDS, derived, from_sql, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Registers a function of (t, spark, sf_dir), where t(name) gives a table, under its own name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: derived(spark, sf_dir, name), spark, sf_dir)
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return put


# ---------------------------------------------------------------- sources and sinks


@query("""SELECT file_name AS key, content_length AS size, coalesce(nullif(content_sha1, ''), large_file_sha1, '') AS sha1, file_id, content_type
FROM {listing} l WHERE action = 'upload' AND content_length > 0""")
def inventory_scan(t, spark, sf_dir):
    return readers.inventory(t("listing"))


@query("""SELECT file_name AS key, content_length AS size, CASE WHEN content_sha1 = 'none' THEN coalesce(large_file_sha1, '') ELSE coalesce(content_sha1, '') END AS sha1, file_id, coalesce(content_type, 'application/octet-stream') AS content_type,
lower(regexp_extract(file_name, '\\.([^./]*)$', 1)) AS extension, upload_timestamp FROM {listing} l WHERE action = 'upload' AND content_length > 0""")
def inventory_scan_sorted(t, spark, sf_dir):
    return readers.inventory_sorted(t("listing"))


@query("SELECT key, size, etag FROM {published} p WHERE starts_with(key, 'gallery/generations/g1/')")
def published_listing(t, spark, sf_dir):
    return t("published").where(c("key").startswith("gallery/generations/g1/")).select("key", "size", "etag")


@query("SELECT CAST(doc_id AS STRING) || '.txt' AS name, octet_length(encode(text)) AS size, SHA256(text) AS sha256 FROM documents")
def staged_scan(t, spark, sf_dir):
    """Writes each document as a file, its name in the first line, 500 in a folder, and scans those; at scale the scan reads what is staged already.

    A task's folders are its own, so they are put in place whole and not file by file on the driver.
    """
    folder = ingest._folder(spark)
    t("documents").select(F.expr("monotonically_increasing_id() div 500").alias("part"), F.concat(c("doc_id").cast("string"), F.lit("\n"), "text")).write.partitionBy("part").option("lineSep", "\x1e").option("maxRecordsPerFile", 1).text(folder)

    def found(files):
        named = files.select("content", "length", F.substring_index(F.decode("content", "utf-8"), "\n", 1).alias("id"))
        body = F.expr("substring(content, length(id) + 2, length(content) - length(id) - 2)")
        return named.select(F.concat("id", F.lit(".txt")).alias("name"), (c("length") - F.length("id") - 2).alias("size"), F.sha2(body, 256).alias("sha256"))

    return readers.scanned_files(spark, folder, found)


def _index_documents(t):
    """JSON index documents of the objects of each source, 1000 doc_ids a document, in two shapes; every 50th item has no key, every 49th a foreign one, every 47th no size."""
    d = c("doc_id")
    key = F.when(d % 50 == 0, None).when(d % 49 == 0, F.concat(F.lit("other/"), "key")).otherwise(c("key"))
    o = t("objects").select(F.floor(d / 1000).alias("run"), F.split("key", "/")[1].alias("src"), F.struct(key.alias("key"), c("extension").alias("ext"), F.when(d % 47 != 0, c("size")).alias("size")).alias("x"))
    items = o.groupBy("src", "run").agg(F.sort_array(F.collect_list("x")).alias("items"))
    return items.select("src", F.when(F.length("src") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.struct("items"))).alias("body"))


@query("SELECT key, extension AS ext, CASE WHEN doc_id % 47 <> 0 THEN size END AS size FROM {objects} o WHERE doc_id % 50 <> 0 AND doc_id % 49 <> 0")
def gallery_index_lenient(t, spark, sf_dir):
    return readers.index_items(_index_documents(t), strict=False)


@query("SELECT key, extension AS ext, size FROM {objects} o WHERE doc_id % 50 <> 0")
def gallery_index_items(t, spark, sf_dir):
    good = t("objects").where("doc_id % 50 <> 0")
    items = good.groupBy((c("doc_id") % 20).alias("g"), F.floor(c("doc_id") / 20_000).alias("run")).agg(F.collect_list(F.struct("key", c("extension").alias("ext"), "size")).alias("items"))
    return readers.index_items(items.select(F.when(c("g") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.struct("items"))).alias("body")), strict=True)


@query("SELECT position // 25 AS list_id, CAST(position % 25 AS INT) AS position, value FROM {raw_sources} s")
def source_list_parse(t, spark, sf_dir):
    lists = t("raw_sources").groupBy(F.floor(c("position") / 25).alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("sources"))
    return readers.source_list(lists.select("list_id", F.when(c("list_id") % 2 == 0, F.to_json("sources")).otherwise(F.to_json(F.struct(F.lit(1).alias("version"), "sources"))).alias("body")))


@query("SELECT DISTINCT key FROM {progress} p WHERE outcome = 'completed'")
def completed_keys(t, spark, sf_dir):
    return reconcile.completed(t("progress"))


_LATEST = "SELECT generation, status, seq, updated_at, created_at FROM (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY coalesce(updated_at, -1) DESC, seq DESC) AS n FROM {states} s) q WHERE n = 1"


@query(_LATEST)
def generation_latest(t, spark, sf_dir):
    return readers.latest_states(t("states"))


@query("SELECT destination_key AS key, extension AS ext, size FROM {manifest} m")
def gallery_index_build(t, spark, sf_dir):
    return summary.gallery_items(t("manifest"))


@query(f"SELECT 1 AS version, CAST({NOW} AS BIGINT) AS generated_at, count(*) AS count FROM {{manifest}} m")
def gallery_index_header(t, spark, sf_dir):
    return summary.gallery_header(t("manifest"), NOW)


@query("SELECT key, CAST(json_object('content_type', content_type, 'ext', extension, 'file_id', file_id, 'key', key, 'sha1', sha1, 'size', size, 'upload_timestamp', upload_timestamp) AS VARCHAR) AS item FROM {objects} o")
def canonical_index(t, spark, sf_dir):
    return summary.canonical_items(t("objects"))


@query("""SELECT key, ext, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn DESC, position DESC) AS n FROM (
SELECT key, extension AS ext, size, doc_id AS position, 0 AS turn FROM {objects} a UNION ALL SELECT key, extension, size, doc_id, 1 FROM {objects_v2} b) u) q WHERE n = 1""")
def index_merge(t, spark, sf_dir):
    pick = lambda df: df.select("key", c("extension").alias("ext"), "size", c("doc_id").alias("position"))
    return readers.merged_index(pick(t("objects")), pick(t("objects_v2")))


# ---------------------------------------------------------------- rules


@query(f"""SELECT generation, seq, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(make_timestamp(seconds * 1000000), '%Y%m%dT%H%M%SZ-') || left(SHA256(generation), 10) AS id, strftime(make_timestamp(coalesce(updated_at + seq % 86400, {NOW}) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS mail
FROM (SELECT *, coalesce(updated_at, created_at, {NOW}) + seq % 86400 AS seconds FROM {{states}} s) q""")
def date_rules(t, spark, sf_dir):
    at = F.coalesce("updated_at", "created_at", F.lit(NOW)) + c("seq") % 86400
    return t("states").select("generation", "seq", rules.iso_time(at).alias("iso"), rules.generation_id(at, c("generation")).alias("id"), rules.mail_date(c("updated_at") + c("seq") % 86400, NOW).alias("mail"))


@query("SELECT key, lower(regexp_extract(key, '\\.([^./]*)$', 1)) AS extension FROM (SELECT CASE doc_id % 4 WHEN 0 THEN upper(key) WHEN 1 THEN key WHEN 2 THEN 'a.b/' || CAST(doc_id AS STRING) ELSE key || '/.hid' END AS key FROM {objects} o) q")
def extension_of(t, spark, sf_dir):
    d = c("doc_id")
    keys = t("objects").select(F.when(d % 4 == 0, F.upper("key")).when(d % 4 == 1, c("key")).when(d % 4 == 2, F.concat(F.lit("a.b/"), d.cast("string"))).otherwise(F.concat("key", F.lit("/.hid"))).alias("key"))
    return keys.select("key", rules.extension_of(c("key")).alias("extension"))


_ODD = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/' || key WHEN 1 THEN key || '/../x' WHEN 2 THEN replace(key, '/', '\\') WHEN 3 THEN '' WHEN 4 THEN key || '..x' ELSE key END AS key FROM {objects} o"


@query(f"SELECT doc_id, key FROM ({_ODD}) q WHERE key = '' OR starts_with(key, '/') OR contains(key, '\\') OR list_contains(string_split(key, '/'), '..')")
def unsafe_keys(t, spark, sf_dir):
    d, k = c("doc_id") % 6, c("key")
    keys = t("objects").select("doc_id", F.when(d == 0, F.concat(F.lit("/"), k)).when(d == 1, F.concat(k, F.lit("/../x"))).when(d == 2, F.replace(k, F.lit("/"), F.lit("\\"))).when(d == 3, "").when(d == 4, F.concat(k, F.lit("..x"))).otherwise(k).alias("key"))
    return keys.where(~rules.safe_key(c("key")))


@query("SELECT file_name AS key, content_length AS size FROM {listing} l WHERE NOT (content_length > 0 AND (content_sha1 IN ('', 'none') OR (length(content_sha1) = 40 AND regexp_full_match(content_sha1, '[0-9a-fA-F]+'))))")
def invalid_records(t, spark, sf_dir):
    return t("listing").where(~rules.valid_record(c("content_length"), c("content_sha1"))).select(c("file_name").alias("key"), c("content_length").alias("size"))


@query("""SELECT *, objects = 0 OR unverifiable > 0 AS refused FROM (SELECT count(*) AS objects, count(*) FILTER (length(coalesce(nullif(content_sha1, ''), large_file_sha1, '')) <> 40) AS unverifiable
FROM {listing} l WHERE action = 'upload' AND content_length > 0) q""")
def inventory_gate(t, spark, sf_dir):
    return summary.gate(readers.inventory(t("listing")))


@query("""SELECT reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, CASE WHEN extension NOT IN ('jpg','jpeg','png','webp','gif','mp4','m4v','webm') THEN 'type' WHEN size <= 0 THEN 'empty' WHEN size > 5242880 THEN 'large' ELSE 'ok' END AS reason FROM {objects} o) q GROUP BY reason""")
def eligibility_split(t, spark, sf_dir):
    o = t("objects").select("size", rules.reject_reason(c("extension"), c("size"), 5 << 20).alias("reason"))
    return o.groupBy("reason").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT doc_id, CASE WHEN length(n) = 0 THEN 'media.bin' ELSE n END AS name FROM (SELECT doc_id, right(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END, '[^\\p{L}\\p{N}._-]', '_', 'g'), 160) AS n FROM documents) q")
def safe_name(t, spark, sf_dir):
    return t("documents").select("doc_id", rules.safe_name(F.when(c("doc_id") % 9 == 0, "").otherwise(c("text"))).alias("name"))


@query("SELECT doc_id, 'gallery/' || left(sha1(encode(rel) || '\\x00'::BLOB || encode(text)), 20) || '_' || CAST(doc_id AS STRING) || '.txt' AS key FROM (SELECT doc_id, text, source || '/' || CAST(doc_id AS STRING) || '.txt' AS rel FROM documents) q")
def canonical_keys(t, spark, sf_dir):
    d = t("documents").select("doc_id", "text", F.concat("source", F.lit("/"), c("doc_id").cast("string"), F.lit(".txt")).alias("rel"))
    return d.select("doc_id", rules.canonical_key("gallery/", c("rel"), c("text")).alias("key"))


@query("SELECT position, left(SHA256(low), 16) AS source_id, SHA256(value) AS relative_id FROM (SELECT position, value, lower(value) AS low FROM {raw_sources} s) q")
def identities(t, spark, sf_dir):
    return t("raw_sources").select("position", rules.source_identity(c("value")).alias("source_id"), F.sha2("value", 256).alias("relative_id"))


_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.MIME.items())


@query(f"SELECT key, CASE WHEN content_type IN ('', 'b2/x-auto') THEN coalesce(CASE extension {_MIME} END, 'application/octet-stream') ELSE content_type END AS content_type FROM {{objects}} o")
def content_type_resolve(t, spark, sf_dir):
    known = spark.createDataFrame(list(rules.MIME.items()), "extension string, mime string")  # eight rows
    o = t("objects").join(F.broadcast(known), "extension", "left")
    return o.select("key", F.when(c("content_type").isin("", "b2/x-auto"), F.coalesce("mime", F.lit("application/octet-stream"))).otherwise(c("content_type")).alias("content_type"))


#: Manifests of four generations; entries of some repeat a key or lie in another folder, and each header has one fault.
_MANIFESTS = """SELECT generation, CASE WHEN doc_id % 202 = 0 AND generation = 's2' THEN 'gallery/twice' ELSE source_key END AS source_key, 'gallery/generations/' || CASE WHEN doc_id % 102 = 0 AND generation = 's0' THEN 'other' ELSE generation END || substring(source_key, 8) AS destination_key, size
FROM (SELECT doc_id, source_key, size, 's' || CAST(doc_id % 8 AS STRING) AS generation FROM {manifest} m) a"""
_HEADERS = f"""SELECT generation, CASE WHEN generation = 's2' THEN 2 ELSE 1 END AS version, CASE WHEN generation = 's4' THEN 0 ELSE 1000000 END AS target_bytes, count(*) - CASE WHEN generation = 's4' THEN 1 ELSE 0 END AS inventory_objects,
count(*) AS selected_objects, CAST(sum(size) + CASE WHEN generation = 's0' THEN 1 ELSE 0 END AS BIGINT) AS selected_bytes FROM ({_MANIFESTS}) e GROUP BY generation UNION ALL SELECT 'none', 1, 5, 0, 3, 0"""


@query(f"""SELECT *, repeated_sources + repeated_destinations + "foreign" > 0 OR bad_version OR bad_target OR bad_inventory OR bad_objects OR bad_bytes AS refused FROM (SELECT generation, coalesce(entries, 0) AS entries, coalesce(rs, 0) AS repeated_sources, coalesce(rd, 0) AS repeated_destinations, coalesce(fo, 0) AS "foreign",
coalesce(version <> 1, true) AS bad_version, coalesce(target_bytes < 1, true) AS bad_target, coalesce(inventory_objects < coalesce(entries, 0), true) AS bad_inventory, coalesce(selected_objects <> coalesce(entries, 0), true) AS bad_objects, coalesce(selected_bytes <> coalesce(bytes, 0), true) AS bad_bytes
FROM ({_HEADERS}) h FULL JOIN (SELECT generation, count(*) AS entries, sum(size) AS bytes, count(*) - count(DISTINCT source_key) AS rs, count(*) - count(DISTINCT destination_key) AS rd, count(*) FILTER (NOT starts_with(destination_key, 'gallery/generations/' || generation || '/')) AS fo FROM ({_MANIFESTS}) e GROUP BY generation) f USING (generation)) q""")
def manifest_validate(t, spark, sf_dir):
    return summary.manifest_violations(from_sql(spark, sf_dir, _MANIFESTS), from_sql(spark, sf_dir, _HEADERS))


@query("""SELECT shard, planned, planned_bytes, entries, bytes FROM (SELECT shard, count(*) AS planned, CAST(sum(size) AS BIGINT) AS planned_bytes FROM {shard_plan} p GROUP BY shard) a
FULL JOIN (SELECT CAST(doc_id % 8 AS INT) AS shard, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM {manifest} m GROUP BY 1) b USING (shard) WHERE planned <> entries OR planned_bytes <> bytes OR planned IS NULL OR entries IS NULL""")
def shard_validate(t, spark, sf_dir):
    plan = t("shard_plan").groupBy("shard").agg(F.count("*").alias("planned"), F.sum("size").alias("planned_bytes"))
    real = t("manifest").groupBy((c("doc_id") % 8).cast("int").alias("shard")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))
    return plan.join(real, "shard", "full_outer").where("not (planned <=> entries and planned_bytes <=> bytes)")


_STRIPPED = "(SELECT position, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value FROM {raw_sources} s)"
_BARE = "CASE WHEN starts_with(lower(bare), 'r/') THEN split_part(substring(bare, 3), '/', 1) ELSE bare END"
_BARED = f"(SELECT position, value, regexp_replace(value, '^/+|/+$', '', 'g') AS bare FROM {_STRIPPED} v)"
_SOURCE = f"""SELECT position, CASE WHEN regexp_full_match(name, '[A-Za-z0-9_]{{3,21}}') THEN 'https://www.reddit.com/r/' || name || '/new/' ELSE '' END AS source FROM (SELECT position, CASE WHEN starts_with(value, 'https://') OR starts_with(value, 'http://')
 THEN regexp_extract(value, '(?i)^https?://(?:www\\.|old\\.|new\\.)?reddit\\.com/r/([A-Za-z0-9_]{{3,21}})(?:/.*)?$', 1) ELSE {_BARE} END AS name FROM {_BARED} b) q"""
_API = f"""SELECT position, CASE WHEN regexp_full_match(name, '[A-Za-z0-9_]{{3,21}}') THEN name ELSE '' END AS source FROM (SELECT position, CASE WHEN regexp_matches(value, '(?i)^https?://')
 THEN CASE WHEN lower(regexp_extract(value, '(?i)^https?:/+(?:[^/?#]*@)?([^/?#:@]*)(?::[0-9]*)?(?:[/?#]|$)', 1)) IN ('reddit.com', 'www.reddit.com', 'old.reddit.com', 'new.reddit.com') THEN regexp_extract(value, '(?i)^https?:/+[^/?#]*/+r/+([^/?#]+)', 1) ELSE '' END
 ELSE split_part({_BARE}, '/', 1) END AS name FROM {_BARED} b) q"""


@query(_SOURCE)
def source_normalize(t, spark, sf_dir):
    return t("raw_sources").select("position", rules.normalised_source(c("value")).alias("source"))


@query(_API)
def source_normalize_api(t, spark, sf_dir):
    return t("raw_sources").select("position", rules.normalised_source_api(c("value")).alias("source"))


_CLASS = "CASE WHEN lower(extension) IN ('jpg','jpeg','png','webp') THEN 'stills' WHEN lower(extension) IN ('gif','mp4','m4v','webm') THEN 'clips' END"
_BUCKETED = f"SELECT key, size, unnest(list_filter(['all', {_CLASS}, CASE WHEN {_CLASS} IS NOT NULL THEN lower(extension) END], lambda b: b IS NOT NULL)) AS bucket FROM {{objects}} o"


@query(f"SELECT bucket, count(*) AS total, CAST(sum(size) AS BIGINT) AS bytes FROM ({_BUCKETED}) q GROUP BY bucket")
def media_buckets(t, spark, sf_dir):
    o = t("objects").select("size", F.explode(rules.buckets_of(c("extension"))).alias("bucket"))
    return o.groupBy("bucket").agg(F.count("*").alias("total"), F.sum("size").alias("bytes"))


@query("SELECT id, name, count FROM {catalog_raw} k WHERE name <> '' AND count > 0")
def tag_catalog_clean(t, spark, sf_dir):
    return t("catalog_raw").where("name <> '' and count > 0").select("id", "name", "count")


_VALID_ITEMS = """SELECT item, key, ext FROM {items} i WHERE starts_with(key, 'gallery/') AND lower(ext) IN ('jpg','jpeg','png','webp','gif','mp4','m4v','webm')
AND item NOT IN (SELECT item FROM {item_tags} g WHERE tag NOT IN (SELECT id FROM {catalog_raw} k WHERE name <> '' AND count > 0)) AND item NOT IN (SELECT item FROM {item_tags} g GROUP BY item HAVING count(*) > 512)"""


def _valid_items(t):
    known = tag_catalog_clean(t, None, None).select(c("id").alias("tag"), F.lit(True).alias("known"))
    tags = t("item_tags").join(known, "tag", "left").groupBy("item").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("good"), F.count("*").alias("n"))
    i = t("items").where(c("key").startswith("gallery/") & F.lower("ext").isin(*rules.MEDIA))
    return i.join(tags, "item", "left").where("coalesce(good, true) and coalesce(n, 0) <= 512")


@query("""SELECT page_id AS index_id, item, 'gallery/k' || CAST(item AS STRING) AS key, CASE item WHEN 0 THEN 'jpg' ELSE 'gif' END AS ext, CASE item WHEN 0 THEN '0,2' ELSE '' END AS tags
FROM (SELECT page_id, unnest(range(0, least(2, page_id % 7))) AS item FROM pages WHERE page_id % 5 <> 0 AND page_id % 4 <> 3) q""")
def tag_index_read(t, spark, sf_dir):
    """Indexes of up to six items, of which the first two are valid; every fifth has another version, every fourth too many tags for the limit of 10."""
    d = c("page_id")
    given = ['["gallery/k0","jpg",[0,2]]', '["gallery/k1","GIF",[]]', '["gallery/k2","jpg",[1]]', '["other/k3","jpg",[0]]', '["gallery/k4","exe",[0]]', '["gallery/k5","jpg"]']
    tags = F.when(d % 4 == 3, ",".join(f'["t{k}",{k}]' for k in range(1, 13))).otherwise('["t0",1],["t1",0],["t2",3]')
    items = F.array_join(F.slice(F.array(*map(F.lit, given)), F.lit(1), (d % 7).cast("int")), ",")
    body = F.concat(F.lit('{"version":'), F.when(d % 5 == 0, "2").otherwise("1"), F.lit(',"catalog":['), tags, F.lit('],"items":['), items, F.lit("]}"))
    return readers.tag_index(t("pages").select(d.alias("index_id"), body.alias("body")), most_tags=10).select("index_id", "item", "key", "ext", F.array_join("tags", ",").alias("tags"))


@query(_VALID_ITEMS)
def tag_items_valid(t, spark, sf_dir):
    return _valid_items(t).select("item", "key", "ext")


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN raw_size > 26214400 THEN 'too large' WHEN place <= 1 OR host = '' THEN 'malformed' WHEN host <> 'example.org' THEN 'foreign' WHEN lower(local) IN ('abuse','dmca','postmaster','security') THEN 'fixed'
 WHEN NOT ends_with(local, '-k9') THEN 'no suffix' WHEN alias = '' OR starts_with(alias, '.') OR ends_with(alias, '.') OR NOT regexp_full_match(alias, '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+') THEN 'bad alias' ELSE 'alias' END AS verdict
FROM (SELECT *, left(local, greatest(length(local) - 3, 0)) AS alias FROM (SELECT raw_size, length(recipient) - length(string_split(recipient, '@')[-1]) AS place, lower(string_split(recipient, '@')[-1]) AS host,
 CASE WHEN contains(recipient, '@') THEN left(recipient, length(recipient) - length(string_split(recipient, '@')[-1]) - 1) ELSE '' END AS local FROM {messages} m) a) b) q GROUP BY verdict""")
def recipient_triage(t, spark, sf_dir):
    m = t("messages").select(rules.recipient_verdict(c("recipient"), c("raw_size"), "example.org", "-k9").alias("verdict"))
    return m.groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, regexp_replace(text, '(?i)alias' || CAST(conv_id AS STRING) || '\\-k9@example\\.org', 'someone@example.org', 'g') AS text FROM {messages} m")
def address_scrub(t, spark, sf_dir):
    private = F.concat(F.lit("alias"), c("conv_id").cast("string"), F.lit("-k9@example.org"))
    return t("messages").select("conv_id", "turn", rules.scrubbed(c("text"), private, F.lit("someone@example.org")).alias("text"))


_PLAIN = "html"
for _pattern, _text in (("(?is)<style.*?</style>", "''"), ("(?is)<script.*?</script>", "''"), ("(?i)<br\\s*/?>", "chr(10)"), ("(?i)</p>", "chr(10) || chr(10)"), ("<[^>]+>", "''"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', {_text}, 'g')"


@query(f"SELECT page_id, {_PLAIN} AS text FROM pages")
def html_to_text(t, spark, sf_dir):
    return t("pages").select("page_id", rules.html_text(c("html")).alias("text"))


@query("""SELECT request, CASE WHEN count(DISTINCT tag) > 32 THEN 'too many' WHEN bool_or(tag = '' OR length(tag) > 128) THEN 'bad name' WHEN bool_or(k.name IS NULL) THEN 'unknown' ELSE 'ok' END AS verdict
FROM {requests} r LEFT JOIN (SELECT DISTINCT name FROM {catalog_raw} k WHERE name <> '' AND count > 0) k ON k.name = r.tag GROUP BY request""")
def tag_request_check(t, spark, sf_dir):
    known = t("catalog_raw").where("name <> '' and count > 0").select(c("name").alias("tag"), F.lit(True).alias("known")).distinct()
    r = t("requests").join(known, "tag", "left").groupBy("request")
    return r.agg(F.when(F.count_distinct("tag") > 32, "too many").when(F.bool_or((c("tag") == "") | (F.length("tag") > 128)), "bad name").when(F.bool_or(c("known").isNull()), "unknown").otherwise("ok").alias("verdict"))


# ---------------------------------------------------------------- deduplication


@query(f"SELECT position, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(source) ORDER BY position) AS n FROM ({_SOURCE}) s WHERE source <> '') q WHERE n = 1")
def source_dedup(t, spark, sf_dir):
    return dedup.required_sources(dedup.distinct_sources(t("raw_sources"), rules.normalised_source))


_QUALITY = """CASE WHEN media_kind IS NULL THEN CAST('-inf' AS DOUBLE) ELSE log2(greatest(1.0, CAST(CAST(width AS BIGINT) * height AS DOUBLE))) + CASE WHEN media_kind <> 1 THEN 0.9::DOUBLE * log2(greatest(1.0, CAST(coalesce(duration_ms, 0) AS DOUBLE))) ELSE 0.0 END
 + CASE WHEN extension IN ('png', 'webp', 'gif') THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + 0.08::DOUBLE * log2(greatest(1.0, CAST(size AS DOUBLE))) END"""


@query(f"SELECT key, file_id, kept_key FROM (SELECT key, file_id, first_value(key) OVER (PARTITION BY sha256 ORDER BY quality DESC, key) AS kept_key FROM (SELECT *, {_QUALITY} AS quality FROM {{objects}} o) r) q WHERE key <> kept_key")
def exact_dedup(t, spark, sf_dir):
    return dedup.exact_duplicates(t("objects"))


@query(f"SELECT key, round({_QUALITY}, 9) AS quality FROM {{objects}} o WHERE media_kind IS NOT NULL")
def survivor_quality(t, spark, sf_dir):
    return dedup.with_quality(t("objects").where("media_kind is not null")).select("key", F.round("quality", 9).alias("quality"))


@query("SELECT key, position FROM (SELECT key, position, row_number() OVER (PARTITION BY key ORDER BY position) AS n FROM {items} i WHERE key NOT IN (SELECT key FROM {items} k WHERE position % 3 = 0)) q WHERE n = 1")
def batch_new_keys(t, spark, sf_dir):
    return dedup.new_keys(t("items"), t("items").where("position % 3 = 0").select("key")).select("key", "position")


@query("SELECT key, count(*) AS n FROM {items} i GROUP BY key HAVING count(*) > 1")
def duplicate_keys(t, spark, sf_dir):
    return dedup.duplicate_keys(t("items"))


# ---------------------------------------------------------------- joins


@query("SELECT s.key, s.size, CASE WHEN o.key IS NULL THEN 'new' WHEN s.size = o.size AND s.sha1 = o.sha1 THEN 'known' ELSE 'changed' END AS state FROM {objects_v2} s LEFT JOIN {objects} o ON s.key = o.key")
def commit_classify(t, spark, sf_dir):
    return reconcile.classified(t("objects_v2"), t("objects"))


_RECONCILED = """SELECT key, change, file_id, size, CASE WHEN same AND fp_version = 2 THEN phash END AS phash FROM (SELECT coalesce(o.key, n.key) AS key, n.file_id, n.size, o.phash, o.fp_version, o.file_id = n.file_id AND o.size = n.size AND o.sha1 = n.sha1 AS same,
 CASE WHEN n.key IS NULL THEN 'gone' WHEN o.key IS NULL THEN 'new' WHEN o.file_id = n.file_id AND o.size = n.size AND o.sha1 = n.sha1 THEN 'same' ELSE 'changed' END AS change FROM {stored} o FULL JOIN {objects_v2} n ON o.key = n.key) q"""


@query(_RECONCILED)
def inventory_reconcile(t, spark, sf_dir):
    return reconcile.reconciled(t("stored"), t("objects_v2"))


@query(f"SELECT key, file_id FROM ({_RECONCILED}) r WHERE change <> 'gone' AND phash IS NULL")
def fingerprint_missing(t, spark, sf_dir):
    return reconcile.reconciled(t("stored"), t("objects_v2")).where("change <> 'gone' and phash is null").select("key", "file_id")


@query("""SELECT first_key, second_key FROM {exclusions} e WHERE first_key NOT IN (SELECT o.key FROM {objects} o LEFT JOIN {objects_v2} n ON o.key = n.key WHERE n.key IS NULL OR n.file_id <> o.file_id)
AND second_key NOT IN (SELECT o.key FROM {objects} o LEFT JOIN {objects_v2} n ON o.key = n.key WHERE n.key IS NULL OR n.file_id <> o.file_id)""")
def exclusion_reconcile(t, spark, sf_dir):
    return reconcile.surviving_exclusions(t("exclusions"), t("objects"), t("objects_v2"))


@query("SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {objects} o FULL JOIN {objects_v2} n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.file_id <> n.file_id OR o.size <> n.size OR o.sha1 <> n.sha1")
def inventory_diff(t, spark, sf_dir):
    return reconcile.difference(t("objects"), t("objects_v2"))


_TAGGED = """(SELECT CASE WHEN p.destination_key IS NOT NULL AND p.doc_id % 2 = 0 THEN p.destination_key ELSE p.source_key END AS key, 't' || CAST(p.doc_id % 5 AS STRING) AS tags, p.doc_id AS position FROM {prior_manifest} p
UNION ALL SELECT p.source_key, 'late', p.doc_id + 100000000 FROM {prior_manifest} p WHERE p.doc_id % 9 = 0 UNION ALL SELECT 'other/' || CAST(p.doc_id AS STRING), 'x', p.doc_id FROM {prior_manifest} p WHERE p.doc_id % 12 = 0)"""


@query(f"""SELECT m.destination_key AS key, m.extension AS ext, tags FROM (SELECT source_key, tags, row_number() OVER (PARTITION BY source_key ORDER BY position DESC) AS n FROM (
SELECT coalesce(p.source_key, i.key) AS source_key, i.tags, i.position FROM {_TAGGED} i LEFT JOIN {{prior_manifest}} p ON p.destination_key = i.key) a WHERE starts_with(source_key, 'gallery/')) q JOIN {{manifest}} m USING (source_key) WHERE n = 1""")
def tag_remap(t, spark, sf_dir):
    p, d = t("prior_manifest"), c("doc_id")
    items = p.select(F.when(d % 2 == 0, c("destination_key")).otherwise(c("source_key")).alias("key"), F.concat(F.lit("t"), (d % 5).cast("string")).alias("tags"), d.alias("position"))
    late = p.where("doc_id % 9 = 0").select(c("source_key").alias("key"), F.lit("late").alias("tags"), (d + 100000000).alias("position"))
    other = p.where("doc_id % 12 = 0").select(F.concat(F.lit("other/"), d.cast("string")).alias("key"), F.lit("x").alias("tags"), d.alias("position"))
    return reconcile.remapped_tags(items.unionByName(late).unionByName(other), p, t("manifest"))


_UNFINISHED = "SELECT * FROM {manifest} m WHERE source_key NOT IN (SELECT key FROM {progress} p WHERE outcome = 'completed')"


@query(f"SELECT source_key, size FROM ({_UNFINISHED}) q")
def unfinished(t, spark, sf_dir):
    return reconcile.unfinished(t("manifest"), t("progress")).select("source_key", "size")


def _verify(entries: str) -> str:
    return f"SELECT m.source_key, m.destination_key, m.size, coalesce(m.size = p.size AND (m.sha1 = '' OR p.sha1 = m.sha1) AND p.generation = 'g1', false) AS ok FROM ({entries}) m LEFT JOIN {{published}} p ON p.key = m.destination_key"


@query(_verify("SELECT * FROM {manifest} m"))
def verify_objects(t, spark, sf_dir):
    return reconcile.verified(t("manifest"), t("published"), "g1")


@query(f"SELECT CASE WHEN ok THEN 'recognised' ELSE 'missing' END AS state, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM ({_verify(_UNFINISHED)}) q GROUP BY 1")
def recovery_plan(t, spark, sf_dir):
    return reconcile.recovery(t("manifest"), t("progress"), t("published"), "g1")


def _packed(rows: str) -> str:
    """SQL of longest-first packing into SHARDS shards of rows (generation, key, size)."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT generation, key, size, row_number() OVER (PARTITION BY generation ORDER BY size DESC, key) AS n FROM ({rows}) a),
walk(generation, n, key, size, shard, loads) AS (SELECT DISTINCT generation, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), 0, list_transform(range(0, {SHARDS}), lambda i: CAST(0 AS BIGINT)) FROM e UNION ALL
SELECT e.generation, e.n, e.key, e.size, CAST(list_position(w.loads, list_min(w.loads)) AS INT), list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + e.size ELSE x END) FROM walk w JOIN e ON e.generation = w.generation AND e.n = w.n + 1)
SELECT generation, key, size, CAST(shard - 1 AS INT) AS shard FROM walk WHERE n > 0"""


@query(_packed(f"SELECT 'g1' AS generation, source_key AS key, size FROM ({_verify(_UNFINISHED)}) v WHERE NOT ok"))
def recovery_shards(t, spark, sf_dir):
    return reconcile.recovery_shards(t("manifest"), t("progress"), t("published"), "g1", SHARDS)


@query(f"SELECT count(*) AS entries, count(*) FILTER (NOT ok) AS unverified, count(*) FILTER (NOT ok) > 0 AS refused FROM ({_verify('SELECT * FROM {manifest} m')}) q")
def publish_gate(t, spark, sf_dir):
    found = reconcile.verified(t("manifest"), t("published"), "g1").agg(F.count("*").alias("entries"), F.count_if(~c("ok")).alias("unverified"))
    return found.withColumn("refused", c("unverified") > 0)


@query("""SELECT DISTINCT key FROM (SELECT destination_key AS key FROM {prior_manifest} p WHERE destination_key NOT IN (SELECT destination_key FROM {manifest} m) UNION ALL SELECT key FROM {published} b WHERE size % 3 = 0) q
WHERE key NOT IN (SELECT key FROM {published} x WHERE size % 2 = 0)""")
def cleanup_plan(t, spark, sf_dir):
    keys = lambda n: t(n).select(c("destination_key").alias("key"))
    return reconcile.cleanup(keys("prior_manifest"), keys("manifest"), t("published").where("size % 3 = 0").select("key"), t("published").where("size % 2 = 0").select("key"))


@query(f"SELECT destination_key AS key FROM {{prior_manifest}} p WHERE {NOW} - doc_id * 100000 <= {NOW} - 5000000 AND source_key NOT IN (SELECT source_key FROM {{manifest}} m WHERE size % 2 = 0)")
def backlog_retry(t, spark, sf_dir):
    p = t("prior_manifest")
    active = t("manifest").where("size % 2 = 0").select("source_key").join(p, "source_key").select(c("destination_key").alias("key"))
    return reconcile.retried(p.select(c("destination_key").alias("key"), (F.lit(NOW) - c("doc_id") * 100000).alias("not_before")), active, NOW - 5000000)


_DEAD = f"status IN ('failed', 'abandoned') OR (status IN ('building', 'recovering', 'ready') AND {NOW} - coalesce(updated_at, created_at, {NOW}) >= 86400)"


@query(f"SELECT generation, status FROM ({_LATEST}) q WHERE seq % 7 <> 0 AND ({_DEAD})")
def abandoned_generations(t, spark, sf_dir):
    latest = readers.latest_states(t("states"))
    return reconcile.abandoned(latest, latest.where("seq % 7 = 0").select("generation"), NOW)


_LISTED = "SELECT CASE WHEN doc_id % 50 = 49 THEN 'gallery/generations/g' || CAST(doc_id AS STRING) ELSE 'gallery/generations/g' || CAST(doc_id % 300 AS STRING) || substring(key, 8) END AS key FROM {objects} o"


@query(f"SELECT generation, key FROM (SELECT key, regexp_extract(key, '^gallery/generations/([^/]*)/', 1) AS generation FROM ({_LISTED}) k) l WHERE generation <> '' AND generation IN (SELECT generation FROM ({_LATEST}) q WHERE seq % 7 <> 0 AND ({_DEAD}))")
def abandoned_keys(t, spark, sf_dir):
    """The published keys of the generations that abandoned_generations() sweeps."""
    return reconcile.abandoned_keys(abandoned_generations(t, spark, sf_dir), from_sql(spark, sf_dir, _LISTED))


@query("""SELECT n.key, n.file_id, n.size, n.sha1, CASE WHEN o.file_id = n.file_id AND o.size = n.size AND o.sha1 = n.sha1 AND o.fp_version = 2 THEN o.fp_version END AS fp_version,
CASE WHEN o.file_id = n.file_id AND o.size = n.size AND o.sha1 = n.sha1 AND o.fp_version = 2 THEN o.phash END AS phash FROM {objects_v2} n LEFT JOIN {stored} o ON o.key = n.key""")
def store_rewrite(t, spark, sf_dir):
    """A stored inventory brought to the new one, written only where it changed."""
    path = ingest._folder(spark)
    store.create(t("stored"), path, 16)
    store.rewrite(spark, path, t("objects_v2"), 16)
    return spark.read.parquet(path).select(*store.COLUMNS)


@query(f"SELECT generation FROM ({_LATEST}) q WHERE status = 'publication-failed'")
def stuck_generations(t, spark, sf_dir):
    return readers.latest_states(t("states")).where("status = 'publication-failed'").select("generation")


@query("SELECT count(*) AS targets, count(*) FILTER (o.key IS NULL OR o.file_id <> target_file_id) AS stale, count(*) FILTER (o.key IS NULL OR o.file_id <> target_file_id) > 0 AS refused FROM (SELECT DISTINCT target_key, target_file_id FROM {operations} a) t LEFT JOIN {objects} o ON o.key = target_key")
def delete_target_check(t, spark, sf_dir):
    asked = t("operations")
    return reconcile.deletable(asked.unionByName(asked.where("state = 'prepared'")), t("objects"))


@query("SELECT t.id, target_key, CASE WHEN state = 'remote_deleted' THEN 'complete' WHEN state <> 'prepared' THEN 'error' WHEN o.key IS NOT NULL THEN 'delete' ELSE 'already done' END AS action FROM {operations} t LEFT JOIN {objects} o ON o.key = target_key AND o.file_id = target_file_id")
def journal_recovery(t, spark, sf_dir):
    return reconcile.journal(t("operations"), t("objects"))


@query("SELECT source_key FROM {shard_plan} p WHERE source_key NOT IN (SELECT source_key FROM {manifest} m)")
def shard_foreign(t, spark, sf_dir):
    return t("shard_plan").join(t("manifest"), "source_key", "left_anti").select("source_key")


@query("SELECT o.key, o.file_id FROM (SELECT key, file_id FROM {objects} a UNION ALL SELECT key, file_id FROM {objects_v2} b) o JOIN {objects_v2} k ON k.key = o.key WHERE o.file_id <> k.file_id")
def obsolete_versions(t, spark, sf_dir):
    return reconcile.obsolete_versions(t("objects").select("key", "file_id").unionByName(t("objects_v2").select("key", "file_id")), t("objects_v2"))


# ---------------------------------------------------------------- similarity


def _side(name: str, where: str, hashes: str = "[phash]") -> str:
    return f"(SELECT key AS {name}, kind, unnest({hashes}) AS h FROM prints WHERE {where})"


def _near(where: str, distance: int, hashes: str = "[phash]") -> str:
    return f"SELECT DISTINCT x.a, y.b FROM {_side('a', where, hashes)} x JOIN {_side('b', where, hashes)} y ON x.a < y.b AND bit_count(xor(x.h, y.h)) <= {distance}"


def _near_banded(where: str, distance: int, hashes: str) -> str:
    """As _near for up to 7 bits: of eight bands of 8 bits one at least is equal, and pairs meet there."""
    side = lambda name: f"(SELECT DISTINCT {name}, h, k, (h >> (8 * k)) & 255 AS v FROM (SELECT {name}, h, unnest(range(0, 8)) AS k FROM {_side(name, where, hashes)} u) w)"
    return f"SELECT DISTINCT x.a, y.b FROM {side('a')} x JOIN {side('b')} y ON x.k = y.k AND x.v = y.v AND x.a < y.b AND bit_count(xor(x.h, y.h)) <= {distance}"


_WITH = f"WITH prints AS MATERIALIZED ({P.SQL}) "
_STILLS, _CROPS, _MOVING = _near("kind = 1", 10), _near_banded("kind = 1", 7, "list_append(crop_hashes, phash)"), _near("kind <> 1", 12)


@query(_WITH + "SELECT x.phash AS x, y.phash AS y, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS d FROM (SELECT DISTINCT phash FROM prints) x JOIN (SELECT DISTINCT phash FROM prints) y ON bit_count(xor(x.phash, y.phash)) <= 11")
def hamming_join(t, spark, sf_dir):
    h = P.prints(spark, sf_dir).select(c("phash").alias("h"))
    return similarity.near_hashes(h, h, 2, 11)


@query(_WITH + "SELECT x.phash AS x, y.phash AS y, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS d FROM (SELECT DISTINCT phash FROM prints WHERE copy > 0) x JOIN (SELECT DISTINCT phash FROM prints) y ON bit_count(xor(x.phash, y.phash)) <= 11")
def hamming_incremental(t, spark, sf_dir):
    """The pairs that copies add, when the hashes of originals are in a stored index."""
    p = cut(P.prints(spark, sf_dir).select("copy", c("phash").alias("h")))
    index = HashIndex(spark, f"hashes_{uuid.uuid4().hex}", ingest._folder(spark), 2)
    index.put(p.where("copy = 0"))
    found = cut(index.near_new(p.where("copy > 0"), 11))
    spark.sql(f"DROP TABLE {index.table}")
    return found


@query(_WITH + "SELECT p.key, p.phash AS h, count(*) FILTER (q.phash = p.phash) AS copies, count(*) - 1 AS links FROM prints p JOIN prints q ON bit_count(xor(p.phash, q.phash)) <= 11 GROUP BY p.key, p.phash")
def near_classes(t, spark, sf_dir):
    return similarity.classes(P.prints(spark, sf_dir).select("key", c("phash").alias("h")), 2, 11)


@query(_WITH + _STILLS)
def still_candidates(t, spark, sf_dir):
    return similarity.still_candidates(P.prints(spark, sf_dir))


@query(_WITH + _CROPS)
def crop_candidates(t, spark, sf_dir):
    return similarity.crop_candidates(P.prints(spark, sf_dir))


@query(_WITH + _MOVING)
def moving_candidates(t, spark, sf_dir):
    return similarity.moving_candidates(P.prints(spark, sf_dir))


_PAIR = "SELECT e.a, e.b, l.phash AS lp, r.phash AS rp, l.crop_hashes AS lc, r.crop_hashes AS rc, l.duration_ms AS ld, r.duration_ms AS rd, l.frame_count AS lf, r.frame_count AS rf, l.timeline AS lt, r.timeline AS rt, bit_count(xor(l.phash, r.phash)) AS p, 4 * bit_count(xor(l.phash, r.phash)) AS h FROM ({0}) e JOIN prints l ON l.key = e.a JOIN prints r ON r.key = e.b WHERE l.sha256 <> r.sha256"
_STILL_EDGES = "SELECT a, b, round(greatest(0.0, least(1.0, 1.0 - (0.55 * p / 64.0 + 0.45 * h / 256.0)))::DOUBLE, 9) AS score, 'same image after resize or recompression' AS evidence FROM pair_still WHERE p <= 10 AND h <= 48 AND 1.0 - (0.55 * p / 64.0 + 0.45 * h / 256.0) >= 0.76"
_CROP_EDGES = f"""SELECT a, b, round(greatest(0.0, least(1.0, 0.96 - 0.45 * c / 64.0 - 0.25 * h / 256.0))::DOUBLE, 9) AS score, 'convincing crop or reframe' AS evidence FROM (SELECT a, b, h, list_min(list_concat(list_concat(list_transform(rc, lambda y: bit_count(xor(lp, y))),
list_transform(lc, lambda x: bit_count(xor(x, rp)))), flatten(list_transform(lc, lambda x: list_transform(rc, lambda y: bit_count(xor(x, y))))))) AS c FROM pair_still p WHERE h <= 64 AND NOT EXISTS (SELECT 1 FROM ({_STILL_EDGES}) s WHERE s.a = p.a AND s.b = p.b)) q
WHERE c <= 7 AND 0.96 - 0.45 * c / 64.0 - 0.25 * h / 256.0 >= 0.76"""
_WITH_PAIRS = _WITH + f", pair_still AS MATERIALIZED ({_PAIR.format('SELECT * FROM (' + _STILLS + ') s1 UNION SELECT * FROM (' + _CROPS + ') s2')}) "


def _stills(spark, sf_dir):
    p = cut(P.prints(spark, sf_dir))
    return p, similarity.still_candidates(p).unionByName(similarity.crop_candidates(p)).distinct()


@query(_WITH_PAIRS + _STILL_EDGES)
def still_edges(t, spark, sf_dir):
    p, pairs = _stills(spark, sf_dir)
    return similarity.still_edges(pairs, p)


@query(_WITH_PAIRS + _CROP_EDGES)
def crop_edges(t, spark, sf_dir):
    p, pairs = _stills(spark, sf_dir)
    return similarity.crop_edges(pairs, p, similarity.still_edges(pairs, p))


_CLASSES = "SELECT key, min(key) OVER (PARTITION BY phash, hash256, crop_hashes) AS class FROM prints WHERE kind = 1"


@query(_WITH + _CLASSES)
def still_classes(t, spark, sf_dir):
    return similarity.still_classes(P.prints(spark, sf_dir))


@query(_WITH_PAIRS + f", first AS MATERIALIZED (SELECT DISTINCT class FROM ({_CLASSES}) c) SELECT * FROM (SELECT * FROM ({_STILL_EDGES}) s UNION ALL SELECT * FROM ({_CROP_EDGES}) k) e WHERE a IN (SELECT class FROM first) AND b IN (SELECT class FROM first)")
def class_edges(t, spark, sf_dir):
    """Edges between classes; with still_classes() they say all that still_edges() and crop_edges() list pair by pair."""
    return _class_edges(spark, sf_dir)[1]


_PAIR_MOVING = f", pair_moving AS MATERIALIZED ({_PAIR.format(_MOVING)}) "
#: Alignment of each pair, a row for each length and start of a stretch of the longer series.
_ALIGNED = """, lines AS MATERIALIZED (SELECT a, b, p, h, CASE WHEN ld > 0 AND rd > 0 THEN least(ld, rd) / greatest(ld, rd) WHEN lf > 0 AND rf > 0 THEN least(lf, rf) / greatest(lf, rf) ELSE 1.0::DOUBLE END AS ratio, CASE WHEN len(lt) <= len(rt) THEN lt ELSE rt END AS s, CASE WHEN len(lt) <= len(rt) THEN rt ELSE lt END AS l FROM pair_moving),
sized AS (SELECT *, len(l) AS n, len(s) AS m, greatest(least(2, len(l)), least(len(l), CAST(floor(len(l) * ratio + 0.5) AS BIGINT))) AS e FROM lines),
lens AS (SELECT *, unnest(range(greatest(least(2, n), CAST(floor(e * 0.82) AS BIGINT)), least(n, CAST(ceil(e * 1.18) AS BIGINT)) + 1)) AS w FROM sized),
starts AS (SELECT *, unnest(range(0, n - w + 1)) AS o FROM lens),
aligned AS MATERIALIZED (SELECT a, b, p, h, ratio, min(list_sum(list_transform(range(0, m), lambda i: bit_count(xor(s[i + 1], l[o + least(w - 1, CAST(floor(i * (w - 1) / greatest(1, m - 1) + 0.5) AS BIGINT)) + 1])))) / m) AS t FROM starts GROUP BY a, b, p, h, ratio) """
_MOVING_EDGES = """SELECT a, b, round(greatest(0.0, least(1.0, 1.0 - 0.30 * p / 64.0 - 0.25 * h / 256.0 - 0.45 * t / 64.0))::DOUBLE, 9) AS score, CASE WHEN ratio < 0.9 THEN 'strongly matched moving-media excerpt' ELSE 'same moving media after re-encode or resize' END AS evidence FROM aligned
WHERE p <= 12 AND h <= 64 AND t <= 12 AND (ratio >= 0.60 OR t <= 7.8) AND 1.0 - 0.30 * p / 64.0 - 0.25 * h / 256.0 - 0.45 * t / 64.0 >= 0.76"""


@query(_WITH + _PAIR_MOVING + _ALIGNED + "SELECT a, b, round(t, 9) AS distance FROM aligned")
def timeline_distance(t, spark, sf_dir):
    p = cut(P.prints(spark, sf_dir))
    both = similarity._with_prints(similarity.moving_candidates(p), p)
    return both.select("a", "b", F.round(similarity.timeline_distance("l.timeline", "r.timeline", similarity.length_ratio()), 9).alias("distance"))


@query(_WITH + _PAIR_MOVING + _ALIGNED + _MOVING_EDGES)
def moving_edges(t, spark, sf_dir):
    p = cut(P.prints(spark, sf_dir))
    return similarity.moving_edges(similarity.moving_candidates(p), p)


_PLANTED = "SELECT least(x.key, y.key) AS a, greatest(x.key, y.key) AS b FROM prints x JOIN prints y ON y.base = x.base WHERE x.copy = 0 AND y.copy = 1 AND x.base % 18 = 0"


_EVERY_EDGE = f"SELECT * FROM (SELECT * FROM ({_STILL_EDGES}) s UNION ALL SELECT * FROM ({_CROP_EDGES}) k UNION ALL SELECT * FROM ({_MOVING_EDGES}) m) e WHERE (a, b) NOT IN (SELECT (a, b) FROM ({_PLANTED}) x)"


@query(_WITH_PAIRS + _PAIR_MOVING + _ALIGNED + _EVERY_EDGE)
def all_edges(t, spark, sf_dir):
    return similarity.all_edges(cut(P.prints(spark, sf_dir)), _excluded(spark, sf_dir))


def _excluded(spark, sf_dir):
    """Pairs of a vector and its first copy, for every 18th vector."""
    p = P.prints(spark, sf_dir).where("copy = 0 and base % 18 = 0").select("base", c("key").alias("k0"))
    q = P.prints(spark, sf_dir).where("copy = 1").select("base", c("key").alias("k1"))
    return p.join(q, "base").select(F.least("k0", "k1").alias("first_key"), F.greatest("k0", "k1").alias("second_key"))


_PRINT = "CASE WHEN kind = 1 THEN CAST((phash, hash256, crop_hashes) AS VARCHAR) ELSE CAST((phash, hash256, duration_ms, frame_count, timeline) AS VARCHAR) END"
_MEDIA_CLASSES = f"SELECT key, min(key) OVER (PARTITION BY kind = 1, {_PRINT}, CASE WHEN key IN (SELECT a FROM ({_PLANTED}) x) OR key IN (SELECT b FROM ({_PLANTED}) y) THEN key END) AS class, CASE WHEN kind = 1 THEN 'same image after resize or recompression' ELSE 'same moving media after re-encode or resize' END AS evidence FROM prints"


@query(_WITH + _MEDIA_CLASSES)
def media_classes(t, spark, sf_dir):
    return similarity.media_classes(P.prints(spark, sf_dir), _excluded(spark, sf_dir))


@query(_WITH_PAIRS + _PAIR_MOVING + _ALIGNED + f", first AS MATERIALIZED (SELECT DISTINCT class FROM ({_MEDIA_CLASSES}) c) SELECT * FROM ({_EVERY_EDGE}) e WHERE a IN (SELECT class FROM first) AND b IN (SELECT class FROM first)")
def media_class_edges(t, spark, sf_dir):
    """Edges between classes of all media, less exclusions: with media_classes() they say all that all_edges() lists pair by pair."""
    return similarity.class_graph(cut(P.prints(spark, sf_dir)), _excluded(spark, sf_dir))[1]


# ---------------------------------------------------------------- fingerprints


@query("SELECT doc_id, sha1(text) AS sha1, SHA256(text) AS sha256 FROM documents")
def content_hash(t, spark, sf_dir):
    return t("documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query()
def fingerprint_stills(t, spark, sf_dir):
    return fingerprint.fingerprint_stills(P.pixels(spark, sf_dir))


@query()
def frame_sample_gif(t, spark, sf_dir):
    f = P.frames(spark, sf_dir).select("key", "frame_index", c("timestamp_ns").alias("start_ns"), F.lit(100_000_000).alias("duration_ns"))
    return fingerprint.sampled_frames_gif(f)


@query(f"""WITH RECURSIVE f AS MATERIALIZED ({P.FRAMES_SQL}), walk(key, frame_index, taken, took) AS (SELECT DISTINCT key, CAST(-1 AS BIGINT), 0, false FROM f UNION ALL
SELECT f.key, f.frame_index, w.taken + CASE WHEN w.taken < 48 AND f.timestamp_ns >= f.total_ns * w.taken // 48 THEN 1 ELSE 0 END, w.taken < 48 AND f.timestamp_ns >= f.total_ns * w.taken // 48 FROM walk w JOIN f ON f.key = w.key AND f.frame_index = w.frame_index + 1)
SELECT key, CAST(taken - 1 AS INT) AS sample, frame_index FROM walk WHERE took""")
def frame_sample_video(t, spark, sf_dir):
    return fingerprint.sampled_frames_video(P.frames(spark, sf_dir))


def _majority(h: str) -> str:
    """SQL of the bits set in at least half of the hashes of a group, the sign bit as its negative power."""
    return " + ".join(f"CASE WHEN 2 * sum(({h} >> {b}) & 1) >= count(*) THEN {f'{1 << b}' if b < 63 else '(-9223372036854775807 - 1)'} ELSE 0 END" for b in range(64))


@query(f"SELECT key, CAST({_majority('h')} AS BIGINT) AS majority FROM ({P.FRAMES_SQL}) f GROUP BY key")
def majority_hash(t, spark, sf_dir):
    return fingerprint.majority(P.frames(spark, sf_dir))


_WIDE = ", ".join(f"CAST({_majority(f'xor(h, {k * P.STEP})')} AS BIGINT)" for k in range(4))


@query(f"SELECT key, list(h ORDER BY frame_index) AS timeline, CAST({_majority('h')} AS BIGINT) AS majority, [{_WIDE}] AS majority256, [{', '.join(f'xor(arg_min(h, frame_index), {k * P.STEP})' for k in range(1, 8))}] AS crop_hashes FROM ({P.FRAMES_SQL}) f GROUP BY key")
def timeline_build(t, spark, sf_dir):
    return fingerprint.timelines(P.wide_frames(spark, sf_dir))


@query()
def moving_fingerprints(t, spark, sf_dir):
    """Fingerprints of moving media from the pixels of the frames that the sampling rules choose."""
    return fingerprint.moving_fingerprints(P.frame_metadata(spark, sf_dir), P.stored_frames(spark, sf_dir, ingest._folder(spark)))


@query("SELECT CASE WHEN extension IN ('jpg','jpeg','png','webp') THEN 'still' WHEN extension = 'gif' THEN 'gif' WHEN extension IN ('mp4','m4v','webm') THEN 'video' ELSE 'none' END AS way, count(*) AS n FROM {objects} o GROUP BY 1")
def fingerprint_dispatch(t, spark, sf_dir):
    return t("objects").groupBy(F.coalesce(fingerprint.dispatch(c("extension")), F.lit("none")).alias("way")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- summaries


@query("SELECT a.*, b.* FROM (SELECT count(*) AS selected_objects, CAST(sum(size) AS BIGINT) AS selected_bytes FROM {manifest} m) a, (SELECT count(*) AS inventory_objects, CAST(sum(size) AS BIGINT) AS inventory_bytes FROM {objects} o) b")
def manifest_totals(t, spark, sf_dir):
    return summary.manifest_totals(t("manifest"), t("objects"))


@query("SELECT CAST(s.shard AS INT) AS shard, count(p.size) AS objects, CAST(coalesce(sum(p.size), 0) AS BIGINT) AS bytes FROM (SELECT unnest(range(0, 12)) AS shard) s LEFT JOIN {shard_plan} p ON p.shard = s.shard GROUP BY s.shard")
def shard_totals(t, spark, sf_dir):
    return summary.shard_totals(t("shard_plan"), 12)


@query("SELECT *, sum(discovered) OVER () = 0 AND bool_and(all_failed) OVER () AS refused FROM (SELECT source_number, count(status) AS discovered, max(return_code) AS return_code, bool_and(return_code <> 0) AS all_failed FROM {runs} r GROUP BY source_number) q")
def source_counts(t, spark, sf_dir):
    return summary.source_counts(t("runs"))


@query("""SELECT *, source_partial_failures > 0 AS history_rolled_back FROM (SELECT count(DISTINCT source_number) AS attempted, count(DISTINCT source_number) FILTER (return_code <> 0 OR status = 'failed') AS source_partial_failures, count(status) AS discovered, count(*) FILTER (status <> 'rejected') AS staged, count(*) FILTER (status = 'uploaded') AS uploaded, count(*) FILTER (status = 'known') AS known, count(*) FILTER (status = 'rejected') AS rejected,
count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(bytes) FILTER (status = 'uploaded'), 0) AS BIGINT) AS uploaded_bytes FROM {runs} r) q""")
def acquisition_summary(t, spark, sf_dir):
    return summary.acquisition(t("runs"))


@query("SELECT source_number, min(source_number) OVER () AS rollback FROM (SELECT DISTINCT source_number FROM {runs} r WHERE return_code <> 0 OR status = 'failed') q")
def rollback_point(t, spark, sf_dir):
    return summary.failing(t("runs"))


@query("""SELECT shard, count(*) AS planned, CAST(sum(size) AS BIGINT) AS planned_bytes, count(*) FILTER (done) AS completed, count(*) FILTER (sent) AS uploaded, count(*) FILTER (done AND NOT sent) AS recognized, count(*) FILTER (lost AND NOT done) AS failed,
CAST(coalesce(sum(size) FILTER (done), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (sent), 0) AS BIGINT) AS bytes_transferred FROM (SELECT p.shard, p.size, coalesce(g.done, false) AS done, coalesce(g.sent, false) AS sent, coalesce(g.lost, false) AS lost FROM {shard_plan} p
LEFT JOIN (SELECT key, bool_or(outcome = 'completed') AS done, bool_or(outcome = 'completed' AND how = 'uploaded') AS sent, bool_or(outcome = 'failed') AS lost FROM {progress} r GROUP BY key) g ON g.key = p.source_key) q GROUP BY shard""")
def worker_report(t, spark, sf_dir):
    return summary.worker_report(t("shard_plan"), t("progress"))


@query("SELECT k.id, k.name, k.count, count(g.item) AS recount FROM {catalog_raw} k LEFT JOIN {item_tags} g ON g.tag = k.id WHERE k.name <> '' AND k.count > 0 GROUP BY k.id, k.name, k.count")
def tag_catalog(t, spark, sf_dir):
    used = t("item_tags").groupBy(c("tag").alias("id")).agg(F.count("*").alias("recount"))
    return tag_catalog_clean(t, spark, sf_dir).join(used, "id", "left").select("id", "name", "count", F.coalesce("recount", F.lit(0)).alias("recount"))


@query("""SELECT SHA256(line) AS digest, objects FROM (SELECT string_agg(d, '' ORDER BY bucket) AS line, CAST(sum(n) AS BIGINT) AS objects FROM (SELECT bucket, SHA256(line) AS d, n FROM (SELECT left(d, 2) AS bucket, string_agg(d, '' ORDER BY d) AS line, count(*) AS n FROM (
SELECT SHA256(line) AS d FROM (SELECT key || chr(0) || file_id || chr(0) || CAST(size AS STRING) || chr(0) || sha1 AS line FROM {objects} o) a) b GROUP BY 1) e) f) g""")
def inventory_digest(t, spark, sf_dir):
    return summary.digest(t("objects"))


@query("""SELECT 1 AS version, objects AS count, SHA256(line) AS inventory_digest FROM (SELECT string_agg(d, '' ORDER BY bucket) AS line, CAST(sum(n) AS BIGINT) AS objects FROM (SELECT bucket, SHA256(line) AS d, n FROM (SELECT left(d, 2) AS bucket, string_agg(d, '' ORDER BY d) AS line, count(*) AS n FROM (
SELECT SHA256(line) AS d FROM (SELECT key || chr(0) || file_id || chr(0) || CAST(size AS STRING) || chr(0) || sha1 AS line FROM {objects} o) a) b GROUP BY 1) e) f) g""")
def canonical_header(t, spark, sf_dir):
    return summary.canonical_header(t("objects"))


_PIECES = ", ".join(f"CAST(sum(CAST('0x' || substring(d, {1 + 15 * k}, 15) AS BIGINT)) AS DECIMAL(38,0)) AS s{k}" for k in range(4))
_MULTISET = f"SELECT count(*) AS objects, {_PIECES} FROM (SELECT SHA256(line) AS d FROM (SELECT key || chr(0) || file_id || chr(0) || CAST(size AS STRING) || chr(0) || sha1 AS line FROM {{{{{{0}}}}}} o) a) b"


@query(_MULTISET.format("objects"))
def inventory_multiset(t, spark, sf_dir):
    return summary.multiset_digest(t("objects"))


@query(_MULTISET.format("objects_v2"))
def inventory_multiset_updated(t, spark, sf_dir):
    """The digest of the new inventory from that of the old one and the changes alone."""
    old, new = t("objects"), t("objects_v2")
    changes = cut(reconcile.difference(old, new))
    side = lambda rows, *kinds: rows.join(changes.where(c("change").isin(*kinds)).select("key"), "key", "left_semi")
    return summary.updated_digest(summary.multiset_digest(old), side(new, "added", "changed"), side(old, "removed", "changed"))


# ---------------------------------------------------------------- selection and graphs

_PICKED = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT key, size, row_number() OVER (ORDER BY SHA256(w)) AS n FROM (SELECT key, size, '{SEED}' || chr(0) || key AS w FROM {{objects}} o WHERE starts_with(key, 'gallery/')) a),
walk(n, key, size, total, took) AS (SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), false UNION ALL
SELECT o.n, o.key, o.size, CASE WHEN w.total + o.size <= {BUDGET} THEN w.total + o.size ELSE w.total END, w.total + o.size <= {BUDGET} FROM walk w JOIN o ON o.n = w.n + 1) """


@query(_PICKED + "SELECT key, size FROM walk WHERE took")
def budget_select(t, spark, sf_dir):
    return selection.budget_select(t("objects"), BUDGET, SEED)


@query(_PICKED + f"SELECT w.key AS source_key, 'gallery/generations/g9/' || substring(w.key, 9) AS destination_key, w.size, o.sha1, o.file_id, o.extension, CASE WHEN o.content_type IN ('', 'b2/x-auto') THEN coalesce(CASE o.extension {_MIME} END, 'application/octet-stream') ELSE o.content_type END AS content_type FROM walk w JOIN {{objects}} o ON o.key = w.key WHERE took")
def manifest_build(t, spark, sf_dir):
    inventory = summary.refused_if_unverifiable(t("objects"))
    chosen = cut(selection.budget_select(inventory, BUDGET, SEED))
    typed = content_type_resolve(t, spark, sf_dir)
    made = chosen.join(typed, "key").join(inventory.select("key", "sha1", "file_id", "extension"), "key")
    made = made.select(c("key").alias("source_key"), F.concat(F.lit("gallery/generations/g9/"), F.substring("key", 9, 1000000)).alias("destination_key"), "size", "sha1", "file_id", "extension", "content_type")
    summary.valid_manifest(made.withColumn("generation", F.lit("g9")), summary.manifest_header(chosen, inventory, "g9", NOW, SEED, BUDGET))
    return made


def _entries(t):
    return t("manifest").select(F.concat(F.lit("s"), (c("doc_id") % 3).cast("string")).alias("generation"), c("source_key").alias("key"), "size")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT generation, key, size, row_number() OVER (PARTITION BY generation ORDER BY size DESC, key) AS n FROM (SELECT 's' || CAST(doc_id % 3 AS STRING) AS generation, source_key AS key, size FROM {{manifest}} m) a),
walk(generation, n, key, size, shard, loads) AS (SELECT DISTINCT generation, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), 0, list_transform(range(0, {SHARDS}), lambda i: CAST(0 AS BIGINT)) FROM e UNION ALL
SELECT e.generation, e.n, e.key, e.size, CAST(list_position(w.loads, list_min(w.loads)) AS INT), list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + e.size ELSE x END) FROM walk w JOIN e ON e.generation = w.generation AND e.n = w.n + 1)
SELECT generation, key, size, CAST(shard - 1 AS INT) AS shard FROM walk WHERE n > 0""")
def byte_shards(t, spark, sf_dir):
    return selection.byte_shards(_entries(t), SHARDS)


@query(f"""SELECT key, size, CAST(least(floor((upto - size / 2) * {SHARDS} / total), {SHARDS - 1}) AS INT) AS shard FROM (SELECT key, size, sum(size) OVER (ORDER BY SHA256(key) ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM (SELECT source_key AS key, size FROM {{manifest}} m) a) q""")
def byte_shards_scaled(t, spark, sf_dir):
    return selection.byte_shards_scaled(_entries(t), SHARDS)


_ASKED = "['all', 'Stills', 'clips', 'webm', 'no such bucket']"
_ASKS = f"SELECT s_suppkey AS request, CASE WHEN lower(asked) IN ('stills', 'clips', 'jpg', 'jpeg', 'png', 'gif', 'webp', 'mp4', 'm4v', 'webm') THEN lower(asked) ELSE 'all' END AS bucket FROM (SELECT s_suppkey, {_ASKED}[s_suppkey % 5 + 1] AS asked FROM supplier) a"


@query(f"""WITH i AS MATERIALIZED (SELECT bucket, key, row_number() OVER (PARTITION BY bucket ORDER BY SHA256(key)) AS n, count(*) OVER (PARTITION BY bucket) AS total FROM ({_BUCKETED}) b)
SELECT request, key, total FROM (SELECT request, bucket, CAST('0x' || left(SHA256(w), 15) AS BIGINT) AS draw FROM (SELECT request, bucket, 'pick' || chr(0) || CAST(request AS STRING) AS w FROM ({_ASKS}) r) a) d JOIN i USING (bucket) WHERE i.n = draw % total + 1""")
def random_pick(t, spark, sf_dir):
    items = t("objects").select("key", F.explode(rules.buckets_of(c("extension"))).alias("bucket"))
    asked = F.get(F.array(*map(F.lit, ("all", "Stills", "clips", "webm", "no such bucket"))), (c("s_suppkey") % 5).cast("int"))
    return selection.random_pick(items, t("supplier").select(c("s_suppkey").alias("request"), rules.requested_bucket(asked).alias("bucket")), "pick")


_WANTED = "SELECT DISTINCT r.request, k.id AS tag FROM {requests} r JOIN {catalog_raw} k ON k.name = r.tag WHERE k.name <> '' AND k.count > 0"


@query(f"SELECT w.request, g.item FROM ({_WANTED}) w JOIN {{item_tags}} g USING (tag) GROUP BY w.request, g.item HAVING count(DISTINCT tag) = (SELECT count(*) FROM ({_WANTED}) x WHERE x.request = w.request)")
def tag_and_filter(t, spark, sf_dir):
    wanted = t("requests").join(tag_catalog_clean(t, spark, sf_dir).select("id", c("name").alias("tag")), "tag").select("request", c("id").alias("tag")).distinct()
    return selection.with_all_tags(t("item_tags"), wanted)


#: Tagged items of a known extension, the terms they have (tags, and their buckets but `all`), and requests: tags and the bucket that the request means.
_TAGGED = "SELECT item, key, lower(ext) AS ext FROM {items} i WHERE lower(ext) IN ('jpg','jpeg','png','webp','gif','mp4','m4v','webm')"
_PICK_SETS = f"""SELECT request, list_sort(list(DISTINCT term)) AS terms FROM (SELECT request, CAST(tag AS VARCHAR) AS term FROM ({_WANTED}) w WHERE request % 3 <> 2 UNION ALL SELECT request, 'bucket:' || bucket FROM ({_ASKS}) a) u GROUP BY request"""


@query(f"""WITH i AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY SHA256(w), item) AS pos FROM (SELECT *, CAST(item AS STRING) AS w FROM ({_TAGGED}) g) h), t AS MATERIALIZED (SELECT DISTINCT item, term FROM (SELECT item, CAST(tag AS VARCHAR) AS term FROM {{item_tags}} g UNION ALL SELECT item, 'bucket:all' FROM i
UNION ALL SELECT item, 'bucket:' || CASE WHEN ext IN ('jpg','jpeg','png','webp') THEN 'stills' ELSE 'clips' END FROM i UNION ALL SELECT item, 'bucket:' || ext FROM i) u), q AS MATERIALIZED ({_PICK_SETS}),
m AS MATERIALIZED (SELECT request, item, pos, key FROM (SELECT request, len(terms) AS k, unnest(terms) AS term FROM q) r JOIN t USING (term) JOIN i USING (item) GROUP BY request, item, pos, key HAVING count(*) = max(k))
SELECT request, key, total FROM (SELECT request, key, count(*) OVER (PARTITION BY request) AS total, row_number() OVER (PARTITION BY request ORDER BY pos) AS n, CAST('0x' || left(SHA256(w), 15) AS BIGINT) AS draw FROM (SELECT *, 'pick' || chr(0) || CAST(request AS STRING) AS w FROM m) a) b WHERE n = draw % total + 1""")
def random_pick_tagged(t, spark, sf_dir):
    """A random item of those that have all tags of a request and are in its bucket; some requests name no tags."""
    items = from_sql(spark, sf_dir, _TAGGED)
    term = lambda x: F.concat(F.lit("bucket:"), x)
    terms = t("item_tags").select("item", c("tag").cast("string").alias("term")).unionByName(items.select("item", F.explode(F.transform(rules.buckets_of(c("ext")), term)).alias("term")))
    tags, buckets = _tag_requests(t, spark, sf_dir)
    tags = tags.where("request % 3 <> 2").select("request", c("tag").alias("term"))
    buckets = buckets.select("request", term(c("bucket")).alias("term"))
    return postings.picked(items, terms, tags.unionByName(buckets).groupBy("request").agg(F.collect_set("term").alias("terms")), "pick")


def _tag_requests(t, spark, sf_dir):
    """(request, tag) of known tags as text, and (request, bucket) of what each request asks for."""
    tags = t("requests").join(tag_catalog_clean(t, spark, sf_dir).select("id", c("name").alias("tag")), "tag").select("request", c("id").cast("string").alias("tag")).distinct()
    asked = F.get(F.array(*map(F.lit, ("all", "Stills", "clips", "webm", "no such bucket"))), (c("s_suppkey") % 5).cast("int"))
    return tags, t("supplier").select(c("s_suppkey").alias("request"), rules.requested_bucket(asked).alias("bucket"))


@query(f"""SELECT w.request, g.item FROM ({_WANTED}) w JOIN {{item_tags}} g USING (tag) JOIN ({_TAGGED}) i USING (item) JOIN ({_ASKS}) a ON a.request = w.request
WHERE a.bucket IN ('all', i.ext, CASE WHEN i.ext IN ('jpg','jpeg','png','webp') THEN 'stills' ELSE 'clips' END) GROUP BY w.request, g.item HAVING count(DISTINCT tag) = (SELECT count(*) FROM ({_WANTED}) x WHERE x.request = w.request)""")
def tag_bucket_filter(t, spark, sf_dir):
    """tag_and_filter() within the bucket of the request: the bucket is one more tag that an item must have."""
    items = from_sql(spark, sf_dir, _TAGGED)
    term = lambda x: F.concat(F.lit("bucket:"), x)
    own = t("item_tags").join(items.select("item"), "item", "left_semi").select("item", c("tag").cast("string").alias("tag")).unionByName(items.select("item", F.explode(F.transform(rules.buckets_of(c("ext")), term)).alias("tag")))
    tags, buckets = _tag_requests(t, spark, sf_dir)
    within = buckets.join(tags.select("request").distinct(), "request", "left_semi").where("bucket <> 'all'").select("request", term(c("bucket")).alias("tag"))
    return selection.with_all_tags(own, tags.unionByName(within))


_GRAPH = f""", r AS MATERIALIZED (SELECT key, row_number() OVER (ORDER BY quality DESC, key) AS n FROM (SELECT key, log2(greatest(1.0, CAST(CAST(width AS BIGINT) * height AS DOUBLE))) + CASE WHEN kind <> 1 THEN 0.9::DOUBLE * log2(greatest(1.0, CAST(coalesce(duration_ms, 0) AS DOUBLE))) ELSE 0.0::DOUBLE END
 + 0.08::DOUBLE * log2(greatest(1.0, CAST(size AS DOUBLE))) AS quality FROM prints) q),
e AS MATERIALIZED ({_EVERY_EDGE}),
s AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
g AS MATERIALIZED (SELECT x.n AS u, list(y.n) AS vs FROM s JOIN r x ON x.key = s.u JOIN r y ON y.key = s.v GROUP BY x.n),
o AS MATERIALIZED (SELECT u, vs, row_number() OVER (ORDER BY u) AS i FROM g),
walk(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.i, CASE WHEN list_has_any(w.kept, o.vs) THEN w.kept ELSE list_append(w.kept, o.u) END FROM walk w JOIN o ON o.i = w.i + 1),
kept AS MATERIALIZED (SELECT unnest(kept) AS u FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1) z) """
_CHOSEN = _WITH_PAIRS.replace("WITH prints", "WITH RECURSIVE prints", 1) + _PAIR_MOVING + _ALIGNED + _GRAPH


def _class_edges(spark, sf_dir):
    """The class of each still, and the edges between classes."""
    p = cut(P.prints(spark, sf_dir))
    members = cut(similarity.still_classes(p))
    first = cut(p.join(dealt(members.where("key = class").select("key")), "key", "left_semi"))
    pairs = cut(similarity.still_candidates(first).unionByName(similarity.crop_candidates(first)).distinct())
    still = similarity.still_edges(pairs, first)
    return members, cut(still.unionByName(similarity.crop_edges(pairs, first, still)))


def _graph(spark, sf_dir):
    """Quality of all media, their classes and the edges between classes, less exclusions."""
    p = cut(P.prints(spark, sf_dir))
    return P.rated(p), *similarity.class_graph(p, _excluded(spark, sf_dir))


@query(_CHOSEN + "SELECT r.key, r.n IN (SELECT u FROM kept) AS survives FROM g JOIN r ON r.n = g.u")
def consolidate_graph(t, spark, sf_dir):
    return consolidate.class_survivors(*_graph(spark, sf_dir))


_QUEUE = """SELECT l.key AS left_key, x.key AS right_key, e.score, e.evidence, 'g1' AS generation, row_number() OVER (ORDER BY l.n, x.key) AS pos FROM (SELECT q.v, min(q.u) AS u FROM (SELECT g.u AS v, unnest(g.vs) AS u FROM g) q WHERE q.u IN (SELECT u FROM kept) AND q.v NOT IN (SELECT u FROM kept) GROUP BY q.v) m
JOIN r l ON l.n = m.u JOIN r x ON x.n = m.v JOIN e ON (e.a = l.key AND e.b = x.key) OR (e.b = l.key AND e.a = x.key)"""


@query(_CHOSEN + _QUEUE)
def review_queue(t, spark, sf_dir):
    return consolidate.class_review_queue(*_graph(spark, sf_dir), "g1")


@query(_CHOSEN + f"""SELECT a.*, b.*, (SELECT count(*) FROM ({_QUEUE}) z) AS candidates FROM (SELECT count(*) FILTER (change <> 'gone') AS inventory, count(*) FILTER (change <> 'gone' AND phash IS NOT NULL) AS reused, count(*) FILTER (change <> 'gone' AND phash IS NULL) AS to_compute,
 bool_and(phash IS NOT NULL) FILTER (change <> 'gone') AS converged FROM ({_RECONCILED}) q) a, (SELECT count(*) - count(DISTINCT sha256) AS exact FROM {{objects_v2}} o) b""")
def dedupe_summary(t, spark, sf_dir):
    return summary.startup(reconcile.reconciled(t("stored"), t("objects_v2")), t("objects_v2"), consolidate.class_review_queue(*_graph(spark, sf_dir), "g1"))


_RANK = "CAST(regexp_extract(right_key, '([0-9]+)', 1) AS BIGINT)"
#: What is stored now: some objects have another file id than their card showed, some are gone.
_LIVE = "SELECT key, CASE WHEN base % 5 = 1 THEN file_id || '-b' ELSE file_id END AS file_id FROM prints WHERE base % 25 <> 2"


def _decisions(spark, sf_dir):
    """The review queue, a decision for three of four cards (every tenth of an older generation) with the file ids shown, what is stored now, and exclusions stored before."""
    p = cut(P.prints(spark, sf_dir).select("base", "key", "file_id"))
    queue = cut(consolidate.class_review_queue(*_graph(spark, sf_dir), "g1"))
    q = queue.withColumn("rank", F.expr(_RANK))
    kind = F.when(c("rank") % 4 == 0, "keep both").when(c("rank") % 4 == 1, "delete left").when(c("rank") % 4 == 2, "delete right")
    made = q.where("rank % 4 <> 3").select("left_key", "right_key", kind.alias("decision"), F.when(c("rank") % 10 == 0, "g0").otherwise("g1").alias("seen"))
    shown = p.select(c("key").alias("shown"), "file_id")
    made = made.join(dealt(shown), F.when(c("decision") == "delete left", c("left_key")).when(c("decision") == "delete right", c("right_key")) == c("shown"), "left").drop("shown")
    live = p.where("base % 25 <> 2").select("key", F.when(c("base") % 5 == 1, F.concat("file_id", F.lit("-b"))).otherwise(c("file_id")).alias("file_id"))
    stored = q.where("rank % 8 = 0").select(F.least("left_key", "right_key").alias("first_key"), F.greatest("left_key", "right_key").alias("second_key"))
    return queue, made, live, stored


_DECIDED = f"""SELECT left_key, right_key, decision, target, d.file_id, CASE WHEN seen <> 'g1' THEN 'stale' WHEN target IS NOT NULL AND (l.file_id IS NULL OR l.file_id <> d.file_id) THEN 'changed' ELSE 'accepted' END AS state FROM (
SELECT q.*, p.file_id FROM (SELECT *, CASE decision WHEN 'delete left' THEN left_key WHEN 'delete right' THEN right_key END AS target FROM (SELECT left_key, right_key, CASE rank % 4 WHEN 0 THEN 'keep both' WHEN 1 THEN 'delete left' ELSE 'delete right' END AS decision, CASE WHEN rank % 10 = 0 THEN 'g0' ELSE 'g1' END AS seen
FROM (SELECT left_key, right_key, {_RANK} AS rank FROM ({_QUEUE}) q0) r WHERE rank % 4 <> 3) s) q LEFT JOIN prints p ON p.key = q.target) d LEFT JOIN ({_LIVE}) l ON l.key = d.target"""


@query(_CHOSEN + _DECIDED)
def decision_check(t, spark, sf_dir):
    queue, made, live, _ = _decisions(spark, sf_dir)
    return decisions.checked(made, queue, live)


@query(_CHOSEN + f"""SELECT DISTINCT 'delete' AS action, target AS key, CAST(NULL AS VARCHAR) AS other, file_id FROM ({_DECIDED}) c WHERE state = 'accepted' AND target IS NOT NULL
UNION ALL SELECT DISTINCT 'exclude', least(left_key, right_key), greatest(left_key, right_key), CAST(NULL AS VARCHAR) FROM ({_DECIDED}) e WHERE state = 'accepted' AND target IS NULL AND {_RANK} % 8 <> 0""")
def decision_apply(t, spark, sf_dir):
    queue, made, live, stored = _decisions(spark, sf_dir)
    return decisions.applied(decisions.checked(made, queue, live), stored)


# ---------------------------------------------------------------- streaming


@query("SELECT DISTINCT s.key, s.size FROM {objects_v2} s WHERE s.extension IN ('jpg','jpeg','png','webp','gif','mp4','m4v','webm') AND s.size > 0 AND s.size <= 524288000 AND s.key NOT IN (SELECT key FROM {objects} o WHERE doc_id % 2 = 0)")
def stream_acquire(t, spark, sf_dir):
    return ingest.acquire(spark, t("objects_v2"), t("objects").where("doc_id % 2 = 0"), 500 << 20)


@query(f"SELECT lower(source) AS folded, arg_min(source, position) AS source, min(position) AS position FROM ({_API}) q WHERE source <> '' GROUP BY 1")
def stream_sources(t, spark, sf_dir):
    return ingest.upsert_sources(spark, t("raw_sources"))


@query("""SELECT key, ext, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn DESC, position DESC) AS n FROM (
SELECT key, extension AS ext, size, doc_id AS position, 0 AS turn FROM {objects} a UNION ALL SELECT key, extension, size, doc_id, 1 FROM {objects_v2} b) u) q WHERE n = 1""")
def stream_index_checkpoint(t, spark, sf_dir):
    rows = lambda n: t(n).select("key", c("extension").alias("ext"), "size", c("doc_id").alias("position"))
    return ingest.checkpoint_index(spark, rows("objects"), rows("objects_v2"), 500)


@query(f"SELECT key, phash IS NULL AS computed, phash AS kept FROM ({_RECONCILED}) q WHERE change <> 'gone'")
def stream_fingerprint(t, spark, sf_dir):
    return stream_fingerprint_hashes(t, spark, sf_dir).select("key", "computed", F.when(~c("computed"), c("phash")).alias("kept"))


@query()
def stream_fingerprint_hashes(t, spark, sf_dir):
    """stream_fingerprint() with the hashes that were computed."""
    vectors = P.vectors(spark, sf_dir)
    return ingest.fingerprint_changes(spark, t("stored"), t("objects_v2"), lambda keys: P.object_pixels(keys, sf_dir, vectors))


@query(f"SELECT generation, status, coalesce(updated_at, created_at, {NOW}) AS at FROM ({_LATEST}) q WHERE status IN ('building', 'recovering', 'ready') AND {NOW} - coalesce(updated_at, created_at, {NOW}) >= 86400")
def stream_abandoned(t, spark, sf_dir):
    return ingest.idle_generations(spark, t("states"), NOW, reconcile.DAY, 10 * 366 * reconcile.DAY)
