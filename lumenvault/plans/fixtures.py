"""Domain tables derived from the given tables.

Each is one SQL text that Spark and the oracle share: {name} stands for a table, and SHA256(x) for
the digest function, which the two engines name differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The fixed time that ages are measured from: 1999-01-01T00:00:00Z.
NOW = 915148800
#: Bytes a selection may take, and the seed of its order.
BUDGET, SEED = 200_000_000, "seed-1"
SHARDS = 8

_STILL, _CLIP = "('jpg','jpeg','png','webp')", "('gif','mp4','m4v','webm')"

DERIVED: dict[str, str] = {
    "objects": f"""
SELECT doc_id, 'gallery/' || source || '/' || CAST(doc_id AS STRING) || '.' || extension AS key, extension, size,
 sha1(text) AS sha1, SHA256(text) AS sha256, 'f-' || CAST(doc_id AS STRING) AS file_id,
 CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'b2/x-auto' ELSE 'image/' || extension END AS content_type,
 doc_id * 60000 AS upload_timestamp, CAST(64 + doc_id % 1000 AS INT) AS width, CAST(48 + doc_id % 700 AS INT) AS height,
 CASE WHEN extension IN {_CLIP} THEN 1000 * (1 + doc_id % 60) END AS duration_ms,
 CASE WHEN extension IN {_STILL} THEN 1 WHEN extension = 'gif' THEN 2 WHEN extension IN {_CLIP} THEN 3 END AS media_kind
FROM (SELECT doc_id, text, source, n_chars * 1024 AS size, CASE doc_id % 10 WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'gif'
 WHEN 4 THEN 'webp' WHEN 5 THEN 'mp4' WHEN 6 THEN 'm4v' WHEN 7 THEN 'webm' WHEN 8 THEN 'txt' ELSE 'exe' END AS extension FROM {{documents}}) d""",
    # a raw listing: the digest is missing, 'none' or in the metadata for some; some rows are no uploads
    "listing": """
SELECT doc_id, key AS file_name, file_id, CASE WHEN doc_id % 43 = 0 THEN 0 ELSE size END AS content_length,
 CASE WHEN doc_id % 37 = 0 THEN 'hide' ELSE 'upload' END AS action, content_type,
 CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'none' ELSE sha1 END AS content_sha1,
 CASE WHEN doc_id % 5 < 2 AND doc_id % 4 <> 0 THEN sha1 END AS large_file_sha1, upload_timestamp FROM {objects} o""",
    "objects_v2": """
SELECT doc_id, key, extension, CASE WHEN doc_id % 13 = 0 THEN size + 1 ELSE size END AS size, sha1, sha256,
 CASE WHEN doc_id % 7 = 0 THEN file_id || '-b' ELSE file_id END AS file_id FROM {objects} o WHERE doc_id % 11 <> 0
UNION ALL
SELECT doc_id + 10000000, 'gallery/new/' || CAST(doc_id AS STRING) || '.' || extension, extension, size, sha1, sha256, file_id || '-n' FROM {objects} o WHERE doc_id % 17 = 0""",
    # the store before reconciliation: fingerprints of some rows, of an old version for some
    "stored": """
SELECT doc_id, key, file_id, size, sha1, CASE WHEN doc_id % 3 <> 0 THEN CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS INT) END AS fp_version,
 CASE WHEN doc_id % 3 <> 0 THEN doc_id * 7919 END AS phash FROM {objects} o""",
    "exclusions": """
SELECT CASE WHEN a.key < b.key THEN a.key ELSE b.key END AS first_key, CASE WHEN a.key < b.key THEN b.key ELSE a.key END AS second_key
FROM {objects} a JOIN {objects} b ON b.doc_id = a.doc_id + 3 WHERE a.doc_id % 5 = 0""",
    "operations": """
SELECT 'op-' || CAST(doc_id AS STRING) AS id, key AS target_key, CASE WHEN doc_id % 2 = 0 THEN file_id ELSE file_id || '-gone' END AS target_file_id,
 CASE doc_id % 3 WHEN 0 THEN 'prepared' WHEN 1 THEN 'remote_deleted' ELSE 'unknown' END AS state FROM {objects} o WHERE doc_id % 41 = 0 OR doc_id % 29 = 0""",
    "raw_sources": """
SELECT page_id AS position, CASE page_id % 6 WHEN 0 THEN name WHEN 1 THEN 'r/' || name WHEN 2 THEN '/r/' || name || '/new'
 WHEN 3 THEN CASE page_id % 5 WHEN 0 THEN 'HTTPS://' ELSE 'https://' END || CASE page_id % 4 WHEN 0 THEN 'www.' WHEN 1 THEN 'old.' ELSE '' END || 'reddit.com' || CASE page_id % 7 WHEN 0 THEN ':443/' WHEN 1 THEN '//' ELSE '/' END || 'r/' || name || CASE page_id % 11 WHEN 0 THEN '?a=1' WHEN 1 THEN '/top/?b' ELSE '/' END
 WHEN 4 THEN url ELSE CASE WHEN page_id % 4 = 1 THEN 'ab' WHEN page_id % 4 = 3 THEN CASE WHEN page_id % 8 = 3 THEN '/' || name || '/' ELSE name || '/extra' END ELSE 'bad-' || name END END AS value
FROM (SELECT page_id, url, CASE WHEN page_id % 7 < 3 THEN 'SRC' ELSE 'Src' END || CAST(page_id % 40 AS STRING) AS name FROM {pages}) p""",
    "manifest": """
SELECT doc_id, key AS source_key, 'gallery/generations/g1/' || substring(key, 9) AS destination_key, size, sha1, file_id, extension FROM {objects} o
WHERE doc_id % 2 = 0 AND extension NOT IN ('txt', 'exe')""",
    "prior_manifest": """
SELECT doc_id, key AS source_key, 'gallery/generations/g0/' || substring(key, 9) AS destination_key, size, sha1, extension FROM {objects} o
WHERE doc_id % 3 = 0 AND extension NOT IN ('txt', 'exe')""",
    "published": """
SELECT destination_key AS key, CASE WHEN doc_id % 23 = 0 THEN size + 1 ELSE size END AS size,
 CASE WHEN doc_id % 29 = 0 THEN 'wrong' WHEN doc_id % 5 = 0 THEN NULL ELSE sha1 END AS sha1,
 CASE WHEN doc_id % 31 = 0 THEN 'g0' WHEN doc_id % 7 = 0 THEN NULL ELSE 'g1' END AS generation, 'e-' || CAST(doc_id AS STRING) AS etag FROM {manifest} m WHERE doc_id % 19 <> 0""",
    "shard_plan": """
SELECT doc_id, source_key, size, CAST(doc_id % 8 AS INT) AS shard, CAST(0 AS INT) AS round FROM {manifest} m
UNION ALL SELECT doc_id + 50000000, 'gallery/foreign/' || CAST(doc_id AS STRING), size, CAST(doc_id % 8 AS INT), CAST(0 AS INT) FROM {manifest} m WHERE doc_id % 97 = 0""",
    "progress": """
SELECT CAST(doc_id % 8 AS INT) AS shard, CAST(CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS INT) AS round, source_key AS key,
 CASE WHEN doc_id % 3 = 0 THEN 'completed' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'pending' END AS outcome, CASE WHEN doc_id % 4 = 0 THEN 'uploaded' ELSE 'recognized' END AS how FROM {manifest} m
UNION ALL SELECT 0, 1, source_key, 'completed', 'recognized' FROM {manifest} m WHERE doc_id % 12 = 0
UNION ALL SELECT 1, 0, 'gallery/elsewhere/' || source_key, 'completed', 'uploaded' FROM {manifest} m WHERE doc_id % 53 = 0""",
    "states": """
SELECT 'g' || CAST(o_custkey AS STRING) AS generation, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'building' ELSE 'ready' END
 ELSE CASE o_orderkey % 4 WHEN 0 THEN 'recovering' WHEN 1 THEN 'active' WHEN 2 THEN 'publication-failed' ELSE 'abandoned' END END AS status,
 o_orderkey AS seq, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(extract(year FROM o_orderdate) AS BIGINT) * 31557600 - 62168472000 + CAST(extract(doy FROM o_orderdate) AS BIGINT) * 86400 END AS updated_at,
 CASE WHEN o_orderkey % 10 <> 0 THEN CAST(extract(year FROM o_orderdate) AS BIGINT) * 31557600 - 62168472000 END AS created_at FROM {orders}""",
    "catalog_raw": """
SELECT row_number() OVER (ORDER BY ord, name) - 1 AS id, CASE WHEN ord = 1 THEN '' ELSE name END AS name, n AS count FROM (
 SELECT p_brand AS name, count(*) AS n, 0 AS ord FROM {part} WHERE p_brand < 'Brand#2' GROUP BY p_brand
 UNION ALL SELECT 'blank', 5, 1 UNION ALL SELECT 'zero', 0, 2
 UNION ALL SELECT p_brand, count(*), 3 FROM {part} WHERE p_brand >= 'Brand#2' GROUP BY p_brand) c""",
    "item_tags": """
SELECT l_orderkey AS item, c.id AS tag FROM {lineitem} l JOIN {part} p ON l_partkey = p_partkey JOIN {catalog_raw} c ON c.name = p_brand GROUP BY l_orderkey, c.id
UNION ALL SELECT o_orderkey, 999999 FROM {orders} WHERE o_orderkey % 29 = 0""",
    "items": """
SELECT o_orderkey AS item, 'gallery/' || CAST(o_orderkey - CASE WHEN o_orderkey % 37 = 0 AND o_orderkey > 0 THEN 1 ELSE 0 END AS STRING) || '.jpg' AS key,
 CASE WHEN o_orderkey % 31 = 0 THEN 'exe' WHEN o_orderkey % 3 = 0 THEN 'GIF' ELSE 'jpg' END AS ext, o_orderkey AS position FROM {orders}""",
    "requests": """
SELECT s_suppkey AS request, c.name AS tag FROM {supplier} s JOIN {catalog_raw} c ON c.id % 11 = s_suppkey % 11 AND c.id < 22 AND c.name <> '' AND c.count > 0
UNION ALL SELECT s_suppkey, 'no such tag' FROM {supplier} WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, '' FROM {supplier} WHERE s_suppkey % 9 = 0""",
    "messages": """
SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'abuse@example.org' WHEN 1 THEN 'DMCA@Example.org' WHEN 2 THEN 'alias' || CAST(conv_id AS STRING) || '-k9@example.org'
 WHEN 3 THEN CASE WHEN conv_id % 4 = 1 THEN 'alias-K9@example.org' ELSE 'alias@example.org' END WHEN 4 THEN CASE WHEN conv_id % 4 = 0 THEN 'O''Hara+x/y=1-k9@example.org' ELSE '.bad-k9@example.org' END
 ELSE CASE WHEN conv_id % 4 = 1 THEN 'no-at-sign' ELSE 'who-k9@elsewhere.net' END END AS recipient,
 text || ' Alias' || CAST(conv_id AS STRING) || '-K9@Example.ORG' AS text, CAST(length(text) AS BIGINT) * CASE WHEN conv_id % 50 = 0 THEN 1000000 ELSE 1 END AS raw_size FROM {conversations}""",
    "runs": """
SELECT event_id, user_id % 20 AS source_number, CASE event_type WHEN 'click' THEN 'uploaded' WHEN 'purchase' THEN 'uploaded' WHEN 'view' THEN 'known' WHEN 'signup' THEN 'rejected'
 ELSE CASE WHEN user_id % 20 IN (9, 15) THEN 'failed' ELSE 'known' END END AS status, CAST(floor(value * 1000) AS BIGINT) AS bytes, CAST(CASE WHEN user_id % 20 = 12 THEN 1 ELSE 0 END AS INT) AS return_code FROM {events}""",
}


def text_of(name: str, table) -> str:
    """The SQL of a derived table; table(name) gives the text that stands for a given table."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({text_of(m[1], table)})" if m[1] in DERIVED else table(m[1]), DERIVED[name])


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; a given table under its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return from_sql(spark, sf_dir, "SELECT * FROM {" + name + "} t")


def from_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over tables and derived tables in braces."""
    given = lambda t: f"parquet.`{sf_dir}/{t}.parquet`"
    sql = re.sub(r"\{(\w+)\}", lambda m: f"({text_of(m[1], given)})" if m[1] in DERIVED else given(m[1]), sql)
    return spark.sql(re.sub(r"SHA256\((\w+)\)", r"sha2(\1, 256)", sql))


def with_tables(sql: str) -> str:
    """Oracle SQL with {derived} names replaced by their texts."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({text_of(m[1], lambda t: t)})" if m[1] in DERIVED else m[1], sql).replace("SHA256(", "sha256(")
