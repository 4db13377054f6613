"""Byte spans of documents: keys that tell rows apart, and removal of spans from the texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Rows are told apart by these two numbers; rows that agree in key and text share them and their result.
KEYS = ("__k", "__th")


def row_key(key: str, text: str):
    """The key, or for a null key a number from 2^62 upward made from the text."""
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(text).bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1)))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(__k, __th, key, text): the row's key and a hash of its text; a null text is empty."""
    clean = F.coalesce(F.col(text), F.lit(""))
    return docs.select(row_key(key, text).alias("__k"), F.xxhash64(clean).alias("__th"), F.col(key).alias("__id"), clean.alias("__text"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the union of half-open intervals; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[first], reach[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(reach) - 1]))]


def without(raw: bytes, starts, ends) -> bytes:
    """`raw` less the merged spans."""
    at, out = 0, []
    for s, e in zip(starts, ends):
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def kept_digests(rows: DataFrame, found: DataFrame, key: str, *counts: str) -> DataFrame:
    """Per row of `rows` (from keyed()): key, counts, n_bytes, n_removed, n_spans, kept_sha256, spans, by the spans of `found`.

    found: (__k, __th, spans array<struct<s:bigint,e:bigint>>), merged and written to a table; counts: more BIGINT columns of it, 0 if missing.
    """
    ship(rows.sparkSession)
    both = rows.join(found, list(KEYS), "left").select("__id", "__text", "spans", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])

    def run(batches):
        for batch in batches:
            made: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                own = [(x["s"], x["e"]) for x in spans.as_py() or []]
                kept = without(raw, [s for s, _ in own], [e for _, e in own])
                for to, x in zip(made, (len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), ",".join(f"{s}:{e}" for s, e in own))):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], *(pa.array(x, kind) for x, kind in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))], names=[key, *counts, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = T.StructType([T.StructField(key, rows.schema["__id"].dataType), *(T.StructField(n, T.LongType()) for n in (*counts, "n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return both.mapInArrow(run, schema)


def kept_text(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, text): the texts less their spans; a byte cut out of a character leaves U+FFFD."""
    both = rows.join(found, list(KEYS), "left").select(F.col("__id").alias(key), F.col("__text").alias("text"), F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"))
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                own = spans.as_py()
                out.append(without(text.as_py().encode("utf-8", "surrogatepass"), [x["s"] for x in own], [x["e"] for x in own]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return both.mapInArrow(run, T.StructType([T.StructField(key, rows.schema["__id"].dataType), T.StructField("text", T.StringType())]))


def unions(intervals: DataFrame) -> DataFrame:
    """(__k, __th, spans) from rows (__k, __th, s, e): the maximal runs of each document's intervals.

    Intervals of a document lie in one row only as far as its own text is long; they are merged in one pass.
    """
    ship(intervals.sparkSession)
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.column(2):
                s, e = merged(*(np.asarray(row.values.field(n)) for n in ("s", "e")))
                out.append([{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["__k", "__th", "spans"])

    grouped = intervals.groupBy(*KEYS).agg(F.collect_set(F.struct("s", "e")).alias("all"))
    return grouped.mapInArrow(run, "__k long, __th long, spans array<struct<s:bigint,e:bigint>>")
