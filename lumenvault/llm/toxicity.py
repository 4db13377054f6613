"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, ship, written

#: Lengths of the character n-grams, in code points.
SIZES = (3, 4, 5)
#: Hash buckets that n-grams fall into, as a power of two.
BITS = 18
#: Labelled rows that the classifier is fitted on at most: those of smallest hash of their key.
TRAIN_ROWS = 20_000
#: Log-count ratios of less than this many standard errors are taken as chance, so as 0; the others scale their feature.
#: This and the ridge were chosen by three-fold cross-validation over the rows that may be learnt from.
SIGNIFICANT = 3.0
#: Penalty on half the squared coefficients, beside the summed loss.
RIDGE = 1.0
#: Code points whose n-grams are hashed at a time.
BLOCK = 1 << 20


def features(text: str, mark: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text. mark: scratch space of 2**BITS ints, reused between calls."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for at in range(0, len(points), BLOCK):
        c = points[at : at + BLOCK + max(SIZES) - 1]
        h, held = c, 1
        for size in SIZES:
            while held < size and len(h) > 1:
                h, held = h[:-1] * np.uint32(0x01000193) + c[held:], held + 1
            if held == size and len(h):
                out.append(((h ^ np.uint32(size * 0x2545F491)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
        if len(out) > 16 * len(SIZES):
            out = [np.unique(np.concatenate(out))]
    ids = np.concatenate(out).astype(np.int32) if out else np.empty(0, np.int32)
    order = np.arange(len(ids), dtype=np.int32)
    mark[ids] = order
    return ids[mark[ids] == order]


@dataclass
class Model:
    """weight: of each hashed n-gram (log-count ratio times fitted coefficient)."""

    weight: np.ndarray
    bias: float

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[ids].sum(dtype=np.float64), -30, 30))))


def held_out(key):
    """Rows whose label is never learnt from: crc32 of the key as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """(text, y) of the labelled documents that may be learnt from, `most` keys at most.

    A key labelled more than once counts with its highest label; null keys and labels are left out.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    rows = rows.groupBy(F.col(key).alias("__k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = rows.orderBy(F.xxhash64("__k"), "__k").limit(most)
    # `most` keys and labels: 12 bytes each, so broadcast whatever the size of the tables
    return docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(rows), "__k").select("text", "y")


def ratios(rows: DataFrame, zero: int, one: int) -> np.ndarray:
    """The log-count ratio of each hashed n-gram over rows (text, y), 0 where it is no more than chance."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, n = np.zeros(size, np.int32), np.zeros((2, size), np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                n[int(y > 0), features(t.as_py(), mark)] += 1
        used = np.flatnonzero(n.sum(0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[0, used]), pa.array(n[1, used])], names=["f", "n0", "n1"])

    counts = rows.mapInArrow(count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 1) / (one + 2)) - F.log((F.col("n0") + 1) / (zero + 2))
    error = F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    # 2**BITS rows at most
    kept = counts.select("f", ratio.alias("r"), error.alias("e")).where(F.abs("r") >= SIGNIFICANT * F.col("e")).select("f", "r").toArrow()
    out = np.zeros(size)
    out[kept["f"].to_numpy()] = kept["r"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> Model:
    """The classifier for `label`, fitted by Spark's logistic regression over the scaled features.

    Repeated documents of a labelled key each count. Without rows of both classes, so with empty tables too, it
    gives every text their share (0.5 for none).
    """
    spark = docs.sparkSession
    ship(spark)
    rows = written(training_rows(docs, labels, label, key, text, most))
    docs_of = {bool(r[0]): r[1] for r in rows.groupBy(F.col("y") > 0).count().collect()}
    zero, one = docs_of.get(False, 0), docs_of.get(True, 0)
    if not zero or not one:
        p = one / (one + zero) if one + zero else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    r = ratios(rows, zero, one)
    kept = np.flatnonzero(r)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    held = spark.sparkContext.broadcast((place, r[kept]))  # 3 MB at most

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, (at, scale) = np.zeros(1 << BITS, np.int32), held.value
        for batch in batches:
            found = [np.sort(x[x >= 0]) for x in (at[features(t.as_py(), mark)] for t in batch.column(0))]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            n = len(found)
            ids, values = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (flat, scale[flat]))
            # a sparse vector: kind 0, size, indices, values
            vector = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, max(1, len(scale)), np.int32)), ids, values], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([vector, pa.array((np.array(batch.column(1).to_pylist()) > 0).astype(np.float64))], names=["features", "label"])

    # hashed once, as the fit reads its rows several times
    sample = written(rows.mapInArrow(vectors, T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])))
    fitted = LogisticRegression(regParam=RIDGE / (zero + one), standardization=False, maxIter=100, tol=1e-6).fit(sample)
    weight = np.zeros(1 << BITS, np.float32)
    weight[kept] = (r[kept] * fitted.coefficients.toArray()[: len(kept)]).astype(np.float32)
    return Model(weight, float(fitted.intercept))


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the column `out`, 0 to 1; a null text scores as an empty one, equal texts score alike.

    Every row stays, repeated ones too; a column of that name is replaced. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # 2**BITS floats: 1 MB

    def build():
        own, mark = Model(*held.value), np.zeros(1 << BITS, np.int32)
        return lambda texts: [(own.score(features(t, mark)),) for t in texts]

    return append_columns(docs, text, [T.StructField(out, T.DoubleType())], build)
