"""Shared pieces of the text operators: table access, Arrow row maps, written tables, graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import dealt, discard, ship, small, written
from ..sources.shared import work_dir as shared_dir

__all__ = ["append_columns", "bound", "components", "dealt", "discard", "lower_ascii", "shared_dir", "ship", "slices", "small", "table", "written"]

#: Bytes of text that a Python task holds as word or piece lists at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with `value` computed once, however often `make` names it and wherever a filter moves it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def slices(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Runs of whole texts of about SLICE_BYTES; a longer text is a run of its own. Null is ""."""
    run, held = [], 0
    for text in texts:
        text = text or ""
        if run and held + len(text) > SLICE_BYTES:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], build: Callable[[], Callable]) -> DataFrame:
    """`df` with `fields` computed from the string column `text`, an Arrow batch at a time.

    build() runs once a task and returns a function from a list of texts (null is "") to a list of
    rows (tuples in the order of `fields`). Other columns pass through untouched; one of the name of
    a field (in any case) is replaced by it.
    """
    ship(df.sparkSession)
    at = df.columns.index(text)
    own = [f"__made_{k}" for k in range(len(fields))]
    names = df.columns + own
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = build()
        for batch in batches:
            done = 0
            for part in slices(x.as_py() for x in batch.column(at)):
                rows = work(part)
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                given = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([*given.columns, *made], names=names)

    made = df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(own, fields))]))
    new = {f.name.lower() for f in fields}
    return made.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new], *[F.col(n).alias(f.name) for n, f in zip(own, fields)])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (a, b): the smallest node it reaches.

    Alternates large-star and small-star steps until nothing changes, so a chain of n nodes takes about
    log n rounds. The smallest neighbour of a node comes from a partial aggregate and its join reads written
    tables and deals out both, so a hub can be split by adaptive execution and no table is sent whole. A round's tables are removed when the next is written.
    """
    now = written(edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).where("big <> small").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, old = state, now
        both = now.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(now.select(F.col("small").alias("u"), F.col("big").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.where("v > u").join(dealt(least), "u").select(F.col("v").alias("big"), F.col("m").alias("small")).where("big <> small").distinct())
        lowest = written(large.groupBy("big").agg(F.min("small").alias("m")))
        star = large.join(dealt(lowest), "big").select(F.col("small").alias("big"), F.col("m").alias("small")).unionByName(lowest.select("big", F.col("m").alias("small")))
        now = written(star.where("big <> small").distinct())
        discard(old, least, large, lowest)
    roots = now.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(roots)
