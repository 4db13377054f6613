"""A sink of micro-batches as one table: versions are lists of folders, small folders are put together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import remove


class BatchLog:
    """Folders of Parquet files under `path`, and numbered versions, each a file that lists the folders it consists of.

    Readers follow the last version; a version is made by renaming a file that is complete, so one exists as a whole or
    not at all. A batch or a compaction writes new folders first and its version last. A batch that is tried again after its version
    is there is skipped; before that, its folder is of no version and is removed by a later compaction.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, most: int = 16, target: int = 128 << 20):
        """most: folders below `target` bytes that a version has before they are put together."""
        self.spark, self.path, self.schema, self.most, self.target = spark, path, schema, most, target
        self._seen = {"number": 0, "batch": -1, "folders": []}

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place, fs = self._place(folder)
        return [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []

    def version(self) -> dict:
        """number, last batch and folders of the last version.

        Versions are made one after the other, so those after the last one seen are looked for, and the folder is listed only at first.
        """
        number = self._seen["number"] or max((int(x) for x in self._names("versions") if x.isdigit()), default=0)
        while self._exists(f"versions/{number + 1}"):
            number += 1
        if number > self._seen["number"]:
            self._seen = json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/versions/{number}").first()[0])
        return self._seen

    def _exists(self, name: str) -> bool:
        place, fs = self._place(name)
        return fs.exists(place)

    def _commit(self, last: dict, **new) -> None:
        made = last | new | {"number": last["number"] + 1}
        draft, fs = self._place(f"versions/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if not fs.rename(draft, self._place(f"versions/{made['number']}")[0]):
            raise RuntimeError("another writer made this version")
        self._seen = made

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def add(self, rows: DataFrame, batch: int) -> None:
        """Puts in the rows of a batch, once; then compacts if there are many small folders."""
        last = self.version()
        if batch > last["batch"]:
            self._commit(last, batch=batch, folders=[*last["folders"], self._write(rows)])
            self.compact()

    def _size(self, name: str) -> int:
        place, fs = self._place(f"data/{name}")
        return fs.getContentSummary(place).getLength()

    def compact(self) -> None:
        """Puts the folders below the target size together, into files of about that size, and removes what the last two versions do not name."""
        last = self.version()
        if len(last["folders"]) <= self.most:
            return
        sizes = {f: self._size(f) for f in last["folders"]}
        few = [f for f, n in sizes.items() if n < self.target]
        if len(few) <= self.most:
            return
        files = max(1, round(sum(sizes[f] for f in few) / self.target))
        name = self._write(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in few]).coalesce(files))
        self._commit(last, folders=[*(f for f in last["folders"] if f not in few), name])
        for f in set(self._names("data")) - set(last["folders"]) - {name}:
            remove(self.spark, f"{self.path}/data/{f}")

    def read(self, version: dict | None = None) -> DataFrame:
        """The rows of a version, the last if none is named. The two last ones have all their files."""
        folders = (version or self.version())["folders"]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)
