"""Stored tables whose rows can change: only files that hold a touched row are written anew.

A version of a table is a list of its data files, a small parquet table of its own under
`_versions/<number>`; data files lie under `data/commit=<id>/` and are never changed. A change
finds the touched files by `_metadata.file_path`, reads only these, writes their new rows as a
commit and then a version that lists it in their place. A version counts once its job is
committed and its folder can be made only once, so a reader sees the old rows or the new ones,
a change that is cut off leaves the table as it was, and of two changes at once the second
fails and is to be done again. The driver holds file names, as Spark's own file index does.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "commit"
ROWS = 200_000  # of one task, when a large table is made


def _local(uri: str) -> str:
    """A file's place as readers take it: escapes of the URI undone."""
    parts = urlsplit(uri)
    host = f"//{parts.netloc}" if parts.netloc or parts.scheme == "file" else ""
    return f"{parts.scheme}:{host}{unquote(parts.path)}" if parts.scheme else unquote(uri)


class StoredTable:
    """A table under `root`. `by`: partition columns, `schema`: all columns."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no table at {root}")
        self.version = max(numbers)
        listed = spark.read.schema("kind string, value string").parquet(f"{self.root}/_versions/{self.version}")
        rows = listed.agg(F.collect_list(F.struct("kind", "value"))).first()[0]
        self.files = [r.value for r in rows if r.kind == "file"]
        self.by = [r.value for r in rows if r.kind == "by"]
        self.schema = T.StructType.fromJson(json.loads(next(r.value for r in rows if r.kind == "schema")))

    @classmethod
    def create(cls, df: DataFrame, root: str, by: list[str], spread: int = 1, most: int = ROWS) -> StoredTable:
        """Writes `df` as version 0, rows of one partition in `spread` files (by hash of the row). A table of over
        `most` rows is cut into ranges of partition and hash, `spread` for so many rows: no task gets a
        whole partition, however large."""
        table = cls.__new__(cls)
        table.spark, table.root, table.by, table.schema = df.sparkSession, root.rstrip("/"), by, df.schema
        if table._numbers():
            raise FileExistsError(root)
        parts = -(-df.count() * spread // most)
        if parts > spread:
            hashed = [f.name for f in df.schema if not re.search("map<|variant", f.dataType.simpleString())]
            dealt = df.repartitionByRange(parts, *by, F.xxhash64(*hashed))
        else:
            dealt = df.repartition(*by, *([F.pmod(F.xxhash64(*df.columns), F.lit(spread))] if spread > 1 else []))
        table._commit(0, table._write(dealt))
        return cls(df.sparkSession, root)

    def _numbers(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return [int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions/{n}/_SUCCESS"))]

    def _write(self, df: DataFrame) -> list[str]:
        path = f"{self.root}/data/{COMMIT}={uuid.uuid4().hex}"
        df.write.partitionBy(*self.by).parquet(path)
        fields = [f for f in self.schema if f.name not in self.by]
        return [_local(f) for f in self.spark.read.schema(T.StructType(fields)).parquet(path).inputFiles()]

    def _commit(self, version: int, files: list[str]) -> None:
        rows = [("schema", self.schema.json()), *[("by", c) for c in self.by], *[("file", f) for f in files]]
        frame = self.spark.createDataFrame(rows, "kind string, value string")
        frame.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/_versions/{version}")

    def _scan(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema).withColumn("_file", F.lit(""))
        full = T.StructType([*self.schema, T.StructField(COMMIT, T.StringType())])
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*files)
        return rows.select(*self.schema.names, F.col("_metadata.file_path").alias("_file"))

    def read(self) -> DataFrame:
        """The rows of this version; partitions and columns are pruned as in any table."""
        return self._scan(self.files).drop("_file")

    def touched(self, rows: Column | DataFrame, on: list[str] | None = None) -> list[str]:
        """Files with a row that meets the condition `rows`, or has the keys `on` of a row of `rows`."""
        table = self._scan(self.files)
        hit = table.where(rows) if on is None else table.join(rows.select(*on).distinct(), on, "left_semi")
        return sorted(map(_local, hit.agg(F.collect_set("_file")).first()[0]))

    def change(self, rows: Column | DataFrame, change: Callable[[DataFrame], DataFrame], on: list[str] | None = None) -> tuple[StoredTable, list[str]]:
        """(the next version, the files that it replaced): `change` maps the rows of touched files to those that
        take their place, in the same columns; it must leave all other rows as they are."""
        files = self.touched(rows, on)
        if not files:
            return self, []
        gone = set(files)
        new = self._write(change(self._scan(files).drop("_file")).select(*self.schema.names))
        self._commit(self.version + 1, [f for f in self.files if f not in gone] + new)
        return StoredTable(self.spark, self.root), files

    def delete(self, rows: Column | DataFrame, on: list[str] | None = None) -> tuple[StoredTable, list[str]]:
        """change() that takes the rows out. Rows for which a condition is null stay."""
        if on is None:
            return self.change(rows, lambda t: t.where(~F.coalesce(rows, F.lit(False))))
        keys = rows.select(*on).distinct()
        return self.change(rows, lambda t: t.join(keys, on, "left_anti"), on)
