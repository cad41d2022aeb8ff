"""Row changes of stored tables: touched files only, versions, failures half way."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from footfall.sources.versions import StoredTable


def frame(spark, n=40):
    return spark.range(n).select("id", (F.col("id") % 4).cast("int").alias("site"), F.concat(F.lit("v "), F.col("id") % 10).alias("who"),
                                 F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"), F.concat(F.lit("a:/%20 "), F.col("id") % 2).alias("odd"))


def bytes_of(root):
    return {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root).rglob("*.parquet") if "_versions" not in str(p)}


def rows(df):
    return sorted(map(tuple, df.select("id", "site", "who", "n", "odd").collect()))


def test_only_touched_files_are_written(spark, tmp_path):
    root = str(tmp_path / "my table")
    df = frame(spark)
    table = StoredTable.create(df, root, ["site", "odd"])
    assert table.version == 0 and len(table.files) == 4 and rows(table.read()) == rows(df) and table.read().schema["site"].dataType == df.schema["site"].dataType
    before = bytes_of(root)
    new, files = table.delete(F.col("id").isin(1, 5))  # both in the partition of site 1
    assert len(files) == 1 and new.version == 1 and rows(new.read()) == rows(df.where("id NOT IN (1, 5)"))
    after = bytes_of(root)
    assert {p: h for p, h in after.items() if p in before} == before and len(after) == len(before) + 1
    assert set(new.files) & set(table.files) == set(table.files) - set(files)
    assert rows(table.read()) == rows(df)  # an earlier version still reads as it was


def test_keys_updates_and_nothing_to_do(spark, tmp_path):
    root = str(tmp_path / "t")
    df = frame(spark)
    table = StoredTable.create(df, root, ["site"], spread=3)
    keys = spark.createDataFrame([("v 3", 1), ("v 3", 1), (None, 2)], "who string, other int")
    cut, files = table.delete(keys, ["who"])
    assert rows(cut.read()) == rows(df.where("who <> 'v 3'")) and 0 < len(files) < len(table.files)
    moved, _ = cut.change(F.col("n") > 35, lambda t: t.withColumn("site", F.when(F.col("n") > 35, 9).otherwise(F.col("site"))))
    want = df.where("who <> 'v 3'").withColumn("site", F.when(F.col("n") > 35, 9).otherwise(F.col("site")))
    assert rows(moved.read()) == rows(want) and moved.read().where("site = 9").count() == want.where("site = 9").count() > 0
    same, none = moved.delete(F.col("n") > 10**6)
    assert none == [] and same.version == moved.version == 2
    empty, _ = moved.delete(F.lit(True))
    assert empty.read().count() == 0 and rows(StoredTable(spark, root).read()) == []


def test_of_two_changes_one_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    one, two = StoredTable.create(frame(spark), root, ["site"]), StoredTable(spark, root)
    one.delete(F.col("id") == 1)
    with pytest.raises(Exception, match="(?i)already exists"):
        two.delete(F.col("id") == 2)
    assert rows(StoredTable(spark, root).read()) == rows(frame(spark).where("id <> 1"))
    with pytest.raises(FileExistsError):
        StoredTable.create(frame(spark), root, ["site"])
    with pytest.raises(FileNotFoundError):
        StoredTable(spark, str(tmp_path / "none"))
    (tmp_path / "t" / "_versions" / "7").mkdir()  # a version whose job was cut off does not count
    assert StoredTable(spark, root).version == 1


def test_a_large_partition_is_many_tasks(spark, tmp_path):
    df = frame(spark, 3000).withColumn("site", F.lit(1)).unionByName(frame(spark, 40).withColumn("site", F.lit(None).cast("int")))
    table = StoredTable.create(df, str(tmp_path / "t"), ["site"], most=100)
    assert sorted(map(repr, table.read().collect())) == sorted(map(repr, df.collect()))
    per = [r.n for r in table.read().groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(per) >= 25 and max(per) <= 300 and sum(per) == 3040
    cut, files = table.delete(F.col("id") == 2999)
    assert len(files) == 1 and sorted(map(repr, cut.read().collect())) == sorted(map(repr, df.where("id <> 2999").collect()))
