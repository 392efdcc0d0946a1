"""The class tree source: whole writes, replaced folders, failed writes, listing by extension."""

import pytest
from pyspark.sql import functions as F

from tesserae.sources import tree


def put(spark, root, rows, mode="overwrite"):
    frame = spark.createDataFrame(rows, "split string, class string, filename string, content binary").repartition(3)
    frame.write.format("classtree").mode(mode).option("path", root).save()


def listed(spark, root, **options):
    return {(r.path, r.length) for r in spark.read.format("classtree").options(path=root, **options).load().drop("content").collect()}


def test_write_replace_fail_and_list(spark, tmp_path):
    spark.dataSource.register(tree.ClassTree)
    root = f"file://{tmp_path}/t"
    assert listed(spark, root) == set()
    put(spark, root, [("train", "a", f"{i}.txt", b"x" * i) for i in range(6)] + [("train", "b", "one.JPG", b"abc"), ("test", "a", "n.bin", None)])
    assert listed(spark, root) == {(f"train/a/{i}.txt", i) for i in range(6)} | {("train/b/one.JPG", 3), ("test/a/n.bin", 0)}
    assert listed(spark, root, extensions=".jpg,.md") == {("train/b/one.JPG", 3)}
    put(spark, root, [("train", "b", "two.jpg", b"abcd")])  # that folder alone is replaced
    assert listed(spark, root, extensions="jpg") == {("train/b/two.jpg", 4)} and len(listed(spark, root)) == 8
    before = listed(spark, root)
    for bad in ("..", "a/b", ""):
        with pytest.raises(Exception):
            put(spark, root, [("train", "c", f"{i}.txt", b"y") for i in range(20)] + [("train", "c", bad, b"z")])
    with pytest.raises(Exception):
        put(spark, root, [("train", "b", "three.jpg", b"")], mode="append")  # the folder exists
    assert listed(spark, root) == before  # a failed write is never seen
    row = spark.read.format("classtree").option("path", root).load().where(F.col("class") == "b").first()
    assert bytes(row.content) == b"abcd" and row.split == "train" and row.filename == "two.jpg"
