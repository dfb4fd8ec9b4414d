"""Directories of unlike files, and numbers in file order."""

import gzip
import os
import random

import pytest
from oracle import same

from sparkqa.queries import tables
from sparkqa.sources import catalog as C
from sparkqa.sources.directory import read_directory


def put(folder, **files):
    for name, text in files.items():
        data = text if isinstance(text, bytes) else text.encode()
        (folder / name.replace("__", ".")).write_bytes(data)


@pytest.fixture
def folder(tmp_path):
    put(
        tmp_path, a__csv="name,qty\nx,1\ny,2\n", b__csv="qty,name\n3,z\n4.5,w\n", c__csv="name,qty\nu,7\n\nv,eight\n", d__csv="name,qty,name\np,1,q\n", e__csv="name,qty\nonly one\nok,9\na,b,c\n",
        empty__csv="", blank__csv="\n \n", head__csv="name,qty\n", nohead__csv=" , \n1,2\n", readme__txt="hello", broken__csv__gz=b"\x1f\x8b\x08\x00garbage", cut__csv__gz=gzip.compress(os.urandom(4000))[:2000],
        good__csv__gz=gzip.compress(b"name,qty\ng,5\n") + gzip.compress(b"h,6\n"),
    )
    return str(tmp_path)


def test_unlike_files(spark, folder):
    """Files of another header order keep their rows, and no bad file stops the rest."""
    found = read_directory(spark, folder)
    reasons = {r.file: r.reason for r in found.files.collect()}
    assert {f for f, r in reasons.items() if r is None} == {"a.csv", "b.csv", "c.csv", "d.csv", "e.csv", "good.csv.gz"}
    assert {f: r for f, r in reasons.items() if r and not r.startswith("unreadable")} == {"empty.csv": "empty", "blank.csv": "empty", "head.csv": "no rows", "nohead.csv": "no header", "readme.txt": "extension"}
    assert reasons["broken.csv.gz"].startswith("unreadable") and reasons["cut.csv.gz"] == "unreadable: truncated"
    by_columns = {tuple(c for c in t.columns if not c.startswith("__")): t for t in found.tables}
    assert set(by_columns) == {("name", "qty"), ("qty", "name"), ("name", "qty", "name_2")}
    told = lambda t, *c: sorted(map(tuple, t.select("__source_file", "__row_number", *c).collect()))
    assert told(by_columns["qty", "name"], "name", "qty") == [("b.csv", 1, "z", "3"), ("b.csv", 2, "w", "4.5")]
    assert told(by_columns["name", "qty"], "name", "qty") == [("a.csv", 1, "x", "1"), ("a.csv", 2, "y", "2"), ("c.csv", 1, "u", "7"), ("c.csv", 2, "v", "eight"), ("e.csv", 2, "ok", "9"), ("good.csv.gz", 1, "g", "5"), ("good.csv.gz", 2, "h", "6")]
    assert by_columns["name", "qty"].count() == 7 and by_columns["name", "qty"].select("__table_id").distinct().count() == 4
    assert sorted(map(tuple, found.refused.select("file", "row", "line").collect())) == [("e.csv", 1, "only one"), ("e.csv", 3, "a,b,c")]


def test_types_are_each_files_own(spark, folder):
    found = read_directory(spark, folder)
    kinds = {(r.file, r["column"]): r.type for r in found.types().collect()}
    assert kinds["a.csv", "qty"] == "bigint" and kinds["b.csv", "qty"] == "double" and kinds["c.csv", "qty"] == "string" and kinds["a.csv", "name"] == "string"
    loaded = found.load("b.csv")
    assert dict(loaded.dtypes)["qty"] == "double" and sorted(r.qty for r in loaded.collect()) == [3.0, 4.5]
    assert dict(found.load("a.csv").dtypes)["qty"] == "bigint" and found.load("a.csv").first()["__table_id"] == "uploaded_a_csv"
    with pytest.raises(ValueError, match="no such table"):
        found.load("empty.csv")


def test_directory_without_tables(spark, tmp_path):
    put(tmp_path, readme__txt="x")
    found = read_directory(spark, str(tmp_path))
    assert found.tables == [] and found.refused.count() == 0 and [r.reason for r in found.files.collect()] == ["extension"]


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_numbers_follow_the_files(spark, tmp_path, form):
    """Unlike sizes, so that Spark packs larger files first; small splits, so that files fall into several."""
    rng, n, path = random.Random(1), 0, str(tmp_path / "files")
    for i in range(6):
        size = rng.choice([3, 47, 2000, 700])
        spark.range(n, n + size, 1, 1).selectExpr("id", "repeat('x', 50) AS pad").write.mode("append").option("header", True).format(form).save(f"{path}/{i}")
        n += size
    for split in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            rows = spark.read.option("recursiveFileLookup", True).option("header", True).schema("id long, pad string").format(form).load(path)
            got = C.with_lineage(rows, "a.csv")
            assert [(r.id + 1, r["__row_number"]) for r in got.orderBy("id").select("id", "__row_number").collect()] == [(i, i) for i in range(1, n + 1)]
            odd = C.with_lineage(rows.where("id % 2 = 1"), "a.csv")  # numbers of what is left
            assert [r["__row_number"] for r in odd.orderBy("id").collect()] == list(range(1, n // 2 + 1))
            assert sorted(r["__row_number"] for r in got.where("__row_number between 40 and 60").collect()) == list(range(40, 61))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["a3_unlike_files", "b3_file_order"])
def test_queries_against_sql(spark, name):
    same(tables.QUERIES[name](spark, "/root/testdata/sf0.01"), tables.SQL[name], "/root/testdata/sf0.01")
