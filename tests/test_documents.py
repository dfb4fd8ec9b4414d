"""The store of documents on disk: replaced, deleted, cleared, read at a commit; failures and two writers."""

import os

import pytest
from oracle import same

from sparkqa.queries import tables
from sparkqa.sources import documents
from sparkqa.sources.documents import DocumentStore, WriteConflict


def rows(spark, version, docs, n=20):
    return spark.createDataFrame([(f"doc {d}", i, version) for d in docs for i in range(n)], "__document_id string, i int, version int").repartition(3)


def told(frame):
    out = {}
    for r in frame.collect() if frame is not None else []:
        out.setdefault(r["__document_id"], set()).add((r.i, r.version))
    return {d: (len(v), {x for _, x in v}) for d, v in out.items()}


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/data") for f in names}


def test_replace_two_of_seven(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    assert store.read() is None and store.documents().count() == 0
    assert store.put(rows(spark, 1, range(7))) == 1
    before = files(store.root)
    old = store.read()
    assert store.put(rows(spark, 2, [0, 5], 3)) == 2
    assert told(store.read()) == {f"doc {d}": (3, {2}) if d in (0, 5) else (20, {1}) for d in range(7)}
    assert {p: files(store.root)[p] for p in before} == before  # untouched
    assert told(old) == told(store.read(1)) == {f"doc {d}": (20, {1}) for d in range(7)}  # a reader keeps what it began with
    assert {r["__document_id"]: r.rows for r in store.documents().collect()}["doc 5"] == 3


@pytest.mark.parametrize("at", ["_write", "_counted", "_commit"])
def test_failed_write_changes_nothing(spark, tmp_path, monkeypatch, at):
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.put(rows(spark, 1, range(3)))
    want = told(store.read())
    real = getattr(DocumentStore, at)

    def fails(self, *args):
        if at == "_write":
            real(self, *args)  # all is written, the writer dies
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(DocumentStore, at, fails)
        with pytest.raises(OSError, match="lost"):
            store.put(rows(spark, 9, range(2)))
    assert told(store.read()) == want and store.commits() == [1]
    store.put(rows(spark, 2, [1], 1))
    assert told(store.read())["doc 1"] == (1, {2})
    assert store.vacuum() == 1 and told(store.read())["doc 0"] == (20, {1})  # what the failed write left


def test_two_writers(spark, tmp_path, monkeypatch):
    store, other = (DocumentStore(spark, str(tmp_path / "store")) for _ in range(2))
    store.put(rows(spark, 1, range(3)))
    counted = DocumentStore._counted

    def meanwhile(self, version):
        monkeypatch.setattr(DocumentStore, "_counted", counted)
        other.put(rows(spark, 2, [0], 2))
        return counted(self, version)

    monkeypatch.setattr(DocumentStore, "_counted", meanwhile)
    with pytest.raises(WriteConflict):
        store.put(rows(spark, 3, [0, 1], 5))
    assert told(store.read()) == {"doc 0": (2, {2}), "doc 1": (20, {1}), "doc 2": (20, {1})}
    store.put(rows(spark, 3, [0, 1], 5))
    assert told(store.read())["doc 1"] == (5, {3})


def test_delete_and_clear(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    assert store.clear().count() == 0 and store.commits() == []
    store.put(rows(spark, 1, range(4)))
    assert sorted(map(tuple, store.delete(["doc 2", "nothing"]).collect())) == [("doc 2", 20)]
    assert set(told(store.read())) == {"doc 0", "doc 1", "doc 3"}
    assert sorted(map(tuple, store.clear().collect())) == [("doc 0", 20), ("doc 1", 20), ("doc 3", 20)]
    assert store.read() is None and store.clear().count() == 0
    store.put(rows(spark, 5, [2], 1))  # goes on as before
    assert told(store.read()) == {"doc 2": (1, {5})}


def test_compact_and_vacuum(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.put(rows(spark, 1, range(4)))
    for v, d in ((2, 0), (3, 1), (4, 2)):
        store.put(rows(spark, v, [d]))
    want = told(store.read())
    assert store.compact(0.9) is None
    assert store.compact() == 5 and told(store.read()) == want
    assert store.vacuum() == 1 and told(store.read()) == want and len(store.commits()) == 1
    assert len(store._names("data")) == 4 and len(store._names("manifest")) == 1


def test_columns_change_and_rows_without_document(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.put(rows(spark, 1, [0], 1))
    store.put(spark.createDataFrame([("doc 1", "x")], "__document_id string, other string"))
    assert {(r["__document_id"], r.i, r.other) for r in store.read().collect()} == {("doc 0", 0, None), ("doc 1", None, "x")}
    with pytest.raises(ValueError, match="without"):
        store.put(spark.createDataFrame([(None, 1)], "__document_id string, i int"))
    assert len(store.commits()) == 2 and documents.MANIFEST


@pytest.mark.parametrize("name", ["a5_store_replace", "a6_store_clear"])
def test_queries_against_sql(spark, name):
    same(tables.QUERIES[name](spark, "/root/testdata/sf0.001"), tables.SQL[name], "/root/testdata/sf0.001")
