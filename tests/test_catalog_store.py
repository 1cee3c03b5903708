import pytest

from quarry.operators.catalog_store import CatalogStore

BASES, CHUNKS = "id string, name string", "id string, knowledge_base_id string, content string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_of_both_tables_count_at_once(spark, tmp_path, monkeypatch):
    make = spark.createDataFrame
    store = CatalogStore(spark, str(tmp_path / "c"), buckets=4)
    store.changed(make([(f"k{i}", f"n{i}") for i in range(9)], BASES), make([(f"c{i}{j}", f"k{i}", "old") for i in range(9) for j in range(2)] + [("lost", "none", "x")], CHUNKS), change="first")
    first = rows(store.bases()), rows(store.chunks())
    assert len(first[0]) == 9 and len(first[1]) == 18
    new = make([("k3", "again")], BASES), make([("d", "k3", "new")], CHUNKS)
    with monkeypatch.context() as m:  # killed when the chunks are written and the bases aren't
        write = store.spark.createDataFrame([], BASES).write.__class__.parquet
        m.setattr(store.spark.createDataFrame([], BASES).write.__class__, "parquet", lambda self, path, **k: (_ for _ in ()).throw(RuntimeError("killed")) if "/bases/" in path else write(self, path, **k))
        with pytest.raises(RuntimeError, match="killed"):
            store.changed(*new, change="again")
    assert (rows(store.bases()), rows(store.chunks())) == first
    store.changed(*new, change="again").changed(make([("k3", "thrice")], BASES), make([("e", "k3", "newer")], CHUNKS), change="again")
    assert rows(store.chunks().where("knowledge_base_id = 'k3'")) == [("d", "k3", "new")] and ("k3", "again") in rows(store.bases()) and store.chunks().count() == 17
    store.changed(deleted=make([("k1",), ("k2",), ("absent",)], "id string"))
    assert {r[0] for r in rows(store.bases())} == {f"k{i}" for i in (0, 3, 4, 5, 6, 7, 8)} and {r[1] for r in rows(store.chunks())} == {f"k{i}" for i in (0, 3, 4, 5, 6, 7, 8)}
    store.changed(deleted=store.bases().select("id"))
    assert store.bases().count() == 0 == store.chunks().count()
    store.changed(make([(None, "nameless"), ("k", "n")], BASES), make([("x", None, "of none"), ("y", "k", "of k")], CHUNKS))
    store.changed(make([(None, "nameless two")], BASES), make([], CHUNKS))
    assert rows(store.bases().select("name")) == [("n",), ("nameless two",)] and rows(store.chunks().select("id")) == [("y",)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    make = spark.createDataFrame
    store = CatalogStore(spark, str(tmp_path / "c"), buckets=8)
    store.changed(make([(f"k{i}", "n") for i in range(40)], BASES), make([(f"c{i}", f"k{i}", "x") for i in range(40)], CHUNKS))
    before = store._parts()
    store.changed(make([("k1", "m")], BASES), make([("z", "k1", "y")], CHUNKS))
    assert sum(before[b] != f for b, f in store._parts().items()) == 1 and store.bases().count() == 40 and store.chunks().count() == 40
    with pytest.raises(ValueError, match="no bases"):
        CatalogStore(spark, str(tmp_path / "other")).bases()
