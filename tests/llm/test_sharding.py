import pytest

from engram.llm.shared import shared_dir
from engram.llm.sharding import ShardStore, Taken


def rows(spark, a, b):
    return spark.createDataFrame([(k if k % 7 else None, f"text {k}", "x") for k in range(a, b)], "doc_id long, text string, run string")


def test_appends_merges_and_versions(spark):
    store = ShardStore(spark, shared_dir(spark, "t"), target_bytes=1 << 20, fan_in=3)
    with pytest.raises(ValueError, match="no version"):
        store.read()
    for k in range(9):
        store.append(rows(spark, 10 * k, 10 * k + 10).repartition(2))
        store.compact()
    assert store.read().count() == 90 and len(store.manifest()["runs"]) == 1 and store.manifest()["runs"][0]["files"] == 1
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, rows(spark, 0, 90).collect()), key=str)
    assert store.read(1).count() == 10
    store.vacuum()
    assert store.read().count() == 90 and len(store.versions()) == 1


def test_commits_are_atomic(spark):
    store = ShardStore(spark, shared_dir(spark, "t"))
    old = store.append(rows(spark, 0, 5))
    store.append(rows(spark, 5, 9))
    with pytest.raises(Taken, match="exist"):
        store.commit(old, old["runs"], old["schema"])
    store.append(rows(spark, 0, 0))
    assert store.read().count() == 9


def other(spark, store, **kw):
    return ShardStore(spark, store.path, **kw)


def test_vacuum_spares_a_writer_at_work(spark):
    store = ShardStore(spark, shared_dir(spark, "t"), fan_in=2)
    store.append(rows(spark, 0, 5))
    run = store._write(rows(spark, 5, 9))
    second = other(spark, store, fan_in=2)
    second.append(rows(spark, 9, 12))
    second.compact()
    second.vacuum()
    old = store.manifest()
    store.commit(old, [*old["runs"], run], old["schema"])
    store._settled(run)
    assert store.read().count() == 12 and sum(r["rows"] for r in store.manifest()["runs"]) == 12
    lost = store._write(rows(spark, 20, 30))
    other(spark, store, grace_seconds=-1).vacuum()
    left = {x.getPath().getName() for x in store._names("runs")}
    assert lost["run"][5:] not in left and store.read().count() == 12


def test_a_taken_version_is_retried(spark, monkeypatch):
    store = ShardStore(spark, shared_dir(spark, "t"), fan_in=2)
    write, raced = store._write, []

    def slow(df):
        run = write(df)
        if len(raced) < 2:
            raced.append(other(spark, store).append(rows(spark, 100, 103)))
        return run

    monkeypatch.setattr(store, "_write", slow)
    store.append(rows(spark, 0, 5))
    assert store.manifest()["version"] == 2 and store.read().count() == 8
    store.compact()
    assert store.read().count() == 11 and sum(r["rows"] for r in store.manifest()["runs"]) == 11
    monkeypatch.setattr(store, "_write", lambda df: (write(df), other(spark, store, fan_in=2).compact())[0])
    store.append(rows(spark, 5, 6))
    store.compact()
    assert store.read().count() == 12 and not store._names("intents")


def test_appends_with_other_columns(spark):
    store = ShardStore(spark, shared_dir(spark, "t"), fan_in=4)
    make = lambda data, kind: store.append(spark.createDataFrame(data, kind))
    make([(1, "a")], "id long, t string")
    make([(2,)], "ID long")
    make([("c", 3, 0.5)], "t string, id long, more double")
    want = [(1, "a", None), (2, None, None), (3, "c", 0.5)]
    assert store.read().columns == ["id", "t", "more"] and sorted(map(tuple, store.read().collect())) == want
    with pytest.raises(ValueError, match="column t is string"):
        make([(4, 5)], "id long, t long")
    make([(6, "f")], "id long, t string")
    store.compact()
    assert len(store.manifest()["runs"]) == 1 and sorted(map(tuple, store.read().collect())) == [*want, (6, "f", None)]
    assert store.read(1).columns == ["id", "t"] and not store._names("intents")
