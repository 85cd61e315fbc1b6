"""Changes of stored tables: what is rewritten, what a failed change leaves, and two at once."""

import pytest
from pyspark.sql import functions as F

from harborlight.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store")
    change = s.change()
    change.create("people", spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(60)], "id long, name string, grp int"), "id", buckets=8)
    change.create("visits", spark.createDataFrame([(i % 60, i, "open") for i in range(200)], "id long, visit long, status string"), "id", "visit", buckets=4)
    change.commit()
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_touches_only_its_buckets(spark, store):
    before = store.state()["people"]["folders"]
    change = store.change()
    change.upsert("people", spark.createDataFrame([(7, "seven", 9), (1000, "new", 9)], "id long, name string, grp int"))
    change.commit()
    after = store.state()["people"]["folders"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    got = {r.id: r.name for r in store.read("people").collect()}
    assert len(got) == 61 and got[7] == "seven" and got[1000] == "new" and got[8] == "n8"
    assert store.state()["visits"] == store.state(1)["visits"]


def test_update_and_delete_with_nulls(spark, store):
    change = store.change()
    change.update("people", F.col("grp") == 1, name=F.lit(None), grp=F.col("grp") + 10)
    assert change.delete("people", F.col("name") == "n0") == 1 and change.delete("people", F.col("id") == -5) == 0
    assert change.delete("visits", F.col("id") < 60) == 200
    change.commit()
    people = store.read("people").collect()
    assert len(people) == 59 and all((r.name is None) == (r.grp == 11) for r in people)
    assert rows(store.read("visits")) == [] and store.read("visits").columns == ["id", "visit", "status"]


def test_a_change_that_dies_leaves_the_old_rows(spark, store, monkeypatch):
    people, visits = rows(store.read("people")), rows(store.read("visits"))
    change = store.change()
    change.delete("people", F.col("id") < 30)
    change.update("visits", F.col("id") < 30, status=F.lit("gone"))
    monkeypatch.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(OSError("power cut")))
    with pytest.raises(OSError):
        change.commit()
    again = Store(spark, store.path)
    assert again.version() == 1 and rows(again.read("people")) == people and rows(again.read("visits")) == visits
    change = again.change()  # both tables change together, or neither
    change.delete("people", F.col("id") < 30)
    change.update("visits", F.col("id") < 30, status=F.lit("gone"))
    change.commit()
    assert again.read("people").count() == 30
    assert all((r.status == "gone") == (r.id < 30) for r in again.read("visits").collect())


def test_of_two_changes_at_once_the_second_fails(spark, store):
    one, two = store.change(), store.change()
    one.delete("people", F.col("id") == 1)
    two.delete("people", F.col("id") == 2)
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()
    assert store.read("people").count() == 59


def test_vacuum_keeps_the_last_version(spark, store):
    change = store.change()
    change.delete("people", F.col("grp") == 0)
    change.commit()
    left = rows(store.read("people"))
    store.vacuum()
    assert rows(Store(spark, store.path).read("people")) == left and store.version() == 2


def test_empty_store_and_tables(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/none")
    assert store.version() == 0 and store.state() == {}
    change = store.change()
    change.create("t", spark.createDataFrame([], "a string, b int"), "a")
    change.upsert("t", spark.createDataFrame([(None, 1), ("x", 2)], "a string, b int"))
    change.commit()
    assert rows(store.read("t")) == [("x", 2), (None, 1)]
