"""The versioned keyed store: what a merge changes, repeats, crashes and readers."""

import pytest

from civicforms.sources import keyed_store
from civicforms.sources.keyed_store import BUCKET, KeyedStore

SHAPE = "id string, county string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def store_at(spark, path, buckets=8):
    return KeyedStore(spark, f"{path}/store", "id", SHAPE, buckets)


def test_merge_overlays_and_rewrites_only_what_it_touches(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert store.read().collect() == []
    store.merge(spark.createDataFrame([(f"t{k}", None, k) for k in range(50)], SHAPE))
    first = store.manifest()
    assert set(first["versions"]) <= set(map(str, range(8))) and set(first["versions"].values()) == {0}
    store.merge(spark.createDataFrame([("t3", "Cluj"), ("new", "Iași"), (None, "Arad"), ("t4", None)], "id string, county string"))
    want = {f"t{k}": (None, k) for k in range(50)} | {"t3": ("Cluj", 3), "new": ("Iași", None)}
    assert rows(store.read().select("id", "county", "n")) == sorted((k, *v) for k, v in want.items())
    second = store.manifest()
    assert 0 < sum(v == 1 for v in second["versions"].values()) <= 3
    assert rows(store.lookup("t3")) == [("t3", "Cluj", 3)]
    assert store.lookup("none").collect() == []
    # The number of buckets stays that of the first merge.
    assert store_at(spark, tmp_path, 3).buckets == 8


def test_last_patch_of_a_key_counts_for_each_column(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.merge(spark.createDataFrame([("a", "x", 1, 1), ("a", "y", None, 2), ("a", None, 3, 0)], f"{SHAPE}, at int"), order="at")
    assert rows(store.read()) == [("a", "y", 1)]


def test_a_merge_that_stopped_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path)
    store.merge(spark.createDataFrame([("a", "x", 1)], SHAPE), 0)
    before = store.read()

    def fail(self, manifest):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(keyed_store.KeyedStore, "_publish", fail)
        with pytest.raises(RuntimeError, match="stopped"):
            store.merge(spark.createDataFrame([("a", "half", 9), ("b", "half", 9)], SHAPE), 1)
    assert rows(store.read()) == rows(before) == [("a", "x", 1)]
    # The same merge again, as a stream does after a restart; and once more, which does nothing.
    assert store.merge(spark.createDataFrame([("a", "y", None), ("b", "z", 2)], SHAPE), 1)
    assert not store.merge(spark.createDataFrame([("a", "again", None)], SHAPE), 1)
    assert rows(store.read()) == [("a", "y", 1), ("b", "z", 2)]
    assert rows(before) == [("a", "x", 1)]  # a reader from before still reads its version


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.merge(spark.createDataFrame([("a", "x", 1)], SHAPE))
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(store.manifest())


def test_stream_of_patches(spark, tmp_path):
    store, incoming = store_at(spark, tmp_path), f"{tmp_path}/in"
    for batch in ([("a", "x", 1), ("b", "y", 2)], [("a", None, 5), ("c", "z", None)]):
        spark.createDataFrame(batch, SHAPE).coalesce(1).write.mode("append").parquet(incoming)
        store.follow(spark.readStream.schema(SHAPE).parquet(incoming), f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(store.read().na.fill(-1)) == [("a", "x", 5), ("b", "y", 2), ("c", "z", -1)]
    assert store.manifest()["merged"] == {f"{tmp_path}/checkpoint": 1}


def test_clean_keeps_what_is_read(spark, tmp_path):
    store = store_at(spark, tmp_path, 2)
    for k in range(5):
        store.merge(spark.createDataFrame([("a", "x", k), (f"k{k}", "y", k)], SHAPE))
    want = rows(store.read())
    store.clean(keep=1)
    assert rows(store.read()) == want and len(want) == 6
    left = {(p.parent.name, p.name) for p in (tmp_path / "store" / "data").glob(f"*/{BUCKET}=*")}
    assert left == {(f"version={v}", f"{BUCKET}={b}") for b, v in store.manifest()["versions"].items()}
