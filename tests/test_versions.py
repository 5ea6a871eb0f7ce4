"""Updates that commit whole or not at all, and first runs."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators.memory import FileStore
from tidelog.sources import versions, writers

SCHEMA = "k bigint, e string, t timestamp, n double"


def table(spark, path, **options):
    return versions.VersionedTable(spark, f"{path}/t", SCHEMA, ["k"], **options)


def rows(spark, *given):
    return spark.createDataFrame(list(given), "k bigint, e string, n double")


def held(t, version=None):
    return sorted(((r.k, r.e, r.n) for r in t.read(version).collect()), key=str)


def test_versions_from_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == 0 and held(t) == [] and t.upsert(rows(spark)) == 0 and t.version() == 0
    assert t.upsert(rows(spark, (1, "a", 1.0), (2, "b", None), (None, "c", 3.0))) == 1
    # The same again, in another order and with a column more, is no change.
    assert t.upsert(rows(spark, (None, "c", 3.0), (1, "a", 1.0)).withColumn("more", F.lit(1))) == 1
    assert t.upsert(rows(spark, (2, "b", 5.0), (7, "d", 0.0))) == 2
    assert held(t, 1) == sorted([(1, "a", 1.0), (2, "b", None), (None, "c", 3.0)], key=str)
    assert held(t) == sorted([(1, "a", 1.0), (2, "b", 5.0), (None, "c", 3.0), (7, "d", 0.0)], key=str)
    assert t.delete(spark.createDataFrame([(None,), (99,)], "k bigint")) == 3 and (None, "c", 3.0) not in held(t)
    assert t.delete(spark.createDataFrame([(99,)], "k bigint")) == 3


def test_null_and_value_change_places(spark, tmp_path):
    t = versions.VersionedTable(spark, f"{tmp_path}/t", "k int, a string, b string", ["k"])
    t.upsert(spark.createDataFrame([(1, None, "x")], "k int, a string, b string"))
    assert t.upsert(spark.createDataFrame([(1, "x", None)], "k int, a string, b string")) == 2
    assert [tuple(r) for r in t.read().collect()] == [(1, "x", None)]


def test_repeated_keys_of_an_update(spark, tmp_path):
    t = table(spark, tmp_path)
    for turn in range(2):
        assert t.upsert(rows(spark, (1, "b", 0.0), (1, "a", 9.0), (1, "b", 2.0)).repartition(turn + 1)) == 1
    assert held(t) == [(1, "b", 2.0)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, buckets=32)
    t.upsert(spark.range(500).select(F.col("id").alias("k"), F.lit("e").alias("e")))
    before = t.manifest()["folders"]
    t.upsert(rows(spark, (3, "x", 1.0)))
    after = t.manifest()["folders"]
    assert len([b for b in after if after[b] != before[b]]) == 1 and t.read().count() == 500


def test_entities_lie_in_order(spark, tmp_path):
    t = table(spark, tmp_path, by=["e"], buckets=3)
    t.upsert(rows(spark, *[(i * 7 % 50, f"e{i % 4}", 0.0) for i in range(50)]))
    t.upsert(rows(spark, (14, "moved", 1.0), (60, "e1", 0.0)))
    assert sorted(r.k for r in t.read().collect()) == [*range(50), 60] and [r.e for r in t.read().where("k = 14").collect()] == ["moved"]
    found = {}
    for r in t.read().select("e", "k", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect():
        found.setdefault((r.e, r.f), []).append((r.i, r.k))
    assert len({f for _, f in found}) <= 3 and len(found) == 5
    assert all([k for _, k in sorted(v)] == sorted(k for _, k in v) for v in found.values())


def test_a_writer_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", 1.0)))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(t.folder, "publish", dies)
        with pytest.raises(OSError):
            t.upsert(rows(spark, (1, "a", 2.0)))
    assert t.version() == 1 and held(t) == [(1, "a", 1.0)]
    assert t.upsert(rows(spark, (1, "a", 3.0))) == 2 and held(t) == [(1, "a", 3.0)]
    assert len(t.clean()) == 2 and held(t) == [(1, "a", 3.0)] and t.clean() == []


def test_of_two_writers_the_later_fails(spark, tmp_path, monkeypatch):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.upsert(rows(spark, (1, "a", 1.0)))
    old = b.manifest()
    a.upsert(rows(spark, (1, "a", 2.0)))
    monkeypatch.setattr(b, "manifest", lambda version=None: old)
    with pytest.raises(versions.Conflict):
        b.upsert(rows(spark, (1, "a", 9.0)))
    assert held(a) == [(1, "a", 2.0)]


def test_append_new_and_first_runs(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.append_new(rows(spark, (1, "a", 1.0))) == 1 and t.append_new(rows(spark, (1, "b", 2.0), (2, "b", 2.0))) == 1 and t.append_new(rows(spark, (2, "c", 0.0))) == 0
    assert held(t) == [(1, "a", 1.0), (2, "b", 2.0)]
    done = spark.createDataFrame([(1, "x")], "k int, v string")
    assert [writers.resume(done, f"{tmp_path}/run", ["k"]) for _ in range(2)] == [1, 0]
    writers.upsert_files(done, f"{tmp_path}/none", "k", f"{tmp_path}/into")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/into").collect()] == [(1, "x")]
    store = FileStore(spark, f"{tmp_path}/facts", "text string")
    assert store.items().collect() == []
    store.store(spark.createDataFrame([(" a  b ",)], "text string"))
    assert store.flush() == 1 and [r.text for r in store.items().collect()] == ["a b"]


@pytest.mark.parametrize("mode", ["update", "complete", "append"])
def test_streams_of_several_batches(spark, tmp_path, mode):
    """Three files, one a trigger, and a rerun: every row once, as one batch would give."""
    from tidelog.streaming import streams

    schema = "user_id bigint, ts timestamp, event_type string"
    given = [(u, f"2024-01-01 0{h}:{m:02d}:00", "ab"[u % 2]) for h in range(3) for m in range(0, 60, 10) for u in range(4)]
    df = spark.createDataFrame(given, "user_id bigint, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    for part in (0, 2, 1):  # hours come out of order
        df.where(F.hour("ts") == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = streams.read(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    if mode == "append":
        stream, put, want = streams.first_seen(source, "ts", ["user_id"], "1 day"), streams.batches(f"{tmp_path}/out"), 4
    else:
        stream = streams.windowed(source, "ts", ["event_type"], "1 hour", late="1 day")
        put, want = (streams.whole(f"{tmp_path}/out"), 6) if mode == "complete" else (streams.latest(f"{tmp_path}/out", stream.schema, ["event_type", "start"]), 6)
    for _ in range(2):
        streams.into(stream, put, f"{tmp_path}/checkpoint", mode)
    out = versions.VersionedTable(spark, f"{tmp_path}/out", stream.schema, ["event_type", "start"]).read() if mode == "update" else spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    got = out.collect()
    assert len(got) == want and (mode == "append" or {r.n for r in got} == {12})
