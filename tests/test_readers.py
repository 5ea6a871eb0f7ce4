"""Line numbers of files that several tasks read, and first files."""

import json

import pytest

from tidelog.plans import catalog, registry
from tidelog.sources import readers, writers


@pytest.mark.parametrize("block", [200, 10_000_000])
def test_line_numbers_over_blocks(spark, tmp_path, block):
    want = {}
    for name, n in (("a", 300), ("b", 1), ("c", 57), ("empty", 0)):
        lines = ["" if i % 10 == 3 else "  " if i % 10 == 4 else f"{{bad {name} {i}" if i % 13 == 5 else json.dumps({"x": i, "pad": "é" * (i % 29)}) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n" * (name not in ("c", "empty")), encoding="utf-8")
        want |= {(name, i + 1): x for i, x in enumerate(lines)}
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, str(block))
    try:
        if block == 200:
            assert spark.read.text(f"{tmp_path}/a.jsonl").rdd.getNumPartitions() > 5
        named = lambda df: {(r.file.rpartition("/")[2][:-6], r.line): r.value for r in df.collect()}
        assert named(readers.numbered_lines(spark, f"{tmp_path}/*.jsonl")) == want
        assert named(readers.bad_lines(spark, str(tmp_path))) == {k: v for k, v in want.items() if v.startswith("{bad")}
        with pytest.raises(ValueError, match="a.jsonl line 6 is not JSON: .bad a 5"):
            readers.check_lines(spark, str(tmp_path))
        readers.check_lines(spark, f"{tmp_path}/b.jsonl")
        assert readers.bad_lines(spark, f"{tmp_path}/empty.jsonl").collect() == []
    finally:
        spark.conf.set(key, old)


def test_first_files(spark, tmp_path):
    for name in ("P10", "P2", "P1", ".P0"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name}))
    (tmp_path / "note.txt").write_text("x")
    read = lambda first: sorted(r.name for r in readers.scan_documents(spark, str(tmp_path), "name string", first=first).collect())
    assert read(2) == ["P1", "P10"] and read(9) == ["P1", "P10", "P2"] and read(0) == [] and read(None) == ["P1", "P10", "P2"]


def test_packed_documents(spark, tmp_path):
    """As many files as partitions, not as documents; the first ones by their names as text."""
    names = [None, *range(-3, 300)]
    rows = [(n, [(1, "a\nb"), (2, None)] if i % 2 else []) for i, n in enumerate(names)]
    schema = "n bigint, events array<struct<id:bigint,kind:string>>"
    writers.write_documents(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "docs"))
    assert len(list((tmp_path / "docs").rglob("*.json"))) == 3
    read = lambda first: sorted(((r.n, [tuple(e) for e in r.events]) for r in readers.scan_documents(spark, str(tmp_path), schema, recursive=True, first=first, name="n").collect()), key=str)
    assert read(None) == sorted(rows, key=str)
    early = sorted((r for r in rows if r[0] is not None), key=lambda r: str(r[0]))
    assert read(20) == sorted(early[:20], key=str) and read(999) == sorted(early, key=str) and read(0) == []


def test_query_of_documents_makes_few_files(spark, tmp_path, monkeypatch):
    rows = [(u * 10 + i, u, "x") for u in range(300) for i in range(3)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").write.parquet(str(tmp_path / "in" / "events.parquet"))
    monkeypatch.setattr(registry, "fresh_folder", lambda spark: f"file://{tmp_path}/docs")
    got = catalog.queries()["SRC6_json_documents"](spark, str(tmp_path / "in")).collect()
    first = set(sorted(map(str, range(300)))[:20])
    assert sorted((r.user_id, r.event_id, r.event_type, r.demo) for r in got) == sorted((u, e, k, d) for e, u, k in rows for d in (False, True) if not d or str(u) in first)
    assert len(list((tmp_path / "docs").rglob("*.json"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
