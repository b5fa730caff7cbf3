"""The merge table in each mode against dictionaries, and writers that stop."""

import pytest

from quillstone.sources.merge_table import MergeTable

ROW = "k long, part string, v string, size long, at long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_modes_against_dictionaries(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), ("k", "part"), 8)
    with pytest.raises(FileNotFoundError):
        table.read()
    frame = lambda data: spark.createDataFrame(data, ROW)
    first = [(i, "x", f"v{i}", i % 5, 1) for i in range(40)]
    assert table.upsert(frame(first)) == 1
    want = {r[:2]: r for r in first}
    assert rows(table.read()) == sorted(want.values(), key=str)
    second = [(i, "x", None if i % 2 else "new", 9, None) for i in range(35, 45)]
    assert table.upsert(frame(second)) == 2
    for r in second:
        old = want.get(r[:2], (None,) * 5)
        want[r[:2]] = tuple(b if b is not None else a for a, b in zip(old, r, strict=True))
    assert rows(table.read()) == sorted(want.values(), key=str)
    third = [(3, "x", "only", 1, 1), (100, "y", "a", 1, 1)]
    table.replace(frame(third))
    want |= {r[:2]: r for r in third}
    assert rows(table.read()) == sorted(want.values(), key=str)
    fourth = [(4, "x", "less", 0, 99), (5, "x", "more", 50, 0)]
    table.upsert_dominant(frame(fourth), "size", "at")
    want[5, "x"] = fourth[1]
    assert rows(table.read()) == sorted(want.values(), key=str)
    fifth = [(6, "x", "newer", 0, 99), (7, "x", "older", 50, 0)]
    table.last_writer(frame(fifth), "at")
    want[6, "x"] = fifth[0]
    assert rows(table.read()) == sorted(want.values(), key=str)
    assert table.delete(frame([(6, "x", None, None, None), (777, "z", None, None, None)])) == 6
    del want[6, "x"]
    assert rows(table.read()) == sorted(want.values(), key=str)
    table.upsert(table.read().limit(0))
    assert table.vacuum() > 0 and rows(table.read()) == sorted(want.values(), key=str)


def test_untouched_buckets_stay_where_they_are(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), ("k",), 16)
    frame = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "k long, v string")
    table.upsert(frame(range(200)))
    before = table.manifest()["folders"]
    table.upsert(frame([7]))
    after = table.manifest()["folders"]
    assert len(before) == 16 and sum(after[b] != before[b] for b in before) == 1


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = MergeTable(spark, str(tmp_path / "t"), ("k",), 4)
    frame = lambda v: spark.createDataFrame([(i, v) for i in range(9)], "k long, v string")
    table.upsert(frame("old"))
    with monkeypatch.context() as m:
        m.setattr(MergeTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            table.upsert(frame("new"))
    assert {r["v"] for r in table.read().collect()} == {"old"} and table.manifest()["version"] == 1
    state = table.manifest()
    table.upsert(frame("new"))
    with pytest.raises(RuntimeError):  # another writer that began from the same version
        table._publish(state | {"version": 2})
    assert {r["v"] for r in table.read().collect()} == {"new"}
    assert table.vacuum() == 3 and table.read().count() == 9
