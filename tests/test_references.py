from datetime import datetime

from memloom.operators import references as R

ART = "id string, references_ids array<string>, leads_to array<string>, caused_by array<string>, created_at timestamp, loaded_at timestamp, tab string"
T0, T1, T9 = datetime(2024, 3, 1), datetime(2024, 3, 2), datetime(2024, 3, 10)


def _found(spark, rows, removals, ranges=3):
    a = spark.createDataFrame(rows, ART)
    r = spark.createDataFrame(removals, "tab string, object_id string, removed_at timestamp, restored_at timestamp")
    refs = R.references(a, "id", ["references_ids", "leads_to", "caused_by"], "artifacts", "artifacts")
    known = R.parents(a, "id", r, "artifacts", "artifacts")
    return sorted((x.ref_key, x.field_name, x.target_key, x.kind, x.ref_month) for x in R.orphans(refs, known, ranges=ranges).collect())


def test_kinds_and_cleaning(spark):
    rows = [
        ("a", ["b", " B\t", None, "", "  ", "zz"], None, [], T0, T0, "x"),
        ("b", None, ["gone", "back"], ["late"], T0, T0, "x"),
        ("late", None, None, None, T9, T9, "x"),
        ("back", None, None, None, T0, T0, "x"),
        ("a", ["b", "zz"], None, [], T0, T9, "x"),
    ]
    removals = [("artifacts", "gone", T1, None), ("artifacts", "back", T1, T9), ("facts", "b", T1, None)]
    assert _found(spark, rows, removals) == [("a", "references_ids", "zz", "missing", "2024-03"), ("b", "caused_by", "late", "late", "2024-03"), ("b", "leads_to", "gone", "deleted", "2024-03")]


def test_hot_key_spans_ranges(spark):
    rows = [(f"r{k}", ["hot", "none"], None, None, T0, T0, "x") for k in range(400)] + [("hot", None, None, None, T0, T0, "x")]
    for ranges in (1, 7, 40):
        got = _found(spark, rows, [], ranges)
        assert len(got) == 400 and {g[3] for g in got} == {"missing"} and {g[2] for g in got} == {"none"}


def test_long_and_odd_keys(spark):
    long = "k" * 90
    rows = [("a", [long + "1", long + "2", "z\0", "z", "é" * 40], None, None, T0, T0, "x"), (long + "1", None, None, None, T0, T0, "x"), ("z", None, None, None, T0, T0, "x"), ("é" * 40, None, None, None, T0, T0, "x")]
    for ranges in (1, 4):
        assert [g[2] for g in _found(spark, rows, [], ranges)] == [long + "2", "z\0"]


def test_empty_tables(spark):
    assert _found(spark, [], []) == []
