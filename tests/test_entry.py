import inspect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_name_the_optional_subpackage():
    import importlib
    import pkgutil

    import memloom

    for m in pkgutil.walk_packages(memloom.__path__, "memloom."):
        if not m.name.startswith("memloom.llm"):
            assert "memloom.llm" not in inspect.getsource(importlib.import_module(m.name)), m.name


def test_core_queries_run_small(spark):
    core = [n for n, f in entry.queries().items() if "llm" not in f.__module__]
    for name in ("f1_type_filter", "q3_bm25_topk", "g2_mirrored_edges", "w4_windows", "x14_resolved_times", "a11_rates", "s5_json_round_trip"):
        assert name in core and entry.queries()[name](spark, SF).count() > 0, name
