import pytest
from conftest import DATA, as_rows

from peerscope.plans.oracles import ORACLE_SQL
from peerscope.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert as_rows(got) == as_rows(duck.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry_without_text_subpackage(tmp_path):
    """The entry module imports and lists the flow queries where the text subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    shutil.copytree(f"{ROOT}/peerscope", tmp_path / "peerscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'as_pairs' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_top_k_is_one_pass(spark):
    from peerscope.sources.sinks import explained

    assert "TakeOrderedAndProject" in explained(QUERIES["topk_dns_bytes"](spark, DATA))


def test_only_needed_columns_are_read(spark):
    from peerscope.sources.sinks import explained

    plan = explained(QUERIES["as_outgoing"](spark, DATA))
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan
    assert "BroadcastHashJoin LeftOuter" in plan


def test_months_need_no_join_without_keys_and_no_scan_of_the_flows(spark):
    from peerscope.sources.sinks import explained
    from peerscope.sources.views import view

    for name in ("as_ranges", "as_ranges_monthly", "dns_monthly"):
        plan = explained(view(spark, DATA, name))
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "lineitem" not in plan


@pytest.mark.parametrize("name", ["dns_ingoing_monthly", "dns_pairs_monthly"])
def test_many_monthly_names_are_not_broadcast(spark, duck, monkeypatch, name):
    """The estimated bytes of the exploded names are few even where their counted bytes are too many."""
    from peerscope.operators import enrich
    from peerscope.sources.sinks import explained

    assert "BroadcastHashJoin" in explained(QUERIES[name](spark, DATA))
    monkeypatch.setattr(enrich, "BROADCAST_BYTES", 1 << 10)
    got = QUERIES[name](spark, DATA)
    plan = explained(got)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert as_rows(got.toPandas()) == as_rows(duck.execute(ORACLE_SQL[name]).df())
