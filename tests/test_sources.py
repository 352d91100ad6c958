from __future__ import annotations

from datetime import datetime

import pytest

from tests.compare import connect, difference
from vintara import storage
from vintara.plans import catalog, stored
from vintara.plans.queries import sources
from vintara.plans.queries.panel import built_panel
from vintara.sources import loan_files, panel_store
from vintara.sources.driver_tables import DRIVER_SETTINGS as S
from vintara.sources.driver_tables import loan_months

LIGHT = [
    n for n in catalog.oracle_sql()
    if n[0] in "srvpzlnj" and not n.startswith(("p9", "p10", "p11"))
]


@pytest.mark.parametrize("name", LIGHT)
def test_queries_match_their_oracles(spark, folder, name):
    con = connect(folder)
    assert difference(catalog.queries()[name](spark, folder), con, catalog.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("text", ["a|b\n", "a|b|c|d\n"])
def test_wrong_field_counts_fail_even_for_a_count(spark, tmp_path, text):
    path = tmp_path / "rows.txt"
    path.write_text("x|y|z\n" + text)
    rows = loan_files.scan_text(spark, str(path), ["one", "two", "three"])
    with pytest.raises(Exception, match="(?i)malformed"):
        rows.select("one").collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        rows.count()


def test_scan_keeps_quotes_zeros_and_empties(spark, tmp_path):
    path = tmp_path / "rows.txt"
    path.write_text('00501|A "B|\n')
    assert tuple(loan_files.scan_text(spark, str(path), ["a", "b", "c"]).first()) == ("00501", 'A "B', None)


def test_cohort_filter_prunes_panel_files(spark, folder):
    frame = panel_store.read_panel(spark, stored.panel_path(spark, folder), (1999,), ["loan_identifier"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(origination_vintage" in plan or "origination_vintage#" in plan.split("PartitionFilters:")[1][:80]


def test_stored_months_need_no_exchange_for_windows(spark, folder):
    from vintara.operators import panel

    rows = panel.sequence_months(stored.months_of(spark, folder)).rows
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_panel_plan_shuffles_the_months_at_most_once(spark, folder):
    plan = built_panel(spark, folder, S)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


@pytest.fixture
def many_lines(spark, tmp_path, monkeypatch):
    """60 orders of 5 lines, 4 lines without an order, partitions of at most 40 rows on average."""
    day = datetime(1996, 3, 1)
    monkeypatch.setattr(storage, "PART_ROWS", 40)
    orders = [(k, k, "F", 1000.0 + k, day, "1-URGENT") for k in range(60)]
    lines = [(k, 1, 1, n, 5.0, 10.0 * n, 0.05, 0.02, "N", "F", day) for k in [*range(60), None] for n in range(1, 6)][:304]
    spark.createDataFrame(
        orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        [*lines, lines[0], lines[303]], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_buckets_and_join_partitions_grow_with_the_lines(spark, many_lines):
    plan = loan_months(spark, many_lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(l_orderkey" in plan and ", 8), REPARTITION_BY_NUM" in plan
    months = stored.months_of(spark, many_lines)
    described = spark.sql(f"DESCRIBE EXTENDED {stored._months_table(spark, many_lines)}").where("col_name = 'Num Buckets'")
    assert described.first()["data_type"] == "8"
    assert months.count() == 301 and months.where("loan_identifier = 0").count() == 6
    assert months.groupBy("loan_identifier").count().where("count != 5").count() == 1


def test_key_audit_bounds_the_keys_of_a_task(spark, many_lines):
    audit = sources.key_audit(spark, many_lines)
    # 306 lines and 301 months need 8 partitions; the null key counts as a value like any other.
    assert audit._jdf.queryExecution().executedPlan().toString().count(", 8), REPARTITION_BY_NUM") == 2
    assert {r["table"]: r["duplicate_keys"] for r in audit.collect()} == {"origination": 0, "performance": 0, "line items": 2}


def test_originations_are_exported_without_the_months(spark, tmp_path):
    day = datetime(1996, 3, 1)
    rows = [(1, 10, "F", 1000.0, day, "1-URGENT"), (1, 10, "F", 1000.0, day, "1-URGENT"),
            (2, 11, "O", 2000.0, None, "2-HIGH"), (None, 12, "O", 3000.0, day, None), (4, None, None, None, day, "5-LOW")]
    schema = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
              "o_orderpriority string")
    # There are no line items, so any query on the months would fail; an order without a date has no file.
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/orders.parquet")
    found = sources.typed_origination(spark, str(tmp_path)).collect()
    assert sorted((r["loan_identifier"] or 0, r["original_upb"] or 0.0) for r in found) == [
        (0, 3000.0), (1, 1000.0), (1, 1000.0), (4, 0.0)
    ]
    assert {r["origination_vintage"] for r in found} == {1996}
