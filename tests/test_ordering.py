"""Order-dependent helpers against brute force, with hot keys forced."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import normal
from tests.loans import SETTINGS, origination, performance
from vintara.operators import panel, realised
from vintara.operators.ordering import SLICE, Timeline, heavy_values, numbered, prefix_sums
from vintara.operators.quantiles import exact_quantiles
from vintara.sources.driver_tables import loan_months


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    """Keep small shuffles in several partitions, so that carries are exercised."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of the rows, and ties nowhere in the order."""
    rng = random.Random(3)
    rows = [("hot", i, rng.randint(0, 5), rng.random()) for i in range(1000)]
    rows += [(f"k{i % 200}", i, rng.randint(0, 5), rng.random()) for i in range(2000)]
    return spark.createDataFrame(rows, "key string, at int, flag int, value double").repartition(6).cache()


def _both(rows, step):
    plain = Timeline.of(rows, ["key"], ["at"])
    split = Timeline.of(rows, ["key"], ["at"], hot=rows.where("key = 'hot'").select("key").distinct())
    assert split.sliced and split.rows.where(F.col(SLICE) >= 0).select(SLICE).distinct().count() > 1
    left, right = step(plain).rows, step(split).rows.drop(SLICE)
    columns = sorted(left.columns)
    a = normal(columns, [tuple(r) for r in left.select(*columns).collect()])
    b = normal(columns, [tuple(r) for r in right.select(*columns).collect()])
    assert a == b


def test_split_subjects_give_the_same_windows(skewed):
    _both(skewed, lambda t: t.lag(p="value").lead(n="value").first(f="flag"))
    _both(skewed, lambda t: t.running_sum(r=F.col("flag")).number("i"))
    _both(skewed, lambda t: t.running_any(a=(F.col("flag") == 5) & (F.col("at") > 400)))
    _both(skewed, lambda t: t.whole(m=F.min("value"), c=F.count(F.lit(1))))


def test_lag_keeps_nulls_across_slices(spark):
    rows = spark.createDataFrame(
        [("hot", i, None if i % 3 else i, 0.0) for i in range(300)], "key string, at int, flag int, value double"
    )
    _both(rows, lambda t: t.lag(p="flag"))


def test_heavy_values_finds_the_hot_key(skewed):
    assert [r["key"] for r in heavy_values(skewed, "key", hot_rows=500).collect()] == ["hot"]
    assert heavy_values(skewed, "key").isEmpty()


def test_heavy_values_are_told_from_others_of_their_group(skewed, monkeypatch):
    from vintara.operators import ordering

    monkeypatch.setattr(ordering, "VALUE_GROUPS", 2)
    assert [r["key"] for r in heavy_values(skewed, "key", hot_rows=500).collect()] == ["hot"]
    # Each group holds more rows than that, but no key does.
    assert heavy_values(skewed.where("key != 'hot'"), "key", hot_rows=500).isEmpty()


def test_panel_and_realised_legs_do_not_depend_on_splitting(spark):
    months, book = performance(spark), origination(spark)
    split = Timeline.of(months, panel.LOAN, ["period"], hot=months.where("loan_identifier in ('L2000-11', 'L2001-02')").select("loan_identifier").distinct()).rows
    plain, hot = (panel.build_panel(m, book, SETTINGS) for m in (months, split))
    columns = sorted(plain.columns)
    assert normal(columns, [tuple(r) for r in plain.select(*columns).collect()]) == normal(
        columns, [tuple(r) for r in hot.select(*columns).collect()]
    )
    steps = [realised.month_steps(m).drop(SLICE) for m in (months, split)]
    columns = sorted(steps[0].columns)
    assert normal(columns, [tuple(r) for r in steps[0].select(*columns).collect()]) == normal(
        columns, [tuple(r) for r in steps[1].select(*columns).collect()]
    )


def test_adapter_gives_the_same_months_when_every_order_is_hot(spark, folder):
    plain, split = loan_months(spark, folder), loan_months(spark, folder, hot_rows=9)
    assert SLICE in split.columns
    columns = sorted(plain.columns)
    assert normal(columns, [tuple(r) for r in plain.select(*columns).collect()]) == normal(
        columns, [tuple(r) for r in split.select(*columns).collect()]
    )


def test_numbered_is_a_dense_global_rank(skewed):
    ranked, total = numbered(skewed, ["flag", "key", "at"])
    rows = ranked.orderBy("position").collect()
    assert total == len(rows) == 3000
    assert [r["position"] for r in rows] == list(range(1, 3001))
    order = [(r["flag"], r["key"], r["at"]) for r in rows]
    assert order == sorted(order)


def test_prefix_sums_match_a_plain_loop(skewed):
    got = prefix_sums(skewed, ["flag"], ["value", "at"], total=F.col("at").cast("long"))
    seen: dict[int, int] = {}
    for r in got.orderBy("flag", "value", "at").collect():
        seen[r["flag"]] = seen.get(r["flag"], 0) + r["at"]
        assert r["total"] == seen[r["flag"]]


def test_exact_quantiles_match_numpy(skewed):
    import numpy as np

    probabilities = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    got = exact_quantiles(skewed, ["flag"], "value", probabilities)
    data = skewed.toPandas()
    for r in got.collect():
        expected = np.quantile(data[data.flag == r["flag"]]["value"], probabilities)
        assert np.allclose(r["quantiles"], expected, atol=1e-12)


def test_weighted_quantiles_equal_repeated_rows(spark):
    import numpy as np

    rows = [(float(v), w) for v, w in [(3, 5), (1, 2), (9, 1), (4, 7)]]
    frame = spark.createDataFrame(rows, "v double, w bigint")
    got = exact_quantiles(frame, [], "v", [0.25, 0.5, 0.9], "w").first()["quantiles"]
    assert np.allclose(got, np.quantile(np.repeat([v for v, _ in rows], [w for _, w in rows]), [0.25, 0.5, 0.9]))
