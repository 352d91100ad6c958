"""A loan panel derived from order and line-item tables.

An order is a loan, its lines in shipping order are the loan's months. The rules
are deterministic column expressions, so the same panel can be restated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.operators.ordering import HOT_ROWS, Timeline, heavy_values
from vintara.settings import Settings
from vintara.storage import parts_for

LOAN = ("origination_vintage", "loan_identifier")

#: Parameters suited to the short histories of the derived panel.
DRIVER_SETTINGS = Settings(
    train_cohorts=(1995, 1996, 1997, 1998),
    test_cohorts=(1999, 2000, 2001),
    horizon=6,
    horizons=(2, 3, 4, 6),
    binary_window=4,
    isotonic_tail_rows=200,
)

# Total order of an order's lines; rows equal in all of these are identical.
LINE_ORDER = (
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def loan_book(spark: SparkSession, folder: str) -> DataFrame:
    """One row per loan with its origination attributes."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(
        key.alias("loan_identifier"),
        F.year("o_orderdate").alias("origination_vintage"),
        F.when(customer % 11 != 0, 600 + customer * 7 % 221).cast("int").alias("classic_fico"),
        (40 + key * 13 % 61).cast("int").alias("original_combined_loan_to_value"),
        F.when(key % 7 != 0, 10 + key * 5 % 51).cast("int").alias("original_debt_to_income_ratio"),
        (40 + key * 13 % 41).cast("int").alias("original_loan_to_value"),
        F.col("o_totalprice").alias("original_upb"),
        note_rate(key).alias("original_interest_rate"),
        F.lit(360).alias("original_loan_term"),
        F.when(key % 9 != 0, F.when(key % 4 == 0, "Y").otherwise("N"))
        .alias("first_time_homebuyer_indicator"),
        F.col("o_orderstatus").alias("loan_purpose"),
        F.substring("o_orderpriority", 1, 1).alias("occupancy_status"),
        F.when(customer % 500 == 0, "T").when(customer % 3 == 0, "R").otherwise("B").alias("channel"),
        F.lit("SF").alias("property_type"),
        F.when(key % 10 < 6, "2").otherwise("1").alias("number_of_borrowers"),
        F.when(customer % 17 == 0, "2").otherwise("1").alias("number_of_units"),
        F.concat(F.lit("S"), (customer % 12).cast("string")).alias("property_state"),
    )


def note_rate(key: Column) -> Column:
    return 4.0 + 0.25 * (key % 17)


def loan_months(spark: SparkSession, folder: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per loan and month, with the columns of the monthly files.

    The lines are dealt out by loan to partitions of bounded size; the join and the ordered window both start from those.
    """
    lines = table(spark, folder, "lineitem")
    parts = parts_for(lines)
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    hot = heavy_values(lines, "l_orderkey", hot_rows)
    dealt = lambda rows: rows.where(F.col("l_orderkey").isNotNull()).repartition(parts, "l_orderkey")
    if hot.isEmpty():
        placed = dealt(lines).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    else:
        # Orders are unique on their key: this side has a row per hot key, at most rows / hot_rows.
        hot_key = hot.select(F.col("l_orderkey").alias("_hot"))
        few = orders.join(hot_key, F.col("o_orderkey") == F.col("_hot"), "left_semi")
        rest = lines.join(hot_key, F.col("l_orderkey") == F.col("_hot"), "left_anti")
        placed = dealt(rest).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).unionByName(
            lines.join(F.broadcast(few), F.col("l_orderkey") == F.col("o_orderkey"))
        )
    placed = placed.withColumns(
        {"loan_identifier": F.col("l_orderkey"), "origination_vintage": F.year("o_orderdate")}
    )
    placed = placed.withColumn("_large", F.when(F.col("l_quantity") >= 49, 1).otherwise(0))
    # One ordered window: position, gap counter, opening line and next line together.
    story = (
        Timeline.of(placed, LOAN, LINE_ORDER, hot)
        .running_sum(seq=F.lit(1).cast("long"), _larges=F.col("_large"))
        .first(_opening="_large")
        .lead(_next="l_orderkey")
    )
    rows = story.rows.withColumn("jumps", F.col("_larges") - F.col("_opening"))

    seq, key = F.col("seq"), F.col("loan_identifier")
    late = F.when(key % 6 == 0, 2).otherwise(0)
    age = (
        F.when((F.col("l_quantity") <= 2) & (seq > 1), F.lit(0))
        .otherwise(seq - 1 + late + F.col("jumps"))
        .cast("int")
    )
    status, returned = F.col("o_orderstatus"), F.col("l_returnflag")
    code = F.when(
        F.col("_next").isNull(),
        F.when((status == "F") & (returned == "A"), "03")
        .when((status == "O") & (F.col("l_linestatus") == "O"), "01")
        .when((status == "P") & (returned == "N") & (F.col("l_linestatus") == "F"), "16"),
    )
    missed = F.when(F.col("l_tax") >= 0.08, F.lit(None).cast("string")).when(
        (returned == "R") & (F.col("l_discount") >= 0.095), "RA"
    ).when(
        returned == "R",
        F.concat(F.lit("0"), (F.round(F.col("l_discount") * 100).cast("int") % 5).cast("string")),
    ).otherwise("00")
    scheduled = F.col("o_totalprice") * (1 - 0.02 * (seq - 1))
    rows = rows.withColumns({"loan_age": age, "zero_balance_code": code})
    closed = F.col("zero_balance_code").isNotNull()
    term = F.when(key % 97 == 0, 60).otherwise(360)
    columns = {
        "loan_identifier": key,
        "origination_vintage": F.col("origination_vintage"),
        "period": seq.cast("int"),
        "period_date": F.add_months(F.trunc("o_orderdate", "MM"), (seq - 1).cast("int")),
        "loan_age": F.col("loan_age"),
        "remaining_months_to_legal_maturity": term - F.col("loan_age"),
        "current_actual_upb": F.when(closed, 0.0).otherwise(scheduled),
        "current_interest_rate": note_rate(key),
        "current_loan_delinquency_status": missed,
        "zero_balance_code": F.col("zero_balance_code"),
        "zero_balance_removal_upb": F.when(closed, scheduled),
        "actual_loss": F.when(
            F.col("zero_balance_code") == "03",
            F.col("o_totalprice") * (0.1 + 5 * F.col("l_discount")),
        ),
        "modification_flag": F.when(F.col("l_linestatus") == "O", "Y"),
        "payment_deferral_flag": F.when(F.col("l_quantity") >= 45, "Y"),
        "borrower_assistance_plan": F.when(returned == "R", "F"),
        "delinquency_due_to_disaster": F.when(F.col("l_tax") >= 0.07, "Y"),
    }
    kept = [c.alias(n) for n, c in columns.items()]
    return rows.select(*kept, *([F.col("_slice")] if story.sliced else []))


def daily_yields(spark: SparkSession, folder: str) -> DataFrame:
    """A daily yield series as text, ``.`` where there is no observation."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("observation_date"),
        F.when(key % 13 == 0, ".")
        .otherwise(F.concat(F.lit("3."), F.lpad((key % 100).cast("string"), 2, "0")))
        .alias("value"),
    )
