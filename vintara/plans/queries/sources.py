"""Registered source, audit and sink queries: driver tables through text files and back."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from vintara.operators import curves
from vintara.plans.queries.panel import rounded
from vintara.plans.stored import months_of, panel_path
from vintara.sources import loan_files, loan_schema, panel_store
from vintara.sources.driver_tables import DRIVER_SETTINGS as S
from vintara.sources.driver_tables import loan_book
from vintara.storage import fresh_path, parts_for

COHORT = loan_schema.COHORT


def _text(column):
    return F.coalesce(column.cast("string"), F.lit(""))


def _by_file(rows, stem):
    """Rows in the order of their file, named by cohort. The narrow rows are sorted, so that their text need not be."""
    name = F.concat(F.lit(f"{stem}_"), F.coalesce(F.col(COHORT).cast("string"), F.lit("")), F.lit(".txt"))
    return rows.withColumn("file", name).sortWithinPartitions("file")


def _origination_text(spark, folder):
    """The loan book in file layout, with not-available codes and some bad numbers."""
    book = _by_file(loan_book(spark, folder), "sample_orig")
    key = F.col("loan_identifier")
    filled = {c: F.lit("") for c in loan_schema.ORIGINATION}
    filled |= {c: _text(F.col(c)) for c in book.columns if c in filled}
    filled |= {
        "classic_fico": F.coalesce(F.col("classic_fico").cast("string"), F.lit("9999")),
        "original_debt_to_income_ratio": F.coalesce(
            F.col("original_debt_to_income_ratio").cast("string"), F.lit("999")
        ),
        "first_time_homebuyer_indicator": F.coalesce("first_time_homebuyer_indicator", F.lit("9")),
        "postal_code": F.when(key % 10 == 0, "000").otherwise(
            F.lpad((key % 1000).cast("string"), 3, "0")
        ),
        "seller_name": F.when(key % 5 == 0, 'FIRST "QUOTED SELLER').otherwise("OTHER"),
        "number_of_units": F.when(key % 50 == 0, "two").otherwise(F.col("number_of_units")),
        "first_payment_date": F.concat(F.col(COHORT).cast("string"), F.lit("03")),
        "maturity_date": F.when(key % 40 == 0, "203013").otherwise("203001"),
    }
    return book.select("file", *[filled[c].alias(c) for c in loan_schema.ORIGINATION])


def _performance_text(spark, folder):
    months = _by_file(months_of(spark, folder), "sample_perf")
    key = F.col("loan_identifier")
    filled = {c: F.lit("") for c in loan_schema.PERFORMANCE}
    filled |= {c: _text(F.col(c)) for c in months.columns if c in filled}
    filled |= {
        "period": F.date_format("period_date", "yyyyMM"),
        "current_loan_delinquency_status": F.coalesce("current_loan_delinquency_status", F.lit("XX")),
        "loan_age": F.when((key % 30 == 0) & (F.col("period") == 1), "n/a").otherwise(
            F.col("loan_age").cast("string")
        ),
        "estimated_loan_to_value": F.lit("999"),
    }
    return months.select("file", *[filled[c].alias(c) for c in loan_schema.PERFORMANCE])


@lru_cache(maxsize=8)
def _export_root(spark, folder) -> str:
    return fresh_path(spark, "loan-files")


@lru_cache(maxsize=16)
def exported_kind(spark, folder, kind) -> str:
    """The driver tables as loan files of one kind below the shared folder, written once per session.

    One folder of compressed text parts per cohort, named like the published files.
    """
    path = f"{_export_root(spark, folder)}/{kind}"
    text = _origination_text if kind == "origination" else _performance_text
    (
        text(spark, folder).write.mode("append").partitionBy("file").option("sep", "|").option("quote", "")
        .option("emptyValue", "").option("nullValue", "").option("compression", "gzip").csv(path)
    )
    return path


def exported(spark, folder) -> str:
    """The folder with the loan files of every kind."""
    for kind in loan_schema.TABLES:
        exported_kind(spark, folder, kind)
    return _export_root(spark, folder)


def raw(spark, folder, kind):
    return loan_files.scan_cohorts(spark, exported_kind(spark, folder, kind), kind, S)


def scan_text(spark, folder):
    return raw(spark, folder, "origination").select(
        "loan_identifier", "seller_name", "postal_code", "classic_fico", "vantagescore_4_0"
    )


def cohort_stamp(spark, folder):
    return raw(spark, folder, "performance").groupBy(COHORT).agg(F.count(F.lit(1)).alias("rows"))


def missing_cohorts(spark, folder):
    """Cohorts asked for without a file: one year past the last exported cohort."""
    asked = S.__class__(
        train_cohorts=S.train_cohorts, test_cohorts=(*S.test_cohorts, max(S.cohorts) + 1)
    )
    return loan_files.missing_cohorts(spark, exported(spark, folder), asked)


def typed_origination(spark, folder):
    table = loan_files.typed(raw(spark, folder, "origination"), loan_schema.ORIGINATION)
    return rounded(table, 4, "original_upb").select(
        F.col("loan_identifier").cast("bigint").alias("loan_identifier"), COHORT,
        F.col("classic_fico").cast("int"), F.col("original_debt_to_income_ratio").cast("int"),
        F.col("number_of_units").cast("int"), "original_upb", "first_time_homebuyer_indicator",
        "postal_code", "first_payment_date_date", "maturity_date_date",
    )


def typed_performance(spark, folder):
    table = loan_files.typed(raw(spark, folder, "performance"), loan_schema.PERFORMANCE)
    table = rounded(table, 5, "actual_loss")
    return rounded(table, 4, "current_actual_upb").select(
        F.col("loan_identifier").cast("bigint").alias("loan_identifier"), "period_date", "loan_age",
        "current_actual_upb", "current_loan_delinquency_status", "zero_balance_code",
        "actual_loss", F.col("estimated_loan_to_value").cast("int"),
    )


def key_audit(spark, folder):
    months = months_of(spark, folder)
    checks = (
        ("origination", loan_book(spark, folder), ["loan_identifier"]),
        ("performance", months, ["loan_identifier", "period"]),
        # Lines are not unique per order and number: the audit must count those.
        ("line items", spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]),
    )
    parts = [
        loan_files.duplicate_keys(frame, keys, parts_for(frame)).withColumn("table", F.lit(name))
        for name, frame, keys in checks
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cast_losses(spark, folder):
    parts = [
        loan_files.cast_losses(raw(spark, folder, kind), kind, loan_schema.TABLES[kind])
        for kind in loan_schema.TABLES
    ]
    return parts[0].unionByName(parts[1])


def load_summary(spark, folder):
    return loan_files.load_summary(
        raw(spark, folder, "origination"), raw(spark, folder, "performance")
    )


def pruned_panel(spark, folder):
    return panel_store.read_panel(
        spark, panel_path(spark, folder), S.test_cohorts,
        ["loan_identifier", COHORT, "loan_age", "default_event"],
    )


def report_sink(spark, folder):
    """The curve table written as a report and read back."""
    path = fresh_path(spark, "report")
    panel = panel_store.read_panel(spark, panel_path(spark, folder))
    table = rounded(curves.cohort_curves(panel, S), 9, "cif_default")
    panel_store.write_report(table, path, ["vintage", "loan_age"])
    back = spark.read.option("header", True).csv(path)
    return back.select(
        F.col("vintage").cast("int"), F.col("loan_age").cast("int"),
        F.col("at_risk").cast("bigint"), F.col("cif_default").cast("double"),
    )


QUERIES = {
    "s1_scan_text": scan_text,
    "s2_cohort_stamp": cohort_stamp,
    "s2_missing_cohorts": missing_cohorts,
    "s3_typed_origination": typed_origination,
    "s3_typed_performance": typed_performance,
    "s4_key_audit": key_audit,
    "s5_cast_losses": cast_losses,
    "s6_load_summary": load_summary,
    "s7_pruned_panel": pruned_panel,
    "s8_report_sink": report_sink,
}
