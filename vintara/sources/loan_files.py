"""Reading the delimited loan files: raw text, cohort stamp, typed layer, audits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vintara.settings import Settings
from vintara.storage import with_counts
from vintara.sources.loan_schema import (
    COHORT, LOAN_KEY, MONTHS, NOT_AVAILABLE, TABLES, sql_type,
)

# File name patterns, the cohort year in the first group.
FILE_NAMES = {
    ("sample", "origination"): r"sample_orig_(\d{4})\.txt",
    ("sample", "performance"): r"sample_perf_(\d{4})\.txt",
    ("standard", "origination"): r"orig_(\d{4})Q[1-4]\.txt",
    ("standard", "performance"): r"perf_(\d{4})Q[1-4]\.txt",
}


class MissingFiles(FileNotFoundError):
    """Some cohorts have no input file."""


class KeyViolation(ValueError):
    """A table key is not unique."""


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def scan_text(spark: SparkSession, paths: str | list[str], columns: Sequence[str]) -> DataFrame:
    """Pipe-delimited text without header or quoting; every column stays text.

    A line with another field count fails the job. Column pruning is off for this
    read, because a pruned parser does not count the fields it skips.
    """
    return (
        spark.read.schema(text_schema(columns))
        .option("sep", "|").option("header", False)
        .option("quote", "").option("escape", "").option("nullValue", "")
        .option("mode", "FAILFAST").option("columnPruning", False)
        .option("enforceSchema", True).option("recursiveFileLookup", True)
        .csv(paths)
    )


def listed_files(spark: SparkSession, folder: str, kind: str, settings: Settings) -> DataFrame:
    """(path, cohort) of every file of one kind anywhere below a folder, from the file listing alone.

    The name may be that of the file or, for tables written in parts, of its folder.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .load(folder).select("path")
    )
    year = F.regexp_extract("path", FILE_NAMES[settings.source, kind], 1).try_cast("int")
    return listing.select("path", year.alias(COHORT)).where(F.col(COHORT).isNotNull())


def scan_cohorts(spark: SparkSession, folder: str, kind: str, settings: Settings) -> DataFrame:
    """All files of one kind below a folder, stamped with the cohort in their name.

    Reads exactly the listed files; those of cohorts outside the settings are skipped before they are
    read. The driver holds the file names only.
    """
    wanted = listed_files(spark, folder, kind, settings).where(F.col(COHORT).isin(*settings.cohorts))
    paths = sorted(r["path"] for r in wanted.collect())
    if not paths:
        return spark.createDataFrame([], text_schema(TABLES[kind]).add(COHORT, "int"))
    raw = scan_text(spark, paths, TABLES[kind])
    cohort = F.regexp_extract(F.col("_metadata.file_path"), FILE_NAMES[settings.source, kind], 1)
    return raw.select(F.expr("*"), cohort.try_cast("int").alias(COHORT))


def found_cohorts(spark: SparkSession, folder: str, kind: str, settings: Settings) -> DataFrame:
    """Cohorts that have a file."""
    return listed_files(spark, folder, kind, settings).select(COHORT).distinct()


def missing_cohorts(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    """(kind, cohort) pairs the settings ask for without a file."""
    values = ", ".join(f"({c})" for c in settings.cohorts)
    wanted = spark.sql(f"SELECT * FROM VALUES {values} AS wanted({COHORT})")
    parts = [
        wanted.join(found_cohorts(spark, folder, kind, settings), COHORT, "left_anti")
        .select(F.lit(kind).alias("kind"), COHORT)
        for kind in TABLES
    ]
    return parts[0].unionByName(parts[1])


def require_files(spark: SparkSession, folder: str, settings: Settings) -> None:
    gone = sorted((r["kind"], r[COHORT]) for r in missing_cohorts(spark, folder, settings).collect())
    if gone:
        raise MissingFiles(f"no file under {folder} for {gone}")


def cleared(column: str) -> Column:
    """The raw text with its not-available code turned into null."""
    code = NOT_AVAILABLE.get(column)
    return F.col(column) if code is None else F.nullif(F.col(column), F.lit(code))


def typed(raw: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Clear codes, then cast safely; month columns get a date beside them. One projection."""
    out = [F.col(COHORT)] if COHORT in raw.columns else []
    for name in columns:
        kind = sql_type(name)
        value = cleared(name)
        out.append((value if kind == "string" else value.try_cast(kind)).alias(name))
        if name in MONTHS:
            out.append(F.try_to_date(cleared(name), "yyyyMM").alias(f"{name}_date"))
    return raw.select(*out)


def loss_counts(columns: Iterable[str]) -> dict[str, Column]:
    """Per cast column, how many values present in the text the cast loses."""
    return {
        c: F.count_if(cleared(c).isNotNull() & cleared(c).try_cast(sql_type(c)).isNull())
        for c in columns if sql_type(c) != "string"
    }


def cast_losses(raw: DataFrame, table: str, columns: Iterable[str]) -> DataFrame:
    """Values present in the text that a cast lost, per column, in a single pass."""
    lost = loss_counts(columns)
    row = raw.agg(*[count.alias(c) for c, count in lost.items()])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("lost")) for c in lost]
    )
    return row.select(F.lit(table).alias("table"), F.inline(pairs)).where(F.col("lost") > 0)


def typed_and_losses(raw: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The typed layer, and its cast losses once it has been written: the text is parsed once for both."""
    columns = list(columns)
    counted, losses = with_counts(raw, loss_counts(columns))
    return typed(counted, columns), lambda: {c: n for c, n in losses().items() if n}


def duplicate_keys(frame: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """How many key values occur more than once.

    Keys are nearly all different, so a task holds a counter per key: ``parts`` bounds these for tables of many rows.
    """
    dealt = frame if parts is None else frame.select(*keys).repartition(parts, *keys)
    return (
        dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.count_if(F.col("_n") > 1).alias("duplicate_keys")
        )
    )


def require_unique(origination: DataFrame, performance: DataFrame) -> None:
    for name, frame, keys in (
        ("origination", origination, [LOAN_KEY]),
        ("performance", performance, [LOAN_KEY, "period"]),
    ):
        repeated = duplicate_keys(frame, keys).first()["duplicate_keys"]
        if repeated:
            raise KeyViolation(f"{repeated} values of {keys} occur more than once in {name}")


def load_summary(origination: DataFrame, performance: DataFrame) -> DataFrame:
    """Rows, loans and cohorts per table."""

    def row(name: str, frame: DataFrame) -> DataFrame:
        return frame.agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
            F.count_distinct(LOAN_KEY).alias("loans"),
            F.array_join(F.array_sort(F.collect_set(COHORT)), ",").alias("cohorts"),
        )

    return row("origination", origination).unionByName(row("performance", performance))
