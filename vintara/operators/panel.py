"""From loan months to the panel of months at risk.

Everything up to the panel runs in one keyed exchange: the sequencing windows,
the sticky break flags and the per-loan exit measures share the partitioning by
(cohort, loan), so no self-join and no second shuffle of the monthly rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.functions.scalars import month_boundaries, truth
from vintara.operators.ordering import Timeline
from vintara.settings import PREPAID_CODE, REPOSSESSED_STATUS, Settings

LOAN = ("origination_vintage", "loan_identifier")

# Exit reasons in presentation order.
EXIT_REASONS = (
    "default", "prepaid", "administrative_censor", "data_censor",
    "informative_exit", "clock_reset_censor", "month_gap_censor",
)

CARRIED_MONTH_COLUMNS = (
    "current_actual_upb", "current_interest_rate", "current_loan_delinquency_status",
    "missed_payments", "modification_flag", "payment_deferral_flag",
    "borrower_assistance_plan", "delinquency_due_to_disaster", "zero_balance_code", "actual_loss",
)


def sequence_months(performance: DataFrame) -> Timeline:
    """Calendar order per loan, with age-clock resets and missing months flagged."""
    months = Timeline.of(performance, LOAN, ("period",)).lag(previous_loan_age="loan_age")
    step = F.col("loan_age") - F.col("previous_loan_age")
    return months.with_columns(
        {"loan_age_reset": truth(step <= 0), "follows_month_gap": truth(step > 1)}
    )


def classify_months(months: Timeline, settings: Settings) -> Timeline:
    """What each month says about the loan, and whether it counts as time at risk."""
    status, code = F.col("current_loan_delinquency_status"), F.col("zero_balance_code")
    months = months.running_any(
        clock_broken=F.col("loan_age_reset"), after_month_gap=F.col("follows_month_gap")
    )
    missed = F.when(status.rlike("^[0-9]+$"), status).try_cast("int")
    months = months.with_columns({"missed_payments": missed})
    missed, age = F.col("missed_payments"), F.col("loan_age")
    return months.with_columns(
        {
            "at_or_past_delinquency_threshold": truth(
                (status == REPOSSESSED_STATUS)
                | truth(missed >= settings.delinquency_threshold)
            ),
            "terminated_credit_event": truth(code.isin(*settings.credit_event_codes)),
            "terminated_prepaid": truth(code == PREPAID_CODE),
            "terminated_informative": truth(code.isin(*settings.informative_codes))
            if settings.informative_codes else F.lit(False),
            "implied_original_term": age + F.col("remaining_months_to_legal_maturity"),
            "delinquency_exceeds_loan_age": truth(missed > age + 1),
            "eligible": truth(
                ~F.col("clock_broken") & ~F.col("after_month_gap")
                & age.between(0, settings.horizon)
            ),
        }
    )


def history_measures() -> dict[str, Column]:
    """Per-loan measures over the whole history and over the eligible window.

    The same expressions serve a grouped aggregate and a keyed window.
    """
    age, month, period = F.col("loan_age"), F.col("period_date"), F.col("period")
    late, event = F.col("at_or_past_delinquency_threshold"), F.col("terminated_credit_event")
    inside = F.col("eligible")

    def first_age(*conditions: Column) -> Column:
        condition = conditions[0]
        for more in conditions[1:]:
            condition = condition & more
        return F.min(F.when(condition, age))

    def age_before(flag: str) -> Column:
        previous = F.col("previous_loan_age")
        return F.min_by(previous, F.when(F.col(flag) & previous.isNotNull(), period))

    term = F.col("implied_original_term")
    return {
        # whole history: diagnostics, never part of an exit age
        "age_before_clock_reset": age_before("loan_age_reset"),
        "age_before_month_gap": age_before("follows_month_gap"),
        "ever_clock_reset": F.bool_or("loan_age_reset"),
        "ever_month_gap": F.bool_or("follows_month_gap"),
        "observed_months_total": F.count(F.lit(1)),
        "first_delinquent_age_observed": first_age(late),
        "credit_event_age_observed": first_age(event),
        "first_delinquent_month_observed": F.min(F.when(late, month)),
        "credit_event_month_observed": F.min(F.when(event, month)),
        # eligible window
        "first_observed_age": first_age(inside),
        "last_eligible_age": F.max(F.when(inside, age)),
        "eligible_months": F.count(F.when(inside, F.lit(1))),
        "first_delinquent_age": first_age(inside, late),
        "credit_event_age": first_age(inside, event),
        "prepaid_age": first_age(inside, F.col("terminated_prepaid")),
        "informative_exit_age": first_age(inside, F.col("terminated_informative")),
        "any_delinquency_exceeds_loan_age": F.bool_or(
            inside & F.col("delinquency_exceeds_loan_age")
        ),
        "entry_implied_term": F.min_by(term, F.when(inside & term.isNotNull(), period)),
    }


def loan_histories(months: Timeline) -> DataFrame:
    """One row per loan; partial aggregation makes a hot loan harmless."""
    measures = [c.alias(n) for n, c in history_measures().items()]
    return months.rows.groupBy(*LOAN).agg(*measures)


def exit_columns(settings: Settings) -> dict[str, Column]:
    """Exit age and reason from history measures, in dependency order."""
    if settings.default_mode == "delinquency":
        default_age = F.least("first_delinquent_age", "credit_event_age")
    else:
        default_age = F.col("credit_event_age")
    return {
        "default_age": default_age,
        "exit_age": F.least(
            default_age, F.col("prepaid_age"), F.col("informative_exit_age"),
            F.lit(settings.horizon), F.col("last_eligible_age"),
        ),
    }


def exit_reason(settings: Settings) -> Column:
    """The single reason, by precedence; unknown ages never match."""
    leaves = F.col("exit_age")
    return (
        F.when(F.col("default_age") == leaves, "default")
        .when(F.col("prepaid_age") == leaves, "prepaid")
        .when(F.col("informative_exit_age") == leaves, "informative_exit")
        .when(leaves >= settings.horizon, "administrative_censor")
        .when(F.col("age_before_clock_reset") == leaves, "clock_reset_censor")
        .when(F.col("age_before_month_gap") == leaves, "month_gap_censor")
        .otherwise("data_censor")
    )


def _off_clock() -> Column:
    return F.col("any_delinquency_exceeds_loan_age") | F.col("entry_term_mismatch")


def _term_mismatch() -> Column:
    return truth(F.col("entry_implied_term") != F.col("original_loan_term"))


def loan_exits(months: Timeline, origination: DataFrame, settings: Settings) -> DataFrame:
    """How and when every loan with an eligible month left the panel."""
    known = loan_histories(months).where(F.col("eligible_months") > 0)
    terms = origination.select(*LOAN, "original_loan_term")
    event, late = F.col("credit_event_age"), F.col("first_delinquent_age")
    resolved = (
        known.join(terms, list(LOAN), "left")
        .withColumns(exit_columns(settings))
        .withColumn("exit_reason", exit_reason(settings))
        .withColumn("entry_term_mismatch", _term_mismatch())
        .withColumns(
            {
                "off_clock": _off_clock(),
                "months_delinquent_to_disposition": month_boundaries(
                    F.col("first_delinquent_month_observed"), F.col("credit_event_month_observed")
                ),
                "clock_reset_within_horizon": truth(
                    F.col("age_before_clock_reset") <= settings.horizon
                ),
                "credit_event_preceded_delinquency": event.isNotNull()
                & (late.isNull() | truth(event < late)),
                "entered_after_horizon": F.col("first_observed_age") > settings.horizon,
            }
        )
    )
    return resolved.select(
        "loan_identifier", "origination_vintage", "first_observed_age", "last_eligible_age",
        "eligible_months", "observed_months_total", "original_loan_term", "entry_implied_term",
        "first_delinquent_age", "credit_event_age", "prepaid_age", "informative_exit_age",
        "default_age", "exit_age", "first_delinquent_age_observed", "credit_event_age_observed",
        "first_delinquent_month_observed", "credit_event_month_observed",
        "months_delinquent_to_disposition", "exit_reason", "off_clock",
        "any_delinquency_exceeds_loan_age", "entry_term_mismatch", "ever_clock_reset",
        "ever_month_gap", "age_before_clock_reset", "clock_reset_within_horizon",
        "credit_event_preceded_delinquency", "entered_after_horizon",
    )


_FOR_EXIT = (
    "age_before_clock_reset", "age_before_month_gap", "ever_clock_reset", "first_observed_age",
    "last_eligible_age", "first_delinquent_age", "credit_event_age", "prepaid_age",
    "informative_exit_age", "any_delinquency_exceeds_loan_age", "entry_implied_term",
)


def months_at_risk(months: Timeline, origination: DataFrame, settings: Settings) -> DataFrame:
    """The panel: each loan's eligible months up to its exit, origination attached."""
    measures = {n: c for n, c in history_measures().items() if n in _FOR_EXIT}
    spread = months.whole(**measures).rows.where("eligible")
    attributes = [c for c in origination.columns if c not in LOAN]
    joined = (
        spread.withColumns(exit_columns(settings))
        .withColumn("exit_reason", exit_reason(settings))
        .where(F.col("loan_age") <= F.col("exit_age"))
        .join(origination, list(LOAN))
        .withColumn("entry_term_mismatch", _term_mismatch())
    )
    if settings.exclude_off_clock:
        joined = joined.where(~_off_clock())
    leaving = F.col("loan_age") == F.col("exit_age")
    present = [c for c in CARRIED_MONTH_COLUMNS if c in spread.columns]
    return joined.select(
        "loan_identifier", "origination_vintage", "loan_age", "period", "period_date",
        "exit_age", "exit_reason",
        leaving.alias("is_exit_month"),
        (leaving & (F.col("exit_reason") == "default")).alias("default_event"),
        (leaving & (F.col("exit_reason") == "prepaid")).alias("prepayment_event"),
        "first_observed_age", "ever_clock_reset", *present, *attributes,
    )


def classified(performance: DataFrame, settings: Settings) -> Timeline:
    return classify_months(sequence_months(performance), settings)


def build_panel(performance: DataFrame, origination: DataFrame, settings: Settings) -> DataFrame:
    return months_at_risk(classified(performance, settings), origination, settings)


def build_exits(performance: DataFrame, origination: DataFrame, settings: Settings) -> DataFrame:
    return loan_exits(classified(performance, settings), origination, settings)


def written_counts() -> dict[str, Column]:
    """Rows, loans and events of panel rows, under the names that the report gives them."""
    return {
        "rows": F.count(F.lit(1)), "loans": F.count_if("is_exit_month"), "events": F.count_if("default_event"),
    }


def panel_report(
    performance: DataFrame, origination: DataFrame, settings: Settings
) -> DataFrame:
    """One row of shape and integrity counts, with the cohort reconciliation.

    Panel rows, loans and events follow from the exits (a loan contributes its
    months from first to exit age without holes), so the months are read once.
    """
    months = classified(performance, settings)
    loans = loan_exits(months, origination, settings)
    seen = loans.select(
        *LOAN, "exit_age", "exit_reason", "first_observed_age", "off_clock", "ever_clock_reset",
        "clock_reset_within_horizon", "ever_month_gap", "credit_event_preceded_delinquency",
        "entered_after_horizon", F.lit(True).alias("has_exit"),
    )
    booked = origination.select(*LOAN, F.lit(True).alias("in_book"))
    reported = performance.select(*LOAN).groupBy(*LOAN).agg(F.lit(True).alias("has_months"))
    # One row per loan known anywhere; three keyed inputs on one partitioning.
    everyone = booked.join(reported, list(LOAN), "full").join(seen, list(LOAN), "left")
    flag = {c: truth(F.col(c)) for c in ("in_book", "has_months", "has_exit", "off_clock")}
    dropped = flag["off_clock"] if settings.exclude_off_clock else F.lit(False)
    in_panel = flag["has_exit"] & flag["in_book"] & ~dropped
    length = F.col("exit_age") - F.col("first_observed_age") + 1
    of = lambda condition: F.count_if(truth(condition))
    counts = {
        "cohort_loans": of(flag["in_book"]),
        "loans_without_eligible_months": of(flag["has_months"] & ~flag["has_exit"]),
        "rows": F.sum(F.when(in_panel, length)).cast("bigint"),
        "loans": of(in_panel),
        "events": of(in_panel & (F.col("exit_reason") == "default")),
        "left_truncated_loans": of(F.col("first_observed_age") > 0),
        "seasoned_loans": of(F.col("first_observed_age") >= 3),
        "off_clock_loans": of(flag["off_clock"]),
        "excluded_loans": of(dropped),
        "clock_reset_loans": of(F.col("ever_clock_reset")),
        "clock_reset_within_horizon": of(F.col("clock_reset_within_horizon")),
        "month_gap_loans": of(F.col("ever_month_gap")),
        "entered_after_horizon": of(F.col("entered_after_horizon")),
        "credit_event_before_delinquency": of(F.col("credit_event_preceded_delinquency")),
        "loans_missing_origination": of(flag["has_months"] & ~flag["in_book"]),
        "loans_missing_performance": of(flag["in_book"] & ~flag["has_months"]),
    }
    counts |= {f"exits_{r}": of(F.col("exit_reason") == r) for r in EXIT_REASONS}
    row = everyone.agg(*[c.alias(n) for n, c in counts.items()])
    # Loans without any month also have no eligible one: both leave the cohort.
    accounted = (
        F.col("cohort_loans") - F.col("loans_missing_performance")
        - F.col("loans_without_eligible_months") - F.col("excluded_loans")
    )
    return row.withColumns(
        {
            "mean_months_at_risk": F.try_divide(F.col("rows").cast("double"), F.col("loans")),
            "reconciles": accounted == F.col("loans"),
        }
    )


