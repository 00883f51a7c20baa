"""Reports derived from the match result and from the remittance schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.parsing import component_list, date_text
from ledgermill.functions.scoring import round_half_up
from ledgermill.operators.prefix import with_dense_index
from ledgermill.operators.remittance import LATE_THRESHOLD, money
from ledgermill.schemas import SCHEDULE_COLUMNS
from ledgermill.session import materialize

# Report columns.
EXCEPTION_LOG = [
    "pay_date", "payroll_total", "deposit_total", "variance", "match_status", "days_to_deposit", "late_flag",
    "exception_type", "payroll_source_files", "deposit_source_files", "review_required", "review_reason", "severity",
    "recommended_action", "principal_at_risk", "days_late_adjusted", "assumed_annual_rate", "lost_earnings_estimate",
]
WORKPAPER = [
    "pay_date", "exception_type", "late_flag", "days_to_deposit", "payroll_total", "deposit_total", "variance",
    "payroll_component_ids", "deposit_component_ids", "payroll_source_files", "deposit_source_files",
    "review_reason", "severity", "recommended_action",
]
# Policy basis, documents and correction by exception type.
CORRECTIONS = {
    "Late Deposit": (
        "Policy: Deposits should be completed as soon as administratively feasible.",
        "Source register, deposit statement, reconciliation confirmation", "Yes"),
    "Amount Mismatch": (
        "Policy: Deposits should be completed in full; partial deposits require correction and restoration.",
        "Source register, deposit detail, reconciliation worksheet", "Yes"),
    "Missing Deposit": (
        "Policy: Missing deposits require correction and documentation.",
        "Source register, deposit statement, deposit confirmation or proof of correction", "Yes"),
}
OTHER_CORRECTION = ("Policy basis requires review.", "Source documents", "Review")


# -- match result ----------------------------------------------------------------------

def matched(result: DataFrame) -> DataFrame:
    return result.where("exception_code = 'matched'")


def probable(result: DataFrame) -> DataFrame:
    return result.where("exception_code = 'probable_match'")


def exceptions(result: DataFrame) -> DataFrame:
    return result.where("exception_code <> 'matched'")


def exception_summary(result: DataFrame, include_matched: bool = False) -> DataFrame:
    """Rows per exception code."""
    rows = result if include_matched else exceptions(result)
    return rows.groupBy(F.coalesce("exception_code", F.lit("unresolved")).alias("exception_code")).agg(
        F.count(F.lit(1)).alias("count")
    )


def run_stats(result: DataFrame) -> DataFrame:
    """Totals, variance and counts of a run, in one pass."""
    def coded(code: str) -> Column:
        return F.count_if(F.col("exception_code") == code)

    totals = [F.coalesce(money(f"amount_{s}"), F.lit(0.0)) for s in "ab"]
    return result.agg(
        F.count(F.lit(1)).alias("rows"), totals[0].alias("total_system_a"), totals[1].alias("total_system_b"),
        coded("matched").alias("matched_exact"), coded("probable_match").alias("matched_fuzzy"),
        coded("missing_in_a").alias("unmatched_a"), coded("missing_in_b").alias("unmatched_b"),
        F.count_if(F.col("exception_code") != "matched").alias("exception_count"),
    ).withColumn("variance", round_half_up(F.col("total_system_a") - F.col("total_system_b"), 2))


def top_exceptions(result: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` exceptions of highest priority, for a preview."""
    return exceptions(result).orderBy(F.desc("priority_rank"), "row_id_a", "row_id_b").limit(n).select(
        F.coalesce("txn_date_a", "txn_date_b").alias("txn_date"), "amount_a", "amount_b", "amount_c",
        "exception_label", "exception_code", "confidence_score", "severity", "date_delta_days", "present_in_c",
        "priority_rank",
    )


# -- remittance schedule ---------------------------------------------------------------

def _variance() -> Column:
    return round_half_up(F.col("payroll_total") - F.coalesce("deposit_total", F.lit(0.0)), 2)


def schedule_report(schedule: DataFrame) -> DataFrame:
    return schedule.select(*SCHEDULE_COLUMNS).withColumns({
        "pay_date": date_text(F.col("pay_date")), "matched_deposit_date": date_text(F.col("matched_deposit_date")),
    })


def timeliness_report(schedule: DataFrame, threshold_days: int = LATE_THRESHOLD) -> DataFrame:
    return schedule.where("late_flag = 'Yes'").select(
        date_text(F.col("pay_date")).alias("pay_date"), "payroll_total",
        date_text(F.col("matched_deposit_date")).alias("deposit_date"), "days_to_deposit",
        F.lit(threshold_days).alias("threshold_days"),
        (F.col("days_to_deposit") - threshold_days).alias("days_over_threshold"), "exception_type",
    )


def exception_log(schedule: DataFrame) -> DataFrame:
    rows = schedule.where("exception_type <> 'None'").withColumn("variance", _variance())
    return rows.withColumn("pay_date", date_text(F.col("pay_date"))).select(*EXCEPTION_LOG)


def audit_workpaper(schedule: DataFrame) -> DataFrame:
    rows = schedule.where("exception_type <> 'None'").withColumn("variance", _variance())
    return rows.withColumn("pay_date", date_text(F.col("pay_date"))).select(*WORKPAPER)


def simple_exception_log(simple: DataFrame) -> DataFrame:
    """The oldest log: partial and missing rows of the seven-column schedule only."""
    return simple.where("match_status in ('Partial', 'Missing')").select(
        date_text(F.col("pay_date")).alias("pay_date"), "payroll_total",
        date_text(F.col("matched_deposit_date")).alias("matched_deposit_date"), "matched_deposit_amount",
        round_half_up(F.col("payroll_total") - F.coalesce("matched_deposit_amount", F.lit(0.0)), 2).alias("variance"),
        "match_status", "days_to_deposit", "late_flag",
    )


def simple_status_counts(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if(F.col("match_status") == "Missing").alias("missing"),
        F.count_if(F.col("match_status") == "Partial").alias("partial"),
        F.count_if(F.col("late_flag") == "Yes").alias("late"),
    )


def case_summary(schedule: DataFrame) -> DataFrame:
    """Periods, exceptions, late deposits and totals of a case."""
    return schedule.agg(
        F.count(F.lit(1)).alias("pay_periods"),
        F.count_if(F.col("exception_type") != "None").alias("exceptions"),
        F.count_if(F.col("late_flag") == "Yes").alias("late_deposits"),
        F.coalesce(money("payroll_total"), F.lit(0.0)).alias("total_payroll"),
        F.coalesce(money("deposit_total"), F.lit(0.0)).alias("total_deposited"),
    ).withColumn("variance", round_half_up(F.col("total_payroll") - F.col("total_deposited"), 2))


def _correction(position: int) -> Column:
    chain = F
    for kind, row in CORRECTIONS.items():
        chain = chain.when(F.col("exception_type") == kind, F.lit(row[position]))
    return chain.otherwise(F.lit(OTHER_CORRECTION[position]))


def correction_packet_index(schedule: DataFrame, as_of: str) -> DataFrame:
    """Numbered list of critical rows with the wording each needs; ``as_of`` is the issue date."""
    critical = with_dense_index(schedule.where("severity = 'CRITICAL'"), ["pay_date"], "n")
    number = (F.col("n") + 1).cast("string")
    return critical.select(
        F.concat(F.lit("CP-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("case_id"),
        date_text(F.col("pay_date")).alias("pay_date"), "exception_type", "severity", "principal_at_risk",
        "days_late_adjusted", "lost_earnings_estimate", _correction(0).alias("regulatory_basis"),
        _correction(2).alias("correction_required"), _correction(1).alias("documents_needed"),
        F.lit("Process Owner").alias("next_action_owner"), F.lit(as_of).alias("generated_on"),
    )


def _evidence(rows: DataFrame, date: str, amount: str, section: int, prefix: str, kind: str, source: str,
              relevance: str) -> DataFrame:
    return rows.groupBy("source_file").agg(
        F.concat_ws(" to ", F.date_format(F.min(date), "yyyy-MM-dd"), F.date_format(F.max(date), "yyyy-MM-dd"))
        .alias("date_range"),
        F.count(F.lit(1)).alias("record_count"), money(amount).alias("total_amount"),
    ).select(
        F.lit(section).alias("section"), F.lit(prefix).alias("prefix"), F.col("source_file").alias("document_name"),
        F.lit(kind).alias("document_type"), F.lit(source).alias("source"), "date_range", "record_count",
        "total_amount", F.lit(relevance).alias("relevance"),
    )


def evidence_index(
    payroll: DataFrame, deposits: DataFrame, schedule: DataFrame, as_of: str, filter_summary: DataFrame | None = None
) -> DataFrame:
    """One row per source document, numbered across the sections; one row per file, never per record."""
    rows = _evidence(
        payroll, "pay_date", "deferral_amount", 1, "PAY", "Payroll Export", "Payroll System",
        "Primary source for contribution calculations",
    ).unionByName(_evidence(
        deposits, "deposit_date", "deposit_amount", 2, "DEP", "Bank/Trust Statement", "Bank/Custodian",
        "Verification of deposit timing and amounts",
    )).unionByName(_evidence(
        schedule.withColumn("source_file", F.lit("remittance_schedule.csv")), "pay_date", "payroll_total", 3, "REM",
        "Reconciliation Report", "Remittance Engine", "Reconciliation of payroll to deposits",
    ))
    if filter_summary is None:
        counted = rows.withColumns({
            "rows_kept": F.when(F.col("section") == 2, F.col("record_count")),
            "rows_excluded": F.when(F.col("section") == 2, F.lit(0).cast("long")),
        })
    else:
        counted = rows.join(
            filter_summary.select(F.lit(2).alias("section"), F.col("source_file").alias("document_name"),
                                  "rows_kept", "rows_excluded"),
            ["section", "document_name"], "left",
        )
    numbered = with_dense_index(counted, ["section", "document_name"], "n")
    number = (F.col("n") + 1).cast("string")
    return numbered.select(
        F.concat("prefix", F.lit("-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
        .alias("evidence_id"),
        "document_name", "document_type", "source", "date_range", "record_count", "total_amount", "rows_kept",
        "rows_excluded", "relevance", F.lit(as_of).alias("date_created"),
    )


def trace_components(schedule: DataFrame, payroll: DataFrame, deposits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payroll rows and deposits behind every row that needs review, keyed by ``case_date``.

    Payroll rows follow from the pay date, so no id list is split or shuffled; deposits
    follow from the listed ids.
    """
    review = schedule.where("review_required = 'YES'")
    case = F.date_format("pay_date", "yyyy-MM-dd")
    # one line per pay date, stored so that its true size decides the join
    dates = materialize(review.select("pay_date"), "review-dates")
    paid = payroll.join(dates, "pay_date", "left_semi").select(
        case.alias("case_date"), "employee_id", "pay_date", "deferral_amount", "source_file", "payroll_row_id"
    )
    wanted = materialize(review.select(
        case.alias("case_date"), F.explode(component_list(F.col("deposit_component_ids"))).alias("deposit_row_id")
    ), "review-deposits")
    received = deposits.join(wanted, "deposit_row_id").select(
        "case_date", "deposit_id", "deposit_date", "deposit_amount", "source_file", "deposit_row_id"
    )
    return paid, received


def trace_summaries(schedule: DataFrame) -> DataFrame:
    """The text sheet of every row that needs review."""
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("None")))

    def amount(value: Column) -> Column:
        # plain digits at any size, one decimal at least
        return F.regexp_replace(value.cast("decimal(20,2)").cast("string"), "0$", "")

    late_days = F.when(F.col("late_flag") == "Yes", F.col("days_to_deposit")).otherwise(F.lit(0))
    lines = [
        line("Pay date", date_text(F.col("pay_date"))), line("Payroll total", amount(F.col("payroll_total"))),
        line("Deposit total", amount(F.col("deposit_total"))), line("Variance", amount(_variance())),
        line("Exception type", F.col("exception_type")), line("Severity", F.col("severity")),
        line("Days late", late_days), line("Recommended action", F.col("recommended_action")),
        line("Payroll source files", F.col("payroll_source_files")),
        line("Deposit source files", F.col("deposit_source_files")),
    ]
    return schedule.where("review_required = 'YES'").select(
        F.date_format("pay_date", "yyyy-MM-dd").alias("case_date"), F.concat_ws("\n", *lines).alias("summary")
    )
