"""Payroll totals, their deposits, lateness, review fields and amounts at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.calendar import add_business_days, business_days_between, is_late_deposit
from ledgermill.functions.scoring import round_half_up
from ledgermill.operators.deposits import nearest_later_deposit
from ledgermill.operators.prefix import with_dense_index
from ledgermill.schemas import SCHEDULE_COLUMNS
from ledgermill.session import materialize, stored

PARTIAL_LIMIT = 0.10
LOW_CONFIDENCE = 0.90
ANNUAL_RATE = 0.05
LATE_THRESHOLD = 3
# Ids that are joined to text at once; cells are put together from such pieces.
TEXT_PIECE = 1_000

# Review fields by exception type.
REVIEW = {
    "None": ("NO", "No exception", "NONE", "No action"),
    "Late Deposit": ("YES", "Late deposit", "HIGH", "Calculate lost earnings"),
    "Amount Mismatch": ("YES", "Partial deposit", "CRITICAL", "Request deposit proof"),
    "Missing Deposit": ("YES", "Missing deposit", "CRITICAL", "Request deposit proof"),
}


def money(column: str) -> Column:
    """Exact sum of cents, as a double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def payroll_totals(payroll: DataFrame) -> DataFrame:
    """Total, row count and source files per pay date."""
    return payroll.groupBy("pay_date").agg(
        money("deferral_amount").alias("payroll_total"),
        F.count(F.lit(1)).alias("payroll_rows"),
        F.array_join(F.array_sort(F.collect_set("source_file")), ", ").alias("payroll_source_files"),
    )


def components(payroll: DataFrame) -> DataFrame:
    """Long form: ``pay_date, position, payroll_row_id``, positions running on over all pay dates in row order."""
    entries = payroll.select("pay_date", "source_file", F.length("payroll_row_id").alias("digits"), "payroll_row_id")
    order = ["pay_date", "source_file", "digits", "payroll_row_id"]
    return with_dense_index(entries, order, "position").select("pay_date", "position", "payroll_row_id")


def component_ids(payroll: DataFrame) -> DataFrame:
    """Component ids per pay date in row order, as text: one form at every size.

    Rows are numbered by one range shuffle, pieces of ``TEXT_PIECE`` ids become text, and a
    cell is its pieces in order. No task sorts the rows of a day; the cell itself is as long
    as its day.
    """
    piece = F.floor(F.col("position") / TEXT_PIECE).alias("piece")
    pieces = components(payroll).groupBy("pay_date", piece).agg(
        F.array_sort(F.collect_list(F.struct("position", "payroll_row_id"))).alias("e")
    ).select("pay_date", F.struct("piece", F.array_join(F.col("e.payroll_row_id"), ", ").alias("text")).alias("part"))
    cells = pieces.groupBy("pay_date").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return cells.select("pay_date", F.array_join(F.col("parts.text"), ", ").alias("payroll_component_ids"))


def match_grade(total: Column, amount: Column, tolerance: float = 0.01) -> tuple[Column, Column]:
    """Status and confidence of a deposit against a payroll total.

    The relative gap is taken against the size of the total, so a negative total cannot
    turn a large gap into a good match.
    """
    gap = F.abs(total - amount)
    share = gap / F.abs(total)
    known = total.isNotNull() & amount.isNotNull() & (total != 0)
    exact, partial = known & (gap <= tolerance), known & (share <= PARTIAL_LIMIT)
    status = F.when(exact, F.lit("Exact")).when(partial, F.lit("Partial")).otherwise(F.lit("Missing"))
    confidence = (
        F.when(exact, F.lit(1.0)).when(partial, F.lit(1.0) - share / F.lit(PARTIAL_LIMIT)).otherwise(F.lit(0.0))
    )
    return status, confidence


def exception_type(status: Column, late: Column) -> Column:
    return (
        F.when(status == "Missing", F.lit("Missing Deposit"))
        .when(status == "Partial", F.lit("Amount Mismatch"))
        .when(F.coalesce(late, F.lit(False)), F.lit("Late Deposit"))
        .otherwise(F.lit("None"))
    )


def earlier_review_fields(confidence: Column, kind: Column, late_flag: Column, deposit: Column) -> tuple[Column, Column]:
    """Review fields of the first engine version: every reason that applies, comma-joined."""
    low = F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(low, F.lit("Low confidence match")),
        F.when(late_flag == "Yes", F.lit("Late deposit")),
        F.when(kind.contains("Mismatch"), F.lit("Amount mismatch")),
        F.when(F.coalesce(deposit, F.lit(0.0)) == 0, F.lit("Missing deposit")),
    ))
    return F.when(low | (kind != "None"), F.lit("YES")).otherwise(F.lit("NO")), F.array_join(reasons, ", ")


def _review(kind: Column, position: int) -> Column:
    chain = F
    for name, row in REVIEW.items():
        chain = chain.when(kind == name, F.lit(row[position]))
    return chain.otherwise(F.lit(None).cast("string"))


def remittance_schedule(
    payroll: DataFrame,
    deposits: DataFrame,
    late_threshold_days: int = LATE_THRESHOLD,
    annual_rate: float = ANNUAL_RATE,
    tolerance: float = 0.01,
    review_style: str = "v2",
) -> DataFrame:
    """One row per pay date: its nearest deposit, timeliness, review and amounts at risk.

    ``review_style="v1"`` keeps the first version's review texts and has no severity or
    recommended action.
    """
    # what several steps read is parsed and computed once
    payroll, deposits = stored(payroll, "payroll"), stored(deposits, "deposits")
    totals = materialize(payroll_totals(payroll), "payroll-totals")
    chosen = materialize(nearest_later_deposit(totals, deposits), "chosen")
    # files of every deposit that equals the chosen one in date and amount
    files = chosen.select("pay_date", "deposit_date", "deposit_amount").join(
        deposits.select("deposit_date", "deposit_amount", "source_file"), ["deposit_date", "deposit_amount"]
    ).groupBy("pay_date").agg(
        F.array_join(F.array_sort(F.collect_set("source_file")), ", ").alias("deposit_source_files")
    )
    rows = (
        totals.join(chosen, "pay_date", "left").join(files, "pay_date", "left")
        .join(component_ids(payroll), "pay_date", "left")
    )
    total, deposit = F.col("payroll_total"), F.col("deposit_amount")
    status, confidence = match_grade(total, deposit, tolerance)
    late = is_late_deposit(F.col("pay_date"), F.col("deposit_date"), late_threshold_days)
    rows = rows.withColumns({
        "payroll_total": round_half_up(total, 2),
        "deposit_total": F.when(deposit != 0, round_half_up(deposit, 2)),
        "matched_deposit_date": F.col("deposit_date"),
        "days_to_deposit": business_days_between(F.col("pay_date"), F.col("deposit_date")),
        "match_status": status,
        "raw_confidence": confidence,
        "late_flag": F.when(late, F.lit("Yes")).when(~late, F.lit("No")),
        "exception_type": exception_type(status, late),
        "deposit_component_ids": F.col("deposit_row_id"),
    })
    kind = F.col("exception_type")
    none, exact = kind == "None", F.col("match_status") == "Exact"
    short = F.greatest(total - F.coalesce("deposit_total", F.lit(0.0)), F.lit(0.0))
    over = F.when(F.col("deposit_total").isNotNull(), F.greatest(F.col("deposit_total") - total, F.lit(0.0)))
    if review_style == "v1":
        required, reason = earlier_review_fields(
            F.col("raw_confidence"), kind, F.col("late_flag"), F.col("deposit_total"))
        severity = action = F.lit(None).cast("string")
    else:
        required, reason, severity, action = (_review(kind, i) for i in range(4))
    rows = rows.withColumns({
        "match_confidence": round_half_up(F.col("raw_confidence"), 3),
        "review_required": required, "review_reason": reason, "severity": severity, "recommended_action": action,
        "unmatched_payroll_amount": F.when(~exact, round_half_up(short, 2)),
        "unmatched_deposit_amount": F.when(~exact, round_half_up(over, 2)),
    })
    return with_lost_earnings(rows, late_threshold_days, annual_rate).select(*SCHEDULE_COLUMNS)


def with_lost_earnings(rows: DataFrame, late_threshold_days: int, annual_rate: float) -> DataFrame:
    """Principal at risk, late days beyond the threshold and simple interest on them."""
    kind = F.col("exception_type")
    affected = kind != "None"
    principal = F.when(kind.isin("Missing Deposit", "Late Deposit"), F.col("payroll_total")).when(
        kind == "Amount Mismatch", F.col("unmatched_payroll_amount"))
    days = F.greatest(F.coalesce("days_to_deposit", F.lit(0)) - late_threshold_days, F.lit(0))
    earned = round_half_up(principal * F.lit(annual_rate) / F.lit(365.0) * days, 2)
    return rows.withColumns({
        "principal_at_risk": principal,
        "days_late_adjusted": F.when(affected, days),
        "assumed_annual_rate": F.when(affected, F.lit(annual_rate)),
        "lost_earnings_estimate": F.when(affected, earned),
    })


def simple_schedule(payroll: DataFrame, deposits: DataFrame, late_threshold_days: int = LATE_THRESHOLD) -> DataFrame:
    """The oldest schedule: seven columns, ``Matched/Partial/Missing``, unknown lateness is ``No``."""
    totals = payroll_totals(payroll)
    rows = totals.join(nearest_later_deposit(totals, deposits), "pay_date", "left")
    total, deposit = F.col("payroll_total"), F.col("deposit_amount")
    gap, days = F.abs(deposit - total), business_days_between(F.col("pay_date"), F.col("deposit_date"))
    status = (
        F.when(gap <= 0.01, F.lit("Matched")).when(gap <= total * PARTIAL_LIMIT, F.lit("Partial"))
        .otherwise(F.lit("Missing"))
    )
    return rows.select(
        "pay_date", round_half_up(total, 2).alias("payroll_total"), F.col("deposit_date").alias("matched_deposit_date"),
        F.when(deposit != 0, round_half_up(deposit, 2)).alias("matched_deposit_amount"),
        days.alias("days_to_deposit"), status.alias("match_status"),
        F.when(days > late_threshold_days, F.lit("Yes")).otherwise(F.lit("No")).alias("late_flag"),
    )


def required_deposit_dates(schedule: DataFrame, business_days: int = 7) -> DataFrame:
    """Required deposit date (pay date plus business days) and days late against it."""
    due = add_business_days(F.col("pay_date"), business_days)
    return schedule.select(
        "pay_date", "matched_deposit_date", due.alias("required_deposit_date"),
        business_days_between(due, F.col("matched_deposit_date")).alias("days_past_required"),
    )
