"""Checks between payroll, deposits and participant postings, by participant and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.scoring import round_half_up
from ledgermill.operators.remittance import money

CENT = 0.01


def by_participant(payroll: DataFrame, postings: DataFrame) -> DataFrame:
    """Payroll and posted totals per employee and month, full outer."""
    paid = payroll.groupBy("employee_id", F.date_trunc("month", "pay_date").cast("date").alias("period")).agg(
        money("deferral_amount").alias("payroll_amount"), F.count(F.lit(1)).alias("payroll_rows"))
    posted = postings.groupBy("employee_id", F.date_trunc("month", "post_date").cast("date").alias("period")).agg(
        money("posted_amount").alias("posted_amount"), F.count(F.lit(1)).alias("posting_rows"))
    return paid.join(posted, ["employee_id", "period"], "full_outer")


def posting_exceptions(payroll: DataFrame, postings: DataFrame) -> DataFrame:
    """Employee periods that are not posted, posted without payroll, posted more often, or differ."""
    both = by_participant(payroll, postings)
    gap = F.coalesce("payroll_amount", F.lit(0.0)) - F.coalesce("posted_amount", F.lit(0.0))
    kind = (
        F.when(F.col("posting_rows").isNull(), F.lit("Missing Posting"))
        .when(F.col("payroll_rows").isNull(), F.lit("Unexpected Posting"))
        .when(F.col("posting_rows") > F.col("payroll_rows"), F.lit("Duplicate Posting"))
        .when(F.abs(gap) > CENT, F.lit("Amount Difference"))
    )
    return both.withColumns({"finding": kind, "variance": round_half_up(gap, 2)}).where(F.col("finding").isNotNull()).select(
        "employee_id", "period", "payroll_amount", "posted_amount", "payroll_rows", "posting_rows", "variance", "finding"
    )


def three_way_schedule(payroll: DataFrame, deposits: DataFrame, postings: DataFrame) -> DataFrame:
    """Totals per month compared pairwise: payroll to deposits, deposits to postings, payroll to postings."""
    systems = {
        "Payroll": (payroll, "pay_date", "deferral_amount"),
        "Trust": (deposits, "deposit_date", "deposit_amount"),
        "Recordkeeper": (postings, "post_date", "posted_amount"),
    }
    rows = None
    for name, (df, date, amount) in systems.items():
        part = df.select(
            F.date_trunc("month", date).cast("date").alias("period_start"), F.lit(name).alias("system"),
            F.col(amount).alias("amount"),
        )
        rows = part if rows is None else rows.unionAll(part)
    # one aggregate for the three systems instead of three joined ones
    sums = [
        F.sum(F.when(F.col("system") == s, F.col("amount")).cast("decimal(18,2)")).cast("double").alias(s) for s in systems
    ]
    totals = rows.groupBy("period_start").agg(*sums)
    pairs = [("Payroll", "Trust"), ("Trust", "Recordkeeper"), ("Payroll", "Recordkeeper")]
    compared = F.explode(F.array(*[
        F.struct(F.lit(f"{s} to {t}").alias("reconciliation_type"), F.lit(s).alias("source_system"),
                 F.coalesce(s, F.lit(0.0)).alias("source_amount"), F.lit(t).alias("target_system"),
                 F.coalesce(t, F.lit(0.0)).alias("target_amount"))
        for s, t in pairs
    ])).alias("c")
    variance = round_half_up(F.col("source_amount") - F.col("target_amount"), 2)
    return totals.select("period_start", compared).select("period_start", "c.*").withColumns({
        "variance": variance,
        "variance_percent": F.when(F.col("source_amount") != 0, round_half_up(variance / F.col("source_amount") * 100, 2)),
        "reconciled_status": F.when(F.abs(variance) <= CENT, F.lit("Reconciled")).otherwise(F.lit("Variance")),
    })


def validation_failures(
    payroll: DataFrame, deposits: DataFrame, postings: DataFrame, schedule: DataFrame, limit: float, late_days: int = 3
) -> DataFrame:
    """One row per broken rule: V001 totals, V002 timing, V003 ids, V004 limits."""
    def failures(rule: str, df: DataFrame, key, amount) -> DataFrame:
        return df.select(F.lit(rule).alias("rule_id"), key.cast("string").alias("subject"), amount.alias("amount"))

    months = three_way_schedule(payroll, deposits, postings).where("reconciled_status = 'Variance'")
    totals = failures("V001", months, F.concat_ws(" ", F.col("period_start").cast("string"), "reconciliation_type"),
                      F.col("variance"))
    timing = failures("V002", schedule.where(F.col("days_to_deposit") > late_days),
                      F.date_format("pay_date", "yyyy-MM-dd"), F.col("days_to_deposit").cast("double"))
    ids = payroll.select("employee_id", F.lit(1).alias("paid"), F.lit(0).alias("posted")).unionAll(
        postings.select("employee_id", F.lit(0).alias("paid"), F.lit(1).alias("posted"))
    ).groupBy("employee_id").agg(F.max("paid").alias("paid"), F.max("posted").alias("posted"))
    unknown = failures("V003", ids.where("paid + posted = 1"), F.col("employee_id"),
                       (F.col("paid") - F.col("posted")).cast("double"))
    per_year = payroll.groupBy("employee_id", F.year("pay_date").alias("y")).agg(money("deferral_amount").alias("total"))
    over = failures("V004", per_year.where(F.col("total") > limit),
                    F.concat_ws(" ", "employee_id", F.col("y").cast("string")), F.col("total"))
    return totals.unionAll(timing).unionAll(unknown).unionAll(over)
