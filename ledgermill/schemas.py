"""Fixed schemas of the canonical tables and of the match result."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION_COLUMNS = ["txn_date", "txn_amount", "description", "reference", "source_file", "row_id"]

TRANSACTION = T.StructType([
    T.StructField("txn_date", T.TimestampNTZType()),
    T.StructField("txn_amount", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("row_id", T.StringType()),
])

PAYROLL = T.StructType([
    T.StructField("employee_id", T.StringType()),
    T.StructField("pay_date", T.TimestampNTZType()),
    T.StructField("deferral_amount", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("payroll_row_id", T.StringType()),
])

DEPOSIT = T.StructType([
    T.StructField("deposit_id", T.StringType()),
    T.StructField("deposit_date", T.TimestampNTZType()),
    T.StructField("deposit_amount", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("deposit_row_id", T.StringType()),
])

POSTING = T.StructType([
    T.StructField("employee_id", T.StringType()),
    T.StructField("post_date", T.TimestampNTZType()),
    T.StructField("posted_amount", T.DoubleType()),
])


def _side(side: str) -> list[T.StructField]:
    return [T.StructField(f"{f.name}_{side}", f.dataType) for f in TRANSACTION.fields]


MATCH_RESULT = T.StructType(_side("a") + _side("b") + [
    T.StructField("date_delta_days", T.IntegerType()),
    T.StructField("amount_delta", T.DoubleType()),
    T.StructField("match_status", T.StringType()),
    T.StructField("exception_type", T.StringType()),
    T.StructField("candidate_count_a", T.LongType()),
    T.StructField("candidate_count_b", T.LongType()),
    T.StructField("duplicate_in_a", T.BooleanType()),
    T.StructField("duplicate_in_b", T.BooleanType()),
    T.StructField("present_in_a", T.BooleanType()),
    T.StructField("present_in_b", T.BooleanType()),
    T.StructField("present_in_c", T.BooleanType()),
    T.StructField("amount_a", T.DoubleType()),
    T.StructField("amount_b", T.DoubleType()),
    T.StructField("amount_c", T.DoubleType()),
    T.StructField("source_c_file", T.StringType()),
    T.StructField("source_c_row_id", T.StringType()),
    T.StructField("exception_code", T.StringType()),
    T.StructField("exception_label", T.StringType()),
    T.StructField("exception_reason", T.StringType()),
    T.StructField("suggested_action", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("priority_rank", T.DoubleType()),
])

SCHEDULE_COLUMNS = [
    "pay_date", "payroll_total", "deposit_total", "matched_deposit_date", "days_to_deposit",
    "match_status", "match_confidence", "late_flag", "exception_type", "review_required",
    "review_reason", "severity", "recommended_action", "payroll_source_files",
    "deposit_source_files", "payroll_component_ids", "deposit_component_ids",
    "unmatched_payroll_amount", "unmatched_deposit_amount", "principal_at_risk",
    "days_late_adjusted", "assumed_annual_rate", "lost_earnings_estimate",
]
