"""Schedules and reports against known cases, restated as literals."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgermill.operators.deposits import nearest_later_deposit
from ledgermill.operators.normalize import normalize_deposits, normalize_payroll
from ledgermill.operators.remittance import component_ids, remittance_schedule, simple_schedule
from ledgermill.operators.threeway import posting_exceptions, three_way_schedule, validation_failures
from ledgermill.plans import reports as R

PAYROLL = [
    ("E100", "2025-01-10", "100.00"), ("E101", "01/10/2025", "150.00"), ("E102", "2025-01-10", "200.00"),
    ("E103", "2025-01-24", "120.00"), ("E104", "2025-01-24", "130.00"), ("E105", "2025-02-07", "300.00"),
    ("E106", "2025-02-21", "180.00"), ("E107", "2025-03-07", "210.00"),
]
BANK = [("D001", "2025-01-14", "450.00"), ("D002", "2025-01-30", "200.00"), ("D003", "2025-02-14", "300.00"),
        ("D004", "2025-02-25", "180.00")]
# pay date, total, deposit, days, status, confidence, late, type, principal, days late, earnings
EXPECTED = [
    ("2025-01-10", 450.0, 450.0, 2, "Exact", 1.0, "No", "None", None, None, None),
    ("2025-01-24", 250.0, 200.0, 4, "Missing", 0.0, "Yes", "Missing Deposit", 250.0, 1, 0.03),
    ("2025-02-07", 300.0, 300.0, 5, "Exact", 1.0, "Yes", "Late Deposit", 300.0, 2, 0.08),
    ("2025-02-21", 180.0, 180.0, 2, "Exact", 1.0, "No", "None", None, None, None),
    ("2025-03-07", 210.0, None, None, "Missing", 0.0, None, "Missing Deposit", 210.0, 0, 0.0),
]
# the larger case: totals per pay date and the bank lines that are deposits
TOTALS = [("2025-10-10", 4122.5), ("2025-10-24", 4392.5), ("2025-11-07", 4680.0), ("2025-11-21", 4667.5)]
STATEMENT = [
    ("10/13/2025", "ACH DEBIT", "CHECK DEPOSIT 2142", "43.50", "CHK2142"),
    ("10/14/2025", "ACH CREDIT", "Employee 401k Deferral Deposit", "4305.00", "DEP001"),
    ("10/15/2025", "WIRE TRANSFER", "Wire to State Street Trust Account", "100000.00", "WIRE789"),
    ("10/16/2025", "ACH DEBIT", "Monthly ACH Transfer Fee", "-15.00", "FEE1"),
    ("10/27/2025", "ACH CREDIT", "Combined Deferral", "4621.50", "DEP002"),
    ("11/14/2025", "ACH CREDIT", "Employee 401k Deferral Deposit - LATE", "4335.00", "DEP003"),
    ("11/26/2025", "ACH CREDIT", "Employee 401k Partial Deferral Deposit", "3125.50", "DEP004"),
]
STATEMENT_EXPECTED = [
    ("2025-10-10", 4305.0, 2, "Partial", 0.557, "No", "Amount Mismatch", 0.0, 0, 0.0),
    ("2025-10-24", 4335.0, 15, "Partial", 0.869, "Yes", "Amount Mismatch", 57.5, 12, 0.09),
    ("2025-11-07", 4335.0, 5, "Partial", 0.263, "Yes", "Amount Mismatch", 345.0, 2, 0.09),
    ("2025-11-21", 3125.5, 3, "Missing", 0.0, "No", "Missing Deposit", 4667.5, 0, 0.0),
]


@pytest.fixture(scope="module")
def case(spark):
    pay = spark.createDataFrame([(*r, "system_a.csv", i + 1) for i, r in enumerate(PAYROLL)],
                                "Emp_ID string, Pay_Date string, `401k_amount` string, source_file string, _row_number long")
    bank = spark.createDataFrame([(*r, "system_b.csv", i + 1) for i, r in enumerate(BANK)],
                                 "Deposit_ID string, transaction_date string, credit_amount string, source_file string, _row_number long")
    payroll, deposits = normalize_payroll(pay), normalize_deposits(bank)
    return payroll.rows, deposits, remittance_schedule(payroll.rows, deposits.rows).cache()


def test_schedule(case):
    rows = case[2].orderBy("pay_date").collect()
    got = [(r.pay_date.strftime("%Y-%m-%d"), r.payroll_total, r.deposit_total, r.days_to_deposit, r.match_status,
            r.match_confidence, r.late_flag, r.exception_type, r.principal_at_risk, r.days_late_adjusted,
            r.lost_earnings_estimate) for r in rows]
    assert got == EXPECTED
    assert rows[0].payroll_component_ids == ", ".join(f"system_a.csv:PAY0000{i}" for i in (1, 2, 3))
    assert [r.deposit_component_ids for r in rows] == [f"system_b.csv:DEP0000{i}" for i in (1, 2, 3, 4)] + [None]
    assert [r.unmatched_payroll_amount for r in rows] == [None, 50.0, None, None, 210.0]
    assert [r.unmatched_deposit_amount for r in rows] == [None, 0.0, None, None, None]
    assert [r.review_reason for r in rows] == [
        "No exception", "Missing deposit", "Late deposit", "No exception", "Missing deposit"]


def test_reports(case):
    payroll, deposits, schedule = case
    assert [tuple(r) for r in R.timeliness_report(schedule).orderBy("pay_date").collect()] == [
        ("2025-01-24", 250.0, "2025-01-30", 4, 3, 1, "Missing Deposit"),
        ("2025-02-07", 300.0, "2025-02-14", 5, 3, 2, "Late Deposit")]
    log = R.exception_log(schedule).orderBy("pay_date").collect()
    assert [(r.pay_date, r.variance, r.severity) for r in log] == [
        ("2025-01-24", 50.0, "CRITICAL"), ("2025-02-07", 0.0, "HIGH"), ("2025-03-07", 210.0, "CRITICAL")]
    assert len(log[0]) == 18 and len(R.audit_workpaper(schedule).columns) == 14
    packet = R.correction_packet_index(schedule, "2026-01-15").orderBy("case_id").collect()
    assert [(r.case_id, r.pay_date, r.generated_on) for r in packet] == [
        ("CP-0001", "2025-01-24", "2026-01-15"), ("CP-0002", "2025-03-07", "2026-01-15")]
    index = R.evidence_index(payroll, deposits.rows, schedule, "2026-01-15", deposits.filter_summary)
    assert [(r.evidence_id, r.date_range, r.record_count, r.total_amount, r.rows_kept, r.rows_excluded)
            for r in index.orderBy("evidence_id").orderBy("document_type").collect()] == [
        ("DEP-002", "2025-01-14 to 2025-02-25", 4, 1130.0, 4, 0),
        ("PAY-001", "2025-01-10 to 2025-03-07", 8, 1390.0, None, None),
        ("REM-003", "2025-01-10 to 2025-03-07", 5, 1390.0, None, None)]
    paid, received = R.trace_components(schedule, payroll, deposits.rows)
    assert sorted(r.employee_id for r in paid.collect()) == ["E103", "E104", "E105", "E107"]
    assert sorted(r.deposit_id for r in received.collect()) == ["D002", "D003"]
    sheet = {r.case_date: r.summary for r in R.trace_summaries(schedule).collect()}["2025-03-07"]
    assert sheet.split("\n")[:4] == ["Pay date: 2025-03-07", "Payroll total: 210.0", "Deposit total: None", "Variance: 210.0"]
    summary = R.case_summary(schedule).first()
    assert (summary.pay_periods, summary.exceptions, summary.late_deposits, summary.variance) == (5, 3, 2, 260.0)


def test_statement_with_noise(spark):
    pay = spark.createDataFrame([("E1", d, str(t), "p.csv", i) for i, (d, t) in enumerate(TOTALS)],
                                "employee_id string, pay_date string, deferral_amount string, source_file string, _row_number long")
    bank = spark.createDataFrame(
        [(*r, "t.csv", i + 1) for i, r in enumerate(STATEMENT)],
        "Transaction_Date string, Transaction_Type string, Description string, Amount string, deposit_id string, source_file string, _row_number long")
    deposits = normalize_deposits(bank)
    assert [(r.deposit_row_id, r.exclusion_reason) for r in deposits.noise.collect()] == [
        ("t.csv:DEP00004", "Excluded: description contains FEE, NSF")]
    rows = remittance_schedule(normalize_payroll(pay).rows, deposits.rows).orderBy("pay_date").collect()
    assert [(r.pay_date.strftime("%Y-%m-%d"), r.deposit_total, r.days_to_deposit, r.match_status, r.match_confidence,
             r.late_flag, r.exception_type, r.principal_at_risk, r.days_late_adjusted, r.lost_earnings_estimate)
            for r in rows] == STATEMENT_EXPECTED


def test_nearest_deposit_by_brute_force(spark):
    r = random.Random(3)
    start = dt.datetime(2023, 11, 20)
    stamp = lambda: start + dt.timedelta(days=r.randrange(500), hours=r.choice([0, 0, 9]))
    deposits = [(stamp(), round(r.uniform(-20, 400), r.choice([0, 2])), f"f{r.randrange(2)}.csv", f"d{i}") for i in range(300)]
    totals = {stamp(): round(r.uniform(-20, 400), r.choice([0, 2])) for _ in range(80)}
    got = nearest_later_deposit(
        spark.createDataFrame(list(totals.items()), "pay_date timestamp_ntz, payroll_total double"),
        spark.createDataFrame(deposits, "deposit_date timestamp_ntz, deposit_amount double, source_file string, deposit_row_id string"))
    want = {}
    for pay, total in totals.items():
        later = [(abs(a - total), d, f, len(i), i) for d, a, f, i in deposits if d >= pay]
        if later:
            want[pay] = min(later)[4]
    assert {x.pay_date: x.deposit_row_id for x in got.collect()} == want


def test_older_schedule_and_components(case):
    payroll, deposits, _ = case
    rows = simple_schedule(payroll, deposits.rows).orderBy("pay_date")
    assert [(r.match_status, r.late_flag) for r in rows.collect()] == [
        ("Matched", "No"), ("Missing", "Yes"), ("Matched", "Yes"), ("Matched", "No"), ("Missing", "No")]
    counts = R.simple_status_counts(R.simple_exception_log(rows)).first()
    assert tuple(counts) == (2, 0, 1)
    assert component_ids(payroll).count() == 5


def test_a_day_of_many_rows_lists_every_id(spark):
    rows = spark.range(12_345).select(
        F.lit("E").alias("employee_id"), F.lit("2025-01-10").cast("timestamp_ntz").alias("pay_date"), F.lit(1.0).alias("deferral_amount"),
        F.lit("p.csv").alias("source_file"), F.concat(F.lit("p.csv:PAY"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("payroll_row_id"))
    other = rows.limit(3).withColumn("pay_date", F.lit("2025-02-10").cast("timestamp_ntz"))
    found = {r.pay_date.month: r.payroll_component_ids for r in component_ids(rows.unionAll(other)).collect()}
    assert found[1] == ", ".join(f"p.csv:PAY{i:05d}" for i in range(12_345)) and found[2].count(",") == 2


def test_three_way(spark, case):
    payroll, deposits, schedule = case
    day = dt.datetime(2025, 1, 15)
    postings = spark.createDataFrame(
        [("E100", day, 100.0), ("E101", day, 149.0), ("E102", day, 200.0), ("E102", day, 200.0), ("E999", day, 5.0)],
        "employee_id string, post_date timestamp_ntz, posted_amount double")
    found = {(r.employee_id, r.period.month): r.finding for r in posting_exceptions(payroll, postings).collect()}
    assert found == {
        ("E101", 1): "Amount Difference", ("E102", 1): "Duplicate Posting", ("E999", 1): "Unexpected Posting",
        ("E103", 1): "Missing Posting", ("E104", 1): "Missing Posting", ("E105", 2): "Missing Posting",
        ("E106", 2): "Missing Posting", ("E107", 3): "Missing Posting"}
    months = three_way_schedule(payroll, deposits.rows, postings).where("period_start = '2025-01-01'").collect()
    assert {(r.source_system, r.target_system): r.variance for r in months} == {
        ("Payroll", "Trust"): 50.0, ("Trust", "Recordkeeper"): -4.0, ("Payroll", "Recordkeeper"): 46.0}
    rules = validation_failures(payroll, deposits.rows, postings, schedule, limit=250.0)
    seen = {(r.rule_id, r.subject) for r in rules.collect()}
    assert ("V002", "2025-01-24") in seen and ("V003", "E999") in seen and ("V004", "E105 2025") in seen


def test_deposits_are_walked_once_a_side(spark, monkeypatch):
    """Hot amounts, many instants: as many rows as go in, whatever the history; and what a range cannot answer is found."""
    from ledgermill.operators import deposits as module
    kept, sizes = module.materialize, {}

    def counted(df, label):
        df = kept(df, label)
        sizes[label] = df.count()
        return df

    monkeypatch.setattr(module, "materialize", counted)
    r, start = random.Random(5), dt.datetime(2024, 1, 1)
    stamp = lambda: start + dt.timedelta(minutes=r.randrange(200_000))
    deposits = [(stamp(), r.choice([None, 0.0, -0.0, 25.0, 25.0, 25.0, round(r.uniform(-50, 90), 2)]), "f.csv", f"d{i}") for i in range(1500)]
    totals = {stamp(): r.choice([None, 25.0, round(r.uniform(-90, 200), 2)]) for _ in range(700)}
    got = nearest_later_deposit(
        spark.createDataFrame(list(totals.items()), "pay_date timestamp_ntz, payroll_total double"),
        spark.createDataFrame(deposits, "deposit_date timestamp_ntz, deposit_amount double, source_file string, deposit_row_id string"))
    want = {}
    for pay, total in totals.items():
        later = [(abs(a - total), d, f, len(i), i) for d, a, f, i in deposits if d >= pay and None not in (a, total)]
        if later:
            want[pay] = min(later)[4]
    assert {x.pay_date: x.deposit_row_id for x in got.collect()} == want
    assert sizes["swept"] <= 2 * (len(deposits) + len(totals)) and sizes["neighbours"] <= 2 * len(totals)


def test_a_schedule_parses_its_payroll_once(spark, case):
    read = spark.sparkContext.accumulator(0)

    def seen(amount):
        read.add(1)
        return amount

    payroll, deposits, _ = case
    counted = payroll.withColumn("deferral_amount", F.udf(seen, "double").asNondeterministic()("deferral_amount"))
    assert remittance_schedule(counted, deposits.rows).count() == len(EXPECTED)
    assert read.value == payroll.count()
