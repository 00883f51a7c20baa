import csv
import datetime as dt
import io
import random
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgermill.functions.calendar import add_business_days, business_days_between
from ledgermill.functions.parsing import component_list, matched_keywords, parse_amount, parse_date
from ledgermill.operators.normalize import (
    apply_column_aliases, best_parseable_column, flag_deposits, load_system, normalize_deposits, normalize_payroll,
    normalize_transactions,
)
from ledgermill.plans.outputs import reconcile_exports, reconcile_files, run_case, write_match_outputs, evidence_manifest, run_metadata, case_manifest, scan_facts
from ledgermill.operators.quality import quality_issues
from ledgermill.plans.reports import run_stats
from ledgermill.sources.csv import read_export, read_exports
from ledgermill.sources.headers import TRANSACTION_ALIASES, resolve_transaction_headers
from ledgermill.sources.inventory import file_inventory
from ledgermill.sources.records import ends_inside


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_dates(spark):
    d = lambda *a: dt.datetime(*a)
    texts = {
        "2024-01-15": d(2024, 1, 15), "2024/1/5": d(2024, 1, 5), "01/29/2024": d(2024, 1, 29),
        "29/01/2024": d(2024, 1, 29), "06-Jan-2025": d(2025, 1, 6), "6 January 2025": d(2025, 1, 6),
        "Mar 3 2025": d(2025, 3, 3), "March 3, 2025": d(2025, 3, 3), "20250303": d(2025, 3, 3),
        "2024-01-15 13:45:10": d(2024, 1, 15, 13, 45, 10), "2024-01-15T13:45": d(2024, 1, 15, 13, 45),
        "2024-02-31": None, "32/13/2024": None, "soon": None, "": None, None: None, "06-Xyz-2025": None,
    }
    assert one(spark, parse_date, list(texts)) == list(texts.values())


def test_two_digit_years_halves_zones_and_weekdays(spark):
    """The reading of the common date library, with the zone dropped and the time as written."""
    from dateutil import parser

    dates = ["01/15/24", "1/2/24", "13/01/24", "24-12-31", "15-Jan-24", "Jan 15, 24", "31/12/68", "12.25.24", "2024.01.15", "45-Jan-12"]
    times = ["", " 10:00", "T10:00:05Z", " 10:00:05.25+02:00", " 3:05 PM", " 12:00 AM", " 12:30pm", " 1:02:03 a.m.", " 10:00 UTC"]
    texts = [w + d + t for d in dates for t in times for w in ("", "Mon, ", "Tuesday ")]
    texts += ["Mon, 15 Jan 2024", "2024-01-15T10:00:00-0500", "1/15/2024 3:05 PM"]
    want = [parser.parse(t, dayfirst=False, yearfirst=True).replace(tzinfo=None) for t in texts]
    assert dict(zip(texts, one(spark, parse_date, texts))) == dict(zip(texts, want))
    assert one(spark, parse_date, ["1/15/2024 13:05 PM", "1/15/2024 0:05 AM", "Noday 1/2/2024", "10:00"]) == [None] * 4


def test_date_format(spark):
    read = lambda c: parse_date(c, "%d|%m|%Y %H.%M")
    assert one(spark, read, ["05|01|2024 10.30", "2024-01-06", "x", None]) == [
        dt.datetime(2024, 1, 5, 10, 30), dt.datetime(2024, 1, 6), None, None]
    with pytest.raises(ValueError, match="%j"):
        parse_date(F.lit("x"), "%j")


def test_amounts(spark):
    texts = {"$1,234.50": 1234.5, " 7 ": 7.0, "-3.25": -3.25, "1e3": 1000.0, "(5.00)": None, "1d": None, "": None,
             "n/a": None, None: None, ".5": 0.5}
    assert one(spark, parse_amount, list(texts)) == list(texts.values())


def test_keywords_are_substrings(spark):
    words = ["FEE", "INTEREST", "NSF"]
    got = one(spark, lambda c: matched_keywords(c, words), ["Monthly ACH Transfer Fee", None, "401(k)"])
    assert got == [["FEE", "NSF"], [], []]
    assert one(spark, component_list, ["a, b,,c ", None]) == [["a", "b", "c"], []]


def test_business_days_by_counting(spark):
    days = [dt.date(2024, 12, 20) + dt.timedelta(n) for n in range(24)] + [dt.date(1960, 1, 1)]
    pairs = [(a, b) for a in days for b in days if abs((a - b).days) < 60]
    df = spark.createDataFrame(pairs, "a date, b date").select(
        "a", "b", business_days_between(F.col("a"), F.col("b")).alias("n"), add_business_days(F.col("a"), 7).alias("due"))
    for r in df.collect():
        assert r.n == sum((r.a + dt.timedelta(i)).weekday() < 5 for i in range((r.b - r.a).days))
        due, left = r.a, 7
        while left:
            due += dt.timedelta(1)
            left -= due.weekday() < 5
        assert r.due == due


def test_headers():
    found = resolve_transaction_headers(["Deposit_ID", "PostDate", "CreditAmount", "Ref", "Account", "Note"])
    assert (found.date, found.amount, found.credit, found.debit, found.reference) == (
        "PostDate", None, "CreditAmount", None, "Ref")
    both = resolve_transaction_headers(["Post Date", "Description", "Credit", "Debit", "Balance", "Reference"])
    assert (both.date, both.amount, both.credit, both.debit) == ("Post Date", None, "Credit", "Debit")
    usd = resolve_transaction_headers(["TxnID", "OrderRef", "Txn_Date", "Amount_USD", "Customer", "Memo"])
    assert (usd.date, usd.amount, usd.description, usd.reference) == ("Txn_Date", "Amount_USD", "Memo", None)
    for names in TRANSACTION_ALIASES.values():
        assert len(names) == len(set(names))


def test_aliases(spark):
    df = spark.createDataFrame([("2024-01-15", 285.0, "A", "R-1", "x")], "PostDate string, Charge double, Memo string, Ref string, custom_field string")
    assert apply_column_aliases(df, TRANSACTION_ALIASES).columns == [
        "txn_date", "txn_amount", "description", "reference", "custom_field"]


def test_best_parseable_column(spark):
    df = spark.createDataFrame([("x", "1", "2"), ("2", "y", "3"), ("3", "z", None)], "total string, amount string, value string")
    assert best_parseable_column(df, ["amount", "total", "value"], parse_amount) == "total"
    assert best_parseable_column(df, ["nothing"], parse_amount) is None


def test_normalize_transactions(spark):
    df = spark.createDataFrame(
        [("01/15/2024", "$285.00", "t.csv"), ("01/29/2024", "x", "t.csv"), ("02/12/2024", "295", "u.csv")],
        "PostDate string, Charge string, source_file string",
    )
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = normalize_transactions(df)
    rows = {r.row_id: r for r in out.rows.collect()}
    assert set(rows) == {"t.csv:TXN00001", "u.csv:TXN00001"}
    assert rows["t.csv:TXN00001"].txn_amount == 285.0 and dict(out.rows.dtypes)["txn_date"] == "timestamp_ntz"
    assert [r.quarantine_reason for r in out.quarantine.collect()] == ["unparseable amount"]
    assert (out.report.rows, out.report.rows_removed) == (3, 1)
    kept = normalize_transactions(df.withColumn("row_id", F.lit(7))).rows
    assert {r.row_id for r in kept.collect()} == {"7"}


@pytest.mark.parametrize("header,row,message", [
    ("when string, amount string", ("2024-01-01", "1"), "date: no header names it"),
    ("date string, weight string", ("2024-01-01", "1"), "amount: no header names it"),
    ("date string, amount string", ("never", "1"), "date: no value can be read"),
    ("date string, amount string", ("2024-01-01", "lots"), "amount: no value can be read"),
])
def test_unusable_exports_are_refused(spark, header, row, message):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(ValueError, match=message):
            normalize_transactions(spark.createDataFrame([row], header))


def test_noise_rules(spark):
    lines = [
        ("CHECK DEPOSIT 2142", "ACH DEBIT", 43.5, True, None),
        ("Monthly ACH Transfer Fee", "ACH DEBIT", -15.0, False, "Excluded: description contains FEE, NSF"),
        ("Participant Distribution", "ACH DEBIT", -5.0, False, "Excluded: not a contribution deposit"),
        ("401(k) sweep", "OTHER", -5.0, True, None),
        ("plain", "deposit", None, True, None),
    ]
    df = spark.createDataFrame([(d, t, a) for d, t, a, _, _ in lines], "Description string, Type string, deposit_amount double")
    assert [(r.keep, r.exclusion_reason) for r in flag_deposits(df).collect()] == [(k, e) for *_, k, e in lines]


A_CSV = "TxnID,Txn_Date,Amount_USD,Memo\n" + "".join(f"T{i},2025-01-{i % 27 + 1:02d},{100 + i}.00,m\n" for i in range(500))


def test_csv_scan_numbers_rows_across_splits(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(A_CSV)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read_export(spark, str(path), {"Memo": "note"}).select("TxnID", "_row_number", "source_file", "note").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.TxnID: r._row_number for r in rows} == {f"T{i}": i + 1 for i in range(500)}
    assert {r.source_file for r in rows} == {"a.csv"}


def quoted_file(seed, rows, end="\n"):
    """Fields with line breaks, quotes, commas and blanks, as a spreadsheet writes them."""
    r = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "Date", "Amount", "Memo", "Ref"])
    for i in range(rows):
        memo = "".join(r.choice(["a", 'b"', ",", "\n", " ", '"', "x\n\n", "é", "12 pipe"]) for _ in range(r.randrange(9)))
        if r.random() < 0.02:
            memo = "long\n" * 200
        writer.writerow([f"T{i}", "2025-01-01", i, memo.strip(), r.choice(["", 'say ""', "r"])])
        if r.random() < 0.1:
            out.write(end)
    return out.getvalue()


@pytest.mark.parametrize("end,split", [("\n", 60), ("\n", 700), ("\r\n", 200)])
def test_line_breaks_in_quotes_across_splits(spark, tmp_path, end, split):
    """Every file is read as the reference's reader reads it, however the splits fall, with positions in the file."""
    want = {}
    for seed in (1, 2, 3):
        text = quoted_file(seed, 60, end) + f'T60,2025-01-02,1,12" pipe,"open, not{end} closed"{end}'
        (tmp_path / f"q{seed}.csv").write_text(text, newline="")
        frame = pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=False)
        for n, row in enumerate(frame.itertuples(index=False), 1):
            want[f"q{seed}.csv", n] = tuple(v.replace("\r\n", "\n") or None for v in row)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = [str(tmp_path / f"q{seed}.csv") for seed in (1, 2, 3)]
        rows = read_export(spark, paths).select("id", "Date", "Amount", "Memo", "Ref", "source_file", "_row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {(r.source_file, r._row_number): tuple(v and v.replace("\r\n", "\n") for v in r[:5]) for r in rows}
    assert len(rows) == len(got) and got == want


def test_where_a_line_ends():
    cases = {
        "a,b": (False, False), '"a': (True, True), 'a"b,c': (False, False), '"a""': (True, True), '"a""b",c': (False, True),
        '': (False, True), 'x",y': (False, False), ',"': (True, True), '"a",b "c,"d': (True, True), '""': (False, True)}
    for line, (outside, inside) in cases.items():
        assert ends_inside(line, False) == outside, line
    assert ends_inside('b",c', True) is False and ends_inside('b"",c', True) is True and ends_inside('b"x"y', True) is False


def test_broken_lines_go_through_the_match(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Amount,Memo,Ref\n2025-01-01,10,"two\nlines",R1\n2025-01-02,20,one,R2\n')
    (tmp_path / "b.csv").write_text("Date,Amount,Memo,Ref\n2025-01-01,10,x,R1\n")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = reconcile_exports(spark, [str(tmp_path / "a.csv")], [str(tmp_path / "b.csv")])
    rows = {r.row_id_a: r for r in found.result.collect()}
    assert rows["a.csv:TXN00001"].description_a == "two\nlines" and rows["a.csv:TXN00001"].exception_code == "matched"
    assert rows["a.csv:TXN00002"].exception_code == "missing_in_b" and found.quarantine["a"].isEmpty()
    facts = scan_facts(spark, found.reports).collect()
    assert [(r.system, r.rows, r.rows_removed, r.fields["date"], r.files) for r in facts] == [
        ("a", 2, 0, "Date", ["a.csv"]), ("b", 1, 0, "Date", ["b.csv"])]


def test_quality_issues(spark):
    rows = [("2025-01-01", "1", "m", "R"), ("2025-01-01", "1", "m", "R"), ("2025-01-01", "1", "m", "S"), ("never", "x", "m", "T"), ("", None, "m", "U")]
    df = spark.createDataFrame([(*r, "f.csv") for r in rows], "date string, amount string, memo string, ref string, source_file string")
    found = quality_issues(normalize_transactions(df, order_by=["ref"], validate=False)).collect()
    assert sorted((r.issue, r.reference, r.copies or 0) for r in found) == [
        ("duplicate record", "R", 2), ("missing amount", "U", 0), ("missing date", "U", 0), ("unparseable amount", "T", 0),
        ("unparseable date", "T", 0)]


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("Date,Amount,Ref\n2025-01-01,10,R1\n2025-01-02,20,R2\n")
    (tmp_path / "a2.csv").write_text("Date,Amount,Ref\n2025-01-03,30,R3\n")
    (tmp_path / "a3.csv").write_text("Posted Date,Credit,Debit,Trace\n01/04/2025,,5,R4\n01/05/2025,7,,R5\n")
    (tmp_path / "a4.csv").write_text("Date,Amount,Ref\nnever,1,R6\n2025-01-07,n/a,R7\n")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows, reports, aside = load_system(spark, [str(tmp_path / f"a{i}.csv") for i in (1, 2, 3, 4)])
    assert {(r.row_id, r.quarantine_reason) for r in aside.collect()} == {
        ("a4.csv:TXN00001", "unparseable date"), ("a4.csv:TXN00002", "unparseable amount")}
    assert sorted(len(r.files) for r in reports) == [1, 3]
    assert {r.row_id: r.txn_amount for r in rows.collect()} == {
        "a1.csv:TXN00001": 10.0, "a1.csv:TXN00002": 20.0, "a2.csv:TXN00001": 30.0, "a3.csv:TXN00001": -5.0, "a3.csv:TXN00002": 7.0}
    assert len(reports) == 2
    result = reconcile_files(spark, [str(tmp_path / "a1.csv")], [str(tmp_path / "a2.csv"), str(tmp_path / "a1.csv")])
    assert {r.exception_code for r in result.collect()} == {"matched", "missing_in_a"}
    with pytest.raises(ValueError):
        reconcile_files(spark, [], ["x"])
    assert read_exports(spark, []).count() == 0
    with pytest.raises(ValueError, match="file_type is"):
        read_exports(spark, ["x"], file_type="other")


def test_many_files_are_one_scan_per_header(spark, tmp_path):
    headers = ["Date,Amount,Ref", "Posted Date,Total,Memo", "Value_Date,Credit,Debit"]
    for i in range(60):
        (tmp_path / f"f{i:02d}.csv").write_text(f"{headers[i % 3]}\n2025-01-{i % 28 + 1:02d},{i},1\n")
    df = read_exports(spark, [str(tmp_path / f"f{i:02d}.csv") for i in range(60)])
    assert df.count() == 60 and df._jdf.queryExecution().toString().split("== Physical")[0].count("Relation") <= 3 * 4 * 3
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = reconcile_exports(spark, [str(tmp_path / "f00.csv")], [str(tmp_path / "f03.csv")])
    assert found.result.count() == 2 and set(found.quarantine) == {"a", "b"} and len(found.reports["a"]) == 1


def test_a_large_file_is_hashed_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "big.bin").write_bytes(bytes(range(256)) * 20_000)
    row = file_inventory(spark, str(tmp_path), "*.bin").first()
    assert (row.filename, row.file_size_bytes) == ("big.bin", 5_120_000)
    assert row.sha256 == hashlib.sha256(bytes(range(256)) * 20_000).hexdigest()


def test_outputs_and_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_text("Date,Amount,Ref\n2025-01-01,10,R1\n2025-01-02,20,R2\n")
    (tmp_path / "b.csv").write_text("Date,Amount,Ref\n2025-01-01,10,R1\n")
    inputs = file_inventory(spark, str(tmp_path), "*.csv")
    hashed = {r.filename: r.sha256 for r in inputs.collect()}
    assert hashed["a.csv"] == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()
    result = reconcile_files(spark, [str(tmp_path / "a.csv")], [str(tmp_path / "b.csv")])
    out = str(tmp_path / "out")
    write_match_outputs(result, out)
    assert spark.read.csv(f"{out}/exceptions.csv", header=True).count() == 1
    assert spark.read.json(f"{out}/exception_summary.json").collect()[0].asDict() == {"exception_code": "missing_in_b", "count": 1}
    assert evidence_manifest(spark, out).count() >= 5
    meta = run_metadata(inputs, "run", "2025-01-15T00:00:00Z").first()
    assert [i.filename for i in meta.inputs] == ["a.csv", "b.csv"]
    manifest = case_manifest("c1", inputs, inputs, run_stats(result)).first()
    assert manifest.results.matched_exact == 1 and manifest.results.unmatched_b == 1
    assert manifest.reproducibility.run_signature == "case_id=c1 inputs=2 outputs=2 date_window_days=3"


def test_case_folder(spark, tmp_path):
    for kind in ("payroll", "trust"):
        (tmp_path / "inputs" / kind).mkdir(parents=True)
    (tmp_path / "inputs" / "payroll" / "p.csv").write_text("Emp_ID,Pay_Date,401k\nE1,2025-01-10,100\nE2,01/10/2025,50\nE1,2025-01-24,70\n")
    (tmp_path / "inputs" / "trust" / "t.csv").write_text(
        "Deposit_ID,transaction_date,amount,Description\nD1,2025-01-14,150,payroll\nD2,2025-01-20,3,Wire fee\n")
    case = run_case(spark, str(tmp_path), as_of="2025-02-01")
    assert case.summary.first().asDict() == {
        "pay_periods": 2, "exceptions": 1, "late_deposits": 0, "total_payroll": 220.0, "total_deposited": 150.0, "variance": 70.0}
    read = lambda name: spark.read.csv(str(tmp_path / "outputs" / name), header=True)
    assert read("evidence_index.csv").count() == 3 and read("trust_noise_log.csv").count() == 1
    assert read("timeliness_report.csv").columns[0] == "pay_date"
    assert read("exceptions/payroll_components").select("payroll_row_id").collect()[0][0] == "p.csv:PAY00003"
    with pytest.raises(ValueError, match="No payroll files"):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            run_case(spark, str(tmp_path / "none"), as_of="2025-02-01")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="no header gives 'employee_id'"):
        normalize_payroll(spark.createDataFrame([("2025-01-01", "1", "f")], "pay_date string, deferral string, source_file string"))
    with pytest.raises(ValueError, match="no header gives 'deposit_id'"):
        normalize_deposits(spark.createDataFrame([("2025-01-01", "1", "f")], "post_date string, amount string, source_file string"))


def test_validated_records_are_parsed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([("2025-01-10", "5", "a"), ("never", "6", "b"), ("2025-01-11", "x", "c")], "Date string, Amount string, Memo string")
    counted = rows.withColumn("Date", F.udf(seen, "string").asNondeterministic()("Date")).withColumn("row_id", F.col("Memo"))
    for how in ({"validate": True}, {"validate": False, "store": True}):
        read.value = 0
        found = normalize_transactions(counted, **how)
        assert found.rows.count() == 1 and sorted(r.raw_date for r in found.quarantine.collect()) == ["2025-01-11", "never"]
        assert read.value == 3
