"""Every operator as a query over the shared tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions.calendar import business_days_between
from ledgermill.functions.scoring import micros
from ledgermill.functions.similarity import reference_similarity
from ledgermill.operators.assign import exclusive_match, unit_pairs
from ledgermill.operators.classes import CLASS_KEY, class_rows, transaction_classes
from ledgermill.operators.counts import candidate_counts
from ledgermill.operators.deposits import nearest_later_deposit
from ledgermill.operators.normalize import (
    kept_and_excluded, load_system, normalize_deposits, normalize_payroll, normalize_postings, normalize_transactions,
)
from ledgermill.operators.quality import quality_issues
from ledgermill.operators.remittance import (
    component_ids, payroll_totals, remittance_schedule, required_deposit_dates, simple_schedule,
)
from ledgermill.operators.search import Tolerances, best_candidates
from ledgermill.operators.threeway import posting_exceptions, three_way_schedule, validation_failures
from ledgermill.plans import outputs as O
from ledgermill.plans import reports as R
from ledgermill.plans.reconcile import reconcile_transactions
from ledgermill.session import checkpoint_root, materialize
from ledgermill.sources import derived as D
from ledgermill.sources.csv import ROW_NUMBER, list_exports, read_exports, with_row_numbers
from ledgermill.sources.inventory import file_inventory

AS_OF = "2025-01-15"
TOL = Tolerances()
Query = Callable[[SparkSession, str], DataFrame]

# results several queries start from, kept as stored tables per application and folder
_STORED: dict[tuple, DataFrame | str] = {}


def forget_shared() -> None:
    """Make the next query compute what it starts from (timing)."""
    _STORED.clear()


def _shared(name: str, spark: SparkSession, sf_dir: str, build: Query) -> DataFrame:
    key = (spark.sparkContext.applicationId, str(Path(sf_dir)), name)
    if key not in _STORED:
        _STORED[key] = materialize(build(spark, sf_dir), name)
    return _STORED[key]


# -- standardization -------------------------------------------------------------------

def normalize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_transactions(D.ledger_export(spark, sf_dir), order_by=["Line"], validate=False).rows


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_aside = normalize_transactions(D.ledger_export(spark, sf_dir), order_by=["Line"], validate=False).quarantine
    return set_aside.select("reference", "raw_amount", "quarantine_reason")


def credit_minus_debit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_transactions(D.signed_export(spark, sf_dir), validate=False).rows


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("lines_"), F.col("l_returnflag")).alias("source_file"), "l_orderkey", "l_linenumber"
    )
    numbered = with_row_numbers(lines, order_by=["l_orderkey", "l_linenumber"])
    return numbered.select("source_file", "l_orderkey", "l_linenumber", F.col(ROW_NUMBER).alias("row_number"))


# -- matching --------------------------------------------------------------------------

def _classes(spark: SparkSession, sf_dir: str, references: bool = True) -> tuple[DataFrame, DataFrame]:
    return (
        transaction_classes(D.system_a(spark, sf_dir), "x"),
        transaction_classes(D.system_b(spark, sf_dir, references), "p"),
    )


def counted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _classes(spark, sf_dir)
    counts = candidate_counts(a, b, TOL.date_window_days, TOL.partial_tolerance)
    sides = []
    for rows, classes, key, count, side in (
        (D.system_a(spark, sf_dir), a, "x", counts[0], "A"), (D.system_b(spark, sf_dir), b, "p", counts[1], "B"),
    ):
        with_count = classes.join(count, ["t", "amt"], "left").withColumn(
            "candidate_count", F.coalesce("candidate_count", F.lit(0).cast("long")))
        sides.append(class_rows(rows, with_count, key).select(F.lit(side).alias("system"), "row_id", "candidate_count"))
    return sides[0].unionAll(sides[1])


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.system_b(spark, sf_dir)
    classes = transaction_classes(b, "p")
    return class_rows(b, classes, "p").select("row_id", (F.col("copies") > 1).alias("duplicate"))


def _best(spark: SparkSession, sf_dir: str, references: bool) -> DataFrame:
    """Best B for every A row, copies included; B may serve many."""
    a, b = _classes(spark, sf_dir, references)
    best = best_candidates(a.select("x", *CLASS_KEY), b.select("p", *CLASS_KEY), TOL)
    rows_a = class_rows(D.system_a(spark, sf_dir), a, "x").select("x", F.col("row_id").alias("row_id_a"))
    return rows_a.join(best, "x").join(b.select("p", F.col("first.row_id").alias("row_id_b")), "p").select(
        "row_id_a", "row_id_b", "exact", "score")


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B carries no references here, so every similarity is the unknown value."""
    return _best(spark, sf_dir, references=False)


def best_match_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, references=True)


def exclusive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _classes(spark, sf_dir, references=False)
    counts, _ = candidate_counts(a, b, TOL.date_window_days, TOL.partial_tolerance)
    counted = a.join(counts, ["t", "amt"], "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0).cast("long")))
    pairs = unit_pairs(exclusive_match(counted, b, TOL))
    rows_a = class_rows(D.system_a(spark, sf_dir), a, "x").select("x", F.col("rank").alias("rank_a"), F.col("row_id").alias("row_id_a"))
    rows_b = class_rows(D.system_b(spark, sf_dir, False), b, "p").select("p", F.col("rank").alias("rank_b"), F.col("row_id").alias("row_id_b"))
    return pairs.join(rows_a, ["x", "rank_a"]).join(rows_b, ["p", "rank_b"]).select("row_id_a", "row_id_b")


def reconcile_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A against a B without references: the whole match result."""
    return _shared("reconcile_plain", spark, sf_dir, lambda s, d: reconcile_transactions(
        D.system_a(s, d), D.system_b(s, d, references=False)))


def reconcile_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("reconcile_ab", spark, sf_dir, lambda s, d: reconcile_transactions(D.system_a(s, d), D.system_b(s, d)))


def reconcile_abc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("reconcile_abc", spark, sf_dir, lambda s, d: reconcile_transactions(
        D.system_a(s, d), D.system_b(s, d), D.system_c(s, d)))


def similarity_of_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every order reference to its spelling without the hyphen."""
    key = F.col("o_orderkey").cast("string")
    refs = D.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("ORD-"), key).alias("a"), F.concat(F.lit("ORD"), key).alias("b"))
    return refs.select("o_orderkey", reference_similarity(F.col("a"), F.col("b")).alias("similarity"))


def _on_plain(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(reconcile_plain(spark, sf_dir))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _exports(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[str]]:
    """Paths of the ledger and of the bank's signed export, written as CSV parts."""
    key = (spark.sparkContext.applicationId, str(Path(sf_dir)), "exports")
    if key not in _STORED:
        folder = _folder(spark, "exports")
        ledger = D.written_ledger(spark, sf_dir)
        signed = D.signed_export(spark, sf_dir).drop("source_file", "_row_number")
        for name, df in (("a", ledger), ("b", signed)):
            df.write.options(header=True, quote='"', escape='"').csv(f"{folder}/{name}")
        _STORED[key] = folder
    return list_exports(spark, f"{_STORED[key]}/a"), list_exports(spark, f"{_STORED[key]}/b")


def exports_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both exports in one scan per header, a header renamed, memos of two lines."""
    a, b = _exports(spark, sf_dir)
    rows = read_exports(spark, a + b, {"Memo": "note"})
    return rows.select("Total", "note", "Ref", F.col("Value-Date").alias("value_date"), "Credit", "Debit", "Trace")


def _loaded(spark: SparkSession, sf_dir: str):
    a, b = _exports(spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return load_system(spark, a + b)


def exports_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)[0].select("txn_date", "txn_amount", "description", "reference")


def exports_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)[2].select("reference", "description", "raw_amount", "quarantine_reason")


def export_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = O.scan_facts(spark, {"a": _loaded(spark, sf_dir)[1]})
    return facts.select(
        "system", F.array_join("columns", ", ").alias("columns"), *[F.col("fields")[k].alias(f"{k}_header") for k in (
            "date", "amount", "description", "reference")], "rows", "rows_removed")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize_transactions(D.flawed_export(spark, sf_dir), order_by=["Line", "Copy"], validate=False, store=True)
    return quality_issues(found).select("issue", "source_file", "reference", "raw_amount", "copies")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = O.run_metadata(file_inventory(spark, sf_dir, "orders.parquet"), "run-1", f"{AS_OF}T00:00:00Z")
    return run.select("run_id", "run_timestamp_utc", "engine_version", F.explode("inputs").alias("i"), "parameters").select(
        "run_id", "run_timestamp_utc", "engine_version", "i.filename", "i.sha256", "parameters.date_window_days",
        "parameters.amount_tolerance")


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case from payroll and bank files to its written schedule, read back."""
    folder = _folder(spark, "case")
    payroll, bank = D.payroll_export(spark, sf_dir), D.bank_export(spark, sf_dir)
    stamp = {"header": True, "quote": '"', "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    payroll.drop("source_file", "_row_number").write.options(**stamp).csv(f"{folder}/inputs/payroll")
    bank.drop("source_file", "_row_number").write.options(**stamp).csv(f"{folder}/inputs/trust")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        O.run_case(spark, folder, AS_OF)
    written = spark.read.option("header", True).csv(f"{folder}/outputs/remittance_schedule.csv")
    return written.select(
        "pay_date", *[F.col(c).cast("double").alias(c) for c in ("payroll_total", "deposit_total")], "matched_deposit_date",
        F.col("days_to_deposit").cast("int").alias("days_to_deposit"), "match_status", "late_flag", "exception_type", "severity")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's facts in columns; the number of output parts depends on the cluster and is left out."""
    result = reconcile_plain(spark, sf_dir)
    folder = _folder(spark, "manifest")
    O.write_match_outputs(result, folder)
    row = O.case_manifest(
        "case", file_inventory(spark, sf_dir, "orders.parquet"), file_inventory(spark, folder, "part-*"), R.run_stats(result),
        reports={"a": _loaded(spark, sf_dir)[1]}, messages=["some amounts could not be read"])
    row = materialize(row, "manifest")
    mapping = F.explode("processing.detected_mappings").alias("m")
    flat = row.select("case_id", "engine_version", F.col("input_files")[0].alias("f"), "processing", "results", mapping)
    return flat.select(
        "case_id", "engine_version", "f.filename", "f.sha256", "f.file_size_bytes", "processing.matching_logic",
        F.array_join("processing.normalization_steps", "; ").alias("steps"), F.array_join("processing.warnings", "; ").alias("warnings"),
        F.array_join("processing.assumptions", "; ").alias("assumptions"), "processing.status", "processing.error",
        "processing.tolerances.date_window_days", "processing.tolerances.amount_tolerance", "processing.tolerances.partial_tolerance",
        F.array_join("m.columns", ", ").alias("columns"), F.col("m.fields")["date"].alias("date_header"),
        F.col("m.fields")["amount"].alias("amount_header"), "m.rows", "m.rows_removed", "results.total_system_a",
        "results.total_system_b", "results.matched_exact", "results.matched_fuzzy", "results.unmatched_a", "results.unmatched_b",
        "results.exception_count", (F.size("results.output_files") > 0).alias("has_outputs"))


# -- instants below a day ---------------------------------------------------------------

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.col("value").alias("amt"))


def instant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every purchase the other events within a day and a tenth of its amount, and the reverse; instants as stored."""
    events = _events(spark, sf_dir).withColumn("t", micros(F.col("ts")))
    sides = events.where("event_type = 'purchase'"), events.where("event_type <> 'purchase'")
    cells = [s.groupBy("t", "amt").agg(F.count(F.lit(1)).alias("copies")) for s in sides]
    counted = candidate_counts(*cells, 1, 0.1)
    rows = [s.join(c, ["t", "amt"], "left").select(
        "event_id", "event_type", F.coalesce("candidate_count", F.lit(0).cast("long")).alias("candidate_count"))
        for s, c in zip(sides, counted)]
    return rows[0].unionByName(rows[1])


def instant_deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every instant of a purchase the later event nearest in amount."""
    events = _events(spark, sf_dir)
    paid = events.where("event_type = 'purchase'").groupBy(F.col("ts").alias("pay_date")).agg(F.max("amt").alias("payroll_total"))
    received = events.where("event_type <> 'purchase'").select(
        F.col("ts").alias("deposit_date"), F.col("amt").alias("deposit_amount"), F.lit("events.csv").alias("source_file"),
        F.concat(F.lit("E"), "event_id").alias("deposit_row_id"))
    return nearest_later_deposit(paid, received)


def similarity_of_long_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of 128 to 245 characters: an added character, and frequent characters around none or one rare block."""
    key = F.col("o_orderkey").cast("string")
    digests = F.sha2(key, 256), F.sha2(F.concat(F.lit("x"), key), 256)
    digits, kind = F.lpad(key, 8, "0"), F.col("o_orderkey") % 3
    many = lambda n: F.repeat(digits, n)
    a = F.when(kind == 0, F.concat(digests[0], F.lit("Z"), digests[1])).when(
        kind == 1, F.concat(many(15), F.lit("Z"), many(15))).otherwise(F.concat(many(15), F.lit("#QRST"), many(15)))
    b = F.when(kind == 0, F.concat(*digests)).when(kind == 1, many(30)).otherwise(F.concat(many(10), F.lit("#QRST"), many(16)))
    refs = D.table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    return refs.select("o_orderkey", reference_similarity(F.col("a"), F.col("b")).alias("similarity"))


# -- remittance ------------------------------------------------------------------------

def _payroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_payroll(D.payroll_export(spark, sf_dir), validate=False).rows


def _bank(spark: SparkSession, sf_dir: str):
    return normalize_deposits(D.bank_export(spark, sf_dir), validate=False)


def _parsed_payroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("payroll", spark, sf_dir, _payroll)


def _parsed_deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("deposits", spark, sf_dir, lambda s, d: _bank(s, d).rows)


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("schedule", spark, sf_dir, lambda s, d: remittance_schedule(_parsed_payroll(s, d), _parsed_deposits(s, d)))


def schedule_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remittance_schedule(_payroll(spark, sf_dir), _bank(spark, sf_dir).rows, review_style="v1")
    return rows.select("pay_date", "match_confidence", "late_flag", "exception_type", "review_required", "review_reason")


def simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_schedule(_payroll(spark, sf_dir), _bank(spark, sf_dir).rows)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payroll_totals(_payroll(spark, sf_dir))


def listed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(_payroll(spark, sf_dir))


def noise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    return kept_and_excluded(bank.rows, bank.noise)


def lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business days from order to shipment for every line."""
    lines = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    days = business_days_between(F.col("o_orderdate"), F.col("l_shipdate"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", days.alias("business_days"), (days > 3).alias("late"))


def _on_schedule(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(schedule(spark, sf_dir))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = _bank(spark, sf_dir).filter_summary
    return R.evidence_index(_parsed_payroll(spark, sf_dir), _parsed_deposits(spark, sf_dir), schedule(spark, sf_dir), AS_OF, filtered)


def _traced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return R.trace_components(schedule(spark, sf_dir), _parsed_payroll(spark, sf_dir), _parsed_deposits(spark, sf_dir))


def traced_payroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir)[0].select(
        "case_date", "employee_id", "deferral_amount", "payroll_row_id")


def traced_deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir)[1]


def postings_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_exceptions(_payroll(spark, sf_dir), normalize_postings(D.posting_export(spark, sf_dir)))


def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_way_schedule(
        _payroll(spark, sf_dir), _bank(spark, sf_dir).rows, normalize_postings(D.posting_export(spark, sf_dir)))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_failures(
        _payroll(spark, sf_dir), _bank(spark, sf_dir).rows, normalize_postings(D.posting_export(spark, sf_dir)),
        schedule(spark, sf_dir), limit=500_000.0)


QUERIES: dict[str, Query] = {
    "normalize_orders": normalize_orders,
    "quarantine": quarantine,
    "credit_minus_debit": credit_minus_debit,
    "row_numbers": row_numbers,
    "candidate_counts": counted_candidates,
    "duplicates": duplicates,
    "best_match": best_match,
    "best_match_referenced": best_match_referenced,
    "exclusive_match": exclusive_pairs,
    "reconcile_plain": reconcile_plain,
    "reconcile_ab": reconcile_ab,
    "reconcile_abc": reconcile_abc,
    "matched": _on_plain(R.matched),
    "probable": _on_plain(R.probable),
    "exceptions": _on_plain(R.exceptions),
    "exception_summary": _on_plain(lambda r: R.exception_summary(r, include_matched=True)),
    "run_stats": _on_plain(R.run_stats),
    "top_exceptions": _on_plain(R.top_exceptions),
    "matched_ab": lambda s, d: R.matched(reconcile_ab(s, d)),
    "case_manifest": manifest,
    "exports_read": exports_read,
    "exports_loaded": exports_loaded,
    "exports_set_aside": exports_set_aside,
    "export_reports": export_reports,
    "data_quality": issues,
    "run_metadata": metadata,
    "case_files": case_files,
    "instant_counts": instant_counts,
    "instant_deposits": instant_deposits,
    "ref_similarity": similarity_of_references,
    "long_ref_similarity": similarity_of_long_references,
    "business_days": lateness,
    "payroll_totals": totals,
    "component_ids": listed_components,
    "deposits_kept": lambda s, d: _bank(s, d).rows,
    "noise_log": lambda s, d: _bank(s, d).noise,
    "kept_excluded": noise_counts,
    "remittance_schedule": _on_schedule(R.schedule_report),
    "review_fields_v1": schedule_v1,
    "simple_schedule": simple,
    "simple_exception_log": lambda s, d: R.simple_exception_log(simple(s, d)),
    "simple_status_counts": lambda s, d: R.simple_status_counts(R.simple_exception_log(simple(s, d))),
    "required_deposit_dates": _on_schedule(required_deposit_dates),
    "timeliness_report": _on_schedule(R.timeliness_report),
    "exception_log": _on_schedule(R.exception_log),
    "audit_workpaper": _on_schedule(R.audit_workpaper),
    "correction_packet_index": _on_schedule(lambda s: R.correction_packet_index(s, AS_OF)),
    "case_summary": _on_schedule(R.case_summary),
    "trace_summaries": _on_schedule(R.trace_summaries),
    "trace_payroll": traced_payroll,
    "trace_deposits": traced_deposits,
    "evidence_index": evidence,
    "posting_exceptions": postings_checked,
    "three_way_schedule": three_way,
    "validation_failures": validation,
    "file_inventory": lambda s, d: file_inventory(s, d, "*.parquet"),
}
