"""Write runs and cases: tables, summaries, hashes and the manifest."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import __version__
from ledgermill.operators.normalize import Normalized, Report, load_system, normalize_deposits, normalize_payroll
from ledgermill.operators.remittance import LATE_THRESHOLD, remittance_schedule
from ledgermill.plans import reports as R
from ledgermill.plans.reconcile import reconcile_transactions
from ledgermill.session import materialize
from ledgermill.sources.csv import list_exports, read_exports
from ledgermill.sources.inventory import file_inventory

# Texts of the manifest.
STEPS = ["Normalize headers", "Detect date/amount/reference/description", "Standardize to canonical fields"]
MATCHING_LOGIC = "Date-window matching with amount/reference confidence scoring."
ASSUMPTIONS = ["Systems are peer exports with independent timing."]


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts with headers; tasks write in parallel, an empty table writes its header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_match_outputs(result: DataFrame, folder: str, include_matched: bool = False) -> None:
    """``remittance``, ``matched``, ``probable``, ``exceptions`` and the summary by code."""
    result = materialize(result, "result")
    write_csv(result, f"{folder}/remittance.csv")
    write_csv(R.matched(result), f"{folder}/matched.csv")
    write_csv(R.probable(result), f"{folder}/probable.csv")
    write_csv(R.exceptions(result), f"{folder}/exceptions.csv")
    write_json(R.exception_summary(result, include_matched).orderBy("exception_code"), f"{folder}/exception_summary.json")


def run_metadata(inputs: DataFrame, run_id: str, run_timestamp_utc: str, date_window_days: int = 3,
                 amount_tolerance: float = 0.01) -> DataFrame:
    """One row: run id, time, engine version, input hashes and parameters."""
    listed = inputs.agg(F.array_sort(F.collect_list(F.struct("filename", "sha256"))).alias("inputs"))
    return listed.select(
        F.lit(run_id).alias("run_id"), F.lit(run_timestamp_utc).alias("run_timestamp_utc"),
        F.lit(__version__).alias("engine_version"), "inputs",
        F.struct(F.lit(date_window_days).alias("date_window_days"), F.lit(amount_tolerance).alias("amount_tolerance"))
        .alias("parameters"),
    )


def evidence_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of every written part."""
    return file_inventory(spark, folder, "part-*").select("filename", "sha256")


SCANS = ("array<struct<system:string, columns:array<string>, fields:map<string,string>, files:array<string>, "
         "rows:bigint, rows_removed:bigint>>")


def _scans(reports: dict[str, list[Report]]) -> list[dict]:
    """One entry for each header of each system: what was read, what it was taken for, what was set aside."""
    return [
        {"system": system, "columns": r.columns, "fields": {k: v for k, v in r.detected_fields.items() if v},
         "files": sorted(f.rsplit("/", 1)[-1] for f in r.files), "rows": r.rows, "rows_removed": r.rows_removed}
        for system, found in sorted(reports.items()) for r in sorted(found, key=lambda r: r.columns)
    ]


def scan_facts(spark: SparkSession, reports: dict[str, list[Report]]) -> DataFrame:
    """The same as a table, one row per header: ``system, columns, fields, files, rows, rows_removed``."""
    text = F.lit(json.dumps(_scans(reports)))
    return spark.range(1).select(F.explode(F.from_json(text, SCANS)).alias("s")).select("s.*")


def case_manifest(
    case_id: str,
    inputs: DataFrame,
    outputs: DataFrame,
    stats: DataFrame,
    date_window_days: int = 3,
    amount_tolerance: float = 0.01,
    partial_tolerance: float = 0.10,
    status: str = "complete",
    error: str | None = None,
    engine_commit: str | None = None,
    reports: dict[str, list[Report]] | None = None,
    messages: list[str] | None = None,
) -> DataFrame:
    """One nested row describing inputs, processing, results and how to repeat the run.

    ``inputs`` and ``outputs`` are file inventories: their size is the number of files. ``reports`` of
    :class:`FilesResult` give the detected headers and row counts of each system's scans, ``messages`` the warnings.
    The time of the run is left to the caller so that equal runs give equal manifests.
    """
    files = F.array_sort(F.collect_list(F.struct("filename", "sha256", "file_size_bytes")))
    # three one-row tables side by side: stack them, keep the filled value of each column
    stacked = inputs.agg(files.alias("input_files")).unionByName(
        outputs.agg(files.alias("output_files")), allowMissingColumns=True
    ).unionByName(stats, allowMissingColumns=True)
    listed = stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
    parameters = F.struct(
        F.lit(date_window_days).alias("date_window_days"), F.lit(amount_tolerance).alias("amount_tolerance")
    )
    return listed.select(
        F.lit(case_id).alias("case_id"), F.lit(__version__).alias("engine_version"), "input_files",
        F.struct(
            F.lit(STEPS).alias("normalization_steps"), F.lit(MATCHING_LOGIC).alias("matching_logic"),
            F.struct(F.lit(date_window_days).alias("date_window_days"),
                     F.lit(amount_tolerance).alias("amount_tolerance"),
                     F.lit(partial_tolerance).alias("partial_tolerance")).alias("tolerances"),
            F.from_json(F.lit(json.dumps(_scans(reports or {}))), SCANS).alias("detected_mappings"),
            F.from_json(F.lit(json.dumps(messages or [])), "array<string>").alias("warnings"),
            F.lit(ASSUMPTIONS).alias("assumptions"), F.lit(status).alias("status"),
            F.lit(error).cast("string").alias("error"),
        ).alias("processing"),
        F.struct("total_system_a", "total_system_b", "matched_exact", "matched_fuzzy", "unmatched_a", "unmatched_b",
                 "exception_count", "output_files").alias("results"),
        F.struct(
            parameters.alias("parameters"),
            F.format_string("case_id=%s inputs=%d outputs=%d date_window_days=%d", F.lit(case_id),
                            F.size("input_files"), F.size("output_files"), F.lit(date_window_days))
            .alias("run_signature"),
            F.lit(engine_commit).cast("string").alias("engine_commit"),
        ).alias("reproducibility"),
    )


@dataclass
class FilesResult:
    """A match of files: the result, and per system the reports and the rows set aside."""

    result: DataFrame
    reports: dict[str, list[Report]]
    quarantine: dict[str, DataFrame]


def reconcile_exports(
    spark: SparkSession,
    system_a_files: list[str],
    system_b_files: list[str],
    system_c_files: list[str] | None = None,
    date_window_days: int = 3,
) -> FilesResult:
    """Scan, standardize and match groups of exports; A and B are required."""
    if not system_a_files or not system_b_files:
        raise ValueError("a match needs exports of both sides, A and B")
    given = {"a": system_a_files, "b": system_b_files, "c": system_c_files}
    loaded = {name: load_system(spark, files) for name, files in given.items() if files}
    rows = {name: found[0] for name, found in loaded.items()}
    result = reconcile_transactions(rows["a"], rows["b"], rows.get("c"), date_window_days=date_window_days)
    return FilesResult(
        result, {name: found[1] for name, found in loaded.items()}, {name: found[2] for name, found in loaded.items()})


def reconcile_files(
    spark: SparkSession,
    system_a_files: list[str],
    system_b_files: list[str],
    system_c_files: list[str] | None = None,
    date_window_days: int = 3,
) -> DataFrame:
    """The match table of :func:`reconcile_exports`."""
    return reconcile_exports(spark, system_a_files, system_b_files, system_c_files, date_window_days).result


@dataclass
class Case:
    """Everything a remittance case produced."""

    schedule: DataFrame
    payroll: Normalized
    deposits: Normalized
    summary: DataFrame


def write_schedule_outputs(case: Case, folder: str, as_of: str, threshold_days: int = LATE_THRESHOLD) -> None:
    """All audit reports of one case, from one stored schedule."""
    schedule, payroll, deposits = case.schedule, case.payroll.rows, case.deposits.rows
    tables = {
        "remittance_schedule.csv": R.schedule_report(schedule),
        "timeliness_report.csv": R.timeliness_report(schedule, threshold_days),
        "exception_log.csv": R.exception_log(schedule),
        "audit_workpaper.csv": R.audit_workpaper(schedule),
        "trust_noise_log.csv": case.deposits.noise,
        "evidence_index.csv": R.evidence_index(payroll, deposits, schedule, as_of, case.deposits.filter_summary),
        "correction_packet_index.csv": R.correction_packet_index(schedule, as_of),
        "exceptions/trace_summary.csv": R.trace_summaries(schedule),
    }
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
    paid, received = R.trace_components(schedule, payroll, deposits)
    for name, df in (("payroll_components", paid), ("deposit_components", received)):
        df.write.mode("overwrite").option("header", True).partitionBy("case_date").csv(f"{folder}/exceptions/{name}")


def run_case(
    spark: SparkSession,
    case_folder: str,
    as_of: str,
    payroll_column_mapping: dict[str, str] | None = None,
    trust_column_mapping: dict[str, str] | None = None,
    late_threshold_days: int = LATE_THRESHOLD,
) -> Case:
    """Payroll and bank exports under ``inputs/payroll`` and ``inputs/trust`` to reports under ``outputs``."""
    root = case_folder.rstrip("/")
    frames = []
    for kind, mapping in (("payroll", payroll_column_mapping), ("trust", trust_column_mapping)):
        paths = list_exports(spark, f"{root}/inputs/{kind}")
        if not paths:
            raise ValueError(f"No {kind} files: {root}/inputs/{kind} holds no export to read")
        frames.append(read_exports(spark, paths, mapping, kind))
    payroll, deposits = normalize_payroll(frames[0]), normalize_deposits(frames[1])
    # every report starts from these: read and parse the exports once
    payroll.rows = materialize(payroll.rows, "payroll")
    deposits.rows, deposits.noise = materialize(deposits.rows, "deposits"), materialize(deposits.noise, "noise")
    schedule = materialize(remittance_schedule(payroll.rows, deposits.rows, late_threshold_days), "schedule")
    if schedule.isEmpty():
        warnings.warn("No pay dates found")
    case = Case(schedule, payroll, deposits, R.case_summary(schedule))
    write_schedule_outputs(case, f"{root}/outputs", as_of, late_threshold_days)
    return case
