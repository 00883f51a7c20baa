"""The list of data-quality issues of one export: fields that are missing or unreadable, repeated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.normalize import Normalized


def _field(value: str, raw: str, name: str) -> Column:
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    return F.when(F.col(value).isNull(), F.concat(F.when(blank, F.lit("missing ")).otherwise(F.lit("unparseable ")), F.lit(name)))


def quality_issues(normalized: Normalized) -> DataFrame:
    """``issue, source_file, row_id, reference, raw_date, raw_amount, copies``: one row per issue.

    A row without a usable date and amount has two. Usable records alike in date, amount, reference and
    description are listed once for each group, by their first row, with their number.
    """
    aside = normalized.quarantine
    issues = F.array_compact(F.array(_field("txn_date", "raw_date", "date"), _field("txn_amount", "raw_amount", "amount")))
    faults = aside.select(
        F.explode(issues).alias("issue"), "source_file", "row_id", "reference", "raw_date", "raw_amount",
        F.lit(None).cast("long").alias("copies"))
    first = F.min(F.struct("source_file", F.length("row_id").alias("digits"), "row_id"))
    # combined map-side: a record that a third of the rows repeat is one row a task
    repeated = normalized.rows.groupBy("txn_date", "txn_amount", "reference", "description").agg(
        F.count(F.lit(1)).alias("copies"), first.alias("first")).where("copies > 1")
    absent = F.lit(None).cast("string")
    return faults.unionByName(repeated.select(
        F.lit("duplicate record").alias("issue"), "first.source_file", "first.row_id", "reference",
        absent.alias("raw_date"), absent.alias("raw_amount"), "copies"))
