"""Collapse identical transactions into one weighted class per system.

Rows of one system that share date, amount and reference are interchangeable for
matching. One class carries their number, so a hot group of copies costs one line in
every later join. Class ids are dense and follow the matching order: date first, then
the position of the earliest copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.scoring import micros
from ledgermill.operators.prefix import with_dense_index

CLASS_KEY = ["t", "amt", "ref"]


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Rows plus the class key: instant, amount and the reference with blanks unified.

    The engine cannot know what an unusable date or amount should match, so such rows
    are left out here exactly as standardization drops them.
    """
    return rows.where(F.col("txn_date").isNotNull() & F.col("txn_amount").isNotNull()).withColumns({
        "t": micros(F.col("txn_date")),
        "amt": F.col("txn_amount") + F.lit(0.0),
        "ref": F.coalesce(F.col("reference"), F.lit("")),
    })


def position(prefix: str = "") -> list:
    """Order of rows inside one instant; row ids of one file compare as numbers."""
    return [F.col(f"{prefix}source_file"), F.length(f"{prefix}row_id"), F.col(f"{prefix}row_id")]


def transaction_classes(rows: DataFrame, id_name: str) -> DataFrame:
    """One line per class: key, copies, the first copy's fields, dense order id."""
    first = F.min(F.struct(
        F.col("source_file"), F.length("row_id").alias("digits"), F.col("row_id"),
        F.col("description"), F.col("reference"),
    ))
    classes = keyed_rows(rows).groupBy(*CLASS_KEY).agg(
        F.count(F.lit(1)).alias("copies"), first.alias("first"), F.first("txn_date").alias("txn_date")
    )
    order = ["t", "first.source_file", "first.digits", "first.row_id", "amt", "ref"]
    return with_dense_index(classes, order, id_name)


def class_rows(rows: DataFrame, classes: DataFrame, id_name: str) -> DataFrame:
    """Every row with its class id, rank among the copies (0-based) and the class's extra columns.

    Classes of one row already hold the whole row; only real copies are joined back.
    """
    carried = [c for c in classes.columns if c not in (id_name, *CLASS_KEY, "copies", "first", "txn_date")]
    single = classes.where("copies = 1").select(
        id_name, F.lit(0).cast("long").alias("rank"), "t", "amt", "ref", "copies",
        "txn_date", F.col("amt").alias("txn_amount"), F.col("first.description").alias("description"),
        F.col("first.reference").alias("reference"), F.col("first.source_file").alias("source_file"),
        F.col("first.row_id").alias("row_id"), *carried,
    )
    copied = classes.where("copies > 1").select(id_name, *CLASS_KEY, "copies", *carried)
    if copied.isEmpty():
        return single
    members = keyed_rows(rows).join(copied, CLASS_KEY)
    numbered = with_dense_index(members, [id_name, *position(), "description"], "_n")
    base = numbered.groupBy(id_name).agg(F.min("_n").alias("_base"))
    ranked = numbered.join(base, id_name).withColumn("rank", F.col("_n") - F.col("_base"))
    return single.unionByName(ranked.select(*single.columns))
