"""Two or three systems, a payroll and a bank statement derived from the shared tables.

The tables hold one ledger only (``orders``). The other systems are the same ledger as
a counterparty would export it: order status and priority decide which records arrive
late, lose or change their reference, differ in amount, appear twice or not at all.
Every rule is a column expression that reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions.scoring import round_half_up
from ledgermill.schemas import TRANSACTION_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz").alias("day"),
        F.col("o_totalprice").alias("price"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"),
    )


def _row_id(file: str, key: Column) -> Column:
    return F.concat(F.lit(f"{file}:TXN"), F.when(key + 1 < 100_000, F.lpad((key + 1).cast("string"), 5, "0"))
                    .otherwise((key + 1).cast("string")))


def system_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger itself: every order, dated and priced as booked."""
    return _orders(spark, sf_dir).select(
        F.col("day").alias("txn_date"), F.col("price").alias("txn_amount"),
        F.col("o_orderstatus").alias("description"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey")).alias("reference"),
        F.lit("ledger.csv").alias("source_file"), _row_id("ledger.csv", F.col("o_orderkey")).alias("row_id"),
    )


def system_b(spark: SparkSession, sf_dir: str, references: bool = True) -> DataFrame:
    """The counterparty: settles ``rank - 1`` days later, with status-specific defects.

    Pending low-priority orders are absent, pending medium ones are 5 % high, filled
    high ones are exported twice, open unspecified ones carry an extra charge line.
    """
    o, status, rank = _orders(spark, sf_dir), F.col("o_orderstatus"), F.col("rank")
    copies = (
        F.when((status == "P") & (rank == 5), F.array())
        .when((status == "F") & (rank == 2), F.array(F.lit("settled"), F.lit("copy")))
        .when((status == "O") & (rank == 4), F.array(F.lit("settled"), F.lit("charge")))
        .otherwise(F.array(F.lit("settled")))
    )
    ref = (
        F.when((status == "P") & (rank == 4), F.lit(None).cast("string"))
        .when(status == "O", F.concat(F.lit("ORD"), F.col("o_orderkey")))
        .otherwise(F.concat(F.lit("ORD-"), F.col("o_orderkey")))
    )
    price = (
        F.when(F.col("line") == "charge", F.col("price") + 7777.0)
        .when((status == "P") & (rank == 3), round_half_up(F.col("price") * 1.05, 2))
        .otherwise(F.col("price"))
    )
    return o.withColumn("line", F.explode(copies)).select(
        (F.col("day") + F.make_dt_interval(rank - 1)).alias("txn_date"), price.alias("txn_amount"),
        F.col("line").alias("description"),
        (ref if references else F.lit(None).cast("string")).alias("reference"),
        F.lit("bank.csv").alias("source_file"),
        F.concat(_row_id("bank.csv", F.col("o_orderkey")), F.when(F.col("line") == "settled", F.lit(""))
                 .otherwise(F.concat(F.lit("-"), F.col("line")))).alias("row_id"),
    )


def system_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third export: system B one day later, without what B calls a charge."""
    b = system_b(spark, sf_dir).where(F.col("description") != "charge")
    return b.select(
        (F.col("txn_date") + F.make_dt_interval(F.lit(1))).alias("txn_date"), "txn_amount", "description", "reference",
        F.lit("processor.csv").alias("source_file"),
        F.regexp_replace("row_id", "^bank", "processor").alias("row_id"),
    ).select(*TRANSACTION_COLUMNS)


def ledger_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as raw text: mixed date shapes, dollar signs, thousands commas, some ``n/a``."""
    o, rank = _orders(spark, sf_dir), F.col("rank")
    shapes = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyy/MM/dd", "MMM d yyyy", "yyyy.MM.dd", "yyyy-MM-dd'T'HH:mm:ss'Z'",
              "EEE, dd MMM yyyy", "M/d/yyyy h:mm a", "yyyy-MM-dd HH:mm:ss'+02:00'"]
    kind, date = rank - 1 + 5 * (F.col("o_orderkey") % 2), F
    for n, shape in enumerate(shapes):
        date = date.when(kind == n, F.date_format("day", shape))
    amount = (
        F.when((F.col("o_orderstatus") == "P") & (rank == 5), F.lit("n/a"))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), F.format_number("price", 2)))
        .otherwise(F.col("price").cast("decimal(18,2)").cast("string"))
    )
    return o.select(
        date.alias("Posted Date"), amount.alias("Total"), F.col("o_orderstatus").alias("Memo"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey")).alias("Ref"),
        F.concat(F.lit("export_"), F.col("o_orderstatus"), F.lit(".csv")).alias("source_file"),
        F.col("o_orderkey").alias("Line"),
    )


def flawed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with dates that are absent or no dates, and filled high-priority orders twice."""
    export, o = ledger_export(spark, sf_dir), _orders(spark, sf_dir)
    status, rank = F.col("o_orderstatus"), F.col("rank")
    fault = F.when((status == "P") & (rank == 1), F.lit("never")).when((status == "P") & (rank == 2), F.lit(""))
    faults = o.select(F.col("o_orderkey").alias("Line"), fault.alias("fault"), ((status == "F") & (rank == 2)).alias("twice"))
    export = export.join(faults, "Line").withColumn("Posted Date", F.coalesce("fault", "Posted Date"))
    times = F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return export.withColumn("Copy", F.explode(times)).drop("fault", "twice")


def written_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's columns as a file holds them, with a memo of two lines, quotes and a comma."""
    memo = F.concat("Memo", F.lit('\nsays "'), F.col("Ref"), F.lit('", twice'))
    return ledger_export(spark, sf_dir).select("Posted Date", "Total", memo.alias("Memo"), "Ref")


def signed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as a bank would print it: filled orders as debits, the rest as credits."""
    o = _orders(spark, sf_dir)
    text = F.col("price").cast("decimal(18,2)").cast("string")
    return o.select(
        F.date_format("day", "yyyy-MM-dd").alias("Value-Date"),
        F.when(F.col("o_orderstatus") != "F", text).alias("Credit"),
        F.when(F.col("o_orderstatus") == "F", text).alias("Debit"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey")).alias("Trace"), F.lit("signed.csv").alias("source_file"),
        (F.col("o_orderkey") + 1).alias("_row_number"),
    )


def payroll_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a payroll line of its customer on the order date."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("Emp_ID"), F.col("o_orderdate").cast("timestamp_ntz").alias("Pay_Date"),
        F.col("o_totalprice").alias("401k_amount"),
        F.concat(F.lit("payroll_"), F.col("o_orderstatus"), F.lit(".csv")).alias("source_file"),
        (F.col("o_orderkey") + 1).alias("_row_number"),
    )


def bank_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits per pay date with weekday-specific defects, and one bank line per event.

    Monday to Sunday: on time, on time, 4 % short, late, never paid, 12 % high, on time.
    """
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("day")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    ).withColumn("wd", F.weekday("day"))
    lag = F.element_at(F.array(*[F.lit(n) for n in (1, 2, 2, 9, 0, 2, 1)]), F.col("wd") + 1)
    share = F.when(F.col("wd") == 2, 0.96).when(F.col("wd") == 5, 1.12).otherwise(1.0)
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    paid = daily.where("wd <> 4").select(
        F.concat(F.lit("D"), number).alias("deposit_id"), (F.col("day") + F.make_dt_interval(lag)).alias("transaction_date"),
        round_half_up(F.col("total") * share, 2).alias("credit_amount"), F.lit("ACH CREDIT").alias("transaction_type"),
        F.concat(F.lit("Employee deferral deposit "), F.date_format("day", "yyyyMMdd")).alias("description"),
        F.lit("bank.csv").alias("source_file"), number.cast("long").alias("_row_number"),
    )
    kinds = {
        "view": ("INTEREST CREDIT", "Monthly interest income"), "click": ("ACH DEBIT", "Wire transfer fee"),
        "error": ("REVERSAL", "Reversal of entry"), "purchase": ("ACH DEBIT", "Card settlement"),
        "signup": ("DEPOSIT", "Counter deposit"),
    }
    kind, words = F, F
    for name, (a, b) in kinds.items():
        kind, words = kind.when(F.col("event_type") == name, F.lit(a)), words.when(F.col("event_type") == name, F.lit(b))
    lines = table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), F.col("event_id")).alias("deposit_id"), F.col("ts").cast("timestamp_ntz").alias("transaction_date"),
        F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value")).alias("credit_amount"),
        kind.alias("transaction_type"), words.alias("description"), F.lit("bank_lines.csv").alias("source_file"),
        (F.col("event_id") + 1).alias("_row_number"),
    )
    return paid.unionByName(lines)


def posting_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the payroll: pending low-priority lines are lost, urgent filled ones posted twice."""
    o = table(spark, sf_dir, "orders")
    status, rank = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    times = F.when((status == "P") & (rank == "5"), 0).when((status == "F") & (rank == "1"), 2).otherwise(1)
    return o.withColumn("n", F.explode(F.filter(F.sequence(F.lit(0), times), lambda i: i > 0))).select(
        F.col("o_custkey").cast("string").alias("Participant_ID"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("Posted_Date"), F.col("o_totalprice").alias("Posted_Amount"),
    )
