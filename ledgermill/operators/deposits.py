"""For every pay date, the later deposit whose amount is closest to the payroll total.

Exactness, confidence and proximity all fall as the amount gap grows, so the best
deposit is simply the nearest amount among deposits on or after the pay date; equal gaps
go to the earlier deposit. There is no horizon, which rules out a join on pairs: a
pay date reaches every later deposit. Instead deposits and totals are sorted together by
amount, later dates first. The nearest lower amount is then the last deposit before the
total that is not earlier than the pay date, and a task that walks its range once knows it:
a deposit hides all before it that are not later. What a range cannot answer goes to the
nearest range before it with a date late enough. The nearest higher amount is the same
question with all signs turned. Work is that of a sort, whatever the length of the history,
however fine its instants and however often an amount occurs.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions.scoring import micros
from ledgermill.session import materialize

# workers need no installed copy of the package: these functions travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# rows that are walked: a deposit, a question; rows that come out: a deposit no later one of the range hides, a question with and without its answer
DEPOSIT, QUESTION = 0, 1
IN_SIGHT, ANSWERED, OPEN = 0, 1, 2
_SWEPT = ["seg", "side", "kind", "t", "value", "found_t", "found_value"]
_SWEPT_TYPES = "seg int, side int, kind int, t long, value double, found_t long, found_value double"


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the rows of one range: the last deposit before each question that is not earlier than it."""
    earlier: list[int] = []  # instants of deposits in sight, the sign turned: they rise towards the last one
    values: list[float] = []
    place = None

    def in_sight() -> list[tuple]:
        return [(*place, IN_SIGHT, -t, value, 0, 0.0) for t, value in zip(earlier, values)]

    for batch in batches:
        rows = []
        for seg, side, kind, t, value in zip(*(batch[c].tolist() for c in ("seg", "side", "kind", "t", "value"))):
            if (seg, side) != place:
                rows += in_sight()
                earlier.clear()
                values.clear()
                place = seg, side
            if kind == DEPOSIT:
                while earlier and earlier[-1] >= -t:
                    earlier.pop()
                    values.pop()
                earlier.append(-t)
                values.append(value)
                continue
            at = bisect_right(earlier, -t) - 1
            rows.append((seg, side, ANSWERED, t, value, -earlier[at], values[at]) if at >= 0 else (seg, side, OPEN, t, value, 0, 0.0))
        yield pd.DataFrame(rows, columns=_SWEPT)
    yield pd.DataFrame(in_sight(), columns=_SWEPT)


def _neighbours(points: DataFrame, questions: DataFrame) -> DataFrame:
    """``t, value, found_t, found_value``: for every question the nearest amounts below and above it that are not earlier."""
    sides = F.explode(F.array(F.lit(1), F.lit(-1)))
    mixed = points.select("t", "value", F.lit(DEPOSIT).alias("kind")).unionAll(questions.select("t", "value", F.lit(QUESTION).alias("kind")))
    mixed = mixed.select("t", "value", "kind", sides.alias("side")).withColumn("value", F.col("value") * F.col("side"))
    order = ["side", "value", F.desc("t"), "kind"]
    swept = materialize(
        mixed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seg", F.spark_partition_id())
        .mapInPandas(_sweep, _SWEPT_TYPES), "swept")
    # one line per shuffle partition and side
    latest = swept.where(F.col("kind") == IN_SIGHT).groupBy("side", F.col("seg").alias("aim")).agg(F.max("t").alias("latest"))
    aimed = swept.where(F.col("kind") == OPEN).select("side", "seg", "t", "value").join(F.broadcast(latest), "side").where(
        (F.col("aim") < F.col("seg")) & (F.col("latest") >= F.col("t"))).groupBy("side", "t", "value").agg(F.max("aim").alias("seg"))
    # of the deposits in sight at the end of that range, the earliest one that is not earlier than the question
    seen = swept.where(F.col("kind") == IN_SIGHT).select(
        "side", "seg", "t", "value", F.lit(DEPOSIT).alias("kind"), F.struct("t", "value").alias("point"))
    asked = aimed.select("side", "seg", "t", "value", F.lit(QUESTION).alias("kind")).withColumn("point", F.lit(None).cast(seen.schema["point"].dataType))
    upto = Window.partitionBy("side", "seg").orderBy(F.desc("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    further = seen.unionByName(asked).withColumn("found", F.last("point", ignorenulls=True).over(upto)).where(
        F.col("kind") == QUESTION).select("side", "t", "value", F.col("found.t").alias("found_t"), F.col("found.value").alias("found_value"))
    answered = swept.where(F.col("kind") == ANSWERED).select("side", "t", "value", "found_t", "found_value").unionByName(further)
    return answered.select("t", (F.col("value") * F.col("side")).alias("value"), "found_t", (F.col("found_value") * F.col("side")).alias("found_value"))


def nearest_later_deposit(totals: DataFrame, deposits: DataFrame) -> DataFrame:
    """``pay_date`` with the chosen deposit's fields; pay dates without a later deposit are absent.

    ``totals`` has one row per ``pay_date`` with ``payroll_total``. A deposit without an amount is nearest to none.
    """
    where = F.struct(
        F.col("deposit_date"), F.col("source_file"), F.length("deposit_row_id").alias("digits"), F.col("deposit_row_id"),
    )
    # one deposit per amount and instant can ever win: the first
    points = materialize(deposits.where(F.col("deposit_date").isNotNull() & F.col("deposit_amount").isNotNull()).groupBy(
        micros(F.col("deposit_date")).alias("t"), (F.col("deposit_amount") + F.lit(0.0)).alias("value")
    ).agg(F.min(where).alias("w")), "points")
    asked = materialize(totals.where(F.col("pay_date").isNotNull() & F.col("payroll_total").isNotNull()).select(
        "pay_date", micros(F.col("pay_date")).alias("t"), (F.col("payroll_total") + F.lit(0.0)).alias("value")), "totals")
    options = materialize(_neighbours(points, asked), "neighbours")
    gap = F.abs(F.col("found_value") - F.col("value"))
    found = points.select(F.col("t").alias("found_t"), F.col("value").alias("found_value"), "w")
    best = options.join(found, ["found_t", "found_value"]).groupBy("t").agg(
        F.min(F.struct(gap.alias("gap"), F.col("w"), F.col("found_value").alias("value"))).alias("m")
    )
    return asked.select("pay_date", "t").join(best, "t").select(
        "pay_date", F.col("m.value").alias("deposit_amount"), F.col("m.w.deposit_date").alias("deposit_date"),
        F.col("m.w.deposit_row_id").alias("deposit_row_id"),
    )
