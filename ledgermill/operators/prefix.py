"""Running numbers and running sums that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.session import materialize

_POSITION_MASK = (1 << 33) - 1


def with_dense_index(df: DataFrame, order_by: list[str | Column], name: str) -> DataFrame:
    """Number rows 0..n-1 in ``order_by`` order.

    A range shuffle spreads the order over partitions (a hot leading value is split
    because the full key decides the ranges); each row then needs only the count of the
    partitions before its own, a table with one line per partition.
    """
    ordered = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    ordered = materialize(ordered, "ordered")
    # one line per shuffle partition: bounded by the partition count, whatever the rows
    sizes = sorted(tuple(r) for r in ordered.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append(f"({part}, {total}L)")
        total += size
    if not starts:
        starts = ["(0, 0L)"]
    before = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(starts)} AS s(_part, _start)")
    return (
        ordered.join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )


def with_running_totals(
    df: DataFrame,
    group: list[str],
    coarse: str,
    fine: list[str | Column],
    totals: dict[str, str],
) -> DataFrame:
    """Inclusive running sums (value column -> new column) per ``group`` in ``(coarse, fine)`` order.

    ``coarse`` must be monotone in the wanted order. Slices are pre-summed map-side and
    carried forward, so the window that sorts rows holds one slice, not one group.
    """
    keys = [*group, coarse]
    earlier = Window.partitionBy(*group).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy(*fine).rowsBetween(Window.unboundedPreceding, 0)
    slices = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_slice_{v}") for v in totals])
    carried = slices.select(
        *keys, *[F.coalesce(F.sum(f"_slice_{v}").over(earlier), F.lit(0)).alias(f"_carried_{v}") for v in totals]
    )
    return (
        df.join(carried, keys)
        .withColumns({new: F.sum(v).over(inside) + F.col(f"_carried_{v}") for v, new in totals.items()})
        .drop(*[f"_carried_{v}" for v in totals])
    )


def _carried_parts(spark, sums: DataFrame) -> DataFrame:
    """``_part, _carried``: the sum of all earlier parts; one line per shuffle partition, whatever the rows."""
    lines, total = [], 0
    for part, value in sorted(tuple(r) for r in sums.collect()):
        lines.append(f"({part}, {total}L)")
        total += value
    return spark.sql(f"SELECT * FROM VALUES {', '.join(lines or ['(0, 0L)'])} AS s(_part, _carried)")


def with_running_sum(df: DataFrame, order_by: list[str | Column], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` over all rows in ``order_by`` order, by one range shuffle."""
    ordered = materialize(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))), "in-order")
    carried = _carried_parts(df.sparkSession, ordered.groupBy("_part").agg(F.sum(value).alias("n")))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ordered.join(F.broadcast(carried), "_part").withColumn(
        name, F.sum(value).over(inside) + F.col("_carried")).drop("_part", "_pos", "_carried")


def with_count_before(points: DataFrame, questions: DataFrame, at: str, late: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Number distinct ``points`` 0..n-1 by ``at`` and count for every question the points before it.

    A question with ``late`` 0 stands before the point at its own place, one with ``late`` 1 after it. Points and
    questions are sorted together by one range shuffle, so nothing is looked up and no group meets in one task.
    """
    mixed = points.select(at).distinct().withColumns({"_order": F.lit(1), "_is": F.lit(1).cast("long")}).unionByName(
        questions.withColumns({"_order": F.col(late) * 2, "_is": F.lit(0).cast("long")}), allowMissingColumns=True)
    counted = materialize(with_running_sum(mixed, [at, "_order"], "_is", name), "counted")
    found = counted.where("_order = 1").select(at, (F.col(name) - 1).alias(name))
    return found, counted.where("_order <> 1").select(*questions.columns, name)
