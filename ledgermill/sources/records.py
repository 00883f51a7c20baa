"""CSV records that run over several lines, read from splits of a file.

Whether a line begins inside quotes depends on everything before it. A split cannot know, but it can
say how it would end for either beginning. One line per split is enough to chain these answers through
a file; then every split cuts its own records, and the pieces of records that cross a border, at most two
a split, are put together by a shuffle of their own.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.session import materialize

# engine-side columns: full path (file names can repeat), position in the file
PATH, ROW_NUMBER = "_path", "_row_number"
# a record, the first piece of one that goes on in the next split, a further piece, the last one
WHOLE, OPENS, GOES_ON, CLOSES = 0, 1, 2, 3
Border = tuple[str, int]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside or outside quotes ends inside them.

    A quote opens a field only where the field begins; two inside a field are one quote of its text.
    """
    at, size = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            at, inside = at + 1, False
        elif at < size and line[at] == '"' and (at == 0 or line[at - 1] == ","):
            at, inside = at + 1, True
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias("_block"))


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each split and either beginning, outside or inside quotes: how it ends and whether a line of it ends inside."""
    states: dict[Border, list[tuple[bool, bool]]] = {}
    for batch in batches:
        for value, path, block in zip(batch["value"], batch[PATH], batch["_block"]):
            before = states.get((path, block), [(False, False), (True, False)])
            after = [(ends_inside(value, inside), open_) for inside, open_ in before]
            states[path, block] = [(inside, open_ or inside) for inside, open_ in after]
    rows = [(path, block, *outside, *inside) for (path, block), (outside, inside) in states.items()]
    yield pd.DataFrame(rows, columns=[PATH, "_block", "end_0", "open_0", "end_1", "open_1"])


_ANSWER = f"{PATH} string, _block long, end_0 boolean, open_0 boolean, end_1 boolean, open_1 boolean"


def open_borders(spark: SparkSession, paths: list[str]) -> set[Border] | None:
    """Splits that begin inside quotes; None if no line of the files ends inside them.

    Lines without a quote leave everything as it is and stay in the JVM. What comes to the driver is one
    line a split.
    """
    quoted = _lines(spark, paths).where(F.col("value").contains('"')).mapInPandas(_answers, _ANSWER)
    known = {(r[0], r[1]): ((r[2], r[3]), (r[4], r[5])) for r in quoted.collect()}

    def chained(borders: list[Border]) -> tuple[set[Border], bool]:
        found, broken, path, inside = set(), False, None, False
        for border in borders:
            if border[0] != path:
                path, inside = border[0], False
            if inside:
                found.add(border)
            inside, open_ = known.get(border, ((False, False), (True, True)))[inside]
            broken = broken or open_
        return found, broken

    if not chained(sorted(known))[1]:
        return None
    splits = _lines(spark, paths).select(PATH, "_block").distinct().collect()
    return chained(sorted((r[0], r[1]) for r in splits))[0]


def _cut(borders: set[Border]):
    """Lines of whole splits, in order, to records and pieces ``(path, block, seq, kind, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Border | None = None
        held: list[str] = []
        seq, inside, carried = 0, False, False
        rows: list[tuple] = []

        def put(kind: int) -> None:
            nonlocal seq
            text = "\n".join(held)
            held.clear()
            if kind == WHOLE and not text.strip():
                return
            rows.append((*now, seq, kind, text))
            seq += kind in (WHOLE, OPENS)

        def finish() -> None:
            if now is not None and held:
                put(GOES_ON if carried else OPENS)

        for batch in batches:
            for value, path, block in zip(batch["value"], batch[PATH], batch["_block"]):
                if (path, block) != now:
                    finish()
                    now, seq = (path, block), 0
                    inside = carried = now in borders
                held.append(value)
                inside = ends_inside(value, inside) if '"' in value else inside
                if not inside:
                    put(CLOSES if carried else WHOLE)
                    carried = False
            yield pd.DataFrame(rows, columns=[PATH, "_block", "_seq", "_kind", "text"])
            rows = []
        finish()
        yield pd.DataFrame(rows, columns=[PATH, "_block", "_seq", "_kind", "text"])

    return run


def read_records(spark: SparkSession, paths: list[str], borders: set[Border]) -> DataFrame:
    """The records of files with one header, all columns as text, with ``source_file``, path and row number."""
    cut = _lines(spark, paths).mapInPandas(_cut(borders), f"{PATH} string, _block long, _seq int, _kind int, text string")
    cut = materialize(cut, "records")
    whole = cut.where(F.col("_kind") == WHOLE).select(PATH, "_block", "_seq", "text")
    # at most two pieces a split; the pieces of one record follow the one that opens it
    pieces = cut.where(F.col("_kind") != WHOLE)
    upto = Window.partitionBy(PATH).orderBy("_block", F.col("_kind") == OPENS).rowsBetween(Window.unboundedPreceding, 0)
    opened = pieces.withColumn("record", F.last(
        F.when(F.col("_kind") == OPENS, F.struct("_block", "_seq")), ignorenulls=True).over(upto))
    joined = opened.groupBy(PATH, "record").agg(
        F.array_sort(F.collect_list(F.struct("_block", (F.col("_kind") == OPENS).alias("last"), "text"))).alias("parts"))
    joined = joined.select(PATH, "record._block", "record._seq", F.array_join("parts.text", "\n").alias("text"))
    records = whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))
    # one line a split
    earlier = Window.partitionBy(PATH).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.where(F.col("_kind").isin(WHOLE, OPENS)).groupBy(PATH, "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        PATH, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # the header is record 0 of a file
    records = materialize(
        records.join(blocks, [PATH, "_block"]).withColumn(ROW_NUMBER, F.col("_seq") + F.col("_before")).drop("_block", "_seq", "_before"),
        "numbered-records")
    first = records.where(F.col(ROW_NUMBER) == 0).select("text").first()
    header = next(csv.reader([first[0].lstrip("\ufeff")])) if first else []
    names = [h or f"_c{i}" for i, h in enumerate(header)]
    schema = ", ".join(f"`c{i}` string" for i in range(len(names))) or "c0 string"
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    fields = records.where(F.col(ROW_NUMBER) > 0).withColumn("_fields", F.from_csv("text", schema, options))
    return fields.select(
        *[F.col(f"_fields.c{i}").alias(n) for i, n in enumerate(names)],
        F.element_at(F.split(PATH, "/"), -1).alias("source_file"), PATH, F.col(ROW_NUMBER).cast("long").alias(ROW_NUMBER))
