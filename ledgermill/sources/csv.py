"""CSV exports: every column read as text, each row tagged with file and position."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.operators.prefix import with_dense_index
from ledgermill.session import materialize
from ledgermill.sources.records import PATH, ROW_NUMBER, open_borders, read_records

HEADER_BYTES = 1 << 14
FILE_KINDS = ("payroll", "trust", "transactions")


def read_export(spark: SparkSession, path: str | list[str], column_mapping: dict[str, str] | None = None) -> DataFrame:
    """One export (file, folder or glob of files with one header) with ``source_file`` and row numbers.

    ``column_mapping`` renames headers; absent ones are warned about. A quote inside a quoted field is
    written twice. Files without line breaks inside quotes are read by Spark's own reader; the others by
    :mod:`ledgermill.sources.records`. Both work on splits of a file.
    """
    paths = [path] if isinstance(path, str) else path
    borders = open_borders(spark, paths)
    if borders is None:
        raw = spark.read.options(header=True, inferSchema=False, quote='"', escape='"').csv(paths)
        tagged = raw.select(
            "*",
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_path").alias(PATH),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_scan"),
        )
        df, names = _numbered(materialize(tagged, "scan")), raw.columns
    else:
        df = read_records(spark, paths, borders)
        names = df.columns
    for source, target in (column_mapping or {}).items():
        if source in names:
            df = df.withColumnRenamed(source, target)
        else:
            warnings.warn(f"No header reads '{source}', so nothing becomes '{target}'")
    return df


def _numbered(tagged: DataFrame) -> DataFrame:
    """Row number in the file = rows in earlier blocks + position in its own block.

    A block is one scan split, read in order by one task, so no file is ever sorted; the
    block table has one line per split.
    """
    earlier = Window.partitionBy(PATH).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = tagged.groupBy(PATH, "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_scan").alias("_first")).select(
        PATH, "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        tagged.join(blocks, [PATH, "_block"])
        .withColumn(ROW_NUMBER, F.col("_scan") - F.col("_first") + F.col("_before") + 1)
        .drop("_block", "_scan", "_first", "_before")
    )


def with_row_numbers(df: DataFrame, source_file: str = "source_file", order_by: list[str] | None = None) -> DataFrame:
    """Per-file row numbers for tables that carry no file position.

    Without ``order_by`` the order the table arrives in is pinned to storage first.
    """
    if ROW_NUMBER in df.columns:
        return df
    if order_by is None:
        df = materialize(df.withColumn("_scan", F.monotonically_increasing_id()), "arrival")
        order_by = ["_scan"]
    numbered = with_dense_index(df, [source_file, *order_by], "_n")
    # one line per file, stored so that its true size decides the join
    first = materialize(numbered.groupBy(source_file).agg(F.min("_n").alias("_first")), "files")
    return (
        numbered.join(first, source_file)
        .withColumn(ROW_NUMBER, F.col("_n") - F.col("_first") + 1)
        .drop("_n", "_first", "_scan")
    )


def read_exports(
    spark: SparkSession,
    paths: list[str],
    column_mapping: dict[str, str] | None = None,
    file_type: str = "transactions",
) -> DataFrame:
    """Union of several exports, one scan per header; missing columns become null."""
    if file_type not in FILE_KINDS:
        raise ValueError(f"file_type is '{file_type}', known are {', '.join(FILE_KINDS)}")
    if not paths:
        return spark.createDataFrame([], "source_file string")
    frames = [read_export(spark, group, column_mapping) for group in group_by_header(spark, paths).values()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def list_exports(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files in a folder, through the file system Spark itself uses."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.csv"))
    paths = sorted(s.getPath().toString() for s in found or [])
    if not paths:
        warnings.warn(f"{folder} holds no *.csv file")
    return paths


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lines = []
        for uri in batch["path"]:
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            line = b""
            with fs.open_input_stream(path) as stream:
                while b"\n" not in line and (block := stream.read(HEADER_BYTES)):
                    line += block
            lines.append(line.split(b"\n", 1)[0].decode("utf-8", "replace").rstrip("\r"))
        yield pd.DataFrame({"path": batch["path"], "header": lines})


def group_by_header(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files by header line, so each distinct header is one scan instead of one per file.

    Spark lists the files; executors read the first block of each one only.
    """
    listed = spark.read.format("binaryFile").load(paths).select("path")
    first = listed.mapInPandas(_first_lines, "path string, header string")
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("header", "path").toLocalIterator():
        groups.setdefault(row.header, []).append(row.path)
    return groups
