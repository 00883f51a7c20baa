"""Hash and size of input and output files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for uri in batch["path"]:
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with fs.open_input_stream(path) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)[["filename", "sha256", "file_size_bytes"]]


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``filename, sha256, file_size_bytes`` of every file below ``path``.

    Spark lists the files without reading them; executors read each one in blocks, so a file of any
    size takes constant memory. The store must be one that pyarrow opens by its URI.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size_bytes"))
    )
    return files.mapInPandas(_hashed, "filename string, sha256 string, file_size_bytes long")
