"""Small document tables with awkward rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# names that the operators use for columns of their own
CLASHING = ["digest", "key", "fp", "h", "low", "line", "leaf", "row", "score", "predicted", "n_tokens", "piece", "starts",
            "ranges", "lines", "component_id", "rank", "place", "toxic", "w"]


def documents(spark: SparkSession, rows: list[tuple], partitions: int = 3) -> DataFrame:
    """``(doc_id, text)`` rows with the columns of ``documents`` and clashing ones."""
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    return table.withColumns({
        "lang": F.lit("en"), "source": F.lit("src0"), "n_chars": F.length("text").cast("long"), **{c: F.lit(1) for c in CLASHING}})


def prose(seed: int, words: int) -> str:
    chosen = random.Random(seed)
    return " ".join("".join(chosen.choice("abcdefgéß") for _ in range(chosen.randint(1, 7))) for _ in range(words))


def awkward() -> list[tuple]:
    """Nulls, empty, blank, repeated, copied, nearly copied and very long texts."""
    base, long = prose(1, 120), prose(2, 20_000)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        (1, base), (2, base), (3, base.upper()), (4, near), (5, ""), (6, None), (7, " \t\n"), (8, "one"), (8, "one"),
        (None, base), (10, prose(3, 30) + " " + " ".join(words[20:90])), (11, long), (12, long[:50_000]),
        (13, "a\x00b " * 200), (14, "same " * 300), (15, "あい " * 40), (16, prose(4, 19)), (17, prose(5, 20)),
    ]
