"""Target-distribution importance resampling: array-scored weights and ranks by regular sampling."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.textbytes import LOWER, Words, text_slices
from ledgermill.session import materialize

BUCKETS = 10_000
MIN_WORDS = 20
SHARE_PERCENT = 25
SEED = 7
# Rows that the regular samples of all runs may have together; they only balance the segments.
MAX_SAMPLES = 1 << 18

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_POSITION = (1 << 33) - 1


# -- features --------------------------------------------------------------------------

def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()
ONES = np.uint32(0xFFFFFFFF)
TABLE_LENGTH = 48  # longer words are hashed one by one


def _shift_tables() -> np.ndarray:
    """``[n, k, b]``: the checksum ``b << 8k`` after ``n`` more zero bytes."""
    state = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    out = [state]
    for _ in range(TABLE_LENGTH):
        state = CRC[state & 255] ^ (state >> 8)
        out.append(state)
    return np.stack(out)


SHIFT = _shift_tables()


def word_crcs(words: Words) -> np.ndarray:
    """The crc32 of every word, byte position by byte position."""
    lengths = words.ends - words.starts
    order = np.argsort(-lengths, kind="stable")
    starts, crc = words.starts[order], np.full(len(order), ONES, np.uint32)
    descending = -lengths[order]
    for k in range(min(int(lengths.max(initial=0)), TABLE_LENGTH)):
        active = int(np.searchsorted(descending, -k, "left"))  # words longer than k
        c = crc[:active]
        crc[:active] = CRC[(c ^ words.raw[starts[:active] + k]) & 255] ^ (c >> 8)
    out = np.empty_like(crc)
    out[order] = crc ^ ONES
    for i in np.flatnonzero(lengths > TABLE_LENGTH).tolist():
        out[i] = zlib.crc32(words.raw[words.starts[i]:words.ends[i]].tobytes())
    return out


def feature_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature: the words, then every two neighbours of one row joined by a space.

    The checksum of two joined texts is the first one's, moved over the length of the second, combined
    with the second's, so no pair is spelled out.
    """
    crc = word_crcs(words)
    first = np.flatnonzero(words.row[1:] == words.row[:-1])
    spaced = crc[first] ^ ONES
    spaced = CRC[(spaced ^ 0x20) & 255] ^ (spaced >> 8) ^ ONES
    second = first + 1
    length = (words.ends - words.starts)[second]
    short = np.minimum(length, TABLE_LENGTH)
    moved = SHIFT[short, 0, spaced & 255]
    for k in (1, 2, 3):
        moved = moved ^ SHIFT[short, k, (spaced >> np.uint32(8 * k)) & 255]
    pairs = moved ^ crc[second]
    for i in np.flatnonzero(length > TABLE_LENGTH).tolist():
        w = second[i]
        pairs[i] = zlib.crc32(words.raw[words.starts[w]:words.ends[w]].tobytes(), int(spaced[i]))
    return np.concatenate([crc, pairs]) % np.uint32(buckets), np.concatenate([words.row, words.row[first]])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: every task adds up its own, one row a bucket travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, borders in text_slices(batch):
                found, _ = feature_buckets(Words(LOWER[raw], borders, _IS_WORD), buckets)
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most one row a bucket
        out[row.bucket] = row.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of the smoothed shares' ratio, rounded down, in doubles."""
    size = len(raw)
    s_all, t_all = float(raw.sum() + size), float(target.sum() + size)
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist())
    ], np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains of a text's features, looked up in an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, borders in text_slices(batch):
                words = Words(LOWER[raw], borders, _IS_WORD)
                found, row = feature_buckets(words, len(gains))
                n_words = np.diff(words.first)
                n_features = np.bincount(row, minlength=rows.num_rows)
                # sums of whole numbers far below 2^53 are exact in doubles
                total = np.bincount(row, weights=gains[found], minlength=rows.num_rows).astype(np.int64)
                weight = np.floor_divide(total, np.maximum(n_features, 1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


# -- parallel sorting by regular sampling --------------------------------------------------

def _segments(scores: np.ndarray, ids: np.ndarray, split_scores: np.ndarray, split_ids: np.ndarray) -> np.ndarray:
    """How many splitters stand at or before each row, scores descending, then ids ascending."""
    low, high = np.zeros(len(scores), np.int64), np.full(len(scores), len(split_scores), np.int64)
    while (open_rows := low < high).any():
        middle = np.where(open_rows, (low + high) // 2, 0)
        s, d = split_scores[middle], split_ids[middle]
        before = (s > scores) | ((s == scores) & (d <= ids))
        low = np.where(open_rows & before, middle + 1, low)
        high = np.where(open_rows & ~before, middle, high)
    return low


def with_ranks(rows: DataFrame, score: str = "score", doc_id: str = "doc_id", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... by ``score`` descending, then ``doc_id`` ascending, null ids last.

    Every input partition is sorted where it is. Equally spaced rows of these runs are sorted together and
    equally spaced ones of them split the order into as many segments as there are runs; a segment is at
    most ``1/runs + 1/samples a run`` of all rows. Each row goes to its segment's partition, is merged there, and its
    rank is its place plus the sizes of the segments before. Hot scores split at their ids.
    """
    spark = rows.sparkSession
    last = F.lit((1 << 63) - 1).cast("long")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION))
    ordered = [F.col(score).desc(), F.col("_id").asc()]
    runs = rows.withColumn("_id", F.coalesce(F.col(doc_id), last)).sortWithinPartitions(*ordered)
    runs = materialize(runs.withColumns({"_run": F.spark_partition_id(), "_at": position}), "runs")
    # one row a run
    sizes = [r["count"] for r in runs.groupBy("_run").count().collect()]
    total, parts = sum(sizes), max(1, len(sizes))
    each = max(1, min(4 * parts, max_samples // parts))
    gap = max(1, total // (parts * each))
    sample = runs.where(F.pmod(F.col("_at"), F.lit(gap)) == gap // 2).select(score, "_id").toPandas()
    sample = sample.sort_values([score, "_id"], ascending=[False, True])
    at = [len(sample) * k // parts for k in range(1, parts)] if len(sample) else []
    split_scores, split_ids = sample[score].to_numpy()[at], sample["_id"].to_numpy()[at]

    @F.pandas_udf("int")
    def segment(scores: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(_segments(scores.to_numpy(), ids.to_numpy(), split_scores, split_ids))

    placed = runs.withColumn("_segment", segment(score, "_id")).repartitionById(parts, F.col("_segment"))
    merged = materialize(placed.sortWithinPartitions(*ordered).withColumn("_at", position), "segments")
    starts, before = [], 0
    for found in sorted(tuple(r) for r in merged.groupBy("_segment").count().collect()):  # one row a segment
        starts.append((found[0], before))
        before += found[1]
    prefix = spark.createDataFrame(pd.DataFrame(starts or [(0, 0)], columns=["_segment", "_before"]))
    return merged.join(F.broadcast(prefix), "_segment").withColumn(
        "rank", F.col("_before") + F.col("_at") + 1).select(*rows.columns, "rank")


# -- the operator ----------------------------------------------------------------------

def draw(
    docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, min_words: int = MIN_WORDS,
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank``.

    ``docs`` needs ``doc_id`` and ``text``, ``target`` needs ``text``; other columns are ignored. The weight
    compares the hashed words and pairs of neighbours of a text with those of all ``docs`` and all ``target``;
    the score adds Gumbel noise told by ``doc_id``, so the highest scores are a draw without replacement.
    ``rank`` is null for documents that are not drawn. Null, empty and wordless texts have no features and
    weight 0 and are not drawn; a null ``doc_id`` is written as nothing in the noise and comes last among
    equal scores; repeated rows are ranked one after the other; an empty table gives an empty table.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = materialize(weights(docs, gains).withColumn("score", F.col("weight") + noise), "weights")
    eligible = scored.where(F.col("n_words") >= min_words)
    drawn = eligible.count() * share_percent // 100
    ranked = with_ranks(eligible).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``doc_id`` :func:`draw` draws; parameters as there."""
    chosen = draw(docs, target, **parameters).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
