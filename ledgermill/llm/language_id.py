"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.textbytes import text_slices

PROFILE_SIZE = 300
UNKNOWN = "und"
_BOUNDARY = 1


@cache
def _letter_codes() -> np.ndarray:
    """Ten-bit code of every code point: Latin letters one each, other letters spread over the rest, 1 for anything else."""
    points = np.arange(sys.maxunicode + 1, dtype=np.int64)
    letters = np.fromiter((chr(p).isalpha() for p in range(len(points))), bool, len(points))
    codes = np.where(points < 768, points, 768 + points * 2654435761 % 4294967291 % 256)
    return np.where(letters, codes, _BOUNDARY).astype(np.uint32)


def grams(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All 1- to 3-grams of lower-cased letters, and the ``n + 1`` row borders.

    Whatever is no letter is a boundary; a run of them is one, and every row starts and ends with one.
    """
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edges = lead[borders]
    codes = _letter_codes()[points]
    rows = len(borders) - 1
    # a boundary before each row's first point
    spread = np.full(len(codes) + rows, _BOUNDARY, np.uint32)
    place = np.arange(len(codes)) + 1 + np.repeat(np.arange(rows), np.diff(edges))
    spread[place] = codes
    starts = edges[:-1] + np.arange(rows)
    keep = np.ones(len(spread), bool)
    keep[1:] = (spread[1:] != _BOUNDARY) | (spread[:-1] != _BOUNDARY)
    keep[starts] = True  # a row keeps its own opening boundary
    new = np.concatenate([[0], np.cumsum(keep)])
    text, first = spread[keep], np.append(new[starts], new[-1])
    n = len(text)
    table = np.zeros((n, 3), np.uint32)
    table[:, 0] = text
    table[:-1, 1] = (text[:-1] << 10) | text[1:]
    table[:-2, 2] = (text[:-2] << 20) | (text[1:-1] << 10) | text[2:]
    # grams stay in their row: what would follow a row's last point is a boundary, and after it nothing
    table[text == _BOUNDARY, 0] = 0
    last = first[1:] - 1
    table[last, 1] = np.where(text[last] == _BOUNDARY, 0, (text[last] << 10) | np.uint32(_BOUNDARY))
    table[last, 2] = 0
    inner = last[last > first[:-1]] - 1
    table[inner, 2] = np.where(
        text[inner + 1] == _BOUNDARY, 0, (text[inner] << 20) | (text[inner + 1] << 10) | np.uint32(_BOUNDARY))
    return table.ravel(), first * 3


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    values = values[np.searchsorted(values, 1):]
    change = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[change], np.diff(np.append(change, len(values)))


def top_grams(values: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent grams, most frequent first, equal counts by gram."""
    kinds, counts = _counted(values)
    if len(kinds) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        kinds, counts = kinds[near], counts[near]
    return kinds[np.lexsort((kinds, -counts))][:size]


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """The ``size`` most frequent grams of each ``lang`` over all rows with a language and a text.

    Tasks add up their own counts; the driver gets ``size`` grams per language, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lowered = pc.utf8_lower(batch.column("text"))
            for lang in pc.unique(batch.column("lang")).to_pylist():
                rows = pa.RecordBatch.from_arrays([lowered.filter(pc.equal(batch.column("lang"), lang))], ["text"])
                for _, raw, borders in text_slices(rows):
                    kinds, counts = _counted(grams(raw, borders)[0])
                    if lang in sums:
                        both = np.concatenate([sums[lang][0], kinds])
                        amounts = np.concatenate([sums[lang][1], counts])
                        kinds, back = np.unique(both, return_inverse=True)
                        counts = np.bincount(back, amounts, len(kinds)).astype(np.int64)
                    sums[lang] = kinds, counts
        for lang, (kinds, counts) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(kinds)), pa.array(kinds.astype(np.int64)), pa.array(counts.astype(np.int64))],
                ["lang", "gram", "n"])

    counted = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(
        count, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = (
        counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    )
    profiles: dict[str, list[int]] = {}
    for lang, gram, _, _ in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(lang, []).append(gram)
    return profiles


class Profiles:
    """Profiles as one table of ranks, for out-of-place distances."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.size, self.langs = size, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint32))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], np.uint32)), k] = np.arange(len(profiles[lang]))

    def predict(self, values: np.ndarray) -> tuple[str, float]:
        """Nearest language and its closeness: 1 for equal ranks, 0 when no gram is shared."""
        best = top_grams(values, self.size)
        if not len(best) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, best)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == best, at, len(self.grams))
        ranks = self.ranks[at]
        away = np.minimum(np.abs(ranks - np.arange(len(best))[:, None]), self.size)
        away[ranks < 0] = self.size
        distance = away.sum(axis=0)
        k = int(np.argmin(distance))
        return self.langs[k], float(1.0 - distance[k] / (self.size * len(best)))


def held_out_rows():
    """Rows kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> DataFrame:
    """``doc_id, lang_pred, score`` for every document.

    The document's most frequent grams are compared with each profile by out-of-place distance; a
    gram that a profile lacks counts as the profile's length. Ties go to the first language by name.
    Null texts and texts without a letter are ``und`` with score 0, and so is everything when there
    is no profile. Repeated rows give repeated rows; other columns are ignored; an empty table gives
    an empty table. The whole text counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Profiles(profiles, size)
        for batch in batches:
            lowered = pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.utf8_lower(batch.column("text"))], ["doc_id", "text"])
            for rows, raw, borders in text_slices(lowered):
                values, first = grams(raw, borders)
                found = [ready.predict(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
