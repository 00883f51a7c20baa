"""Reference similarity: the one measure Spark has no expression for."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# workers need no installed copy of the package: these functions travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN_SIMILARITY = 0.5


# Longer texts are compared one by one: a table of their characters would not pay.
LONGEST = 512
# cells of the comparison table of one lot of pairs
CELLS = 2_000_000
# From this length of the right text on, characters that are more frequent than one in a hundred
# begin no block, they only lengthen one.
POPULAR_FROM, POPULAR_SHARE = 200, 100


def _codes(texts: list[str]) -> np.ndarray:
    """Character codes, one text per column."""
    width = max(map(len, texts))
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).T.astype(np.int32)


def _usable(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which characters of the right texts may begin a block."""
    usable = np.ones(codes.shape, dtype=bool)
    for column in np.flatnonzero(lengths >= POPULAR_FROM):
        n = lengths[column]
        _, place, count = np.unique(codes[:n, column], return_inverse=True, return_counts=True)
        usable[:n, column] = count[place] <= n // POPULAR_SHARE + 1
    return usable


def _batched_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Matching-blocks ratio of many pairs at once.

    Each open piece of each pair gets its longest common block (first in the left text,
    then first in the right one); what lies before and after the block stays open.
    """
    at_left, some_left = pd.factorize(np.array(left, dtype=object))
    at_right, some_right = pd.factorize(np.array(right, dtype=object))
    n_left = np.array([len(t) for t in some_left])[at_left]
    lengths = np.array([len(t) for t in some_right])
    n_right = lengths[at_right]
    a, codes = _codes(list(some_left))[:, at_left], _codes(list(some_right))
    b, usable = codes[:, at_right], None
    if lengths.max() >= POPULAR_FROM:
        usable = _usable(codes, lengths)[:, at_right]
    matched = np.zeros(len(left), dtype=np.int64)
    rows_a, rows_b = np.arange(a.shape[0])[:, None], np.arange(b.shape[0])[:, None]
    pair = np.arange(len(left))
    a0, a1, b0, b1 = np.zeros_like(pair), n_left, np.zeros_like(pair), n_right
    while len(pair):
        # characters outside the open piece become codes that equal nothing
        one = np.where((rows_a >= a0) & (rows_a < a1), a[:, pair], -1)
        two = np.where((rows_b >= b0) & (rows_b < b1), b[:, pair], -2)
        begins = two if usable is None else np.where(usable[:, pair], two, -2)
        run = np.zeros(two.shape, dtype=np.int16)
        size, end_a, end_b = np.zeros(len(pair), dtype=np.int64), a0.copy(), b0.copy()
        for i in range(int(a0.min()), int(a1.max())):
            hit = begins == one[i]
            run[1:] = (run[:-1] + 1) * hit[1:]
            run[0] = hit[0]
            best = run.max(axis=0)
            better = np.flatnonzero(best > size)
            if len(better):
                size[better], end_a[better] = best[better], i + 1
                end_b[better] = run[:, better].argmax(axis=0) + 1
        if usable is not None:
            # frequent characters next to the block: before it, then after it
            open_ = np.flatnonzero((end_a - size > a0) & (end_b - size > b0))
            while len(open_):
                open_ = open_[one[(end_a - size)[open_] - 1, open_] == two[(end_b - size)[open_] - 1, open_]]
                size[open_] += 1
                open_ = open_[((end_a - size) > a0)[open_] & ((end_b - size) > b0)[open_]]
            open_ = np.flatnonzero((end_a < a1) & (end_b < b1))
            while len(open_):
                open_ = open_[one[end_a[open_], open_] == two[end_b[open_], open_]]
                for grown in (size, end_a, end_b):
                    grown[open_] += 1
                open_ = open_[(end_a < a1)[open_] & (end_b < b1)[open_]]
        np.add.at(matched, pair, size)
        found = size > 0
        before = found & (end_a - size > a0) & (end_b - size > b0)
        after = found & (a1 > end_a) & (b1 > end_b)
        pair, a0, a1, b0, b1 = (
            np.concatenate([pair[before], pair[after]]),
            np.concatenate([a0[before], end_a[after]]),
            np.concatenate([(end_a - size)[before], a1[after]]),
            np.concatenate([b0[before], end_b[after]]),
            np.concatenate([(end_b - size)[before], b1[after]]),
        )
    return 2.0 * matched / (n_left + n_right)


def matching_ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matching-blocks ratios of pairs of texts."""
    out = np.zeros(len(a))
    longest = np.maximum(*(np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b)))
    # lots of pairs of similar length, so that a long text does not widen the table of short ones
    order = np.argsort(longest, kind="stable")
    batched = int(np.searchsorted(longest[order], LONGEST, "right"))
    at = 0
    while at < batched:
        width = max(16, 2 * int(longest[order[at]]))
        to = min(batched, int(np.searchsorted(longest[order], width, "right")), at + max(1, CELLS // width))
        lot = order[at:to]
        out[lot] = _batched_ratios(a[lot].tolist(), b[lot].tolist())
        at = to
    for i in order[batched:]:
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    return out


def _matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    out = np.full(len(left), np.nan)
    wanted = np.flatnonzero(left.notna().to_numpy())
    out[wanted] = matching_ratios(left.to_numpy()[wanted], right.to_numpy()[wanted])
    return pd.Series(out)


def is_blank(ref: Column) -> Column:
    return ref.isNull() | (ref == "")


def reference_similarity(ref_a: Column, ref_b: Column) -> Column:
    """0.5 when a side is blank, 1.0 when equal, else the matching-blocks ratio.

    The trivial cases stay native: the Python side receives nulls for them.
    """
    blank = is_blank(ref_a) | is_blank(ref_b)
    compare = ~blank & (ref_a != ref_b)
    ratio = F.pandas_udf(_matching_ratio, T.DoubleType())(F.when(compare, ref_a), F.when(compare, ref_b))
    return F.when(blank, F.lit(UNKNOWN_SIMILARITY)).when(ref_a == ref_b, F.lit(1.0)).otherwise(ratio)
