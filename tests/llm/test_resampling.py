"""Importance resampling against a row-by-row statement, and its sort by regular sampling."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgermill.llm import resampling as R
from ledgermill.llm.textbytes import LOWER, Words, text_bytes
from text_tables import awkward, documents, prose

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def stated(rows, items, share=25, least=20, buckets=10_000, seed=7):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))

    s, t = counts(x for _, x in rows), counts(items)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    eligible = sorted((-score, doc is None, doc or 0, n, w) for doc, n, w, score, k in out if k >= least)
    result = Counter((doc, n, w, score, None) for doc, n, w, score, k in out if k < least)
    for place, (score, none, doc, n, w) in enumerate(eligible):
        result[(None if none else doc, n, w, -score, place + 1 if place < share * len(eligible) // 100 else None)] += 1
    return result


def test_crc_of_words_and_neighbours():
    texts = ["one two  Three", "", None, "x", "é" * 60 + " ab " + "ü" * 30 + " " + "q" * 200, "a" * 48 + " " + "b" * 49]
    raw, borders = text_bytes(pa.array(texts))
    found, row = R.feature_buckets(Words(LOWER[raw], borders, R._IS_WORD), 1 << 31)
    want = Counter((i, zlib.crc32(f.encode()) % (1 << 31)) for i, t in enumerate(texts) for f in features(t))
    assert Counter(zip(row.tolist(), found.tolist())) == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_draw_equals_the_statement(spark, partitions):
    rows = awkward() + [(100 + i, prose(i, 15 + i % 20)) for i in range(60)] + [(500, prose(9, 40))] * 3
    items = [prose(2, 50), None, "", prose(7, 30)]
    target = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, score int")
    got = R.draw(documents(spark, rows, partitions), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == stated(rows, items)


def test_empty_tables(spark):
    empty = documents(spark, [])
    target = spark.createDataFrame([], "text string")
    assert R.draw(empty, target).collect() == []
    rows = [(1, prose(1, 30)), (2, None)]
    assert Counter(tuple(r) for r in R.draw(documents(spark, rows), target).collect()) == stated(rows, [])


def test_ranks_with_hot_scores(spark):
    chosen = random.Random(3)
    rows = [(i, 5 if i % 3 else chosen.randint(-9, 9)) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, score long").repartition(9)
    want = {d: k + 1 for k, (d, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    for samples in (R.MAX_SAMPLES, 9):
        got = R.with_ranks(table, max_samples=samples).collect()
        assert {r.doc_id: r["rank"] for r in got} == want


def test_segments_are_balanced():
    order = np.lexsort((np.arange(1000), np.full(1000, -4)))
    scores, ids = np.full(1000, 4), order
    found = R._segments(scores, ids, np.full(3, 4), np.array([250, 500, 750]))
    assert np.bincount(found).tolist() == [250, 250, 250, 250]


def test_resample_keeps_whole_rows(spark):
    rows = [(i, prose(i, 25)) for i in range(40)]
    docs, target = documents(spark, rows), spark.createDataFrame([(prose(3, 25),)], "text string")
    kept = R.resample(docs, target)
    ranked = {r.doc_id for r in R.draw(docs, target).collect() if r["rank"]}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == ranked and len(ranked) == 10
