"""Repeated byte strings by two-stage suffix sorting of the places where texts can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.textbytes import BASES, SpanHashes, mix, place, text_slices
from ledgermill.session import discard, materialize

LENGTH = 400
GRAM = 8
# Distinct segments under one key that are sorted in one task; a key with more is cut finer.
KEY_SEGMENTS = 2000
SORT_BYTES = 512 << 10


# -- suffix sorting --------------------------------------------------------------------

def suffix_array(symbols: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Two-stage suffix sorting of ``symbols`` (uint8, 0 ends a text), in order up to ``depth`` symbols.

    First stage: only suffixes smaller than their successor are sorted directly. Second stage: all
    others are induced. Buckets of first symbols are scanned from the smallest; the suffix one
    place before a scanned one, if it starts with a larger or the same symbol, is next in its bucket.

    With ``wanted``, a mask, only these suffixes are put in order, and those that they are induced from: the
    ones up to the first directly sorted suffix behind each run of wanted places.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    text = symbols.tobytes()
    # a run of one symbol takes its type from the symbol after the run
    change = np.flatnonzero(np.append(symbols[1:] != symbols[:-1], True))
    rises = np.append(symbols[change[:-1] + 1] > symbols[change[:-1]], False)
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
    smaller[symbols == 0] = True  # text ends are placed directly and never induced
    needed = np.ones(n, bool)
    if wanted is not None:
        sorted_places = np.flatnonzero(smaller)
        run_ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False)) + 1
        run_ends = run_ends[run_ends < n]
        reached = sorted_places[np.minimum(np.searchsorted(sorted_places, run_ends), len(sorted_places) - 1)]
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, run_ends, 1)
        np.add.at(steps, np.maximum(reached + 1, run_ends), -1)
        needed = wanted | (np.cumsum(steps)[:n] > 0)
    direct = np.flatnonzero(smaller & (symbols > 0) & needed).tolist()
    direct.sort(key=lambda i: text[i:i + depth])
    direct = np.array(direct, np.int64)
    heads = symbols[direct]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(found: np.ndarray, into_same: bool) -> np.ndarray:
        """Send on the predecessors that are induced; those of the same symbol are returned."""
        before = found[found > 0] - 1
        before = before[~smaller[before] & needed[before]]
        first = symbols[before]
        here = symbols[found[0]] if len(found) else 0
        own = before[first == here] if into_same else before[:0]
        rest, first = before[first > here], first[first > here]
        if len(rest):
            order = np.argsort(first, kind="stable")
            rest, first = rest[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(rest, cuts):
                waiting[symbols[part[0]]].append(part)
        return own

    for c in range(256):
        if c == 0:
            own = np.flatnonzero((symbols == 0) & needed)
            if len(own):
                out.append(own)
                induce(own, False)
            continue
        larger = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(larger):
            out.append(larger)
            larger = induce(larger, True)
        own = direct[np.searchsorted(heads, c):np.searchsorted(heads, c, "right")]
        if len(own):
            out.append(own)
            induce(own, False)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    """Lengths, up to ``limit``, of the common prefixes of suffix pairs, eight symbols at a time."""
    padded = np.concatenate([symbols, np.zeros(limit + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    lengths = np.zeros(len(left), np.int64)
    active = np.arange(len(left))
    for step in range(0, limit, 8):
        same = words[left[active] + step] == words[right[active] + step]
        whole = same.all(axis=1)
        ended = active[~whole]
        lengths[ended] = step + np.argmin(same[~whole], axis=1)
        active = active[whole]
        if not len(active):
            break
    lengths[active] = limit
    return np.minimum(lengths, limit)


def repeated_starts(segments: list[bytes], valid: list[tuple[int, int]], weights: list[int], length: int) -> list[np.ndarray]:
    """For each segment the starts in its ``valid`` range whose ``length`` bytes occur twice or more.

    ``weights`` says how often a segment occurs; a copy is not sorted twice. A start repeats when
    its segment does, or when it and a neighbour in suffix order share ``length`` symbols.
    """
    sizes = np.array([len(s) + 1 for s in segments])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # UTF-8 has no byte above 0xF4, so one is added and 0 ends each segment
    joined = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
    is_start = np.zeros(len(joined), bool)
    for b, (lo, hi) in zip(begin.tolist(), valid):
        is_start[b + lo:b + hi] = True
    order = suffix_array(joined, length, is_start)
    hit = np.zeros(len(joined), bool)
    if len(order) > 1:
        shared = common_prefixes(joined, order[:-1], order[1:], length) >= length
        hit[order[:-1][shared]] = True
        hit[order[1:][shared]] = True
    out = []
    for b, (lo, hi), weight in zip(begin.tolist(), valid, weights):
        out.append(np.arange(lo, hi) if weight > 1 else np.flatnonzero(hit[b + lo:b + hi]) + lo)
    return out


# -- where texts can repeat ------------------------------------------------------------

def _grams(raw: np.ndarray) -> np.ndarray:
    """Mixed value of the ``GRAM`` bytes from every position (zeros after the end)."""
    padded = np.concatenate([raw, np.zeros(GRAM, np.uint8)]).astype(np.uint64)
    value = np.zeros(len(raw), np.uint64)
    for k in range(GRAM):
        value = (value << np.uint64(8)) | padded[k:k + len(raw)]
    return mix(value)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value in every window of ``width``."""
    n = len(values) - width + 1
    # positions ride in the low bits: ties go to the first one
    low = np.uint64((1 << 24) - 1)
    best = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    rest = width - span
    best = np.minimum(best[:n], best[rest:rest + n])
    return (best & low).astype(np.int64)


def _anchors(raw: np.ndarray, borders: np.ndarray, length: int, reach: int):
    """Anchors of all strings of ``length`` bytes: row, position, first and last start, three hashes.

    A string's anchor is the smallest gram among its first ``reach`` positions, so equal strings
    have it at the same place; starts that share an anchor follow each other. ``core`` hashes the
    bytes all strings with this anchor contain; ``c1, c2`` hash the segment of all its starts.
    """
    out = []
    grams = _grams(raw)
    first, second = SpanHashes(grams), SpanHashes(grams, BASES[1])
    for row in np.flatnonzero(np.diff(borders) >= length).tolist():
        a, b = int(borders[row]), int(borders[row + 1])
        starts = b - a - length + 1
        place = _window_minima(grams[a:a + starts + reach - 1], reach) + a if starts + reach - 1 < 1 << 24 else _long_minima(grams, a, starts, reach)
        change = np.flatnonzero(np.append(place[1:] != place[:-1], True))
        last = change
        begin = np.concatenate([[0], change[:-1] + 1])
        at = place[begin]
        core = mix(first.of(at, at + (length - reach - GRAM + 2)))
        lo, hi = begin + a, last + a + length - GRAM + 1
        span = ((at - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
        out.append((np.full(len(at), row), at - a, begin, last + 1, core, mix(first.of(lo, hi) + span), mix(second.of(lo, hi) ^ span)))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def _long_minima(grams: np.ndarray, a: int, starts: int, reach: int) -> np.ndarray:
    """``_window_minima`` piece by piece for a very long text."""
    step = 1 << 22
    return np.concatenate([
        _window_minima(grams[a + s:a + min(s + step, starts) + reach - 1], reach) + a + s for s in range(0, starts, step)])


_ANCHOR = "doc_id long, at int, begin int, end int, key long, c1 long, c2 long"


def anchor_segments(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """One row per anchor: starts ``begin <= s < end`` (bytes) of its document have it at ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, borders in text_slices(batch):
                found = _anchors(raw, borders, length, reach)
                if found is None:
                    continue
                row, at, begin, end, key, c1, c2 = found
                ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row].astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(begin.astype(np.int32)),
                     pa.array(end.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (key, c1, c2))],
                    [f.split()[0] for f in _ANCHOR.split(", ")])

    return docs.mapInArrow(run, _ANCHOR)


def _cut_segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of wanted segments ``(key, c1, c2, weight, doc_id, begin, end)``, read from their documents."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "c1", "c2", "weight", "begin", "end")).alias("w"))
    lists = materialize(lists, "segment-lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for doc, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "w"))):
                data = text.encode()
                for x in items:
                    piece = data[x["begin"]:x["end"] - 1 + length]
                    for o, v in zip(out, (x["key"], x["c1"], x["c2"], x["weight"], x["end"] - x["begin"], doc, piece)):
                        o.append(v)
                    size += len(piece)
                if size > 4 << 20:
                    yield _segment_batch(out)
                    out, size = [[] for _ in range(7)], 0
            if out[0]:
                yield _segment_batch(out)

    return docs.join(lists, "doc_id").select("doc_id", "text", "w").mapInArrow(
        run, "key long, c1 long, c2 long, weight long, starts int, doc_id long, piece binary")


def _segment_batch(out: list[list]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(out, types)], ["key", "c1", "c2", "weight", "starts", "doc_id", "piece"])


def _sort_keys(length: int):
    """Sorted rows of ``(key, c1, c2, weight, starts, piece)`` to repeated start ranges per segment."""

    def sorted_ranges(held: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([h[5] for h in held], [(0, h[4]) for h in held], [h[3] for h in held], length)
        out: list[list] = [[], [], [], [], []]
        for h, starts in zip(held, found):
            if not len(starts):
                continue
            breaks = np.flatnonzero(np.diff(starts) > 1)
            lows, highs = starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])]
            for lo, hi in zip(lows.tolist(), highs.tolist()):
                for o, v in zip(out, (h[0], h[1], h[2], lo, hi + 1)):
                    o.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, [pa.int64()] * 3 + [pa.int32()] * 2)], ["key", "c1", "c2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "c1", "c2", "weight", "starts", "piece"))
            for row in zip(*columns):
                if size > SORT_BYTES and row[0] != held[-1][0]:  # whole keys only
                    yield sorted_ranges(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield sorted_ranges(held)

    return run


def _pieces_cut_finer(length: int, reach: int):
    """Segments to shorter ones: their own anchors at a smaller reach, with the place in the longer segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, borders in text_slices(batch.rename_columns(["key", "c1", "c2", "weight", "starts", "text"]), 64 << 10):
                found = _anchors(raw, borders, length, reach)
                if found is None:
                    continue
                row, _, begin, end, key, c1, c2 = found
                data = raw.tobytes()
                at = (borders[row] + begin).tolist()
                pieces = [data[i:i + n] for i, n in zip(at, (end - begin - 1 + length).tolist())]
                parents = [pa.array(rows.column(c).to_numpy()[row]) for c in ("key", "c1", "c2")]
                yield pa.RecordBatch.from_arrays(
                    [*parents, pa.array(begin.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (key, c1, c2)),
                     pa.array(rows.column("weight").to_numpy()[row]), pa.array((end - begin).astype(np.int32)),
                     pa.array(pieces, pa.binary())],
                    ["pkey", "p1", "p2", "place", "key", "c1", "c2", "weight", "starts", "piece"])

    return run


_CHILD = "pkey long, p1 long, p2 long, place int, key long, c1 long, c2 long, weight long, starts int, piece binary"
_RANGE = "key long, c1 long, c2 long, lo int, hi int"


def _piece_ranges(pieces: DataFrame, length: int, reach: int, key_segments: int) -> DataFrame:
    """Repeated start ranges of distinct segments ``(key, c1, c2, weight, starts, piece)``.

    The segments of a key are sorted in one task. A key with more than ``key_segments`` of them is
    cut into shorter segments with longer cores, which spread over many keys; equal ones are again
    one weighted segment, and what is found for it holds at its place in every longer one. At a
    reach of 1 a key is the string itself and has one segment.
    """
    sizes = materialize(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("segments"), F.sum("weight").alias("copies")), "key-sizes")
    sized = pieces.join(sizes.where("copies > 1"), "key")
    if reach == 1:
        key_segments = (1 << 63) - 1  # one segment a key, whatever the hash says
    small = sized.where(F.col("segments") <= key_segments).select("key", "c1", "c2", "weight", "starts", "piece")
    ranges = materialize(small.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_keys(length), _RANGE), "segment-ranges")
    crowded = sizes.where(F.col("segments") > key_segments).select("key")
    if crowded.isEmpty():
        return ranges
    reach = max(1, reach // 4)
    children = materialize(
        pieces.join(crowded, "key").select("key", "c1", "c2", "weight", "starts", "piece")
        .mapInArrow(_pieces_cut_finer(length, reach), _CHILD), "finer-segments")
    kinds = children.groupBy("key", "c1", "c2").agg(
        F.sum("weight").alias("weight"), F.first("starts").alias("starts"), F.first("piece").alias("piece"))
    found = _piece_ranges(materialize(kinds, "finer-kinds"), length, reach, key_segments)
    above = children.drop("piece").join(found, ["key", "c1", "c2"]).select(
        F.col("pkey").alias("key"), F.col("p1").alias("c1"), F.col("p2").alias("c2"),
        (F.col("place") + F.col("lo")).alias("lo"), (F.col("place") + F.col("hi")).alias("hi"))
    return ranges.unionByName(materialize(above, "finer-ranges"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, key_segments: int = KEY_SEGMENTS) -> DataFrame:
    """``(doc_id, lo, hi)``: starts ``lo <= s < hi`` whose ``length`` bytes also start anywhere else.

    Equal strings have equal anchors and equal cores, so all strings that can be equal meet under
    one key, the hash of the core. Keys that occur once are dropped. Equal segments (128 hash bits)
    are one weighted segment, read once from one document; see :func:`_piece_ranges` for the rest.
    """
    reach = length * 3 // 4
    anchors = materialize(anchor_segments(docs, length, reach), "anchors")
    counts = materialize(
        anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated-keys")
    repeated = materialize(anchors.join(counts, "key"), "repeated-anchors")
    discard(anchors)
    contents = materialize(
        repeated.groupBy("key", "c1", "c2").agg(
            F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "begin", "end")).alias("one")), "segments")
    sizes = materialize(contents.groupBy("key").agg(F.count(F.lit(1)).alias("segments")), "segment-counts")
    sized = materialize(contents.join(sizes, "key"), "sized-segments")
    # a key with one segment that occurs more than once: all its starts repeat
    alone = sized.where("segments = 1").select(
        "key", "c1", "c2", F.lit(0).alias("lo"), (F.col("one.end") - F.col("one.begin")).cast("int").alias("hi"))
    wanted = sized.where("segments > 1").select("key", "c1", "c2", "weight", "one.doc_id", "one.begin", "one.end")
    pieces = materialize(_cut_segments(docs, wanted, length).drop("doc_id"), "pieces")
    ranges = materialize(alone.unionByName(_piece_ranges(pieces, length, reach, key_segments)), "all-ranges")
    found = repeated.join(ranges, ["key", "c1", "c2"]).select(
        "doc_id", (F.col("begin") + F.col("lo")).alias("lo"), (F.col("begin") + F.col("hi")).alias("hi"))
    found = materialize(found, "placed-ranges")
    for stored in (counts, repeated, contents, sizes, sized, pieces, ranges):
        discard(stored)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every document.

    Each UTF-8 byte covered by a string of ``length`` bytes that also starts anywhere else, in any
    document, goes; matches stay inside documents and are judged on the input. ``kept`` is the
    remaining bytes (a cut may fall inside a character). A null text is empty. A repeated row counts
    as a further copy of its text; ``doc_id`` names one text, so two texts must not share one. Rows
    with a null ``doc_id`` are compared like all others. Columns besides ``doc_id`` and
    ``text`` are ignored; an empty table gives an empty table. One text is worked on as a whole in
    one task.
    """
    given = "_given_id"
    docs = docs.select(F.col("doc_id").cast("long").alias(given), place(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    spans = repeated_ranges(docs.select("doc_id", "text"), length).groupBy("doc_id").agg(
        F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    spans = materialize(spans, "byte-ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                data = (text or "").encode()
                removed = runs = 0
                kept, at = [], 0
                for lo, hi in sorted((x["lo"], x["hi"] - 1 + length) for x in ranges or ()):
                    if lo > at or (at == 0 and runs == 0):
                        kept.append(data[at:lo])
                        runs += 1
                        at = lo
                    if hi > at:
                        removed += hi - at
                        at = hi
                kept.append(data[at:])
                rest = b"".join(kept)
                for o, v in zip(out, (len(data), removed, runs, rest, hashlib.sha256(rest).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(given), *(pa.array(v, t) for v, t in zip(
                    out, [pa.int64()] * 3 + [pa.binary(), pa.string()]))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return docs.join(spans, "doc_id", "left").select(given, "text", "ranges").mapInArrow(cut, schema)
