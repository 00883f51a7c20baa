"""Repeated word windows: a count-min sketch first, exact grouping of what it lets through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.textbytes import BASES, Words, mix, place, text_slices, window_hashes
from ledgermill.session import materialize

WINDOW_WORDS = 20
ROWS = 2
BLOCK_SLOTS = 1 << 20
# Slots of one sketch row. Wider rows let fewer unrepeated windows through to the exact pass; the
# result is the same at any width. The upper bound keeps what is sent to every task at 2 x 64 MB.
MIN_SLOTS, MAX_SLOTS = 1 << 20, 1 << 29
# Windows that a task holds before it sends them on.
_HELD_COUNTS, _HELD_WINDOWS = 1 << 21, 1 << 20


def sketch_slots(text_bytes: int) -> int:
    """Slots per sketch row for so many bytes of text: about four for each word."""
    wanted = max(MIN_SLOTS, min(MAX_SLOTS, 2 * text_bytes // 3))
    return 1 << (wanted - 1).bit_length()


def _window_table(batch: pa.RecordBatch, size: int):
    """For each slice: its rows, words, window positions and two 64-bit hashes of every window."""
    for rows, raw, borders in text_slices(batch):
        words = Words(raw, borders)
        hashes, at = words.hashes(), words.windows(size)
        yield rows, words, at, window_hashes(hashes, at, size), window_hashes(hashes, at, size, BASES[1])


def _slots(first: np.ndarray, second: np.ndarray, slots: int) -> list[np.ndarray]:
    """Slot of every window in each sketch row."""
    mask = np.uint64(slots - 1)
    return [((first >> np.uint64(20 * r)) ^ (second >> np.uint64(13 * r))) & mask for r in range(ROWS)]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(values, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def merged_sketch(docs: DataFrame, size: int, slots: int) -> list[bytearray]:
    """Per sketch row one bit per slot: set where the counters of all partitions add up to two or more.

    Each task counts its own windows (a counter stops at two) and emits the slots it has seen and
    those it has seen twice, in blocks; blocks are added up one row at a time, so a task holds one block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]

        def flush() -> Iterator[pa.RecordBatch]:
            blocks, seen, twice = [], [], []
            for r in range(ROWS):
                if not held[r]:
                    continue
                values = np.sort(np.concatenate(held[r]))
                held[r].clear()
                fresh = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
                again = np.unique(values[~fresh])
                values = values[fresh]
                numbers = values // BLOCK_SLOTS
                for n in np.unique(numbers).tolist():
                    a, b = np.searchsorted(numbers, [n, n + 1])
                    c, d = np.searchsorted(again, [n * BLOCK_SLOTS, (n + 1) * BLOCK_SLOTS])
                    blocks.append(r * (slots // BLOCK_SLOTS) + n)
                    seen.append(_pack(values[a:b] - np.uint32(n * BLOCK_SLOTS)))
                    twice.append(_pack(again[c:d] - np.uint32(n * BLOCK_SLOTS)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array(seen, pa.binary()), pa.array(twice, pa.binary())],
                ["block", "seen", "twice"])

        total = 0
        for batch in batches:
            for _, _, at, first, second in _window_table(batch, size):
                for r, s in enumerate(_slots(first, second, slots)):
                    held[r].append(s.astype(np.uint32))
                total += len(at)
                if total >= _HELD_COUNTS:
                    yield from flush()
                    total = 0
        if total:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            bits = zstandard.compress(np.packbits(twice).tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, seen, again in zip(*(batch.column(c).to_pylist() for c in ("block", "seen", "twice"))):
                if block != now:
                    if now is not None:
                        yield done()
                    now, once, twice = block, np.zeros(BLOCK_SLOTS, bool), np.zeros(BLOCK_SLOTS, bool)
                slots_seen = _unpack(seen)
                twice[slots_seen[once[slots_seen]]] = True
                twice[_unpack(again)] = True
                once[slots_seen] = True
        if now is not None:
            yield done()

    parts = docs.select("text").mapInArrow(count, "block int, seen binary, twice binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary")
    out = [bytearray(slots // 8) for _ in range(ROWS)]
    per_row, width = slots // BLOCK_SLOTS, BLOCK_SLOTS // 8
    for block, bits in blocks.toLocalIterator():  # bounded: ROWS x MAX_SLOTS bits, whatever the input
        r, n = divmod(block, per_row)
        out[r][n * width:(n + 1) * width] = zstandard.decompress(bytes(bits))
    return out


def removed_positions(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``(doc_id, at)``: window starts (word positions, from 0) whose words also start earlier.

    Earlier means a smaller ``doc_id`` or a smaller position in the same document; two rows alike are
    one document, and the same start of both is not later than itself. No ``doc_id`` is null here. The sketch
    never undercounts, so every repeated window reaches the exact pass: windows go by the first
    hash to a task, where equal windows (96 hash bits) follow each other in document order and
    all but the first are kept. Within one input task later copies are found at once, so a window
    held by a third of all documents sends one row per task and not one per document.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = sketch_slots(total)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(merged_sketch(docs, size, slots))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.frombuffer(x, np.uint8) for x in sent.value]
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            h1, low, doc = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((low & np.uint64(0xFFFFFFFF), doc, low >> np.uint64(32), h1))
            h1, low, doc = h1[order], low[order], doc[order]
            opens = np.ones(len(h1), bool)
            opens[1:] = (h1[1:] != h1[:-1]) | ((low[1:] >> np.uint64(32)) != (low[:-1] >> np.uint64(32)))
            head = np.maximum.accumulate(np.where(opens, np.arange(len(h1)), 0))
            # a repeated row has the same place, which is not later
            same = (doc != doc[head]) | (low != low[head])
            # a later copy is known here: it goes to any task; the first one stands for this task
            route = np.where(same, mix(h1 ^ low), h1)
            back = np.argsort(doc, kind="stable")
            return pa.RecordBatch.from_arrays(
                [pa.array(x[back]) for x in (route.view(np.int64), low.view(np.int64), doc, same)],
                ["h", "low", "doc_id", "later"])

        for batch in batches:
            for rows, words, at, first, second in _window_table(batch, size):
                passed = np.ones(len(at), bool)
                for plane, s in zip(planes, _slots(first, second, slots)):
                    passed &= (plane[s >> np.uint64(3)] >> (np.uint8(7) - (s & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0
                at, first, second = at[passed], first[passed], second[passed]
                row = words.row[at]
                position = (at - words.first[row]).astype(np.uint64)
                ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
                held.append((first, (second & np.uint64(0xFFFFFFFF00000000)) | position, ids[row].astype(np.int64)))
                count += len(at)
                if count >= _HELD_WINDOWS:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by window, document, position: all but the first of each window."""
        before: tuple | None = None  # window and first place of the run that the last row was in
        for batch in batches:
            if not batch.num_rows:
                continue
            h, low = batch.column("h").to_numpy(), batch.column("low").to_numpy().view(np.uint64)
            doc, known = batch.column("doc_id").to_numpy(), batch.column("later").to_numpy(zero_copy_only=False)
            top = low >> np.uint64(32)
            opens = np.ones(len(h), bool)
            opens[1:] = (h[1:] != h[:-1]) | (top[1:] != top[:-1]) | (known[1:] != known[:-1])
            head = np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))
            first_doc, first_low = doc[head], low[head]
            if before is not None and before[:3] == (h[0], top[0], known[0]):
                first_doc[head == 0], first_low[head == 0] = before[3:]
            before = (h[-1], top[-1], known[-1], first_doc[-1], first_low[-1])
            same = known | (doc != first_doc) | (low != first_low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[same]), pa.array((low[same] & np.uint64(0xFFFFFFFF)).astype(np.int32))], ["doc_id", "at"])

    estimated = docs.select("doc_id", "text").mapInArrow(
        estimate, "h long, low long, doc_id long, later boolean")
    return estimated.repartition("h").sortWithinPartitions(
        "later", "h", F.shiftrightunsigned("low", 32), "doc_id", "low").mapInArrow(later, "doc_id long, at int")


def _cut(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``words`` positions a window starting at ``starts`` covers."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, words), -1)
    return np.cumsum(steps)[:words] > 0


def remove_repeats(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256`` for every document.

    Each word covered by a window of ``size`` words whose sequence also starts earlier goes;
    windows are judged on the input. Kept words are joined by one space. Words are runs without
    ASCII white space, unchanged; a null text has none. A ``doc_id`` names one text: rows that repeat
    it with the same text are one document and share its result. Rows with a null ``doc_id`` come after
    all others, in an order told by their texts. Columns besides ``doc_id`` and ``text`` are ignored. An
    empty table gives an empty table. One text is worked on as a whole in one task.
    """
    given = "_given_id"
    docs = docs.select(F.col("doc_id").cast("long").alias(given), place(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    starts = removed_positions(docs, size).groupBy("doc_id").agg(F.collect_list("at").alias("starts"))
    starts = materialize(starts, "window-starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts, digests = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("starts")):
                words = (text or "").encode().split()
                gone = 0
                total = len(words)
                if found.is_valid and total:
                    covered = _cut(total, np.unique(found.values.to_numpy()).astype(np.int64), size)
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                kept = b" ".join(words)
                counts.append(total)
                removed.append(gone)
                texts.append(kept.decode())
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(given), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.string()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return docs.join(starts, "doc_id", "left").mapInArrow(cut, schema)
