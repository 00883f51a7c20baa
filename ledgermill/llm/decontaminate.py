"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted-shingle similarity."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm.textbytes import LOWER, Words, text_slices, window_hashes
from ledgermill.session import discard, materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# At a similarity of 0.8 about 10 of 64 bits differ, with a spread of 3.
MAX_DISTANCE = 20
BLOCKS = 8
# Items that a task holds at a time: text bytes, and so many more for each item.
ITEM_BLOCK_BYTES = 10_000_000
ITEM_BYTES = 100
# Pairs of a word and an item place that are looked at together.
_PAIRS = 1 << 20


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.uint64:
    """64 bits; a bit is set when shingles of over half the weight have it set."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8)).reshape(-1, 64)
    set_weight = weights @ bits
    return np.packbits(set_weight * 2 > weights.sum()).view(">u8")[0].astype(np.uint64)


def weighted_similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared weight over joint weight of two shingle multisets."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    joint = sum(a.values()) + sum(b.values()) - shared
    return shared / joint if joint else 1.0


class BlockIndex:
    """Multi-index of fingerprints: 8 blocks of 8 bits.

    Fingerprints at most ``radius`` bits apart have a block with at most ``radius // BLOCKS``
    differing bits, so looking up every block value that near finds all of them.
    """

    def __init__(self, prints: np.ndarray, radius: int = MAX_DISTANCE):
        self.prints, self.radius = prints, radius
        blocks = prints.astype(">u8").view(np.uint8).reshape(-1, BLOCKS)
        values = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius // BLOCKS
        self._near = [np.flatnonzero(n) for n in near]
        # positions by block value: 4 bytes an item and block
        self._order = [np.argsort(blocks[:, b], kind="stable").astype(np.int32) for b in range(BLOCKS)]
        self._from = [np.searchsorted(np.sort(blocks[:, b]), np.arange(257)) for b in range(BLOCKS)]

    def within(self, fingerprint: np.uint64) -> np.ndarray:
        """Positions of all fingerprints within the radius."""
        parts = np.array([fingerprint], ">u8").view(np.uint8)
        found = np.zeros(len(self.prints), bool)
        for order, start, part in zip(self._order, self._from, parts):
            for value in self._near[part].tolist():
                found[order[start[value]:start[value + 1]]] = True
        candidates = np.flatnonzero(found)
        return candidates[np.bitwise_count(self.prints[candidates] ^ fingerprint) <= self.radius]


class Items:
    """Benchmark items ready for search: shingle weights, sizes, fingerprints, where each shingle stands.

    Everything is kept in arrays, about 30 bytes a word and 50 an item.
    """

    def __init__(self, ids: list[int], texts: list[str], shingle_words: int = SHINGLE_WORDS):
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
        self.ids, sizes, shingles, prints, keys, weights = [], [], [], [], [], []
        places: dict[int, list] = {}
        for part, raw, borders in text_slices(batch):
            words = Words(LOWER[raw], borders)
            hashes = words.hashes()
            for row, item in enumerate(part.column("id").to_pylist()):
                a, b = int(words.first[row]), int(words.first[row + 1])
                if a == b:
                    continue  # no words: nothing to look for
                size = min(shingle_words, b - a)
                # hashes are sums from the first value on, so those of the item alone are the same
                found = window_hashes(hashes[a:b], np.arange(b - a - size + 1), size)
                places.setdefault(size, []).append((len(self.ids), found))
                key, weight = np.unique(found, return_counts=True)
                self.ids.append(item)
                sizes.append(b - a)
                shingles.append(size)
                keys.append(key)
                weights.append(weight.astype(np.int32))
                prints.append(simhash(key, weight))
        self.sizes, self.shingles = np.array(sizes, np.int64), np.array(shingles, np.int64)
        self._borders = np.cumsum([0, *map(len, keys)])
        self._keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self._weights = np.concatenate(weights) if weights else np.zeros(0, np.int32)
        self.index = BlockIndex(np.array(prints, np.uint64))
        # by shingle size: sorted hashes with item and place, and one bit per hash, which tells most words apart alone
        self.places, self.filters = {}, {}
        for size, found in places.items():
            hashes = np.concatenate([h for _, h in found])
            order = np.argsort(hashes, kind="stable")
            item = np.repeat(np.array([n for n, _ in found], np.int32), [len(h) for _, h in found])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for _, h in found])
            self.places[size] = (hashes[order], item[order], place[order])
            self.filters[size] = np.zeros(1 << 24, bool)
            self.filters[size][hashes & np.uint64(0xFFFFFF)] = True

    def windows(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """``(row, shingle size, words, first word)`` of the windows to look at, each once."""
        out = [np.zeros((0, 4), np.int64)]
        for size, (keys, item, places) in self.places.items():
            at = words.windows(size)
            if not len(at):
                continue
            found = window_hashes(hashes, at, size)
            hits = np.flatnonzero(self.filters[size][found & np.uint64(0xFFFFFF)])
            low = np.searchsorted(keys, found[hits], "left")
            count = np.searchsorted(keys, found[hits], "right") - low
            total = np.concatenate([[0], np.cumsum(count)])
            for begin in range(0, int(total[-1]), _PAIRS):
                pair = np.arange(begin, min(begin + _PAIRS, int(total[-1])))
                hit = np.searchsorted(total, pair, "right") - 1
                entry = low[hit] + pair - total[hit]
                position, length = at[hits[hit]], self.sizes[item[entry]]
                row = words.row[position]
                first, end = words.first[row], words.first[row + 1]
                start = np.maximum(np.minimum(position - places[entry], end - length), first)
                kept = np.minimum(start + length, end) - size + 1 > start
                out.append(np.unique(np.stack([row, np.full(len(row), size), length, start - first], 1)[kept], axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, words: Words, hashes: np.ndarray, windows: np.ndarray, similarity: float) -> list[tuple[int, int, int, int, float]]:
        """``(row, item, first word, words, similarity)`` of those windows that hold an item."""
        out = []
        for size in self.places:
            at = words.windows(size)
            found = window_hashes(hashes, at, size)
            for row, _, length, start in windows[windows[:, 1] == size].tolist():
                first, end = int(words.first[row]), int(words.first[row + 1])
                k = int(np.searchsorted(at, first + start))
                stop = min(start + length, end - first)
                window = Counter(found[k:k + stop - size + 1 - start].tolist())
                keys = np.array(list(window), np.uint64)
                fingerprint = simhash(keys, np.array(list(window.values()), np.int64))
                for number in self.index.within(fingerprint).tolist():
                    if self.shingles[number] == size:
                        a, b = self._borders[number], self._borders[number + 1]
                        value = weighted_similarity(window, dict(zip(self._keys[a:b].tolist(), self._weights[a:b].tolist())))
                        if value >= similarity:
                            out.append((row, number, start, stop - start, value))
        return out


_BUILT: dict[str, Items] = {}


class ItemBlock:
    """Some items, sent to every task; a worker keeps those it used last."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, shingle_words: int):
        rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).orderBy("item_id").collect()
        self._name, self._words = uuid.uuid4().hex, shingle_words
        self.sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    def items(self) -> Items:
        if self._name not in _BUILT:
            _BUILT.clear()
            _BUILT[self._name] = Items(*self.sent.value, self._words)
        return _BUILT[self._name]


_MATCHES = "array<struct<item_id:long,first_word:int,n_words:int,similarity:double>>"
_FOUND = f"doc_id long, contaminated boolean, item_ids array<long>, best_similarity double, matches {_MATCHES}"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())]))
_WINDOWS = "array<struct<size:int,n_words:int,first_word:int>>"
_WINDOW_TYPE = pa.list_(pa.struct([("size", pa.int32()), ("n_words", pa.int32()), ("first_word", pa.int32())]))


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    max_item_bytes: int | None = None,
    block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, contaminated, item_ids, best_similarity, matches``.

    For every item, windows of as many words as the item has are fingerprinted wherever the document
    shares a word shingle with some item, at the offset where the shingle stands in the item; a
    window that shares none cannot reach any similarity above 0. Items within 20 bits of a window are
    all found by the block index and kept when the weighted similarity of shingle multisets is at
    least ``similarity``. A-Z count as a-z. Items shorter than a shingle are one shingle of their own
    length; items without words are never found. Null texts are empty; repeated rows give repeated
    rows; other columns are ignored; an empty table on either side gives no match.

    The benchmark goes to every task, in blocks of at most ``block_bytes`` (a longer item is a block
    of its own). With several blocks the documents are stored once; the windows of all blocks are
    collected first and then compared with the items of each block, so the result is that of one
    block. A caller who wants no more than ``max_item_bytes`` text bytes of benchmark can have more
    refused.
    """
    _refuse(benchmark, max_item_bytes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _one_block(benchmark, block_bytes):
        stored = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
        found = _matches_by_block(stored, benchmark, shingle_words, similarity, block_bytes)
        found = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
        ids = F.array_sort(F.array_distinct(F.array_compact(F.col("matches.item_id"))))
        return stored.select("row", "doc_id").join(found, "row", "left").withColumn(
            "matches", F.coalesce("matches", F.array().cast(_MATCHES))
        ).select("doc_id", (F.size("matches") > 0).alias("contaminated"), ids.alias("item_ids"),
                 F.coalesce(F.array_max("matches.similarity"), F.lit(0.0)).alias("best_similarity"), "matches")
    block = ItemBlock(docs.sparkSession, benchmark, shingle_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.items()
        for batch in batches:
            for part, raw, borders in text_slices(batch):
                found = _found(items, raw, borders, similarity)
                ids = [sorted({m["item_id"] for m in f if m["item_id"] is not None}) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([bool(f) for f in found]), pa.array(ids, pa.list_(pa.int64())),
                     pa.array([max((m["similarity"] for m in f), default=0.0) for f in found]), pa.array(found, _MATCH_TYPE)],
                    ["doc_id", "contaminated", "item_ids", "best_similarity", "matches"])

    return docs.mapInArrow(run, _FOUND)


def _refuse(benchmark: DataFrame, max_item_bytes: int | None) -> None:
    if max_item_bytes is not None:
        size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > max_item_bytes:
            raise ValueError(f"benchmark texts have {size} bytes; at most {max_item_bytes} are wanted")


def _cost():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ITEM_BYTES


def _one_block(benchmark: DataFrame, block_bytes: int) -> bool:
    return (benchmark.agg(F.sum(_cost())).first()[0] or 0) <= block_bytes


def item_blocks(benchmark: DataFrame, block_bytes: int = ITEM_BLOCK_BYTES) -> Iterator[DataFrame]:
    """Parts of the benchmark of at most ``block_bytes``, or of one longer item.

    Every partition is cut into pieces by a running sum; the driver sees only the pieces' sizes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, piece, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            pieces = []
            for cost in batch.column("cost").to_pylist():
                if size and size + cost > block_bytes:
                    piece, size = piece + 1, 0
                size += cost
                pieces.append(f"{partition}-{piece}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.string())], [*batch.schema.names, "piece"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", _cost().alias("cost"))
    stored = materialize(items.mapInArrow(cut, "item_id long, text string, cost long, piece string"), "benchmark-pieces")
    blocks, size = [], block_bytes + 1
    for piece, cost in stored.groupBy("piece").agg(F.sum("cost")).orderBy("piece").collect():
        if size + cost > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append(piece)
        size += cost
    for pieces in blocks:
        yield stored.where(F.col("piece").isin(pieces)).select("item_id", "text")


def _matches_by_block(docs: DataFrame, benchmark: DataFrame, shingle_words: int, similarity: float, block_bytes: int) -> DataFrame:
    """``(row, matches)`` of the rows of stored ``(row, text)`` with an item, one line for each block."""
    blocks = list(item_blocks(benchmark, block_bytes))

    def each_block(table: DataFrame, work, schema: str, label: str) -> list[DataFrame]:
        parts = []
        for part in blocks:
            block = ItemBlock(docs.sparkSession, part, shingle_words)
            parts.append(materialize(table.mapInArrow(work(block), schema), label))
            block.sent.destroy()
        return parts

    def look(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = block.items()
            for batch in batches:
                for part, raw, borders in text_slices(batch):
                    words = Words(LOWER[raw], borders)
                    windows = items.windows(words, words.hashes()) if len(words.row) else np.zeros((0, 4), np.int64)
                    rows, starts = np.unique(windows[:, 0], return_index=True)
                    lists = pa.ListArray.from_arrays(
                        pa.array([*starts.tolist(), len(windows)], pa.int32()),
                        pa.StructArray.from_arrays([pa.array(windows[:, c], pa.int32()) for c in (1, 2, 3)], fields=list(_WINDOW_TYPE.value_type)))
                    yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(rows)), lists], ["row", "windows"])
        return run

    def compare(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = block.items()
            for batch in batches:
                for part, raw, borders in text_slices(batch):
                    windows = np.array([
                        (row, w["size"], w["n_words"], w["first_word"])
                        for row, found in enumerate(part.column("windows").to_pylist()) for w in found], np.int64).reshape(-1, 4)
                    found = _found(items, raw, borders, similarity, windows)
                    hit = [k for k, f in enumerate(found) if f]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row").take(pa.array(hit, pa.int64())), pa.array([found[k] for k in hit], _MATCH_TYPE)],
                        ["row", "matches"])
        return run

    looked = each_block(docs.select("row", "text"), look, f"row long, windows {_WINDOWS}", "block-windows")
    windows = _union(looked).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("windows"))).alias("windows"))
    texts = materialize(docs.select("row", "text").join(windows, "row"), "benchmark-windows")
    for part in looked:
        discard(part)
    found = _union(each_block(texts, compare, f"row long, matches {_MATCHES}", "block-matches"))
    discard(texts)
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def _found(items: Items, raw: np.ndarray, borders: np.ndarray, similarity: float, windows: np.ndarray | None = None) -> list[list[dict]]:
    """Matches of every row of a slice, in these windows or else in those of the items."""
    words = Words(LOWER[raw], borders)
    found: list[list[dict]] = [[] for _ in range(len(borders) - 1)]
    if items.ids and len(words.row):
        hashes = words.hashes()
        windows = items.windows(words, hashes) if windows is None else windows
        for row, number, first, length, value in items.matches(words, hashes, windows, similarity):
            found[row].append({"item_id": items.ids[number], "first_word": first, "n_words": length, "similarity": value})
    for matches in found:
        matches.sort(key=lambda m: (m["item_id"] is not None, m["item_id"] or 0, m["first_word"], m["n_words"], m["similarity"]))
    return found


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, block_bytes: int = ITEM_BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, all columns, in which :func:`find_benchmark` finds no item."""
    if not _one_block(benchmark, block_bytes):
        stored = materialize(docs.select(F.struct("*").alias("kept"), F.monotonically_increasing_id().alias("row")), "documents")
        texts = stored.select("row", F.col("kept.text").alias("text"))
        found = _matches_by_block(texts, benchmark, shingle_words, similarity, block_bytes)
        return stored.join(found.select("row"), "row", "left_anti").select("kept.*")
    block = ItemBlock(docs.sparkSession, benchmark, shingle_words)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = block.items()
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            flags = [not f for _, raw, borders in text_slices(batch) for f in _found(items, raw, borders, similarity)]
            yield pa.array(flags, pa.bool_())

    return docs.where(clean(F.col("text")))
