"""Variable-capacity best-fit packing, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.prefix import with_dense_index
from ledgermill.session import materialize

CAPACITIES = (512, 1024, 2048, 4096)
# Fixed part of a sequence's cost, in tokens, beside one per position.
OVERHEAD = 32


def default_cost(capacity: int) -> float:
    return float(capacity + OVERHEAD)


def word_count(text: Column) -> Column:
    """Runs without ASCII white space, and one mark for the end of the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


@dataclass
class Bins:
    """``count`` bins alike. Bin ``k`` holds, for each part ``(length, first, each)``, the items of that
    length with ranks ``first + k * each`` to ``first + (k + 1) * each - 1``."""

    count: int
    capacity: int
    room: int
    parts: list[tuple[int, int, int]] = field(default_factory=list)

    def divided(self, first: int) -> tuple[Bins, Bins]:
        """The first ``first`` bins, and the others."""
        moved = [(length, start + first * each, each) for length, start, each in self.parts]
        return replace(self, count=first), replace(self, count=self.count - first, parts=moved)

    def with_items(self, length: int, first: int, each: int) -> Bins:
        return replace(self, room=self.room - each * length, parts=[*self.parts, (length, first, each)])


def _fill(space: int, counts: dict[int, int], sizes: list[int]) -> dict[int, int]:
    """Items by size that fill ``space``, taking the longest remaining one that fits each time."""
    taken, at = {}, bisect.bisect_right(sizes, space) - 1
    while at >= 0:
        size = sizes[at]
        take = min(counts[size], space // size)
        if take:
            taken[size] = take
            space -= take * size
        at = min(at, bisect.bisect_right(sizes, space)) - 1
    return taken


def opening_size(
    length: int, counts: dict[int, int], sizes: list[int], capacities: tuple[int, ...], cost: Callable[[int], float]
) -> int:
    """The capacity with the least cost per token it would hold: this item and what then fits beside it."""
    return _opening(length, counts, sizes, capacities, cost)[0]


def _opening(
    length: int, counts: dict[int, int], sizes: list[int], capacities: tuple[int, ...], cost: Callable[[int], float]
) -> tuple[int, dict[int, int], int]:
    """:func:`opening_size`, the items beside the first in such a bin, and for how many bins in a row this choice stands."""
    best, fills = None, {}
    for capacity in capacities:
        if capacity >= length:
            fills[capacity] = _fill(capacity - length, counts, sizes)
            price = cost(capacity) / (length + sum(size * n for size, n in fills[capacity].items()))
            if best is None or price < best[0]:
                best = (price, capacity)
    beside = fills[best[1]]
    used = {**beside, length: beside.get(length, 0) + 1}
    # the choice stands while there is as much left of each size as any of the capacities would take
    times = 1 + min((counts[size] - max(f.get(size, 0) for f in fills.values())) // n for size, n in used.items())
    return best[1], beside, times


def plan(
    histogram: dict[int, int],
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = default_cost,
    promise: bool = False,
) -> list[Bins]:
    """Best-fit decreasing over ``length -> number of items``; bins alike are handled together.

    Lengths go from long to short. Items go to the open bins with the least room that fits them;
    what fits nowhere opens bins of the size that costs least for each token it would hold, judged
    for each bin. With ``promise``, shorter items that were counted on for one bin are not counted on
    for another; without it every length is judged by its first bin alone, as if the shorter items
    could fill all its bins. At the end each bin shrinks to the smallest permitted size that holds its
    contents. Work and result grow with the number of different lengths, not with the number of items.
    """
    capacities = tuple(sorted(capacities))
    counts = {k: v for k, v in histogram.items() if v > 0}
    sizes = sorted(counts)
    free = dict(counts)  # items not promised to an open bin
    rooms: list[int] = []  # the different rooms of open bins, sorted
    open_bins: dict[int, list[Bins]] = {}
    done: list[Bins] = []

    def keep(bins: Bins, front: bool = False) -> None:
        """Queue bins by room; of equal rooms the one that has had it longest is next."""
        if not bins.count:
            return
        if bins.room not in open_bins:
            bisect.insort(rooms, bins.room)
            open_bins[bins.room] = []
        open_bins[bins.room].insert(0 if front else len(open_bins[bins.room]), bins)

    while sizes:
        length = sizes[-1]
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                bins = open_bins[rooms[at]].pop(0)
                if not open_bins[rooms[at]]:
                    del open_bins[rooms.pop(at)]
            else:
                free[length] = left - 1
                capacity, beside, times = _opening(length, free, sizes, capacities, cost)
                if promise:
                    for size, n in beside.items():
                        free[size] -= n * times
                bins = Bins(times if promise else -(-left // (capacity // length)), capacity, capacity)
            each = bins.room // length
            full = min(bins.count, left // each)
            filled, bins = bins.divided(full)
            keep(filled.with_items(length, rank, each))
            rank, left = rank + full * each, left - full * each
            if left < each and left and bins.count:
                last, bins = bins.divided(1)
                keep(last.with_items(length, rank, left))
                rank, left = rank + left, 0
            keep(bins, front=True)
        del counts[sizes.pop()]
    for group in open_bins.values():
        for bins in group:
            used = bins.capacity - bins.room
            size = next(c for c in capacities if c >= used)
            done.append(replace(bins, capacity=size, room=size - used))
    return done


def pack(
    docs: DataFrame,
    tokens: Column | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = default_cost,
) -> DataFrame:
    """One row per packed piece: ``bin_id, capacity, bin_offset, doc_id, piece, first_token, n_tokens``.

    ``tokens`` is the number of tokens of a document, at least 1 (default: its words and one end
    mark, so null and empty texts have one token). A document longer than the largest capacity is
    cut into pieces of that capacity and a rest; nothing is dropped. Every piece lies in one bin and
    no bin is over its capacity. Only ``doc_id`` and the columns of ``tokens`` are read. Repeated
    rows are packed as often as they occur, a null ``doc_id`` like any other; an empty table gives an
    empty table. The driver sees the histogram of lengths and the plan, whose size the largest
    capacity bounds; pieces find their bins by length and rank.
    """
    largest = max(capacities)
    count = (word_count(F.col("text")) if tokens is None else tokens).cast("long")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(count, F.lit(1)).alias("n")).select("doc_id", "n", cut)
    pieces = materialize(pieces.select(
        "doc_id", "piece", (F.col("piece") * largest).alias("first_token"),
        F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).alias("n_tokens")), "pieces")
    # at most one line per length up to the largest capacity
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    entries, first_bin = [], 0
    for bins in plan(histogram, capacities, cost, promise=True):
        offset = 0
        for length, first, each in bins.parts:
            entries.append((length, first, first + bins.count * each, each, first_bin, offset, bins.capacity))
            offset += length * each
        first_bin += bins.count
    before, starts = 0, []
    for length in sorted(histogram):
        starts.append((length, before))
        before += histogram[length]
    spark = docs.sparkSession
    placed = spark.createDataFrame(
        entries, "n_tokens long, rank_from long, rank_to long, each long, first_bin long, offset long, capacity int")
    begin = spark.createDataFrame(starts, "n_tokens long, before long")
    ranked = with_dense_index(pieces, ["n_tokens", "doc_id", "piece"], "place")
    return (
        ranked.join(F.broadcast(begin), "n_tokens")
        .withColumn("rank", F.col("place") - F.col("before"))
        .join(F.broadcast(placed.withColumnRenamed("n_tokens", "size")),
              (F.col("n_tokens") == F.col("size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(
            (F.col("first_bin") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each"))).alias("bin_id"), "capacity",
            (F.col("offset") + (F.col("rank") - F.col("rank_from")) % F.col("each") * F.col("n_tokens")).alias("bin_offset"),
            "doc_id", "piece", "first_token", "n_tokens")
    )
