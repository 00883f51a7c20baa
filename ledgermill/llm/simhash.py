"""SimHash near-duplicates: pigeonring filtering of fingerprints, then components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.components import connected_components
from ledgermill.session import materialize

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
# Bits of one ring of segments. With 5 segments and at most 3 differing bits the budgets of chains of
# length 1, 2 and 3 are 0, 1 and 1 bits (length * 3 / 5, rounded down).
SEGMENTS = (13, 13, 13, 13, 12)
CHAIN = 3
PARTS = 4
BLOCK = 2000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> bytes:
    """Eight big-endian bytes; a bit is set when it is set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return bytes(8)
    line = b" ".join(words)
    width = min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # 255 bits add up within a byte
        bits = np.unpackbits(hashes[at:at + 255].view(np.uint8)).reshape(-1, 64)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as the signed long with the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = b"".join(fingerprint(t.as_py(), shingle_words) for t in batch.column("text"))
            values = np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# -- pigeonring ------------------------------------------------------------------------

def ring_segments(fps: np.ndarray) -> list[np.ndarray]:
    """The segments of unsigned fingerprints, first bits first."""
    out, shift = [], 64
    for width in SEGMENTS:
        shift -= width
        out.append((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def chain_keys(fps: np.ndarray) -> np.ndarray:
    """``(len(fps), SEGMENTS * PARTS)`` join keys.

    If two fingerprints differ in at most 3 bits, then from some segment ``i`` on every prefix of
    the ring keeps within its proportional budget (pigeonring): segment ``i`` is equal, and the two
    after it differ in at most one bit together. Cut into ``PARTS`` parts, all parts of those two
    but one are equal. A key is ``i``, the part left out, segment ``i`` and the other parts, so
    both fingerprints share at least one key.
    """
    segments, keys = ring_segments(fps), []
    for i in range(len(SEGMENTS)):
        nexts = [(i + step) % len(SEGMENTS) for step in range(1, CHAIN)]
        width = sum(SEGMENTS[n] for n in nexts)
        rest = np.zeros(len(fps), np.uint64)
        for n in nexts:
            rest = (rest << np.uint64(SEGMENTS[n])) | segments[n]
        cuts = [width * p // PARTS for p in range(PARTS + 1)]
        for p in range(PARTS):
            left_out = np.uint64(((1 << (cuts[p + 1] - cuts[p])) - 1) << cuts[p])
            key = (segments[i] << np.uint64(26)) | (rest & ~left_out)
            keys.append((np.uint64(i * PARTS + p) << np.uint64(40)) | key)
    return np.stack(keys, axis=1)


def ring_passes(diff: np.ndarray, max_distance: int = MAX_DISTANCE) -> np.ndarray:
    """Whether some start keeps every chain prefix up to ``CHAIN`` within its budget."""
    counts = [np.bitwise_count(s).astype(np.int64) for s in ring_segments(diff)]
    m = len(counts)
    passed = np.zeros(len(diff), bool)
    for i in range(m):
        total, good = np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
        for step in range(CHAIN):
            total = total + counts[(i + step) % m]
            good &= total * m <= (step + 1) * max_distance
        passed |= good
    return passed


def _links_in_runs(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each run of equal ``group`` values, spanning only.

    Every pair of a run is compared; a link is kept only if it joins two parts that the links
    kept before did not, so a run of ``n`` gives fewer than ``n`` links.
    """
    size = len(fps)
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    run_end = np.repeat(last, np.diff(np.concatenate([[-1], last])))
    root = np.arange(size)
    froms, tos = [], []
    active, step = np.arange(size), 1

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while True:
        active = active[active + step <= run_end[active]]
        if not len(active):
            break
        here = active[root[active] != root[active + step]]
        diff = fps[here] ^ fps[here + step]
        near = np.bitwise_count(diff) <= 8  # cheap look before the ring
        here, diff = here[near], diff[near]
        good = ring_passes(diff)
        here, diff = here[good], diff[good]
        here = here[np.bitwise_count(diff) <= MAX_DISTANCE]
        for i in here.tolist():
            a, b = find(i), find(i + step)
            if a != b:
                root[max(a, b)] = min(a, b)
                froms.append(i)
                tos.append(i + step)
        if len(here):
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
        step += 1
    return np.array(froms, np.int64), np.array(tos, np.int64)


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, low, high, fp)`` rows to links; only whole runs are compared."""
    held: list[np.ndarray] | None = None

    def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, low, high, fps = rows
        change = np.zeros(len(key), np.int64)
        change[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        a, b = _links_in_runs(np.cumsum(change), fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in ("key", "low", "high", "fp")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        ends = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield linked([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield linked(held)


def near_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints ``(fp)`` at most 3 bits apart.

    Fingerprints meet on chain keys. A key with more than ``block`` fingerprints is dealt into
    random blocks of about that many, and every two of its blocks meet in a task of their own,
    so memory is bounded, no comparison is left out and no key falls to one task.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            keys = chain_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, keys.shape[1]))], ["key", "fp"])

    keys = materialize(distinct.select("fp").mapInArrow(keyed, "key long, fp long"), "chain-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "chain-sizes")
    met = keys.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = met.select("key", "fp", "own", other.alias("other")).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    together = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
    return together.mapInArrow(_link_runs, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Two documents link when
    their fingerprints differ in at most 3 bits; ``component_id`` is the smallest ``doc_id``
    that links reach. Null and wordless texts have fingerprint zero and link like any other.
    An empty table gives an empty table; repeated rows give repeated rows; a null ``doc_id``
    takes part like any other and is larger than every number.
    """
    prints = materialize(fingerprints(docs, shingle_words), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-prints")
    links = materialize(near_links(distinct), "links")
    reached = materialize(connected_components(links), "components")
    # the smallest doc_id of a component of fingerprints
    classes = distinct.join(reached, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    classes = materialize(classes, "classes")
    smallest = materialize(classes.groupBy("component").agg(F.min("first_doc").alias("component_id")), "smallest")
    named = materialize(classes.join(smallest, "component").select("fp", "component_id"), "named-prints")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``doc_id`` is the smallest of its component.

    Rows that share a ``doc_id`` stay or go together; rows without one stay when their component has no ``doc_id``.
    """
    found = near_duplicates(docs, shingle_words)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    kept = materialize(kept, "kept-ids")
    # one plan at every size: the texts go to their verdicts once
    return docs.join(kept.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")
