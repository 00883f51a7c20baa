"""Spelling variants: a variable-length gram index finds words one edit apart, frequent ones name the form.

A gram grows from ``Q_MIN`` code points until it is rare in the vocabulary or ``Q_MAX`` long. A word is the
sequence of its grams that no earlier gram covers. One edit changes at most a number of these grams that is
known for each word; so it is known how many grams a partner must share, and only words that share so many
are compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.session import discard, materialize

MIN_LENGTH = 7
MIN_COUNT = 2
SLIP = 31  # one occurrence in so many loses a code point
RATIO = 10
Q_MIN, Q_MAX = 3, 4
# Numbers of shared grams that lists are made for; a word is found with the largest one its bound allows.
SHARED = (3, 5, 7, 10, 15, 22, 32, 48, 64)
# A gram that more positions than this share is extended, and the grams that do are sent to every task. The
# limit grows with the vocabulary so that there are at most this many of them.
LEAST_FREQUENT = 64
MAX_FREQUENT = 400_000
HELD_WORDS = 200_000
START, END = "\x01" * (Q_MAX - 1), "\x02" * (Q_MAX - 1)


# -- words -----------------------------------------------------------------------------

def words_of(text: str | None, doc_id: int | None, min_length: int = MIN_LENGTH, slip: int = SLIP) -> Counter:
    """Word -> occurrences of one text, slips applied; a null ``doc_id`` is written as nothing."""
    pattern = rf"[a-zÀ-ÿ]{{{min_length},}}"
    runs = Counter(re.findall(pattern, (text or "").encode().lower().decode()))  # bytes: lower-cases A-Z only
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    found: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < min_length:
                continue
        found[run] += n
    return found


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """``(word, n)`` of the words that occur often enough in all texts; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                held.update(words_of(text.as_py(), doc_id.as_py(), min_length, slip))
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- grams -----------------------------------------------------------------------------

def frequent_grams(vocab: DataFrame, least: int = LEAST_FREQUENT, most: int = MAX_FREQUENT) -> dict[str, int]:
    """Grams of ``Q_MIN`` to ``Q_MAX`` code points at more than a limit of positions of the padded words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                s = START + word + END
                held.update(s[p:p + q] for q in range(Q_MIN, Q_MAX + 1) for p in range(len(s) - q + 1))
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    positions = vocab.agg(F.sum(F.length("word") + F.lit(len(START + END)))).first()[0] or 0
    limit = max(least, -(-positions * (Q_MAX - Q_MIN + 1) // most))
    counts = vocab.select("word").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # fewer than ``most`` rows: each of them holds more than ``limit`` of the counted positions
    return {r.word: r.n for r in counts.where(F.col("n") > limit).toLocalIterator()}


def decompose(s: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Spans of the variable grams of a padded word that no earlier gram covers."""
    spans, covered = [], 0
    for p in range(len(s) - Q_MAX + 1):
        e = p + Q_MIN
        while e < p + Q_MAX and s[p:e] in frequent:
            e += 1
        if e > covered:
            spans.append((p, e))
            covered = e
    return spans


def most_affected(s: str, spans: list[tuple[int, int]], frequent: dict[str, int]) -> int:
    """How many of the grams one edit can change at most.

    A gram's length depends on its own code points only, so an edit at ``i`` changes the grams that
    hold ``i``, and those after it that a new gram may cover: one that starts at or before ``i``,
    ends where they end or later, and so has everything between as frequent text. An insertion
    before ``i + 1`` changes no more than an edit at ``i``; the first one stands on the last pad.
    """
    first, last = len(START) - 1, len(s) - len(END) - 1
    hit = [0] * (last + 1)
    for p, e in spans:
        for i in range(max(first, p), min(last, e - 1) + 1):
            hit[i] += 1
        for i in range(max(first, e - Q_MAX), min(last, p - 1) + 1):
            if e - 2 - i < Q_MIN or s[i + 1:e - 1] in frequent:
                hit[i] += 1
    return max(hit[first:])


def index_keys(word: str, frequent: dict[str, int]) -> list[tuple[str, bool]]:
    """The lists of the index that a word stands in, and whether partners are looked for in them.

    Of ``g`` grams at most ``a`` change. Those before the edit are the first ones in both words with the same
    text before them, those behind it the last ones with the same text after them. So two words one edit
    apart share, for any number up to the larger ``g - a``, the first ``b`` and the last ``number - b`` grams for
    some ``b``: a merge of lists with that threshold is one list for each ``b``. Words meet in the lists of
    the smaller of their two numbers. A word whose grams may almost all change has none, see :func:`half_keys`.
    """
    s = START + word + END
    spans = decompose(s, frequent)
    shared = len(spans) - most_affected(s, spans, frequent)
    numbers = [n for n in SHARED if n <= shared]
    keys = []
    for n in numbers:
        for b in range(n + 1):
            before = s[:spans[b - 1][1]] if b else ""
            behind = s[spans[b - n][0]:] if b < n else ""
            keys.append((f"{n}:{b}:{before}\x03{behind}", n == numbers[-1]))
    return keys


def half_keys(word: Column) -> Column:
    """Lists by halves of a word: one half is untouched by an edit. The lengths of two words may differ by one."""
    size = F.length(word)
    short, long = F.floor((size - 1) / 2).cast("int"), F.floor(size / 2).cast("int")
    keys = [F.concat(F.lit(f"{side}:"), half.cast("string"), F.lit(":"), part(half)) for half in (short, long) for side, part in (
        ("h", lambda n: F.substring(word, F.lit(1), n)), ("t", lambda n: F.substring(word, -n, n)))]
    return F.array_distinct(F.array(*keys))


def near_words(vocab: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """``(word, n, near, near_n)`` for every two words one edit apart, in both directions, each once."""
    grams = vocab.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.value
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for at in range(0, len(words), 2000):
                rows = []
                for w, n in zip(words[at:at + 2000], counts[at:at + 2000]):
                    keys = index_keys(w, known)
                    rows += [(xxhash.xxh64_intdigest(k.encode()) - (1 << 63), own, w, n) for k, own in keys]
                    if not keys:
                        rows.append((None, True, w, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.int64()))],
                    ["key", "own", "word", "n"])

    lists = materialize(vocab.select("word", "n").mapInArrow(run, "key long, own boolean, word string, n long"), "gram-lists")
    other = lists.where("key IS NOT NULL").select("key", F.col("own").alias("both"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    once = F.col("word").eqNullSafe(F.col("near")) | (F.col("both") & (F.col("word") > F.col("near")))
    met = lists.where("own AND key IS NOT NULL").drop("own").join(other, "key").where(~once).drop("both")
    # few words, if any, have no list; they look at all words by halves
    bare = materialize(lists.where("key IS NULL").select("word", "n"), "bare-words")
    halves = bare.withColumn("key", F.explode(half_keys(F.col("word")))).join(
        vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(half_keys(F.col("word"))).alias("key")), "key")
    found = met.unionByName(halves).where(F.levenshtein("word", "near", 1) == 1)
    ordered = found.select(F.least("word", "near").alias("word"), F.greatest("word", "near").alias("near"),
                           F.when(F.col("word") < F.col("near"), F.col("n")).otherwise(F.col("near_n")).alias("n"),
                           F.when(F.col("word") < F.col("near"), F.col("near_n")).otherwise(F.col("n")).alias("near_n"))
    pairs = materialize(ordered.distinct(), "near-words")
    discard(lists)
    return pairs.unionByName(pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


# -- forms -----------------------------------------------------------------------------

def roots_of(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)`` without cycles: every round doubles the steps taken."""
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        after = materialize(
            current.join(onward, "root", "left")
            .select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        discard(current)
        current = after.select("word", "root")
        if not after.agg(F.bool_or("moved")).first()[0]:
            return current


def group_variants(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP, ratio: int = RATIO
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are the runs of letters up
    to U+00FF, A-Z lower-cased, of whole texts; one occurrence in ``slip``, told by a hash of ``doc_id``
    and run, has lost a code point. Words of at least ``min_length`` code points and ``min_count``
    occurrences count. ``form`` is the most frequent word one edit away (ties: the smallest) if it is
    ``ratio`` times as frequent, ``root`` the end of the forms' chain. Null and empty texts hold no word,
    a null ``doc_id`` is written as nothing in the hash, repeated rows count as often as they stand
    there, an empty table gives an empty table.
    """
    vocab = materialize(vocabulary(docs, min_length, min_count, slip), "vocabulary")
    near = near_words(vocab, frequent_grams(vocab))
    # a word has at most some thousand neighbours: one per place and letter
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    named = vocab.join(best, "word", "left").withColumn("best_n", -F.col("best.least"))
    is_form = F.col("best_n") >= F.lit(ratio) * F.col("n")
    named = materialize(named.select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "named")
    roots = roots_of(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
