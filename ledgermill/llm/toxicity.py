"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.language_id import held_out_rows
from ledgermill.llm.stopwords import STOP_WORDS
from ledgermill.llm.textbytes import SpanHashes, Words, mix, text_bytes, text_slices
from ledgermill.session import discard, materialize

THRESHOLD = 0.3
TABLE_BITS = 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
TOP = 3
PREFIXES = (4, 5, 6, 7)
# Rows and bytes of text that one task trains on between two averages of the models.
SHARD_ROWS = 12_000
SHARD_BYTES = 32 << 20
# labelled ids that every task gets, so that texts stay where they are; more are joined with the texts
SENT_LABELS = 4_000_000
# passes over the rows of one shard, and at least over those of many
EPOCHS, LEAST_EPOCHS = 6, 3
# parameters are added up as whole numbers of this part, so that the sums do not depend on the order
FIXED = float(1 << 32)
# width of a cell of equal probabilities on the logit scale when thresholds are chosen
CELLS_PER_LOGIT = 1024

_IS_WORD = np.zeros(256, bool)
_IS_WORD[97:123] = True
_IS_WORD[128:] = True


def word_features(raw: np.ndarray, borders: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of lower-cased text, their ``(n, 1 + len(PREFIXES))`` hashed features, their full hashes.

    The features of a word are itself and its first 4 to 7 bytes (the whole word when shorter).
    """
    words = Words(raw, borders, _IS_WORD)
    spans = SpanHashes(raw.astype(np.uint64) + np.uint64(1))
    length = words.ends - words.starts
    whole = mix(spans.of(words.starts, words.ends) + length.astype(np.uint64))
    columns = [whole]
    for k, cut in enumerate(PREFIXES):
        columns.append(mix(spans.of(words.starts, np.minimum(words.starts + cut, words.ends)) + np.uint64((k + 1) << 40)))
    features = np.stack(columns, axis=1) >> np.uint64(64 - TABLE_BITS)
    return words, features.astype(np.int32), whole


@dataclass
class Model:
    """Embedding rows, one weight block per filter width, filter offsets, output weights, thresholds."""

    table: np.ndarray  # (2 ** TABLE_BITS, DIM)
    filters: list[np.ndarray]  # per width (width, DIM, FILTERS)
    offsets: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (len(WIDTHS) * FILTERS * TOP,)
    bias: float
    thresholds: dict[str, float]

    def responses(self, features: np.ndarray) -> np.ndarray:
        """``(n, filters)`` responses of every filter at every word; too short a rest gives -1."""
        embedded = self.table[features[:, 0]]
        for k in range(1, features.shape[1]):
            embedded = embedded + self.table[features[:, k]]
        out = np.full((len(features), len(self.offsets)), -1.0, np.float32)
        for i, (width, weights) in enumerate(zip(WIDTHS, self.filters)):
            n = len(features) - width + 1
            if n > 0:
                found = embedded[:n] @ weights[0]
                for k in range(1, width):
                    found += embedded[k:k + n] @ weights[k]
                out[:n, i * FILTERS:(i + 1) * FILTERS] = found + self.offsets[i * FILTERS:(i + 1) * FILTERS]
        return out

    def pooled(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``TOP`` largest positive responses of each filter (zeros when fewer), and where they are."""
        found = self.responses(features)
        n = len(found)
        if n > TOP:
            where = np.argpartition(found, n - TOP, axis=0)[n - TOP:]
        else:
            where = np.tile(np.arange(n)[:, None], (1, found.shape[1]))
        values = np.take_along_axis(found, where, axis=0)
        order = np.argsort(-values, axis=0, kind="stable")
        where, values = np.take_along_axis(where, order, axis=0), np.take_along_axis(values, order, axis=0)
        full = np.zeros((TOP, found.shape[1]), np.float32)
        full[:len(values)] = np.maximum(values, 0.0)
        return full, where

    def probability(self, features: np.ndarray) -> float:
        values, _ = self.pooled(features)
        return float(1.0 / (1.0 + np.exp(-(values.ravel() @ self.out + self.bias))))

    def score(self, probability: float, language: str) -> float:
        """Probability stretched so that the threshold of the text's language comes to ``THRESHOLD``."""
        t = self.thresholds.get(language, self.thresholds[""])
        if probability < t:
            return THRESHOLD * probability / t
        return THRESHOLD + (1.0 - THRESHOLD) * (probability - t) / (1.0 - t)


class Training:
    """A model on its way: its parameters with their Adagrad sums, as it starts from ``seed``."""

    def __init__(self, seed: int = 7, rate: float = 0.1):
        self.random, self.rate = np.random.default_rng(seed), rate
        size = len(WIDTHS) * FILTERS
        self.model = Model(
            self.random.normal(0, 0.1, (1 << TABLE_BITS, DIM)).astype(np.float32),
            [self.random.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(size, np.float32), self.random.normal(0.3, 0.1, TOP * size).astype(np.float32), -1.0, {"": 0.5})
        self.sums = [np.full_like(x, 1e-2) for x in (self.model.table, *self.model.filters, self.model.offsets, self.model.out)]
        self.bias_sum = 1e-2
        self.touched = np.zeros(1 << TABLE_BITS, bool)

    def run(self, samples: list[np.ndarray], labels: np.ndarray, epochs: int) -> None:
        """Adagrad on the log loss, one text at a time; only the pooled words pass a gradient on."""
        model, sums, rate, size = self.model, self.sums, self.rate, len(WIDTHS) * FILTERS

        def step(values: np.ndarray, total: np.ndarray, gradient: np.ndarray, at=...) -> None:
            total[at] += gradient * gradient
            values[at] -= rate * gradient / np.sqrt(total[at])

        for _ in range(epochs):
            for i in self.random.permutation(len(samples)).tolist():
                features = samples[i]
                values, where = model.pooled(features) if len(features) else (np.zeros((TOP, size), np.float32), np.zeros((0, size), int))
                p = 1.0 / (1.0 + np.exp(-(values.ravel() @ model.out + model.bias)))
                error = np.float32(p - labels[i])
                passed = (error * model.out.reshape(TOP, size)) * (values > 0)
                step(model.out, sums[-1], error * values.ravel())
                self.bias_sum += float(error * error)
                model.bias -= rate * float(error) / self.bias_sum ** 0.5
                step(model.offsets, sums[-2], passed.sum(axis=0))
                for w, width in enumerate(WIDTHS):
                    rows, cols = np.nonzero(passed[:len(where), w * FILTERS:(w + 1) * FILTERS])
                    if not len(rows):
                        continue
                    gradient = passed[rows, w * FILTERS + cols]
                    start = where[rows, w * FILTERS + cols]
                    for k in range(width):
                        used = features[start + k]
                        embedded = model.table[used].sum(axis=1)
                        by_filter = np.zeros((FILTERS, DIM), np.float32)
                        np.add.at(by_filter, cols, gradient[:, None] * embedded)
                        to_rows, back = np.unique(used, return_inverse=True)
                        into = np.zeros((len(to_rows), DIM), np.float32)
                        np.add.at(into, back.reshape(used.shape), (gradient[:, None] * model.filters[w][k].T[cols])[:, None, :])
                        step(model.filters[w], sums[1 + w], by_filter.T, k)
                        step(model.table, sums[0], into, to_rows)
                        self.touched[to_rows] = True

    def done(self) -> Model:
        # rows no pooled word ever used say nothing about a text
        self.model.table[~self.touched] = 0.0
        return self.model

    def _dense(self) -> list[np.ndarray]:
        return [*self.model.filters, self.model.offsets, self.model.out]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`run` changed, as numbered rows of ``DIM`` parameters and ``DIM`` sums: words from 0 on, the rest below."""
        words = np.flatnonzero(self.touched)
        rest = [np.concatenate([x.ravel() for x in side]).astype(np.float64) for side in (self._dense(), self.sums[1:])]
        rest = [np.append(rest[0], self.model.bias), np.append(rest[1], self.bias_sum)]
        rest = [np.pad(x, (0, -len(x) % DIM)).reshape(-1, DIM) for x in rest]
        values = np.concatenate([np.hstack([self.model.table[words], self.sums[0][words]]), np.hstack(rest)])
        return np.append(words, -1 - np.arange(len(rest[0]))), values.astype(np.float32)

    def take(self, at: np.ndarray, values: np.ndarray) -> None:
        """Go on from the rows of :meth:`rows`, or from their averages."""
        word = at >= 0
        self.model.table[at[word]], self.sums[0][at[word]] = values[word, :DIM], values[word, DIM:]
        self.touched[at[word]] = True
        rest = values[~word][np.argsort(-at[~word])]

        def fill(into: list[np.ndarray], flat: np.ndarray) -> float:
            begin = 0
            for x in into:
                x[...] = flat[begin:begin + x.size].reshape(x.shape)
                begin += x.size
            return float(flat[begin])

        self.model.bias = fill(self._dense(), rest[:, :DIM].ravel())
        self.bias_sum = fill(self.sums[1:], rest[:, DIM:].ravel())


def train(samples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, seed: int = 7) -> Model:
    """A model trained on texts in memory."""
    training = Training(seed, rate)
    training.run(samples, labels, epochs)
    return training.done()


class LanguageVotes:
    """Language of a text by its function words, for choosing a threshold; the column ``lang`` is not read."""

    def __init__(self):
        self.names = sorted(STOP_WORDS)
        texts = [" ".join(STOP_WORDS[n]) for n in self.names]
        words, _, whole = word_features(*text_bytes(pa.array(texts)))
        self.known, first = np.unique(whole, return_index=True)
        self.votes = np.zeros((len(self.known) + 1, len(self.names)), np.int64)
        np.add.at(self.votes, (np.searchsorted(self.known, whole), words.row), 1)

    def of(self, whole: np.ndarray) -> str:
        at = np.searchsorted(self.known, whole)
        at[at == len(self.known)] = 0
        found = self.votes[at[self.known[at] == whole]].sum(axis=0) if len(whole) else np.zeros(len(self.names), int)
        return self.names[int(np.argmax(found))] if found.sum() else ""


def _best_cut(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float | None:
    """Threshold of the best F1 for cells of texts with probabilities from ``low`` to ``high``, or none with too few toxic ones.

    Between the two probabilities around the best cut the middle (on the logit scale) is taken.
    """
    if toxic.sum() < 5 or toxic.sum() == rows.sum():
        return None
    order = np.argsort(-high, kind="stable")
    low, high, toxic, rows = (x[order] for x in (low, high, toxic, rows))
    k = int(np.argmax(2 * np.cumsum(toxic) / (np.cumsum(rows) + toxic.sum())))
    below = high[k + 1] if k + 1 < len(high) else low[k] / 2
    logit = [np.log(max(v, 1e-9) / max(1 - v, 1e-9)) for v in (low[k], below)]
    return float(np.clip(1 / (1 + np.exp(-sum(logit) / 2)), 0.01, 0.99))


def set_thresholds(model: Model, cells: dict[str, tuple[np.ndarray, ...]]) -> None:
    """Set per language the threshold with the best F1 over its cells (:func:`_best_cut`); ``""`` has the cells of all texts.

    Languages with few toxic texts use the threshold of all.
    """
    everything = _best_cut(*cells[""]) if "" in cells else None
    model.thresholds = {"": 0.5 if everything is None else everything}
    for language, columns in cells.items():
        threshold = _best_cut(*columns) if language else None
        if threshold is not None:
            model.thresholds[language] = threshold


def calibrate(model: Model, samples: list[np.ndarray], languages: list[str], labels: np.ndarray) -> None:
    """:func:`set_thresholds` from texts in memory that the training did not see."""
    p, names = np.array([model.probability(s) for s in samples]), np.array(languages, dtype=object)

    def cells(chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        values, back = np.unique(p[chosen], return_inverse=True)
        toxic = np.bincount(back, labels[chosen], len(values))
        return values, values, toxic, np.bincount(back, minlength=len(values))

    every = {"": np.ones(len(p), bool)} | {name: names == name for name in set(languages) - {""}}
    set_thresholds(model, {name: cells(chosen) for name, chosen in every.items()})


def _shards(batches: Iterator[pa.RecordBatch], calibration: bool) -> Iterator[tuple[int, list[np.ndarray], list[str], np.ndarray]]:
    """Number, features, languages and labels of every shard: a fifth of its rows is for calibration, the rest for training."""
    votes = LanguageVotes()
    for stored in batches:
        for number, listed in zip(stored.column("shard").to_pylist(), stored.column("rows")):
            rows = pa.RecordBatch.from_struct_array(listed.values)
            held = np.arange(rows.num_rows) % 5 == 0
            rows = rows.filter(pa.array(held if calibration else ~held))
            samples, languages = [], []
            for _, raw, borders in text_slices(rows):
                words, features, whole = word_features(raw, borders)
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    samples.append(features[a:b])
                    languages.append(votes.of(whole[a:b]))
            yield number, samples, languages, rows.column("toxic").to_numpy()


_ROW = [f"v{i}" for i in range(2 * DIM)]


def _trained(shards: DataFrame, training: Training | None, turn: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Every shard goes on from ``training`` by itself; the averages of what they changed."""
    sent = shards.sparkSession.sparkContext.broadcast(training)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, samples, _, labels in _shards(batches, calibration=False):
            if sent.value is None:
                own = Training()
            else:
                own = copy.deepcopy(sent.value)
                own.random = np.random.default_rng([turn, shard])
                own.touched[:] = False
            own.run(samples, labels, epochs)
            at, values = own.rows()
            columns = [np.ascontiguousarray(values[:, i]) for i in range(len(_ROW))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int32), *columns)], ["at", *_ROW])

    changed = shards.mapInArrow(work, "at int, " + ", ".join(f"{c} float" for c in _ROW))
    # a word's row is averaged over the shards that met the word
    mean = [(F.sum((F.col(c) * F.lit(FIXED)).cast("long")) / F.count(F.lit(1)) / F.lit(FIXED)).alias(c) for c in _ROW]
    found = changed.repartition("at").groupBy("at").agg(*mean).toArrow()
    sent.destroy()
    return found.column("at").to_numpy(), np.stack([found.column(c).to_numpy() for c in _ROW], axis=1)


def _cells(shards: DataFrame, model: Model) -> dict[str, tuple[np.ndarray, ...]]:
    """Texts kept for calibration, counted by language and probability."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, samples, languages, labels in _shards(batches, calibration=True):
            p = pa.array([sent.value.probability(s) for s in samples], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(languages, pa.string()), p, pa.array(labels, pa.int32())], ["language", "p", "toxic"])

    scored = shards.mapInArrow(work, "language string, p double, toxic int")
    q = F.greatest(F.least("p", F.lit(1 - 1e-14)), F.lit(1e-14))
    cell = F.floor(F.log(q / (1 - q)) * CELLS_PER_LOGIT).alias("cell")
    counted = scored.groupBy("language", cell).agg(
        F.min("p").alias("low"), F.max("p").alias("high"), F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows")).toPandas()
    sent.destroy()
    of_all = counted.groupby("cell", as_index=False).agg({"low": "min", "high": "max", "toxic": "sum", "rows": "sum"})
    parts = [("", of_all), *((name, part) for name, part in counted.groupby("language") if name)]
    return {name: tuple(part[c].to_numpy() for c in ("low", "high", "toxic", "rows")) for name, part in parts if len(part)}


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> Model:
    """Train on all labelled rows outside the held-out quarter, whole texts.

    Rows are dealt by the hash of their id into shards of about ``shard_rows`` rows and ``shard_bytes`` bytes
    at most, one stored row each, which later rounds read without a shuffle. Every shard trains in a task of its own, one pass a round, and the models are averaged after each
    round; the model, whose size is fixed, is what travels. A single shard makes all its passes at once. A fifth of
    every shard is kept for calibration. With no usable labels every score is below the threshold.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")).where(~held_out_rows())
    marked = materialize(marked, "labels")
    known = F.broadcast(marked) if marked.count() <= SENT_LABELS else marked
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(~held_out_rows())
    count, size, least, most = texts.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id").agg(
        F.count(F.lit(1)), F.sum("size"), F.min("toxic"), F.max("toxic")).first()
    if not count or least == most:
        width = len(WIDTHS) * FILTERS
        return Model(np.zeros((1 << TABLE_BITS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                     np.zeros(width, np.float32), np.zeros(TOP * width, np.float32), -2.0, {"": 0.5})
    shards = max(1, -(-count // shard_rows), -(-size // shard_bytes))
    place = F.xxhash64("doc_id")
    shard = F.pmod(F.xxhash64(place), F.lit(shards)).cast("int").alias("shard")
    listed = F.sort_array(F.collect_list(F.struct(place.alias("place"), "doc_id", F.lower("text").alias("text"), "toxic"))).alias("rows")
    dealt = materialize(texts.join(known, "doc_id").groupBy(shard).agg(listed), "labelled-texts")
    rounds, passes = (1, EPOCHS) if shards == 1 else (max(LEAST_EPOCHS, -(-EPOCHS // shards)), 1)
    training = None
    for turn in range(rounds):
        at, values = _trained(dealt, training, turn, passes)
        training = training or Training()
        training.take(at, values)
    model = training.done()
    set_thresholds(model, _cells(dealt, model))
    discard(dealt)
    return model


def score_udf(spark, model: Model):
    """Score of a text column as a column function; the model goes to every task once."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready, votes = sent.value, LanguageVotes()
        for column in texts:
            lowered = pa.RecordBatch.from_arrays([pc.utf8_lower(column)], ["text"])
            scores = []
            for _, raw, borders in text_slices(lowered):
                words, features, whole = word_features(raw, borders)
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    scores.append(ready.score(ready.probability(features[a:b]), votes.of(whole[a:b])))
            yield pa.array(scores, pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for every document: the score from the whole text alone.

    ``predicted`` is 1 when the score is at least 0.3. Null and wordless texts get the score of an
    empty text. Repeated rows give repeated rows; other columns are ignored; an empty table gives an
    empty table.
    """
    score = score_udf(docs.sparkSession, model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.3."""
    return docs.where(score_udf(docs.sparkSession, model)(F.col("text")) < THRESHOLD)
