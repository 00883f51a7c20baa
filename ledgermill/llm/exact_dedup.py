"""Exact dedup against a persistent digest index: native expressions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.session import checkpoint_root, discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 64


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased (no other letter), null as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.unhex(F.sha2(lowered.cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, each with the batch that brought it, stored as Parquet bucketed and sorted by ``digest``.

    ``path`` is a folder all executors share. The catalog entry is made anew in each session
    over the same files, so the index outlives sessions. One index has one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.table = "digest_index_" + "".join(c if c.isalnum() else "_" for c in self.path)[-80:].lower()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, doc_id BIGINT, batch STRING) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def known(self, found: DataFrame, how: str, batch: str = "") -> DataFrame:
        """Sort-merge semi- or anti-join of rows with a ``digest`` and those of other batches; the index side is not shuffled."""
        others = self.rows().where(F.col("batch") != batch).select("digest")
        return found.join(others.hint("merge"), "digest", how)

    def append(self, kept: DataFrame, batch: str) -> None:
        """Add ``(digest, doc_id)`` rows that no other batch has, one file per bucket; what ``batch`` added before stays as it is."""
        own = self.rows().where(F.col("batch") == batch).select("digest")
        new = kept.join(own.hint("merge"), "digest", "left_anti").select("digest", "doc_id", F.lit(batch).alias("batch"))
        new.repartition(self.buckets, "digest").write.insertInto(self.table)

    def forget(self) -> None:
        """Drop the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _fresh_groups(docs: DataFrame, index: DigestIndex, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, digest)`` of every row, and per digest the row to keep, the size, whether it was known.

    Digests that are not in the index are appended to it.
    """
    batch = batch or uuid.uuid4().hex
    digests = materialize(docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest")), "digests")
    # combined map-side: a text held by a third of all rows is one row per task here
    groups = materialize(
        digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    fresh = materialize(
        index.known(groups, "left_anti", batch).select("digest", F.col("keep_id").alias("doc_id")), "fresh-digests")
    index.append(fresh, batch)
    marked = groups.join(
        fresh.select("digest", F.lit(True).alias("fresh")), "digest", "left"
    ).select("digest", "keep_id", "group_size", F.col("fresh").isNull().alias("known"))
    marked = materialize(marked, "marked-groups")
    discard(groups)
    return digests, marked


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, known, text_sha256``.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest ``doc_id`` stays,
    unless the index already holds the text: then ``known`` is true and no row of the group is
    kept. New digests are appended before the result is returned, marked with ``batch``: a job that
    fails later and runs again under the same name gets the same result, since what its own batch
    added is not known to it. Without a name every call is a batch of its own. ``keep_id`` is the largest
    ``doc_id`` of the group in this batch. Rows that repeat a ``doc_id`` within a group are all
    marked alike; a null ``doc_id`` is smaller than any other and kept only if its group has
    no other. Columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an
    empty table.
    """
    digests, marked = _fresh_groups(docs, index, batch)
    return digests.join(marked, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")).alias("kept"),
        "known", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`deduplicate` keeps; of rows alike in text and ``doc_id``, one.

    Rows meet their group on digest and id together, so the copies of a text do not meet in one task.
    """
    _, marked = _fresh_groups(docs, index, batch)
    own, key, place = "_exact_dedup_id", "_exact_dedup_digest", "_exact_dedup_place"
    least = F.lit(-(1 << 63)).cast("long")
    kept = marked.where("NOT known").select(F.col("digest").alias(key), F.coalesce("keep_id", least).alias(own))
    rows = docs.withColumns({key: digest(F.col("text")), own: F.coalesce(F.col("doc_id").cast("long"), least)})
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    order = Window.partitionBy(key, own).orderBy(F.xxhash64(*hashed))
    return (
        rows.join(kept.hint("merge"), [key, own]).withColumn(place, F.row_number().over(order))
        .where(F.col(place) == 1).select(*docs.columns)
    )


def new_index(spark: SparkSession, name: str, buckets: int = BUCKETS) -> DigestIndex:
    """An index in a folder of its own under the shared folder."""
    return DigestIndex(spark, f"{checkpoint_root(spark).rstrip('/')}/{name}", buckets)
