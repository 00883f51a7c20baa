"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records rebuilt by joins.

An archive is a folder of two tables. ``payloads`` holds every different payload once under its SHA-256;
the write fails if two payloads under one digest differ in length or SHA-1. ``records`` holds, for every
record, the exact bytes that stand before its payload. The bytes of a record are its header, its payload if
it is a response, and the two line ends that close it; :func:`write_warc` makes WARC files of them.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.session import checkpoint_root

VERSION = "WARC/1.1"
EOL = "\r\n"
CLOSE = EOL * 2
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED_AT = "1970-01-01T00:00:00Z"
RECORD_ID = "urn:x-page:"
NO_ID = "none"
# Records that one copy of a payload is joined to. A payload with more of them is repeated.
RECORDS_A_COPY = 10_000
RECORDS_A_FILE = 100_000


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 20 bytes given in hex: five hex digits are four letters."""
    letters = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(hex_digest, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.lit(BASE32).substr(place, F.lit(1)))
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(page_id.cast("string"), F.lit(NO_ID)), F.lit(">"))


def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, n_bytes, sha256, sha1``; a null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({
        "n_bytes": F.octet_length("payload").cast("long"),
        "sha256": F.unhex(F.sha2("payload", 256)),
        "sha1": base32(F.sha1("payload")),
    })


def _headers(captured: DataFrame, payloads: DataFrame, captured_at: str) -> DataFrame:
    """``page_id, sha256, copy, has_payload, header`` of every capture, from its payload's first holder."""
    known = payloads.select("sha256", "first_page", "copies")
    rows = captured.drop("payload").join(known, "sha256")
    is_response = F.col("page_id").eqNullSafe(F.col("first_page"))
    # line ends inside a url would end the header line
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"),
        _line("Content-Length", F.col("n_bytes").cast("string")), F.lit(EOL))
    kind = F.when(is_response, F.lit("response")).otherwise(F.lit("revisit"))
    block = F.octet_length(http) + F.when(is_response, F.col("n_bytes")).otherwise(F.lit(0))
    revisit = F.when(is_response, F.lit("")).otherwise(F.concat(
        F.lit(f"WARC-Profile: {REVISIT_PROFILE}{EOL}"), _line("WARC-Refers-To", _record_id(F.col("first_page")))))
    header = F.concat(
        F.lit(VERSION + EOL), _line("WARC-Type", kind), _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {captured_at}{EOL}"), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), revisit,
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
        _line("Content-Length", block.cast("string")), F.lit(EOL), http)
    spread = F.ceil(F.col("copies") / RECORDS_A_COPY).cast("long")
    return rows.select(
        "page_id", "sha256", F.pmod(F.xxhash64("page_id", "url"), spread).alias("copy"),
        is_response.alias("has_payload"), header.cast("binary").alias("header"))


def write_archive(pages: DataFrame, folder: str, captured_at: str = CAPTURED_AT) -> None:
    """Store one record for every row of ``pages`` (``page_id, url, html``; other columns are ignored).

    Of records with equal payloads the one with the smallest ``page_id`` is the response, the others
    revisit it. Rows that repeat this ``page_id`` are responses too; a null ``page_id`` is larger than any
    other, and a response if its payload has no other. A null html is an empty payload, a null url is empty,
    line ends in a url become spaces. An empty table gives an archive without records.
    """
    captured = captures(pages)
    # one payload a digest and task travels; of a payload held by a third of all rows each task sends one
    found = captured.groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.min("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("most_bytes"),
        F.min("sha1").alias("sha1"), F.max("sha1").alias("other_sha1"),
        F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies"))
    same = (F.col("n_bytes") == F.col("most_bytes")) & (F.col("sha1") == F.col("other_sha1"))
    clash = F.raise_error(F.concat(F.lit("different payloads under SHA-256 "), F.hex("sha256"))).cast("long")
    checked = found.withColumn("n_bytes", F.when(same, F.col("n_bytes")).otherwise(clash))
    checked.select("sha256", "payload", "n_bytes", "sha1", "first_page", "copies").write.parquet(f"{folder}/payloads")
    payloads = pages.sparkSession.read.parquet(f"{folder}/payloads")
    _headers(captured, payloads, captured_at).write.parquet(f"{folder}/records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, has_payload, header, payload, record``: every record of the archive with its exact bytes.

    ``payload`` is the full payload, of revisits too. A payload is joined to a bounded number of
    records at a time: one with more of them is repeated. A payload that no longer has its digest ends the job.
    """
    records = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads").select("sha256", "payload", "copies")
    broken = F.raise_error(F.concat(F.lit("payload lost its SHA-256 "), F.hex("sha256"))).cast("binary")
    intact = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(broken)
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / RECORDS_A_COPY).cast("long") - 1))
    copies = payloads.select("sha256", intact.alias("payload"), spread.alias("copy"))
    joined = records.join(copies, ["sha256", "copy"])
    held = F.when(F.col("has_payload"), F.col("payload")).otherwise(F.lit(b""))
    return joined.select(
        "page_id", "has_payload", "header", "payload",
        F.concat("header", held, F.lit(CLOSE).cast("binary")).alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the headers and payloads of records.

    The digest is that of the payload's bytes; a header that names another one, or a length that does
    not fit the record, ends the job.
    """
    digest = base32(F.sha1("payload"))
    header = F.col("header").cast("string")

    def field(name: str) -> Column:
        return F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1)

    block = F.octet_length("record") - F.octet_length(F.substring_index(header, CLOSE, 1)) - 2 * len(CLOSE)
    fits = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (
        field("Content-Length").cast("long") == block)
    wrong = F.raise_error(F.concat(F.lit("record does not fit its header: "), header))
    page = F.regexp_extract(field("WARC-Refers-To"), rf"^<{RECORD_ID}(-?\d+)>$", 1)
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(fits, digest).otherwise(wrong).alias("payload_digest"),
        field("WARC-Type").alias("record_type"), F.when(page != "", page.cast("long")).alias("refers_to"))


def new_archive(spark: SparkSession, name: str) -> str:
    """A folder under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}"


# -- WARC files ------------------------------------------------------------------------

def write_warc(records: DataFrame, folder: str, records_a_file: int = RECORDS_A_FILE) -> None:
    """Gzipped WARC files of the ``record`` bytes; their two last line ends are written as the separator."""
    body = F.expr(f"substring(record, 1, octet_length(record) - {len(CLOSE)})").cast("string")
    (
        records.select(body.alias("value")).write.option("lineSep", CLOSE).option("compression", "gzip")
        .option("maxRecordsPerFile", records_a_file).text(folder)
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``header, payload``: exact bytes before and of the payload of every record below ``folder``.

    A file is cut by the lengths its headers state, whatever the payloads hold; one file is one row, so
    files are bounded by :func:`write_warc`'s records a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_py()
                if name.as_py().endswith(".gz"):
                    data = gzip.decompress(data)
                headers, payloads, at = [], [], 0
                while at < len(data):
                    start = data.index(CLOSE.encode(), at) + len(CLOSE)
                    lines = data[at:start].decode().split(EOL)
                    length = next(int(line.split(":", 1)[1]) for line in lines if line.lower().startswith("content-length:"))
                    inner = data.index(CLOSE.encode(), start) + len(CLOSE)
                    headers.append(data[at:inner])
                    payloads.append(data[inner:start + length])
                    at = start + length + len(CLOSE)
                    if len(headers) == 1000:
                        yield pa.RecordBatch.from_pydict({"header": headers, "payload": payloads})
                        headers, payloads = [], []
                if headers:
                    yield pa.RecordBatch.from_pydict({"header": headers, "payload": payloads})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(folder).select("path", "content")
    return files.mapInArrow(run, "header binary, payload binary")
