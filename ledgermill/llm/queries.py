"""The numbered operators over the shared tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm.decontaminate import find_benchmark
from ledgermill.llm.exact_dedup import deduplicate, new_index
from ledgermill.llm.html_text import extract_text
from ledgermill.llm.language_id import held_out_rows, identify, learn_profiles
from ledgermill.llm.line_dedup import drop_recurring_lines
from ledgermill.llm.packing import pack
from ledgermill.llm.resampling import draw
from ledgermill.llm.simhash import near_duplicates
from ledgermill.llm.spelling import group_variants
from ledgermill.llm.substring_dedup import remove_repeats as remove_repeated_words
from ledgermill.llm.suffix_dedup import remove_repeats as remove_repeated_bytes
from ledgermill.llm.toxicity import fit, score_documents
from ledgermill.llm.warc_archive import new_archive, parsed, read_archive, write_archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids", F.round("best_similarity", 6).alias("best_similarity"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_rows().alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, learn_profiles(docs.where(~held_out_rows())))
    return found.select("doc_id", held_out_rows().alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = new_index(spark, f"digest-index-{uuid.uuid4().hex}")
    found = deduplicate(_table(spark, sf_dir, "documents"), index)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = new_archive(spark, f"warc-{uuid.uuid4().hex}")
    write_archive(_table(spark, sf_dir, "pages"), archive)
    return parsed(read_archive(spark, archive))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_html_text": op7_html_text,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_resampling": op11_resampling,
    "op12_spelling": op12_spelling,
    "op13_warc": op13_warc,
}

LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_sql(hexed: str) -> str:
    """DuckDB SQL for the crc32 of the bytes in a column of hex digits, half a byte at a time."""
    halves = (f"list_transform(range(strlen({hexed})), lambda i: "
              f"(instr('0123456789ABCDEF', substr({hexed}, (xor(i, 1) + 1)::INT, 1)) - 1)::UBIGINT)")
    # the remainders of the four single bits of half a byte
    bits = [(0, 0x1DB71064), (1, 0x3B6E20C8), (2, 0x76DC4190), (3, 0xEDB88320)]
    step = "c >> 4"
    for bit, remainder in bits:
        step = f"xor({step}, ((xor(c, x) >> {bit}) & 1) * {remainder}::UBIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {halves}), lambda c, x: {step}), 4294967295::UBIGINT)")


_FEATURES = r"""
    SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
    FROM (SELECT {key}, regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table})"""

ORACLE = {
    "op11_resampling": f"""
        WITH d AS ({_FEATURES.format(key='doc_id', text=LOWERED.format('text'), table='documents')}),
        b AS ({_FEATURES.format(key='item_id', text=LOWERED.format('text'), table='benchmark')}),
        dn AS (SELECT doc_id, f, count(*) AS n FROM d GROUP BY ALL), bn AS (SELECT f, count(*) AS n FROM b GROUP BY ALL),
        h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM dn UNION SELECT f FROM bn)),
        k AS (SELECT f, {_crc_sql('x')} % 10000 AS bucket FROM h),
        s AS (SELECT bucket, sum(n) AS s FROM dn JOIN k USING (f) GROUP BY bucket),
        t AS (SELECT bucket, sum(n) AS t FROM bn JOIN k USING (f) GROUP BY bucket),
        c AS (SELECT range AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t
              FROM range(10000) LEFT JOIN s ON range = s.bucket LEFT JOIN t ON range = t.bucket),
        a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
        g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS gain FROM c, a),
        w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
              FROM dn JOIN k USING (f) JOIN g USING (bucket) GROUP BY doc_id),
        e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
              FROM documents LEFT JOIN w USING (doc_id)),
        r AS (SELECT doc_id, n_features, weight,
                     weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
              FROM r WHERE n_features >= 39)
        SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
        FROM r LEFT JOIN o USING (doc_id)""",
    "op12_spelling": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, unnest(regexp_extract_all({LOWERED.format('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents),
        o AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x
              FROM d WHERE length(run) >= 7 GROUP BY ALL),
        c AS (SELECT run, n, {_crc_sql('x')} AS h FROM o),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM (
                  SELECT CASE WHEN h % 31 = 0
                              THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                              ELSE run END AS word, n FROM c)
              WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        m AS (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS less
              FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
        p AS (SELECT a.word, b.word AS near FROM m a JOIN m b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
              UNION SELECT m.word, v.word FROM m JOIN v ON m.less = v.word
              UNION SELECT v.word, m.word FROM m JOIN v ON m.less = v.word),
        q AS (SELECT p.word, near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
                     row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near) AS place
              FROM p JOIN v ON p.near = v.word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
                     CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
              FROM v LEFT JOIN q ON v.word = q.word AND place = 1),
        r(word, last, steps) AS (
            SELECT word, word, 0 FROM f
            UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON r.last = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, form, arg_max(r.last, steps) AS root, f.n, n_near, form_n
        FROM f JOIN r ON f.word = r.word GROUP BY f.word, form, f.n, n_near, form_n""",
    "op13_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS x FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first_page,
                     list_transform(range(40), lambda i: instr('0123456789ABCDEF', substr(x, (i + 1)::INT, 1)) - 1) AS n
              FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((n[(5 * j // 4 + 1)::INT] * 16 + n[(5 * j // 4 + 2)::INT]) >> (3 - (5 * j) % 4)::INT) & 31)::INT + 1, 1)),
                   '') AS payload_digest,
               CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_page THEN first_page END AS refers_to
        FROM d""",
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
