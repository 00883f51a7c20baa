"""The corpus pipeline, stage by stage, against what each stage must keep."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgermill.llm import simhash as S
from text_tables import awkward, documents, prose

ITEM = prose(80, 30)


def _folder(spark, path, rows):
    docs = documents(spark, rows)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 == 0)) for i in range(1000, 1400)]
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def _labelled():
    bad = ["vile", "nasty", "awful"]
    return [(i, prose(i, 40) + (f" {bad[i % 3]} " + prose(i + 900, 30) + f" {bad[(i + 1) % 3]}" if i % 4 == 0 else ""))
            for i in range(1000, 1400)]


def test_each_stage_keeps_what_it_must(spark, tmp_path):
    rows = awkward() + _labelled() + [(60, prose(90, 40) + " " + ITEM + " " + prose(91, 40))]
    docs = _folder(spark, tmp_path, rows)
    kept, before = {}, Counter(d for d, _ in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.select("doc_id", "text").collect()
        after = Counter(r.doc_id for r in kept[name])
        assert not after - before  # a stage adds nothing
        before = after
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    toxic = {i for i in range(1000, 1400) if i % 4 == 0}
    clean = {i for i in range(1000, 1400) if i % 4}
    assert len(toxic - ids["toxicity"]) > 0.9 * len(toxic) and len(clean & ids["toxicity"]) > 0.9 * len(clean)
    lowered = Counter((r.text or "").lower() for r in kept["exact_dedup"])
    assert max(lowered.values()) == 1 and 3 in ids["exact_dedup"]
    assert {(r.text or "").lower() for r in kept["toxicity"]} == set(lowered)
    prints = {r.doc_id: int.from_bytes(S.fingerprint(r.text)) for r in kept["exact_dedup"]}
    left = np.array([prints[r.doc_id] for r in kept["near_dedup"]], np.uint64)
    for i, p in enumerate(left):
        assert (np.bitwise_count(left ^ p) <= 3).sum() == 1, i
    assert 60 in ids["near_dedup"] and ids["near_dedup"] - ids["decontamination"] == {60}
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, docs, str(tmp_path)).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == Counter({r.doc_id: len((r.text or "").encode().split()) + 1 for r in kept["decontamination"]})


def test_run_over_an_empty_table(spark, tmp_path):
    _folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_is_a_registered_query():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n in __spark_entry__.queries() if n.startswith("op")] == [
        "op1_line_dedup", "op2_packing", "op3_simhash", "op4_suffix_dedup", "op5_substring_dedup", "op6_decontamination",
        "op7_html_text", "op8_toxicity", "op9_language_id", "op10_exact_dedup", "op11_resampling", "op12_spelling", "op13_warc"]
