"""Exact, SimHash, suffix, substring and line dedup against row-by-row statements."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgermill.llm import line_dedup as L
from ledgermill.llm import simhash as S
from ledgermill.llm import substring_dedup as W
from ledgermill.llm import suffix_dedup as B
from ledgermill.llm.components import connected_components
from ledgermill.llm.exact_dedup import deduplicate, new_index, without_copies
from ledgermill.llm.queries import op1_line_dedup
from text_tables import awkward, documents, prose

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def components(nodes, linked) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- exact -----------------------------------------------------------------------------

def test_exact_dedup(spark):
    rows = awkward()
    got = deduplicate(documents(spark, rows), new_index(spark, "exact-a")).collect()
    groups: dict[str, list] = {}
    for doc, text in rows:
        groups.setdefault(sha((text or "").translate(ASCII_LOWER).encode()), []).append(doc)
    want = Counter()
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, False, digest) for i in ids)
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_index_outlives_a_batch(spark):
    index = new_index(spark, "exact-b", buckets=4)
    first = documents(spark, [(1, "Text one"), (2, "other")])
    assert {r.doc_id for r in deduplicate(first, index).collect() if r.kept} == {1, 2}
    index.forget()
    index = new_index(spark, "exact-b", buckets=4)  # a later session opens the same files
    again = {r.doc_id: (r.kept, r.known) for r in deduplicate(documents(spark, [(3, "TEXT ONE"), (4, "new")]), index).collect()}
    assert again == {3: (False, True), 4: (True, False)}
    plan = index.known(first.selectExpr("unhex(sha2(text, 256)) AS digest"), "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount" in plan


def test_exact_dedup_repeats_a_batch_whose_result_was_lost(spark):
    docs = documents(spark, [(1, "one"), (2, "two"), (3, "ONE")])
    index = new_index(spark, "exact-f", buckets=4)
    deduplicate(docs, index, "monday")  # appended, but its rows were never stored
    again = deduplicate(documents(spark, [(1, "one"), (2, "two"), (3, "ONE"), (4, "new")]), index, "monday").collect()
    assert {r.doc_id for r in again if r.kept} == {2, 3, 4} and not any(r.known for r in again)
    assert without_copies(docs, index, "monday").count() == 2
    assert all(r.known and not r.kept for r in deduplicate(docs, index, "tuesday").collect())
    assert without_copies(docs, index).count() == 0
    assert sorted(r.doc_id for r in index.rows().collect()) == [2, 3, 4]


def test_exact_dedup_runs_without_python(spark):
    plan = deduplicate(documents(spark, [(1, "a")]), new_index(spark, "exact-c"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_without_copies_keeps_one_row_and_all_columns(spark):
    docs = documents(spark, awkward())
    kept = without_copies(docs, new_index(spark, "exact-d"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17] or \
        Counter(r.doc_id for r in kept.collect())[8] == 1


@pytest.mark.parametrize("operator", [
    lambda d, s: deduplicate(d, new_index(s, "exact-e")), lambda d, s: S.near_duplicates(d), lambda d, s: B.remove_repeats(d),
    lambda d, s: W.remove_repeats(d), lambda d, s: L.drop_recurring_lines(d)])
def test_empty_tables(spark, operator):
    assert operator(documents(spark, []), spark).collect() == []


# -- SimHash ---------------------------------------------------------------------------

def fingerprint_by_hand(text):
    words = (text or "").translate(ASCII_LOWER).encode().split()
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_near_duplicates(spark):
    rows = awkward() + [(100 + i, prose(50, 400).replace(" ", f" x{i} ", 1)) for i in range(20)]
    got = S.near_duplicates(documents(spark, rows)).collect()
    prints = {fingerprint_by_hand(t) for _, t in rows}
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    of = components(prints, near)
    smallest: dict = {}
    for doc, text in rows:
        c = of[fingerprint_by_hand(text)]
        smallest[c] = min((x for x in (smallest.get(c), doc) if x is not None), default=None)
    want = Counter((doc, f"{fingerprint_by_hand(t):016x}", smallest[of[fingerprint_by_hand(t)]]) for doc, t in rows)
    assert Counter(tuple(r) for r in got) == want


def test_every_pair_within_three_bits_shares_a_chain_key_and_passes_the_ring():
    random = np.random.default_rng(3)
    fps = random.integers(0, 1 << 63, 4000, dtype=np.uint64)
    masks = np.zeros(4000, np.uint64)
    for _ in range(3):
        masks ^= np.uint64(1) << random.integers(0, 64, 4000).astype(np.uint64)
    shared = (S.chain_keys(fps) == S.chain_keys(fps ^ masks)).any(axis=1)
    assert shared.all() and S.ring_passes(masks).all()


def test_crowded_keys_are_dealt_in_blocks_without_losing_links(spark):
    # many fingerprints that differ in a few low bits of one segment
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (i << 1) for i in range(300)} | {base ^ (i << 40) for i in range(40)})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(r.a, r.b) for r in S.near_links(table, block=16).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert components(fps, links) == components(fps, near)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, 201), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 200: 200, 201: 200}


# -- suffix array ----------------------------------------------------------------------

def bytes_by_hand(rows, length):
    seen: Counter = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        seen.update(t[i:i + length] for i in range(len(t) - length + 1))
    for (doc, _), t in zip(rows, texts):
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        spans = bytes(covered).count(b"\0\1") + covered.startswith(b"\1")
        yield doc, len(t), sum(covered), spans, sha(bytes(x for x, c in zip(t, covered) if not c))


def suffix_rows():
    return [(d, t if t is None else t[:3000]) for d, t in awkward()] + [
        (30, prose(9, 200)), (31, "x" + prose(9, 200)[7:] + "y"), (32, prose(10, 150)), (32, prose(10, 150)), (None, prose(9, 200))]


@pytest.mark.parametrize("segments", [B.KEY_SEGMENTS, 1])
def test_suffix_dedup(spark, monkeypatch, segments):
    monkeypatch.setattr(B, "repeated_ranges", lambda d, n, whole=B.repeated_ranges: whole(d, n, segments))
    rows = suffix_rows()
    got = B.remove_repeats(documents(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == Counter(bytes_by_hand(rows, 400))


def test_two_stage_suffix_sorting():
    random = np.random.default_rng(1)
    for _ in range(100):
        segments = [bytes(random.choice([97, 98], random.integers(1, 30)).astype(np.uint8)) for _ in range(random.integers(1, 6))]
        joined = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
        text, order = joined.tobytes(), B.suffix_array(joined, 12).tolist()
        cut = [text[i:text.index(b"\0", i) + 1][:12] for i in order]
        assert sorted(order) == list(range(len(text))) and cut == sorted(cut)
        wanted = random.random(len(text)) < 0.3
        some = B.suffix_array(joined, 12, wanted).tolist()
        cut = [text[i:text.index(b"\0", i) + 1][:12] for i in some]
        assert sorted(some) == np.flatnonzero(wanted).tolist() and cut == sorted(cut)
        left, right = np.array(order[:-1]), np.array(order[1:])
        want = [next((k for k in range(9) if k == 9 or text[a + k:a + k + 1] != text[b + k:b + k + 1]), 9) for a, b in zip(order, order[1:])]
        assert np.minimum(B.common_prefixes(joined, left, right, 9), 9).tolist() == want


# -- word windows ----------------------------------------------------------------------

def words_by_hand(rows, size):
    """Rows in order of ``doc_id``, the one without it last; rows alike are one document."""
    first, result = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i:i + size])
            if first.setdefault(window, (doc, i)) != (doc, i):
                covered[i:i + size] = [True] * size
        result[doc, text] = (doc, len(words), sum(covered), sha(b" ".join(w for w, c in zip(words, covered) if not c)))
    return [result[r] for r in rows]


def two_letters(turns):
    """A word of 2^turns letters and its complement; sums of powers modulo 2^64 cannot tell them apart."""
    word = "a"
    for _ in range(turns):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_sums_of_powers_confuse():
    one, other = two_letters(12)
    for base in (W.BASES[0], W.BASES[1]):
        raw = np.frombuffer(f"{one} {other} {one} ab ba ab\0 ab".encode(), np.uint8)
        h = W.Words(raw, np.array([0, len(raw)])).hashes(base).tolist()
        assert h[0] == h[2] and len(set(h)) == 5 and h[3] == h[6]


@pytest.mark.parametrize("slots", [W.MIN_SLOTS, 1])
def test_substring_dedup(spark, monkeypatch, slots):
    if slots == 1:  # a sketch too small for its windows lets everything through and loses nothing
        monkeypatch.setattr(W, "BLOCK_SLOTS", 1024)
        monkeypatch.setattr(W, "sketch_slots", lambda size: 1024)
    one, other = two_letters(11)
    rest = prose(31, 19)
    rows = awkward() + [
        (40, prose(30, 25)), (40, prose(30, 25)), (41, f"{one} {rest}"), (42, f"{other} {rest}"), (43, prose(5, 20)),
        (44, "x y " * 40), (44, "x y " * 40), (45, prose(30, 25)[3:] + " " + prose(32, 30))]
    got = W.remove_repeats(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == Counter(words_by_hand(rows, 20))


# -- line templates --------------------------------------------------------------------

def lines_by_hand(rows, leading, least, constant):
    def tokens(line):
        return tuple(b"<*>" if any(48 <= c <= 57 for c in t) else t for t in line.split())

    docs = [(doc, [tokens(x) for x in (t or "").encode().split(b"\n")]) for doc, t in rows]
    holders: dict = {}
    for doc, lines in docs:
        for t in lines:
            if t and doc is not None:
                holders.setdefault(t, set()).add(doc)
    leaf = {t: (len(t),) for t in holders}
    for level in range(leading):
        below: dict = {}
        for t, who in holders.items():
            if len(t) > level:
                below.setdefault((leaf[t], t[level]), set()).update(who)
        # a rare token, and a field, go to the shared child
        leaf = {t: node if len(t) <= level else (*node, t[level] if t[level] != b"<*>" and len(below[node, t[level]]) >= least else None)
                for t, node in leaf.items()}
    reach: dict = {}
    for t, who in holders.items():
        reach.setdefault(leaf[t], set()).update(who)
    held = {t: who for t, who in holders.items() if len(reach[leaf[t]]) >= least}
    places: Counter = Counter()
    for t, who in held.items():
        for i, token in enumerate(t):
            places[leaf[t], i, token] += len(who)
    template = {}
    for t in held:
        shape = tuple(x if places[leaf[t], i, x] >= least else None for i, x in enumerate(t))
        template[t] = (leaf[t], shape) if sum(x is not None for x in shape) >= constant * len(t) else t
    who_has: dict = {}
    for t, who in held.items():
        who_has.setdefault(template[t], set()).update(who)
    for (doc, lines), (_, text) in zip(docs, rows):
        raw = (text or "").encode().split(b"\n")
        kept = [x for x, t in zip(raw, lines) if len(who_has.get(template.get(t), ())) < least]
        yield doc, len(raw), len(raw) - len(kept), sha(b"\n".join(kept))


def test_line_dedup(spark):
    rows = awkward() + [
        (40 + i, f"user {name} logged in at 10:{i}\nown line {prose(i + 70, 6)}\n\nshared words stand here") for i, name in
        enumerate(["ann", "bob", "cy", "di", "ed", "flo"])]
    got = L.drop_recurring_lines(documents(spark, rows), 1, 4).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    want = Counter(lines_by_hand(rows, 1, 4, 0.5))
    assert Counter(tuple(r) for r in got) == want
    assert all(r.n_dropped == 2 for r in got if r.doc_id and r.doc_id >= 40)


def line_rows():
    """Lines over few words, so that leaves, constant tokens and templates come about in many ways."""
    random = np.random.default_rng(5)
    words = "a b c d e f g h q1 7 <*> \u00e9".split()
    lines = [" ".join(random.choice(words, random.integers(1, 7))) for _ in range(60)]
    rows = []
    for doc in range(70):
        own = [str(x) for x in random.choice(lines, 4)] + [f"{random.choice(words[:3])} saw {prose(doc, 1)} at {doc} \t today", "", " \x0b"]
        random.shuffle(own)
        rows.append((doc + 100, "\n".join(own) + "\n" * int(random.integers(0, 3))))
    return awkward() + rows + [rows[3], rows[4], (None, rows[5][1]), (None, "\n".join(lines))]


@pytest.mark.parametrize("leading,least,slots,sent", [(3, 10, None, 0), (3, 4, None, 99999), (2, 6, 1024, 1), (0, 10, 1024, 99999)])
def test_line_dedup_tree_with_shared_children(spark, monkeypatch, leading, least, slots, sent):
    # lines beyond those that may be sent everywhere are found by a join, with the same result
    if slots:  # a sketch too small for its tokens lets everything through and changes nothing
        monkeypatch.setattr(L, "BLOCK_SLOTS", slots)
        monkeypatch.setattr(L, "sketch_slots", lambda size: 1024)
    rows = line_rows()
    found = L.drop_recurring_lines(documents(spark, rows), leading, least, max_sent_lines=sent)
    got = found.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == Counter(lines_by_hand(rows, leading, least, 0.5))
    assert any(r.n_dropped for r in got)


def test_line_dedup_with_a_variable_leading_token_and_the_querys_own_parameters(spark, tmp_path):
    rows = awkward() + [(40 + i, f"user {prose(i + 300, 1)}q{'abcdefghijkl'[i]} logged in at 10:{i}\nown words {prose(i + 70, 6)}") for i in range(12)]
    rows += [(60 + i, f"{'abcdefghijkl'[i]}x came to see us today") for i in range(12)]
    rows += [(80 + i, f"seldom {'abcdefghijkl'[i]}y is what this line has") for i in range(9)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_line_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(r.n_dropped == (1 if r.doc_id and 40 <= r.doc_id < 72 else 0) for r in got)
