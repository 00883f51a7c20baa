"""Spelling variants against a row-by-row statement; the gram bound against every edit."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from ledgermill.llm import spelling as S
from text_tables import awkward, documents

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def stated(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(ASCII_LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    vocab = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in vocab if one_edit(w, x)] for w in vocab}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best and vocab[best] >= 10 * vocab[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), k, len(near[w]), vocab[form[w]] if form[w] else None) for w, k in vocab.items()}


def edited(chosen, word, letters):
    at, kind = chosen.randrange(len(word) + 1), chosen.randrange(3)
    if kind == 0 or at == len(word):
        return word[:at] + chosen.choice(letters) + word[at:]
    return word[:at] + (chosen.choice(letters) if kind == 1 else "") + word[at + 1:]


def variant_texts(seed, letters, words):
    chosen = random.Random(seed)
    base = ["".join(chosen.choice(letters) for _ in range(chosen.randint(6, 12))) for _ in range(words)]
    base += [w[:4] + w for w in base[:5]] + ["a" * 9, "a" * 10, "ab" * 5, "ab" * 5 + "a"]
    texts = []
    for i in range(80):
        picked = [chosen.choice(base) for _ in range(40)]
        picked += [edited(chosen, chosen.choice(base), letters) for _ in range(6)]
        picked += [w.upper() for w in picked[:3]] + [base[0]] * 30 + ["é" * 3 + base[1], "è" + "é" * 2 + base[1]]
        texts.append((i, ", ".join(picked)))
    return texts


def test_groups_equal_the_statement(spark):
    for seed, letters in ((1, "abcdefghijklmnoé"), (2, "ab"), (3, "abcÀ÷×")):
        rows = awkward() + variant_texts(seed, letters, 40)
        got = S.group_variants(documents(spark, rows))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == stated(rows)


def test_chains_end_at_the_root(spark):
    rows = [(i, "wonderful " * 400 + "wonderfull " * 30 + "wonderfulll " * 2) for i in range(3)]
    found = {r.word: r for r in S.group_variants(documents(spark, rows)).collect()}
    assert {tuple(r) for r in found.values()} == stated(rows)
    assert found["wonderfulll"].form == "wonderfull" and found["wonderfulll"].root == "wonderful"


def test_empty_table(spark):
    assert S.group_variants(documents(spark, [])).collect() == []


def halves(word):
    return {(side, n, part) for n in {(len(word) - 1) // 2, len(word) // 2} for side, part in (("h", word[:n]), ("t", word[-n:]))}


def meet(word, other, frequent):
    """One of the two looks in a list that the other stands in, or has no list and looks by halves."""
    one, two = S.index_keys(word, frequent), S.index_keys(other, frequent)
    if not one or not two:
        return bool(halves(word) & halves(other))
    return bool({k for k, own in one if own} & {k for k, _ in two} or {k for k, own in two if own} & {k for k, _ in one})


def test_words_one_edit_apart_meet():
    """With few and with many frequent grams, on alphabets where almost all grams repeat."""
    chosen = random.Random(5)
    for letters in ("ab", "abcd", "abcdefghijklmnopqrstuvwxyz"):
        words = ["".join(chosen.choice(letters) for _ in range(chosen.randint(7, 14))) for _ in range(400)]
        counts = Counter()
        for word in words:
            s = S.START + word + S.END
            counts.update(s[p:p + q] for q in range(S.Q_MIN, S.Q_MAX + 1) for p in range(len(s) - q + 1))
        for limit in (0, 2, 8, 40, 10 ** 9):
            frequent = {g: n for g, n in counts.items() if n > limit}
            for word in words[:150]:
                for _ in range(8):
                    other = edited(chosen, word, letters)
                    if other != word and len(other) >= 7:
                        assert meet(word, other, frequent), (word, other, limit)


def test_words_without_lists_look_by_halves(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARED", (9, 12))
    rows = variant_texts(4, "abcdeé", 30)
    assert {tuple(r) for r in S.group_variants(documents(spark, rows)).collect()} == stated(rows)


def test_bound_holds_for_every_edit():
    chosen = random.Random(8)
    words = ["".join(chosen.choice("abc") for _ in range(chosen.randint(7, 10))) for _ in range(60)]
    counts = Counter()
    for word in words:
        s = S.START + word + S.END
        counts.update(s[p:p + q] for q in range(S.Q_MIN, S.Q_MAX + 1) for p in range(len(s) - q + 1))
    frequent = {g: n for g, n in counts.items() if n > 6}
    for word in words:
        s = S.START + word + S.END
        spans = S.decompose(s, frequent)
        most = S.most_affected(s, spans, frequent)
        for at in range(len(word) + 1):
            others = {word[:at] + c + word[at:] for c in "abcx"} | {word[:at] + word[at + 1:]}
            others |= {word[:at] + c + word[at + 1:] for c in "abcx"} if at < len(word) else set()
            for other in others - {word}:
                t = S.START + other + S.END
                kept = Counter((p, t[p:e]) for p, e in S.decompose(t, frequent))
                moved = Counter((len(t) - e, t[p:e]) for p, e in S.decompose(t, frequent))
                same = sum(1 for p, e in spans if (p, s[p:e]) in kept or (len(s) - e, s[p:e]) in moved)
                assert len(spans) - same <= most
