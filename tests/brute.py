"""Row-by-row statement of the matching rules, for small fixtures."""

from __future__ import annotations

import datetime as dt
import random
from difflib import SequenceMatcher

START = dt.datetime(2024, 1, 1)


def random_rows(n, seed, days=6, amounts=(100.0, 100.0, 100.01, 105.0, 110.0, 90.0, 95.5, -3.0, 0.0, 0.05)):
    r = random.Random(seed)
    return [
        (
            START + dt.timedelta(days=r.randrange(days), hours=r.choice([0, 0, 6])), r.choice(amounts), f"d{i}",
            r.choice([None, "", "ORD-1", "ORD1", "ORD-2", "XZ"]), f"f{r.randrange(2)}.csv", f"r{i}",
        )
        for i in range(n)
    ]


def similarity(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.5


def _order(rows):
    position = lambda r: (r[4], len(r[5]), r[5])
    first = {}
    for r in rows:
        key = (r[0], r[1], r[3] or "")
        first[key] = min(first.get(key, position(r)), position(r))
    return sorted(rows, key=lambda r: (r[0], first[r[0], r[1], r[3] or ""], position(r)))


def score(a, b, window, tol, partial):
    """None when B is no candidate, else (exact, score)."""
    if abs(b[0] - a[0]) > dt.timedelta(days=window):
        return None
    gap, base = abs(b[1] - a[1]), max(abs(a[1]), 1e-9)
    if gap > tol and gap / base > partial:
        return None
    days = abs(b[0] - a[0]).days
    when = 1.0 if days == 0 else 0.7 + 0.3 * (1 - days / max(window, 1)) if days <= window else 0.2
    return gap <= tol, 0.55 * (1 - min(gap / base, 1.0)) + 0.25 * when + 0.20 * similarity(a[3], b[3])


def best(a, rows, window, tol, partial):
    """The first best of ``rows`` in their order."""
    found = None
    for b in rows:
        s = score(a, b, window, tol, partial)
        if s is not None and (found is None or s > found[0]):
            found = (s, b)
    return found and found[1]


def exclusive(rows_a, rows_b, window=3, tol=0.01, partial=0.10):
    free, pairs = _order(rows_b), {}
    for a in _order(rows_a):
        b = best(a, free, window, tol, partial)
        if b is not None:
            pairs[a[5]] = b[5]
            free.remove(b)
    return pairs


def counts(rows_a, rows_b, window=3, partial=0.10):
    count_a, count_b = {r[5]: 0 for r in rows_a}, {r[5]: 0 for r in rows_b}
    for a in rows_a:
        for b in rows_b:
            near = abs(b[0] - a[0]) <= dt.timedelta(days=window)
            if near and abs(b[1] - a[1]) / max(abs(a[1]), 1e-9) <= partial:
                count_a[a[5]] += 1
                count_b[b[5]] += 1
    return count_a, count_b
