"""Limits whose work spreads over tasks equal a fold over each client's requests."""

import random
from collections import Counter

from ephemera.operators import limits


def folded(times, window):
    """The place of each request in its window, in order of time."""
    out, start, n = [], None, 0
    for t in times:
        if start is None or t - start > window:
            start, n = t, 0
        n += 1
        out.append(n)
    return out


def made(rng, n):
    # one client has a third of all requests, many at one time
    rows = [(i, 7 if i % 3 == 0 else rng.randrange(20), rng.choice("abc"), float(rng.randrange(4000))) for i in range(n)]
    return [*rows, (n, None, "a", 1.0), (n + 1, 3, "a", None), (n + 2, 3, None, 5.0)]


SCHEMA = "id long, client long, path string, at double"


def test_places_equal_a_fold(spark):
    rows = made(random.Random(3), 900)
    out = limits.window_places(spark.createDataFrame(rows, SCHEMA), ["client"], "at", "id", 60)
    want = {}
    for c in {r[1] for r in rows if r[1] is not None}:
        own = sorted((r for r in rows if r[1] == c and r[3] is not None), key=lambda r: (r[3], r[0]))
        want |= dict(zip((r[0] for r in own), folded([r[3] for r in own], 60), strict=True))
    assert {r["id"]: r["window_place"] for r in out.collect()} == {r[0]: want.get(r[0]) for r in rows} and out.columns == ["id", "client", "path", "at", "window_place"]
    assert limits.window_places(spark.createDataFrame([], SCHEMA), ["client"], "at", "id", 60).count() == 0


def test_two_levels_equal_a_fold(spark):
    rows = made(random.Random(5), 500)
    out = limits.two_levels(spark.createDataFrame(rows, SCHEMA), "client", "path", "at", "id", (2, 100), (4, 300))
    verdict, overall, path = {}, {}, {}

    def place(held, key, t, window):
        start, n = held.get(key, (None, 0))
        held[key] = (t, 1) if start is None or t - start > window else (start, n + 1)
        return held[key][1]

    for i, c, p, t in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[0])):
        if c is not None and t is not None and place(overall, c, t, 300) > 4:
            verdict[i] = "overall"
        elif None not in (c, p, t) and place(path, (c, p), t, 100) > 2:
            verdict[i] = "path"
        else:
            verdict[i] = "passed"
    assert {r["id"]: r["verdict"] for r in out.collect()} == verdict and min(Counter(verdict.values()).values()) >= 5
