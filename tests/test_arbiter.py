"""The arbiter over points, lines and regions against a plain version, message by message."""

import math
import random
from collections import defaultdict

from ephemera.operators import resolve
from ephemera.plans import geo_queries
from ephemera.sources import tables


def hypot(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1])


def foot(p, a, b):
    """The point of a segment that is nearest to p, and how far along it lies."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    f = 0.0 if not n else min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return (a[0] + f * dx, a[1] + f * dy), f


def sides(pts):
    return list(zip(pts, pts[1:], strict=False)) or [(pts[0], pts[0])]


def meeting(a, b):
    """Of the points that two vertex lists share the one nearest to their centre, the first in x, y order of equals; or None."""
    found = [v for v in a if any(hypot(v, foot(v, *s)[0]) < 1e-9 for s in sides(b))]
    found += [v for v in b if any(hypot(v, foot(v, *s)[0]) < 1e-9 for s in sides(a))]
    for p, p2 in sides(a):
        for q, q2 in sides(b):
            rx, ry, sx, sy = p2[0] - p[0], p2[1] - p[1], q2[0] - q[0], q2[1] - q[1]
            cross = rx * sy - ry * sx
            if cross:
                t = ((q[0] - p[0]) * sy - (q[1] - p[1]) * sx) / cross
                u = ((q[0] - p[0]) * ry - (q[1] - p[1]) * rx) / cross
                if 0 <= t <= 1 and 0 <= u <= 1:
                    found.append((p[0] + t * rx, p[1] + t * ry))
    once = []
    for p in sorted(found):
        if not any(hypot(p, q) < 1e-6 for q in once):
            once.append(p)
    if not once:
        return None
    centre = tuple(sum(p[k] for p in once) / len(once) for k in (0, 1))
    least = min(hypot(p, centre) for p in once)
    return next(p for p in once if hypot(p, centre) <= least * (1 + 1e-9))


def nearest(a, b):
    """Distance of two vertex lists and the middle of their shortest connecting line."""
    meet = meeting(a, b)
    if meet:
        return 0.0, meet
    ways = [(v, foot(v, *s)[0]) for v in a for s in sides(b)] + [(foot(v, *s)[0], v) for v in b for s in sides(a)]
    p, q = min(ways, key=lambda w: hypot(*w))
    return hypot(p, q), ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)


def run(pts):
    return sum(hypot(a, b) for a, b in sides(pts))


def located(line, p):
    """Fraction of a line's length at which it is nearest to p, and the distance."""
    best, before = None, 0.0
    for a, b in sides(line):
        q, f = foot(p, a, b)
        if best is None or hypot(p, q) < best[0]:
            best = hypot(p, q), (before + f * hypot(a, b)) / run(line)
        before += hypot(a, b)
    return best[1], best[0]


def middle(points):
    c = sum(x for x, _ in points) / len(points), sum(y for _, y in points) / len(points)
    return c, max(hypot(p, c) for p in points)


def in_box(pts, ring):
    (x0, y0), (x1, y1) = ring[0], ring[2]
    return all(x0 <= x <= x1 and y0 <= y <= y1 for x, y in pts) and any(x0 < x < x1 and y0 < y < y1 for x, y in pts)


def plain(rows, places, s):
    best = {}
    for geo_id, score, text in rows:
        if score >= s.threshold and geo_id in places and (geo_id not in best or (-score, text) < best[geo_id]):
            best[geo_id] = -score, text
    valid = sorted((k, g) for g, (k, _) in best.items())[: s.most]
    score = {g: -k for k, g in valid}
    if not score:
        return "random_null", "no_valid_candidates", None, 0.0, None, None, 0
    region = min((g for g in score if places[g][0] == s.mask), default=None)
    kept = [g for g in score if places[g][0] != s.mask and (region is None or in_box(places[g][2], places[region][2]))]
    if not kept:
        return "random_null", "district_only" if region is not None else "all_filtered_by_district", region, 0.0, None, None, 0
    pairs = {(a, b): nearest(places[a][2], places[b][2]) for a in kept for b in kept if a < b}
    near = defaultdict(set)
    for (a, b), (d, _) in pairs.items():
        if d <= s.buffer_m:
            near[a].add(b)
            near[b].add(a)
    members = {min(kept, key=lambda g: (-score[g], g))}
    for _ in range(3):
        members |= {b for a in members for b in near[a]}
    mean = sum(score[g] for g in members) / len(members)
    inner = {p: v for p, v in pairs.items() if set(p) <= members}
    meets = [m for a, b in inner if (m := meeting(places[a][2], places[b][2]))]
    ways = []
    for g in members:
        if places[g][1] == "LINESTRING":
            hits = [f for f, d in (located(places[g][2], m) for m in meets) if d <= s.buffer_m]
            if len(hits) >= 2:
                lo, hi = (max(0.001, min(0.999, f(hits))) for f in (min, max))
                at, cuts = 0.0, [0.0]
                for a, b in sides(places[g][2]):
                    at += hypot(a, b) / run(places[g][2])
                    cuts.append(at)
                ends = [point_at(places[g][2], lo), point_at(places[g][2], hi)]
                pts = ends[:1] if lo == hi else [ends[0], *(p for p, c in zip(places[g][2], cuts, strict=True) if lo < c < hi), ends[1]]
                ways.append((-5, -score[g] * 0.9, g, "street_segment", g, "LINESTRING", pts))
    if not ways and meets:
        c, spread = middle(meets)
        if spread <= 2 * s.buffer_m:
            ways.append((-4, -mean, 0, "intersection", None, "POINT", [c]))
    anchors = [m for d, m in inner.values() if d <= s.anchor_m]
    if not ways and not meets and anchors and len(members) >= 2:
        c, spread = middle(anchors)
        if spread <= s.scatter_m:
            ways.append((-3, -max(0.1, mean * 0.85 - min(0.3, spread * 0.0004)), 0, "weighted_centroid", None, "POINT", [c]))
    ways += [(-1, -score[g], g, "single_match", g, places[g][1], places[g][2]) for g in members]
    way = min(ways, key=lambda w: w[:3])
    strategy, geo_id, total, gtype, pts = way[3], way[4], -way[1], way[5], way[6]
    if any(score[g] >= s.far_score and nearest(pts, places[g][2])[0] > s.far_m for g in members):
        geo_id = min(members, key=lambda g: (-score[g], places[g][1] != "LINESTRING", -run(places[g][2]) if places[g][1] == "LINESTRING" else 0, g))
        strategy, total, gtype, pts = "single_match", score[geo_id], places[geo_id][1], places[geo_id][2]
    return strategy, None, geo_id, total, gtype, len(pts), len(members)


def point_at(line, fraction):
    left = fraction * run(line)
    for a, b in sides(line):
        step = hypot(a, b)
        if left <= step or (a, b) == sides(line)[-1]:
            f = left / step if step else 0
            return a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])
        left -= step


def test_shapes_equal_a_plain_arbiter(spark, sf):
    places = {r["id"]: (r["type"], r["geom"]["gtype"], [(p["x"], p["y"]) for p in r["geom"]["pts"]]) for r in geo_queries.line_places(spark, sf).collect()}
    rows = defaultdict(list)
    for r in tables.candidates(spark, sf).collect():
        rows[r["msg_id"]].append((r["geo_id"], r["score"], r["text"]))
    got = {r["msg_id"]: r for r in geo_queries.r_arbiter_shapes(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for msg_id, own in rows.items():
        strategy, reason, geo_id, total, gtype, n_points, n_members = plain(own, places, geo_queries.SETTINGS)
        r = got[msg_id]
        assert (r["strategy"], r["reason"], r["geo_id"], r["gtype"], r["n_points"] if r["gtype"] else None, r["n_members"]) == (strategy, reason, geo_id, gtype, n_points, n_members), msg_id
        assert abs(r["confidence"] - total) <= 0.0006, msg_id
    assert {r["strategy"] for r in got.values()} >= {"single_match", "weighted_centroid", "random_null"}


def test_crowded_streets_equal_a_plain_arbiter(spark):
    """Lines that cross one another, points on and beside them, and regions that hold some."""
    rng = random.Random(8)
    spot = lambda w=2000.0: (round(rng.uniform(0, w), 1), round(rng.uniform(0, w), 1))
    places = {}
    for i in range(60):
        kind = rng.choice(["LINESTRING", "LINESTRING", "POINT"])
        places[i] = rng.choice(["street", "park"]), kind, [spot() for _ in range(1 if kind == "POINT" else rng.randrange(2, 5))]
    for i in range(60, 66):
        (x, y), w = spot(1000), 1500.0
        places[i] = "district", "POLYGON", [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    places[66] = "park", "POINT", [(9000.0, 9000.0)]
    rows = {m: [(g, round(rng.uniform(0.7, 1), 2), f"t{g}") for g in rng.sample(sorted(places), rng.randrange(1, 6))] for m in range(400)}
    shape = "struct<gtype: string, pts: array<struct<x: double, y: double>>, starts: array<int>>"
    known = spark.createDataFrame([(i, str(i), t, (k, p, None)) for i, (t, k, p) in places.items()], f"id long, name string, type string, geom {shape}")
    asked = spark.createDataFrame([(m, *r) for m, own in rows.items() for r in own], "msg_id long, geo_id long, score double, text string")
    got = {r["msg_id"]: r for r in resolve.resolve(asked, known, s=geo_queries.SETTINGS).collect()}
    for m, own in rows.items():
        strategy, reason, geo_id, total, gtype, n_points, n_members = plain(own, places, geo_queries.SETTINGS)
        r = got[m]
        assert (r["strategy"], r["reason"], r["geo_id"], r["n_members"]) == (strategy, reason, geo_id, n_members), m
        assert abs(r["confidence"] - total) < 1e-6 and (r["geom"] is None) == (gtype is None), m
        assert gtype is None or (r["geom"]["gtype"], len(r["geom"]["pts"])) == (gtype, n_points), m
    assert {r["strategy"] for r in got.values()} == {"single_match", "street_segment", "intersection", "weighted_centroid", "random_null"}
