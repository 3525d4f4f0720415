"""Shapes joined on place, overlay and ring repair, against comparisons of all pairs and of many points."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ephemera.functions import geo, overlay
from ephemera.operators import spatial

GEOM = "id long, geom struct<gtype:string,pts:array<struct<x:double,y:double>>,starts:array<int>>"


def ring(*pts):
    return np.array([*pts, pts[0]], float)


def square(x, y, s):
    return ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))


def stars(rng, n=12):
    """A random closed ring of integer corners, that mostly crosses itself."""
    pts = rng.integers(0, n, (rng.integers(3, 9), 2)).astype(float)
    return np.vstack([pts, pts[:1]])


def test_overlay_of_random_rings_equals_looking_at_points():
    rng = np.random.default_rng(3)
    for _ in range(120):
        a, b, p = [stars(rng)], [stars(rng), stars(rng)], rng.uniform(0, 12, (800, 2))
        mended = overlay.repaired(a)
        assert (overlay.within_rings(p, mended) if mended else np.zeros(len(p), bool)).tolist() == overlay.within_rings(p, a).tolist()
        assert not mended or (overlay.area(mended) > 0 and not geo.tangled(mended) or overlay.area(overlay.repaired(mended)) == pytest.approx(overlay.area(mended)))
        both = overlay.common("POLYGON", a, "POLYGON", b)["POLYGON"]
        want = overlay.within_rings(p, a) & overlay.within_rings(p, b)
        assert (overlay.within_rings(p, both) if both else np.zeros(len(p), bool)).tolist() == want.tolist()
        if both:
            m = overlay.middle("POLYGON", both)[None]
            assert overlay.within_rings(m, a)[0] and overlay.within_rings(m, b)[0]


def test_lines_and_edges_in_common():
    said = lambda *args: {k: [p.tolist() for p in v] for k, v in overlay.common(*args).items() if v}
    line = lambda *p: [np.array(p, float)]
    assert said("LINESTRING", line((0, 0), (10, 0)), "LINESTRING", line((2, 0), (5, 0), (5, 5), (7, -5))) == {"LINESTRING": [[[2, 0], [5, 0]]], "POINT": [[[6, 0]]]}
    donut = [square(0, 0, 10), square(4, 1, 2)]
    assert said("LINESTRING", line((-5, 2), (15, 2)), "POLYGON", donut) == {"LINESTRING": [[[0, 2], [4, 2]], [[6, 2], [10, 2]]]}
    assert said("POLYGON", donut, "LINESTRING", line((-5, 10), (15, 10))) == {"LINESTRING": [[[0, 10], [10, 10]]]}
    assert said("POLYGON", [square(0, 0, 4)], "POLYGON", [square(4, 1, 4)]) == {"LINESTRING": [[[4, 1], [4, 4]]]}
    assert said("POLYGON", [square(0, 0, 4)], "POLYGON", [square(4, 4, 4)]) == {"POINT": [[[4, 4]]]}
    assert said("POINT", line((1, 1)), "POLYGON", [square(0, 0, 4)]) == {"POINT": [[[1, 1]]]} and said("POINT", line((9, 9)), "POLYGON", [square(0, 0, 4)]) == {}
    assert said("POLYGON", [square(0, 0, 9)], "POLYGON", [square(2, 2, 3)]) == {"POLYGON": [square(2, 2, 3).tolist()]}


def test_rings_are_repaired():
    bow = overlay.repaired([ring((0, 0), (2, 2), (2, 0), (0, 2))])
    assert sorted(r.tolist() for r in bow) == [[[0, 0], [1, 1], [0, 2], [0, 0]], [[1, 1], [2, 0], [2, 2], [1, 1]]]
    spike = overlay.repaired([ring((0, 0), (4, 0), (4, 4), (2, 4), (2, 9), (2, 4), (0, 4))])
    assert [r.tolist() for r in spike] == [square(0, 0, 4).tolist()]
    assert overlay.area(overlay.repaired([square(0, 0, 10), square(2, 2, 3)])) == 91 and overlay.area(overlay.repaired([square(0, 0, 10), square(0, 0, 10)])) == 0
    assert geo.made_valid("POLYGON", [square(0, 0, 4)])[0].tolist() == square(0, 0, 4).tolist() and len(geo.made_valid("POLYGON", [ring((0, 0), (2, 2), (2, 0), (0, 2))])) == 2
    assert geo.made_valid("POLYGON", [ring((0, 0), (1, 1), (2, 2))]) == []


def test_points_on_shapes():
    horseshoe = [ring((0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9))]
    m = overlay.middle("POLYGON", horseshoe)
    assert overlay.within_rings(m[None], horseshoe)[0]
    apart = [square(0, 0, 1), square(5, 8, 2)]
    assert overlay.within_rings(overlay.middle("POLYGON", apart)[None], apart)[0]
    assert overlay.middle("LINESTRING", [np.array([(0, 0), (5, 1), (9, 0)], float)]).tolist() == [5, 1]
    assert overlay.middle("POINT", [np.array([(0, 0)], float), np.array([(4, 4)], float), np.array([(9, 9)], float)]).tolist() == [4, 4]
    assert geo.surface_point("LINESTRING", [np.array([(0, 0), (4, 4)], float)], "LINESTRING", [np.array([(0, 4), (4, 0)], float)]).tolist() == [2, 2]
    assert geo.surface_point("POINT", [np.array([(0.0, 0)])], "POINT", [np.array([(1.0, 0)])]) is None


def shapes(spark, rng, n, spread, first=0):
    rows = []
    for i in range(n):
        x, y, s = *rng.uniform(0, spread, 2).tolist(), float(rng.choice([1, 3, 40]))
        kind, pts = [("POINT", [(x, y)]), ("LINESTRING", [(x, y), (x + s, y + s / 2), (x + s, y - s)]), ("POLYGON", square(x, y, s).tolist())][i % 3]
        rows.append((first + i, (kind, [{"x": a, "y": b} for a, b in pts], None)))
    return rows, spark.createDataFrame([*rows, (-1 - first, None), (-2 - first, ("POINT", [], None))], GEOM)


@pytest.mark.parametrize("capacity", [4, 64])
def test_joined_shapes_equal_all_pairs(spark, capacity):
    rng = np.random.default_rng(capacity)
    (a, left), (b, right) = shapes(spark, rng, 150, 200.0), shapes(spark, rng, 120, 200.0, 1000)
    # a third of a side lies at one place
    a += [(500 + i, a[2][1]) for i in range(70)]
    left = left.unionByName(spark.createDataFrame(a[150:], GEOM))
    parts = {i: (g[0], geo._parts(g[1], None)) for i, g in [*a, *b]}
    tests = {"intersects": lambda x, y: geo.meet(*x, *y), "within": lambda x, y: geo.contained(*x, *y), "near": lambda x, y: geo.shortest_line(*x, *y)[0] <= 5}
    for how, test in tests.items():
        want = sorted((i, j) for i, _ in a for j, _ in b if test(parts[i], parts[j]))
        got = sorted(map(tuple, spatial.join_shapes(left, right, how, distance=5.0, capacity=capacity).collect()))
        assert got == want and len(want) > 5, how


def test_cells_follow_the_crowd_and_each_pair_comes_once(spark):
    rng = np.random.default_rng(9)
    pts = np.vstack([rng.uniform(0, 1000, (300, 2)), 500 + rng.uniform(0, 0.5, (900, 2))])
    box = spark.createDataFrame([(i, float(x), float(y), float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x0 double, y0 double, x1 double, y1 double")
    cells, _ = spatial.leaves(box, box, 16)
    per = {(r["depth"], r["ix"], r["iy"]): r["count"] for r in cells.where("side = 0").groupBy("depth", "ix", "iy").count().collect()}
    assert max(per.values()) <= 16 and sum(per.values()) == 1200 and len({d for d, _, _ in per}) >= 3
    wide = box.selectExpr("id", "x0 - 3 AS x0", "y0 - 3 AS y0", "x1 + 3 AS x1", "y1 + 3 AS y1")
    got = spatial.near_boxes(box, wide, 16)
    assert got.count() == got.distinct().count() == int((np.abs(pts[:, None] - pts[None]).max(2) <= 3).sum())
    none = box.limit(0)
    assert spatial.near_boxes(box, none).count() == 0 and spatial.near_boxes(none, none).columns == ["a", "b"]
    same = box.selectExpr("id", "1D AS x0", "1D AS y0", "1D AS x1", "1D AS y1").limit(30)
    assert spatial.near_boxes(same, same, 4).count() == 900
    with pytest.raises(ValueError):
        spatial.join_shapes(box, box, "beside")


def test_middles_and_buffers_as_columns(spark):
    df = spark.createDataFrame([(1, ("LINESTRING", [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 2.0}], None)), (2, ("LINESTRING", [{"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 1.0}], None)), (3, ("POINT", [{"x": 7.0, "y": 8.0}], None))], GEOM)
    got = {r["id"]: tuple(r["m"]) for r in df.select("id", geo.midpoint(df["geom"]["pts"]).alias("m")).collect()}
    assert got == {1: (3.0, 0.0), 2: (1.0, 1.0), 3: (7.0, 8.0)}


def test_upright_boxes_points_and_lines_need_no_look_at_each_pair(spark, monkeypatch):
    """Crowded rectangles: their pairs were compared in Python one at a time, which only shapes of other kinds need."""
    rng = np.random.default_rng(5)
    kinds = ["POINT", "LINESTRING", "POLYGON", "POLYGON"]
    at = rng.integers(0, 12, (80, 2)).astype(float)  # whole numbers, so that many only touch
    forms = lambda x, y: [[(x, y)], [(x, y), (x + 3, y + 4), (x + 6, y + 2)], square(x, y, 4).tolist(), [(x, y + 4), (x + 4, y + 4), (x + 4, y), (x, y), (x, y + 4)]]
    rows = [(i, (kinds[i % 4], [{"x": a, "y": b} for a, b in forms(x, y)[i % 4]], None)) for i, (x, y) in enumerate(at.tolist())]
    left = spark.createDataFrame(rows, GEOM)
    right = left.where("id % 4 >= 2")
    parts = {i: (g[0], geo._parts(g[1], None)) for i, g in rows}
    said = {r["id"]: r["kind"] for r in spatial.boxes(left).collect()}
    assert [said[i] for i in range(4)] == [spatial.POINT, spatial.LINE, spatial.FULL, spatial.FULL]
    with monkeypatch.context() as m:
        m.setattr(geo, "intersects", lambda a, b: a["gtype"] == "none")  # no pair may be left for it
        met = sorted(map(tuple, spatial.join_shapes(left, right).collect()))
    assert met == sorted((i, j) for i in parts for j in parts if j % 4 >= 2 and geo.meet(*parts[i], *parts[j]))
    held = sorted(map(tuple, spatial.join_shapes(left, right, "within").collect()))
    assert held == sorted((i, j) for i in parts for j in parts if j % 4 >= 2 and geo.contained(*parts[i], *parts[j]))
    got = {(r["a"], r["b"]): r for r in spatial.shared(right, right).collect()}
    want = {(i, j): overlay.common(*parts[i], *parts[j]) for i in parts for j in parts if i % 4 >= 2 and j % 4 >= 2 and geo.meet(*parts[i], *parts[j])}
    assert got.keys() == want.keys()
    for k, w in want.items():
        kind = next(n for n in ("POLYGON", "LINESTRING", "POINT") if w[n])
        assert got[k]["part"]["gtype"] == kind and got[k]["inside"] == (kind == "POLYGON")
        if kind == "POLYGON":
            ring = np.array([tuple(p) for p in got[k]["part"]["pts"]])
            assert overlay.area([ring]) == pytest.approx(overlay.area(w[kind])) and tuple(got[k]["p"]) == pytest.approx(overlay.middle(kind, w[kind]).tolist())


@pytest.mark.parametrize("how", ["intersects", "within"])
def test_a_tally_equals_the_grouping_of_all_pairs(spark, how, monkeypatch):
    rng = random.Random(11)

    def point():
        return rng.randint(0, 400) / 4, rng.randint(0, 400) / 4

    def box(x, y, w, h):
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]

    def line(n):
        x, y = point()
        return [(x + rng.randint(-8, 8) / 4 * i, y + rng.randint(-8, 8) / 4 * i) for i in range(n)]

    left = [(i, "POINT", [point()]) for i in range(900)] + [(1000 + i, "LINESTRING", line(rng.choice([2, 3, 4, 6]))) for i in range(300)]
    left += [(2000 + i, "POLYGON", box(*point(), rng.choice([0.5, 3.0, 60.0]), rng.choice([0.25, 2.0, 30.0]))) for i in range(60)] + [(3000, "POLYGON", [(1.0, 1.0), (40.0, 1.0), (1.0, 40.0), (1.0, 1.0)]), (3001, None, None)]
    right = [(i, "POLYGON", box(*point(), rng.randint(1, 200) / 4, rng.randint(1, 200) / 4)) for i in range(40)] + [(50, "POLYGON", [(10.0, 10.0), (60.0, 10.0), (10.0, 60.0), (10.0, 10.0)]), (51, "POLYGON", box(-500.0, -500.0, 2000.0, 2000.0)), (52, None, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, g string, p array<struct<x:double,y:double>>").select("id", F.when(F.col("g").isNotNull(), F.struct(F.col("g").alias("gtype"), F.col("p").alias("pts"), F.lit(None).cast("array<int>").alias("starts"))).alias("geom"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("own"))
    l, r = frame(left), frame(right)
    joined = spatial.join_shapes(l, r, how, keep=("own",)).groupBy("b", "own").agg(F.count("*"), F.sum("a")).collect()
    plain = lambda rows: sorted(map(tuple, rows), key=repr)
    tallied = spatial.tally(l, r, how, by=("own",))
    assert plain(tallied.collect()) == plain(joined) and tallied.columns == ["b", "own", "n", "total"]
    # the corners of cells stand for what is inside
    assert "sign" in tallied._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(spatial, "CROWDED", 1)
    assert plain(spatial.tally(l, r, how, by=("own",)).collect()) == plain(joined)
    assert spatial.tally(l.limit(0), r, how).count() == 0


def test_what_boxes_share_is_told_by_their_sides_and_edges(spark):
    """Boxes that only touch have a line or a point in common; the others' common part is a box, made once for each pair."""
    rng = random.Random(4)
    rows = [(i, *(rng.randint(0, 30) / 2 for _ in range(2)), rng.choice([1e-5, 1.0, 2.0, 4.5]), rng.choice([1.0, 3.0])) for i in range(60)]
    sides = {i: (x, y, x + w, y + h) for i, x, y, w, h in rows}
    shapes = spark.createDataFrame([(i, ("POLYGON", [(a, b), (c, b), (c, d), (a, d), (a, b)], None)) for i, (a, b, c, d) in sides.items()], GEOM)
    want = {}
    for i, a in sides.items():
        for j, b in sides.items():
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if w >= 0 and h >= 0:
                want[i, j] = ("POLYGON" if w > 0 and h > 0 else "LINESTRING" if w > 0 or h > 0 else "POINT", w * h)
    found = spatial.shared(shapes, shapes)
    got = found.select("a", "b", "gtype", "area", "box", F.col("part")["gtype"].alias("made")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    assert all(r["gtype"] == r["made"] for r in got) and {r["gtype"] for r in got} >= {"POLYGON", "LINESTRING", "POINT"}
    # thin boxes are laid over each other, as rounding could decide about them
    wide = [r for r in got if min(min(s[2] - s[0], s[3] - s[1]) for s in (sides[r["a"]], sides[r["b"]])) > 1e-3]
    assert all(r["gtype"] == want[r["a"], r["b"]][0] and r["box"] == (r["gtype"] == "POLYGON") for r in wide)
    assert all(r["area"] == pytest.approx(want[r["a"], r["b"]][1]) for r in wide if r["box"])
    assert "transform" not in found.where("box").select("a", "b", "area", "inside")._jdf.queryExecution().executedPlan().toString()
