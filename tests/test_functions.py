import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ephemera.functions import geo, similarity, text
from ephemera.operators import dictionary, log, metrics, resolve
from ephemera.streaming.state import windows_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(deadline=None)
@given(st.text("abc", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    assert similarity.common([a], [b])[0] == lcs(a, b)
    assert 0 <= similarity.ratio([a], [b])[0] <= 1
    assert similarity.partial_ratio([a], [b])[0] == similarity.partial_ratio([b], [a])[0]


def test_similarity_values():
    assert similarity.ratio(["oakline"], ["oakline"])[0] == 1
    assert similarity.partial_ratio(["donsk"], ["great donsk road"])[0] == 1
    assert similarity.weighted_ratio(["custmer"], ["customer"])[0] == pytest.approx(14 / 15)


def test_wkt():
    assert geo.parse_wkt("POINT(1 2)") == {"gtype": "POINT", "pts": [{"x": 1.0, "y": 2.0}], "starts": None}
    several = {"MULTIPOINT(1 1, 2 2)": [0, 1], "MULTIPOINT((1 1), (2 2))": [0, 1], "MULTILINESTRING((0 0, 1 1), (2 2, 3 3, 4 4))": [0, 2], "POLYGON((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))": [0, 4], "MULTIPOLYGON(((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1)), ((20 20, 21 20, 21 21, 20 20)))": [0, 4, 8]}
    for wkt, starts in several.items():
        assert geo.parse_wkt(wkt)["starts"] == starts and geo.parse_wkt(wkt)["gtype"] == wkt.partition("(")[0]
    assert geo.parse_wkt("polygon ((0 0, 4 0, 4 4, 0 0))")["gtype"] == "POLYGON"
    for bad in (None, "", "POINT(1)", "POINT(a b)", "LINESTRING(0 0)", "POLYGON((0 0, 1 1, 2 2))", "POLYGON((0 0, 4 0, 4 4))", "GEOMETRYCOLLECTION(POINT(1 1))", "POINT EMPTY", "MULTIPOINT()", "POINT(1 2) x", "POINT(nan 1)", "POINT(1 2"):
        assert geo.parse_wkt(bad) is None


def test_geometry():
    a, b = np.array([[0.0, 0], [10, 0]]), np.array([[5.0, -5], [5, 5]])
    assert geo.crossings([a], [b]).tolist() == [[5, 0]]
    assert geo.shortest_line("LINESTRING", [a], "POINT", [np.array([[5.0, 3]])])[0] == 3
    assert geo.locate(a, np.array([2.0, 7])) == (0.2, 7.0)
    assert geo.substring(a, 0.2, 0.5).tolist() == [[2, 0], [5, 0]]
    assert geo.substring(np.array([[0.0, 0], [0, 2], [6, 2]]), 0.5, 0.5).tolist() == [[2, 2]]
    ring = np.array([[0.0, 0], [4, 0], [4, 4], [0, 4], [0, 0]])
    assert geo.inside(np.array([1.0, 1]), [ring]) and not geo.inside(np.array([0.0, 1]), [ring]) and not geo.inside(np.array([5.0, 1]), [ring])
    assert geo.merged([a, np.array([[10.0, 0], [10, 5]])]).tolist() == [[0, 0], [10, 0], [10, 5]]
    assert geo.merged([a, np.array([[20.0, 0], [30, 5]])]) is None
    assert geo.made_valid("LINESTRING", [np.array([[0.0, 0], [0, 0]])]) == []
    assert geo.made_valid("POLYGON", [ring[:-1]])[0].tolist() == ring.tolist()


WITHIN = [
    ("LINESTRING(1 9, 9 9)", "POLYGON((0 0, 10 0, 10 10, 6 10, 6 3, 4 3, 4 10, 0 10, 0 0))", False),  # across a notch
    ("LINESTRING(1 1, 9 1)", "POLYGON((0 0, 10 0, 10 10, 6 10, 6 3, 4 3, 4 10, 0 10, 0 0))", True),
    ("LINESTRING(0 0, 10 0)", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))", False),  # on the edge altogether
    ("LINESTRING(0 0, 5 5)", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))", True),
    ("POINT(5 5)", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", False),
    ("POINT(3 3)", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", True),
    ("POLYGON((3 3, 7 3, 7 7, 3 7, 3 3))", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", False),
    ("POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", True),
    ("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))", True),
    ("MULTIPOINT(1 1, 21 21)", "MULTIPOLYGON(((0 0, 9 0, 9 9, 0 9, 0 0)), ((20 20, 30 20, 30 30, 20 30, 20 20)))", True),
    ("LINESTRING(1 1, 21 21)", "MULTIPOLYGON(((0 0, 9 0, 9 9, 0 9, 0 0)), ((20 20, 30 20, 30 30, 20 30, 20 20)))", False),
    ("POINT(5 0)", "LINESTRING(0 0, 10 0)", True), ("POINT(0 0)", "LINESTRING(0 0, 10 0)", False), ("POINT(5 1)", "LINESTRING(0 0, 10 0)", False),
    ("LINESTRING(2 0, 4 0)", "MULTILINESTRING((0 0, 10 0), (0 5, 5 5))", True), ("LINESTRING(8 0, 12 0)", "LINESTRING(0 0, 10 0)", False),
    ("POINT(1 1)", "POINT(1 1)", True), ("POINT(1 2)", "MULTIPOINT(1 1, 1 2)", True), ("POINT(1 2)", "POINT(1 1)", False),
]


def test_within(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in WITHIN], "a string, b string").select("a", "b", geo.from_wkt("a").alias("ga"), geo.from_wkt("b").alias("gb"))
    got = {(r["a"], r["b"]): r["w"] for r in df.select("a", "b", geo.within(F.col("ga"), F.col("gb")).alias("w")).collect()}
    assert got == {(a, b): w for a, b, w in WITHIN}


def test_lengths_and_geojson_of_several_parts(spark):
    df = spark.createDataFrame([("MULTILINESTRING((0 0, 3 4), (10 10, 10 12))",), ("POLYGON((0 0, 4 0, 4 3, 0 0), (1 1, 2 1, 2 2, 1 1))",), ("MULTIPOINT(1 2, 3 4)",)], "w string").select(geo.from_wkt("w").alias("g"))
    got = df.select(geo.length(F.col("g")).alias("l"), geo.geojson(F.col("g")).alias("j")).collect()
    assert [r["l"] for r in got] == [7.0, 0.0, 0.0]
    assert [r["j"] for r in got] == [
        '{"type":"MultiLineString","coordinates":[[[0.0,0.0],[3.0,4.0]],[[10.0,10.0],[10.0,12.0]]]}',
        '{"type":"Polygon","coordinates":[[[0.0,0.0],[4.0,0.0],[4.0,3.0],[0.0,0.0]],[[1.0,1.0],[2.0,1.0],[2.0,2.0],[1.0,1.0]]]}',
        '{"type":"MultiPoint","coordinates":[[1.0,2.0],[3.0,4.0]]}',
    ]


def test_mercator_round_trip(spark):
    p = spark.createDataFrame([(30.5, 46.4)], "lon double, lat double").select(geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"))
    r = p.select(geo.longitude(F.col("x")).alias("lon"), geo.latitude(F.col("y")).alias("lat")).first()
    assert math.isclose(r["lon"], 30.5) and math.isclose(r["lat"], 46.4)


def test_tokens(spark):
    df = spark.createDataFrame([("5 th Avenue, 7th km 10April",), ("",), (None,), ("a_b 3-rd",)], "t string")
    got = [r[0] for r in df.select(text.tokens(F.col("t"))).collect()]
    assert got == [["5th", "Avenue", "7th", "km", "10", "April"], [], [], ["a", "b", "3rd"]]


def test_cleaning(spark):
    df = spark.createDataFrame([("<b>At 12:30</b> &amp; #Oak Hauptstrasse é. SUBSCRIBE now",), (None,)], "t string")
    light = [r[0] for r in df.select(text.clean_light(text.strip_tail(F.col("t")))).collect()]
    assert light == ["At & Oak Hauptstreet e.", ""]
    assert [r[0] for r in df.select(text.dedup_key(F.lit("a-b"))).collect()] == [None, None]


def test_repeats_chain(spark):
    rows = [(1, "abcd", 0.0), (2, "abcd", 1800.0), (3, "abcd", 3600.0), (4, "abcd", 5401.0), (5, None, 0.0), (6, None, 1.0)]
    df = spark.createDataFrame(rows, "message_id long, k string, at double")
    got = {r["message_id"]: r["duplicate"] for r in log.repeats_within(df, F.col("k"), "at").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_sync_twice_changes_nothing(spark):
    table = spark.createDataFrame([(1, ["Oak", "Oak St"], "street"), (2, ["Elm"], None)], "id long, names array<string>, type string")
    source = spark.createDataFrame([(1, ["Oak", "Old Oak"], "street"), (2, ["Elm"], "park"), (3, ["Ash", "A"], "park"), (4, ["Fir", "A"], "park")], "rn long, names array<string>, type string")
    once = dictionary.synchronised(table, source)
    rows = sorted((r["id"], r["names"], r["type"]) for r in once.collect())
    assert rows == [(1, ["Oak", "Oak St", "Old Oak"], "street"), (2, ["Elm"], "park"), (5, ["Ash", "A"], "park")]
    assert sorted((r["id"], r["names"], r["type"]) for r in dictionary.synchronised(once, source).collect()) == rows


def test_arbiter_cases(spark):
    pt = lambda x, y: ("POINT", [(float(x), float(y))], None)
    line = lambda *p: ("LINESTRING", [(float(x), float(y)) for x, y in p], None)
    box = ("POLYGON", [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0), (0.0, 0.0)], None)
    two = ("MULTILINESTRING", [(0.0, 2000.0), (500.0, 2000.0), (500.0, 2000.0), (1000.0, 2000.0)], [0, 2])
    places = [
        (1, "a", "street", line((0, 0), (1000, 0))), (2, "b", "street", line((300, -100), (300, 100))), (3, "c", "street", line((700, -100), (700, 100))),
        (4, "d", "park", pt(5000, 5000)), (5, "e", "park", pt(5099, 5000)), (6, "f", "park", pt(5201, 5000)), (7, "g", "district", box), (8, "h", "park", pt(10, 10)), (9, "i", "park", pt(90, 90)), (10, "j", "street", two), (11, "k", "street", line((300, 1900), (300, 2100))), (12, "l", "street", line((700, 1900), (700, 2100))),
    ]
    places = spark.createDataFrame(places, "id long, name string, type string, geom struct<gtype: string, pts: array<struct<x: double, y: double>>, starts: array<int>>")
    cases = {
        1: [(4, 0.9)], 2: [(1, 0.9), (2, 0.9), (3, 0.9)], 3: [(1, 0.9), (2, 0.8)], 4: [(4, 0.9), (5, 0.8)], 5: [(5, 0.9), (6, 0.8)], 6: [(4, 0.7)], 7: [(7, 0.9)], 8: [(7, 0.9), (8, 0.8), (9, 0.95)], 10: [(10, 0.9), (11, 0.9), (12, 0.9)],
    }
    rows = [(m, g, s, f"t{g}") for m, c in cases.items() for g, s in c]
    out = resolve.resolve(spark.createDataFrame(rows, "msg_id long, geo_id long, score double, text string"), places, spark.createDataFrame([(m,) for m in [*cases, 9]], "msg_id long"))
    got = {r["msg_id"]: r for r in out.collect()}
    assert [(m, got[m]["strategy"]) for m in sorted(got)] == [(1, "single_match"), (2, "street_segment"), (3, "intersection"), (4, "weighted_centroid"), (5, "single_match"), (6, "random_null"), (7, "random_null"), (8, "single_match"), (9, "random_null"), (10, "street_segment")]
    assert [(p["x"], p["y"]) for p in got[10]["geom"]["pts"]] == [(pytest.approx(300), 2000), (500, 2000), (pytest.approx(700), 2000)] and got[10]["geo_id"] == 10
    assert [(p["x"], p["y"]) for p in got[2]["geom"]["pts"]] == [(pytest.approx(300), 0), (pytest.approx(700), 0)] and got[2]["geo_id"] == 1
    assert (got[3]["geom"]["pts"][0]["x"], got[3]["confidence"]) == (300, pytest.approx(0.85))
    assert got[4]["geom"]["pts"][0]["x"] == 5049.5
    assert [got[m]["reason"] for m in (6, 7, 9)] == ["no_valid_candidates", "district_only", "no_candidates"]
    assert got[8]["geo_id"] == 8


def test_requests_are_checked():
    assert log.checked_request(60, 100, 5, ["a", "b", "a"], ["a", "b"]) == {"minutes": 60, "limit": 100, "after_id": 5, "layers": ["a", "b"]}
    for bad in ({"minutes": -1}, {"minutes": 1441}, {"limit": 0}, {"limit": 5001}, {"after_id": -1}, {"layers": ["c"], "known": ["a"]}, {"layers": [""]}):
        with pytest.raises(ValueError):
            log.checked_request(**bad)


@settings(deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 20), st.integers(0, 40))
def test_fixed_windows_in_two_parts(times, window, cut):
    """The places in windows do not depend on how the requests are dealt over batches."""
    at, want, start, n = np.array(sorted(times), float), [], None, 0
    for t in at.tolist():
        start, n = (t, 1) if start is None or t - start > window else (start, n + 1)
        want.append(n)
    a, s, k = windows_of(at[:cut], None, 0, window)
    b, _, _ = windows_of(at[cut:], s, k, window)
    assert [*a, *b] == want


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), max_size=40), st.integers(1, 3), st.integers(1, 10), st.integers(1, 7))
def test_sliding_limits_whatever_the_batches(rows, limit, window, size):
    rows = sorted(rows)
    want, kept = {}, {}
    for key, at in rows:
        inside = [t for t in kept.get(key, []) if at - t < window]
        n, passed = want.get(key, (0, 0))
        want[key] = n + 1, passed + (len(inside) < limit)
        kept[key] = [*inside, at] if len(inside) < limit else inside

    def judge():
        seen = []

        def step(at):
            n = 0
            for t in at.tolist():
                if sum(t - s < window for s in seen) < limit:
                    seen.append(t)
                    n += 1
            return n

        return step

    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + size]], pa.string()), pa.array([float(r[1]) for r in rows[i : i + size]])], ["key", "at"]) for i in range(0, len(rows), size)]
    out = [r for b in metrics._judged(judge, iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {k: (n, p) for k, n, p in out} == want and len(out) == len(want)


def test_streams_let_rows_without_a_key_pass_by(spark):
    from ephemera.streaming import sink, state

    rows = [(i, None if i % 2 else "k", float(i)) for i in range(30)]
    stream = sink.in_order(spark, spark.createDataFrame(rows, "message_id long, key string, at double"), "at")
    state.with_state_store(spark)
    out = sink.run_to_table(spark, state.sliding_repeats(stream, 2), "nulls").collect()
    assert {r["message_id"]: r["duplicate"] for r in out} == {i: i % 2 == 0 and i > 0 for i in range(30)} and len({r["batch"] for r in out}) == 3
