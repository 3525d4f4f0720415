"""Synchronisation with repeated canonical names, watermarks in numbers, and cleaning rules by hand-made cases."""

import random

from pyspark.sql import functions as F

from ephemera.functions import text
from ephemera.operators import dictionary, log, reports

PLACES = "id long, names array<string>, type string"


def test_a_place_is_updated_once_whatever_the_source_repeats(spark):
    places = spark.createDataFrame([(1, ["A", "a1"], "park"), (2, ["B"], "park"), (3, ["A", "a2"], None)], PLACES)
    source = spark.createDataFrame([(10, ["A", "x"], "street"), (20, ["A", "y", "x"], "square"), (5, ["B", "z"], None), (30, ["C"], "lane"), (31, ["C", "c"], "road")], "rn long, names array<string>, type string")
    out = {r["id"]: (r["names"], r["type"]) for r in dictionary.synchronised(places, source).collect()}
    assert out.pop(1) == (["A", "a1", "x", "y"], "street") and out.pop(3) == (["A", "a2", "x", "y"], "street") and out.pop(2) == (["B", "z"], None)
    assert sorted(out.values()) == [(["C"], "lane")]
    again = dictionary.synchronised(dictionary.synchronised(places, source), source)
    assert sorted((r["names"], r["type"] or "") for r in again.collect()) == [(["A", "a1", "x", "y"], "street"), (["A", "a2", "x", "y"], "street"), (["B", "z"], ""), (["C", "c"], "lane")]


def test_a_healed_place_comes_once(spark):
    places = spark.createDataFrame([(1, ["A"], None, None), (2, ["B"], 3.0, 4.0), (3, ["D"], None, None)], "id long, names array<string>, lon double, lat double")
    source = spark.createDataFrame([(9, ["A"], 1.0, 2.0), (8, ["A"], None, 5.0), (10, ["A"], 7.0, 8.0), (1, ["B"], 9.0, 9.0)], "rn long, names array<string>, lon double, lat double")
    assert sorted((r["id"], r["lon"], r["lat"]) for r in dictionary.healed(places, source).collect()) == [(1, 1.0, 2.0), (2, 3.0, 4.0), (3, None, None)]


def test_many_marks_without_a_nested_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(500)) for i in range(3000)] + [(5000 + i, 250) for i in range(1500)]
    events = spark.createDataFrame(rows, "id long, message_id long")
    marks = spark.createDataFrame([(m,) for m in [*range(-3, 600), 7, 7]], "mark long")
    out = log.changes_after(events, marks)
    low, high = min(m for _, m in rows), max(m for _, m in rows)
    want = {m: (sum(x > m for _, x in rows), max((i for i, x in rows if x > m), default=None)) for m in range(-3, 600) if not (m > high or (low > 0 and m < low - 1))}
    assert {r["mark"]: (r["n"], r["last"]) for r in out.collect()} == {m: v for m, v in want.items() if v[0]}
    assert "Cartesian" not in out._jdf.queryExecution().toString()
    wide = spark.range(100_000).select((F.col("id") % 400).alias("mark"))
    assert log.changes_after(events, wide).count() == len({m for m in want if 0 <= m < 400 and want[m][0]})
    assert log.changes_after(events.limit(0), marks).count() == 0


def test_deliveries_by_one_equi_join(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, "*"), (4, None)], "id long, layer string")
    subscriptions = spark.createDataFrame([("all", []), ("b", ["b", "b"]), ("star", ["*"])], "subscriber string, layers array<string>")
    out = log.deliveries(events, subscriptions)
    assert sorted((r["subscriber"], r["id"]) for r in out.collect()) == [("all", 1), ("all", 2), ("all", 3), ("all", 4), ("b", 2), ("star", 3)]
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_busy_lock_counts_pairs(spark):
    rows = [(p, None, 1, 2, g) for p in (1, 2) for g in (True, False) for _ in range(30)] + [(3, 5, 1, 2, False), (4, 5, 1, 2, True)]
    out = reports.lock_graph(spark.createDataFrame(rows, "pid long, locked_rel long, rows long, shared_blks_read long, granted boolean"))
    assert sorted(map(tuple, out.collect())) == [(1, 2, 900), (2, 1, 900), (3, 4, 1)]


def test_cleaning_rules(spark):
    said = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert said(text.clean_light, "At 14:30 or 9.05, not 24:10, 99:99 or 12:60: c / P and P/o\\B") == "At or , not 24:10, 99:99 or 12:60: cp and pob"
    assert said(text.clean, "the c/p at 23.59 now") == "the cp at now"
    assert said(text.strip_tail, "Road closed \U0001f310 show Pin  on MAP \n") == "Road closed" and said(text.strip_tail, "show pin on map, then go") == "show pin on map, then go"
    assert said(text.strip_tail, "News subscribe now show pin on map") == "News" and said(text.strip_tail, None) == ""
    promo = lambda t: said(text.is_promotional, t)
    assert promo("see WWW.x.org") and promo("ask @some_user") and promo("a Limited \n offer") and not promo("mail me at joe@example") and not promo("an @abc") and not promo("plain") and promo(None) is False
    assert said(lambda c: text.is_promotional(c, phrases=("hello there",)), "Hello  there") is True
