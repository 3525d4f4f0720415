"""Tables that small files unfold to are never gathered on the driver."""

from pyspark.sql import functions as F

from ephemera.operators import dictionary as dic
from ephemera.operators import match as m
from ephemera.operators.lineage import cut, large


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_index_is_broadcast(spark):
    places = spark.range(50).selectExpr("id", "array(concat('Oak', id, ' Lane'), concat('oak ', id)) AS names", "'street' AS type")
    index = dic.aliases(places)
    found = m.surfaces(spark.range(60).selectExpr("concat('lane oak', id) AS surface"))
    for tier in (m.exact(found, index), m.reordered(found, index), m.known_surfaces(found, index)):
        assert "Broadcast" not in _plan(tier)
    kept = large(cut(index.select("geo_id", "alias")))
    assert "Broadcast" not in _plan(kept.where(F.col("geo_id") > 3).join(kept.select("geo_id").distinct(), "geo_id"))
    assert m.reordered(found, index).count() == 50


def test_stems_are_worked_out_once(spark):
    """A condition on the stems doubled the work of the alias index."""
    index = dic.aliases(spark.range(5).selectExpr("id", "array(concat('Oak', id, ' Lanes'), '...') AS names"))
    lines = [line for line in _plan(index).splitlines() if "regexp_extract_all" in line]
    assert len(lines) == 1 and "Filter" not in lines[0]
    assert sorted((r["alias"], r["key"]) for r in index.collect()) == [(f"oak{i} lanes", f"oak{i} lan") for i in range(5)]
