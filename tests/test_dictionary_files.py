"""Files of the dictionary are read with as few Python workers as may be."""

from ephemera.sources import files


def test_well_known_text_is_read_once_a_row(spark, tmp_path):
    rows = [(1, "a| b ||c", "MULTIPOINT((1 2), (0 0))", "x"), (2, "d", "POINT(broken", "y"), (3, "e", None, "x"), (4, "f", "POINT(3 4)", None)]
    spark.createDataFrame(rows, files.DICTIONARY).write.option("header", True).csv(f"{tmp_path}/d")
    read = files.read_dictionary(spark, f"{tmp_path}/d")
    assert sorted((r["id"], r["names"], r["type"], r["geom"]["gtype"], r["geom"]["pts"][0]["x"]) for r in read.collect()) == [(1, ["a", "b", "c"], "x", "MULTIPOINT", 1.0), (4, ["f"], None, "POINT", 3.0)]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
