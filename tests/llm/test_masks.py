"""Masks of whole texts are those of their lines."""

from pyspark.sql import functions as F

from ephemera.llm import templates

TEXTS = ["a  b\t1 2\r\n  \n12 34\n\x0b x\x0cy 9 \n1\t\t2\n   3 é5\n\r", "", "\n\n", "7", "<*> 3\n<*>", " a1b22 \n\tx", "plain\nlines 5"]


def test_masks_of_a_text_are_those_of_its_lines(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    by_line = F.transform(F.split("text", "\n", -1), templates.masked)
    for whole, lines in df.select(templates.masks(templates.spaced(F.col("text"))), by_line).collect():
        assert whole == lines


def test_digits_are_sought_in_whole_texts(spark):
    df = spark.createDataFrame([(1, t) for t in TEXTS], "doc_id long, text string")
    plan = templates.lines_of(df, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]+") == 1 and "lambda" in plan
