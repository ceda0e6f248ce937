"""Cleaning takes time by the length of a text, however long its lines are."""

from time import monotonic

from pyspark.sql import functions as F

from quern.operators import cleaning as L


def test_long_lines(spark):
    rows = [(1, "word " * 40_000), (2, "a\r" + "x" * 200_000 + "menu_depth=3 y\nrest " + "y" * 60), (3, "z" * 70 + " " * 100_000 + "z \t\nmode=getPrint"), (4, "idx=1"), (5, None)]
    began = monotonic()
    got = dict(spark.createDataFrame(rows, "id int, text string").select("id", L.without_print_remains(F.col("text"))).collect())
    assert monotonic() - began < 30
    assert got == {1: ("word " * 40_000).strip(), 2: "rest " + "y" * 60, 3: rows[2][1][: -len(" \t\nmode=getPrint")], 4: "", 5: None}
