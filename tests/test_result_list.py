"""Result lists of copies that are tied in name and score."""

from quern.operators import catalog as C

SCHEMA = "filename string, date string, drafter string, category string, content string, score double"
HITS = [
    ("a b.pdf", "2024-01-02", "kim", "x", "old", 0.9),
    ("a b.pdf", "2024-03-02", "kim", "x", "new", 0.9),
    ("a b.pdf", None, "kim", "x", "undated", 0.9),
    ("a_b(1).pdf", "2024-09-02", "kim", "x", "newer but worse", 0.5),
    ("c.pdf", "2024-02-02", "lee", None, "two", 0.4),
    ("c.pdf", "2024-02-02", "lee", None, "one", 0.4),
    ("d.pdf", None, "lee", "y", None, None),
    ("d.pdf", None, "kim", "y", None, None),
]
WANTED = [("a b.pdf", 0.9, "new"), ("c.pdf", 0.4, "one"), ("d.pdf", None, "y | kim")]


def listed(spark, hits, parts):
    df = spark.createDataFrame(spark.sparkContext.parallelize(hits, parts), SCHEMA)
    return [tuple(r) for r in C.result_list(df).select("filename", "score", "snippet").collect()]


def test_tied_copies_do_not_hang_on_the_order_or_split_of_the_input(spark):
    for hits in (HITS, HITS[::-1], HITS[1::2] + HITS[::2]):
        for parts in (1, 3, 8):
            assert listed(spark, hits, parts) == WANTED
