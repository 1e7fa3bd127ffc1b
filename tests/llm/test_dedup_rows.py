"""Which rows the near-duplicate stage keeps, exactly."""

from basketflow.llm.simhash import simhash_dedup
from pyspark.sql import functions as F


def some_text(name):
    return " ".join(f"{name}{i}" for i in range(40))


def test_one_row_of_each_group(spark):
    a, b, c, d, e, f = map(some_text, "abcdef")
    rows = [
        (1, a), (1, a), (2, a), (None, a),  # repeated rows
        (3, b), (4, b), (3, c),  # an id shared by two groups
        (None, d), (None, d), (None, e),  # groups of null ids only
        (5, f), (5, f.upper()), (5, f.title()),  # one id and fingerprint, different texts
        (6, None), (6, ""), (7, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sums = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    expected = [
        (1, a), (3, b), (3, c), (None, d), (None, e),
        (5, min(f, f.upper(), f.title(), key=sums.get)), (6, min(None, "", key=sums.get)),
    ]
    found = [tuple(r) for r in simhash_dedup(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
