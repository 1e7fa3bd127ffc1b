"""Texts made to stall or break an operator."""

import random
import time

import pytest
from basketflow.llm.secret_scan import secret_spans
from basketflow.llm.token_counts import VOCABULARY, encode, load_encoding, section_token_counts


def test_runs_of_white_space_give_the_same_tokens():
    encoding, _ = load_encoding(VOCABULARY)
    draw = random.Random(4)
    blanks = " \t\n\r\x0b\x0c\x85\xa0 　"
    for _ in range(400):
        parts = [draw.choice(["a", "the", "9", "!?", "é", "\x1f", "​", "日本"]) * draw.randint(0, 3) for _ in range(6)]
        text = "".join(p + "".join(draw.choices(draw.choice([" ", "\n", " \n", blanks]), k=draw.randint(0, 9))) for p in parts)
        for long_run in (1, 2, 3, 5):
            assert encode(encoding, text, long_run) == encoding.encode_ordinary(text), repr(text)
    for text in (" " * 50_000, "\n" * 50_000 + "x", "x" + " \n" * 30_000 + "y"):
        assert encode(encoding, text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + " " * 2_000_000 + "b", "\t" * 1_500_000])
def test_millions_of_blanks_are_counted(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "two words")], "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in section_token_counts(docs).collect()}
    assert found[2] == 2 and found[1] > 1000


def test_millions_of_line_breaks_are_counted(spark):
    docs = spark.createDataFrame([(1, "\n" * 2_000_000)], "doc_id long, text string")
    counted = section_token_counts(docs).agg({"n_tokens": "sum", "section": "max"}).first()
    assert counted[0] == 1_000_000 or counted[1] == 1_000_000
    assert max(counted) == 1_999_999


@pytest.mark.parametrize("unit", ["eyJ", "AKIA", "password", "-----BEGIN", "xoxb-", "ghp_", "0123456789abcdef0123456789abcde ", "eyJa."])
def test_a_megabyte_of_beginnings_is_scanned_in_seconds(spark, unit):
    text = unit * (1_000_000 // len(unit))
    docs = spark.createDataFrame([(1, text), (2, "password=abcdefgh1")], "doc_id long, text string")
    secret_spans(docs.where("doc_id = 2")).collect()  # compiled
    begun = time.monotonic()
    found = {r["doc_id"]: r for r in secret_spans(docs).collect()}
    assert time.monotonic() - begun < 30
    assert found[2]["n_assign"] == 1 and len(found) == 2
