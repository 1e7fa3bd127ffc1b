"""Every operator on nulls, empty and very long texts, ties, repeats, empty tables, odd columns."""

import pytest
from basketflow.llm.decontamination import contaminated, decontaminate
from basketflow.llm.pieces import decode_pieces, encode_pieces
from basketflow.llm.quality_classifier import quality_scores
from basketflow.llm.quality_rules import quality_filter, quality_verdicts
from basketflow.llm.secret_scan import redact_secrets, secret_spans
from basketflow.llm.sharding import shard_by_bytes
from basketflow.llm.simhash import simhash_dedup, simhash_groups
from basketflow.llm.suffix_tree import lm_scores
from basketflow.llm.token_counts import section_token_counts
from basketflow.llm.toxicity import toxicity_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", None, 0),
    (3, " \t\n", None, "a", 3),
    (4, "one two three four five", "en", "a", 23),
    (4, "one two three four five", "en", "a", 23),
    (4, "another text of this id", "en", "a", 23),
    (None, "a row without an id", "en", "a", 19),
    (5, LONG, "en", "a", len(LONG)),
    (6, "x" * 50_000, "en", "a", 50_000),
    (7, "日本語 ñandú \U0001f600 ▁", "ja", "b", 11),
]
EXTRA = ["spans", "row", "hits", "fp", "t", "key", "rules", "w", "x", "grp", "kept", "part", "label"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, None, 1), (5, 0, 1), (None, 1, 1), (99, 1, 0), (2, 7, None)], LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five"), (3, "...")], "item_id long, text string")


def operators(labels, items):
    return {
        "lm": lm_scores,
        "pieces": encode_pieces,
        "toxicity": lambda d: toxicity_scores(d, labels),
        "quality": lambda d: quality_scores(d, labels),
        "secrets": secret_spans,
        "rules": quality_verdicts,
        "simhash": simhash_groups,
        "shards": lambda d: shard_by_bytes(d, 24),
    }


NAMES = ["lm", "pieces", "toxicity", "quality", "secrets", "rules", "simhash", "shards"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each(odd, labels, items, name):
    found = operators(labels, items)[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    for column in found[0].__fields__:
        if column not in ("distance", "component_id", "doc_id", "lang", "source"):
            assert all(r[column] is not None for r in found), column


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, items, name):
    assert operators(labels, items)[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", ["simhash", "shards", "pieces", "secrets"])
def test_columns_with_clashing_names(odd, labels, items, name):
    extra = odd.selectExpr("*", *[f"'?' AS {c}" for c in EXTRA])
    plain = operators(labels, items)[name](odd)
    found = operators(labels, items)[name](extra)
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_filters_keep_all_columns(odd, items):
    extra = odd.selectExpr("*", *[f"'?' AS {c}" for c in EXTRA])
    for kept in (quality_filter(extra), simhash_dedup(extra), decontaminate(extra, items), redact_secrets(extra, length_col="n_chars")):
        assert kept.schema.names == extra.columns
        assert kept.count() <= len(ROWS)
    assert redact_secrets(extra).count() == len(ROWS)


def test_no_labels_no_items(spark, odd):
    nothing = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_scores(odd, nothing).collect()} == {0.5}
    assert {r.score for r in toxicity_scores(odd, nothing).collect()} == {0.5}
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(odd, none).count() == 0
    assert decontaminate(odd, none).count() == len(ROWS)


def test_null_and_repeated_items(odd, items):
    both = items.union(items)
    found = contaminated(odd, both).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(4, None)] * 4


def test_sections_of_odd_texts(spark, odd):
    found = section_token_counts(odd).collect()
    empty = [r for r in found if r.doc_id in (1, 2)]
    assert [(r.section, r.start, r.end, r.n_tokens) for r in empty] == [(0, 0, 0, 0)] * 2
    assert section_token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_come_back(odd):
    decoded = {str(r) for r in decode_pieces(encode_pieces(odd)).collect()}
    expected = odd.selectExpr("doc_id", "replace(coalesce(text, ''), '▁', ' ') AS text").collect()
    assert decoded == {str(r) for r in expected}
