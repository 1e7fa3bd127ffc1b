"""What scoring looks up and leaves on disk."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from basketflow.llm import common, suffix_tree


def test_bitmap_passes_few_others(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 40_000)
    others = rng.integers(-(2**63), 2**63, 200_000)
    bits = suffix_tree.bitmap(spark.createDataFrame(pa.table({"key": keys})))
    assert suffix_tree.in_bitmap(bits, keys).all()
    assert suffix_tree.in_bitmap(bits, others).mean() < 0.015


def test_spent_tables_are_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "workspace", lambda spark, label: str(tmp_path / label))
    docs = spark.createDataFrame([(i, "a b c d " * 40 + f"word{i}") for i in range(40)], "doc_id long, text string")
    scored = suffix_tree.lm_scores(docs)
    left = {p.relative_to(tmp_path).parts[0] for p in Path(tmp_path).rglob("*.parquet")}
    assert {"word_counts", "level_1", "score_parts"} <= left
    assert not [name for name in left if name.startswith(("next_words", "cells_of"))]
    assert scored.count() == 40


def test_texts_taken_together(monkeypatch):
    """Groups of a few words, with empty texts and a memory that is often emptied."""
    monkeypatch.setattr(suffix_tree, "_TOGETHER", 4)
    monkeypatch.setattr(suffix_tree, "_FLUSH", 3)
    held = [None, "", "A b c", "d", " ", "a b c d e f g h i", "z", None]
    known = np.array([suffix_tree.word_hash(w) for w in (b"a", b"d")], np.int64)
    groups = list(suffix_tree.Lexicon(known).together(pa.array(held)))
    words = [(t or "").lower().split() for t in held]
    assert [n for g in groups for n in g.lengths.tolist()] == [len(w) for w in words]
    hashes = [h for w in words for h in [*(suffix_tree.word_hash(x.encode()) for x in w), suffix_tree.END_HASH]]
    assert np.concatenate([g.hashes for g in groups]).tolist() == hashes
    ranks = [{"a": 0, "d": 1}.get(x, -1) for w in words for x in [*w, None]]
    assert np.concatenate([g.ranks for g in groups]).tolist() == ranks
    assert [k for g in groups for k in g.left.tolist()] == [k for w in words for k in range(len(w), -1, -1)]
