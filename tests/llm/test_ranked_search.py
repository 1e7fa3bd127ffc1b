"""Ranked search against SQL and plain Python, the treap against its grid."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from basketflow.llm import ranked_search as search
from basketflow.llm.catalog import llm_oracles, llm_queries

SF_DIR = "/root/testdata/sf0.01"
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scored = []
        for doc_id, c in counts:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort()
        found += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(scored[:k])]
    return found


def ranked(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_sql(spark):
    found = llm_queries()["op11_ranked_search"](spark, SF_DIR)
    with duckdb.connect() as base:
        for name in ("documents", "benchmark"):
            base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
        wanted = base.execute(llm_oracles()["op11_ranked_search"])
        names = [c[0] for c in wanted.description]
        assert sorted(names) == sorted(found.columns)
        rows = sorted(wanted.fetchall())
        (items,) = base.execute("SELECT count(*) FROM benchmark").fetchone()
    assert sorted(map(tuple, found.select(names).collect())) == rows
    assert len(rows) == items * 50


def odd_rows(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcñ日XY09", k=draw.randint(1, 4))) for _ in range(80)]
    texts = [None, "", " \t_-", "Ünï", "x" * 50_000, "a b " * 9000]
    texts += ["-_ ".join(draw.choices(words[: draw.randint(1, 80)], k=draw.randint(1, 60))) for _ in range(200)]
    texts += texts[10:40]  # ties
    docs = [(draw.randint(-50, 10**12), t) for t in texts] + [(7, "abc a"), (7, "abc a"), (None, "abc a"), (None, "a")]
    items = [(i, t) for i, t in enumerate(draw.sample([t for t in texts if t], 12))] + [(90, None), (91, "..."), (92, "nowhere123")]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "open_", "side"), [(1, 50, 256, 4096), (2, 3, 2, 16), (3, 1, 4, 64), (4, 7, 16, 128)])
def test_equals_brute_force(spark, monkeypatch, seed, k, open_, side):
    monkeypatch.setattr(search, "OPEN", open_)
    monkeypatch.setattr(search, "LEAST_SIDE", side)
    docs, items = odd_rows(seed)
    frame = spark.createDataFrame([(*d, "?", 0) for d in docs], "doc_id long, text string, terms string, n int").repartition(3)
    found = search.rank_documents(frame, spark.createDataFrame(items, "item_id int, text string"), k)
    assert ranked(found) == sorted(brute(docs, items, k), key=str)


def test_items_in_blocks_and_repeated_items(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 4)
    docs, items = odd_rows(5)
    items = items + items[:2]
    found = search.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), 5
    )
    assert ranked(found) == sorted(brute(docs, items, 5), key=str)


def test_empty_tables(spark):
    docs, items = odd_rows(6)
    full = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    none = [f.limit(0) for f in full]
    for pair in ((full[0], none[1]), (none[0], full[1]), none):
        assert search.rank_documents(*pair).collect() == []


def test_treap_survives_packing_and_finds_the_best():
    draw = np.random.default_rng(3)
    grid = np.where(draw.random((64, 64)) < 0.2, draw.integers(1, 1000, (64, 64)), 0)
    rows, columns = np.nonzero(grid)
    treap = search.Treap.unpack(search.Treap.of(rows, columns, grid[rows, columns], 6).pack())
    assert treap.maxima[0].tolist() == [grid.max()]
    for level, maxima in enumerate(treap.maxima):
        size = 64 >> level
        cells = grid.reshape(1 << level, size, 1 << level, size).max(axis=(1, 3))
        assert sorted(maxima.tolist()) == sorted(cells[cells > 0].tolist())
    for _ in range(20):
        asked = draw.choice(64, 5, replace=False)
        best = search.Best(4)
        best.names = np.arange(64)
        treap.best(asked, 64, best)
        sums = grid[asked].sum(axis=0)
        wanted = sorted((-s, c) for c, s in enumerate(sums.tolist()) if s)[:4]
        assert [(-s, c) for s, c in zip(best.scores.tolist(), best.keys.tolist(), strict=True)] == wanted


def test_pieces_do_not_cut_terms(monkeypatch):
    text = ("ab cd " * 50 + "x" * 300 + " ef").encode()
    whole = search.term_counts(text)
    monkeypatch.setattr(search, "PIECE", 7)
    assert search.term_counts(text) == whole
