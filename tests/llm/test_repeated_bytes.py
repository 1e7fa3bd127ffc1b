"""Removal of repeated byte strings against a dictionary of all windows."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from basketflow.llm import repeated_bytes as rep
from basketflow.llm.catalog import llm_oracles, llm_queries

SIZE = rep.SIZE


def brute(rows):
    """``(id, text)`` in order of place -> id, number of bytes, spans and what is left."""
    seen, found = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - SIZE + 1):
            window = data[at : at + SIZE]
            if window in seen:
                covered[at : at + SIZE] = True
            seen.add(window)
        spans = int(np.count_nonzero(covered[1:] & ~covered[:-1]) + covered[0])
        kept = bytes(b for b, c in zip(data, covered, strict=False) if not c)
        found.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return found


def digests(frame):
    return sorted(
        (
            (r["doc_id"], r["n_bytes"], sum(r["stops"]) - sum(r["starts"]), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest())
            for r in frame.collect()
        ),
        key=str,
    )


def odd_texts(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefñ日", k=draw.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(draw.choices(words, k=draw.randint(10, 80))) for _ in range(6)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "b" * 500, "ab" * 400, "\0" * 150, "c" * 99 + "d" + "c" * 99]
    for _ in range(60):
        parts = [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(3)]
        parts.insert(draw.randint(0, 3), draw.choice(passages)[draw.randint(0, 20) :])
        texts.append(" ".join(parts))
    copies = [draw.choice(texts) or "" for _ in range(40)]
    texts += copies + [c[: len(c) // 2] + "X" + c[len(c) // 2 :] for c in copies[:20]]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize(
    ("seed", "together", "handed", "max_bitmap"),
    [(1, 8192, 1 << 16, 1 << 24), (2, 8192, 1 << 16, 0), (3, 1, 1 << 16, 1 << 24), (4, 4, 3, 1 << 24), (5, 8192, 1, 0)],
)
def test_equals_brute_force(spark, monkeypatch, seed, together, handed, max_bitmap):
    """Also with grams too frequent for one task, and with the wanted grams found by a join."""
    monkeypatch.setattr(rep, "TOGETHER", together)
    monkeypatch.setattr(rep, "HANDED", handed)
    rows = list(enumerate(odd_texts(seed)))
    docs = spark.createDataFrame([(*r, "?", 1) for r in rows], "doc_id long, text string, window string, th int")
    found = rep.remove_repeated_bytes(docs.repartition(5), max_bitmap=max_bitmap)
    wanted = brute(rows)
    assert digests(found) == sorted(wanted, key=str)
    assert sum(r[2] for r in wanted) > 10_000


def test_blocks_smaller_than_texts(spark, monkeypatch):
    monkeypatch.setattr(rep, "BLOCK", 256)
    monkeypatch.setattr(rep, "BUCKET", 50)
    rows = list(enumerate(odd_texts(9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(rep.remove_repeated_bytes(docs)) == sorted(brute(rows), key=str)


def test_query_on_whole_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    rows = sorted(zip(table["doc_id"], table["text"], strict=True))
    found = llm_queries()["op12_suffix_array_dedup"](spark, sf_dir)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(map(tuple, found.select(names).collect()))
    assert got == sorted(brute(rows))
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        assert got == sorted(base.execute(llm_oracles()["op12_suffix_array_dedup"]).fetchall())


def test_repeated_rows_shared_and_null_ids(spark):
    one, two = "first text of the id " * 9, "quite another text of it " * 9
    rows = [(4, one), (4, one), (4, one), (4, two), (None, two), (None, None), (4, "short"), (4, "short")]
    found = digests(rep.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id int, text string")))
    by_first = {(r[0], r[1], r[2]) for r in found}
    assert len(found) == len(rows)
    own = {t: brute([(0, t)])[0][2] for t in (one, two)}
    # The null id comes first, so it keeps what its text does not repeat itself.
    assert (None, len(two), own[two]) in by_first
    assert (4, len(two), len(two)) in by_first
    assert sorted(r[2] for r in found if r[1] == len(one)) == [own[one], len(one), len(one)]
    assert [r[2] for r in found if r[1] == 5] == [0, 0]


def test_long_run_of_one_byte(spark):
    rows = [(1, " " * 300_000), (2, " " * 300_000), (3, "x")]
    found = digests(rep.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(r[0], r[2], r[3]) for r in found] == [(1, 299_999, 1), (2, 300_000, 1), (3, 0, 0)]


def test_empty_table(spark):
    assert rep.remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_order():
    draw = np.random.default_rng(5)
    keys = draw.integers(0, 3, (500, 6)).astype(np.uint64)
    order, new, marked = rep.multikey_order(keys, np.arange(500), 2)
    rows = [tuple(keys[i]) for i in order]
    assert rows == sorted(map(tuple, keys))
    assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(500)]
    assert marked.tolist() == [i == 0 or rows[i][:2] != rows[i - 1][:2] for i in range(500)]
