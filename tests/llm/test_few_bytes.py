"""How texts are cut into words, and how little is sent of what is counted and sought."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from basketflow.llm import suffix_tree
from basketflow.llm.common import texts, words


def test_cut_finds_the_words(monkeypatch):
    odd = [f" a{chr(c)}B\t{chr(c)}" for c in [*range(0x300), 0x1680, 0x2028, 0x3000, 0xFEFF]]
    column = pa.array([None, "", " \n", "x", *odd, "É Àb \x1c\x1f c", None])
    wanted = [[suffix_tree.word_hash(w) for w in words(t)] for t in texts(column)]
    for size, kind in ((1, pa.string()), (7, pa.large_string()), (1 << 21, pa.string())):
        monkeypatch.setattr(suffix_tree, "_CUT", size)
        for skipped in (0, 5):
            some = list(suffix_tree.cut(column.cast(kind).slice(skipped)))
            found = [h for hashes, of, _ in some for h in hashes[of].tolist()]
            lengths = [n for _, _, each in some for n in each.tolist()]
            assert lengths == [len(w) for w in wanted[skipped:]]
            assert found == [h for w in wanted[skipped:] for h in w]


def test_packed_columns_come_back():
    columns = [np.array([3, -(2**63), 2**63 - 1]), np.zeros(0, np.int32), np.array([0.1, -np.inf]), np.array([-1], np.int8)]
    kinds = [c.dtype.type for c in columns]
    assert [c.tolist() for c in suffix_tree.unpacked(suffix_tree.packed(*columns), *kinds)] == [c.tolist() for c in columns]


def _cells(known, depths, text, buckets=4):
    bits = np.full(1 << 10, -1, np.int64).view(np.uint64)  # all pass
    often = np.sort(np.array([suffix_tree.word_hash(b"w1")]))
    shared = SimpleNamespace(value=(bits, often, np.array([2]), known))
    out = pa.Table.from_batches(list(suffix_tree._count_next(shared, depths, buckets, iter([pa.record_batch([text], ["text"])]))))
    found = []
    for bucket in range(buckets):
        group = out.filter(pa.compute.equal(out["bucket"], bucket))
        if len(group):
            found += [tuple(r.values()) for r in suffix_tree._paired(2, known, group).to_pylist()]
    return out, sorted(found, key=str)


def test_cells_take_few_bytes():
    """Less than a hash of 64 bits for each, with its context and count."""
    rng = np.random.default_rng(2)
    text = pa.array([" ".join(f"w{k}" for k in rng.zipf(1.3, 100) % 5000) for _ in range(400)])
    known = np.array([suffix_tree.word_hash(b"w%d" % k) for k in range(5000)])
    out, _ = _cells(known, [1], text)
    cells = sum(len(suffix_tree.unpacked(c, *suffix_tree._CELLS_OF)[-1]) for c in out["cells"].to_pylist())
    assert cells > 15_000
    assert out.nbytes < 8 * cells


def test_words_that_are_not_known_are_counted_alike():
    """Ranks and hashes stand for the same words, in contexts of all lengths."""
    rng = np.random.default_rng(4)
    text = pa.array([" ".join(f"w{k}" for k in rng.integers(12, size=60)) for _ in range(80)] + ["", None])
    hashes = np.array([suffix_tree.word_hash(b"w%d" % k) for k in range(12)])
    for depths in ([1], [2, 3]):
        some = [_cells(known, depths, text)[1] for known in (hashes, hashes[:5], np.zeros(0, np.int64))]
        assert some[0] and some[0] == some[1] == some[2]
        assert {row[0] for row in some[0]} == set(depths)
        for depth, context, parent, *_ in some[0]:
            if depth == 2:
                assert parent in hashes
            assert depth > 1 or context in hashes


def test_questions_take_few_bytes():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 4000, np.uint64) >> np.uint64(8))
    times, at = np.ones(4000, np.int32), np.arange(4000, dtype=np.int32) % 500
    sent = suffix_tree._question(keys.tobytes(), times.tobytes(), at.tobytes())
    assert len(sent) < 10 * len(keys)
    found = suffix_tree.unpacked(sent, np.uint64, np.int32, np.int32)
    assert np.cumsum(found[0], dtype=np.uint64).tolist() == keys.tolist()
    assert found[1].tolist() == times.tolist() and found[2].tolist() == at.tolist()


def test_buckets_for_looking_up_do_not_grow_past_their_tokens():
    per = suffix_tree._BUCKET
    tokens = [1, per, 63 * per, 100 * per, 1000 * per, 16000 * per]
    assert [suffix_tree.buckets_of(n) for n in tokens] == [1, 1, 63, 64, 250, 4000]
