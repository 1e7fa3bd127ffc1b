"""The whole suffix tree against brute force."""

import math
import re
from collections import Counter

import numpy as np
from basketflow.llm import suffix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain_scores(texts, held):
    tokens = {i: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in texts.items()}
    words, following = Counter(), {}
    for i, found in tokens.items():
        if i in held:
            continue
        words.update([*found, None])
        for d in (1, 2, 3):
            for k in range(d, len(found) + 1):
                following.setdefault(tuple(found[k - d : k]), Counter())[(found + [None])[k]] += 1
    norm = sum(words.values()) + 0.1 * (len(words) + 1)
    tree = {}
    for c in sorted(following, key=len):
        n = following[c]
        total = sum(n.values())
        if total < 30 or (len(c) > 1 and c[1:] not in tree):
            continue
        up = following.get(c[1:])
        share = (lambda w: words[w] / norm + 0.1 / norm) if len(c) == 1 else (lambda w, up=up, t=sum(up.values()): up[w] / t)
        kept = {w: k for w, k in n.items() if k > 1}
        once = len(n) - len(kept)
        ratio = sum(k * math.log(k / total / share(w)) for w, k in kept.items())
        if once:
            ratio += once * math.log(once / total / (1 - sum(map(share, kept))))
        if ratio - (len(kept) + (once > 0)) * math.log(total) / 2 > 0:
            tree[c] = kept, total, once

    def p(c, w):
        if not c:
            return (words[w] + 0.1) / norm
        kept, total, once = tree[c]
        kinds = len(kept) + once
        return (kept.get(w, 0) + (kinds + once) * p(c[1:], w)) / (total + kinds)

    scores = {}
    for i, found in tokens.items():
        scores[i] = 0.0
        for k, w in enumerate([*found, None]):
            c = ()
            while len(c) < min(3, k) and tuple(found[k - len(c) - 1 : k]) in tree:
                c = tuple(found[k - len(c) - 1 : k])
            scores[i] += math.log10(p(c, w))
    return scores, tree


def test_extended_hashes_are_those_of_spark(spark):
    rows = [(5, -7), (-(2**63), 2**63 - 1), (0, 0), (123456789012345, -98765432109876)]
    found = spark.createDataFrame(rows, "a long, b long").selectExpr("xxhash64(a, b) AS h").collect()
    a, b = np.array(rows, np.int64).T.copy()
    assert [r.h for r in found] == suffix_tree.extend(a, b).tolist()


def test_scores_of_the_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "AT_HAND", 300)  # most of the tree is joined
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in suffix_tree.lm_scores(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    wanted, tree = plain_scores(texts, {i for i, r in found.items() if r.held_out})
    assert max(map(len, tree)) > 1
    for i, r in found.items():
        assert math.isclose(r.score, wanted[i], rel_tol=1e-7), i


def test_contexts_of_rarer_words_count(spark):
    """Pairs of words that rank below 256, each word seen 40 times, always in the same pair."""
    pairs = [f"left{i} right{i}" for i in range(600)]
    text = [(i, " ".join(pairs[i % 7 :] + pairs[: i % 7])) for i in range(60)]
    docs = spark.createDataFrame(text, "doc_id long, text string")
    for r in suffix_tree.lm_scores(docs).collect():
        assert r.score > 0.6 * r.base_score


def test_contexts_over_several_buckets(spark, monkeypatch):
    """Many buckets, many groups of texts, and contexts spread over several buckets give the same scores."""
    monkeypatch.setattr(suffix_tree, "AT_HAND", 100)
    monkeypatch.setattr(suffix_tree, "_BUCKET", 400)
    monkeypatch.setattr(suffix_tree, "_CELLS", 5_000)
    monkeypatch.setattr(suffix_tree, "KNOWN", 50)
    rng = np.random.default_rng(3)

    def text(n):
        found = [1, 2]
        while len(found) < n:
            found.append((3 * found[-1] + found[-2] + int(rng.integers(2))) % 15 if rng.random() < 0.9 else int(rng.integers(2000)))
        return " ".join(f"w{k}" for k in found)

    texts = {i: text(120) for i in range(150)} | {150: "", 151: "w1 " * 900}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_tree.lm_scores(docs).collect()}
    held = {i for i, r in found.items() if r.held_out}
    wanted, tree = plain_scores(texts, held)
    assert max(map(len, tree)) > 1
    words = {w for i, t in texts.items() if i not in held for w in t.split()}
    for i, r in found.items():
        assert math.isclose(r.score, wanted[i], rel_tol=1e-7), i
        assert r.n_known == 1 + sum(w in words for w in texts[i].split())


def test_frequent_contexts_are_spread(spark, monkeypatch):
    """No bucket has all that follows a word which makes up a third of the corpus."""
    monkeypatch.setattr(suffix_tree, "_BUCKET", 1_000)
    text = spark.createDataFrame([(" ".join(f"the w{(i * 97 + k) % 800} x{k % 7}" for k in range(100)),) for i in range(60)], "text string")
    known, counts = suffix_tree.count_words(text)
    candidates = counts.where("c >= 30").selectExpr("h AS context", "c AS n")
    counted, _ = suffix_tree._counted(text, candidates, [1], 30, known.train_tokens)
    cells = counted.where(f"context = {suffix_tree.word_hash(b'the')}L").collect()
    assert sum(r.n for r in cells) == 6000
    assert sum(r.next is None for r in cells) != 1 and len({r.next for r in cells if r.next}) == 800


def test_no_row_for_each_run(spark, monkeypatch):
    """What is not at hand is asked for once by a group of texts, and not joined run by run."""
    monkeypatch.setattr(suffix_tree, "AT_HAND", 0)
    docs = spark.createDataFrame([(i, "a b c d " * 40) for i in range(40)], "doc_id long, text string")
    plan = suffix_tree.lm_scores(docs)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan
    keys, times, at = np.repeat([5, -7], 300), 300, np.tile(np.arange(300, dtype=np.int32), 2)
    rows = list(suffix_tree._asked(0, [(keys, at)], 1))
    assert len(rows) == 1 and np.frombuffer(rows[0][2], np.int64).tolist() == [5, -7]
    assert np.frombuffer(rows[0][3], np.int32).tolist() == [times, times]


def test_buckets_are_those_of_sql(spark):
    keys = np.random.default_rng(5).integers(-(2**63), 2**63, 1000)
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long").selectExpr(suffix_tree.in_bucket("key", 37))
    assert [r.bucket for r in frame.collect()] == suffix_tree.bucket_of(keys, 37).tolist()
