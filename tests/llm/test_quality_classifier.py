"""The quality classifier against plain Python: features, gradient steps, scores."""

import math
from collections import Counter

import numpy as np
import xxhash
from basketflow.llm import quality_classifier as quality
from basketflow.llm.catalog import llm_queries

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def bucket(value):
    return 1 + (((value * 0x9E3779B97F4A7C15) & MASK) >> 32) % (quality.BUCKETS - 1)


def plain_features(text):
    """Every word with its n-grams, one by one; a word that repeats the one before counts apart."""
    words, found = text.encode().split(), Counter()
    for word in words:
        found[bucket(xxhash.xxh64_intdigest(word))] += 1
        codes = [10, *map(ord, word.decode()), 10]
        for n in quality.NGRAMS:
            for at in range(len(codes) - n + 1):
                value = n
                for code in codes[at : at + n]:
                    value = (value * 1000003 + code) & MASK
                found[bucket(value)] += 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    if again:
        found[0] = again * sum(found.values()) / len(words)
    return found


TEXTS = ["one two two ñandú", "", "a", "x x x x", "日本 \U0001f600 word's", "A a A", "end\nof\tline " * 40]


def test_features():
    for text in TEXTS:
        buckets, counts = quality.document_features(text.encode())
        wanted = plain_features(text)
        assert buckets.tolist() == sorted(wanted)
        assert np.allclose(counts, [wanted[b] for b in sorted(wanted)])


def loss(vectors, output, features, label):
    buckets, counts = features
    hidden = (counts / counts.sum()) @ vectors[buckets]
    scores = output @ hidden
    return math.log(np.exp(scores - scores[label]).sum())


def numeric(function, array, places, step=1e-6):
    found = np.zeros_like(array)
    for place in places:
        kept = array[place]
        array[place] = kept + step
        up = function()
        array[place] = kept - step
        found[place] = (up - function()) / (2 * step)
        array[place] = kept
    return found


def test_steps_follow_the_gradient(monkeypatch):
    """Three texts, one pass: each step is the finite difference of the log loss."""
    monkeypatch.setattr(quality, "EPOCHS", 1)
    documents = [quality.document_features(t.encode()) for t in ("good words here", "bad bad thing", "more good words")]
    labels = np.array([1, 0, 1])
    rng = np.random.default_rng(42)
    vectors = rng.uniform(-1, 1, (quality.BUCKETS, quality.DIMENSIONS)) / quality.DIMENSIONS
    output = np.zeros((2, quality.DIMENSIONS))
    for done, i in enumerate(rng.permutation(3)):
        rate = quality.RATE * (1 - done / 3)
        buckets = documents[i][0]

        def here(i=i):
            return loss(vectors, output, documents[i], labels[i])

        by_output = numeric(here, output, list(np.ndindex(output.shape)))
        by_vector = numeric(here, vectors, [(b, d) for b in buckets for d in range(quality.DIMENSIONS)])
        output -= rate * by_output
        vectors -= rate * 10 * by_vector
    found = quality.train(documents, labels)
    assert np.allclose(found[1], output, atol=1e-7)
    assert np.allclose(found[0], vectors, atol=1e-7)
    assert np.abs(output).max() > 1e-3


def test_calibration_fits_the_share():
    margins = np.repeat([-1.0, 1.0], 500)
    labels = np.concatenate([np.arange(500) % 10 == 0, np.arange(500) % 10 < 8]).astype(int)
    slope, offset = quality.calibrate(margins, labels)
    chance = 1 / (1 + np.exp(-(slope * np.array([-1.0, 1.0]) + offset)))
    assert np.allclose(chance, [0.1, 0.8], atol=0.01)


def test_query_scores_are_the_formula(spark, monkeypatch):
    """Every row's score from the model that was fitted, feature by feature."""
    models = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    found = {r.doc_id: r for r in llm_queries()["op5_quality_classifier"](spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    (model,) = models
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        counts = plain_features(text)
        if not text.split():
            wanted = model["empty"]
        else:
            margin = sum(model["weight"][b] * n for b, n in counts.items()) / sum(counts.values())
            wanted = 1 / (1 + math.exp(-(model["slope"] * margin + model["offset"])))
        assert math.isclose(found[i].score, wanted, rel_tol=1e-6), i
        assert found[i].predicted == (found[i].score >= 0.3)


def test_held_out_rows_are_told_apart(spark):
    """Labels of the held-out fold, on rows the fit has not seen, at the larger scale."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in llm_queries()["op5_quality_classifier"](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good = [r.score for r in rows if labels[r.doc_id] == 1]
    bad = [r.score for r in rows if labels[r.doc_id] == 0]
    assert len(good) > 5 and len(bad) > 5
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.9
