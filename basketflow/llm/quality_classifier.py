"""Text classification by subword embeddings, trained with numpy."""

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import map_batches, texts
from basketflow.llm.suffix_tree import held_out

#: Rows of the embedding table; features share them by hash.
BUCKETS = 1 << 16
DIMENSIONS = 12
#: Characters of an n-gram.
NGRAMS = (2, 3, 4)
#: Labelled rows that the model is fitted on, at most; those of the smallest id hashes.
MAX_EXAMPLES = 6000
#: Whole texts are averaged; of so many different features, drawn for each text, a training
#: step sees the average. Only the noise of the steps depends on it.
DRAWN = 600
EPOCHS, RATE = 12, 1.0
#: Marks a word that repeats the one before it, the one word pair that needs no vocabulary.
_AGAIN = 0
_REMEMBERED = 300_000


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return 1 + ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % (BUCKETS - 1)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of many words, and the word that each belongs to.

    A word has itself, as written, and its character n-grams with its ends marked.
    """
    whole = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    joined = b"\n" + b"\n".join(words) + b"\n"  # no word has a line break: it marks the ends
    codes = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(codes == 10)
    found, owners = [_bucket(whole)], [np.arange(len(words))]
    for n in NGRAMS:
        places = len(codes) - n + 1
        if places <= 0:
            continue
        hashes = np.full(places, n, np.uint64)
        for k in range(n):
            hashes = hashes * np.uint64(1000003) + codes[k : places + k]
        inside = np.flatnonzero(ends[n - 2 : places + n - 2] == ends[:places])
        found.append(_bucket(hashes[inside]))
        owners.append(ends[inside] - 1)
    return np.concatenate(found), np.concatenate(owners)


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a whole text and how often each occurs."""
    words = text.split()
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    total = np.zeros(BUCKETS)
    if counts:
        buckets, owners = word_features(list(counts))
        total = np.bincount(buckets, np.fromiter(counts.values(), float, len(counts))[owners], BUCKETS)
    # A repetition weighs as much as a word with its n-grams.
    total[_AGAIN] = again * (total.sum() / max(1, len(words)))
    found = np.flatnonzero(total)
    return found, total[found]


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on the log loss of a softmax over averaged vectors.

    Returns the vectors and the output weights, of which there are two rows.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    output = np.zeros((2, DIMENSIONS))
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(documents)):
            rate = RATE * (1 - done / steps)
            done += 1
            buckets, counts = documents[i]
            if not len(buckets):
                continue
            weights = counts / counts.sum()
            if len(buckets) > DRAWN:
                drawn = rng.choice(len(buckets), DRAWN, p=weights)
                buckets, times = np.unique(drawn, return_counts=True)
                buckets, weights = documents[i][0][buckets], times / DRAWN
            rows = vectors[buckets]
            hidden = weights @ rows
            scores = output @ hidden
            odds = np.exp(scores - scores.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = error @ output
            output -= rate * np.outer(error, hidden)
            vectors[buckets] = rows - rate * 10 * weights[:, None] * back
    return vectors, output


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the logistic of a margin the share of label 1 (Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - labels) * margins).sum() + 1e-2 * (a - 1), (p - labels).sum()])
        h = np.array([[(w * margins**2).sum() + 1e-2, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's margin is the mean over its features, so each word adds a sum and a number."""
    model = shared.value
    weight, again, slope, offset, empty = (model[k] for k in ("weight", "again", "slope", "offset", "empty"))

    known = Numbers()
    sums, sizes = np.zeros(0), np.zeros(0)
    for batch in batches:
        if len(known) > _REMEMBERED:
            known, sums, sizes = Numbers(), np.zeros(0), np.zeros(0)
        found = [text.split() for text in texts(batch.column(1))]
        lengths = np.array([len(words) for words in found], np.int64)
        numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, int(lengths.sum()))
        if known.new:
            buckets, owners = word_features(known.new)
            sums = np.concatenate([sums, np.bincount(owners, weight[buckets], len(known.new))])
            sizes = np.concatenate([sizes, np.bincount(owners, minlength=len(known.new))])
            known.new = []
        row = np.repeat(np.arange(len(found)), lengths)
        total = np.bincount(row, sums[numbers], len(found))
        features = np.bincount(row, sizes[numbers], len(found))
        same = (numbers[1:] == numbers[:-1]) & (row[1:] == row[:-1])
        times = np.bincount(row[1:][same], minlength=len(found)) * features / np.maximum(lengths, 1)
        margin = (total + again * times) / np.maximum(features + times, 1)
        scores = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        scores[lengths == 0] = empty
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])


class Numbers(dict):
    """Word -> number, in the order in which words are first asked for; ``new`` lists the last."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


def fit(examples: DataFrame, seed: int = 42) -> dict:
    """A model from ``text, label, id``: at most ``MAX_EXAMPLES`` rows, by hash of the id.

    Four fifths train the vectors, the rest fixes slope and offset of the score. Without rows
    of both labels every score is the share of label 1 (a half if there are none).
    """
    label = F.expr("label IS NOT NULL AND label IN (0, 1)")
    rows = (
        examples.where(label)
        .withColumn("order", F.xxhash64("id"))
        .orderBy("order", "id")
        .limit(MAX_EXAMPLES)
        .select("text", "label")
        .collect()
    )
    labels = np.array([r["label"] for r in rows], np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    nothing = {"weight": np.zeros(BUCKETS), "again": 0.0, "slope": 1.0, "offset": float(np.log(share / (1 - share))), "empty": float(share)}
    if len(set(labels.tolist())) < 2:
        return nothing
    documents = [document_features((r["text"] or "").encode()) for r in rows]
    check = np.arange(len(rows)) % 5 == 4
    vectors, output = train([d for d, c in zip(documents, check, strict=True) if not c], labels[~check], seed)
    weight = vectors @ (output[1] - output[0])
    margins = np.array([0.0 if not len(b) else float(weight[b] @ n / n.sum()) for b, n in documents])
    filled = np.array([len(b) > 0 for b, _ in documents])
    if len(set(labels[check & filled].tolist())) < 2:
        check = np.ones(len(rows), bool)
    slope, offset = calibrate(margins[check & filled], labels[check & filled])
    none = labels[~filled]
    empty = (none.sum() + share) / (len(none) + 1.0)  # what labelled texts without a word are
    return {"weight": weight, "again": float(weight[_AGAIN]), "slope": slope, "offset": offset, "empty": float(empty)}


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.3,
) -> DataFrame:
    """Score every row's text; a higher score makes label 1 likelier.

    Learns from labelled rows outside of the held-out fold (crc32 of the id modulo 5 is 0).
    Returns ``doc_id, held_out, score, predicted``. Text is all that a score depends on.

    Null, empty and blank texts get the smoothed share of label 1 among labelled ones like
    them. Rows with a null or other label or a null id teach nothing; an id that is labelled
    more than once teaches each time. Repeated rows and ids are scored each time. An empty
    table gives an empty result. Other columns are not read.
    """
    flagged = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col, 5, 0).alias("held_out")
    )
    marks = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    # Which rows to learn from is known by id alone, so only their texts are read for it.
    chosen = marks.where(~held_out("id", 5, 0)).where("label IN (0, 1) AND id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(MAX_EXAMPLES)
    examples = flagged.where("NOT held_out").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "label", "id")
    shared = docs.sparkSession.sparkContext.broadcast(fit(examples))
    source = flagged.select(F.struct("doc_id", "held_out").alias("row"), "text")
    kind = source.schema["row"].dataType.simpleString()
    scored = map_batches(source, lambda b: _score(shared, b), f"row {kind}, score double")
    return scored.select("row.*", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
