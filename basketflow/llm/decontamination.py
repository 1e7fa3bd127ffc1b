"""Benchmark passages in documents, by latent semantic retrieval and alignment."""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import fresh, map_batches

#: A passage is two neighbouring blocks of words; passages overlap by one block.
BLOCK = 24
#: Dimensions of the latent space, and columns of the random test matrix it is found with.
RANK, SKETCH = 160, 176
#: Least cosine, in the latent space, of a passage that is compared word by word.
COSINE = 0.4
#: Share of an item's words that its longest common subsequence with the text must reach: by
#: itself, or together with the answer.
COPIED, PARAPHRASED = 0.8, 0.6
#: The last words of an item are its answer; so many of them must follow in order.
ANSWER, ANSWER_FOUND = 5, 3
#: Words in this share of the items, or more, say little about one.
COMMON = 0.01
LEAST_TERMS = 8
#: Items that are searched for at once; more are searched for block by block.
ITEMS = 5000
_SLICES, _PARTS = 16, 64
_FEW = 8  # terms of a block that are added with those of other blocks
_STRIP = b".,;:!?\"'()[]"


def term(word: bytes) -> bytes:
    """In lower case (A-Z) without the punctuation around it."""
    return word.lower().strip(_STRIP)


def terms(text: str | None) -> list[bytes]:
    return [t for t in map(term, (text or "").encode().split()) if t]


def vocabulary(items: list[list[bytes]]) -> list[bytes]:
    """The words that tell items apart: the rarer ones, and of each item its rarest."""
    df = Counter(t for item in items for t in set(item))
    most = max(2.0, COMMON * len(items))
    chosen = {t for t, n in df.items() if n <= most}
    for item in items:
        chosen.update(sorted(set(item), key=lambda t: (df[t], t))[:LEAST_TERMS])
    return sorted(chosen)


class Terms(dict):
    """Word as written -> its term; remembers what it is asked."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = term(word)
        return found


class TermIds(dict):
    """Number of each term, under the ways it is commonly written in running text.

    A word written otherwise counts for nothing in the latent space, but is compared as its
    term all the same. Unknown words, which most are, cost one look-up.
    """

    def __init__(self, chosen: list[bytes]):
        self.numbers = {t: i for i, t in enumerate(chosen)}
        super().__init__(
            (form + mark, i)
            for t, i in self.numbers.items()
            for form in (t, t.capitalize(), t.upper())
            for mark in (b"", b".", b",")
        )
        self.update(self.numbers)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))


@dataclass
class Blocks:
    """Occurrences of terms in the blocks of a batch of documents, blocks in order."""

    block: np.ndarray
    term: np.ndarray
    doc: np.ndarray  # of each block
    joined: np.ndarray  # whether the next block is of the same document

    @property
    def windows(self) -> np.ndarray:
        """Blocks with which a passage begins: all but the last of several."""
        single = np.bincount(self.doc)[self.doc] == 1 if len(self.doc) else np.zeros(0, bool)
        return np.flatnonzero(self.joined | single)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the terms' rows over the passage that begins with each block."""
        out = np.zeros((len(self.doc), rows.shape[1]), rows.dtype)
        if len(self.block):
            starts = np.flatnonzero(np.diff(self.block, prepend=-1))
            n = np.diff(np.append(starts, len(self.block)))
            many = n > _FEW
            if many.any():
                at = np.flatnonzero(np.repeat(many, n))
                first = np.append(0, np.cumsum(n[many])[:-1])
                out[self.block[starts[many]]] = np.add.reduceat(rows[self.term[at]], first, axis=0)
            # Of the others the second terms of all blocks, the third terms, and so on; then the first,
            # which is the order of reduceat.
            order = np.flatnonzero(~many)
            order = order[np.argsort(-n[order], kind="stable")]
            starts, n = starts[order], n[order]
            several = np.searchsorted(-n, -1)
            rest = rows[self.term[starts[:several] + 1]]
            for k in range(2, n[0] if len(n) else 0):
                more = np.searchsorted(-n, -k)
                rest[:more] += rows[self.term[starts[:more] + k]]
            total = rows[self.term[starts]]
            total[:several] += rest
            out[self.block[starts]] = total
        ends = np.flatnonzero(~self.joined[:-1])
        alone = out[ends]
        out[:-1] += out[1:]
        out[ends] = alone
        return out


def cut(documents: list[list[bytes]], ids: TermIds) -> Blocks:
    blocks, found, owners, base = [], [], [], 0
    for d, words in enumerate(documents):
        numbers = ids.of(words)
        at = np.flatnonzero(numbers >= 0)
        blocks.append(at // BLOCK + base)
        found.append(numbers[at])
        n = max(1, -(-len(words) // BLOCK))
        owners.append(np.full(n, d))
        base += n
    doc = np.concatenate([np.zeros(0, np.int64), *owners])
    empty = np.zeros(0, np.int64)
    return Blocks(np.concatenate([empty, *blocks]), np.concatenate([empty, *found]), doc, np.append(doc[1:] == doc[:-1], False)[: len(doc)])


def _documents(column: pa.Array) -> list[list[bytes]]:
    return [(v.as_py() or b"").split() for v in column.cast(pa.large_binary())]


def _sketch(chosen: list[bytes], seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (term counts)' (term counts) times the test matrix, passages with each term, passages."""
    import pyspark

    ids = TermIds(chosen)
    test = test_matrix(len(chosen), seed)
    total = np.zeros((len(chosen), SKETCH + 2), np.float64)
    seen = False
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            part = cut(_documents(batch.column(0).slice(start, 100)), ids)
            seen = True
            windows = part.windows
            total[0, SKETCH + 1] += len(windows)
            if not len(part.block):
                continue
            passage = part.sums(test)
            last = np.ones(len(part.doc), bool)
            last[windows] = False
            passage[last] = 0
            both = passage.copy()
            both[1:] += passage[:-1]  # none after the end of a document, which is zero
            order = np.argsort(part.term, kind="stable")
            starts = np.flatnonzero(np.diff(part.term[order], prepend=-1))
            total[part.term[order[starts]], :SKETCH] += np.add.reduceat(both[part.block[order]], starts, axis=0)
            before = part.block > 0
            before[before] = part.joined[part.block[before] - 1]
            pairs = np.concatenate([
                (part.block * len(chosen) + part.term)[~last[part.block]],
                ((part.block - 1) * len(chosen) + part.term)[before],
            ])
            total[:, SKETCH] += np.bincount(np.unique(pairs) % len(chosen), minlength=len(chosen))
    if seen:
        task = pyspark.TaskContext.get().partitionId()
        pieces = [p.astype(np.float64).tobytes() for p in np.array_split(total, _SLICES)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_SLICES), pa.int32()), pa.array([task % _PARTS] * _SLICES, pa.int32()), pa.array(pieces, pa.binary())],
            ["slice", "part", "sums"],
        )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the arrays of a group, one at a time."""
    total, keys = None, None
    for batch in batches:
        keys = keys or (batch.column(0)[:1], batch.column(1)[:1])
        for value in batch.column(2):
            sums = np.frombuffer(value.as_py())
            total = sums.copy() if total is None else total + sums
    yield pa.RecordBatch.from_arrays([*keys, pa.array([total.tobytes()], pa.binary())], ["slice", "part", "sums"])


def test_matrix(rows: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((rows, SKETCH)).astype(np.float32)


def latent_terms(docs: DataFrame, chosen: list[bytes], text_col: str, seed: int = 42) -> np.ndarray:
    """The term vectors of a latent space: row t is the projection of term t, times its idf.

    Randomised SVD of the TF-IDF matrix A of all passages in one pass. With raw counts C and
    idf weights D (A = C D), each task adds up C'C W for its passages and a random matrix W,
    besides the passages that each term is in. The sums of the tasks are added in two steps,
    slice by slice. With D known at the end, D (C'C W) is A'A times the test matrix D^-1 W, so
    that the singular vectors follow from it by Nystrom's formula.
    """
    text = docs.select(F.col(text_col).alias("text"))
    parts = map_batches(text, lambda b: _sketch(chosen, seed, b), "slice int, part int, sums binary")
    schema = "slice int, part int, sums binary"
    added = parts.groupBy("slice", "part").applyInArrow(_add_group, schema)
    added = added.groupBy("slice").applyInArrow(_add_group, schema)
    rows = {r["slice"]: np.frombuffer(r["sums"]).reshape(-1, SKETCH + 2) for r in added.toLocalIterator()}
    if not rows:
        return np.zeros((len(chosen), RANK), np.float32)
    total = np.concatenate([rows[s] for s in range(_SLICES)])
    sketch, df, passages = total[:, :SKETCH], total[:, SKETCH], total[0, SKETCH + 1]
    idf = np.log((passages + 1) / (df + 1)) + 1
    test = test_matrix(len(chosen), seed).astype(np.float64)
    core = test.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10 if len(values) else values > 0
    root = vectors[:, good] / np.sqrt(values[good])
    basis = np.linalg.svd((idf[:, None] * sketch) @ root, full_matrices=False)[0][:, :RANK]
    return (idf[:, None] * basis).astype(np.float32)


def _add_group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_add(iter(table.to_batches())))


def common_subsequence(places: dict[bytes, int], length: int, text: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; ``places`` has a bit for
    each place of a word in the item."""
    full = (1 << length) - 1
    row = full
    for word in text:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def _places(item: list[bytes]) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for i, word in enumerate(item):
        found[word] = found.get(word, 0) | 1 << i
    return found


class Holders:
    """Which items have which terms; counts an item's terms in documents."""

    def __init__(self, own: list[set[int]], least: list[int], n_terms: int):
        pairs = np.array([(t, i) for i, o in enumerate(own) for t in o], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.items, self.least = pairs[:, 1], np.array(least)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(n_terms + 1))

    def enough(self, part: Blocks, documents: int) -> np.ndarray:
        """Of each document and item, whether the item's least number of its own terms is there."""
        width = len(self.starts) - 1
        seen = np.unique(part.doc[part.block] * width + part.term)
        doc, term = seen // width, seen % width
        n = self.starts[term + 1] - self.starts[term]
        at = np.arange(n.sum()) + np.repeat(self.starts[term] - np.append(0, np.cumsum(n)[:-1]), n)
        found = np.repeat(doc, n) * len(self.least) + self.items[at]
        return np.bincount(found, minlength=documents * len(self.least)).reshape(documents, -1) >= self.least


def _search(shared, field: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    ids, table, items = TermIds(model["terms"]), model["table"], model["items"]
    numbers = model["numbers"]
    latent = np.stack([table[[ids.numbers[t] for t in item if t in ids.numbers]].sum(axis=0) for item in items])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    places = [_places(item) for item in items]
    answers = [_places(item[-ANSWER:]) for item in items]
    own = [{ids.numbers[t] for t in item if t in ids.numbers} for item in items]
    # A word of the item that is nowhere in the text is missing in any common subsequence.
    fewest = [math.ceil(PARAPHRASED * len(item)) - (len(item) - len(p)) for item, p in zip(items, places, strict=True)]
    # Of the item's words so many are missed at most; its own terms can make up for no more.
    least = [max(1, math.ceil(PARAPHRASED * len(item)) - (len(item) - len(o))) for item, o in zip(items, own, strict=True)]
    holders = Holders(own, least, len(ids.numbers))
    term_of = Terms()
    kind = pa.list_(pa.struct([("item", pa.int32()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())]))
    for batch in batches:
        column = batch.column(0).field(field)
        results: list[list[dict]] = []
        for start in range(0, batch.num_rows, 100):
            documents = _documents(column.slice(start, 100))
            part = cut(documents, ids)
            first = np.searchsorted(part.doc, np.arange(len(documents)))
            last = np.append(first[1:], len(part.doc))
            best: list[dict[int, tuple]] = [{} for _ in documents]
            vectors = part.sums(table)
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            norms[norms == 0] = np.inf
            begins = np.zeros(len(norms), bool)
            begins[part.windows] = True
            enough = holders.enough(part, len(documents))
            term_list, owner = part.term.tolist(), part.doc.tolist()
            start_of = np.searchsorted(part.block, np.arange(len(norms) + 1)).tolist()
            first_of, last_of = first.tolist(), last.tolist()
            for some in range(0, len(norms), 4096):
                dots = vectors[some : some + 4096] @ latent.T
                near_enough = (dots >= COSINE * norms[some : some + 4096, None]) & begins[some : some + 4096, None]
                at_block, at_item = np.nonzero(near_enough)
                keep = enough[part.doc[some + at_block], at_item]
                for w, i in zip(at_block[keep].tolist(), at_item[keep].tolist(), strict=True):
                    block, item = some + w, items[i]
                    d = owner[block]
                    known = best[d].get(i)
                    if known is not None and known[1] == 1.0:
                        continue
                    margin = max(BLOCK, len(item))
                    around = -(-margin // BLOCK)
                    lo = start_of[max(first_of[d], block - around)]
                    hi = start_of[min(last_of[d], block + 2 + around)]
                    if len(own[i].intersection(term_list[lo:hi])) < least[i]:
                        continue
                    at = (block - first_of[d]) * BLOCK
                    near = documents[d][max(0, at - margin) : at + 2 * BLOCK + margin]
                    near = [t for t in map(term_of.__getitem__, near) if t]
                    if len(places[i].keys() & near) < fewest[i]:
                        continue
                    share = common_subsequence(places[i], len(item), near) / len(item)
                    if share < PARAPHRASED:
                        continue
                    tail = min(ANSWER, len(item))
                    answer = common_subsequence(answers[i], tail, near) >= min(ANSWER_FOUND, tail)
                    if (share >= COPIED or answer) and (known is None or share > known[1]):
                        best[d][i] = (float(dots[w, i] / norms[block]), share, answer)
            for found in best:
                results.append([
                    {"item": int(numbers[i]), "cosine": c, "lcs": s, "answer": a} for i, (c, s, a) in sorted(found.items())
                ])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results, kind)], ["row", "hits"])


def with_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text",
    keep: list[str] | None = None,
) -> tuple[DataFrame, list[list]]:
    """``row`` (a struct of the columns ``keep``, all by default) and ``hits`` of every row.

    A hit has the number of an item, in the order of the list returned with the frame. The
    benchmark is a stated query set: its texts go to the driver and to every task, in blocks
    of ``ITEMS``, and one search over all documents is made for each block.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if keep is None or c in keep]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    queries = [(n, item) for n, r in enumerate(benchmark.select(item_text_col).toLocalIterator()) if (item := terms(r[0]))]
    schema = f"row {kind}, hits array<struct<item:int,cosine:double,lcs:double,answer:boolean>>"
    result = rows.withColumn("hits", F.expr("cast(array() AS array<struct<item:int,cosine:double,lcs:double,answer:boolean>>)"))
    for start in range(0, len(queries), ITEMS):
        block = queries[start : start + ITEMS]
        items = [item for _, item in block]
        chosen = vocabulary(items)
        table = latent_terms(docs, chosen, text_col)
        shared = spark.sparkContext.broadcast(
            {"terms": chosen, "table": table, "items": items, "numbers": [n for n, _ in block]}
        )
        place = columns.index(text_col)
        found = map_batches(result.select("row"), lambda b, s=shared: _search(s, place, b), schema) if not start else None
        if found is None:  # a later block: search again and put the hits beside the earlier ones
            earlier = result.select(F.struct(F.col("row"), F.col("hits")).alias("row"))
            inner = earlier.selectExpr("struct(row.row.*, row.hits AS __hits) AS row")
            again = inner.schema["row"].dataType.simpleString()
            found = map_batches(inner, lambda b, s=shared: _search(s, place, b), schema.replace(kind, again, 1))
            names = ", ".join(f"'{c}', row.`{c}`" for c in columns)
            found = found.selectExpr(f"named_struct({names}) AS row", "concat(row.__hits, hits) AS hits")
        result = found
    return result, queries


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Which rows hold which benchmark items, whole, edited or paraphrased.

    Returns ``doc_id, item_id, cosine, lcs, answer``, a row for each pair found: the best
    passage's cosine in the latent space, the share of the item's words in the longest common
    subsequence, and whether the item's last words follow in order. A pair is reported if
    the share is ``COPIED``, or ``PARAPHRASED`` with the answer.

    Null, empty and blank texts hold nothing, and such items are never found. Repeated rows
    and ids, and null ids, are reported each time; repeated items each. Empty tables give an
    empty result. Other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    listed = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    found, names = _with_ids(plain, listed)
    return found.selectExpr("row.doc_id", "inline(hits)").join(F.broadcast(names), "item").select(
        "doc_id", "item_id", "cosine", "lcs", "answer"
    )


def _with_ids(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hits, and which item each number is; the benchmark is read in one order for both."""
    rows = list(benchmark.toLocalIterator())
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    fixed = spark.createDataFrame([(n, r["item_id"], r["text"]) for n, r in enumerate(rows)], f"item int, item_id {kind}, text string")
    found, _ = with_hits(docs, fixed.orderBy("item"))
    return found, fixed.select("item", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""
    found, _ = with_hits(docs, benchmark, text_col, item_text_col)
    return found.where("size(hits) = 0").select("row.*")
