"""Ranked lexical search by K2-treaps over grids of terms and documents.

A block of documents is a square grid: a row for each term of the query set, a column for each
document, the term's impact in each cell. A quadtree over the grid keeps the greatest impact of
each cell that is not empty. A query follows the paths of its rows down the tree together: the
maxima of the cells in which its rows lie add up to a bound for a range of documents.
"""

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow.llm.common import map_batches, saved

#: Items that are searched for together; more are taken in blocks.
ITEMS = 4096
#: Columns of a grid at least; a grid has as many columns as rows.
LEAST_SIDE = 4096
#: A range of so many documents (2 at least) is opened whole, with numpy, and not put on the heap.
OPEN = 256
#: Bytes of text that are cut into terms together.
PIECE = 1 << 20

# Every byte that no term holds becomes a space, A-Z become small letters.
_TERMS = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in UTF-8 ``text``."""
    plain, found, at = text.translate(_TERMS), Counter(), 0
    while at < len(plain):
        stop = plain.find(b" ", at + PIECE)
        stop = len(plain) if stop < 0 else stop
        found.update(plain[at:stop].split(b" "))
        at = stop
    del found[b""]
    return found


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to a score; ``n`` is its document's number of terms."""
    lengths, at = np.unique(n, return_inverse=True)
    m = np.array([50 + (50 * x * n_docs) // n_terms for x in lengths.tolist()], np.int64)[at]
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _spread(values: np.ndarray) -> np.ndarray:
    """Bit i to bit 2i."""
    found = values.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        found = (found | found << np.uint64(shift)) & np.uint64(mask)
    return found


class Treap:
    """Levels of cells from the whole grid down to single impacts.

    ``cells[l]`` holds four bits for each cell of level l, one for each quarter that is not empty;
    the cells of level l + 1 are those quarters, in order. ``maxima[l]`` is the greatest impact of
    each cell.
    """

    def __init__(self, cells: list[np.ndarray], maxima: list[np.ndarray]):
        self.cells, self.maxima = cells, maxima
        self.quarters = []
        for bits in cells:
            has = bits[:, None] >> np.arange(4, dtype=np.uint8) & 1
            place = np.cumsum(has.ravel(), dtype=np.int32).reshape(-1, 4) - 1
            self.quarters.append(np.where(has == 1, place, -1))

    @property
    def depth(self) -> int:
        return len(self.cells)

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, depth: int) -> "Treap":
        """From the impacts of a grid with sides of ``2 ** depth``; there must be one at least."""
        code = _spread(rows) << np.uint64(1) | _spread(columns)
        order = np.argsort(code)
        code, values = code[order], values[order].astype(np.int64)
        cells, maxima = [], [values]
        for _ in range(depth):
            parent = code >> np.uint64(2)
            first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            bit = np.uint8(1) << (code & np.uint64(3)).astype(np.uint8)
            cells.append(np.bitwise_or.reduceat(bit, first))
            values = np.maximum.reduceat(values, first)
            maxima.append(values)
            code = parent[first]
        return cls(cells[::-1], maxima[::-1])

    def pack(self) -> list[bytes]:
        """Compressed levels: the bits of the cells, and how far their maxima fall below the cell above."""
        press, above = zstandard.ZstdCompressor(level=3), np.zeros(1, np.int64)
        found = []
        for level, maxima in enumerate(self.maxima):
            found.append(press.compress((above - maxima).astype("<i8").tobytes()))
            if level < self.depth:
                found.append(press.compress(self.cells[level].tobytes()))
                above = np.repeat(maxima, np.bitwise_count(self.cells[level]))
        return found

    @classmethod
    def unpack(cls, packed: list[bytes]) -> "Treap":
        open_, above = zstandard.ZstdDecompressor(), np.zeros(1, np.int64)
        cells, maxima = [], []
        for level, data in enumerate(packed):
            data = open_.decompress(data)
            if level % 2:
                cells.append(np.frombuffer(data, np.uint8))
                above = np.repeat(maxima[-1], np.bitwise_count(cells[-1]))
            else:
                maxima.append(above - np.frombuffer(data, "<i8"))
        return cls(cells, maxima)

    def _down(self, level: int, at: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each range: ``at[i, t]`` is the cell of row t, -1 where it is empty.

        ``side`` is the rows' bit at this level, shifted to its place in the quarter's number.
        """
        quarters, maxima = self.quarters[level], self.maxima[level + 1]
        halves = np.stack([np.where(at >= 0, quarters[at, side | half], -1) for half in (0, 1)], axis=1)
        return halves, np.where(halves >= 0, maxima[halves], 0).sum(axis=2)

    def best(self, rows: np.ndarray, columns: int, least: "Best") -> None:
        """Offer ``least`` all columns whose rows' impacts may add up to enough, best range first."""
        sides = [(rows >> (self.depth - 1 - level) & 1) << 1 for level in range(self.depth)]
        start = np.zeros((1, len(rows)), np.int32)
        heap = [(-int(self.maxima[0][0]) * len(rows), 0, 0, start)]
        while heap:
            bound, level, prefix, at = heapq.heappop(heap)
            if not least.may_enter(-bound):
                return
            if 1 << (self.depth - level) <= OPEN:
                self._open(level, prefix, at, sides, least)
                continue
            halves, bounds = self._down(level, at, sides[level])
            for half in (0, 1):
                upper, child = int(bounds[0, half]), prefix << 1 | half
                if upper and child << (self.depth - level - 1) < columns:
                    heapq.heappush(heap, (-upper, level + 1, child, halves[:, half]))

    def _open(self, level: int, prefix: int, at: np.ndarray, sides: list[np.ndarray], least: "Best") -> None:
        """All documents of a range, less those ruled out on the way down."""
        prefixes, bounds = np.array([prefix]), None
        while level < self.depth:
            halves, bounds = self._down(level, at, sides[level])
            prefixes = (prefixes[:, None] << 1 | np.arange(2)).ravel()
            at, bounds = halves.reshape(-1, at.shape[1]), bounds.ravel()
            keep = (bounds > 0) & (bounds >= least.floor)
            prefixes, at, bounds = prefixes[keep], at[keep], bounds[keep]
            if not len(prefixes):
                return
            level += 1
        least.offer(bounds, prefixes)


class Best:
    """The ``k`` best so far: greatest score, then smallest order."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = 1
        self.names = None

    def may_enter(self, bound: int) -> bool:
        return bound >= self.floor

    def offer(self, scores: np.ndarray, columns: np.ndarray) -> None:
        scores, keys = np.append(self.scores, scores), np.append(self.keys, self.names[columns])
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores, self.keys = scores[order], keys[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.scores[-1]))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, item_id, terms`` of the items that have a term; ``item`` is a number of the row's own."""
    source = items.select(
        F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text")
    )
    kind = source.schema["item_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(term_counts(t.as_py() or b"")) for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"]
            )

    return saved(map_batches(source, work, f"item long, item_id {kind}, terms array<binary>"), "items").where("size(terms) > 0")


def _postings(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, n, terms, tfs`` of each document with a term at all."""
    known = shared.value
    for batch in batches:
        rows, lengths, terms, tfs = [], [], [], []
        for row, text in enumerate(batch.column(1).cast(pa.large_binary())):
            counts = term_counts(text.as_py() or b"")
            if counts:
                found = [(known[t], n) for t, n in counts.items() if t in known]
                rows.append(row)
                lengths.append(counts.total())
                terms.append([t for t, _ in found])
                tfs.append([n for _, n in found])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64())),
            ],
            ["doc_id", "n", "terms", "tfs"],
        )


def _index(side: int, weights: np.ndarray, n_docs: int, n_terms: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A packed treap for each ``side`` documents."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, tfs = (table[n].combine_chunks() for n in ("terms", "tfs"))
        column = np.repeat(np.arange(table.num_rows), terms.value_lengths().to_numpy())
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        value = impacts(weights[term], tf, table["n"].to_numpy()[column], n_docs, n_terms)
        real = value > 0
        packed = []
        if real.any():
            packed = Treap.of(term[real], column[real], value[real], side.bit_length() - 1).pack()
        ids = pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([packed], pa.list_(pa.binary()))], ["docs", "levels"])

    for batch in batches:
        for at in range(0, batch.num_rows, side):
            part = batch.slice(at, side)
            if held and size + part.num_rows > side:
                yield out()
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if size:
        yield out()


def _search(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best documents of all of a task's blocks for each item."""
    queries = shared.value
    best = {item: Best(k) for item, _ in queries}
    for batch in batches:
        for row in range(batch.num_rows):
            packed = batch.column(1)[row].as_py()
            if not packed:
                continue
            treap = Treap.unpack(packed)
            names = batch.column(0)[row].values
            for item, rows in queries:
                # Documents without an id come after all others.
                best[item].names = names.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                treap.best(rows, len(names), best[item])
    for item, found in best.items():
        if len(found.keys):
            columns = [pa.array(np.full(len(found.keys), item)), pa.array(found.keys), pa.array(found.scores)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])


_NO_ID = (1 << 63) - 1


def _rows(found: list, df: dict[bytes, int], n_docs: int) -> dict[bytes, int]:
    """The row of each term: frequent ones first, by frequency, then those of one item together.

    Terms of like impact, or of the same documents, then share cells.
    """
    first: dict[bytes, int] = {}
    for number, item in enumerate(found):
        for term in item["terms"]:
            first.setdefault(bytes(term), number)

    def place(term: bytes) -> tuple:
        n = df.get(term, 0)
        return (0, -n, term) if 64 * n > n_docs else (1, first[term], term)

    return {term: row for row, term in enumerate(sorted(first, key=place))}


def _ranked(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``item, doc_id, score``: the best of every block for one block of items."""
    spark = docs.sparkSession
    found = items.orderBy("item").collect()
    known = {term: number for number, term in enumerate(sorted({bytes(t) for i in found for t in i["terms"]}))}
    terms = spark.sparkContext.broadcast(known)
    postings = saved(
        map_batches(docs, lambda batches: _postings(terms, batches), "doc_id long, n long, terms array<int>, tfs array<long>"),
        "postings",
    )
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = dict(map(tuple, postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
    names = sorted(known)
    df = {names[number]: n for number, n in counts.items()}
    rows = _rows(found, df, n_docs)
    side = max(LEAST_SIDE, 1 << (max(len(rows), 1) - 1).bit_length())
    weights = np.zeros(len(names), np.int64)
    row_of = np.array([rows[name] for name in names], np.int32)
    for name, n in df.items():
        weights[known[name]] = term_weight(n_docs, n)
    by_row = np.zeros(max(len(rows), 1), np.int64)
    by_row[row_of] = weights
    moved = spark.sparkContext.broadcast(row_of)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def renumbered() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                new = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(lists.value_lengths().to_numpy())), pa.int32()),
                    pa.array(moved.value[lists.flatten().to_numpy()], pa.int32()),
                )
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], new, batch.column(3)], batch.schema.names)

        return _index(side, by_row, n_docs, n_terms, renumbered())

    indexed = saved(map_batches(postings, index, "docs array<long>, levels array<binary>"), "treaps")
    queries = [(i["item"], np.array([rows[bytes(t)] for t in i["terms"]])) for i in found]
    asked = spark.sparkContext.broadcast([(item, r[by_row[r] > 0]) for item, r in queries if (by_row[r] > 0).any()])
    return map_batches(indexed, lambda batches: _search(asked, k, batches), "item long, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each item, by whole-number impacts of the terms they share.

    Every document is a column of an index of its block, with rows for the terms of the items: the
    items are a stated query set, taken in blocks of ``ITEMS``, and each block of documents is
    searched for all of them. What reaches the last step is ``k`` rows an item and task.

    Returns ``item_id, rank, doc_id, score``; ranks start at 1, equal scores go by ascending id.

    Null and empty texts have no term: such documents are never found and do not count, such
    items find nothing. Ids of documents must be whole numbers; documents that share an id are
    ranked each for itself, one without an id comes after all others of its score. Items that
    share an id are each ranked. Empty tables give an empty result. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = item_terms(items, item_id_col, item_text_col)
    blocks = max(1, -(-listed.count() // ITEMS))
    found = None
    for number in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        best = _ranked(source, part, k)
        found = best if found is None else found.union(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = saved(found, "ranked").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(listed.select("item", "item_id"), "item").select(
        "item_id", "rank", F.expr(f"nullif(doc_id, {_NO_ID})").alias("doc_id"), "score"
    )


def oracle_sql(k: int = 50) -> str:
    """The same in SQL (DuckDB)."""
    capitals = "".join(map(chr, range(65, 91)))
    terms = (
        f"regexp_extract_all(translate(text, '{capitals}', '{capitals.lower()}'),"
        " '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
WITH words AS (SELECT doc_id, unnest({terms}) AS term FROM documents WHERE text IS NOT NULL),
wanted AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id),
placed AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {k}
"""
