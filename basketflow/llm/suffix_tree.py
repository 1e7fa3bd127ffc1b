"""Language-model scores from a probabilistic suffix tree over words, kept as tables."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import cleaned_up, map_batches, removed, saved, saved_at

#: Words whose counts every task knows; counts of the others are joined.
KNOWN = 200_000
#: Least occurrences of a context.
MIN_OCCURRENCES = 30
ADDED = 0.1
#: Words of the longest context.
DEPTH = 3
#: Entries of the tree that every task has at hand, at most; the others are joined.
AT_HAND = 1 << 21
_FLUSH = 400_000
#: Training tokens for each bucket in which next words are counted.
_BUCKET = 1 << 19
#: Buckets in which what is not at hand is looked up have four times as many, if there are more than these.
_BUCKETS = 64
#: Rows of one batch of blocks, which have some 10 kB or more each.
_BLOCKS = 16
#: Bytes of text that are cut into words at once, or one text.
_CUT = 1 << 21
#: Words that are looked up at once, or one text.
_TOGETHER = 30_000
_CELLS = 1_000_000
_BITS = (0, 6, 12, 18)  # where a key has the numbers of its bits
_BITMAP = 21  # a bitmap of keys has 64 << this bits at most


def word_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


#: Stands for the end of a text; no word has a blank.
END_HASH = word_hash(b" ")


def cut(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: hashes of their words, which of them each word is, and words of each text.

    Words are lower-cased (A-Z) and stand between ASCII white space; nulls have none. Each is
    hashed once for the texts that are cut together.
    """
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        after = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _CUT, "right")), first + 1)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(first, after - first)))
        coded = lists.flatten().dictionary_encode()
        of, text = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
        kinds = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, kinds), np.uint64, len(kinds)).view(np.int64)
        if b"" in kinds:  # beside white space at a text's ends
            there = of != kinds.index(b"")
            of, text = of[there], text[there]
        yield hashes, of, np.bincount(text, minlength=len(lists))
        first = after


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(h)
        h, n = h[order], n[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[new], np.add.reduceat(n, new)

    for batch in batches:
        for hashes, of, _ in cut(batch.column(0)):
            n = np.bincount(of, minlength=len(hashes))
            own = np.flatnonzero(n)
            held.append((hashes[own], n[own]))
            size += len(own)
            if size > 2 * _FLUSH:
                held = [summed()]
                size = len(held[0][0])
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["h", "n"])
                    size = 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed()], ["h", "n"])


class Lexicon:
    """Hashes of words and their ranks among the known words, -1 for the others and the end of a text."""

    def __init__(self, known: np.ndarray):
        self.order = np.argsort(known).astype(np.int32)
        self.known = known[self.order]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1, np.int32)
        i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[i] == hashes, self.order[i], np.int32(-1))

    def together(self, column: pa.Array) -> Iterator["Together"]:
        """The texts of a column, in groups of so many words."""
        for hashes, of, lengths in cut(column):
            ranks, ends, first = self.ranks(hashes), np.cumsum(lengths), 0
            while first < len(lengths):
                before = int(ends[first - 1]) if first else 0
                after = min(int(np.searchsorted(ends, before + _TOGETHER)) + 1, len(lengths))
                some = of[before : ends[after - 1]]
                yield Together.of(hashes[some], ranks[some], lengths[first:after])
                first = after


@dataclass
class Together:
    """Texts one after the other, an end after each."""

    hashes: np.ndarray
    ranks: np.ndarray
    text: np.ndarray  # of each word and end
    left: np.ndarray  # words from here to the end: 0 for the end
    lengths: np.ndarray  # of the texts, without the ends

    @classmethod
    def of(cls, hashes: np.ndarray, ranks: np.ndarray, lengths: np.ndarray) -> "Together":
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(int(ends[-1]) + 1, bool)
        inside[ends] = False
        all_hashes, all_ranks = np.full(len(inside), END_HASH, np.int64), np.full(len(inside), -1, np.int32)
        all_hashes[inside], all_ranks[inside] = hashes, ranks
        text = np.repeat(np.arange(len(lengths)), lengths + 1)
        return cls(all_hashes, all_ranks, text, ends[text] - np.arange(len(inside)), lengths)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers in few bytes: the first bytes of all numbers, the second ones, and so on, with zstd."""
    raw = b"".join([
        np.array([len(c) for c in columns], np.int64).tobytes(),
        *(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns),
    ])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns of ``packed``, of these kinds."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    at, found = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return found


@dataclass
class Words:
    """Counts of the known words, most frequent first, and of the corpus."""

    hashes: np.ndarray
    counts: np.ndarray
    train_docs: int
    train_tokens: int  # with an end for each row
    train_types: int

    @property
    def base_denominator(self) -> float:
        return float(np.log10(self.train_tokens + ADDED * (self.train_types + 1)))


def count_words(text: DataFrame) -> tuple[Words, DataFrame]:
    """Of the column ``text``: the known words, and the counts ``(h, c)`` of all words."""
    counts = saved(
        map_batches(text, _count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "word_counts"
    )
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_docs = text.count()
    top = counts.orderBy(F.desc("c"), "h").limit(KNOWN).toArrow()
    known = Words(
        top["h"].to_numpy(), top["c"].to_numpy(), n_docs, int(total) + n_docs, int(types) + (n_docs > 0)
    )
    return known, counts



_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    x = value * _P2
    x = ((x << np.uint64(31)) | (x >> np.uint64(33))) * _P1 ^ (seed + (_P5 + np.uint64(8)))
    x = ((x << np.uint64(27)) | (x >> np.uint64(37))) * _P1 + _P4
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def extend(start: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run of words with one more at its end: Spark's ``xxhash64(start, word)``."""
    first = _hash_long(start.view(np.uint64), np.full(1, 42, np.uint64))
    return _hash_long(word.view(np.uint64), first).view(np.int64)


def runs(sequence: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, ... words; the run at place i starts with the i-th word."""
    found = [sequence]
    for d in range(1, min(longest, len(sequence))):
        found.append(extend(found[-1][:-1], sequence[d:]))
    return found


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``. Others' bits may be set by chance: what passes is looked up.

    Sixteen bits or more for each key, up to 64 << ``_BITMAP`` bits in all. A key sets four
    bits of one of the words.
    """
    with cleaned_up(keys.sparkSession):
        wanted = max(keys.count(), 1) * 16 // 64
    width = min(max(wanted.bit_length(), 10), _BITMAP)
    own = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(key, {at}) & 63 AS int))" for at in _BITS)
    with cleaned_up(keys.sparkSession):
        rows = keys.groupBy(F.expr(f"shiftrightunsigned(key, {64 - width})").alias("at")).agg(
            F.expr(f"bit_or({own})").alias("bits")
        ).toArrow()
    found = np.zeros(1 << width, np.int64)
    found[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return found.view(np.uint64)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64)
    width = len(bits).bit_length() - 1
    own = np.zeros(len(at), np.uint64)
    for shift in _BITS:
        own |= np.uint64(1) << (at >> np.uint64(shift) & np.uint64(63))
    return bits[at >> np.uint64(64 - width)] & own == own


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key by its highest bits; in SQL ``in_bucket``."""
    return ((keys.view(np.uint64) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def in_bucket(key: str, buckets: int) -> str:
    return f"cast(shiftright(shiftrightunsigned({key}, 40) * {buckets}L, 24) AS int) AS bucket"


_COUNTED = "bucket int, split boolean, cells binary"
#: What ``cells`` holds: a context's words and how often it comes, next words with their counts. Words are
#: ranks plus one, and hashes for those of 0.
_CELLS_OF = (np.int8, np.uint32, np.int64, np.int32, np.uint32, np.int64, np.int32)


def _blocks(
    split: bool, bucket: np.ndarray, columns: list[np.ndarray], hashes: np.ndarray, ranks: np.ndarray
) -> Iterator[tuple]:
    """Rows of ``_COUNTED``: the cells of each bucket, those of a context one after the other.

    A cell is given by its context's hash, depth and place among the words, and its count.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, (context, depth, place, n) = bucket[order], (c[order] for c in columns)
    new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])))
    ends, of = np.append(new, len(context)), bucket[new]
    times = np.diff(ends).astype(np.int32)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))

    def words_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = ranks[at]
        return (own + 1).astype(np.uint32), hashes[at[own < 0]]

    for i, j in zip(starts, np.append(starts[1:], len(of)), strict=True):
        some, cells = new[i:j], slice(ends[i], ends[j])
        words_ = depth[some].astype(np.int64)
        at = np.repeat(place[some] - (np.cumsum(words_) - words_), words_) + np.arange(words_.sum())
        nexts = words_at(place[cells] + depth[cells])
        yield int(of[i]), split, packed(depth[some], *words_at(at), times[i:j], *nexts, n[cells])


def _count_next(shared, depths: list[int], buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (context, next word or end) for contexts of so many words, in blocks by context.

    Counted are contexts whose runs of the least of these lengths are all in the bitmap. Those that
    start with a frequent run are spread over several buckets by their next words.
    """
    bits, often, ways, known = shared.value
    lexicon, size, passed = Lexicon(known), 0, 0
    least, held = depths[0], [[], [], [], [], []]

    def column(i: int) -> np.ndarray:
        found = np.concatenate(held[i])
        held[i].clear()  # one column at a time is there twice
        return found

    def out() -> Iterator[pa.RecordBatch]:
        hashes, ranks = column(3), column(4)
        context, depth, place = column(0), column(1), column(2)
        following = hashes[place + depth]
        # By half of each; cells that share these by chance come out in several parts.
        high = np.uint64(0xFFFFFFFF00000000)
        order = np.argsort((context.view(np.uint64) & high) | (following.view(np.uint64) >> np.uint64(32)))
        context, following = context[order], following[order]
        other = context[1:] != context[:-1]
        new = np.flatnonzero(np.append(True, other | (following[1:] != following[:-1])))
        n = np.diff(np.append(new, len(context))).astype(np.int32)
        order, context, following = order[new], context[new], following[new]
        columns = [context, depth[order], place[order], n]
        bucket, rows = bucket_of(context, buckets), iter(())
        split = np.zeros(len(context), bool)
        if len(often):
            start = hashes[columns[2]]
            for i in range(1, least):
                start = extend(start, hashes[columns[2] + i])
            i = np.minimum(np.searchsorted(often, start), len(often) - 1)
            split = often[i] == start
            more = bucket[split] + bucket_of(following[split], ways[i[split]].astype(np.uint64))
            if split.any():
                rows = _blocks(True, np.mod(more, buckets), [c[split] for c in columns], hashes, ranks)
        if not split.all():
            rows = chain(rows, _blocks(False, bucket[~split], [c[~split] for c in columns], hashes, ranks))
        while some := list(islice(rows, _BLOCKS)):
            kinds = (pa.int32(), pa.bool_(), pa.binary())
            arrays = [pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "split", "cells"])

    for batch in batches:
        for some in lexicon.together(batch.column(0)):
            found = runs(some.hashes, depths[-1])
            for depth in range(least, len(found) + 1):
                inside = in_bitmap(bits, found[least - 1]) if depth == least else inside[:-1] & inside[1:]
                at = np.flatnonzero(inside & (some.left[: len(inside)] >= depth))
                if len(at):
                    held[0].append(found[depth - 1][at])
                    held[1].append(np.full(len(at), depth, np.int8))
                    held[2].append((at + passed).astype(np.int32))
                size += len(at)
            held[3].append(some.hashes)
            held[4].append(some.ranks)
            passed += len(some.hashes)
            if size > _CELLS or passed > 8 * _CELLS:
                if size:
                    yield from out()
                held, size, passed = [[], [], [], [], []], 0, 0
    if size:
        yield from out()


def _paired(least: int, known: np.ndarray, group: pa.Table) -> pa.Table:
    """The cells of a bucket: what follows a context more than once, and how many follow it once."""
    rows = [unpacked(cells, *_CELLS_OF) for cells in group["cells"].to_pylist()]
    split = np.repeat(np.array(group["split"].to_pylist(), bool), [len(row[0]) for row in rows])
    depth, *of_contexts, times, nexts, others, n = (np.concatenate(c) for c in zip(*rows, strict=True))
    del rows

    def hashes_of(words_: np.ndarray, others: np.ndarray) -> np.ndarray:
        found, is_known = np.empty(len(words_), np.int64), words_ > 0
        found[is_known], found[~is_known] = known[words_[is_known] - 1], others
        return found

    following, n, depth = hashes_of(nexts, others), n.astype(np.int64), depth.astype(np.int32)
    word, start = hashes_of(*of_contexts), np.cumsum(depth) - depth
    context, parent = word[start], word[start + (depth > 1)]
    for d in range(1, int(depth.max())):
        longer = np.flatnonzero(depth > d)
        last = word[start[longer] + d]
        context[longer] = extend(context[longer], last)
        if d > 1:
            parent[longer] = extend(parent[longer], last)
    of = np.repeat(np.arange(len(context)), times)
    # By one number for the two; 64 bits as those of the hashes themselves.
    mixed = context[of] * np.int64(-7046029254386353131) + following
    order = np.argsort(mixed)
    mixed = mixed[order]
    new = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1]))
    n, of, following = np.add.reduceat(n[order], new), of[order[new]], following[order[new]]
    _, place, own = np.unique(context[of], return_index=True, return_inverse=True)
    # The place of each context, by which its other columns are found.
    place = of[place]
    once, total = np.bincount(own, n == 1, len(place)).astype(np.int64), np.bincount(own, n, len(place))
    inside = split[place] | (total >= least)
    kept, pooled = np.flatnonzero((n > 1) & inside[own]), np.flatnonzero((once > 0) & inside)
    at = np.append(of[kept], place[pooled])
    return pa.table({
        "depth": depth[at], "context": context[at], "parent": parent[at],
        "next": pa.array(np.append(following[kept], pooled), mask=np.arange(len(at)) >= len(kept)),
        "n": np.append(n[kept], once[pooled]),
    })


def _counted(
    text: DataFrame, candidates: DataFrame, depths: list[int], least: int, tokens: int, known: np.ndarray | None = None
) -> tuple[DataFrame, str]:
    """``depth, context, parent, next, n``, written, and where: next words seen once after a context as one, null.

    The contexts are those that occur ``least`` times. A context is in one bucket, and so in one
    task, if it occurs at most ``_BUCKET // 8`` times; others are in as many as they need, and have
    a row of null in each. Words whose hashes are ``known`` are sent as their places there.
    """
    spark = text.sparkSession
    buckets, limit = max(tokens // _BUCKET, 1), max(_BUCKET // 8, 1)
    with cleaned_up(spark):
        often = candidates.where(F.col("n") > limit).select("context", "n").orderBy("context").toArrow()
    often, ways = often["context"].to_numpy(), often["n"].to_numpy() // limit + 1
    known = np.zeros(0, np.int64) if known is None else known
    hashes = spark.sparkContext.broadcast(known)
    shared = spark.sparkContext.broadcast((bitmap(candidates.selectExpr("context AS key")), often, ways, known))
    blocks = map_batches(text, lambda batches: _count_next(shared, depths, buckets, batches), _COUNTED)
    found = saved_at(
        blocks.groupBy("bucket").applyInArrow(
            lambda group: _paired(least, hashes.value, group), "depth int, context long, parent long, next long, n long"
        ),
        "next_words",
    )
    shared.destroy()  # what they were needed for is written
    hashes.destroy()
    return found


def whole_tree(
    text: DataFrame, known: Words, counts: DataFrame, depth: int = DEPTH, least: int = MIN_OCCURRENCES
) -> DataFrame:
    """All retained contexts as rows ``key, value, n``: what a run of words adds to a score.

    A context of up to ``depth`` words is a candidate if it occurs ``least`` times (which a longer
    one can only if the shorter ones do), whatever its words. Its next symbols are the words, and
    the end, that follow it more than once; all that follow it once are one symbol more. It is
    retained if its parent is, and if its next symbols diverge from the parent's: the
    log-likelihood ratio exceeds that of as many free parameters as it has symbols (half the log
    of its occurrences each).

    Its distribution is mixed with its parent's, which weighs as much as the context has
    different next words, and gets what followed once besides: that tells how often something
    new follows, and nothing about what. The root is the base distribution. Neither number nor
    rank is bounded.

    A text's score is its base score and the values of all its runs of words. A run is the key
    of two things. As a context with its next word it adds the log of p over the parent's p,
    less that of a word never seen there; as a context, the log of a never seen word's p over
    the parent's p. Values of contexts that are not retained are missing, so the longest
    retained context's p remains. Both things may have a row; their values add up.
    """
    spark = text.sparkSession
    root = f"(c + {ADDED}D) / {known.train_tokens + ADDED * (known.train_types + 1)!r}D"
    end = spark.createDataFrame([(END_HASH, known.train_docs)], "h long, c long")
    above = counts.select("h", "c").union(end).selectExpr("h AS up", f"{root} AS share", f"{root} AS p")
    candidates = counts.where(f"c >= {least}").selectExpr("h AS context", "c AS n")
    parts, counted, spent = [], None, []
    for words_ in range(1, depth + 1):
        if words_ <= 2:  # two passes: the longer contexts are counted with those of two words
            depths = [1] if words_ == 1 else list(range(2, depth + 1))
            counted, counted_at = _counted(text, candidates, depths, least, known.train_tokens, known.hashes)
        cells, cells_at = saved_at(
            counted.where(F.col("depth") == words_).selectExpr(
                "context", "next", "n",
                "next AS up" if words_ == 1 else "if(next IS NULL, null, xxhash64(parent, next)) AS up",
            ).join(above, "up", "left"),
            f"cells_of_{words_}",
        )
        if words_ == 1 or words_ == depth:
            spent.append(counted_at)
        removed(spark, spent)
        spent = [cells_at]
        grouped = cells.groupBy("context").agg(
            F.sum("n").alias("total"), F.sum(F.expr("if(next IS NULL, n, 0L)")).alias("once"),
            F.count("next").alias("kept"), F.count("share").alias("found"), F.sum("share").alias("shares"),
            F.sum(F.expr("n * ln(n / share)")).alias("logs"),
        )
        other = "if(once > 0, once * ln(once / greatest(1D - coalesce(shares, 0D), 1e-12D)), 0D)"
        retained = saved(
            grouped.where(
                f"total >= {least} AND found = kept AND (kept > 0 OR once > 0) AND coalesce(logs, 0D) + {other}"
                " - total * ln(total) - (kept + if(once > 0, 1, 0)) * ln(total) / 2 > 0"
            ).selectExpr(
                "context", "total", "once", "kept + once AS kinds",
                "log10((kept + 2 * once) / (total + kept + once)) AS unseen",
            ),
            f"retained_of_{words_}",
        )
        mixed = "(n + (kinds + once) * p) / (total + kinds)"
        level = saved(
            cells.where("next IS NOT NULL").join(retained, "context").selectExpr(
                "xxhash64(context, next) AS key", "n", "n / total AS share", f"{mixed} AS p",
                f"log10({mixed} / p) - unseen AS value",
            ),
            f"level_{words_}",
        )
        parts += [level.select("key", "value", "n"), retained.selectExpr("context AS key", "unseen AS value", "total AS n")]
        candidates = cells.where(f"n >= {least} AND next <> {END_HASH}L").selectExpr(
            "xxhash64(context, next) AS context", "n"
        )
        above = level.selectExpr("key AS up", "share", "p")
    removed(spark, spent)
    table = parts[0]
    for part in parts[1:]:
        table = table.union(part)
    return table


def at_hand(tree: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys of the tree and their values, the rarer first; not all of a tie.

    A run's number of occurrences is the same as a context and with its last word as the next
    one, so the rows of a key are taken together or not at all.
    """
    with cleaned_up(tree.sparkSession):
        found = tree.groupBy("n").agg(F.count("*").alias("keys")).orderBy(F.desc("n")).toArrow()
    fit_in = found["n"].to_numpy()[np.cumsum(found["keys"].to_numpy()) <= AT_HAND]
    if not len(fit_in):
        return np.zeros(0, np.int64), np.zeros(0)
    with cleaned_up(tree.sparkSession):
        rows = tree.where(F.col("n") >= int(fit_in[-1])).groupBy("key").agg(
            F.sum("value").alias("value"), F.max("n").alias("n")
        ).toArrow()
    order = np.lexsort((rows["key"].to_numpy(), rows["n"].to_numpy()))
    return rows["key"].to_numpy()[order], rows["value"].to_numpy()[order]


class Values:
    """Values by key, each key in one of two places; a key that finds both taken is left out."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = np.append(keys, 0), np.append(values, 0.0)
        self.places = []
        left = np.arange(len(keys))
        for shift in (0, 32):
            place = np.full(1 << 22, len(keys), np.int32)
            at = self._at(keys[left], shift)
            place[at] = left  # of several the last, which is the most frequent
            self.places.append((shift, place))
            left = left[place[at] != left]

    @staticmethod
    def _at(keys: np.ndarray, shift: int) -> np.ndarray:
        return (keys >> shift) & ((1 << 22) - 1)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the keys, 0 for those that are not here, and which are."""
        last = len(self.keys) - 1
        i = np.full(len(keys), last, np.int32)
        left = np.arange(len(keys))
        for shift, place in self.places:
            at = place[self._at(keys[left], shift)]
            here = (self.keys[at] == keys[left]) & (at < last)
            i[left[here]] = at[here]
            left = left[~here]
        return self.values[i], i < last


#: What a row of ``_score`` asks for: values of runs in the tree, or logs of words that are not known.
_RUN, _WORD = 0, 1
_ASKED = "keys binary"


def buckets_of(tokens: int) -> int:
    """In how many buckets so many training tokens are looked up.

    Larger buckets than those of counting: they send fewer sums for each text.
    """
    return max(tokens // (4 * _BUCKET), min(tokens // _BUCKET, _BUCKETS), 1)


def _asked(kind: int, found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple]:
    """For each bucket its keys, once each, how often each is asked for, and by which texts."""
    keys, at = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(keys):
        return
    order = np.argsort(keys.view(np.uint64))
    keys, at = keys[order], at[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    own, ends = keys[new], np.append(new, len(keys))
    times, of = np.diff(ends).astype(np.int32), bucket_of(own, buckets)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for i, j in zip(starts, np.append(starts[1:], len(of)), strict=True):
        yield int(of[i]), kind, own[i:j].tobytes(), times[i:j].tobytes(), at[ends[i] : ends[j]].tobytes()


def _question(keys: bytes, times: bytes, at: bytes) -> bytes:
    """What ``_asked`` has for a bucket, in few bytes: of the keys, which are in order, the differences."""
    keys = np.frombuffer(keys, np.uint64)
    return packed(np.append(keys[:1], np.diff(keys)), np.frombuffer(times, np.int32), np.frombuffer(at, np.int32))


def _score(shared, depth: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base and gain of each text as far as they are at hand, and what is to be looked up.

    A run is in the tree only if it is so without its last word (which then follows a retained
    context) or without its first (the parent of a retained context); others are not sought.

    Texts are taken in groups, each named by the ``part`` of its first text; what a group asks
    for comes after its texts, a row for each bucket, with ``part`` of a text less that of the first.
    """
    known, keys, values, bits = shared.value
    known = Words(**known)
    lexicon, tree = Lexicon(known.hashes), Values(keys, values)
    logs = np.append(np.log10(known.counts + ADDED), np.log10(ADDED))  # the last for rank -1
    end = float(np.log10(known.train_docs + ADDED))
    first, held, size, taken, kind_of_row = 0, ([], []), 0, 0, None

    def out() -> Iterator[pa.RecordBatch]:
        found = (x for kind in (_RUN, _WORD) for x in _asked(kind, held[kind], buckets))
        while some := list(islice(found, _BLOCKS)):
            bucket, kind, *columns = zip(*some, strict=True)
            n = len(some)
            nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket, pa.int32()), pa.array([first] * n, pa.int64()), pa.nulls(n, kind_of_row), *nothing,
                    pa.array(kind, pa.int32()), pa.array([_question(*c) for c in zip(*columns, strict=True)], pa.binary()),
                ],
                names,
            )

    names = ["bucket", "first", "row", "part", "n_tokens", "n_known", "base", "gain", "kind", "keys"]
    for batch in batches:
        done, kind_of_row = 0, batch.column(0).type
        parts = batch.column(1).to_numpy()
        for some in lexicon.together(batch.column(2)):
            n = len(some.lengths)
            part = parts[done : done + n]
            if not taken:
                first = int(part[0])
            own = part - first
            word = some.left > 0
            is_known = word & (some.ranks >= 0)
            base = np.bincount(some.text[word], logs[some.ranks[word]], n) + end
            known_n = np.bincount(some.text[is_known], minlength=n) + (known.train_docs > 0)
            rare = np.flatnonzero(word & ~is_known)
            held[_WORD].append((some.hashes[rare], own[some.text[rare]].astype(np.int32)))
            size += len(rare)
            gain, inside = np.zeros(n), word
            for d, found in enumerate(runs(some.hashes, depth + 1)):
                sought = word & (some.left >= d)
                if d:
                    sought = sought[:-d] & (inside[:-1] | inside[1:])
                inside = np.zeros(len(found), bool)
                at = np.flatnonzero(sought)
                at = at[in_bitmap(bits, found[at])]
                inside[at] = True
                value, here = tree.of(found[at])
                gain += np.bincount(some.text[at], value, n)
                at = at[~here]
                held[_RUN].append((found[at], own[some.text[at]].astype(np.int32)))
                size += len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.mod(part, buckets).astype(np.int32)), pa.array(np.full(n, first)),
                    batch.column(0).slice(done, n), pa.array(part), pa.array(some.lengths + 1),
                    pa.array(known_n.astype(np.int64)), pa.array(base), pa.array(gain), pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
            done, taken = done + n, taken + n
            if size > _CELLS // 2 or taken > _FLUSH // 8:
                yield from out()
                held, size, taken = ([], []), 0, 0
    if taken:
        yield from out()


def _looked_up(asked: pa.Table, there: pa.Table) -> pa.Table:
    """The texts as they came, and for each group and kind the sums, by text, of the values in this bucket."""
    tables = {}
    kinds, keys, values = (there[c].to_numpy() for c in ("kind", "key", "value"))
    for kind in (_RUN, _WORD):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(keys[own])]
        new = np.flatnonzero(np.append(True, keys[own][1:] != keys[own][:-1])) if len(own) else own
        tables[kind] = keys[own][new], np.add.reduceat(values[own], new) if len(own) else np.zeros(0)
    is_text = asked["kind"].is_null()
    texts_ = asked.filter(is_text).drop_columns(["bucket", "keys"])
    questions = asked.filter(pc.invert(is_text)).select(["first", "kind", "keys"])
    answers = []
    for row in questions.to_pylist():
        sought, times, at = unpacked(row["keys"], np.uint64, np.int32, np.int32)
        sought = np.cumsum(sought, dtype=np.uint64).view(np.int64)
        keys, values = tables[row["kind"]]
        i = np.minimum(np.searchsorted(keys, sought), max(len(keys) - 1, 0))
        here = keys[i] == sought if len(keys) else np.zeros(len(sought), bool)
        if not here.any():
            continue
        each = np.repeat(np.where(here, values[i], 0.0), times)
        here = np.repeat(here, times)
        n, sums = np.bincount(at[here]), np.bincount(at[here], each[here])
        at = np.flatnonzero(n)
        n = n[at].astype(np.int32) if row["kind"] == _WORD else np.zeros(0, np.int32)
        found = packed(np.diff(at, prepend=0).astype(np.int32), sums[at], n)
        answers.append((row["first"], row["kind"], found))
    columns = {name: texts_[name] for name in texts_.column_names}
    if answers:
        first, kind, found = zip(*answers, strict=True)
        of = {"first": pa.array(first, pa.int64()), "kind": pa.array(kind, pa.int32())}
        columns = {
            name: pa.chunked_array([*c.chunks, of.get(name, pa.nulls(len(answers), c.type))]) for name, c in columns.items()
        }
    found = pa.array(found if answers else (), pa.binary())
    columns["found"] = pa.chunked_array([pa.nulls(len(texts_), pa.binary()), found])
    return pa.table(columns)


def _summed(group: pa.Table) -> pa.Table:
    """The texts of a group with all that was found for them."""
    is_text = group["kind"].is_null()
    texts_ = group.filter(is_text)
    part = texts_["part"].to_numpy()
    own = part - group["first"][0].as_py()
    sums = np.zeros((2, int(own.max()) + 1))
    found = np.zeros(sums.shape, np.int64)
    for row in group.filter(pc.invert(is_text)).select(["kind", "found"]).to_pylist():
        at, values, n = unpacked(row["found"], np.int32, np.float64, np.int32)
        at = np.cumsum(at)
        sums[row["kind"], at] += values
        if row["kind"] == _WORD:
            found[_WORD, at] += n
    base = texts_["base"].to_numpy() + sums[_WORD, own]
    return pa.table({
        "row": texts_["row"], "n_tokens": texts_["n_tokens"],
        "n_known": pa.array(texts_["n_known"].to_numpy() + found[_WORD, own]),
        "base": pa.array(base), "gain": pa.array(texts_["gain"].to_numpy() + sums[_RUN, own]),
    })


def score(
    docs: DataFrame, known: Words, counts: DataFrame, tree: DataFrame, keep: list[str], text_col: str = "text",
    depth: int = DEPTH,
) -> DataFrame:
    """Base and model scores of every row, beside the columns ``keep``.

    Frequent words and runs are scored where they are read. The rest are hashed, and looked up
    in the whole tables by buckets (``buckets_of``). A group of texts asks
    once for a key, so one that is hot in the scored rows only is not sent with each of them.
    """
    keys, values = at_hand(tree)
    shared = docs.sparkSession.sparkContext.broadcast((vars(known), keys, values, bitmap(tree)))
    buckets = buckets_of(known.train_tokens)
    source = docs.select(
        F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("part"), F.col(text_col).alias("text")
    )
    kind = source.schema["row"].dataType.simpleString()
    text = f"row {kind}, part long, n_tokens long, n_known long, base double, gain double, kind int"
    asked = map_batches(
        source, lambda batches: _score(shared, depth, buckets, batches), f"bucket int, first long, {text}, {_ASKED}"
    )
    unknown = float(np.log10(ADDED))
    there = tree.selectExpr(in_bucket("key", buckets), f"{_RUN} AS kind", "key", "value").union(
        counts.selectExpr(in_bucket("h", buckets), f"{_WORD} AS kind", "h", f"log10(c + {ADDED}D) - ({unknown!r}D)")
    )
    parts = saved(
        asked.groupBy("bucket").cogroup(there.groupBy("bucket")).applyInArrow(
            _looked_up, f"first long, {text}, found binary"
        ),
        "score_parts",
    )
    found = parts.groupBy("first").applyInArrow(
        _summed, f"row {kind}, n_tokens long, n_known long, base double, gain double"
    )
    base = F.col("base") - F.col("n_tokens") * known.base_denominator
    return found.select(
        "row.*", "n_tokens", "n_known", F.lit(known.train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds) == fold


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = MIN_OCCURRENCES
) -> DataFrame:
    """Score every row, learning from the nine tenths that are not held out.

    ``depth`` is the number of words of the longest context, ``least`` how often one must occur.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens
    are lower-cased words and one end; ``score`` is the model's log10 probability of them.

    Null, empty and blank texts have the end only. Repeated rows and ids are kept, and count
    each time. If nothing is left to learn from, all words are unknown. An empty table gives
    an empty result. Other columns are not read.
    """
    flagged = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col, 10, 0).alias("held_out")
    )
    learned = flagged.where("NOT held_out").select("text")
    known, counts = count_words(learned)
    return score(flagged, known, counts, whole_tree(learned, known, counts, depth, least), ["doc_id", "held_out"], depth=depth)
