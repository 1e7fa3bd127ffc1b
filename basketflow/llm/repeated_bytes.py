"""Removal of repeated byte strings by a distributed, sparse suffix array.

A string of ``SIZE`` bytes that occurs twice is called a window here. Suffixes are not taken at
every byte: each window is owned by the ``GRAM`` bytes in it whose hash is least, which depends
on its bytes alone, so equal windows are owned by equal grams at the same distance. Only suffixes
that begin with an owner are sorted (one byte in 32), each with the bytes its windows reach back.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow.llm.common import map_batches, saved

SIZE = 100
GRAM = 32
#: Hashed grams a window holds.
SPAN = SIZE - GRAM + 1

#: Window starts that a task looks at together.
BLOCK = 1 << 18
#: Bytes of neighbourhoods that a task combines before they are shuffled.
COMBINED = 32 << 20
#: Suffixes of one bucket of the sort.
BUCKET = 100_000
#: Different neighbourhoods of a gram that one task compares window by window; beyond, they are shuffled.
TOGETHER = 8192
#: Suffixes of one gram that buckets hand on to one task, at most.
HANDED = 1 << 16
#: Grams that occur twice, up to which tasks find them in a bitmap (16 MB); beyond, they are joined.
MAX_BITMAP = 1 << 24
BITS = 27

#: Slices that are copied together.
_SLICES = 4096
#: Bytes of results a task gathers before it hands them on.
_HELD = 1 << 22

_ROW = "id long, th long, lo int, wins int"
_SUFFIXES = f"{_ROW}, suffix binary, before binary"
_FOUND = f"{_ROW}, before int, around binary"

_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on, by doubling."""
    found = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB)
    found ^= found >> np.uint64(32)
    for step, mix in enumerate(_MIX):
        found = found[: -(1 << step)] * np.uint64(mix) + found[1 << step :]
        found ^= found >> np.uint64(29)
    return found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def owned_runs(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of the texts ``data[edges[i]:edges[i + 1]]``, as runs with the same owner.

    Yields arrays ``owner, first, last, hash`` for each block of windows: the place of the gram,
    the first and last start, and the gram's hash.
    """
    # No window starts in the last bytes of a text.
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, np.maximum(edges[:-1], edges[1:] - SIZE + 1), 1)
    np.add.at(step, edges[1:], -1)
    barred = np.cumsum(step[:-1]) > 0
    places = (1 << BLOCK.bit_length()) - 1
    for at in range(0, len(data) - SIZE + 1, BLOCK):
        stop = min(at + BLOCK, len(data) - SIZE + 1)
        free = ~barred[at:stop]
        if not free.any():
            continue
        hashes = gram_hashes(data[at : stop + SIZE - 1])
        # The place in the low bits: of equal hashes the leftmost is the owner.
        ranked = (hashes & np.uint64(~places & (1 << 64) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        owner = (sliding_least(ranked, SPAN) & np.uint64(places)).astype(np.int64)
        owner[~free] = -1
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        last = np.append(first[1:], len(owner)) - 1
        real = owner[first] >= 0
        first, last = first[real], last[real]
        found = owner[first]
        # Owners have small hashes; once more multiplied, their bits are even again.
        key = hashes[found] * np.uint64(_MIX[0])
        yield at + found, at + first, at + last, (key ^ key >> np.uint64(32)).view(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column one after the other, and where each value begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    values = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return values[edges[0] : edges[-1]], edges - edges[0]


def _copied(out: np.ndarray, at: np.ndarray, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
    """Write ``data[first[i]:first[i] + sizes[i]]`` to ``out`` at ``at[i]``, some thousand slices at a time."""
    for row in range(0, len(first), _SLICES):
        some = sizes[row : row + _SLICES]
        edges = np.cumsum(some) - some
        ahead = np.arange(int(some.sum()))
        out[np.repeat(at[row : row + _SLICES] - edges, some) + ahead] = data[np.repeat(first[row : row + _SLICES] - edges, some) + ahead]


def _slices(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> pa.Array:
    """``data[first[i]:stop[i]]`` as a binary column."""
    edges = np.append(0, np.cumsum(stop - first))
    picked = np.empty(edges[-1], np.uint8)
    _copied(picked, edges[:-1], data, first, stop - first)
    return pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(picked)]
    )


def _padded(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The slices as rows of big-endian words, so that words compare as bytes do."""
    rows = np.zeros((len(first), width), np.uint8)
    _copied(rows.ravel(), np.arange(len(first)) * width, data, first, sizes)
    return rows.view("<u8").byteswap(inplace=True)


def multikey_order(keys: np.ndarray, order: np.ndarray, mark: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of words, stable over ``order``.

    Word by word, the rows that are still equal are parted by their next word; rows that stand
    alone are left out of further words. Returns the sorted order, where a new value begins in
    it, and where a new value of the first ``mark`` words begins.
    """
    order = order.copy()
    new = np.zeros(len(order), bool)
    new[:1] = True
    marked = new.copy()
    live = np.arange(len(order))
    for word in range(keys.shape[1]):
        if len(live):
            group = np.cumsum(new[live])
            values = keys[order[live], word]
            by = np.lexsort((values, group))
            order[live] = order[live][by]
            values = values[by]
            new[live[1:]] |= values[1:] != values[:-1]
        if word + 1 == mark:
            marked = new.copy()
        if len(live):
            alone = new & np.append(new[1:], True)
            live = live[~alone[live]]
    return order, new, marked


def _repeats(order: np.ndarray, new: np.ndarray, ids: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which sorted rows are not the first of their value; the same place twice is one."""
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    return np.logical_or.reduce([column[order] != column[first] for column in ids]) if len(order) else new


class Suffixes:
    """Rows of ``_SUFFIXES`` in memory."""

    def __init__(self, ids: np.ndarray, th: np.ndarray, lo: np.ndarray, wins: np.ndarray, around: np.ndarray, edges: np.ndarray, left: np.ndarray):
        self.ids, self.th, self.lo, self.wins = ids, th, lo, wins
        self.around, self.edges, self.left = around, edges, left

    def sort(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the bytes from the gram on, then those before it, then place."""
        start, sizes = self.edges[:-1], np.diff(self.edges)
        after = _padded(self.around, start + self.left, sizes - self.left, 104)
        before = _padded(self.around, start, self.left, 72)
        lengths = (self.left << 32 | sizes).astype(np.uint64)[:, None]
        places = np.lexsort((self.lo, self.th, self.ids))
        return multikey_order(np.hstack([after, before, lengths]), places, GRAM // 8)

    def columns(self, rows: np.ndarray, whole: bool) -> list[pa.Array]:
        """Rows of ``_FOUND``, with the bytes or without."""
        found = [pa.array(c[rows], t) for c, t in ((self.ids, pa.int64()), (self.th, pa.int64()), (self.lo, pa.int32()), (self.wins, pa.int32()))]
        if whole:
            around = _slices(self.around, self.edges[:-1][rows], self.edges[1:][rows]).cast(pa.binary())
            return [*found, pa.array(self.left[rows], pa.int32()), around]
        return [*found, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())]

    def repeated_windows(self, rows: np.ndarray) -> list[pa.Array]:
        """Of the windows of ``rows``, those that another of them holds at an earlier place."""
        many = self.wins[rows]
        owner = np.repeat(rows, many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        words = _padded(self.around, self.edges[owner] + step, np.full(len(owner), SIZE), 104)
        at = self.lo[owner] + step
        ids = (self.ids[owner], self.th[owner], at)
        order, new, _ = multikey_order(words, np.lexsort(ids[::-1]))
        again = np.zeros(len(owner), bool)
        again[order] = _repeats(order, new, ids)
        # Neighbours of one row become one run.
        found = np.flatnonzero(again)
        fresh = np.append(True, (np.diff(found) != 1) | (owner[found[1:]] != owner[found[:-1]]))[: len(found)]
        runs = found[fresh]
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(found)))
        return [
            pa.array(ids[0][runs], pa.int64()), pa.array(ids[1][runs], pa.int64()), pa.array(at[runs], pa.int32()),
            pa.array(sizes, pa.int32()), pa.nulls(len(runs), pa.int32()), pa.nulls(len(runs), pa.binary()),
        ]


_NAMES = ["id", "th", "lo", "wins", "before", "around"]


def resolve(rows: Suffixes, whole: bool) -> Iterator[pa.RecordBatch]:
    """All that one bucket of the suffix sort can tell.

    A suffix that equals an earlier one in all bytes its windows reach is a repeat as a whole.
    Of those left, suffixes of the same gram are compared window by window. Unless the bucket
    holds ``whole`` grams, its first and last may go on in the next bucket: what is left of them
    is handed on, as are grams with too many neighbourhoods.
    """
    if not len(rows.ids):
        return
    order, new, gram = rows.sort()
    again = _repeats(order, new, (rows.ids, rows.th, rows.lo))
    yield pa.RecordBatch.from_arrays(rows.columns(order[again], False), _NAMES)
    first = np.flatnonzero(new)
    group = np.cumsum(gram)[first]
    sizes = np.bincount(group)
    on = sizes[group] > TOGETHER
    if not whole:
        on |= (group == 1) | (group == group[-1])
    yield pa.RecordBatch.from_arrays(rows.columns(order[first[on]], True), _NAMES)
    open_ = ~on & (sizes[group] > 1)
    left, their = order[first[open_]], group[open_]
    ends = np.cumsum(rows.wins[left])
    at = 0
    while at < len(left):
        # Whole grams, about a quarter of a million windows.
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK)))
        stop = int(np.searchsorted(their, their[stop - 1], "right"))
        yield pa.RecordBatch.from_arrays(rows.repeated_windows(left[at:stop]), _NAMES)
        at = stop


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    sure = table.filter(pa.compute.is_null(table["suffix"]))
    for batch in sure.to_batches():
        nothing = [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *nothing], _NAMES)
    table = table.filter(pa.compute.is_valid(table["suffix"])).combine_chunks()
    if not table.num_rows:
        return
    columns = [table[n].combine_chunks() for n in table.column_names]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    before, left_edges = _flat(columns[5])
    after, right_edges = _flat(columns[4])
    left, right = np.diff(left_edges), np.diff(right_edges)
    edges = np.append(0, np.cumsum(left + right))
    around = np.empty(edges[-1], np.uint8)
    _copied(around, edges[:-1], before, left_edges[:-1], left)
    _copied(around, edges[:-1] + left, after, right_edges[:-1], right)
    ids, th, lo, wins = (c.to_numpy().astype(np.int64) for c in columns[:4])
    yield from resolve(Suffixes(ids, th, lo, wins, around, edges, left), whole=False)


def _boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that buckets handed on, all of a gram in one partition."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    ids, th, lo, wins, left = (table[n].to_numpy().astype(np.int64) for n in _NAMES[:5])
    column = table["around"].combine_chunks()
    around, edges = _flat(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    yield from resolve(Suffixes(ids, th, lo, wins, around, edges, left), whole=True)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the keys, as pages of 2 ** 16; a page's keys are all in one partition."""
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        place = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        order = np.argsort(place)
        for page in np.split(place[order], np.flatnonzero(np.diff(place[order] >> np.uint64(16))) + 1):
            if len(page):
                bits = pages.setdefault(int(page[0] >> np.uint64(16)), np.zeros(1 << 16, bool))
                bits[(page & np.uint64(0xFFFF)).astype(np.int64)] = True
    if pages:
        packed = [np.packbits(bits, bitorder="little").tobytes() for bits in pages.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array(packed, pa.binary())], ["page", "bits"])


def key_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``2 ** BITS`` bits of the column ``key``, put together from pages made in tasks."""
    dealt = keys.select("key").repartition(F.shiftrightunsigned("key", 64 - BITS + 16))
    found = np.zeros(1 << (BITS - 3), np.uint8)
    for page, bits in map_batches(dealt, _pages, "page int, bits binary").toLocalIterator():
        found[page << 13 : (page + 1) << 13] = np.frombuffer(bits, np.uint8)
    return found


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the bitmap; others' bits may be set by chance."""
    place = keys.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each owner's hash occurs, added up within blocks."""
    for batch in batches:
        data, edges = _flat(batch.column(2))
        for _, _, _, hashes in owned_runs(data, edges):
            keys, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every owner with its place: ``id, th, key, at``, at being the first window's start."""
    for batch in batches:
        data, edges = _flat(batch.column(2))
        ids, th = (batch.column(i).to_numpy() for i in (0, 1))
        for _, first, _, hashes in owned_runs(data, edges):
            text = np.searchsorted(edges, first, "right") - 1
            columns = [ids[text], th[text], hashes, (first - edges[text]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "th", "key", "at"])


def _merged(ids: np.ndarray, th: np.ndarray, lo: np.ndarray, wins: np.ndarray) -> list[np.ndarray]:
    """Runs of windows, with those that follow one another in a text made one."""
    order = np.lexsort((lo, th, ids))
    ids, th, lo, wins = (c[order] for c in (ids, th, lo, wins))
    new = np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (lo[1:] != lo[:-1] + wins[:-1]))
    first = np.flatnonzero(new[: len(ids)])
    return [ids[first], th[first], lo[first], np.add.reduceat(wins, first) if len(first) else wins]


def _combined(held: list[Suffixes]) -> Iterator[pa.RecordBatch]:
    """What a task found, each neighbourhood once; repeats among them are told without bytes."""
    plain = [np.concatenate([getattr(r, n) for r in held]) for n in ("ids", "th", "lo", "wins")]
    sizes = np.concatenate([np.diff(r.edges) for r in held])
    around = np.concatenate([r.around for r in held])
    rows = Suffixes(*plain, around, np.append(0, np.cumsum(sizes)), np.concatenate([r.left for r in held]))
    order, new, _ = rows.sort()
    again = _repeats(order, new, (rows.ids, rows.th, rows.lo))
    told = _merged(*(c[order[again]] for c in plain))
    nothing = [pa.nulls(len(told[0]), pa.binary())] * 2
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ["id", "th", "lo", "wins", "suffix", "before"]
    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(told, kinds, strict=True)), *nothing], names)
    left = order[~again]
    for at in range(0, len(left), 50_000):
        some = left[at : at + 50_000]
        start, middle, stop = rows.edges[some], rows.edges[some] + rows.left[some], rows.edges[some + 1]
        parts = [_slices(around, middle, stop).cast(pa.binary()), _slices(around, start, middle).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*rows.columns(some, False)[:4], *parts], names)


def _suffixes(wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes whose gram occurs twice, combined within the task.

    ``wanted`` is the bitmap of such grams, or None where the rows list their places.
    """
    held, size = [], 0
    for batch in batches:
        data, edges = _flat(batch.column(2))
        ids, th = (batch.column(i).to_numpy() for i in (0, 1))
        if wanted is None:
            lists = batch.column(3)
            at = np.repeat(edges[:-1], lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()
        for owner, first, last, keys in owned_runs(data, edges):
            keep = np.isin(first, at) if wanted is None else in_bits(wanted.value, keys)
            owner, first, last = owner[keep], first[keep], last[keep]
            if not len(owner):
                continue
            text = np.searchsorted(edges, first, "right") - 1
            around, starts = _flat(_slices(data, first, last + SIZE))
            held.append(Suffixes(ids[text], th[text], first - edges[text], last - first + 1, around, starts, owner - first))
            size += len(around)
            if size > COMBINED:
                yield from _combined(held)
                held, size = [], 0
    if held:
        yield from _combined(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the rows handed on."""
    for batch in batches:
        around, edges = _flat(batch.column(5))
        ids, th, lo, wins = (batch.column(i).to_numpy() for i in range(4))
        for at in range(0, len(ids), 1024):
            rows = np.arange(at, min(at + 1024, len(ids)))
            owner = np.repeat(rows, wins[rows])
            step = np.arange(len(owner)) - np.repeat(np.cumsum(wins[rows]) - wins[rows], wins[rows])
            start = edges[owner] + step
            window = _slices(around, start, start + SIZE).cast(pa.binary())
            columns = [pa.array(ids[owner]), pa.array(th[owner]), pa.array((lo[owner] + step).astype(np.int32)), window]
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "lo", "window"])


def _spans(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows, packed as start and number, to the maximal runs of bytes they cover."""
    packed = np.sort(packed)
    first = packed >> 32
    reach = np.maximum.accumulate(first + (packed & 0xFFFFFFFF) + SIZE - 1)
    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return first[new], reach[np.append(new[1:], len(first)) - 1]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, copy, data, runs`` -> the removed spans and what is left."""
    for batch in batches:
        made, held, since = [], 0, 0
        for row in range(batch.num_rows):
            data = batch.column(2)[row].as_buffer()
            runs = batch.column(3)[row].values
            starts = stops = np.zeros(0, np.int64)
            if batch.column(1)[row].as_py() > 1 and len(data) >= SIZE:
                starts, stops = np.zeros(1, np.int64), np.full(1, len(data))
            elif runs is not None:
                starts, stops = _spans(runs.to_numpy())
            edges = np.ravel(np.column_stack([starts, stops])).tolist()
            view = memoryview(data)
            kept = b"".join(view[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(data)], strict=True))
            made.append((len(data), starts, stops, kept))
            held += len(kept)
            if held > _HELD or row == batch.num_rows - 1:
                sizes, starts_of, stops_of, kept_of = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(since, len(made)), pa.array(sizes, pa.int64()),
                        pa.array(starts_of, pa.list_(pa.int64())), pa.array(stops_of, pa.list_(pa.int64())),
                        pa.array(kept_of, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "starts", "stops", "kept"],
                )
                made, held, since = [], 0, row + 1


def repeated_runs(rows: DataFrame, max_bitmap: int = MAX_BITMAP) -> DataFrame:
    """``id, th, data`` -> ``id, th, lo, wins``: windows ``lo`` to ``lo + wins - 1`` occur earlier."""
    spark = rows.sparkSession
    texts = rows.where(F.octet_length("data") >= SIZE)
    counted = map_batches(texts, _grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    shared = saved(counted.where("n > 1"), "shared_grams")
    grams, places = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if grams <= max_bitmap:
        bits = spark.sparkContext.broadcast(key_bits(shared))
        suffixes = map_batches(texts, lambda batches: _suffixes(bits, batches), _SUFFIXES)
    else:
        listed = (
            map_batches(texts, _places, "id long, th long, key long, at int")
            .join(shared.select("key"), "key", "left_semi")
            .groupBy("id", "th").agg(F.collect_set("at").alias("listed"))
        )
        suffixes = map_batches(texts.join(listed, ["id", "th"]), lambda batches: _suffixes(None, batches), _SUFFIXES)
    buckets = max(spark.sparkContext.defaultParallelism, -(-places // BUCKET))
    dealt = suffixes.repartitionByRange(buckets, "suffix", "before", "id", "th", "lo")
    found = saved(map_batches(dealt, _bucket, _FOUND), "suffix_buckets")
    told = found.where("around IS NULL").select("id", "th", "lo", "wins")

    # What the buckets handed on: grams that lie across boundaries meet once more.
    handed = found.where("around IS NOT NULL").withColumn("gram", F.expr(f"substring(around, before + 1, {GRAM})"))
    sized = handed.join(handed.groupBy("gram").agg(F.count("*").alias("many")), "gram")
    near = sized.where(F.col("many") <= HANDED).repartition("gram").select(*_NAMES)
    met = saved(map_batches(near, _boundary, _FOUND), "boundary_grams")

    # And grams with too many neighbourhoods for a task: each of their windows for itself.
    far = met.where("around IS NOT NULL").union(sized.where(F.col("many") > HANDED).select(*_NAMES))
    place = F.struct("id", "th", "lo")
    windows = saved(map_batches(far, _windows, "id long, th long, lo int, window binary"), "windows")
    first = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = windows.join(first.select("window", "first"), "window").where(place != F.col("first"))
    told = told.union(met.where("around IS NULL").select("id", "th", "lo", "wins"))
    return told.union(later.select("id", "th", "lo", F.lit(1).alias("wins")))


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bitmap: int = MAX_BITMAP
) -> DataFrame:
    """Take out each byte covered by a ``SIZE``-byte string that also starts earlier.

    Earlier means in a text of smaller id, or further left in the same text. Texts count as UTF-8
    bytes, strings are judged on the input, matches do not cross texts.

    Returns ``doc_id, n_bytes, starts, stops, kept``: the maximal removed runs and the bytes left.

    A null text counts as empty. The id must be a whole number; a null one comes before all
    others. Texts that share an id follow one another by checksum (XXH64); of rows that are
    equal in id and text the first is judged like any, the others are repeats as a whole. An
    empty table gives an empty result. Other columns are not read.

    Scale: suffixes are range-partitioned by their leading bytes and, where these are equal, by
    place, so that the copies of one text, however many, spread over buckets. A task holds one
    bucket or one text.
    """
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(data).alias("th"), data.alias("data"),
    )
    runs = repeated_runs(rows.select("id", "th", "data"), max_bitmap)
    packed = runs.groupBy("id", "th").agg(
        F.collect_list(F.expr("shiftleft(cast(lo AS long), 32) | wins")).alias("runs")
    )
    numbered = rows.join(packed, ["id", "th"], "left").withColumn(
        "copy", F.row_number().over(Window.partitionBy("id", "th").orderBy("doc_id"))
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(
        numbered.select("doc_id", "copy", "data", "runs"), _kept,
        f"doc_id {kind}, n_bytes long, starts array<long>, stops array<long>, kept binary",
    )


def oracle_sql() -> str:
    """The counts and what is left, in SQL (DuckDB), over the digits of each text's bytes."""
    two = 2 * SIZE
    return f"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
windows AS (
  SELECT doc_id, CAST(pos AS BIGINT) AS pos, substr(digits, 2 * pos + 1, {two}) AS bytes
  FROM (SELECT doc_id, digits, unnest(range(0, length(digits) // 2 - {SIZE - 1})) AS pos
        FROM texts WHERE length(digits) >= {two})),
numbered AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, pos) AS place FROM windows),
again AS (
  SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {SIZE} AS goes_on
  FROM numbered WHERE place > 1),
runs AS (
  SELECT doc_id, pos, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run
  FROM again),
spans AS (SELECT doc_id, run, min(pos) AS start, max(pos) + {SIZE} AS stop FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, run, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY run), 0) AS since FROM spans),
left_over AS (
  SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS last,
         string_agg(substr(digits, 2 * since + 1, 2 * (start - since)), '' ORDER BY run) AS kept
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(digits) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN digits ELSE kept || substr(digits, 2 * last + 1) END)) AS kept_sha256
FROM texts LEFT JOIN left_over USING (doc_id)
"""
