"""Near-duplicates by 64-bit SimHash fingerprints and bit-sliced comparison."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import fresh, map_batches, saved, texts, words
from basketflow.llm.components import connected_components

SHINGLE = 3
SEED = 42
#: Fingerprints with this many differing bits or fewer are linked.
RADIUS = 3
#: The bits are cut into so many runs. Within the radius two runs at least are equal, so each
#: pair of linked fingerprints meets in the bucket of some pair of runs (25 or 26 bits).
RUNS = RADIUS + 2
#: Members of a bucket that are compared in one task at most; larger buckets are cut up.
BLOCK = 2048
#: Comparisons (of one fingerprint with 64 others) made side by side.
LANES = 16384

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles."""
    found = words(text)
    if not found:
        return 0
    if len(found) <= SHINGLE:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start : start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in texts(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"]
        )


def transpose(values: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: ``planes[k, p]`` has bit p of the k-th 64."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[..., 0]


def within_radius(query: np.ndarray, block: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Which members of ``block[i]`` differ from the fingerprint ``query[i]`` in few bits.

    The 64 distances of a comparison are counted at once, in carry-save counters of
    ``radius.bit_length()`` bits that overflow as soon as the radius is passed. A comparison is
    given up when all its members have overflowed. Returns the indices i that have matches,
    and the 64 match bits of each.
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    live = np.arange(len(query))
    counters = [np.full(len(query), _ALL if start >> b & 1 else 0, np.uint64) for b in range(width)]
    over = ~valid[block]
    for plane in range(64):
        ones = (np.uint64(0) - ((query >> np.uint64(plane)) & np.uint64(1)))
        carry = planes[block, plane] ^ ones
        for b in range(width):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if plane % 4 == 3:
            keep = np.flatnonzero(over != _ALL)
            if len(keep) < len(live):
                live, query, block, over = live[keep], query[keep], block[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(live):
                    break
    return live, ~over


def _least_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; a label is the least member of its class."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up


def link_groups(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the classes of each group ``values[starts[i]:starts[i + 1]]``."""
    sizes = np.diff(starts)
    blocks = -(-sizes // 64)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - starts[:-1][group]
    slot = first_block[:-1][group] * 64 + place
    padded = np.zeros(first_block[-1] * 64, np.uint64)
    padded[slot] = values
    used = np.zeros(len(padded), np.uint8)
    used[slot] = 1
    member = np.zeros(len(padded), np.int64)
    member[slot] = np.arange(len(values))
    valid = np.packbits(used.reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 8).view("<u8")[:, 0]
    planes = transpose(padded)
    labels = np.arange(len(values))
    # A member is compared with its own block and the later ones.
    many = blocks[group] - place // 64
    ends = np.cumsum(many)
    at = 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LANES, "right")))
        who = np.repeat(np.arange(at, stop), many[at:stop])
        step = np.arange(len(who)) - np.repeat(ends[at:stop] - many[at:stop] - (ends[at - 1] if at else 0), many[at:stop])
        block = slot[who] // 64 + step
        live, bits = within_radius(values[who], block, planes, valid)
        for some in range(0, len(live), 4096):
            part, found = live[some : some + 4096], bits[some : some + 4096]
            row, lane = np.nonzero(np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            labels = _least_labels(labels, who[part[row]], member[block[part[row]] * 64 + lane])
        at = stop
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[labels[linked]], values[linked]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group is held until its last row is seen."""
    rest_key, rest_fp = np.zeros((3, 0), np.int64), np.zeros(0, np.uint64)

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        a, b = link_groups(fps, np.concatenate([[0], new, [len(fps)]]))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([rest_key, np.stack([c.to_numpy() for c in batch.columns[:3]])], axis=1)
        fps = np.concatenate([rest_fp, batch.column(3).to_numpy().view(np.uint64)])
        if len(fps) < 4 * BLOCK:
            rest_key, rest_fp = keys, fps
            continue
        cut = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0))[-1]) + 1 if (keys != keys[:, -1:]).any() else 0
        if cut:
            yield out(keys[:, :cut], fps[:cut])
        rest_key, rest_fp = keys[:, cut:].copy(), fps[cut:].copy()
    if len(rest_fp):
        yield out(rest_key, rest_fp)


def _bucket_keys(fp: str) -> list[str]:
    """SQL for the bucket of each pair of runs; the pair's number is in the upper bits."""
    edges = [round(64 * i / RUNS) for i in range(RUNS + 1)]

    def run(i: int) -> str:
        return f"(shiftrightunsigned({fp}, {edges[i]}) & {(1 << (edges[i + 1] - edges[i])) - 1}L)"

    return [
        f"({n}L << 40) | ({run(i)} << 20) | {run(j)}"
        for n, (i, j) in enumerate(combinations(range(RUNS), RUNS - RADIUS))
    ]


def near_links(nodes: DataFrame) -> DataFrame:
    """``fp`` (distinct longs) -> links ``(a, b)`` with the components of all pairs within the radius.

    Every fingerprint goes to the buckets of its equal runs, so no pair is lost. Buckets of
    one member are dropped. A bucket of over ``BLOCK`` members is cut into parts, and each two
    parts meet in a group of their own, so no task holds an unbounded group; a group reports
    a spanning forest of its links, not all pairs.
    """
    keyed = saved(
        nodes.select("fp", F.explode(F.array(*[F.expr(k) for k in _bucket_keys("fp")])).alias("bucket")),
        "buckets",
    )
    sizes = keyed.groupBy("bucket").count().where("count > 1")
    parts = keyed.join(sizes, "bucket").selectExpr(
        "bucket", "fp", f"cast(ceil(count / {BLOCK // 2}) AS int) AS parts"
    )
    mine = "cast(pmod(xxhash64(fp), parts) AS int)"
    met = parts.selectExpr(
        "bucket", "fp", f"{mine} AS mine",
        "explode(if(parts = 1, array(0), sequence(0, parts - 1))) AS other",
    ).selectExpr("bucket", "cast(least(mine, other) AS long) AS lo", "cast(greatest(mine, other) AS long) AS hi", "fp")
    dealt = met.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return map_batches(dealt, _links, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every row and the smallest id reachable over links.

    Returns ``doc_id, fingerprint, component_id``; fingerprint as 16 hex digits.

    Null and blank texts have fingerprint zero and are linked like others. Repeated rows and
    ids are kept. A null id takes part in linking but never names a component (the component
    is null if all its ids are). An empty table gives an empty result. Other columns are not
    read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    prints = saved(map_batches(source, _fingerprints, f"doc_id {kind}, fp long"), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint_nodes")
    roots = saved(connected_components(near_links(nodes.select("fp"))), "fingerprint_roots")
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").selectExpr(
        "fp", "least_id", "coalesce(root, fp) AS root"
    )
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the smallest id.

    Exactly one row of each group stays. Among rows that share the smallest id it is the one
    with the smallest checksum (XXH64 of the text), with equal ones any. A row with a null id
    is kept only where its whole group has no other. Columns are those of ``docs``. The rows
    are written once with a number, by which the chosen ones are found again.
    """
    (row,) = fresh(docs, "row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    key = F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("checksum"), F.col(row).alias("row"),
    )
    groups = simhash_groups(rows.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text")
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id.row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
