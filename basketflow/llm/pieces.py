"""SentencePiece encoding as a max-plus scan, and decoding."""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import map_batches, saved

#: A model file that every executor can read.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Code points of a chunk; longer documents are encoded by several tasks.
CHUNK = 16384
#: What pieces score. The file ranks its pieces (score -rank). "log_rank" takes them to be
#: distributed by Zipf's law, which keeps common words whole; "file" adds the file's scores.
SCORES = ("log_rank", "file")
_ZIPF_SHIFT = 50.0
#: Log scores are multiples of this, so that sums are exact and need no order of addition.
_GRAIN = 2.0**-20
#: Scores below this mark pieces of last resort, which set no scale.
_LAST_RESORT = -1e8
#: Words whose pieces a task remembers.
_REMEMBERED = 300_000
_NONE = -math.inf

#: Units of up to so many characters are solved together with others.
_SHORT = 48


@dataclass
class Pieces:
    """Vocabulary of a model: scores and ids by piece, bytes by id, and a trie of the pieces.

    ``classes`` numbers the characters that occur in pieces, 0 for the others; ``inside`` has
    the pairs of characters that are neighbours in some piece: no piece crosses others.
    ``edges`` (sorted) has node * 65536 + class for each step in the trie, ``nodes`` where it
    leads, ``node_ids`` and ``node_scores`` the piece that ends there (-1, minus infinity).
    """

    scores: dict[str, float]
    ids: dict[str, int]
    raw: list[bytes]
    byte_ids: list[int]
    byte_score: float
    longest: int
    classes: np.ndarray
    inside: np.ndarray
    edges: np.ndarray
    nodes: np.ndarray
    node_ids: np.ndarray
    node_scores: np.ndarray


def load_pieces(path: str, scores_by: str = "log_rank") -> Pieces:
    """Read a model file; its control and unknown pieces are never used.

    A byte of a character without a piece costs a third more than the worst common piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, ids, byte_ids = {}, {}, [0] * 256
    raw = [b""] * model.get_piece_size()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            scores[piece], ids[piece] = model.get_score(i), i
            raw[i] = piece.replace(SPACE, " ").encode()
    worst = min(s for s in scores.values() if s > _LAST_RESORT)
    if scores_by == "log_rank":  # pieces of last resort, runs of spaces, rank last
        scores = {p: -round(math.log(_ZIPF_SHIFT - max(s, worst)) / _GRAIN) * _GRAIN for p, s in scores.items()}
        worst = min(scores.values())
    characters = sorted({c for piece in scores for c in piece})
    number = {c: i for i, c in enumerate(characters, 1)}
    classes = np.zeros(0x110000, np.int32)
    classes[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    inside = np.zeros((len(characters) + 1, len(characters) + 1), bool)
    steps: dict[int, int] = {}
    ends: dict[int, str] = {}
    for piece in scores:
        node = 0
        for c in piece:
            node = steps.setdefault(node << 16 | number[c], len(steps) + 1)
        ends[node] = piece
        for a, b in zip(piece, piece[1:], strict=False):
            inside[number[a], number[b]] = True
    keys = np.fromiter(steps, np.int64, len(steps))
    order = np.argsort(keys)
    node_ids, node_scores = np.full(len(steps) + 1, -1), np.full(len(steps) + 1, _NONE)
    for node, piece in ends.items():
        node_ids[node], node_scores[node] = ids[piece], scores[piece]
    return Pieces(
        scores, ids, raw, byte_ids, round(worst * 4 / 3 / _GRAIN) * _GRAIN, max(map(len, scores)),
        classes, inside, keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order], node_ids, node_scores,
    )


def class_numbers(vocabulary: Pieces, s: str) -> np.ndarray:
    return vocabulary.classes[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]


def cut_positions(vocabulary: Pieces, s: str) -> list[int]:
    """Positions within a text that no piece crosses."""
    if len(s) < 2:
        return []
    found = class_numbers(vocabulary, s)
    return (np.flatnonzero(~vocabulary.inside[found[:-1], found[1:]]) + 1).tolist()


def solve(vocabulary: Pieces, units: list[str]) -> list[tuple[float, list[int]]]:
    """Best score and pieces of many short units, whose characters all occur in pieces.

    The trie is walked from all positions at once; then the positions of all units are
    settled from left to right, those with one distance from their unit's start together.
    The same rules as in :func:`forward`.
    """
    sizes = np.array([len(u) for u in units])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a place more for each unit's end
    n = int(starts[-1])
    letters = np.zeros(n, np.int64)
    flat = class_numbers(vocabulary, "".join(units))
    owner = np.repeat(np.arange(len(units)), sizes)
    letters[np.arange(len(flat)) + owner] = flat  # the end has class 0, at which every walk stops
    longest = min(vocabulary.longest, int(sizes.max()))
    piece = np.full((longest, n), -1, np.int32)
    score = np.full((longest, n), _NONE)
    at, node = np.arange(n), np.zeros(n, np.int64)
    for size in range(longest):
        keys = node << 16 | letters[at + size]
        place = np.minimum(np.searchsorted(vocabulary.edges, keys), len(vocabulary.edges) - 1)
        found = vocabulary.edges[place] == keys
        at, node = at[found], vocabulary.nodes[place[found]]
        piece[size, at], score[size, at] = vocabulary.node_ids[node], vocabulary.node_scores[node]
        inside = at + size + 1 < n
        at, node = at[inside], node[inside]
    first = starts[:-1]
    best, back = np.full(n, _NONE), np.full(n, -1, np.int32)
    best[first] = 0.0
    alone = score[0] == _NONE  # a character that is in pieces but is none
    spelled = {}
    for i in np.flatnonzero(alone & (letters > 0)):
        u = int(np.searchsorted(starts, i, "right")) - 1
        raw = units[u][i - starts[u]].encode()
        spelled[int(i)] = [vocabulary.byte_ids[b] for b in raw]
        score[0, i], piece[0, i] = vocabulary.byte_score * len(raw), -2
    for distance in range(int(sizes.max())):
        from_ = first[sizes > distance] + distance
        room = sizes[sizes > distance] - distance
        for size in range(min(longest, int(room.max()))):
            p = from_[room > size]
            q = p + size + 1
            value = best[p] + score[size, p]
            better = value > best[q]
            best[q[better]], back[q[better]] = value[better], size + 1
    found: list[list[int]] = [[] for _ in units]
    place, who = first + sizes, np.arange(len(units))
    while len(who):
        size = back[place]
        going = size > 0
        place, who, size = place[going], who[going], size[going]
        before = place - size
        for u, i, p in zip(who.tolist(), piece[size - 1, before].tolist(), before.tolist(), strict=True):
            if i >= 0:
                found[u].append(i)
            else:
                found[u].extend(reversed(spelled[p]))
        place = before
    return [(s, ids[::-1]) for s, ids in zip(best[first + sizes].tolist(), found, strict=True)]


def forward(vocabulary: Pieces, s: str, begin: int, stop: int) -> tuple[list[float], list[int]]:
    """Best score of every position from ``begin``, and where its last piece starts.

    Pieces start before ``stop`` and may end after it. Of equal scores the longer last piece
    stays. A character that is no piece is spelled in bytes.
    """
    n, longest, get = len(s), vocabulary.longest, vocabulary.scores.get
    best, back = [_NONE] * (n + 1), [-1] * (n + 1)
    best[begin] = 0.0
    for p in range(begin, stop):
        b = best[p]
        if b == _NONE:
            continue
        for q in range(p + 1, min(n, p + longest) + 1):
            score = get(s[p:q])
            if score is not None and b + score > best[q]:
                best[q], back[q] = b + score, p
        if s[p] not in vocabulary.scores:
            score = b + vocabulary.byte_score * len(s[p].encode())
            if score > best[p + 1]:
                best[p + 1], back[p + 1] = score, p
    return best, back


def backtrace(vocabulary: Pieces, s: str, back: list[int], end: int) -> list[int]:
    found: list[int] = []
    while back[end] >= 0:
        piece = s[back[end] : end]
        i = vocabulary.ids.get(piece)
        found.extend([i] if i is not None else [vocabulary.byte_ids[b] for b in reversed(piece.encode())])
        end = back[end]
    found.reverse()
    return found


class Encoder(dict):
    """Encodes text unit by unit. Units are numbered and remembered, since most recur."""

    def __init__(self, vocabulary: Pieces):
        super().__init__()
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.scores, self.sizes, self.starts = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        number = self[unit] = len(self)
        return number

    def units(self, s: str) -> list[str]:
        """The parts of a text between cuts."""
        if not s:
            return []
        cuts = [0, *cut_positions(self.vocabulary, s), len(s)]
        return [s[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _settle(self) -> None:
        """Solve the units that have been numbered since the last time."""
        found: dict[str, tuple[float, list[int]]] = {}
        short = [u for u in self.new if len(u) <= _SHORT and (len(u) > 1 or u in self.vocabulary.scores)]
        for start in range(0, len(short), 20_000):
            part = short[start : start + 20_000]
            found.update(zip(part, solve(self.vocabulary, part), strict=True))
        for u in self.new:
            if u not in found:
                best, back = forward(self.vocabulary, u, 0, len(u))
                found[u] = best[-1], backtrace(self.vocabulary, u, back, len(u))
        solved = [found[u] for u in self.new]
        sizes = np.array([len(ids) for _, ids in solved], np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.scores = np.concatenate([self.scores, [score for score, _ in solved]])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids for _, ids in solved), np.int32, int(sizes.sum()))])
        self.new = []

    def encode_many(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all texts in a row, where each text's end, and the scores."""
        if len(self) > _REMEMBERED:
            self.forget()
        units = [self.units(s) for s in marked]
        until = np.cumsum([0, *map(len, units)])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(units)), np.int64, int(until[-1]))
        if self.new:
            self._settle()
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        within = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
        flat = self.flat[np.repeat(self.starts[numbers], sizes) + within]
        # Scores are multiples of one grain, so differences of running sums are exact.
        sums = np.concatenate([[0.0], np.cumsum(self.scores[numbers])])
        return flat, ends[until], sums[until[1:]] - sums[until[:-1]]

    def encode(self, s: str) -> tuple[float, list[int]]:
        """Best score and pieces of a text whose spaces are marked."""
        flat, _, scores = self.encode_many([s])
        return float(scores[0]), flat.tolist()

    def ends(self, s: str, size: int) -> tuple[int, int] | None:
        """The first and the last place of the chunk ``s[:size]`` that no piece crosses."""
        cuts = [c for c in cut_positions(self.vocabulary, s) if c <= size]
        return (cuts[0], cuts[-1]) if cuts else None

    def matrix(self, s: str, size: int, ends: tuple[int, int] | None, middle: float) -> np.ndarray:
        """Best scores from each entry to each exit of the chunk ``s[:size]``.

        Entry i: a piece of the chunk before covers the first i characters. Exit j: the last
        piece covers j characters of what follows (the rest of ``s``). Between the first and
        the last cut (``ends``) there is one way only, so its score ``middle`` is added to what
        leads up to it.
        """
        width = self.vocabulary.longest
        first, last = ends or (size, 0)
        table = np.full((width, width), _NONE)
        tails = np.full(width, _NONE)
        if ends:
            best, _ = forward(self.vocabulary, s[last : size + width], 0, size - last)
            for j in range(min(width, len(s) - size + 1)):
                tails[j] = middle + best[size - last + j]
        for i in range(min(width, first + 1, size + 1)):
            best, _ = forward(self.vocabulary, s[: first + (0 if ends else width)], i, first)
            if ends:
                table[i] = best[first] + tails
            else:
                for j in range(min(width, len(best) - size)):
                    table[i, j] = best[size + j]
        for j in range(size, width):  # a piece that covers the whole chunk and more
            table[j, j - size] = max(table[j, j - size], 0.0) if j > size else table[j, j - size]
        return table

    def around(self, head: str, tail: str | None, size: int, entry: int, leave: int) -> tuple[list[int], list[int]]:
        """The pieces before and after the middle of a chunk, on the best way from ``entry`` to ``leave``.

        ``head`` is what lies before the first cut and ``tail`` what follows the last one, of
        which ``size`` characters are the chunk's. Without a cut the head is all and has no tail.
        """
        if tail is None:
            if entry > size:
                return [], []
            _, back = forward(self.vocabulary, head, entry, size)
            return backtrace(self.vocabulary, head, back, size + leave), []
        _, back = forward(self.vocabulary, head, entry, len(head))
        before = backtrace(self.vocabulary, head, back, len(head))
        _, back = forward(self.vocabulary, tail, 0, size)
        return before, backtrace(self.vocabulary, tail, back, size + leave)

    def raw(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.raw.__getitem__, ids))


def _bytes(s: str) -> bytes:
    return s.replace(SPACE, " ").encode()


def decode_ids(vocabulary: Pieces, ids) -> str:
    """The text of pieces; bytes that are no UTF-8 become replacement characters."""
    text = b"".join([vocabulary.raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of matrices, pair by pair."""
    out = np.empty_like(a)
    for start in range(0, len(a), 64):
        part = slice(start, start + 64)
        out[part] = (a[part, :, :, None] + b[part, None, :, :]).max(axis=2)
    return out


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices: neighbours are combined, then the pairs scanned."""
    n = len(matrices)
    if n == 1:
        return matrices
    pairs = scan(combine(matrices[0 : n - 1 : 2], matrices[1:n:2]))
    out = np.empty_like(matrices)
    out[0] = matrices[0]
    out[1::2] = pairs
    if n > 2:
        out[2::2] = combine(pairs[: (n - 1) // 2], matrices[2::2])
    return out


def boundary_states(matrices: np.ndarray) -> tuple[np.ndarray, float]:
    """How many characters the best way covers beyond each boundary (n + 1), and its score."""
    n = len(matrices)
    before = scan(matrices)[:, 0, :]
    states = np.zeros(n + 1, np.int64)
    for k in range(n - 1, 0, -1):
        states[k] = np.argmax(before[k - 1] + matrices[k][:, states[k + 1]])
    return states, float(before[-1, 0])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _encode_whole(path: str, scores_by: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(load_pieces(path, scores_by))
    for batch in batches:
        marked = [value.as_py() or "" for value in batch.column(1)]
        flat, ends, scores = encoder.encode_many(marked)
        raw = encoder.vocabulary.raw
        same = [
            b"".join(map(raw.__getitem__, flat[a:b].tolist())) == s.replace(SPACE, " ").encode()
            for a, b, s in zip(ends, ends[1:], marked, strict=False)
        ]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        columns = [batch.column(0), lists, pa.array(scores), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "score", "round_trip"])


def _matrices(path: str, scores_by: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk solved once: its matrix, the pieces of its middle, and the text around that."""
    encoder = Encoder(load_pieces(path, scores_by))
    for batch in batches:
        chunks = [s.as_py() for s in batch.column(3)]
        sizes = batch.column(4).to_pylist()
        ends = [encoder.ends(s, n) for s, n in zip(chunks, sizes, strict=True)]
        middles = [s[e[0] : e[1]] if e else "" for s, e in zip(chunks, ends, strict=True)]
        flat, until, scores = encoder.encode_many(middles)
        found, same, heads, tails, rest = [], [], [], [], []
        for i, (s, n, e) in enumerate(zip(chunks, sizes, ends, strict=True)):
            found.append(encoder.matrix(s, n, e, float(scores[i])).ravel())
            same.append(encoder.raw(flat[until[i] : until[i + 1]].tolist()) == _bytes(middles[i]))
            heads.append(s[: e[0]] if e else s)
            tails.append(s[e[1] :] if e else None)
            rest.append(n - e[1] if e else n)
        width = encoder.vocabulary.longest**2
        matrices = pa.ListArray.from_arrays(
            pa.array(np.arange(len(found) + 1, dtype=np.int32) * width), pa.array(np.concatenate(found) if found else np.zeros(0))
        )
        middle = [zstandard.compress(flat[a:b].astype("<i4").tobytes(), 1) for a, b in zip(until, until[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3], matrices, pa.array(middle, pa.binary()), pa.array(same, pa.bool_()), pa.array(heads, pa.string()),
                pa.array(tails, pa.string()), pa.array(rest, pa.int32()),
            ],
            ["row", "doc_id", "chunk", "matrix", "middle", "same", "head", "tail", "rest"],
        )


def _states(table: pa.Table) -> pa.Table:
    """One document's chunks; a document is a row, so they are bounded by what a row may hold."""
    table = table.sort_by("chunk")
    n = table.num_rows
    flat = table.column("matrix").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    width = math.isqrt(len(flat) // n)
    states, score = boundary_states(flat.reshape(n, width, width))
    return pa.table({
        "row": table.column("row"), "chunk": table.column("chunk"), "entry": states[:-1], "leave": states[1:],
        "score": np.full(n, score),
    })


def _backtraces(path: str, scores_by: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's pieces: those around the middle, now that its two states are known."""
    encoder = Encoder(load_pieces(path, scores_by))
    for batch in batches:
        row, chunk, middle, middle_same, head, tail, rest, entry, leave, score = batch.columns
        ids, same = [], []
        for k in range(batch.num_rows):
            h, t, n, i, j = (c[k].as_py() for c in (head, tail, rest, entry, leave))
            before, after = encoder.around(h, t, n, i, j)
            inner = np.frombuffer(zstandard.decompress(middle[k].as_py()), "<i4")
            ids.append(np.concatenate([np.array(before, np.int32), inner, np.array(after, np.int32)]))
            if t is None:
                good = encoder.raw(before) == _bytes(h[i : n + j])
            else:
                good = encoder.raw(before) == _bytes(h[i:]) and encoder.raw(after) == _bytes(t[: n + j])
            same.append(good and middle_same[k].as_py())
        yield pa.RecordBatch.from_arrays([row, chunk, _lists(ids), score, pa.array(same, pa.bool_())], ["row", "chunk", "ids", "score", "same"])


def encode_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK,
    scores: str = "log_rank",
) -> DataFrame:
    """Pieces of each row's text with the best total score.

    Returns ``doc_id, n_tokens, ids, score, round_trip``. Spaces are marked and one is put
    before the text, as the model asks; characters without a piece are spelled in bytes, so
    ``round_trip`` (decoding gives the text back, a literal U+2581 as a space) holds for every
    text. Best is the unigram rule (greatest sum) over ``scores``; see ``SCORES``.

    Texts of up to ``chunk`` code points are encoded in one go. Longer ones are cut into
    chunks that go to tasks of their own: each chunk yields the max-plus matrix of best scores
    from what an earlier piece already covers to what its last piece covers beyond, the
    matrices of a document are combined by an associative scan into the states at the
    boundaries, and each chunk is then traced back by itself between its two states. Of equal
    scores the longer last piece is taken, and at a boundary the smaller overhang.

    Null and empty texts have no pieces, score 0 and a true ``round_trip``. Repeated rows and
    ids, and null ids, give rows of their own. An empty table gives an empty result. Other
    columns are not read.
    """
    if scores not in SCORES:
        raise ValueError(f"scores must be one of {SCORES}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.when(text == "", "").otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))
    source = docs.select(F.col(id_col).alias("doc_id"), marked.alias("s"))
    kind = source.schema["doc_id"].dataType.simpleString()
    short = map_batches(
        source.where(F.length("s") <= chunk).select(F.struct("doc_id").alias("row"), "s"),
        lambda batches: _encode_whole(model, scores, batches),
        f"row struct<doc_id:{kind}>, ids array<int>, score double, round_trip boolean",
    ).select("row.doc_id", "ids", "score", "round_trip")
    ahead = 64  # characters after a chunk that its last piece may cover
    long = source.where(F.length("s") > chunk).withColumn("row", F.monotonically_increasing_id())
    chunks = long.withColumn(
        "chunk", F.explode(F.expr(f"sequence(0, cast((length(s) - 1) div {chunk} AS int))"))
    ).selectExpr(
        "row", "doc_id", "chunk", f"substring(s, chunk * {chunk} + 1, {chunk + ahead}) AS s",
        f"least({chunk}, length(s) - chunk * {chunk}) AS size",
    ).repartition("row", "chunk")
    solved = saved(
        map_batches(
            chunks, lambda batches: _matrices(model, scores, batches),
            f"row long, doc_id {kind}, chunk int, matrix array<double>, middle binary, same boolean,"
            " head string, tail string, rest int",
        ),
        "chunks",
    )
    states = solved.select("row", "chunk", "matrix").groupBy("row").applyInArrow(
        _states, "row long, chunk int, entry long, leave long, score double"
    )
    traced = map_batches(
        solved.join(states, ["row", "chunk"]).select(
            "row", "chunk", "middle", "same", "head", "tail", "rest", "entry", "leave", "score"
        ),
        lambda batches: _backtraces(model, scores, batches),
        "row long, chunk int, ids array<int>, score double, same boolean",
    )
    joined = traced.groupBy("row").agg(
        F.expr("flatten(transform(sort_array(collect_list(struct(chunk, ids))), x -> x.ids))").alias("ids"),
        F.first("score").alias("score"), F.min("same").alias("round_trip"),
    )
    names = solved.where("chunk = 0").select("row", "doc_id")
    whole = joined.join(names, "row").select("doc_id", "ids", "score", "round_trip")
    return short.unionByName(whole).select("doc_id", F.size("ids").alias("n_tokens"), "ids", "score", "round_trip")


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = load_pieces(path)
    for batch in batches:
        decoded = [None if v.as_py() is None else decode_ids(vocabulary, v.as_py()) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], ["row", "text"])


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of rows of pieces; null pieces give a null text, no pieces an empty one."""
    source = encoded.select(F.struct(F.col(id_col).alias("doc_id")).alias("row"), F.col(ids_col).alias("ids"))
    kind = source.schema["row"].dataType.simpleString()
    return map_batches(source, lambda batches: _decode(model, batches), f"row {kind}, text string").select("row.doc_id", "text")
