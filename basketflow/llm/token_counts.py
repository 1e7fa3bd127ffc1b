"""Token counts of fields and sections: documents are encoded once, tokens assigned by offset."""

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import map_batches

#: A rank file that every executor can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text before the merges of that file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Who gets a token that crosses the end of a section: the section of its first byte, of its
#: last byte, or the one with most of its bytes (of equals the first).
RULES = ("first", "last", "most")
#: Between the fields of a document; it belongs to the field before it.
JOINT = b"\n"

#: Fixed value: what the pattern's engine takes for white space.
_BLANK = "[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Runs of white space from this length on are kept from the pattern's engine, which needs a
#: step of its stack for each character and fails at a million.
LONG_RUN = 10_000


def encode(encoding: tiktoken.Encoding, text: str, long_run: int = LONG_RUN) -> list[int]:
    """The tokens of a text, whatever runs of white space it holds.

    The pattern makes one part of a run of white space, less its last character where other
    text follows; that part is given to the merges directly, with what stands before and behind
    it cut by the pattern. The tokens are those of the library for the whole text.
    """
    found, at = [], 0
    for run in re.finditer(f"{_BLANK}{{{long_run},}}", text):
        stop = run.end() - (run.end() < len(text))
        found += encoding.encode_ordinary(text[at : run.start()])
        if stop > run.start():
            found += encoding._encode_single_piece(text[run.start() : stop])
        at = stop
    return found + encoding.encode_ordinary(text[at:])


def load_encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the number of bytes of each token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def sections(text: bytes) -> np.ndarray:
    """Where the lines of a text start; a line break ends a line, and none starts after the last."""
    starts = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], starts[starts < len(text)]])


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Interval join of token byte spans with sections ``bounds[i]:bounds[i + 1]``.

    Both are sorted and tile the document, so each end is one binary search. Empty sections
    share their start with the next and get no token.
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "last":
        return last
    found = first.copy()
    for i in np.flatnonzero(first != last):
        edges = np.clip(bounds[first[i] : last[i] + 2], starts[i], ends[i])
        found[i] += int(np.argmax(np.diff(np.append(edges, ends[i])[: last[i] - first[i] + 2])))
    return found


def _count(path: str, rule: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoding, sizes = load_encoding(path)
    for batch in batches:
        columns = [c.cast(pa.large_binary()) for c in batch.columns[1:]]
        rows: list[np.ndarray] = []
        source = []
        for r in range(batch.num_rows):
            fields = [c[r].as_py() or b"" for c in columns]
            document = JOINT.join(fields)
            lines, owner, at = [], [], 0
            for f, field in enumerate(fields):
                found = sections(field) + at
                lines.append(found)
                owner.append(np.full(len(found), f))
                at += len(field) + len(JOINT)
            starts, field = np.concatenate(lines), np.concatenate(owner)
            bounds = np.append(starts, len(document))
            tokens = np.array(encode(encoding, document.decode("utf-8", "replace")), np.int64)
            ends = np.cumsum(sizes[tokens])
            begins = ends - sizes[tokens]
            mine = attribute(begins, ends, bounds[:-1], rule)
            inside = np.searchsorted(bounds[:-1], ends - 1, "right") - 1
            crossing = np.searchsorted(bounds[:-1], begins, "right") - 1
            crossing = crossing[crossing != inside]
            points = np.concatenate([[0], np.cumsum((np.frombuffer(document, np.uint8) & 0xC0) != 0x80)])
            n = len(starts)
            section = np.arange(n) - np.searchsorted(field, field)
            rows.append(np.stack([
                field, section, points[bounds[:-1]], points[bounds[1:]],
                np.bincount(mine, minlength=n), np.bincount(crossing, minlength=n),
            ]))
            source.append(np.full(n, r))
        if rows:
            table = np.concatenate(rows, axis=1)
            ids = batch.column(0).take(pa.array(np.concatenate(source)))
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, table)],
                ["doc_id", "field_no", "section", "start", "end", "n_tokens", "n_crossing"],
            )


def section_token_counts(
    docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), rule: str = "first",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Tokens of each line of each field, when the whole document is encoded at once.

    A document is its fields with a line break between them. Returns ``doc_id, field, section,
    start, end, n_tokens, n_crossing``: the section's number in its field, its place in the
    document in code points (end exclusive), the tokens it is given by ``rule``, and how many
    tokens that begin in it end in a later section. The token counts of a document's
    sections add up to its number of tokens.

    A null or empty field is one empty section. Repeated rows and ids, and null ids, give rows
    of their own. An empty table gives an empty result. Other columns are not read. Nothing is
    shuffled; a task holds one batch and one document's tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    chosen = docs.select(F.col(id_col).alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    kind = chosen.schema["doc_id"].dataType.simpleString()
    counted = map_batches(
        chosen, lambda batches: _count(vocabulary, rule, batches),
        f"doc_id {kind}, field_no long, section long, start long, end long, n_tokens long, n_crossing long",
    )
    names = F.array(*map(F.lit, fields))
    return counted.select(
        "doc_id", F.get(names, F.col("field_no").cast("int")).alias("field"),
        F.col("section").cast("int").alias("section"), "start", "end", "n_tokens", "n_crossing",
    )
