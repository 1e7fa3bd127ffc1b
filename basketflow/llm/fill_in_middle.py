"""Fill-in-the-middle forms of texts kept as seekable compressed frames."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from basketflow.llm.common import map_batches, saved

# --- fixed values: the marks of the three parts ---------------------------------
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Bytes of text a frame holds; a cut costs the decompression of one frame.
FRAME_BYTES = 1 << 16
LEVEL = 1

#: A stored text: how many units (code points) have gone by at the end of each frame, and the frames.
STORED = "struct<ends:array<bigint>,frames:array<binary>>"
#: Bytes of results a task gathers before it hands them on.
_HELD = 1 << 22


def _starts(data: bytes) -> np.ndarray:
    """Where in UTF-8 ``data`` a code point begins."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


class Frames:
    """A text as independent zstandard frames, with the cumulative number of units after each."""

    def __init__(self, ends: list[int] | None = None, frames: list[bytes] | None = None):
        self.ends = ends or []
        self.frames = frames or []

    @property
    def units(self) -> int:
        return self.ends[-1] if self.ends else 0

    @classmethod
    def of(cls, data: bytes, size: int = FRAME_BYTES) -> "Frames":
        """``data`` cut into frames of ``size`` bytes, or as many more as end a code point."""
        made, at = cls(), 0
        while at < len(data):
            stop = min(len(data), at + size)
            while stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop += 1
            made.add(data[at:stop])
            at = stop
        return made

    def add(self, data: bytes) -> None:
        """One more frame at the end."""
        if data:
            self.append(zstandard.compress(data, LEVEL), len(_starts(data)))

    def append(self, frame: bytes, units: int) -> None:
        """A frame that is compressed already."""
        self.ends.append(self.units + units)
        self.frames.append(frame)

    def data(self, number: int) -> bytes:
        return zstandard.decompress(self.frames[number])

    def spans(self, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """The frames that hold the units ``start`` to ``stop``: number, and from and to within it."""
        if start >= stop:
            return
        for number in range(int(np.searchsorted(self.ends, start, "right")), len(self.ends)):
            before = self.ends[number - 1] if number else 0
            if before >= stop:
                return
            yield number, max(start - before, 0), min(stop, self.ends[number]) - before

    def size(self, number: int) -> int:
        return self.ends[number] - (self.ends[number - 1] if number else 0)

    def bytes_of(self, number: int, start: int, stop: int) -> bytes:
        """Units ``start`` to ``stop`` of one frame, which alone is decompressed."""
        data = self.data(number)
        if start == 0 and stop == self.size(number):
            return data
        edges = np.append(_starts(data), len(data))
        return data[(0 if start == 0 else edges[start]) : edges[stop]]

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The bytes of the units ``start`` to ``stop``, one frame after the other."""
        for span in self.spans(start, self.units if stop is None else stop):
            yield self.bytes_of(*span)

    def copy(self, source: "Frames", start: int, stop: int) -> None:
        """Append units of another text: whole frames as they are, only cut ones are read."""
        for number, first, last in source.spans(start, stop):
            if first == 0 and last == source.size(number):
                self.append(source.frames[number], last)
            else:
                self.add(source.bytes_of(number, first, last))

    def find(self, mark: bytes) -> int:
        """The unit at which ``mark`` (ASCII) first stands; marks may lie across frames."""
        tail, before = b"", 0
        for number in range(len(self.frames)):
            data = tail + self.data(number)
            at = data.find(mark)
            if at >= 0:
                return before + len(_starts(data[:at]))
            tail = data[len(data) - min(len(data), len(mark) - 1) :]
            # A tail that begins inside a code point counts from its next one.
            before = self.ends[number] - len(_starts(tail))
        raise ValueError(f"no {mark.decode()} in the text")


def _digest(parts: Iterator[bytes]) -> str:
    made = hashlib.sha256()
    for part in parts:
        made.update(part)
    return made.hexdigest()


def assemble(text: Frames, form: str, first: int, last: int) -> Frames:
    """The output of a text that is cut at the units ``first`` and ``last``."""
    made = Frames()
    if form == "plain":
        made.copy(text, 0, text.units)
        return made
    prefix, middle, suffix = (0, first), (first, last), (last, text.units)
    order = [(PREFIX, prefix), (SUFFIX, suffix)]
    for mark, part in [*(order if form == "psm" else order[::-1]), (MIDDLE, middle)]:
        made.add(mark)
        made.copy(text, *part)
    return made


def restore(output: Frames, form: str) -> Iterator[bytes]:
    """The text again, from its output and form alone, frame by frame."""
    if form == "plain":
        yield from output.stream()
        return
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    # A text that is cut holds no mark, so the first of each is the one that was put there.
    at_one, at_two, at_middle = output.find(one), output.find(two), output.find(MIDDLE)
    first = (at_one + len(one), at_two)
    second = (at_two + len(two), at_middle)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    yield from output.stream(*prefix)
    yield from output.stream(at_middle + len(MIDDLE))
    yield from output.stream(*suffix)


def _row_by_row(frame: DataFrame, make: Callable[[dict], tuple[dict, int]], schema: str) -> DataFrame:
    """``make(row) -> (row, bytes)`` for each row; results are handed on every few megabytes."""
    names = frame.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for at in range(batch.num_rows):
                row, size = make({n: batch.column(i)[at] for i, n in enumerate(names)})
                made.append(row)
                held += size
                if held > _HELD:
                    yield pa.RecordBatch.from_pylist(made, target)
                    made, held = [], 0
            if made:
                yield pa.RecordBatch.from_pylist(made, target)

    target = to_arrow_schema(frame.sparkSession.createDataFrame([], schema).schema)
    return map_batches(frame, work, schema)


def frame_store(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES
) -> DataFrame:
    """Every text as a seekable row of frames, written to the shared folder.

    Returns ``doc_id, units, marked, stored``: the number of code points, whether the text
    holds one of the marks, and the frames with their cumulative unit counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX.decode()))
    for mark in (SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark.decode()))
    source = docs.select(F.col(id_col).alias("doc_id"), marked.alias("marked"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make(row: dict) -> tuple[dict, int]:
        found = Frames.of(row["text"].as_buffer().to_pybytes(), frame_bytes)
        stored = {"ends": found.ends, "frames": found.frames}
        made = {"doc_id": row["doc_id"].as_py(), "units": found.units, "marked": row["marked"].as_py(), "stored": stored}
        return made, sum(map(len, found.frames))

    schema = f"doc_id {kind}, units bigint, marked boolean, stored {STORED}"
    return saved(_row_by_row(source, make, schema), "frames")


def _share(number: int) -> Column:
    """One of the 8-digit groups of the id's checksum as an unsigned number."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * number + 1, 8), 16, 10).cast("bigint")


def fim_plan(store: DataFrame) -> DataFrame:
    """Form and cuts of each stored text, from its index alone: adds ``form, first, last``."""
    one, two = (_share(i) % (F.col("units") + 1) for i in (0, 1))
    plain = (F.col("units") == 0) | F.col("marked") | (_share(2) % 100 >= 90)
    form = F.when(plain, "plain").when(_share(3) % 100 < 20, "spm").otherwise("psm")
    return store.select("*", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("last"))


def _cut(row: dict) -> Frames:
    stored = row["stored"].as_py()
    text = Frames(stored["ends"], stored["frames"])
    return assemble(text, row["form"].as_py(), row["first"].as_py(), row["last"].as_py())


def fim_outputs(store: DataFrame) -> DataFrame:
    """The outputs as seekable rows: ``doc_id, units, form, first, last, output``."""
    kind = store.schema["doc_id"].dataType.simpleString()
    plain = ["doc_id", "units", "form", "first", "last"]

    def make(row: dict) -> tuple[dict, int]:
        made = _cut(row)
        output = {"ends": made.ends, "frames": made.frames}
        return {n: row[n].as_py() for n in plain} | {"output": output}, sum(map(len, made.frames))

    schema = f"doc_id {kind}, units bigint, form string, first bigint, last bigint, output {STORED}"
    return _row_by_row(fim_plan(store).select(*plain, "stored"), make, schema)


def frame_texts(stored: DataFrame, column: str = "output") -> DataFrame:
    """The frames of ``column`` put together again: ``doc_id, text``."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def make(row: dict) -> tuple[dict, int]:
        found = row["found"].as_py()
        text = b"".join(Frames(found["ends"], found["frames"]).stream()).decode("utf-8", "replace")
        return {"doc_id": row["doc_id"].as_py(), "text": text}, len(text)

    return _row_by_row(
        stored.select("doc_id", F.col(column).alias("found")), make, f"doc_id {kind}, text string"
    )


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES
) -> DataFrame:
    """Digests of the fill-in-the-middle output of every text and of the text restored from it.

    Texts are stored as independent zstandard frames with cumulative unit counts. A text is cut
    at two units drawn from its id: only frames with a cut are decompressed and written anew, the
    others go into the output as they are. Digests stream the output's frames in order; the
    restored text is read from the output alone, by seeking behind its marks.

    Returns ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``.

    Null texts count as empty and are ``plain``, as are texts that hold a mark. A null id is
    drawn from as the empty text. Rows are independent, so repeats give equal rows; an empty
    table gives an empty result. Other columns are not read. A task holds the compressed frames
    of one text and one decompressed frame.
    """
    plan = fim_plan(frame_store(docs, id_col, text_col, frame_bytes))
    kind = plan.schema["doc_id"].dataType.simpleString()

    def make(row: dict) -> tuple[dict, int]:
        form, first, last = (row[n].as_py() for n in ("form", "first", "last"))
        output = _cut(row)
        cut = form != "plain"
        made = {
            "doc_id": row["doc_id"].as_py(), "n": row["units"].as_py(), "form": form,
            "prefix_chars": first if cut else None, "middle_chars": last - first if cut else None,
            "output_sha256": _digest(output.stream()), "restored_sha256": _digest(restore(output, form)),
        }
        return made, 256

    return _row_by_row(
        plan, make,
        f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint,"
        " output_sha256 string, restored_sha256 string",
    )


def oracle_sql() -> str:
    """The same in SQL (DuckDB)."""
    marks = " OR ".join(f"contains(body, '{m.decode()}')" for m in (PREFIX, SUFFIX, MIDDLE))
    share = "CAST('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), {}, 8) AS BIGINT)"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n FROM documents),
drawn AS (
  SELECT *, {share.format(1)} % (n + 1) AS one, {share.format(9)} % (n + 1) AS two,
         CASE WHEN n = 0 OR {marks} OR {share.format(17)} % 100 >= 90 THEN 'plain'
              WHEN {share.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM texts),
cut AS (
  SELECT *, substr(body, 1, least(one, two)) AS prefix,
         substr(body, least(one, two) + 1, greatest(one, two) - least(one, two)) AS middle,
         substr(body, greatest(one, two) + 1) AS suffix
  FROM drawn)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN least(one, two) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN abs(one - two) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN body ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""
