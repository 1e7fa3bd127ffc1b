"""Fill-in-the-middle forms: SQL, the frames, exact round trips and odd rows."""

import hashlib

import duckdb
import pytest
from basketflow.llm import fill_in_middle as fim
from basketflow.llm.catalog import llm_oracles, llm_queries

SF_DIR = "/root/testdata/sf0.01"


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        output, form = text, "plain"
    elif h[3] % 100 < 20:
        form, output = "spm", f"<S>{text[last:]}<P>{text[:first]}<M>{text[first:last]}"
    else:
        form, output = "psm", f"<P>{text[:first]}<S>{text[last:]}<M>{text[first:last]}"
    cut = (None, None) if form == "plain" else (first, last - first)
    return (doc_id, n, form, *cut, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


TEXTS = [
    None, "", "a", "<", "<<P", "plain <P> text", "ñ" * 5000, "日本語 \U0001f600\n" * 3000, "x" * 300_000,
    "é" * 40, "<S", "S>", " \t\n", "\0\0",
] + [f"<{'<' * (i % 7)}P{'>' if i % 3 else ''} text {i} 日本" * (i % 5) for i in range(60)]


def test_equals_sql(spark):
    found = llm_queries()["op13_fill_in_middle"](spark, SF_DIR)
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
        wanted = base.execute(llm_oracles()["op13_fill_in_middle"])
        names = [c[0] for c in wanted.description]
        assert sorted(names) == sorted(found.columns)
        assert sorted(map(tuple, found.select(names).collect())) == sorted(wanted.fetchall())


@pytest.mark.parametrize("frame_bytes", [1, 7, 1000, fim.FRAME_BYTES])
def test_equals_brute_force_whatever_the_frames(spark, frame_bytes):
    texts = TEXTS if frame_bytes >= 1000 else [t for t in TEXTS if len(t or "") < 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a repeated id"), (3, "a repeated id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "?", "?") for r in rows], "doc_id long, text string, stored string, form string")
    found = sorted(map(tuple, fim.fill_in_middle(docs, frame_bytes=frame_bytes).collect()), key=str)
    assert found == sorted((brute(*r) for r in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_outputs_are_whole_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    store = fim.frame_store(docs, frame_bytes=100)
    texts = {r["doc_id"]: r["text"] for r in fim.frame_texts(fim.fim_outputs(store)).collect()}
    for number, text in enumerate(TEXTS):
        assert hashlib.sha256(texts[number].encode()).hexdigest() == brute(number, text)[5]
    back = {r["doc_id"]: r["text"] for r in fim.frame_texts(store, "stored").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_only_cut_frames_are_read(monkeypatch):
    text = fim.Frames.of(("0123456789" * 1000).encode(), 100)
    read = []
    whole = fim.Frames.data
    monkeypatch.setattr(fim.Frames, "data", lambda self, n: read.append(n) or whole(self, n))
    output = fim.assemble(text, "psm", 1234, 5678)
    assert set(read) == {12, 56}
    assert output.units == 10_009
    assert text.ends[:3] == [100, 200, 300]


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
