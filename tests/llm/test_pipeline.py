"""The pipeline stage by stage, and the registered queries."""

import re
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from basketflow.llm import secret_scan
from basketflow.llm.catalog import llm_oracles, llm_queries
from basketflow.llm.pieces import decode_pieces
from basketflow.llm.quality_rules import quality_verdicts
from basketflow.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.saved(stage(spark, found[-1], SF), "test-stage"))
    return found


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for frame in stages[1:-1]:
        assert frame.dtypes == stages[0].dtypes


def test_rejected_documents_go(stages):
    wanted = {r.doc_id for r in quality_verdicts(stages[0]).where("kept").collect()}
    assert texts(stages[1]) == {i: t for i, t in texts(stages[0]).items() if i in wanted}


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    prints = {i: fingerprint(t.encode()) for i, t in before.items()}
    group = {i: i for i in before}
    changed = True
    while changed:
        changed = False
        for a in before:
            for b in before:
                if group[b] < group[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a], changed = group[b], True
    assert after == {i: before[i] for i in before if group[i] == i}


def test_benchmark_passages_go_and_the_rest_stays(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    exact = {i for i, t in before.items() if any(x in t for x in items)}
    assert len(exact - after.keys()) >= 0.9 * len(exact)
    for i in before.keys() - after.keys() - exact:  # edited copies: they share long word runs
        runs = {" ".join(w[k : k + 4]) for x in items for w in [x.split()] for k in range(len(w) - 3)}
        assert sum(r in before[i] for r in runs) >= 4


def test_secrets_are_masked(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert before.keys() == after.keys()
    for i, text in after.items():
        hits = [m for r in secret_scan.RULES for m in re.finditer(r.pattern, before[i]) if len(m[r.group]) >= r.least]
        assert (text != before[i]) == bool(hits)
        assert not any(m[0] in text for m in hits)
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_pieces_give_the_text_back(stages):
    encoded = stages[5]
    assert encoded.where("NOT round_trip").count() == 0
    assert texts(decode_pieces(encoded)) == texts(stages[4])


def test_run_is_all_stages(spark, stages):
    ids = [sorted(r.doc_id for r in f.collect()) for f in (corpus_pipeline.run(spark, SF), stages[5])]
    assert ids[0] == ids[1]


def test_registered_queries():
    names = list(llm_queries())
    assert sorted(re.match(r"op\d+_|pipeline", n)[0] for n in names) == sorted([*(f"op{n}_" for n in range(1, 14)), "pipeline"])
    assert set(llm_oracles()) <= set(names)


def test_secret_scan_equals_its_sql(spark):
    with duckdb.connect() as connection:
        path = Path("/root/testdata/sf0.01/documents.parquet")
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        wanted = connection.execute(llm_oracles()["op6_secret_scans"])
        columns = [c[0] for c in wanted.description]
        found = llm_queries()["op6_secret_scans"](spark, "/root/testdata/sf0.01").select(columns)
        assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())
