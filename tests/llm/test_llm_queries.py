"""Registered queries against their SQL on the smallest data, and the pipeline stage by stage."""

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from check import same_rows
from curioshelf.llm import line_crf, packing, secrets, toxicity
from curioshelf.llm.queries import ORACLES, QUERIES, held_out
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, con, key):
    got, want = QUERIES[key](spark, SF_DIR), con.execute(ORACLES[key])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert same_rows(got.columns, got.collect(), names, want.fetchall())


COLUMNS = {
    "op2": None,
    "op3": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op9": None,
}


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_columns_and_documents(spark, con, start):
    got = QUERIES[next(k for k in QUERIES if k.startswith(start + "_"))](spark, SF_DIR)
    assert COLUMNS[start] is None or got.columns == COLUMNS[start]
    ids = {r[0] for r in got.select("doc_id").distinct().collect()}
    assert ids == {r[0] for r in con.execute("select doc_id from documents").fetchall()}


def expected(spark, name, docs):
    """What a stage leaves of ``docs``, as doc_id: text, by plain means."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    if name == "ngram_jaccard_join":
        first = {d for d, _, c in brute(rows) if d == c}
        return {d: t for d, t in rows if d in first}
    if name == "secret_scans":
        scanned = secrets.scan(docs)
        found = secrets.score(scanned, secrets.train(secrets.samples(scanned))).select("doc_id", "_spans").collect()
        out = dict(rows)
        for doc, spans in map(tuple, found):
            at, text = 0, ""
            for s in spans:
                if s["start"] >= at:
                    text += out[doc][at : s["start"]] + "[SECRET]"
                at = max(at, s["end"])
            out[doc] = text + out[doc][at:] if spans else out[doc]
        return out
    if name == "toxicity":
        model = toxicity.train(docs, corpus_pipeline._labels(spark, SF_DIR).where(~held_out(4, 2)))
        out = {}
        for doc, text in rows:
            words = [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text) if w]
            known = {int(t): w for t, w in zip(model.terms, model.weights, strict=False)}
            counts = Counter(t for w in words for t in terms_of(w))
            z = model.intercept + sum(known[t] * math.log1p(n) for t, n in counts.items() if t in known)
            z += float(toxicity._patterns([text])[0] @ model.weights[len(model.terms) :])
            if 1 / (1 + math.exp(-z)) < toxicity.THRESHOLD:
                out[doc] = text
        return out
    model = line_crf.train(docs, corpus_pipeline._labels(spark, SF_DIR).where(~held_out(5, 0)))
    return {d: t for d, t in rows if line_crf.scores_of(model, pa.array([t]))[0] >= line_crf.THRESHOLD}


def terms_of(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return toxicity._terms(data, np.array([0, len(data)]))[1].tolist()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.columns == columns and after.dtypes == docs.dtypes
        got = {r["doc_id"]: r["text"] for r in after.collect()}
        assert got == expected(spark, name, docs) and len(got) == after.count() and len(got) > 100
        assert after.where("n_chars <> length(text)").count() == 0
        docs = spark.createDataFrame(after.collect(), after.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    items = {r["doc_id"]: (r["length"], r["source"], r["cluster"]) for r in packing.as_items(docs).collect()}
    check(list(map(tuple, last.collect())), items, packing.CAPACITY)
    assert corpus_pipeline.run(spark, SF_DIR).count() == last.count()


def test_pipeline_on_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF_DIR).count() == 0
