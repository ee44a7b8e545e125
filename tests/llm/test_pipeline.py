"""The pipeline and the queries without SQL against brute force, on the smallest driver tables."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from test_documents import edits, removed_bytes, slow_components, slow_counts, slow_fingerprint
from test_near_copies import slow_least
from test_tokens import reference

import corpus_pipeline
from seriesforge.llm import decontaminate, quality_gbt, stages
from seriesforge.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    return {t: con.execute(f"SELECT * FROM '{SF_DIR}/{t}.parquet'").fetchall() for t in ("documents", "benchmark", "labels")}


def leaked(texts, benchmark):
    table = decontaminate.lower_table()
    segments = decontaminate.Segments(benchmark, table, decontaminate.BUDGET)
    patterns = ["".join(map(chr, c)) for c in segments.code]
    seeds = [[p[i:i + 8] for i in range(len(p) - 7)] for p in patterns]
    out = set()
    for key, text in texts:
        plain = "".join(map(chr, decontaminate.plain(text, table)[0]))
        grams = {plain[i:i + 8] for i in range(len(plain) - 7)}
        for s, p in enumerate(patterns):
            if sum(g in grams for g in seeds[s]) >= segments.need[s] and edits(p, plain) <= segments.edits[s]:
                out.add((key, segments.item[s]))
    return out


def test_run(spark, tables):
    docs = [(d, t) for d, t, *_ in tables["documents"]]
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality_gbt.quality_model(frame, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    judged = {r.doc_id: r.judged for r in quality_gbt.judge(frame, model).collect()}
    kept = []
    for d, t in docs:
        counts = slow_counts(t)
        assert tuple(judged[d])[:4] == counts[:4] and counts[4] in (None, judged[d].n_repeat_words)
        if judged[d].kept:
            kept.append((d, t))
    assert 0 < len(kept) < len(docs)
    kept = [(d, t) for (d, t), (_, least) in zip(kept, slow_least(kept)) if d == least]
    cut = []
    for d, t, gone in removed_bytes(kept, 50):
        at, left = 0, []
        for c in t:
            n = len(c.encode())
            left.append("" if gone[at:at + n].all() else c)
            at += n
        cut.append((d, "".join(left)))
    bad = {d for d, _ in leaked(cut, tables["benchmark"])}
    clean = [(d, t) for d, t in cut if d not in bad]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    expected = []
    for d, t in sorted(clean):
        ids = np.array(reference().encode_ordinary(t), "<u4")
        expected.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == expected


def test_stages_keep_columns_and_take_odd_rows(spark, docs, nothing):
    (name, *_), columns = zip(*corpus_pipeline.STAGES), docs.columns
    assert len(name) == 5
    own = docs.withColumnsRenamed({"doc": "_dedup", "tag": "_hit", "key": "_judged"})
    for frame, some in ((own, True), (own.limit(0), False)):
        rows = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF_DIR)
            assert rows.columns == own.columns
        last = corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR)
        assert (last.count() > 0) == some
    assert columns == docs.columns and nothing.count() == 0


def test_near_dedup_of_odd_rows(spark, docs, texts):
    left = sorted(((r.doc_id, r.text) for r in stages.near_dedup(spark, docs, SF_DIR).collect()), key=repr)
    expected = {(d, t) for (d, t), (_, least) in zip(texts, slow_least(texts)) if d is None or d == least}
    rows = sorted([r for r in texts if r[0] is None] + [r for r in expected if r[0] is not None], key=repr)
    assert left == rows


def test_queries(spark, tables):
    docs = [(d, t) for d, t, *_ in tables["documents"]]
    fps = {d: slow_fingerprint(t) for d, t in docs}
    roots, least = slow_components(list(fps.values())), {}
    for d in sorted(fps, reverse=True):
        least[roots[fps[d]]] = d
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, SF_DIR).collect()}
    assert got == {d: (f"{f:016x}", least[roots[f]]) for d, f in fps.items()}
    got = {r.doc_id: r for r in QUERIES["op4_suffix_dedup"](spark, SF_DIR).collect()}
    for d, t, gone in removed_bytes(docs, 50):
        raw = np.frombuffer(t.encode(), np.uint8)
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        assert tuple(got[d])[1:] == (len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest())
    found = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, SF_DIR).collect()}
    assert found == leaked(docs, tables["benchmark"]) and found
    for r in QUERIES["op9_byte_bpe"](spark, SF_DIR).collect():
        assert r.decoded_sha256 == hashlib.sha256(dict(docs)[r.doc_id].encode()).hexdigest()
    labels = {d: q for d, q, _ in tables["labels"]}
    kept = {r.doc_id: r.kept for r in QUERIES["op10_quality_rules"](spark, SF_DIR).collect()}
    judged = [kept[d] == bool(q) for d, q in labels.items() if q is not None and len(dict(docs)[d].split()) >= 50]
    assert np.mean(judged) > 0.9
