"""The whole pipeline, and the registered queries, on the small tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from nearfold import session
from nearfold.llm import mixing, pii, quality, sampling
from nearfold.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram jaccard join", "personal data", "mixing", "sentencepiece"]


def test_pipeline_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = {r.doc_id for r in quality.judge(docs, ["doc_id"]).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    assert all(not brute.quality_counts(t)[-1] for _, t in rows)
    first = {d for d, _, c in brute.classes(rows) if d == c}
    kept = spark.createDataFrame([x for x in rows if x[0] in first], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(kept).collect()}
    want = {}
    for doc, text in rows:
        if doc in first:
            out, at = [], 0
            for kind, a, b in sorted((s.split(":") for s in spans[doc].split(",") if s), key=lambda s: int(s[1])):
                if int(a) >= at:
                    out += [text[at : int(a)], f"<{kind.upper()}>"]
                at = max(at, int(b))
            want[doc] = "".join(out) + text[at:]
    result = corpus_pipeline.run(spark, SF_DIR)
    found: dict = {}
    for r in sampling.decoded(result).collect():
        assert r.exact and r.text == want[r.doc_id]
        found.setdefault(r.doc_id, set()).add(tuple(r.ids))
    assert set(found) == set(want) and all(len(s) == 2 for s in found.values())


def test_middle_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).dtypes == docs.dtypes


def test_all_numbers_are_there():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op5_suffix_array_dedup"])
def test_dedup_queries(spark, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    plain = {"op1_substring_dedup": brute.word_dedup, "op5_suffix_array_dedup": brute.byte_dedup}[name]
    assert sorted((tuple(r) for r in QUERIES[name](spark, SF_DIR).collect()), key=str) == plain(rows)


def test_mixing_query_places_every_document(spark):
    rows = QUERIES["op2_mixing"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    slots: dict = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline
        slots.setdefault(r.slot, set()).add(r.source)
    assert all(len(s) == 1 for s in slots.values())
    assert len({(r.slot, r.place) for r in rows}) == len(rows)


def test_the_samples_are_in_the_order_of_the_mixture(spark):
    """What mixing decides reaches the last stage: ordered by their places the samples are the mixture."""
    docs = spark.createDataFrame([(i, f"text {i}", "a" if i % 10 else "b") for i in range(60)], "doc_id long, text string, source string")
    want = [r.doc_id for r in mixing.mixed(docs).orderBy("slot", "place").collect()]
    mixed = session.staged(corpus_pipeline.mix_sources(spark, docs, SF_DIR), "mixed")
    samples = corpus_pipeline.encode(spark, mixed, SF_DIR).collect()
    assert [r.doc_id for r in sorted(samples, key=lambda r: (r.part, r.row)) if r.sample == 1] == want != sorted(want)
