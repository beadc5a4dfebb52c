import re

import pytest
from cases import ROWS, documents, table

import corpus_pipeline
from quarrydf.llm import mixing
from test_llm_lines import brute as brute_lines


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "encode"]


def test_run_follows_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.materialize(stage(spark, docs, sf), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == sizes[-1] and sizes[0] >= sizes[1] == sizes[2] > sizes[3]
    assert set(r["doc_id"] for r in out.collect()) == set(r["doc_id"] for r in docs.collect())


def test_awkward_rows(spark, tmp_path):
    folder = table(spark, tmp_path, documents=documents(spark, ["ids", "__lang", "mix_size", "__digest", "row"]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, folder)
    keep = [r for r in ROWS if re.search(r"[^\W\d_]", r[1] or "")]
    assert sorted((r["doc_id"], r["text"]) for r in first.filter("doc_id IS NOT NULL").collect()) == sorted(r[:2] for r in keep if r[0] is not None)
    second = corpus_pipeline.line_dedup(spark, first, folder)
    want = {k[0]: v[0] for k, v in brute_lines([r[:2] for r in keep], 3).items()}
    got = second.collect()
    assert len(got) == len(keep) and all(r["text"] == want[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    third = corpus_pipeline.near_dedup(spark, second, folder)
    ids = sorted((r["doc_id"] for r in third.collect()), key=str)
    assert len(ids) == len(set(ids)) and ids.count(5) <= 1
    fourth = corpus_pipeline.mix_sources(spark, third, folder)
    assert all(r["count"] <= 2 for r in fourth.groupBy("doc_id", "text").count().collect())
    assert corpus_pipeline.encode(spark, fourth, folder).count() == fourth.count()
    assert corpus_pipeline.run(spark, folder).count() == fourth.count()


@pytest.mark.parametrize("at", range(5))
def test_empty_table(spark, at, tmp_path):
    docs = documents(spark).limit(0)
    assert corpus_pipeline.STAGES[at][1](spark, docs, str(tmp_path)).count() == 0


def test_mixing_repeats_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs, mixing.WEIGHTS).agg({"mix_copies": "sum"}).first()[0]
    assert corpus_pipeline.mix_sources(spark, docs, sf).count() == mixed
