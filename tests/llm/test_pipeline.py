"""Every stage of the pipeline on what the stage before it kept, against brute-force versions."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.helpers import no_documents, odd_documents, written
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import check_plan
from tests.llm.test_packing import check_pieces
from tests.llm.test_simhash import brute_components
from tracewarden.llm import mixing, packing, quality

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """The input of the first stage and the output of each, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_all_but_the_last_return_documents(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for df in steps[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)


def test_quality(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    decisions = quality.quality_decisions(steps[0], labels).collect()
    assert Counter(i for (i,) in rows(steps[1], "doc_id")) == Counter(r["doc_id"] for r in decisions if r["predicted"])


def test_line_dedup(steps):
    before, after = rows(steps[1], "doc_id", "text", "n_chars"), {r[0]: r[1:] for r in rows(steps[2], "doc_id", "text", "n_chars")}
    decisions = brute_lines([r[:2] for r in before])
    assert len(after) == len(before)
    for doc_id, text, n_chars in before:
        lines = text.split("\n")
        left = "\n".join(line for i, line in enumerate(lines) if decisions.get((doc_id, i), (0, 0, 0, True))[3])
        assert after[doc_id] == (left, n_chars if left == text else len(left))


def test_near_duplicates(steps):
    want = {component for *_, component in brute_components(rows(steps[2], "doc_id", "text"))}
    assert Counter(i for (i,) in rows(steps[3], "doc_id")) == Counter(want)


def test_mixing(steps):
    documents = rows(steps[3], "doc_id", "text", "source")
    plan = mixing.mixing_plan(steps[3]).collect()
    check_plan(plan, documents, close=0.4)
    assert Counter(i for (i,) in rows(steps[4], "doc_id")) == +Counter({r["doc_id"]: r["copies"] for r in plan})


def test_packing(steps):
    pieces = packing.pack_documents(steps[4], with_ids=True)
    check_pieces(pieces.collect(), rows(steps[4], "doc_id", "text"), waste=steps[4].rdd.getNumPartitions() * 2048)
    assert sorted(rows(pieces, "doc_id", "start", "length")) == sorted(rows(steps[5], "doc_id", "start", "length"))


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    result = corpus_pipeline.run(spark, sf_dir)
    assert sum(n for (n,) in rows(result, "length")) == sum(n for (n,) in rows(steps[5], "length"))


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_tables_pass_through(spark, tmp_path, make):
    documents = make(spark).select(*corpus_pipeline.COLUMNS, "h", "word")
    sf = written(spark, tmp_path, documents=documents, labels=spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS))
    result = corpus_pipeline.run(spark, sf)
    kept = {r["doc_id"] for r in result.collect()}
    assert kept <= {r["doc_id"] for r in documents.collect()} and bool(kept) == (not documents.isEmpty())
    assert {"doc_id", "sequence_id", "offset"} <= set(result.columns)
