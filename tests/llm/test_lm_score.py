import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from tests.llm.helpers import ODD, no_documents, odd_documents
from tracewarden.llm import lm_score as lm
from tracewarden.llm.queries import QUERIES


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["\n"]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def brute(documents, model, frequent, classes):
    counts = Counter()
    for doc_id, text in documents:
        if not held(doc_id):
            counts.update(tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    least = min((c for _, c in frequent), default=None)
    want = sorted(((w, c) for w, c in counts.items() if least and c >= least), key=lambda x: (-x[1], x[0]))
    assert frequent == want and len(want) <= lm.FREQUENT
    top = [w for w, _ in want][: classes - 1]
    place = {w: i + 1 for i, w in enumerate(top)}
    rest = n - sum(counts[w] for w in top) + v - len(top) + 1
    r, q, c, b = (a.astype(np.float64) for a in model.arrays())
    for doc_id, text in documents:
        words = tokens_of(text)
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in words)
        score, before = 0.0, [place.get("\n", 0)] * 2
        for w in words:
            s = (c[0] * r[before[1]] + c[1] * r[before[0]]) @ q.T + b
            p = np.exp(s - s.max())
            k = place.get(w, 0)
            score += log10(p[k] / p.sum()) + (log10((counts[w] + 1) / rest) if k == 0 else 0)
            before = [before[1], k]
        yield doc_id, held(doc_id), len(words), sum(counts[w] > 0 for w in words), n, pytest.approx(base, rel=1e-9, abs=1e-9), pytest.approx(score, rel=2e-4, abs=1e-3)


def key(row):
    return (row[0] is None, row[0] or 0, row[2], row[3])


def check(docs, documents, monkeypatch, classes):
    models = []
    real = lm.train
    monkeypatch.setattr(lm, "CLASSES", classes)
    monkeypatch.setattr(lm, "train", lambda tokens, counted: models.append((real(tokens, counted), counted.frequent)) or models[-1][0])
    rows = [tuple(r) for r in lm.score_documents(docs).collect()]
    assert sorted(rows, key=key) == sorted(brute(documents, *models[0], classes), key=key)


@pytest.mark.parametrize("frequent", [5, 10_000])
def test_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    documents = [(d, t if d != 6 else "word " * 300) for d, t, *_ in ODD]
    check(spark.createDataFrame(documents, "doc_id long, text string").repartition(3), documents, monkeypatch, 4)


def test_nothing_and_nothing_to_learn_from(spark, monkeypatch):
    assert lm.score_documents(no_documents(spark)).count() == 0
    only = next(i for i in range(100) if held(i))
    (row,) = lm.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert tuple(row) == (only, True, 3, 0, 0, 0.0, 0.0)
    assert lm.score_documents(odd_documents(spark)).count() == len(ODD)


def test_all_documents(spark, sf_dir, monkeypatch):
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sample = sorted(documents, key=lambda d: len(d[1]))[:150]
    check(spark.createDataFrame(sample, "doc_id long, text string"), sample, monkeypatch, 64)


def test_probabilities_sum_to_one_and_parts_agree():
    share = np.full(20, 0.05)
    model = lm.LogBilinear.fresh(share)
    model.context *= 8
    model.target *= 8
    w2, w1 = np.divmod(np.arange(400), 20)
    logs = model.log_probabilities(w1, w2)
    assert np.exp(logs).sum(axis=1) == pytest.approx(np.ones(400), rel=1e-5)
    first, second, norm = model.parts()
    assert first[w1] + second[w2] - norm[w2, w1][:, None] == pytest.approx(logs / np.log(10), abs=1e-4)


def test_noise_contrast_learns_what_follows():
    rng = np.random.default_rng(0)
    follows = rng.permutation(20)
    ids = [0]
    for _ in range(30_000):
        ids.append(int(follows[ids[-1]]) if rng.random() < 0.8 else int(rng.integers(20)))
    model, share = lm.LogBilinear.fresh(np.full(20, 0.05)), np.full(20, 0.05)
    contrast = lm.NoiseContrast(model, share, 1)
    w2, w1, w = lm.contexts(np.array(ids), 0)
    for at in range(0, len(w), 256):
        contrast.step(w2[at : at + 256], w1[at : at + 256], w[at : at + 256])
    probability = np.exp(model.log_probabilities(np.arange(20), np.arange(20)))
    assert probability[np.arange(20), follows].mean() > 0.4


def test_model_beats_unigrams_on_held_out_texts(spark):
    rows = QUERIES["op7_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / tokens > sum(r["base_score"] for r in rows) / tokens + 0.03
