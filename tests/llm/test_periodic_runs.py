import hashlib
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import ODD, no_documents, odd_documents
from tracewarden.llm import periodic_runs
from tracewarden.llm.queries import QUERIES


def brute_runs(words):
    """Every stretch that keeps a period, for every period; of periods with the same stretch the smallest counts."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        j = 0
        while j < n - q:
            start = j
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > start and j + q - start >= max(6, 4 * q):
                best.setdefault((start, j + q - start), q)
            j += j == start
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_all_documents(spark, sf_dir):
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).select(COLUMNS).collect())
    assert got == sorted(brute_row(d, t) for d, t in documents)
    assert sum(r[1] > 0 for r in got) > len(got) // 20


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_sequences(letters):
    rng = np.random.default_rng(letters)
    for _ in range(400):
        words = rng.integers(0, letters, rng.integers(0, 60))
        if rng.random() < 0.5:
            words = np.concatenate([words, np.tile(rng.integers(0, 3, rng.integers(1, 8)), 6), words])
        got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(words.astype(np.int64)))))
        assert got == brute_runs(words.tolist())


def test_odd_rows(spark):
    found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(odd_documents(spark)).collect()}
    assert len(periodic_runs.periodic_runs(odd_documents(spark)).collect()) == len(ODD)
    assert [tuple(x) for x in found[6]["runs"]] == [(0, 30_000, 1)] and found[6]["collapsed"] == "word"
    assert found[3]["n_words"] == found[4]["n_words"] == 0 and found[4]["runs"] == [] and found[4]["collapsed"] == ""
    assert found[5]["collapsed"] == "ÉTÉ été É\u00a0nbsp tab win two three end"
    assert periodic_runs.periodic_runs(no_documents(spark)).count() == 0


def test_neighbouring_texts_do_not_mix(spark):
    rows = [(i, "a b a b") for i in range(50)] + [(99, "a b " * 3)]
    found = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in found} == {i: [] for i in range(50)} | {99: []}
    long = [(i, "x a b " * (4 + i)) for i in range(6)]
    found = periodic_runs.periodic_runs(spark.createDataFrame(long, "doc_id long, text string").coalesce(1)).collect()
    assert all([tuple(x) for x in r["runs"]] == [(0, 3 * (4 + r["doc_id"]), 3)] for r in found)
