import re
from itertools import combinations

import numpy as np
import pytest

from tests.llm.helpers import ODD, no_documents, odd_documents
from tests.llm.test_simhash import brute_roots
from tracewarden.llm import minhash_dedup
from tracewarden.llm.queries import QUERIES


def brute_set(text, words):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(own) < words:
        return frozenset([tuple(own)] if own else [])
    return frozenset(zip(*(own[i:] for i in range(words))))


def brute(documents, words, percent=80):
    sets = [brute_set(t, words) for _, t in documents]
    alike = {}
    for at, s in enumerate(sets):
        alike.setdefault(s, []).append(at)
    edges = [(at[0], b) for s, at in alike.items() if s for b in at[1:]]
    different = sorted((s for s in alike if s), key=len)
    for a, b in combinations(different, 2):
        if 100 * len(a) >= percent * len(b) and 100 * len(a & b) >= percent * len(a | b):
            edges.append((alike[a][0], alike[b][0]))
    roots = brute_roots(edges, range(len(documents)))
    first = {}
    for at, (d, _) in enumerate(documents):
        if d is not None:
            first[roots[at]] = min(d, first.get(roots[at], d))
    return sorted(((d, len(sets[at]), first.get(roots[at]), d == first.get(roots[at])) for at, (d, _) in enumerate(documents)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_odd_rows(spark):
    for words in (4, 5):
        assert result(minhash_dedup.near_duplicates(odd_documents(spark), words)) == brute([(r[0], r[1]) for r in ODD], words)
    assert minhash_dedup.near_duplicates(no_documents(spark)).count() == 0


def test_all_documents(spark, sf_dir):
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op11_minhash_near_dedup"](spark, sf_dir)) == brute(documents, 4)


def families(seed, base_words, copies, changed):
    """Copies of a text that is not among them, each with some words of its own; and chains in which neighbours alone are near."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(10**9))
    base, texts = [word() for _ in range(base_words)], []
    for _ in range(copies):
        own = list(base)
        at = rng.integers(0, base_words - changed)
        own[at : at + changed] = [word() for _ in range(changed)]
        texts.append(" ".join(own))
    own = list(base)
    for step in range(12):
        own = [word() for _ in range(4)] + own[:-4]
        texts.append("z " + " ".join(own))
    return list(enumerate(texts))


@pytest.mark.parametrize("changed", [2, 8, 12])
def test_large_groups_in_small_tiles(spark, monkeypatch, changed):
    for name, value in (("BAND_TILE", 8), ("BAND_CELL", 100), ("SET_TILE", 9000), ("SET_CELL", 20_000), ("COLUMNS", 50)):
        monkeypatch.setattr(minhash_dedup, name, value)
    documents = families(changed, 100, 60, changed)
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert result(minhash_dedup.near_duplicates(df, 4)) == brute(documents, 4)


def test_sketch_fills_every_column_and_estimates():
    rng = np.random.default_rng(2)
    for size in (1, 3, 40, 200, 5000):
        sets = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(5)]
        found = minhash_dedup.sketches(sets)
        assert (found != np.iinfo(np.uint64).max).all()
        for s, row in zip(sets, found):  # a set's sketch does not depend on the sets beside it
            assert (minhash_dedup.sketches([s])[0] == row).all()
    agree = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
        a, b = np.sort(pool[:90]), np.sort(pool[10:])  # 80 of 100 in common
        x, y = minhash_dedup.sketches([a, b])
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 0.8) < 0.015 and np.std(agree) < 0.035


def test_pairs_at_the_limit_share_a_band_and_pass_the_sample():
    rng = np.random.default_rng(4)
    for size in (9, 45, 450):  # 8/10, 40/50 and 400/500 in common
        sets = []
        for _ in range(300):
            pool = rng.integers(0, 2**63, size + size // 9).astype(np.uint64)
            sets += [np.sort(pool[:size]), np.sort(pool[size // 9 :])]
        sketch = minhash_dedup.sketches(sets)
        keys, bits = minhash_dedup.band_keys(sketch), minhash_dedup.sample_bits(sketch)
        assert (keys[::2] == keys[1::2]).any(axis=1).all()
        assert (np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1) <= minhash_dedup.MOST_APART).all()
        assert len(np.unique(keys[::2])) == keys[::2].size


def test_wanted_texts_found_by_shuffle(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BROADCAST_KEYS", 0)
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op11_minhash_near_dedup"](spark, sf_dir)) == brute(documents, 4)
