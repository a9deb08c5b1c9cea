import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import ODD, no_documents, odd_documents
from tracewarden.llm import common, simhash_dedup
from tracewarden.llm.queries import QUERIES


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(documents):
    prints = [(d, brute_print(t)) for d, t in documents]
    values = np.array(sorted({p for _, p in prints}), np.uint64)
    edges = []
    for at in range(0, len(values), 500):
        a, b = np.nonzero(np.bitwise_count(values[at : at + 500, None] ^ values) <= 3)
        edges += zip((a + at).tolist(), b.tolist())
    roots = brute_roots(edges, range(len(values)))
    place = {int(v): i for i, v in enumerate(values)}
    first = {}
    for d, p in prints:
        if d is not None:
            first[roots[place[p]]] = min(d, first.get(roots[place[p]], d))
    return sorted(((d, f"{p:016x}", first.get(roots[place[p]])) for d, p in prints), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_odd_rows(spark):
    assert result(simhash_dedup.near_duplicates(odd_documents(spark))) == brute_components([(r[0], r[1]) for r in ODD])
    assert simhash_dedup.near_duplicates(no_documents(spark)).count() == 0


def test_all_documents_with_a_deep_tree_and_small_cells(spark, sf_dir, monkeypatch):
    for name, value in (("LEAF", 8), ("HOME_BLOCK", 16), ("VISIT_BLOCK", 64)):
        monkeypatch.setattr(simhash_dedup, name, value)
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op9_simhash_near_dedup"](spark, sf_dir)) == brute_components(documents)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64)), base[:300] ^ np.uint64(0b111)]))
    tree = simhash_dedup.VantageTree.fit(points[:400], 6)
    leaf, index, home = tree.route(points, 3)
    assert sorted(index[home]) == list(range(len(points)))
    home_leaf = dict(zip(index[home].tolist(), leaf[home].tolist()))
    visited = set(zip(index.tolist(), leaf.tolist()))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= 3)
    assert all((int(i), home_leaf[int(j)]) in visited for i, j in zip(a, b))
    x, y = simhash_dedup.link(points, points, 3)
    assert len(x) < len(points)
    want = brute_roots(zip(a.tolist(), b.tolist()), range(len(points)))
    place = {int(v): i for i, v in enumerate(points)}
    assert brute_roots([(place[int(p)], place[int(q)]) for p, q in zip(x, y)], range(len(points))) == want


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(5)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(3000)],
        "random": [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(250)],
        "none": [],
    }[shape]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == brute_roots(edges, nodes)


def test_one_document_of_each_group_stays(spark):
    kept = simhash_dedup.keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    want = {r[2] for r in brute_components([(r[0], r[1]) for r in ODD])}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)
    assert simhash_dedup.keep_one(no_documents(spark)).count() == 0
