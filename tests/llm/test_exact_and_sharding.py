import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import ODD, no_documents, odd_documents
from tracewarden.llm import exact_dedup, sharding
from tracewarden.llm.queries import QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            out.append((i, best, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_on_odd_rows(spark):
    got = [tuple(r) for r in exact_dedup.exact_groups(odd_documents(spark)).collect()]
    assert sorted(got, key=str) == brute_groups([(r[0], r[1]) for r in ODD])


def test_exact_groups_with_a_hot_text_and_a_shuffled_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", 0)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 2500}") for i in range(6000)]
    got = [tuple(r) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_groups(rows)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(no_documents(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_and_inverse(size):
    numbers = np.arange(size)
    moved = sharding.permute(numbers, size, 7)
    assert sorted(moved) == list(numbers)
    assert (sharding.permute(moved, size, 7, inverse=True) == numbers).all()


def check_shards(rows, documents):
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in places.values())
    counts = [len(places[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(documents)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == want
    shard, slot, number = (np.array([r[c] for r in rows]) for c in ("shard", "slot", "row_number"))
    assert (sharding.row_of(shard, slot, len(rows), 16, 2024) == number).all()


def test_shards_of_odd_rows(spark, monkeypatch):
    first = sharding.shard_documents(odd_documents(spark)).collect()
    check_shards(first, [(r[0], r[1]) for r in ODD])
    monkeypatch.setattr(sharding, "RUN", 2)  # repeated rows written out in several runs
    again = sharding.shard_documents(odd_documents(spark, 7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert sharding.shard_documents(no_documents(spark)).count() == 0


def test_shards_of_all_documents(spark, sf_dir):
    rows = QUERIES["op10_sharding"](spark, sf_dir).collect()
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(rows, documents)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
