import hashlib
from statistics import mean

import numpy as np
import pytest

from tests.llm.helpers import ODD, no_documents, odd_documents
from tracewarden.llm import fingerprint as fp
from tracewarden.llm.queries import QUERIES

MultisetHash = fp.MultisetHash


def slow_like(text):
    lanes = np.zeros(fp.LIKE_LANES, np.int64)
    for paragraph in text.encode().split(b"\n"):
        n = len(paragraph)
        for part in [paragraph[i : i + 8] for i in range(n - 7)] if n >= 8 else [paragraph] * (n > 0):
            v = int.from_bytes(part, "little")
            v = (v ^ v >> 29) * 0x9E3779B97F4A7C15 % 2**64
            v = (v ^ v >> 32) * 0xD6E8FEB86659FD93 % 2**64
            lanes[v >> 57] += 1 if (v >> 56) % 2 == 0 else -1
    return lanes


def test_sums_match_a_loop_over_paragraphs():
    texts = ["", "\n", "a", "abcdefgh", "abcdefg\nx\n\nabcdefghijk", "é" * 9 + "\n", "\n\nlong enough line", "ab\ncd"]
    for text, found in zip(texts, MultisetHash.of_many(texts)):
        assert (found.like == slow_like(text)).all(), text
        vectors = [np.frombuffer(hashlib.shake_128(p).digest(4 * fp.EQUAL_LANES), "<u4") for p in text.encode().split(b"\n")]
        assert (found.equal == np.sum(vectors, axis=0, dtype=np.uint32)).all()
        assert (MultisetHash.of(text).like == found.like).all()


def test_order_does_not_matter_and_edits_are_incremental():
    a = MultisetHash.of("first line here\nsecond line\nthird")
    assert a == MultisetHash.of("third\nfirst line here\nsecond line") != MultisetHash.of("third\nsecond line\nsecond line")
    b = a.insert("one more paragraph").delete("second line")
    assert b == MultisetHash.of("first line here\nthird\none more paragraph") and b.hex() == MultisetHash.of("third\none more paragraph\nfirst line here").hex()
    assert MultisetHash.from_hex(a.hex()) == a and MultisetHash.from_hex(a.hex()).likeness(b) == a.likeness(b)


@pytest.mark.parametrize("unit, n", [("a", 40_000), ("One sentence that is said again and again. ", 31_000)])
def test_counts_of_long_repetitive_texts_do_not_wrap(unit, n):
    text, shorter = unit * n, unit * (n * 3 // 4)
    long, less, other = MultisetHash.of_many([text, shorter, "Nothing of the kind stands here. " * 40])
    assert np.abs(long.like).max() > 2**15 - 1
    assert long.likeness(less) > 0.999 and long.likeness(other) < 0.5
    assert MultisetHash.from_hex(long.hex()).likeness(less) == long.likeness(less)
    assert len(other.hex()) < len(long.hex())
    twice = long.insert(text)
    assert (twice.like == 2 * long.like).all() and twice.delete(text) == long and twice.delete(text).hex() == long.hex()


def check(rows, documents):
    """Documents: (doc_id, text) in the order in which they follow each other."""
    want = []
    for (doc_id, text), (_, following) in zip(documents, documents[1:] + documents[:1]):
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        a, b, c = map(MultisetHash.of, (text, edited, following))
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), pytest.approx(a.likeness(b)), pytest.approx(a.likeness(c))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert [tuple(r) for r in sorted(rows, key=key)] == sorted(want, key=key)


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_odd_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(fp, "BUCKET", bucket)
    documents = sorted(((r[0], r[1] or "") for r in ODD), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    check(fp.fingerprint_documents(odd_documents(spark)).collect(), documents)
    assert fp.fingerprint_documents(no_documents(spark)).count() == 0
    one = spark.createDataFrame([(5, "only one")], "doc_id long, text string")
    check(fp.fingerprint_documents(one).collect(), [(5, "only one")])


def test_all_documents(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET", 17)
    rows = QUERIES["op8_fingerprint"](spark, sf_dir).collect()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(rows, sorted(((r[0], r[1] or "") for r in documents), key=lambda r: -r[0]))
    long = [r for r in rows if r["n_chars"] > 200]
    assert mean(r["near_edited"] for r in long) > 0.5 > 0.3 > mean(r["near_next"] for r in long)
    assert mean(r["near_edited"] > r["near_next"] for r in long) > 0.97
