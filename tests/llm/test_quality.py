import zlib

import numpy as np
import pytest

from tests.llm.helpers import ODD, no_documents, odd_documents, written
from tracewarden.llm import quality
from tracewarden.llm.quality import BLOCK, FILTERS, WIDTH, ByteConvNet
from tracewarden.llm.queries import QUERIES


def slow_score(net, text):
    """Filters at every byte, one position at a time."""
    n = -(-(len(text) + 1) // BLOCK)
    data = text + bytes(n * BLOCK - len(text) + WIDTH)
    out = np.array([sum(net.embed[data[p + k]].astype(float) @ net.filters[k] for k in range(WIDTH)) for p in range(n * BLOCK)])
    chunks = np.array([np.maximum(out[b * BLOCK : (b + 2) * BLOCK].max(axis=0) + net.bias, 0) for b in range(n)])
    pooled = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
    return 1 / (1 + np.exp(-(pooled @ net.combine + net.offset[0])))


def test_scores_cover_every_byte():
    net = ByteConvNet.fresh()
    net.bias += 0.1
    texts = [b"", b"x", b"a" * 31, b"b" * 32, "é last bytes differ".encode() * 40, b"plain text " * 900 + b"###", bytes(range(256))]
    assert net.scores(texts) == pytest.approx([slow_score(net, t) for t in texts], abs=1e-4)


def test_slopes_match_finite_differences():
    net = ByteConvNet.fresh()
    for a in net.arrays():
        a[...] = a.astype(np.float32)
    net.bias += 0.5
    texts, labels = [b"one text of words", b"and *** another ### longer text " * 3, b""], np.array([1, 0, 1], np.float32)

    def loss():
        p = np.clip(net.scores(texts), 1e-9, 1 - 1e-9)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    rng = np.random.default_rng(2)
    for values, slopes in zip(net.arrays(), net._slopes(texts, labels)):
        steepest = np.argsort(-np.abs(slopes).ravel())[:5]
        for at in [*steepest, rng.integers(values.size)]:
            place = np.unravel_index(at, values.shape)
            before, step = values[place], np.float32(2e-3)
            values[place] = before + step
            up = loss()
            values[place] = before - step
            down = loss()
            values[place] = before
            assert (up - down) / (2 * step) == pytest.approx(slopes[place], rel=0.1, abs=3e-3)


def test_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (7, 1, None), (9, None, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    sf = written(spark, tmp_path, documents=odd_documents(spark), labels=labels)
    rows = QUERIES["op5_quality"](spark, sf).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
    assert len({r["score"] for r in rows if r["doc_id"] in (None, 7)}) == 1  # the text alone decides
    kept = quality.keep_good(odd_documents(spark).withColumnRenamed("h", "score"), labels)
    assert "score" in kept.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_nothing_to_learn_or_score(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_decisions(odd_documents(spark), labels).collect()
    assert {r["score"] for r in rows} == {0.5} and len(rows) == len(ODD)
    assert quality.quality_decisions(no_documents(spark), labels).count() == 0
    assert quality.keep_good(no_documents(spark), labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in found if r["quality"] == 1]
    bad = [r["predicted"] for r in found if r["quality"] == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.15


def test_long_texts_are_learned_from_start_to_end(spark):
    text = "".join(chr(33 + i * 90 // 20_000) for i in range(20_000))
    piece = spark.createDataFrame([(text,), ("short é",)], "text string").select(quality._pieces(quality.F.col("text"))).collect()
    assert len(piece[0][0]) == quality.PIECES * quality.PIECE
    assert piece[0][0][:1] == text[:1].encode() and piece[0][0][-1:] == text[-1:].encode()
    assert bytes(piece[1][0]) == "short é".encode()
    assert FILTERS > 0
