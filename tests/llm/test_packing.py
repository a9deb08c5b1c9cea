import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, no_documents, odd_documents
from tracewarden.llm import packing
from tracewarden.llm.queries import QUERIES
from tracewarden.llm.tokens import ByteBpe, tokenizer_path


def reference_ids(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_the_tokenizers():
    white = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\xa0", "\u3000 ", "\x1c", "\x85", "\r\n", "   "]
    words = ["it's", "x", "12a", "É!", "日本", "'ll", "don't.", "<|endoftext|>", "\0", "é", "🙂", "²³", "ªº", "a" * 600]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(words) + rng.choice(white) for _ in range(rng.integers(0, 9))) for _ in range(800)]
    texts += [f"a{chr(c)}b {chr(c)} c\n{chr(c)}  {chr(d)}1{chr(c)}" for c in range(0x110) for d in range(0, 0x100, 17)] + [r[1] or "" for r in ODD]
    bpe = ByteBpe(tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
    assert [bpe.encode(t).tolist() for t in texts] == reference_ids(texts)


def check_pieces(rows, documents, waste):
    ids = [i + [1] for i in reference_ids([t for _, t in documents])]
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(documents, ids))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        data = bytes(r["ids"])
        assert r["length"] * 4 == len(data) and zlib.crc32(data) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], data))
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len({(r["tier"], r["step_group"]) for r in found}) == 1
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= waste
    got = Counter()
    for (doc_id, n), parts in pieces.items():
        at_start = defaultdict(list)
        for start, data in parts:
            at_start[start].append(data)
        for _ in range(len(at_start[0])):  # copies may be cut at different places
            whole = b""
            while len(whole) < 4 * n:
                whole += at_start[len(whole) // 4].pop()
            got[doc_id, n, zlib.crc32(whole)] += 1
        assert not any(at_start.values())
    assert got == want


def test_odd_rows(spark):
    rows = packing.pack_documents(odd_documents(spark), with_ids=True).collect()
    check_pieces(rows, [(r[0], r[1]) for r in ODD], waste=3 * 2048)
    assert packing.pack_documents(no_documents(spark)).count() == 0


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, with_ids=True).collect()
    check_pieces(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], waste=docs.rdd.getNumPartitions() * 2048)
    plain = QUERIES["op2_packing"](spark, sf_dir)
    assert "ids" not in plain.columns and plain.count() == len(rows)


def test_step_groups_are_balanced(spark):
    docs = spark.createDataFrame([(i, "lorem ipsum dolor " * (20 + 37 * i % 900)) for i in range(900)], "doc_id long, text string")
    rows = packing.pack_documents(docs.repartition(4)).groupBy("tier", "step_group").agg({"length": "sum"}).collect()
    tiers = defaultdict(dict)
    for tier, group, tokens in rows:
        tiers[tier][group] = tokens
    for groups in tiers.values():
        assert sorted(groups) == list(range(len(groups)))
        assert all(tokens >= packing.STEP_TOKENS - 4 * 2048 for group, tokens in groups.items() if group < len(groups) - 1)
