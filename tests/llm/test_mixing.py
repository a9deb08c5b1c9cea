import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import ODD, no_documents, odd_documents
from tracewarden.llm import mixing
from tracewarden.llm.queries import QUERIES


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Share by weight, then hand the excess on again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, spare, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    for _ in range(10_000):
        each = sum(weight[s] for s in open_)
        if spare <= 1e-9 or not open_:
            break
        for s in open_:
            target[s] += spare * weight[s] / each
        spare = sum(max(0.0, target[s] - 2 * sizes[s]) for s in order)
        target = {s: min(target[s], 2.0 * sizes[s]) for s in order}
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
    return target


def check_plan(rows, documents, close):
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter((d, words(t), s) for d, t, s in documents)
    sizes = Counter()
    for _, text, source in documents:
        sizes[source] += words(text)
    targets, taken, longest = brute_targets(sizes), Counter(), defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-9)
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= close * target + longest[source] * (close > 0.01)


def test_odd_rows(spark):
    rows = mixing.mixing_plan(odd_documents(spark)).collect()
    check_plan(rows, [(r[0], r[1], r[3]) for r in ODD], close=1.0)
    assert mixing.mixing_plan(no_documents(spark)).count() == 0


def test_all_documents_in_small_buckets(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    first = mixing.mixing_plan(docs).collect()
    check_plan(first, documents, close=0.25)
    again = mixing.mixing_plan(docs.repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    monkeypatch.setattr(mixing, "BUCKET", 2)
    check_plan(mixing.mixing_plan(docs).collect(), documents, close=0.25)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(QUERIES["op6_mixing"](spark, sf_dir).columns)


def test_large_sources_meet_their_targets(spark):
    documents = [(i, "w " * (1 + (i * i) % 400), ("hot", "b", "c", "d", None)[0 if i % 3 == 0 else i % 5]) for i in range(9000)]
    rows = mixing.mixing_plan(spark.createDataFrame(documents, "doc_id long, text string, source string")).collect()
    check_plan(rows, documents, close=0.001)


def test_the_mix_repeats_whole_rows(spark):
    docs = odd_documents(spark)
    plan = Counter()
    for r in mixing.mixing_plan(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +plan
    assert mixing.mix_documents(no_documents(spark)).count() == 0


def test_rates_solve_the_dual(spark):
    import numpy as np
    import pandas as pd

    cells = pd.DataFrame({"place": [0, 0, 0, 1, 1], "size": [10, 100, 1000, 5, 50], "n": [30, 20, 2, 7, 3]})
    size = cells["n"] * cells["size"]
    whole = size.groupby(cells["place"]).sum()
    sources = pd.DataFrame({"place": [0, 1], "source_size": whole.to_numpy(), "target": [0.6 * whole[0], 1.7 * whole[1]], "scale": [300.0, 20.0]})
    state = mixing._tilts(spark.createDataFrame(cells), sources)
    for place, tilt, scale, target in state[["place", "tilt", "scale", "target"]].to_numpy():
        own = cells["place"] == place
        rate = np.minimum(2, np.exp(tilt * cells["size"] / scale))
        assert (rate * size)[own].sum() == pytest.approx(target, rel=1e-6)
