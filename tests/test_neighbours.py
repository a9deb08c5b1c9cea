"""Neighbours by matrix products: exact against brute force, and no more visits than blocks of full size ask for."""

import numpy as np
from pyspark.sql import functions as F

from tracewarden.operators import neighbours


def test_vectors_without_structure_visit_full_blocks(spark, monkeypatch):
    """Bounds rule nothing out of random vectors; they used to be copied to a cell per root of their number."""
    points = np.random.default_rng(3).normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(points)], "vec_id long, embedding array<double>, label int")
    seen, kept = [], neighbours._compared
    monkeypatch.setattr(neighbours, "_compared", lambda visits, references, k: seen.append(visits.count()) or kept(visits, references, k))
    got = {}
    for r in neighbours.nearest(df, df, block_rows=300).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    for i, v in enumerate(points):
        distance = np.sqrt(((points - v) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(600), distance)) if j != i][:5]
        assert [got[i][n] for n in range(1, 6)] == [(j, distance[j]) for j in order]
    assert sum(seen) <= 600 * 6


def test_products_lose_no_neighbour():
    """Far from zero, products round off what tells neighbours apart; squares may overflow; ids repeat."""
    rng = np.random.default_rng(4)
    for base, scale in ((1e8, 1.0), (0.0, 1e-9), (1e200, 1e199), (0.0, 1.0)):
        matrix = base + scale * rng.integers(-3, 4, size=(300, 8))
        ids, radius = np.arange(300) // 2, np.full(50, np.inf)
        query, ref = neighbours._near(matrix[:50], radius, ids[:50], matrix, ids, 3)
        with np.errstate(over="ignore"):
            distance = np.sqrt(((matrix[:50, None, :] - matrix) ** 2).sum(axis=2))
        for q in range(50):
            others = np.flatnonzero(ids != ids[q])
            want = set(others[distance[q, others] <= np.sort(distance[q, others])[2]])
            assert want <= set(ref[query == q])
