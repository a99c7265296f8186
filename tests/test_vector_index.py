"""The persisted vector index against a scan."""

import numpy as np
import pytest

from corpusloom.operators.vector_index import VectorIndex
from corpusloom.session import scratch_path

SCHEMA = "vec_id long, embedding array<double>, label string"


def _scan(rows, queries, k, metric, own=False):
    out = []
    for a, v in queries:
        scored = []
        for b, w in rows:
            if own or a != b:
                x, y = np.array(v), np.array(w)
                s = x @ y / np.sqrt((x @ x) * (y @ y)) if metric == "cosine" else -np.sqrt(((x - y) ** 2).sum())
                scored.append((-round(float(s), 6) + 0.0, b))
        out += [(a, b, -s + 0.0) for s, b in sorted(scored)[:k]]
    return sorted(out)


def _got(found):
    return sorted((r.query_id, r.id, r.score + 0.0) for r in found.collect())


def _rows(n, clusters, spread, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, [float(x) for x in centres[i % clusters] + rng.normal(size=dim) * spread]) for i in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_search_equals_a_scan(spark, metric):
    rows = _rows(600, 12, 0.1) + [(1000 + i, v) for i, v in _rows(40, 40, 1.0, seed=9)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1])]  # ties
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(3000, None, "x"), (3001, [float("nan")] * 8, "x"), (3002, [1.0, None] + [0.0] * 6, "x")], SCHEMA)
    queries = [r for r in rows if r[0] % 50 == 0] + [(7777, [0.3] * 8)]
    asked = spark.createDataFrame([(*r, "x") for r in queries] + [(8000, None, "x")], SCHEMA)
    index = VectorIndex(spark, scratch_path(spark, "vectors"), metric)
    assert index.search(asked, 5).count() == 0
    assert index.build(df, lists=24) == 24
    assert _got(index.search(asked, 5)) == _scan(rows, queries, 5, metric)
    # rows of other clusters are never scored
    assert index.scored < index.whole / 3
    assert _got(index.search(asked, 700, block=5)) == _scan(rows, queries, 700, metric)
    assert _got(index.search(asked, 1, own=True)) == _scan(rows, queries, 1, metric, own=True)
    more = [(5000 + i, v) for i, v in _rows(100, 12, 0.1, seed=4)]
    index.append(spark.createDataFrame([(*r, "x") for r in more], SCHEMA))
    index.delete(df.where("vec_id < 100"))
    left = [r for r in rows + more if r[0] >= 100]
    assert _got(index.search(asked, 7)) == _scan(left, queries, 7, metric)


def test_vectors_without_clusters(spark):
    rows = _rows(300, 300, 1.0, dim=24)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    index = VectorIndex(spark, scratch_path(spark, "vectors"))
    index.build(df)
    queries = rows[::60]
    assert _got(index.search(spark.createDataFrame([(*r, "x") for r in queries], SCHEMA), 10)) == _scan(rows, queries, 10, "cosine")


def test_empty_table(spark):
    index = VectorIndex(spark, scratch_path(spark, "vectors"))
    assert index.build(spark.createDataFrame([], SCHEMA)) == 0
    with pytest.raises(ValueError):
        VectorIndex(spark, "x", "dot")
