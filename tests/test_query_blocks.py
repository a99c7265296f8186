"""Legs of a search meet a batch of queries by blocks: the same scores, and a worker's memory doesn't follow the queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R


def _texts(rng, n, words, vocabulary):
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, words))) for _ in range(n)]


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
@pytest.mark.parametrize("most", [None, 3])
def test_blocks_give_the_same_scores(spark, monkeypatch, cells, most):
    """Against the shuffle join and a plain model: copies, ties, empty texts, terms that a query has twice, texts longer than a block."""
    rng = random.Random(30)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = _texts(rng, 60, 30, vocabulary) + ["", "w1 w2"] * 4 + [" ".join(vocabulary * 3)]
    asked = [*_texts(rng, 23, 8, vocabulary), "w1 w1 w2", "nothing", ""]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    terms = spark.createDataFrame([(100 + q, t) for q, text in enumerate(asked) for t in text.split()], "q long, term string")

    def best(hits, key="q"):
        hits = hits if most is None else R.ranked(hits, key, "chunk_id", most)
        return {(r[key], r.chunk_id): r.score for r in hits.collect()}

    with monkeypatch.context() as m:
        m.setattr(R, "_TERMS", 0)
        want = best(R.bm25(chunks, "chunk_id", terms, "q", most=most))
    monkeypatch.setattr(R, "_CELLS", cells)
    got = best(R.bm25(chunks, "chunk_id", terms, "q", most=most))
    assert len(want) > 50 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)

    a, b = R.text_vectors(texts), R.text_vectors(asked)
    size = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))
    cosine = np.round(np.divide(a @ b.T, size, out=np.zeros(size.shape), where=size > 0), 6)
    plain = {}
    for q in range(len(asked)):
        for x in sorted(np.flatnonzero(cosine[:, q]).tolist(), key=lambda x: (-cosine[x, q], x))[:most]:
            plain[q, x] = cosine[x, q]
    hits = R.text_leg(chunks, list(enumerate(asked)), "q", "long", ("chunk_id",), most or len(texts))
    got = best(hits)
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 2e-6 for k in plain)


@pytest.mark.parametrize("leg", ["lexical", "dense"])
def test_a_worker_s_memory_does_not_follow_the_queries(spark, tmp_path, monkeypatch, leg):
    def noting(run):
        def wrapped(batches):
            import tracemalloc
            import uuid

            tracemalloc.start()
            try:
                yield from run(batches)
            finally:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(tracemalloc.get_traced_memory()[1] >> 20))
                tracemalloc.stop()

        return wrapped

    folder = str(tmp_path)
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(300)]
    chunks = spark.createDataFrame(list(enumerate(_texts(rng, 2_000, 120, vocabulary))), "chunk_id long, text string").coalesce(1)
    asked = list(enumerate(_texts(rng, 5_000, 40, vocabulary)))
    if leg == "lexical":
        rows = R.counted(chunks, ("chunk_id",), R.T.WORD, None)
        monkeypatch.setattr(R, "lean", noting)
        hits = R.scored(rows, ("chunk_id",), "q", [(q, t, 1.0) for q, text in asked for t in text.split()], "long", 60.0, 1.2, 0.75, 30)
    else:
        monkeypatch.setattr(R, "lean", noting)
        hits = R.text_leg(chunks, asked, "q", "long", ("chunk_id",), 30)
    assert hits.agg(F.count_distinct("q")).first()[0] > 4_000
    peaks = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert peaks and max(peaks) < 150, peaks
