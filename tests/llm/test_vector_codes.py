import hashlib
import math
import random

import numpy as np
import pytest

from corpusloom.llm import vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def _brute(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector of floats or None, label)."""
    good = [(i, [math.floor(256 * np.float32(x)) for x in v], k) for i, v, k in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return []
    width = len(good[0][1])
    good = [r for r in good if len(r[1]) == width]
    d = width // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))

    def near(x, book):
        return min((far(x, e), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = {}
            for _, v, _ in good:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            new.append([[sum(x) // len(x) for x in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])])
        books = new
    out, by = [], {}
    for i, v, k in good:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(f for f, _ in found)
        by[k] = by.get(k, 0) + error
        out.append((i, "".join(f"{c:02x}" for _, c in found), error, k))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[k], digest) for i, c, e, k in out), key=repr)


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in op.vector_codes(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 30, 300])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 % 1009, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [rows[0]] * 40  # a group of copies
    rows += [(2000 + i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(32)], 7) for i in range(60)]  # ties
    rows += [(1, None, 0), (2, [], 0), (3, [float("nan")] * 32, 0), (4, [float("inf")] + [0.0] * 31, 0), (5, [None] + [0.0] * 31, 0), (6, [0.5] * 16, 0), (7, [0.5] * 33, 0)]
    rows += [(None, [0.1] * 32, None), (rows[0][0], [0.3] * 32, 1)]
    assert _run(spark, rows) == _brute(rows)


def test_codebooks_of_other_shapes(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(12)], 0) for i in range(50)]
    assert _run(spark, rows, parts=4, entries=9, rounds=3, bits=2) == _brute(rows, 4, 9, 3)


def test_first_vector_of_another_length(spark):
    rows = [(i, [0.1 * i] * (16 if i % 2 else 32), 0) for i in range(1, 20)]
    assert _run(spark, rows) == _brute(rows)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(0)
    entries = rng.integers(-100, 100, (64, 4))
    entries[10] = entries[3]
    query = rng.integers(-120, 120, (500, 4))
    va = op.Approximation(entries, 4)
    lower, upper = va.bounds(query)
    far = ((query[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (lower <= far).all() and (far <= upper).all()
    code, least = va.nearest(query)
    assert (code == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
    assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.3


def test_empty_table_and_components_too_large(spark):
    assert _run(spark, []) == [] and _run(spark, [(1, None, 0)]) == []
    with pytest.raises(ValueError, match="beyond"):
        _run(spark, [(1, [1e30] * 16, 0)])
