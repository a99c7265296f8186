import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import embedding_links as links

SCHEMA = "vec_id long, embedding array<float>, label int, node string, row int"


def _brute(rows, cosine=0.93):
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[k] = np.array(v, np.float32).astype(np.float64)
    n, up = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in good:
        for y in good:
            if x < y and rows[x][2] == rows[y][2] and len(good[x]) == len(good[y]):
                a, b = good[x], good[y]
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    n[x], n[y] = n[x] + 1, n[y] + 1
                    up[max(find(x), find(y))] = min(find(x), find(y))
    out = []
    for k, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((vec, n[k], c, vec == c))
    return sorted(out, key=repr)


def _run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    out = links.embedding_links(df, **options)
    return sorted(((r.row.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=repr)


def _rows(seed, n=160, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    out = []
    for i in range(n):
        c = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.3, 1.0])
        out.append((int(i * 7 % n), [float(np.float32(x)) for x in c * rng.uniform(0.1, 5)], int(rng.integers(3))))
    return out


def test_against_brute_force(spark):
    rows = _rows(1)
    v = rows[0][1]
    rows += [(900, v, rows[0][2]), (901, v, rows[0][2]), (902, v, None), (903, None, 0), (904, [0.0] * 6, 0), (905, [float("nan")] + v[1:], 0), (906, [None] + v[1:], 0), (907, [float("inf")] + v[1:], 0), (908, v[:3], rows[0][2]), (None, v, rows[0][2]), (909, [], 0), (900, v, rows[0][2])]
    assert _run(spark, rows) == _brute(rows)
    assert _run(spark, rows, block=16) == _brute(rows)
    assert _run(spark, rows, block=4, sample_rows=20) == _brute(rows)


def test_tiny_and_huge_doubles(spark):
    base = [[1.0, 2.0, 3.0], [1.01, 2.0, 3.0], [3.0, -1.0, 0.5]]
    rows = [(3 * k + i, [x * f for x in v], 1) for k, f in enumerate((1.0, 1e-200, 1e200)) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.row.vec_id: (r.n_links, r.component_id) for r in links.embedding_links(df).collect()}
    assert got == {i: (5, 0) if i % 3 < 2 else (2, 2) for i in range(9)}


def test_far_cells_do_not_meet(spark):
    """Of tight groups each point is sent to a few tasks, however many groups the label has."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    v = np.repeat(centres, 30, axis=0) + 0.02 * rng.normal(size=(1200, 32))
    points = spark.createDataFrame([(1, 32, i, 1, x.tolist()) for i, x in enumerate(v)], "label int, width int, node long, copies long, v array<double>")
    large = spark.createDataFrame([(1, 32, 1200)], "label int, width int, n long")
    limit = float(np.sqrt(2 - 2 * 0.93))
    sent = links._leaves(points, large, 600, 30, limit * (1 + 1e-6), limit)
    assert 1200 <= sent.count() <= 2 * 1200


def test_empty_and_all_alike(spark):
    assert _run(spark, []) == []
    rows = [(i, [1.0, 2.0], 1) for i in range(50)]
    assert _run(spark, rows) == [(i, 49, 0, i == 0) for i in sorted(range(50), key=lambda i: repr((i, 49, 0, i == 0)))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.booleans())
def test_dual_traversal_finds_exactly_the_links(seed, n, split):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(max(1, n // 6), 4))[rng.integers(0, max(1, n // 6), n)] + rng.normal(size=(n, 4)) * rng.choice([0.001, 0.05, 0.2, 1], (n, 1))
    weight, second = rng.integers(1, 4, n), (rng.random(n) < 0.5) & split
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hit = unit @ unit.T >= 0.93
    np.fill_diagonal(hit, False)
    if second.any() and not second.all():
        hit &= second[:, None] != second[None, :]
    if second.all():
        second = np.zeros(n, bool)
    add, top = links.task_links(v, weight, second, 0.93)
    assert add.tolist() == (hit @ weight).tolist()
    for x, y in zip(*np.nonzero(hit), strict=True):
        assert top[x] == top[y]


def test_many_points_are_walked_in_bounded_parts():
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(900, 8)), rng.normal(size=(1, 8)) + 0.15 * rng.normal(size=(700, 8))])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for second in (np.zeros(1600, bool), rng.random(1600) < 0.5):
        hit = unit @ unit.T >= 0.93
        np.fill_diagonal(hit, False)
        if second.any():
            hit &= second[:, None] != second[None, :]
        add, top = links.task_links(v, np.ones(1600, np.int64), second, 0.93)
        assert add.tolist() == hit.sum(axis=1).tolist()
        x, y = np.nonzero(hit)
        assert (top[x] == top[y]).all()


def test_many_large_labels_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(links, "CELLS", 6)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)], int(i % 7)) for i in range(420)]
    seen = []
    told = links._centres
    monkeypatch.setattr(links, "_centres", lambda *a: seen.append(told(*a)) or seen[-1])
    monkeypatch.setattr(links._leaves, "__defaults__", (6,))
    assert _run(spark, rows, block=16) == _brute(rows)
    # every large label has centres of its own, and no pass all of them
    assert len(seen) > 1 and sum(map(len, seen)) == 7 and all(len(c) >= 2 for x in seen for c in x.values())


def test_one_component_of_all_rows(spark):
    """No task gets a component whole: the tables that are joined by it are written first."""
    rows = [(i, [1.0, float(np.float32(i / 1e5))], 0) for i in range(3000)]
    got = _run(spark, rows, block=500)
    assert {(n, c, k) for _, n, c, k in got} == {(2999, 0, True), (2999, 0, False)}
