import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm import minhash, textops

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, rid int, kept string, row int"


def _bag(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _brute(rows):
    bags, up = [_bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and 10 * both >= 8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def _check(spark, rows):
    df = spark.createDataFrame([(*r, i, "clash", 1) for i, r in enumerate(rows)], SCHEMA).coalesce(1)
    got = {r.row.rid: r for r in minhash.minhash_classes(df).collect()}
    assert len(got) == len(rows)
    for members in _brute(rows).values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        assert {got[i].class_id for i in members} == {min(ids) if ids else None}
        assert {got[i].class_size for i in members} == {len(members)} and sum(got[i].kept for i in members) == 1
        assert all(rows[i][0] == min(ids) for i in members if got[i].kept and ids)


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for family in range(8):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 80, 200]))]
        rows += [(len(rows) + k, _edited(rng, base, rng.choice([0, 1, 2, 4, 8]))) for k in range(12)]
    rows += [(500, None), (501, ""), (502, "!!"), (503, "one two"), (504, "One TWO"), (505, "one two three"), (None, rows[3][1]), (3, rows[3][1]), (506, "a b " * 4000), (507, "a b " * 4000 + "c"), (508, "la " * 300), (509, "la " * 200), (510, "x" * 50_000)]
    _check(spark, rows)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    _check(spark, [(i, _edited(rng, base, rng.randrange(0, 9))) for i in range(150)])


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert minhash.minhash_classes(df).count() == 0
    df = spark.createDataFrame([(2, "a b c d e f", 1, "x", 1), (1, "A b c d e f", 2, "y", 2)], SCHEMA)
    out = minhash.minhash_dedup(df)
    assert out.dtypes == df.dtypes and [r.doc_id for r in out.collect()] == [1]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for most in (2, 3, 12):
        base = rng.integers(1, 2**63, 60).astype(np.uint64)
        a = rng.integers(1, most, 60)
        b = np.maximum(1, a + rng.integers(-1, 2, 60))
        true, found = np.minimum(a, b).sum() / np.maximum(a, b).sum(), []
        for t in range(30):
            s = minhash.bag_signatures(np.repeat([0, 1], 60), np.tile(textops.mix(base + np.uint64(t)), 2), np.concatenate([a, b]), 2, 128)
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - true) < 5 * np.std(found) / len(found) ** 0.5 + 0.005


def test_bound_by_a_pivot_is_never_too_low():
    rng = np.random.default_rng(4)
    for _ in range(300):
        draw = lambda: np.unique(rng.integers(0, 40, 60).astype(np.uint64), return_counts=True)
        (x, n), (y, m), (z, k) = draw(), draw(), draw()
        a, b, pivot = (x, n, int(n.sum())), (y, m, int(m.sum())), (z, k, int(k.sum()))
        (ea, la), (eb, lb) = minhash.lacking(a, pivot), minhash.lacking(b, pivot)
        lacks = sum(bin((p | q) & (2**64 - 1)).count("1") for p, q in zip(la, lb, strict=True))
        assert minhash.overlap(a, b) <= pivot[2] - lacks + min(ea, eb)
