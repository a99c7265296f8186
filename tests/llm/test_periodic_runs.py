import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import periodic_runs as op

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, runs string, n_words int"


def _brute_runs(w, exponent=4, least=6):
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and all(any(w[k] != w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def _plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = h % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def _brute(doc_id, text):
    w = _plant(doc_id, WORD.findall(text or ""))
    found = _brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else (None,) * 3
    milli = 1000 * top[1] // top[2] if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *top, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (2, 6), (3, 5), (3, 1)])
def test_runs_against_brute_force(exponent, least):
    rng = random.Random(exponent * 10 + least)
    for _ in range(700):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 8)
            w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < n else 9 for i in range(a, n)]
        got = op.found_runs(np.array(w, np.int64), np.zeros(n, np.int64), exponent, least)
        assert [tuple(x) for x in got.tolist()] == _brute_runs(w, exponent, least)


def test_rows_do_not_run_into_each_other():
    rng = random.Random(4)
    rows = [[rng.randrange(2) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    codes, row = np.array([x for w in rows for x in w]), np.repeat(np.arange(len(rows)), [len(w) for w in rows])
    first = np.cumsum([0, *map(len, rows)])
    want = [(int(first[r]) + s, n, q) for r, w in enumerate(rows) for s, n, q in _brute_runs(w)]
    assert [tuple(x) for x in op.found_runs(codes, row, 4, 6).tolist()] == want


def test_filter_keeps_all_runs_and_drops_plain_text():
    rng = np.random.default_rng(1)
    prose = rng.zipf(1.3, 20_000) % 3_000
    text = np.concatenate([prose, np.tile(np.arange(5000, 5040), 4), prose[:500]])
    a, b = op.stretches(text, np.zeros(len(text), np.int64), 4, 6)
    assert any(x <= 20_000 and y >= 20_160 for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert (b - a).sum() < 0.2 * len(text)


def test_query_against_brute_force(spark):
    rng = random.Random(13)
    vocabulary = ["the", "of", "é", "😀", "a", "b.", "C", "c"]
    blanks = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n"]
    texts = []
    for i in range(400):
        w = [rng.choice(vocabulary[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            w += w[-rng.randint(1, 7) :] * rng.randint(1, 9)
        texts.append((i * 7, rng.choice(["", " "]) + "".join(x + rng.choice(blanks) for x in w)))
    texts += [(5000, None), (5001, ""), (5002, " \n "), (None, "a a a a a a a"), (7, texts[1][1]), (7, texts[1][1]), (5003, "la " * 20_000), (5004, "x y " * 9), (5005, "\x1c\x1d " * 8)]
    docs = spark.createDataFrame([(*t, "clash", 1) for t in texts], SCHEMA).repartition(6)
    got = sorted((tuple(r) for r in op.report(op.periodic_runs(op.planted(docs))).collect()), key=repr)
    assert [g for g in got if g[0] != 5003] == sorted((_brute(*t) for t in texts if t[0] != 5003), key=repr)
    (long,) = [g for g in got if g[0] == 5003]
    assert long[1:6] == (1, 0, 20_000, 1, 20_000_000)


def test_long_texts(spark):
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    rng = random.Random(0)
    block = [f"w{rng.randrange(9_000)}" for _ in range(12_000)]
    texts = [(1, " ".join(map(str, b))), (2, " ".join(block * 5)), (3, "")]
    rows = {r.doc_id: r for r in op.periodic_runs(spark.createDataFrame([(*t, "", 1) for t in texts], SCHEMA)).collect()}
    assert [tuple(x) for x in rows[2].runs] == [(0, 60_000, 12_000)] and rows[2].collapsed == " ".join(block)
    assert rows[1].runs == [] and rows[1].n_words == len(b) and rows[3].n_words == 0


def test_empty_table(spark):
    assert op.report(op.periodic_runs(op.planted(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_query_begins_at_a_tenth_of_the_crc(spark, tmp_path):
    from corpusloom.llm import queries

    ids = [i for i in range(4_000) if zlib.crc32(str(i).encode()) % 10 == 0][:120]
    rows = [(i, " ".join(f"{i}.{k}" for k in range(k + 1)), "", 1) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        w, g = text.split(), zlib.crc32(str(i).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = _brute_runs(w)
        assert got[i].n_runs == len(found) and got[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert [got[i].start, got[i].length, got[i].period] == (list(max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]))) if found else [None] * 3)
