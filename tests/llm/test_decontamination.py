import hashlib
import random
import re

import pytest

from corpusloom.llm import decontamination as op

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, v int, items string, h1 int", "item_id long, text string, w string"


def _words(text):
    return WORDS.findall((text or "").translate(LOWER))


def _brute(docs, items):
    windows = {}
    for item, text in items:
        w = _words(text)
        if item is not None:
            for i in range(max(1, len(w) - 12) if w else 0):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def _frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "clash", 2) for d in docs], DOCS), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)


@pytest.mark.parametrize("block", [100_000, 7])
def test_against_brute_force(spark, block):
    rng = random.Random(5)
    vocabulary = ["the", "of", "a", "É", "é", "x1", "word", "rare", "b", "zz"] + [f"w{i}" for i in range(30)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 3, 13, 14, 40]))) for i in range(12)] + [(50, None), (51, ""), (None, sentence(20)), (3, sentence(5)), (60, "the the the " * 6)]
    docs = []
    for i in range(50):
        parts = [sentence(rng.randint(0, 60))]
        if i % 2:
            parts.insert(rng.randint(0, 1), (rng.choice(items)[1] or "").upper())
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (7, docs[7][1]), (7, "the"), (None, docs[3][1]), (102, "the " * 3000), (103, "!!!")]
    d, b = _frames(spark, docs, items)
    got = sorted((tuple(r) for r in op.contamination(d, b, block=block).collect()), key=repr)
    assert got == _brute(docs, items)
    kept = sorted((r.doc_id, r.text) for r in op.uncontaminated(d, b).where("doc_id IS NOT NULL").collect() if r.text is not None)
    flags = {}
    for doc in docs:
        flags[doc] = _brute([doc], items)[0][-1]
    assert kept == sorted(x for x in docs if x[0] is not None and x[1] is not None and not flags[x])
    assert op.uncontaminated(d, b).columns == d.columns


def test_empty_tables(spark):
    d, b = _frames(spark, [(1, "a b c")], [])
    assert op.contamination(d, b).first().contaminated is False
    d, b = _frames(spark, [], [(1, "a b c")])
    assert op.contamination(d, b).count() == 0 and op.uncontaminated(d, b).count() == 0


def test_main_path_runs_no_python(spark):
    d, b = _frames(spark, [(1, "a b c")], [(1, "a b c")])
    plan = op.contamination(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
