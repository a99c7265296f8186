import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, piece int"


def test_ids_are_the_librarys():
    rng = random.Random(2)
    library = Tokenizer.from_file(PATH)
    encode = packing.Encoder(open(PATH, encoding="utf-8").read())
    parts = ["a", "it's", " ", "  ", "\n", "é", "ß", "²", "\t", "<|endoftext|>", "ing", "\r\n", "…", "12", "%%", "日本", "\x85", "\xa0", "🙂", "\x1c"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 40), st.data())
def test_plan_is_a_packing(capacity, data):
    histogram = {n: data.draw(st.integers(0, 7)) for n in range(1, capacity)}
    slots, bins = packing.plan(dict(histogram), capacity)
    content, given_ = {}, Counter()
    for length, rank, n, first, offset in slots:
        assert rank == given_[length]
        given_[length] += n
        for i in range(n):
            content.setdefault(first + i, []).append((offset, length))
    assert all(given_[n] == c for n, c in histogram.items()) and len(content) == bins
    for bin_ in content.values():
        at = 0
        for offset, length in sorted(bin_):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in bin_) <= 2


def test_plan_stays_close_to_the_bound_and_small():
    histogram = {n: 1000 + n * n % 97 for n in range(1, 1024)}
    slots, bins = packing.plan(dict(histogram), 1024)
    assert bins <= 1.001 * sum(n * c for n, c in histogram.items()) / 1024 + 1 and len(slots) < 10_000


def test_rows(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc de\n") for _ in range(rng.choice([0, 3, 50, 900, 6000]))), "clash", 9) for i in range(60)]
    rows += [(60, None, "x", 1), (61, "", "x", 1), (5, rows[5][1], "x", 1), (None, "word " * 3000, "x", 1)]
    library = Tokenizer.from_file(PATH)
    out = packing.best_fit_packing(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= sum(r.length for r in out) / 1024 * 1.1 + 2
    kept = packing.best_fit_packing(spark.createDataFrame(rows[:5], SCHEMA), PATH, keep_ids=True).first()
    assert len(kept.ids) == kept.length
    assert packing.best_fit_packing(spark.createDataFrame([], SCHEMA), PATH).count() == 0
