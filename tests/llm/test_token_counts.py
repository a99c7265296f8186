import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from corpusloom.llm.token_counts import _Lengths, count_tokens, run_lengths, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, n_bytes int"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def test_counts_are_the_librarys(library):
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "▁", "é", "é", "\t", "\x00", "<s>", "\r\n", "𝔘", "  \n", " \n", "　", "日本", "x" * 70]
    plain, runs = _Lengths(library.encode, {}, 50), run_lengths(library.encode, 20)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert count_tokens(text, plain, runs) == len(library.encode(text))


def test_rows(spark, library):
    texts = [None, "", "a", "word " * 20_000, "x" * 50_000, "same", "same", "two\nlines\n\n", " <s> ▁▁ "]
    rows = [(i if i != 6 else None, t, "clash", 1) for i, t in enumerate(texts)]
    got = token_counts(spark.createDataFrame(rows, SCHEMA), MODEL).collect()
    want = sorted((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "")), len(library.encode(r[1] or "")) > 4096) for r in rows if r[0] is not None)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows)
    assert token_counts(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
