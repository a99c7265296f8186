import zlib

import pyarrow as pa
import pytest

from corpusloom.llm import quality

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, `#x` int"


@pytest.fixture(scope="module")
def weights(spark):
    return quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, weights):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score(docs, weights).where("held_out").join(labels, "doc_id").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_rows(spark, weights):
    texts = [None, "", "plain words here", "plain words here", "!!! $$$ %%%", "word " * 50_000, "x" * 100_000]
    rows = [(None if i == 3 else i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.score(df, weights).collect()}
    assert len(got) == len(rows) and got[None].held_out and got[None].score == got[2].score and got[0].score == got[1].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    want = {i: s for i, s in zip((r[0] for r in rows), quality.scores(pa.array([t or "" for t in texts], pa.large_string()), weights, 18), strict=True)}
    assert all(abs(got[i].score - want[i]) < 1e-12 for i in want)
    kept = quality.accepted(df, weights)
    assert kept.dtypes == df.dtypes and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] >= 0.3}
    assert quality.score(df.limit(0), weights).count() == 0


def test_only_the_text_is_used(spark, weights):
    a = quality.score(spark.createDataFrame([(1, "some text", "en", 1)], SCHEMA), weights).first().score
    b = quality.score(spark.createDataFrame([(99, "some text", "de", 7)], SCHEMA), weights).first().score
    assert a == b


def test_labels_of_the_held_out_fold_are_not_learned(spark, weights):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert (quality.fit(docs, flipped) == weights).all()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    w = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs, w).first().score == 0.5


def _plain_score(text, weights, bits):
    """The score of one text, word by word, with dicts."""
    import math
    import re

    import numpy as np

    from corpusloom.llm import textops

    one = lambda x: int(textops.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    hashed = lambda raw: int(textops.hash_spans(textops.LOWER[np.frombuffer(raw, np.uint8)], np.array([0]), np.array([len(raw)]))[0])
    words = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x00-\x20\x7f]+", text.encode())
    shapes = []
    for w in words:
        upper = sum(65 <= b <= 90 for b in w)
        case = 0 if not upper else 1 if upper == len(w) else 2 if upper == 1 and 65 <= w[0] <= 90 else 3
        kind = 1 if re.match(rb"[A-Za-z\x80-\xff]", w) else 2 if w[:1].isdigit() else 3
        shapes.append(hashed(w) if kind == 3 else one(kind << 8 | case << 4 | min(len(w) // 4, 7)))
    counts = {}
    for runs, salt in (([hashed(w) for w in words], 1), (shapes, 7)):
        for i in range(len(runs)):
            gram = one(runs[i] + salt)
            for n in range(3):
                if n:
                    if i + n >= len(runs):
                        break
                    gram = one(gram * 31 + runs[i + n])
                counts[gram >> (64 - bits)] = counts.get(gram >> (64 - bits), 0) + 1
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1
    return 1 / (1 + math.exp(-(sum(weights[k] * math.log1p(c) for k, c in counts.items()) / norm + weights[-1])))


def test_scores_against_a_plain_scorer(spark, weights):
    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts = [*docs, "", "A", "a b", "Ab, c1 22!! ÉÉ éa", "same same same", "x\ty\nz"]
    got = quality.scores(pa.array(texts, pa.large_string()), weights, 18)
    assert all(abs(_plain_score(t, weights, 18) - s) < 1e-9 for t, s in zip(texts, got, strict=True))


def test_word_order_counts(spark, weights):
    a, b = "the cat sat on the mat today", "mat the on sat cat the today"
    data = quality.textops.buffers(pa.array([a, b]))
    place, _, ptr = quality.features(*data, 18)
    assert set(place[: ptr[1]]) != set(place[ptr[1] :])


def test_an_id_that_repeats_is_learned_once(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    some = docs.where("doc_id < 100")
    again = some
    for _ in range(4):
        again = again.unionByName(again)
    assert (quality.fit(again, labels.unionByName(labels)) == quality.fit(some, labels)).all()


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, ("good words here " if i % 2 else "bad bad !!! ") * (50 if i % 10 else 3000)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")

    def sizes(**kw):
        caught = []
        monkeypatch.setattr(type(docs), "repartition", lambda self, n, *a: caught.append(self) or self.coalesce(n))
        w = quality.fit(docs, labels, **kw)
        monkeypatch.undo()
        return [len(r.text.encode()) for r in caught[-1].select("text").collect()], w

    all_rows, w = sizes(max_bytes=100 << 20)
    assert len(all_rows) == sum(1 for i, _ in rows if zlib.crc32(str(i).encode()) % 5)
    few, w = sizes(max_bytes=80_000)
    # whole rows, none above an eighth, as many as fit
    assert 60_000 < sum(few) <= 80_000 and max(few) <= 10_000 and w.any()
    none, w = sizes(max_bytes=100)
    assert none == [] and not w.any()
