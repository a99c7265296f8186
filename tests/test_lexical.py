"""Stems and scores against SQLite's full-text search; the persisted index against a scan."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.stem import STEP_2, STEP_3, STEP_4, measure, porter, stem
from corpusloom.operators import retrieval as R
from corpusloom.operators.lexical_index import LexicalIndex
from corpusloom.session import scratch_path

# Pairs of the published description of the algorithm.
PUBLISHED = dict(
    x.split(":")
    for x in "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radicalli:radic vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form electriciti:electr electrical:electr goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adoption:adopt communism:commun activate:activ effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll".split()
)


def test_published_stems():
    assert {w: porter(w) for w in PUBLISHED} == PUBLISHED
    assert [measure(w) for w in "tr ee tree y by trouble oats trees ivy troubles private oaten orrery".split()] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]


def _fts(texts):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    return db


def test_stems_against_sqlite(spark):
    rng = random.Random(0)
    words = {w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in re.findall(R.ALNUM, r.text.lower())}
    endings = [*STEP_2, *STEP_3, *STEP_4, "", "s", "ed", "ing", "y", "e", "ies", "sses", "eed", "ll"]
    words |= {"".join(rng.choice(["a", "b", "y", "e", "t", "l", "s", "o", "w", "st", "ion", "é", "7"]) for _ in range(rng.randint(1, 5))) + rng.choice(endings) + rng.choice(["", "", "s", "y"]) for _ in range(20_000)}
    words |= set(PUBLISHED) | {"a" * 63 + "s", "a" * 64 + "s"}
    db = _fts(sorted(words))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    stems = dict(db.execute("SELECT doc, term FROM v"))
    assert [(w, stems[i], stem(w)) for i, w in enumerate(sorted(words)) if stems[i] != stem(w)] == []


def test_search_against_sqlite(spark):
    rng = random.Random(1)
    words = "run running runner runs relate relational relation cat cats the of naïve élan x1 running".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    questions = ["running cats", "relations", "the the runs", "ELAN naive", "absent"]
    db, chunks = _fts(texts), spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")

    class C:
        def table(self, _):
            return spark.createDataFrame(list(enumerate(questions)), "item_id long, text string")

    got = {(r.item_id, r.chunk_id): r.score for r in R.bm25(chunks, "chunk_id", R.stemmed_items(C()), "item_id", style="floor", pattern=R.ALNUM, stemmed=True).collect()}
    want = {}
    for i, q in enumerate(questions):
        match = " OR ".join(f'"{w}"' for w in re.findall(r"\w+", q))
        want |= {(i, row): -s for row, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def _scan(texts, queries, k):
    hits = R.ranked(R.bm25(texts, "chunk_id", queries, "q"), "q", "chunk_id", k)
    return sorted((r.q, r.chunk_id, r.score, r.rank) for r in hits.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rare = [f"w{i}" for i in range(400)]
    common = ["the", "of", "and", "to", "in"]
    rows = []
    for i in range(3000):
        n = rng.randint(0, 40)
        rows.append((f"c{i:05d}", " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare[: 1 + int(400 * rng.random() ** 3)]) for _ in range(n)), f"d{i % 50}"))
    queries = [(q, t) for q in range(25) for t in rng.sample(rare, 3) + rng.sample(common, 3)] + [(90, "the"), (90, "the"), (91, "absent"), (92, "w0"), (92, "absent")]
    return spark.createDataFrame(rows, "chunk_id string, text string, document_id string"), spark.createDataFrame(queries, "q long, term string")


def test_index_gives_the_hits_of_a_scan_and_reads_fewer_blocks(spark, corpus):
    chunks, queries = corpus
    index = LexicalIndex(spark, scratch_path(spark, "index"), buckets=8, block=16)
    assert index.search(queries, "q", 5).count() == 0
    assert index.append(chunks.where("chunk_id < 'c02000'"), carry=("document_id",)) == 0 and index.append(chunks.where("chunk_id >= 'c02000'"), carry=("document_id",)) == 1
    for k in (1, 10, 5000):
        got = index.search(queries, "q", k, carry=("document_id",))
        assert sorted((r.q, r.chunk_id, r.score, r.rank) for r in got.collect()) == _scan(chunks, queries, k)
    # a rare word decides, so of the common ones only blocks around its texts are read
    rare = chunks.select(F.explode(F.array_distinct(F.split("text", " "))).alias("t")).groupBy("t").count().where("count >= 2").orderBy("count", "t").first().t
    few = spark.createDataFrame([(1, rare), (1, "the"), (1, "of"), (1, "and")], "q long, term string")
    got = index.search(few, "q", 1)
    assert sorted((r.q, r.chunk_id, r.score, r.rank) for r in got.collect()) == _scan(chunks, few, 1)
    assert index.read < 0.2 * index.seen
    # deleted chunks are gone from hits, counts and averages
    dead = chunks.where("document_id IN ('d3', 'd7') OR chunk_id IN ('c00000', 'c02999')").select("chunk_id")
    n = dead.count()
    assert index.delete(dead) == n and index.delete(dead) == 0
    left = chunks.join(dead, "chunk_id", "left_anti")
    got = index.search(queries, "q", 10)
    assert sorted((r.q, r.chunk_id, r.score, r.rank) for r in got.collect()) == _scan(left, queries, 10)
    a = index.audit().first()
    assert (a.chunks, a.live, a.deleted, a.duplicates) == (3000, 3000 - n, n, 0) and a.postings == a.postings_told > 0
    # appended again under a new segment
    assert index.append(dead.join(chunks, "chunk_id"), carry=("document_id",)) == 2
    got = index.search(queries, "q", 10)
    assert sorted((r.q, r.chunk_id, r.score, r.rank) for r in got.collect()) == _scan(chunks, queries, 10)


def test_search_reads_the_buckets_of_its_terms_alone(spark, corpus):
    chunks, queries = corpus
    index = LexicalIndex(spark, scratch_path(spark, "index"), buckets=16)
    index.append(chunks.limit(300))
    plan = index._table("blocks").where(F.col("bucket").isin(3))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_okapi_within_a_page(spark):
    """Scores by a plain version: IDF of terms in more than half of the texts is a quarter of the mean."""
    import math
    from collections import Counter

    rng = random.Random(8)
    words = "aa bb cc dd ee ff the x é1".split()
    rows = [(p, i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for p in range(6) for i in range(rng.randint(1, 6))]
    asked = {p: [rng.choice(words) for _ in range(4)] for p in range(6)}
    chunks = spark.createDataFrame(rows, "page_id long, block int, text string")
    queries = spark.createDataFrame([(p, w, 0) for p, ws in asked.items() for w in ws if len(w) > 1], "page_id long, term string, q int")
    got = {(r.page_id, r.block): r.score for r in R.bm25(chunks, "block", queries, "q", 1.5, 0.75, style="okapi", pattern=R.LONGER, prefix=("page_id",)).collect()}
    for p in range(6):
        texts = {i: [w for w in re.findall(r"\w+", t) if len(w) > 1] for q, i, t in rows if q == p}
        n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
        df = Counter(w for t in texts.values() for w in set(t))
        raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
        low = 0.25 * sum(raw.values()) / len(raw) if raw else 0
        for i, t in texts.items():
            hit = [w for w in asked[p] if w in t]
            want = sum((raw[w] if raw[w] >= 0 else low) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in hit)
            assert abs(got.get((p, i), 0.0) - want) < 1e-5


def test_index_moves_lists_and_keeps_few_hits(spark, corpus, monkeypatch):
    """Postings move as lists, and a search writes no more than about the best k of a range of chunks for each query."""
    from corpusloom.operators import lexical_index as L

    chunks, queries = corpus
    counts = {}

    def noted(df, name="table"):
        out = L_materialize(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    L_materialize = L.materialize
    monkeypatch.setattr(L, "materialize", noted)
    index = LexicalIndex(spark, scratch_path(spark, "index"), buckets=8, block=16)
    index.append(chunks.coalesce(2))
    assert 0 < counts["posted"] < index.audit().first().postings / 2
    common = queries.where("term IN ('the', 'of', 'and', 'to', 'in')")
    got = index.search(common, "q", 5)
    assert sorted((r.q, r.chunk_id, r.score, r.rank) for r in got.collect()) == _scan(chunks, common, 5)
    assert counts["hits"] <= 3 * 5 * 2 * common.select("q").distinct().count()


def test_documents_are_scored_where_they_are_read(spark, tmp_path):
    """No word is shuffled; rows that share an id are one document, as in the SQL."""
    import duckdb

    from corpusloom.operators.catalog import ORACLES, QUERIES

    plan = QUERIES["ret_03"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
    rng = random.Random(4)
    words = "the and Über naïve corpus x zebra ß1 of of of".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", "\n" + " ".join(rng.choice(words) for _ in range(n))])
    rows = [(i % 37, text(rng.choice([0, 3, 150, 400])), "en", "src1", 0) for i in range(60)] + [(900, None, "en", "src1", 0), (901, "", "en", "src1", 0), (None, text(200), "en", "src1", 0)]
    same = text(150)
    rows += [(902, same, "en", "src1", 0)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for t in ("conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = {r[:2]: r[2] for r in con.execute(ORACLES["ret_03"]).fetchall()}
    got = {(r.document_id, r.chunk_id): r.score for r in QUERIES["ret_03"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
