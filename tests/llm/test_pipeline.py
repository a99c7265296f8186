from corpusloom.session import materialize

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= before
        assert docs.count() <= kept
        kept = docs.count()
    ids = {r.doc_id for r in docs.collect()}
    out = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == ids and max(r.offset + r.length for r in out) <= 1024


def test_stages_take_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "some plain words that make a sentence of enough length for the shingles. " * 3
    rows = [(1, text, "en", "a", len(text)), (2, text, None, None, None), (None, None, None, None, None), (3, "", "en", "b", 0), (3, "", "en", "b", 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_each_stage_against_a_plain_version(spark):
    """Each stage's rows against a model without the operators, on what the stage before it kept."""
    from collections import defaultdict

    import public_tokenizers
    from test_decontamination import _brute as contaminated
    from test_minhash import _brute as groups
    from test_quality import _plain_score
    from test_substring import _repeated
    from tokenizers import Tokenizer

    from corpusloom.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    results = {}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        results[name] = docs.collect()
        if name == "pack":
            break
        got = {r.doc_id: r.text for r in results[name]}
        if name == "quality":
            assert set(got) == {i for i, t in rows if _plain_score(t, weights, 18) >= 0.3}
        elif name == "near_duplicates":
            assert set(got) == {min(rows[k][0] for k in g) for g in groups(rows).values()}
        elif name == "repeated_passages":
            texts = [t for _, t in rows]
            for (i, text), long, short in zip(rows, _repeated(texts, 52), _repeated(texts, 50), strict=True):
                left = len(got[i].split()) if i in got else 0
                assert len(text.split()) - sum(short) - 2 <= left <= len(text.split()) - sum(long) + 2, i
        elif name == "decontaminate":
            assert set(got) == {doc for doc, *_, bad in contaminated(rows, items) if not bad}
        if name != "repeated_passages":
            assert all(got[i] == t for i, t in rows if i in got)
        rows = sorted(got.items())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in results["pack"]:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        ends = [a + n for a, n in sorted(pieces[i])]
        assert [a for a, _ in sorted(pieces[i])] == [0, *ends[:-1]] and ends[-1] == len(library.encode(text, add_special_tokens=False).ids) + 1
    for held in sequences.values():
        ends = [a + n for a, n in sorted(held)]
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024
