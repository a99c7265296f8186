from corpusloom.operators.catalog import QUERIES


def test_pages_with_one_address_are_told_apart(spark, tmp_path):
    spark.createDataFrame([(i, f"https://e.org/{i % 4}", "") for i in range(60)] + [(None, "https://e.org/0", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(r.page_id for r in QUERIES["src_19"](spark, str(tmp_path)).collect())
    assert got == [i for i in range(60) if i % 3 and not (i % 5 == 0 and i % 30 < 20)]


def test_a_long_configuration_file_takes_one_pass(spark):
    import time

    from corpusloom.sources import files

    text = "- early\nx\nsite a :\r\n  - u1\n -  u2 \nother\nb:\n- \n" + "\n".join(f"- https://e.org/{i}" for i in range(100_000))
    begun = time.time()
    got = [tuple(r) for r in files.configured(spark.createDataFrame([(1, text), (2, None), (3, "")], "file int, text string"), "file").collect()]
    # a line costs the same wherever it stands
    assert time.time() - begun < 60
    assert got[:3] == [(1, "site a", "u1"), (1, "site a", "u2"), (1, "b", "https://e.org/0")] and len(got) == 100_002


def test_words_of_neighbours_are_not_shuffled(spark, tmp_path):
    rows = [(1, "abcd efgh abcd"), (2, "abcd abcd zzzz"), (2, "efgh"), (3, None), (4, "abcd"), (5, "none")]
    spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["fn_12"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [(1, 5)]
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def _against_sql(spark, folder, name, rows):
    import duckdb
    from corpusloom.operators.catalog import ORACLES

    spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]
    return sorted(got, key=repr), sorted(con.sql(ORACLES[name]).fetchall(), key=repr)


_ODD_TEXTS = [(i, t) for i, t in enumerate(["", None, "a b", " "] * 86 + [""] * 16)] + [(7 + 24 * i, "") for i in range(20, 60)] + [(24 * i, None) for i in range(20, 60)]


def test_downloads_are_refused_by_their_declared_length(spark, tmp_path):
    got, want = _against_sql(spark, tmp_path, "src_07", [*_ODD_TEXTS, (None, "a"), (None, None)])
    assert got == want and {r[1] for r in got} == {"", "empty", "too large", "type mismatch"}


def test_downloads_without_an_id_do_not_pass(spark, tmp_path):
    got, want = _against_sql(spark, tmp_path, "src_08", [*_ODD_TEXTS, (None, "a"), (None, None)])
    assert got == want and got
