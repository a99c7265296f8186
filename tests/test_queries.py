"""Every registered query of the reference operators against its SQL in DuckDB, and those without SQL for rows."""

import math

import duckdb
import pandas as pd
import pytest

from corpusloom.operators.catalog import ORACLES, QUERIES
from corpusloom.operators.corpus import Corpus

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([_plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, want.fetchall())


#: Queries that SQL can't say, and the tests that hold them against a plain version.
MODELLED = {
    "src_01": "test_operators: files are scanned", "src_12": "below", "src_13": "below", "src_14": "test_models: markdown", "fn_01": "test_operators: clean text", "fn_30": "test_query_gate: entities",
    "chk_03": "test_operators: recursive split", "chk_05": "test_operators: semantic groups", "chk_07": "test_operators: merge of low density", "ret_14": "test_models: packages", "html_02": "test_models", "html_03": "test_models", "html_04": "test_models",
    "html_05": "test_models", "html_06": "test_models", "html_07": "test_operators: links", "top_c1": "test_plans: folds", "top_c2": "test_plans: folds", "evt_18": "test_streaming: drain", "dup_06_accepted": "test_plans: acceptance",
}


def test_what_has_no_sql_is_modelled():
    assert set(QUERIES) - set(ORACLES) == set(MODELLED)


@pytest.mark.parametrize("name", sorted(MODELLED))
def test_query_gives_rows_each_time_the_same(spark, name):
    first, again = (QUERIES[name](spark, SF) for _ in "ab")
    rows = _rows(first.columns, [tuple(r) for r in first.collect()])
    assert rows[1] and rows == _rows(again.columns, [tuple(r) for r in again.collect()])


def test_page_parsers(spark):
    texts = {r.document_id: r.text for r in Corpus(spark, SF).docs.select("document_id", "text").collect()}
    for name, cut in (("src_12", lambda t: [t[i : i + 2000] for i in range(0, len(t), 2000)]), ("src_13", lambda t: [p for p in t.split("\n\n") if p.strip()])):
        got = {r.path: (r.pages, r.needs_ocr) for r in QUERIES[name](spark, SF).collect()}
        assert got == {k: (len(p), bool(p) and sum(len(x) > 50 for x in p) < 0.1 * len(p)) for k, p in ((k, cut(t)) for k, t in texts.items())}
