"""Query registration: a name, a function of a Corpus, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.corpus import CTE, Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain_counts(sql: str) -> str:
    """count_if(x) as a filtered count, whose type is BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 0, at + len("count_if")
        for end in range(end, len(sql)):
            depth += (sql[end] == "(") - (sql[end] == ")")
            if not depth:
                break
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if(') : end]}){sql[end + 1 :]}"
    return sql


def query(name: str, oracle: str | None = None):
    """Register f(corpus). In the oracle, a leading `WITH base` stands for the corpus tables as CTEs."""

    def add(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if oracle:
            text = oracle.strip()
            text = _plain_counts(text)
            ORACLES[name] = "WITH RECURSIVE " + CTE + text.removeprefix("WITH base") if text.startswith("WITH base") else text
        return f

    return add
