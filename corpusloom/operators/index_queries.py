"""Queries over persisted indexes: each builds its index in the shared folder, from whole tables, and works on that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lexical_index import LexicalIndex
from corpusloom.operators.registry import query
from corpusloom.operators.relational_queries import _GROUPS, _NEAREST, _VEC, chunk_groups
from corpusloom.operators.retrieval import _D, _DENSE, _bm25_cte, first_per_document, items
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.session import scratch_path


def indexed(c) -> LexicalIndex:
    """All chunks, in two segments."""
    index = LexicalIndex(c.spark, scratch_path(c.spark, "lexical"))
    for part in (0, 1):
        index.append(c.chunks.where(F.col("doc_id") % 2 == part), carry=("document_id", "content_hash"))
    return index


@query("ret_02_index", f"WITH base, {_bm25_cte('log1p', 1.2, 0.75)}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM lex), d AS (SELECT r.item_id, chunk_id, document_id, score, rank FROM r JOIN chunks USING (chunk_id) WHERE rank <= 30 QUALIFY row_number() OVER (PARTITION BY item_id, document_id ORDER BY rank) = 1) SELECT item_id, chunk_id, document_id, score FROM d QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank) <= 5")
def ret_02_index(c):
    """The flagship search over a persisted index."""
    hits = first_per_document(indexed(c).search(items(c), "item_id", 30, carry=("document_id",)), "item_id", "document_id")
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))).where("r <= 5").select("item_id", "chunk_id", "document_id", "score")


def _spam(c) -> DataFrame:
    """Chunks whose text three documents or more hold."""
    spam = chunk_groups(c.chunks, c.sources).where("documents >= 3").select("content_hash")
    return c.chunks.join(spam, "content_hash", "left_semi").select("chunk_id")


@query("dup_04_index", f"WITH base, {_GROUPS} SELECT chunk_id FROM chunks WHERE content_hash NOT IN (SELECT content_hash FROM g WHERE documents >= 3)")
def dup_04_index(c):
    """Chunks with hashes of spam are deleted from the index; what is left in it."""
    index = indexed(c)
    index.delete(_spam(c))
    return index.live().select("chunk_id")


@query("aud_02_index", f"WITH base, {_GROUPS}, t AS (SELECT chunk_id, content_hash, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM chunks), s AS (SELECT chunk_id, content_hash IN (SELECT content_hash FROM g WHERE documents >= 3) AS dead, len(list_distinct(w)) AS n FROM t) SELECT count(*) AS chunks, count_if(NOT dead) AS live, count_if(dead) AS deleted, 0::BIGINT AS duplicates, CAST(sum(n) AS BIGINT) AS postings, CAST(sum(n) AS BIGINT) AS postings_told, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM t)) AS terms FROM s")
def aud_02_index(c):
    """Counts of the store against those of its blocks, after a purge."""
    index = indexed(c)
    index.delete(_spam(c))
    return index.audit()


def listed(c, metric: str) -> VectorIndex:
    """All vectors in inverted lists."""
    index = VectorIndex(c.spark, scratch_path(c.spark, "vectors"), metric)
    index.build(c.table("embeddings"))
    return index


@query("ret_04_index", f"WITH {_DENSE} SELECT query_id, vec_id, -round(sqrt(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS score FROM v, q WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def ret_04_index(c):
    """Vector search by distance over a persisted index."""
    return listed(c, "l2").search(c.table("embeddings").where("vec_id % 50 = 0")).withColumnRenamed("id", "vec_id")


@query("ret_05_index", f"WITH {_DENSE}, {_D} SELECT query_id, vec_id, score FROM dr WHERE rank <= 10")
def ret_05_index(c):
    """Vector search by cosine over a persisted index."""
    return listed(c, "cosine").search(c.table("embeddings").where("vec_id % 50 = 0")).withColumnRenamed("id", "vec_id")


@query("jn_14_index", f"WITH {_VEC}, {_NEAREST} SELECT * FROM n")
def jn_14_index(c):
    """The nearest other vector of each query over a persisted index."""
    hits = listed(c, "cosine").search(c.table("embeddings").where("vec_id % 50 = 0"), 1)
    return hits.select(F.col("query_id").alias("vec_id"), F.col("id").alias("nearest"), F.col("score").alias("similarity"))
