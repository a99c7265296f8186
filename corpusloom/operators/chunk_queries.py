"""Queries of the chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking
from corpusloom.operators.registry import query


@query("chk_01", "WITH base SELECT chunk_id, document_id, chunk_index, text, content_hash, char_start, char_end FROM chunks")
def chk_01(c):
    return c.chunks.select("chunk_id", "document_id", "chunk_index", "text", "content_hash", "char_start", "char_end")


@query("chk_02", "WITH base SELECT chunk_id, CASE WHEN char_start < 1000 THEN 1 WHEN char_start < 3000 THEN 2 ELSE 1 END AS page, CASE WHEN char_start < 3000 THEN char_start ELSE 0 END AS offset_start, CASE WHEN char_start < 1000 THEN least(char_end, 1000) WHEN char_start < 3000 THEN least(char_end, 3000) ELSE 1000 END AS offset_end FROM chunks")
def chk_02(c):
    """Spans of two pages; chunks beyond both fall back to the first."""
    span = lambda p, a, b: F.struct(F.lit("a").alias("artifact_id"), F.lit(p).alias("page"), F.lit(a).cast("long").alias("offset_start"), F.lit(b).cast("long").alias("offset_end"))
    spans = F.array(span(1, 0, 1000), span(2, 1000, 3000))
    return chunking.map_span(c.chunks.withColumn("spans", spans)).select("chunk_id", "span.page", "span.offset_start", "span.offset_end")


@query("chk_03")
def chk_03(c):
    return chunking.recursive(c.docs)


@query("chk_04", "WITH base, w AS (SELECT document_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM docs), n AS (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil((len(w) - 200) / 180.0)) AS BIGINT))) AS i FROM w WHERE len(w) > 0) SELECT document_id, i AS chunk_index, array_to_string(list_slice(w, i * 180 + 1, i * 180 + 200), ' ') AS text FROM n")
def chk_04(c):
    """Windows of blank-separated tokens: 200, of which 20 are shared with the next."""
    return chunking.token_windows(c.docs)


@query("chk_05")
def chk_05(c):
    return chunking.semantic(c.docs)


@query("chk_06", "WITH base, w AS (SELECT document_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z]{2,}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")) AS w FROM chunks), d AS (SELECT document_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w)::DOUBLE END AS ld FROM w) SELECT document_id, count(*) AS chunks, count_if(ld < 0.4) AS low_chunks, count_if(ld < 0.4) / count(*)::DOUBLE > 0.3 OR min(ld) < 0.2 AS needs_rechunk FROM d GROUP BY 1")
def chk_06(c):
    """Which documents the adaptive chunker takes up."""
    return chunking.rechunk_triggers(c.chunks)


@query("chk_07")
def chk_07(c):
    """Their merged chunks."""
    return chunking.adaptive(c.chunks)
