"""The document corpus over the driver's tables: documents, sources, metadata, chunks, episodes and trace events.

Source and metadata columns that the tables lack are derived from doc_id, so every branch of the operators has rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.session import small_batches

#: The same tables for DuckDB, as common table expressions. Trailing comma or first select is the query's.
CTE = """
docs AS (SELECT doc_id, 'doc:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) AS document_id, text, lang, source, n_chars, doc_id % 13 = 0 AS tombstoned,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) AS stored_at FROM documents),
src AS (SELECT document_id, doc_id, 'https://' || source || '.example.org/' || (doc_id % 300) AS source_url, source AS source_domain,
  CASE doc_id % 4 WHEN 0 THEN 'configured_scrape' WHEN 1 THEN 'agent_research' WHEN 2 THEN 'manual' ELSE 'unknown' END AS provenance,
  (doc_id % 101) / 100.0::DOUBLE AS quality_score, CASE WHEN doc_id % 7 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') END AS published_at FROM docs WHERE doc_id % 23 <> 0),
meta AS (SELECT document_id, doc_id, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'sha256:' || sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) END AS normalized_hash,
  substr(text, 1, 40) AS title, n_chars AS char_count FROM docs WHERE doc_id % 17 <> 0),
chunks AS (SELECT document_id, doc_id, i AS chunk_index, 'chunk:' || substr(sha256(document_id || ':' || i), 1, 16) AS chunk_id, substr(text, i * 448 + 1, 512) AS text,
  'sha256:' || sha256(substr(text, i * 448 + 1, 512)) AS content_hash, i * 448 AS char_start, least(i * 448 + 512, length(text)) AS char_end, source, tombstoned
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN length(text) = 0 THEN -1 ELSE CAST(greatest(0, ceil((length(text) - 512) / 448.0)) AS BIGINT) END)) AS i FROM docs)),
episodes AS (SELECT conv_id AS session_id, turn, role, text AS content, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 60 + turn * 2 AS INTEGER)) AS created_at FROM conversations),
trace AS (SELECT event_id AS seq, user_id AS artifact_id, event_type AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value AS latency_ms, ts FROM events)
"""


#: Below so many bytes a core a table is dealt out before costly work: files of one row group are one task otherwise.
_SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; a table that fills them is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * _SMALL else df


def metadata_of(docs: DataFrame, hash_: Column, title: Column, *chars: str) -> DataFrame:
    """Metadata rows of those documents that have them, some without a hash."""
    n = F.col("doc_id")
    return docs.where(n % 17 != 0).select("document_id", "doc_id", F.when(n % 19 != 0, hash_).alias("normalized_hash"), title.alias("title"), *[F.col(x).alias("char_count") for x in chars])


class Corpus:
    """Lazy tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # whatever a query runs in Python sees no more than a few MB of text at a time
        small_batches(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        document_id = F.concat(F.lit("doc:"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32))
        stored = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 90).cast("int"))
        return self.table("documents").select("doc_id", document_id.alias("document_id"), "text", "lang", "source", "n_chars", (F.col("doc_id") % 13 == 0).alias("tombstoned"), stored.alias("stored_at"))

    @cached_property
    def sources(self) -> DataFrame:
        n = F.col("doc_id")
        provenance = F.when(n % 4 == 0, "configured_scrape").when(n % 4 == 1, "agent_research").when(n % 4 == 2, "manual").otherwise("unknown")
        published = F.when(n % 7 == 0, "").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (n % 60).cast("int")).cast("string"))
        url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), (n % 300).cast("string"))
        return self.docs.where(n % 23 != 0).select("document_id", "doc_id", url.alias("source_url"), F.col("source").alias("source_domain"), provenance.alias("provenance"), ((n % 101) / 100.0).alias("quality_score"), published.alias("published_at"))

    @cached_property
    def metadata(self) -> DataFrame:
        from corpusloom.functions.text import normalized_hash

        return metadata_of(self.docs, normalized_hash("text"), F.substring("text", 1, 40), "n_chars")

    @cached_property
    def chunks(self) -> DataFrame:
        return chunking.fixed_window(spread(self.docs), keep=("doc_id", "source", "tombstoned"))

    @cached_property
    def episodes(self) -> DataFrame:
        at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("conv_id") * 60 + F.col("turn") * 2).cast("int"))
        return self.table("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"), at.alias("created_at"))

    @cached_property
    def trace(self) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
        return self.table("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("artifact_id"), F.col("event_type").alias("stage"), status.alias("status"), F.col("value").alias("latency_ms"), "ts")
