"""Filters, joins, aggregates, windows, top-k and set operators as queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.registry import query
from corpusloom.plans.metric_pairs import vector_pairs
from corpusloom.plans.nearest import nearest_rows

NOW = "2024-03-01"


# Filters


@query("flt_01", "WITH base SELECT document_id, lang FROM docs WHERE NOT tombstoned")
def flt_01(c):
    return c.docs.where("NOT tombstoned").select("document_id", "lang")


@query("flt_02", "WITH base SELECT document_id, doc_id, lang, n_chars FROM docs WHERE document_id = 'doc:' || substr(sha256('42'), 1, 32)")
def flt_02(c):
    return c.docs.where(F.col("document_id") == F.concat(F.lit("doc:"), F.substring(F.sha2(F.lit("42"), 256), 1, 32))).select("document_id", "doc_id", "lang", "n_chars")


def nearest(vectors, queries, k: int, where: str):
    """k nearest of each query by Euclidean distance; the filter comes before the cut. Score is the negative distance."""
    base = vectors.where(where).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest_rows(base, queries, k, "l2", own=True).select("query_id", F.col("id").alias("vec_id"), "score")


def _probe(c):
    """The stated query set: every row whose id is divisible by 50."""
    return c.table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 50 = 0)"


@query("flt_03", f"WITH {_VEC} SELECT query_id, vec_id, -round(sqrt(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS score FROM v, q WHERE label = 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def flt_03(c):
    return nearest(c.table("embeddings"), _probe(c), 10, "label = 3")


@query("flt_04", "WITH base SELECT document_id FROM src WHERE coalesce(published_at, '') = '' OR published_at BETWEEN '2024-01-10' AND '2024-01-20'")
def flt_04(c):
    return c.sources.where("coalesce(published_at, '') = '' OR published_at BETWEEN '2024-01-10' AND '2024-01-20'").select("document_id")


def in_period(value, start: str, end: str):
    """Half-open period: a missing value is in it, one that can't be read is not."""
    at = F.try_to_timestamp(value)
    inside = (at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp"))
    return F.when(F.coalesce(value, F.lit("")) == "", True).otherwise(F.coalesce(inside, F.lit(False)))


@query("flt_05", "WITH base, t AS (SELECT document_id, CASE WHEN doc_id % 11 = 0 THEN 'soon' ELSE published_at END AS p FROM src) SELECT document_id, CASE WHEN coalesce(p, '') = '' THEN true ELSE coalesce(try_cast(p AS TIMESTAMP) >= TIMESTAMP '2024-01-10' AND try_cast(p AS TIMESTAMP) < TIMESTAMP '2024-02-01', false) END AS inside FROM t")
def flt_05(c):
    p = F.when(F.col("doc_id") % 11 == 0, "soon").otherwise(F.col("published_at"))
    return c.sources.select("document_id", in_period(p, "2024-01-10", "2024-02-01").alias("inside"))


@query("flt_06", "WITH base SELECT chunk_id FROM chunks WHERE document_id IN (SELECT document_id FROM docs WHERE source = 'src3')")
def flt_06(c):
    scope = c.docs.where("source = 'src3'").select("document_id")
    return c.chunks.join(scope, "document_id", "left_semi").select("chunk_id")


@query("flt_07", "WITH base SELECT chunk_id FROM chunks")
def flt_07(c):
    return c.chunks.select("chunk_id")


@query("flt_08", "WITH base SELECT m.document_id, title, source_domain FROM meta m LEFT JOIN src s USING (document_id) WHERE title ILIKE '%the%' OR source_domain ILIKE '%the%' OR m.document_id ILIKE '%the%' ORDER BY quality_score DESC NULLS LAST, char_count DESC, m.document_id LIMIT 20")
def flt_08(c):
    j = c.metadata.join(c.sources.select("document_id", "source_domain", "quality_score"), "document_id", "left")
    like = lambda x: F.ilike(x, F.lit("%the%"))
    hits = j.where(like(F.col("title")) | F.coalesce(like(F.col("source_domain")), F.lit(False)) | like(F.col("document_id")))
    return hits.orderBy(F.desc_nulls_last("quality_score"), F.desc("char_count"), "document_id").limit(20).select("document_id", "title", "source_domain")


@query("flt_09", "WITH base SELECT session_id, turn FROM episodes WHERE contains(lower(content), 'tion') AND created_at >= TIMESTAMP '2024-01-02'")
def flt_09(c):
    return c.episodes.where(F.contains(F.lower("content"), F.lit("tion")) & (F.col("created_at") >= F.lit("2024-01-02").cast("timestamp"))).select("session_id", "turn")


@query("flt_10", "SELECT page_id, url FROM pages WHERE regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/.*[0-9]') AND NOT contains(url, '/tag/') AND regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) LIKE '%.net'")
def flt_10(c):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return c.table("pages").where(path.rlike("^/.*[0-9]") & ~F.contains("url", F.lit("/tag/")) & T.host("url").like("%.net")).select("page_id", "url")


def looks_like_article(url):
    low = F.lower(url)
    other = F.exists(T.literals(["mailto:", "tel:", "whatsapp:", "telegram:", "#", "javascript:"]), lambda p: low.startswith(p))
    return (url != "") & ~other & ~F.exists(T.literals(T.SKIP_LINKS), lambda p: F.contains(low, p))


@query("flt_11", "SELECT page_id, NOT (" + " OR ".join(f"contains(lower(url), '{p}')" for p in T.SKIP_LINKS) + ") AS article FROM pages")
def flt_11(c):
    return c.table("pages").select("page_id", looks_like_article(F.col("url")).alias("article"))


@query("flt_12", f"WITH base SELECT document_id, coalesce(date_diff('day', try_cast(published_at AS DATE), DATE '{NOW}') <= 30, true) AS fresh FROM src")
def flt_12(c):
    return c.sources.select("document_id", F.coalesce(F.datediff(F.lit(NOW).cast("date"), F.col("published_at").try_cast("date")) <= 30, F.lit(True)).alias("fresh"))


@query("flt_13", "WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id FROM t WHERE length(text) >= 800 AND len(w) > 0 AND len(list_distinct(w)) / len(w)::DOUBLE < 0.6")
def flt_13(c):
    w = T.words_of(F.lower("text"))
    return c.docs.where((F.length("text") >= 800) & (F.size(F.array_distinct(w)) / F.size(w) < 0.6)).select("doc_id")


@query("flt_14", "WITH base SELECT CASE WHEN doc_id % 5 = 0 THEN 'enriched' WHEN doc_id % 5 = 1 THEN 're_embed' WHEN length(text) < 100 THEN 'skipped' ELSE 'to_process' END AS work, count(*) AS n FROM chunks GROUP BY 1")
def flt_14(c):
    n = F.col("doc_id") % 5
    work = F.when(n == 0, "enriched").when(n == 1, "re_embed").when(F.length("text") < 100, "skipped").otherwise("to_process")
    return c.chunks.groupBy(work.alias("work")).agg(F.count("*").alias("n"))


@query("flt_15", "WITH t AS (SELECT doc_id, CASE WHEN n_chars < 1000 THEN 1 WHEN n_chars < 4000 THEN 2 ELSE 3 END AS bucket, [5, 10, 5] AS quota FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS n FROM t) SELECT doc_id, bucket FROM r WHERE n <= quota[bucket]")
def flt_15(c):
    bucket = F.when(F.col("n_chars") < 1000, 1).when(F.col("n_chars") < 4000, 2).otherwise(3)
    ranked = c.docs.select("doc_id", bucket.alias("bucket")).withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")))
    return ranked.where(F.col("n") <= F.element_at(F.array(F.lit(5), F.lit(10), F.lit(5)), F.col("bucket"))).select("doc_id", "bucket")


@query("flt_16", "WITH s AS (SELECT DISTINCT source AS name, 'configured' AS kind, true AS active FROM documents UNION ALL SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'added', page_id % 3 <> 0 FROM pages) SELECT kind, count(*) AS sources, count_if(active) AS active FROM s GROUP BY kind")
def flt_16(c):
    a = c.table("documents").select(F.col("source").alias("name"), F.lit("configured").alias("kind"), F.lit(True).alias("active")).distinct()
    b = c.table("pages").select(T.host("url"), F.lit("added"), F.col("page_id") % 3 != 0).distinct()
    return a.union(b).groupBy("kind").agg(F.count("*").alias("sources"), F.count_if("active").alias("active"))


# Joins


@query("jn_01", "WITH base SELECT source_url, normalized_hash FROM src JOIN meta USING (document_id) WHERE normalized_hash IS NOT NULL")
def jn_01(c):
    return c.sources.select("document_id", "source_url").join(c.metadata, "document_id").where("normalized_hash IS NOT NULL").select("source_url", "normalized_hash")


def live_chunk_counts(chunks):
    return chunks.where("NOT tombstoned").groupBy("document_id").agg(F.count("*").alias("live_chunks"))


def url_documents(c):
    """Live documents with their address, size and live chunks."""
    d = c.docs.where("NOT tombstoned").select("document_id", "n_chars", "stored_at")
    return c.sources.select("document_id", "source_url").join(d, "document_id").join(live_chunk_counts(c.chunks), "document_id", "left").withColumn("live_chunks", F.coalesce("live_chunks", F.lit(0)))


_URLDOCS = "u AS (SELECT document_id, source_url, d.n_chars, d.stored_at, (SELECT count(*) FROM chunks k WHERE k.document_id = d.document_id AND NOT k.tombstoned) AS live_chunks FROM src JOIN docs d USING (document_id) WHERE NOT d.tombstoned)"


@query("jn_02", f"WITH base, {_URLDOCS} SELECT document_id, source_url, live_chunks FROM u")
def jn_02(c):
    return url_documents(c).select("document_id", "source_url", "live_chunks")


@query("jn_03", "WITH base SELECT chunk_id, d.lang, s.source_domain FROM chunks k JOIN docs d USING (document_id) LEFT JOIN src s USING (document_id)")
def jn_03(c):
    return c.chunks.select("chunk_id", "document_id").join(c.docs.select("document_id", "lang"), "document_id").join(c.sources.select("document_id", "source_domain"), "document_id", "left").select("chunk_id", "lang", "source_domain")


@query("jn_04", "WITH base SELECT d.document_id FROM docs d LEFT JOIN meta m USING (document_id) WHERE m.normalized_hash IS NULL")
def jn_04(c):
    return c.docs.select("document_id").join(c.metadata.select("document_id", "normalized_hash"), "document_id", "left").where("normalized_hash IS NULL").select("document_id")


@query("jn_05", "WITH base SELECT document_id, title, source_url FROM meta LEFT JOIN src USING (document_id)")
def jn_05(c):
    return c.metadata.select("document_id", "title").join(c.sources.select("document_id", "source_url"), "document_id", "left")


@query("jn_06", f"WITH {_VEC} SELECT query_id, vec_id, -round(sqrt(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS score FROM v, q WHERE vec_id % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 8")
def jn_06(c):
    """Only live vectors are ranked, so tombstones can't shrink the result."""
    return nearest(c.table("embeddings"), _probe(c), 8, "vec_id % 13 <> 0")


@query("jn_07", "WITH base, hits AS (SELECT chunk_id FROM chunks WHERE contains(text, 'with')) SELECT chunk_id, text FROM chunks JOIN hits USING (chunk_id) WHERE chunk_index = 0")
def jn_07(c):
    hits = c.chunks.where(F.contains("text", F.lit("with"))).select("chunk_id")
    return c.chunks.where("chunk_index = 0").join(hits, "chunk_id").select("chunk_id", "text")


@query("jn_08", "WITH base, report AS (SELECT 'in/' || doc_id || '.txt' AS saved_to, source_url FROM src), files AS (SELECT 'in/' || doc_id || '.txt' AS path, 'sha256:' || sha256(text) AS artifact_id, document_id FROM docs) SELECT document_id, source_url, artifact_id FROM report JOIN files ON saved_to = path")
def jn_08(c):
    path = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    report = c.sources.select(path.alias("path"), "source_url")
    files = c.docs.select(path.alias("path"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("artifact_id"), "document_id")
    return report.join(files, "path").select("document_id", "source_url", "artifact_id")


_SITES = ("https://src1.", "https://src2.", "https://src11.")


@query("jn_09", "WITH base, conf AS (SELECT unnest([" + ", ".join(f"'{s}'" for s in _SITES) + "]) AS site) SELECT document_id FROM src WHERE EXISTS (SELECT 1 FROM conf WHERE contains(source_url, site))")
def jn_09(c):
    """A short configured list, so containment is an expression and not a join."""
    return c.sources.where(F.exists(T.literals(_SITES), lambda s: F.contains("source_url", s))).select("document_id")


def difference(live, indexed):
    """Ids missing from the index and orphans in it, by anti joins both ways."""
    return live.join(indexed, "chunk_id", "left_anti").select("chunk_id", F.lit("missing").alias("kind")).union(indexed.join(live, "chunk_id", "left_anti").select("chunk_id", F.lit("orphan").alias("kind")))


_INDEX = "live AS (SELECT chunk_id FROM chunks WHERE NOT tombstoned), idx AS (SELECT chunk_id FROM chunks WHERE doc_id % 10 <> 3)"


def _index(c):
    return c.chunks.where("NOT tombstoned").select("chunk_id"), c.chunks.where("doc_id % 10 <> 3").select("chunk_id")


@query("jn_10", f"WITH base, {_INDEX} SELECT chunk_id, 'missing' AS kind FROM live WHERE chunk_id NOT IN (SELECT chunk_id FROM idx) UNION ALL SELECT chunk_id, 'orphan' FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM live)")
def jn_10(c):
    return difference(*_index(c))


@query("jn_11", f"WITH base, {_INDEX} SELECT chunk_id FROM live WHERE chunk_id NOT IN (SELECT chunk_id FROM idx)")
def jn_11(c):
    live, index = _index(c)
    return live.join(index, "chunk_id", "left_anti")


@query("jn_12", "WITH base SELECT chunk_id FROM chunks WHERE document_id IN (SELECT document_id FROM docs WHERE doc_id % 5 = 0) AND document_id NOT IN (SELECT document_id FROM docs WHERE doc_id % 10 = 0)")
def jn_12(c):
    batch, main = c.docs.where("doc_id % 5 = 0").select("document_id"), c.docs.where("doc_id % 10 = 0").select("document_id")
    return c.chunks.join(batch, "document_id", "left_semi").join(main, "document_id", "left_anti").select("chunk_id")


@query("jn_13", "WITH base, ack AS (SELECT max(seq) FILTER (WHERE artifact_id = 1) AS a FROM trace) SELECT seq FROM trace WHERE seq > coalesce((SELECT a FROM ack), 0) AND NOT EXISTS (SELECT 1 FROM trace d WHERE d.seq = trace.seq AND d.stage = 'click')")
def jn_13(c):
    ack = c.trace.agg(F.coalesce(F.max(F.when(F.col("artifact_id") == 1, F.col("seq"))), F.lit(0)).alias("a"))
    delivered = c.trace.where("stage = 'click'").select("seq")
    return c.trace.join(F.broadcast(ack), F.col("seq") > F.col("a")).join(delivered, "seq", "left_anti").select("seq")


def nearest_of(queries, rows):
    """For each query vector the most similar other row: (vec_id, nearest, similarity); the smallest id of ties.

    A query that meets no other row is left out.
    """
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = nearest_rows(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), asked, 1)
    return found.select(F.col("query_id").alias("vec_id"), F.col("id").alias("nearest"), F.col("score").alias("similarity"))


_COS = "round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6)"
_NEAREST = f"p AS (SELECT a.vec_id, b.vec_id AS o, {_COS} AS s FROM v a, v b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id), n AS (SELECT vec_id, o AS nearest, s AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, o) = 1)"


def _history(c):
    """The stated query set, ids divisible by 50, against all rows."""
    v = c.table("embeddings")
    return nearest_of(v.where("vec_id % 50 = 0"), v)


@query("jn_14", f"WITH {_VEC}, {_NEAREST} SELECT * FROM n")
def jn_14(c):
    return _history(c)


@query("jn_15", f"WITH {_VEC} SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.3")
def jn_15(c):
    return vector_pairs(c.table("embeddings"), 0.3, group="label", digits=6).withColumnRenamed("s", "similarity")


@query("jn_16", "WITH base SELECT chunk_id, text, provenance FROM (SELECT * FROM chunks WHERE contains(text, 'that')) LEFT JOIN src USING (document_id)")
def jn_16(c):
    hits = c.chunks.where(F.contains("text", F.lit("that"))).select("chunk_id", "document_id", "text")
    return hits.join(c.sources.select("document_id", "provenance"), "document_id", "left").select("chunk_id", "text", "provenance")


@query("jn_17", "WITH base, d AS (SELECT document_id, CASE doc_id % 3 WHEN 0 THEN 'reject' ELSE 'promote' END AS decision, 1 AS seen FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT document_id, 'pending', 2 FROM docs WHERE doc_id % 5 = 0 UNION ALL SELECT document_id, 'promote', 3 FROM docs WHERE doc_id % 7 = 0), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY seen DESC) = 1) SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM d WHERE decision = 'reject') AND decision = 'pending' THEN 'reject' ELSE decision END AS state FROM l")
def jn_17(c):
    """Review state from three stores: the newest wins, but a rejection beats a pending state."""
    n = F.col("doc_id")
    a = c.docs.where(n % 2 == 0).select("document_id", F.when(n % 3 == 0, "reject").otherwise("promote").alias("decision"), F.lit(1).alias("seen"))
    b = c.docs.where(n % 5 == 0).select("document_id", F.lit("pending").alias("decision"), F.lit(2).alias("seen"))
    d = c.docs.where(n % 7 == 0).select("document_id", F.lit("promote").alias("decision"), F.lit(3).alias("seen"))
    by = a.unionByName(b).unionByName(d).groupBy("document_id").agg(F.max_by("decision", "seen").alias("last"), F.bool_or(F.col("decision") == "reject").alias("rejected"))
    return by.select("document_id", F.when(F.col("rejected") & (F.col("last") == "pending"), "reject").otherwise(F.col("last")).alias("state"))


_STATES = "CASE doc_id % 3 WHEN 0 THEN 'promote' WHEN 1 THEN 'reporter_only' ELSE 'defer' END"


def _state(c):
    return F.when(F.col("doc_id") % 3 == 0, "promote").when(F.col("doc_id") % 3 == 1, "reporter_only").otherwise("defer")


@query("jn_18", f"WITH base, k AS (SELECT document_id, count(*) AS total, count_if(NOT tombstoned) AS live FROM chunks GROUP BY 1), held AS (SELECT document_id, 'main' AS corpus, 1 AS p FROM docs WHERE doc_id % 4 = 0 UNION ALL SELECT document_id, 'research', 2 FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT document_id, 'reporter', 3 FROM docs), f AS (SELECT document_id, arg_min(corpus, p) AS corpus FROM held GROUP BY 1) SELECT f.document_id, corpus, title, source_domain, coalesce(total, 0) AS chunks, coalesce(live, 0) AS live_chunks, {_STATES} AS decision FROM f JOIN docs d USING (document_id) LEFT JOIN meta m USING (document_id) LEFT JOIN src s USING (document_id) LEFT JOIN k USING (document_id)".replace("CASE doc_id", "CASE d.doc_id"))
def jn_18(c):
    n = F.col("doc_id")
    first = F.when(n % 4 == 0, "main").when(n % 3 == 0, "research").otherwise("reporter")
    k = c.chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(~F.col("tombstoned")).alias("live_chunks"))
    card = c.docs.select("document_id", first.alias("corpus"), _state(c).alias("decision"))
    card = card.join(c.metadata.select("document_id", "title"), "document_id", "left").join(c.sources.select("document_id", "source_domain"), "document_id", "left").join(k, "document_id", "left")
    return card.select("document_id", "corpus", "title", "source_domain", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("live_chunks", F.lit(0)).alias("live_chunks"), "decision")


@query("jn_19", "WITH base SELECT chunk_id FROM chunks JOIN docs d USING (document_id) WHERE NOT chunks.tombstoned AND (chunks.doc_id + chunk_index) % 4 IN (0, 1) ORDER BY d.stored_at, chunk_id LIMIT 100")
def jn_19(c):
    jobs = c.chunks.where("NOT tombstoned AND (doc_id + chunk_index) % 4 IN (0, 1)").select("document_id", "chunk_id")
    return jobs.join(c.docs.select("document_id", "stored_at"), "document_id").orderBy("stored_at", "chunk_id").limit(100).select("chunk_id")


@query("jn_20", f"WITH base SELECT source AS topic, document_id, title, {_STATES} AS decision FROM docs LEFT JOIN meta m USING (document_id) WHERE lang = 'en'".replace("CASE doc_id", "CASE docs.doc_id"))
def jn_20(c):
    members = c.docs.where("lang = 'en'").groupBy("source").agg(F.collect_list("document_id").alias("members")).select(F.col("source").alias("topic"), F.explode("members").alias("document_id"))
    reasons = c.docs.select("document_id", _state(c).alias("decision"))
    return members.join(c.metadata.select("document_id", "title"), "document_id", "left").join(reasons, "document_id", "left").select("topic", "document_id", "title", "decision")


# Aggregates


@query("agg_01", "WITH base SELECT (SELECT count(*) FROM docs WHERE NOT tombstoned) AS documents, (SELECT count(*) FROM chunks WHERE NOT tombstoned) AS chunks, (SELECT count(*) FROM embeddings) AS vectors")
def agg_01(c):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(c.docs.where("NOT tombstoned"), "documents").join(one(c.chunks.where("NOT tombstoned"), "chunks"), F.lit(True)).join(one(c.table("embeddings"), "vectors"), F.lit(True))


@query("agg_02", "WITH base SELECT stage, count(*) AS n FROM trace GROUP BY stage")
def agg_02(c):
    return c.trace.groupBy("stage").agg(F.count("*").alias("n"))


@query("agg_03", "WITH base SELECT count(*) AS total, count(DISTINCT artifact_id) AS artifacts, count_if(status = 'failed') AS failed, round(avg(latency_ms) FILTER (WHERE latency_ms > 0), 2) AS avg_latency FROM trace")
def agg_03(c):
    return c.trace.agg(F.count("*").alias("total"), F.count_distinct("artifact_id").alias("artifacts"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), 2).alias("avg_latency"))


def chunk_groups(chunks, sources):
    """Per content hash: documents, domains (missing is one), known domains, chunks, start of the text."""
    j = chunks.where("NOT tombstoned").select("document_id", "content_hash", "text").join(sources.select("document_id", "source_domain"), "document_id", "left")
    return j.groupBy("content_hash").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct(F.coalesce("source_domain", F.lit(""))).alias("domains"), F.count_distinct("source_domain").alias("known_domains"), F.count("*").alias("chunks"), F.substring(F.min("text"), 1, 120).alias("sample"))


_GROUPS = "g AS (SELECT content_hash, count(DISTINCT k.document_id) AS documents, count(DISTINCT coalesce(source_domain, '')) AS domains, count(DISTINCT source_domain) AS known_domains, count(*) AS chunks, substr(min(text), 1, 120) AS sample FROM chunks k LEFT JOIN src s USING (document_id) WHERE NOT tombstoned GROUP BY content_hash)"


@query("agg_04", f"WITH base, {_GROUPS} SELECT content_hash, documents, domains, chunks, sample FROM g WHERE documents >= 3 OR domains >= 2")
def agg_04(c):
    return chunk_groups(c.chunks, c.sources).where("documents >= 3 OR domains >= 2").select("content_hash", "documents", "domains", "chunks", "sample")


@query("agg_05", f"WITH base, {_GROUPS} SELECT count_if(documents >= 3 AND known_domains < 2) AS site, count_if(known_domains >= 2) AS across FROM g WHERE documents >= 2")
def agg_05(c):
    return chunk_groups(c.chunks, c.sources).where("documents >= 2").agg(F.count_if((F.col("documents") >= 3) & (F.col("known_domains") < 2)).alias("site"), F.count_if(F.col("known_domains") >= 2).alias("across"))


@query("agg_06", "WITH base SELECT normalized_hash, count(*) AS n, array_to_string(list_sort(list(document_id)), ',') AS members FROM meta WHERE normalized_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def agg_06(c):
    return c.metadata.where("normalized_hash IS NOT NULL").groupBy("normalized_hash").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("document_id")), ",").alias("members")).where("n > 1")


@query("agg_07", "WITH base SELECT source_url, count(*) AS n FROM src GROUP BY 1 HAVING count(*) > 1")
def agg_07(c):
    return c.sources.groupBy("source_url").agg(F.count("*").alias("n")).where("n > 1")


def mean_vectors(vectors, key: str = "label"):
    """Mean vector per key: components averaged apart, so no group is gathered in one place."""
    each = vectors.select(key, F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy(key, "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s.m).alias("centroid"))


@query("agg_08", "WITH t AS (SELECT label, unnest(generate_series(1, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, round(avg(x), 6) AS m FROM t GROUP BY ALL) SELECT label, list(m ORDER BY pos) AS centroid FROM m GROUP BY label")
def agg_08(c):
    return mean_vectors(c.table("embeddings"))


@query("agg_09", f"WITH base SELECT {_STATES} AS decision, count(*) AS n FROM docs GROUP BY 1")
def agg_09(c):
    return c.docs.groupBy(_state(c).alias("decision")).agg(F.count("*").alias("n"))


@query("agg_10", "WITH base SELECT CASE WHEN status = 'failed' THEN 'retry' WHEN seq % 2 = 0 THEN 'delivered' ELSE 'pending' END AS state, count(*) AS n FROM trace GROUP BY 1")
def agg_10(c):
    state = F.when(F.col("status") == "failed", "retry").when(F.col("seq") % 2 == 0, "delivered").otherwise("pending")
    return c.trace.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("agg_11", "SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY 1")
def agg_11(c):
    terms = c.docs.select(F.explode(T.found(F.lower("text"), "[a-z]{4,}")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term")


@query("agg_12", "WITH base SELECT count(DISTINCT document_id) AS diversity FROM chunks WHERE contains(text, 'tion')")
def agg_12(c):
    return c.chunks.where(F.contains("text", F.lit("tion"))).agg(F.count_distinct("document_id").alias("diversity"))


@query("agg_13", "WITH t AS (SELECT doc_id, string_split(lang || ',' || source || ',' || lang || ',' || source, ',') AS l FROM documents) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids FROM t")
def agg_13(c):
    return c.docs.select("doc_id", F.array_join(F.array_distinct(F.array("lang", "source", "lang", "source")), ",").alias("ids"))


@query("agg_14", "WITH t AS (SELECT (doc_id % 10) / 10.0::DOUBLE AS s FROM documents) SELECT count_if(s >= 0.35) AS supported, count_if(s >= 0.12 AND s < 0.35) AS partial, count_if(s < 0.12) AS unsupported FROM t")
def agg_14(c):
    s = (F.col("doc_id") % 10) / 10.0
    return c.docs.agg(F.count_if(s >= 0.35).alias("supported"), F.count_if((s >= 0.12) & (s < 0.35)).alias("partial"), F.count_if(s < 0.12).alias("unsupported"))


def ranked_latencies(trace, key: str = "stage"):
    """Rows with their place from 0 and the group's size, so exact order statistics are filters and not gathered lists."""
    w = Window.partitionBy(key)
    return trace.select(key, "latency_ms", (F.row_number().over(w.orderBy("latency_ms")) - 1).alias("i"), F.count("*").over(w).alias("n"))


def order_statistic(place):
    return F.max(F.when(F.col("i") == place, F.col("latency_ms")))


_RANKED = "r AS (SELECT stage, latency_ms, row_number() OVER (PARTITION BY stage ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM trace)"


@query("agg_15", f"WITH base, {_RANKED} SELECT stage, max(latency_ms) FILTER (WHERE i = n // 2) AS p50, max(latency_ms) FILTER (WHERE i = CAST(floor(0.95 * n) AS BIGINT)) AS p95, round(avg(latency_ms), 6) AS mean FROM r GROUP BY stage")
def agg_15(c):
    """p50 and p95 are the elements at n // 2 and int(.95 n) of the sorted values."""
    n = F.col("n")
    return ranked_latencies(c.trace).groupBy("stage").agg(order_statistic(F.floor(n / 2)).alias("p50"), order_statistic(F.floor(n * F.lit(0.95).cast("decimal(3,2)"))).alias("p95"), F.round(F.avg("latency_ms"), 6).alias("mean"))


@query("agg_16", f"WITH base, {_RANKED} SELECT stage, max(latency_ms) FILTER (WHERE i = CAST(ceil(0.5 * n) AS BIGINT) - 1) AS p50, max(latency_ms) FILTER (WHERE i = CAST(ceil(0.9 * n) AS BIGINT) - 1) AS p90 FROM r GROUP BY stage")
def agg_16(c):
    """Nearest rank: element ceil(f n) - 1."""
    at = lambda f: F.ceil(F.col("n") * F.lit(f).cast("decimal(2,1)")) - 1
    return ranked_latencies(c.trace).groupBy("stage").agg(order_statistic(at(0.5)).alias("p50"), order_statistic(at(0.9)).alias("p90"))


@query("agg_17", "WITH base SELECT session_id, count_if(role = 'user') AS user_turns, count_if(role = 'assistant') AS assistant_turns, arg_min(content, turn) AS first, arg_max(content, turn) AS last FROM episodes GROUP BY 1")
def agg_17(c):
    return c.episodes.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.min_by("content", "turn").alias("first"), F.max_by("content", "turn").alias("last"))


@query("agg_18", "WITH base SELECT s AS source, sha256(array_to_string(list_sort(list(h)), '|')) AS fingerprint FROM (SELECT source AS s, sha256(text) AS h FROM docs) GROUP BY 1")
def agg_18(c):
    """Order-free fingerprint of each source's contents."""
    return c.docs.select("source", F.sha2("text", 256).alias("h")).groupBy("source").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "|"), 256).alias("fingerprint"))


@query("agg_19", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, count(*) AS n FROM pages GROUP BY 1")
def agg_19(c):
    return c.table("pages").groupBy(T.host("url").alias("site")).agg(F.count("*").alias("n"))


@query("agg_20", "WITH base SELECT document_id, round(avg(length(text)), 6) AS mean FROM chunks GROUP BY 1 HAVING avg(length(text)) > 450")
def agg_20(c):
    return c.chunks.groupBy("document_id").agg(F.round(F.avg(F.length("text")), 6).alias("mean")).where("mean > 450")


@query("agg_21", "WITH base SELECT CAST(min(length(text)) AS BIGINT) AS least, CAST(max(length(text)) AS BIGINT) AS most, round(avg(length(text)), 6) AS mean FROM chunks")
def agg_21(c):
    n = F.length("text")
    return c.chunks.agg(F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.round(F.avg(n), 6).alias("mean"))


@query("agg_22", "WITH base SELECT count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS mean, round((count(*) - count(DISTINCT content_hash)) / count(*)::DOUBLE, 6) AS duplicate_rate FROM chunks")
def agg_22(c):
    n = F.length("text")
    return c.chunks.agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean"), F.round((F.count("*") - F.count_distinct("content_hash")) / F.count("*"), 6).alias("duplicate_rate"))


@query("agg_23", f"WITH base, {_RANKED} SELECT stage, round(median(latency_ms), 6) AS median, max(latency_ms) FILTER (WHERE i = CAST(floor(0.95 * n) AS BIGINT)) AS p95, max(latency_ms) AS p99 FROM r GROUP BY stage")
def agg_23(c):
    """True median, upper-index p95, and a p99 that is the maximum."""
    return ranked_latencies(c.trace).groupBy("stage").agg(F.round(F.median("latency_ms"), 6).alias("median"), order_statistic(F.floor(F.col("n") * F.lit(0.95).cast("decimal(3,2)"))).alias("p95"), F.max("latency_ms").alias("p99"))


# Windows


@query("win_01", "WITH base SELECT document_id, round(1 - (rank() OVER (ORDER BY quality_score DESC) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE, 6) AS percentile FROM src")
def win_01(c):
    """Ties share the best place. Counts per score are ranked, not rows, so one task sees distinct scores only."""
    return c.sources.select("document_id", "quality_score").join(percentiles(c.sources, "quality_score"), "quality_score").select("document_id", F.round("percentile", 6).alias("percentile"))


def percentiles(df, score: str):
    """(score, above, percentile) for each distinct score: above counts better rows."""
    by = df.groupBy(score).agg(F.count("*").alias("n"))
    # one row a distinct rounded score
    above = F.sum("n").over(Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    whole = F.sum("n").over(Window.partitionBy())
    return by.select(score, above.alias("above"), (1 - above / F.greatest(whole - 1, F.lit(1))).alias("percentile"))


@query("win_02", "WITH base SELECT document_id, row_number() OVER (ORDER BY quality_score DESC, doc_id) AS rank FROM src")
def win_02(c):
    """Stable rank: better scores counted before, then the place within equal scores."""
    w = Window.partitionBy("quality_score").orderBy("doc_id")
    within = c.sources.select("document_id", "quality_score", F.row_number().over(w).alias("r"))
    return within.join(percentiles(c.sources, "quality_score"), "quality_score").select("document_id", (F.col("above") + F.col("r")).alias("rank"))


@query("win_03", "WITH base SELECT document_id, lag(document_id) OVER (PARTITION BY source_url ORDER BY doc_id) AS by_url FROM src")
def win_03(c):
    return c.sources.select("document_id", F.lag("document_id").over(Window.partitionBy("source_url").orderBy("doc_id")).alias("by_url"))


@query("win_04", f"WITH base, {_URLDOCS} SELECT source_url, document_id FROM u QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY live_chunks DESC, n_chars DESC, stored_at DESC, document_id) = 1")
def win_04(c):
    w = Window.partitionBy("source_url").orderBy(F.desc("live_chunks"), F.desc("n_chars"), F.desc("stored_at"), "document_id")
    return url_documents(c).withColumn("r", F.row_number().over(w)).where("r = 1").select("source_url", "document_id")


@query("win_07", "WITH base SELECT artifact_id, stage FROM trace QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY ts DESC, seq DESC) = 1")
def win_07(c):
    return c.trace.groupBy("artifact_id").agg(F.max_by("stage", F.struct("ts", "seq")).alias("stage"))


@query("win_08", "WITH base, h AS (SELECT session_id, turn, role FROM episodes), f AS (SELECT *, min(turn) OVER (PARTITION BY session_id, role) AS first FROM h) SELECT session_id, turn, dense_rank() OVER (PARTITION BY session_id ORDER BY first) AS doc_no, row_number() OVER (PARTITION BY session_id, role ORDER BY turn) AS fragment FROM f")
def win_08(c):
    """Citation numbers: by first appearance, then within."""
    own = Window.partitionBy("session_id", "role")
    first = c.episodes.select("session_id", "turn", "role", F.min("turn").over(own).alias("first"))
    return first.select("session_id", "turn", F.dense_rank().over(Window.partitionBy("session_id").orderBy("first")).alias("doc_no"), F.row_number().over(own.orderBy("turn")).alias("fragment"))


def within_budget(rows, key: str, order: str, cost: str, budget: int):
    """Greedy fold in order: what does not fit is skipped, later smaller ones may fit. One bounded list per key."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, x: F.when(s.used + x.c <= budget, F.struct((s.used + x.c).alias("used"), F.concat(s.kept, F.array(x.o)).alias("kept"))).otherwise(s)
    return rows.groupBy(key).agg(F.aggregate(items, start, step).alias("f")).select(key, F.explode("f.kept").alias(order))


@query("win_09", "WITH base, e AS (SELECT session_id, turn, CAST(greatest(1, ceil(strlen(content) / 4.0)) AS BIGINT) AS c, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM episodes), f AS (SELECT session_id, turn, n, c <= 120 AS kept, CASE WHEN c <= 120 THEN c ELSE 0 END AS used FROM e WHERE n = 1 UNION ALL SELECT e.session_id, e.turn, e.n, f.used + e.c <= 120, CASE WHEN f.used + e.c <= 120 THEN f.used + e.c ELSE f.used END FROM f JOIN e ON e.session_id = f.session_id AND e.n = f.n + 1) SELECT session_id, turn FROM f WHERE kept")
def win_09(c):
    return within_budget(c.episodes.withColumn("cost", T.token_estimate("content")), "session_id", "turn", "cost", 120)


@query("win_10", "WITH base SELECT seq, lead(seq) OVER (PARTITION BY artifact_id, stage ORDER BY seq) IS NOT NULL AS superseded FROM trace")
def win_10(c):
    return c.trace.select("seq", F.lead("seq").over(Window.partitionBy("artifact_id", "stage").orderBy("seq")).isNotNull().alias("superseded"))


def tool_grams(trace, sizes=(2, 3, 4)):
    """Runs of consecutive stages of a session, by size, with their counts."""
    w = Window.partitionBy("artifact_id").orderBy("seq")
    most = max(sizes)
    ahead = trace.select("stage", *[F.lead("stage", k).over(w).alias(f"s{k}") for k in range(1, most)])
    grams = F.array(*[F.when(F.col(f"s{n - 1}").isNotNull(), F.concat_ws(">", "stage", *[f"s{k}" for k in range(1, n)])) for n in sizes])
    return ahead.select(F.explode(F.filter(grams, lambda g: g.isNotNull())).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_GRAMS = "l AS (SELECT stage, lead(stage, 1) OVER w AS s1, lead(stage, 2) OVER w AS s2, lead(stage, 3) OVER w AS s3 FROM trace WINDOW w AS (PARTITION BY artifact_id ORDER BY seq)), g AS (SELECT stage || '>' || s1 AS gram FROM l WHERE s1 IS NOT NULL UNION ALL SELECT stage || '>' || s1 || '>' || s2 FROM l WHERE s2 IS NOT NULL UNION ALL SELECT stage || '>' || s1 || '>' || s2 || '>' || s3 FROM l WHERE s3 IS NOT NULL)"


@query("win_11", f"WITH base, {_GRAMS} SELECT gram, count(*) AS n FROM g GROUP BY gram")
def win_11(c):
    return tool_grams(c.trace)


@query("win_12", "WITH base SELECT session_id, turn, lag(content) OVER (PARTITION BY session_id ORDER BY turn) AS previous FROM episodes")
def win_12(c):
    return c.episodes.select("session_id", "turn", F.lag("content").over(Window.partitionBy("session_id").orderBy("turn")).alias("previous"))


@query("win_13", "WITH base SELECT document_id, chunk_index, coalesce(lead(char_start) OVER (PARTITION BY document_id ORDER BY chunk_index) - char_end, 0) AS gap FROM chunks")
def win_13(c):
    from corpusloom.operators.chunking import overlap_coverage

    return overlap_coverage(c.chunks)


@query("win_14", f"WITH {_VEC}, l AS (SELECT vec_id, e, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM v) SELECT vec_id, round(list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))), 6) AS cosine FROM l WHERE p IS NOT NULL")
def win_14(c):
    from corpusloom.operators.scalar_queries import cosine

    v = c.table("embeddings").withColumn("p", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return v.where("p IS NOT NULL").select("vec_id", F.round(cosine(F.col("embedding"), F.col("p")), 6).alias("cosine"))


# Sort, limit, top-k


@query("top_02", "WITH base SELECT chunk_id, chunk_index FROM chunks")
def top_02(c):
    return c.chunks.select("chunk_id", "chunk_index").orderBy("chunk_index", "chunk_id")


@query("top_03", "WITH base SELECT session_id, turn, content FROM episodes QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 3")
def top_03(c):
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return c.episodes.withColumn("r", F.row_number().over(w)).where("r <= 3").select("session_id", "turn", "content")


@query("top_04", f"WITH {_VEC}, s AS (SELECT query_id, vec_id, label, round(list_dot_product(e, q), 6) AS score FROM v, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 30), d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) = 1) SELECT query_id, vec_id, label, score FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def top_04(c):
    """Three times as many as asked for, then the best of each document, then the cut."""
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    s = nearest_rows(rows, _probe(c), 30, "dot", ("label",), own=True).select("query_id", F.col("id").alias("vec_id"), "label", "score")
    cut = lambda df, k, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k).drop("r")
    return cut(cut(s, 1, "query_id", "label"), 10, "query_id")


def representatives(vectors, key: str = "label", most: int = 5):
    """The members nearest their group's mean, in their own order; groups of up to three keep all."""
    from corpusloom.operators.scalar_queries import cosine

    near = vectors.join(mean_vectors(vectors, key), key).select(key, "vec_id", F.round(cosine(F.col("embedding"), F.col("centroid")), 5).alias("s"))
    w = Window.partitionBy(key).orderBy(F.desc("s"), "vec_id")
    ranked = near.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return ranked.where((F.col("r") <= most) | (F.col("n") <= 3)).groupBy(key).agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


_MEANS = "t AS (SELECT label, unnest(generate_series(1, len(e))) AS pos, unnest(e) AS x FROM v), m AS (SELECT label, pos, round(avg(x), 6) AS m FROM t GROUP BY ALL), cen AS (SELECT label, list(m ORDER BY pos) AS c FROM m GROUP BY label)"
_NEAR = "n AS (SELECT label, vec_id, round(list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c))), 5) AS s FROM v JOIN cen USING (label))"


@query("top_05", f"WITH {_VEC}, {_MEANS}, {_NEAR} SELECT label, list(vec_id ORDER BY vec_id) AS members FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= 5) GROUP BY label")
def top_05(c):
    return representatives(c.table("embeddings"))


@query("top_06", "WITH t AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY ALL) SELECT doc_id, w AS term, n FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) <= 5")
def top_06(c):
    return top_terms(c.docs, "doc_id", 5)


def top_terms(docs, key: str, k: int):
    t = docs.select(key, F.explode(T.found(F.lower("text"), "[a-z]{4,}")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term"))).where(F.col("r") <= k).drop("r")


@query("top_07", "WITH base, r AS (SELECT document_id, chunk_id, chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r FROM chunks WHERE source = 'src5'), s AS (SELECT CAST(ceil(60.0 / count(DISTINCT document_id)) AS BIGINT) AS share FROM r) SELECT chunk_id FROM r, s WHERE r <= share ORDER BY document_id, chunk_index LIMIT 60")
def top_07(c):
    """Each document of a scope may give at most ceil(max / documents) chunks; then the overall cut."""
    hits = c.chunks.where("source = 'src5'")
    share = hits.agg(F.ceil(60 / F.count_distinct("document_id")).alias("share"))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")))
    return ranked.join(F.broadcast(share), F.lit(True)).where("r <= share").orderBy("document_id", "chunk_index").limit(60).select("chunk_id")


@query("top_08", "WITH base SELECT document_id, 'pending' AS kind FROM (SELECT document_id FROM docs WHERE doc_id % 3 = 1 ORDER BY stored_at, document_id LIMIT 20) UNION ALL SELECT document_id, 'promoted' FROM (SELECT document_id FROM docs WHERE doc_id % 3 = 0 ORDER BY stored_at DESC, document_id LIMIT 20)")
def top_08(c):
    pending = c.docs.where("doc_id % 3 = 1").orderBy("stored_at", "document_id").limit(20).select("document_id", F.lit("pending").alias("kind"))
    promoted = c.docs.where("doc_id % 3 = 0").orderBy(F.desc("stored_at"), "document_id").limit(20).select("document_id", F.lit("promoted").alias("kind"))
    return pending.union(promoted)


# Set operations


@query("set_01", "WITH base SELECT document_id FROM docs EXCEPT (SELECT document_id FROM docs WHERE doc_id % 3 = 0 UNION SELECT document_id FROM docs WHERE doc_id % 5 = 0)")
def set_01(c):
    done = c.docs.where("doc_id % 3 = 0").select("document_id").union(c.docs.where("doc_id % 5 = 0").select("document_id"))
    return c.docs.select("document_id").distinct().join(done, "document_id", "left_anti")


@query("set_02", "WITH base SELECT chunk_id FROM chunks WHERE contains(text, 'with') UNION SELECT chunk_id FROM chunks WHERE contains(text, 'that')")
def set_02(c):
    leg = lambda w: c.chunks.where(F.contains("text", F.lit(w))).select("chunk_id")
    return leg("with").union(leg("that")).distinct()


@query("set_03", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a, ['the', 'of', 'and', 'with'] AS b FROM benchmark) SELECT item_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS both, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS either FROM t")
def set_03(c):
    a, b = F.array_distinct(T.found(F.lower("text"), "[a-z]+")), T.literals(["the", "of", "and", "with"])
    return c.table("benchmark").select("item_id", F.size(F.array_intersect(a, b)).cast("long").alias("both"), F.size(F.array_union(a, b)).cast("long").alias("either"))


@query("set_04", "WITH base, s AS (SELECT document_id, 1 AS rank, 'registered' AS status FROM docs UNION ALL SELECT document_id, 3, 'indexed' FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT document_id, 2, 'failed' FROM docs WHERE doc_id % 3 = 0) SELECT document_id, arg_max(status, rank) AS status FROM s GROUP BY 1")
def set_04(c):
    part = lambda where, rank, status: c.docs.where(where).select("document_id", F.lit(rank).alias("rank"), F.lit(status).alias("status"))
    return part("true", 1, "registered").union(part("doc_id % 2 = 0", 3, "indexed")).union(part("doc_id % 3 = 0", 2, "failed")).groupBy("document_id").agg(F.max_by("status", "rank").alias("status"))


@query("set_05", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT item_id, list_has_all(w, ['the', 'of']) AS covered FROM t")
def set_05(c):
    w = T.found(F.lower("text"), "[a-z]+")
    return c.table("benchmark").select("item_id", (F.size(F.array_except(T.literals(["the", "of"]), w)) == 0).alias("covered"))
