"""Trace, session and memory analytics in batch form; corpusloom.streaming has the incremental ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.registry import query
from corpusloom.operators.relational_queries import _GRAMS, tool_grams

NOW = "2024-01-05 12:00:00"


@query("evt_01", "WITH base SELECT artifact_id, stage, row_number() OVER (PARTITION BY artifact_id ORDER BY seq) AS step FROM trace")
def evt_01(c):
    return c.trace.select("artifact_id", "stage", F.row_number().over(Window.partitionBy("artifact_id").orderBy("seq")).alias("step"))


@query("evt_02", "WITH base SELECT seq, stage FROM trace WHERE status = 'failed' OR stage = 'view'")
def evt_02(c):
    return c.trace.where("status = 'failed' OR stage = 'view'").select("seq", "stage")


@query("evt_03", "WITH base SELECT stage, count(*) AS total, count(DISTINCT artifact_id) AS artifacts, count_if(status = 'failed') AS failed, round(avg(latency_ms) FILTER (WHERE latency_ms > 0), 2) AS avg_latency FROM trace GROUP BY stage")
def evt_03(c):
    return c.trace.groupBy("stage").agg(F.count("*").alias("total"), F.count_distinct("artifact_id").alias("artifacts"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), 2).alias("avg_latency"))


def ewma(observations: DataFrame, key: str, order: str, score: str, keep: float = 0.7, least: int = 2, threshold: float = 0.4) -> DataFrame:
    """(key, n, confidence, needs_research). The moving average in closed form: each observation's weight depends on how many
    follow it, so a window and a sum replace the fold."""
    w = Window.partitionBy(key)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    rows = observations.select(key, F.col(score).alias("s"), n.alias("n"), i.alias("i"))
    weight = F.when(F.col("i") == 1, F.pow(F.lit(keep), F.col("n") - 1)).otherwise((1 - keep) * F.pow(F.lit(keep), F.col("n") - F.col("i")))
    by = rows.groupBy(key).agg(F.max("n").alias("n"), F.round(F.sum(weight * F.col("s")), 6).alias("confidence"))
    return by.withColumn("needs_research", (F.col("n") >= least) & (F.col("confidence") < threshold))


_OBS = "ob AS (SELECT artifact_id, seq, greatest(0.0, least(1.0, latency_ms / 200.0)) AS s, count(*) OVER (PARTITION BY artifact_id) AS n, row_number() OVER (PARTITION BY artifact_id ORDER BY seq) AS i FROM trace), ew AS (SELECT artifact_id, max(n) AS n, round(sum(CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END * s), 6) AS confidence FROM ob GROUP BY 1)"


def _confidence(c) -> DataFrame:
    return ewma(c.trace.withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("latency_ms") / 200.0))), "artifact_id", "seq", "s")


@query("evt_04", f"WITH base, {_OBS} SELECT artifact_id, n, confidence, n >= 2 AND confidence < 0.4 AS needs_research FROM ew")
def evt_04(c):
    return _confidence(c)


def search_score(hits: Column, mean: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))
    return F.when(hits == 0, 0.0).when(hits < 3, clamped * 0.5).otherwise(clamped)


def compile_score(documents: Column) -> Column:
    return F.when(documents == 0, 0.0).when(documents < 5, 0.3).when(documents < 15, 0.6).otherwise(0.85)


def research_score(ingested: Column) -> Column:
    return F.when(ingested == 0, 0.2).when(ingested < 3, 0.5).otherwise(0.8)


@query("evt_05", "WITH base SELECT seq, CASE WHEN seq % 5 = 0 THEN 0.0 WHEN seq % 5 < 3 THEN least(1.0, latency_ms / 300.0) * 0.5 ELSE least(1.0, latency_ms / 300.0) END AS search, CASE WHEN seq % 20 = 0 THEN 0.0 WHEN seq % 20 < 5 THEN 0.3 WHEN seq % 20 < 15 THEN 0.6 ELSE 0.85 END::DOUBLE AS compile, CASE WHEN seq % 4 = 0 THEN 0.2 WHEN seq % 4 < 3 THEN 0.5 ELSE 0.8 END::DOUBLE AS research FROM trace")
def evt_05(c):
    n = F.col("seq")
    return c.trace.select("seq", search_score(n % 5, F.col("latency_ms") / 300.0).alias("search"), compile_score(n % 20).alias("compile"), research_score(n % 4).alias("research"))


@query("evt_06", f"WITH base, {_OBS} SELECT artifact_id, confidence FROM ew WHERE n >= 2 AND confidence < 0.4 AND artifact_id % 3 <> 0 ORDER BY confidence, artifact_id LIMIT 10")
def evt_06(c):
    proposed = c.trace.where("artifact_id % 3 = 0").select("artifact_id").distinct()
    return _confidence(c).where("needs_research").join(proposed, "artifact_id", "left_anti").orderBy("confidence", "artifact_id").limit(10).select("artifact_id", "confidence")


@query("evt_07", "WITH base SELECT artifact_id, count(*) AS n, round(CASE WHEN count(*) = 1 THEN 1 / ln(21) ELSE least(1.0, ln(1 + count(*)) / ln(21)) END, 6) AS score FROM trace WHERE stage = 'error' GROUP BY 1")
def evt_07(c):
    n = F.col("n")
    by = c.trace.where("stage = 'error'").groupBy("artifact_id").agg(F.count("*").alias("n"))
    return by.withColumn("score", F.round(F.when(n == 1, 1 / F.log(F.lit(21.0))).otherwise(F.least(F.lit(1.0), F.log(1 + n) / F.log(F.lit(21.0)))), 6))


_SAID = "sa AS (SELECT role, turn, 'about ''topic ' || (session_id % 7) || ''' [TOOL:search_corpus] {\"query\": \"q' || (turn % 3) || '\"}' AS s FROM episodes)"


@query("evt_08", f"WITH base, {_SAID}, ob AS (SELECT lower(unnest(regexp_extract_all(s, '''([^'']{{3,60}})''', 1))) AS topic, 1 AS w FROM sa WHERE role = 'assistant' UNION ALL SELECT json_extract_string(regexp_extract(s, '\\[TOOL:\\w+\\]\\s*(\\{{.*?\\}})', 1), '$.query'), 2 FROM sa) SELECT topic, CAST(sum(w) AS BIGINT) AS weight FROM ob GROUP BY 1 ORDER BY weight DESC, topic LIMIT 30")
def evt_08(c):
    """Quoted phrases of the assistant count once, tool queries twice."""
    s = F.concat(F.lit("about 'topic "), (F.col("session_id") % 7).cast("string"), F.lit("' [TOOL:search_corpus] {\"query\": \"q"), (F.col("turn") % 3).cast("string"), F.lit('"}'))
    e = c.episodes.select("role", s.alias("s"))
    quoted = e.where("role = 'assistant'").select(F.explode(F.regexp_extract_all(F.lower("s"), F.lit("'([^']{3,60})'"), F.lit(1))).alias("topic"), F.lit(1).alias("w"))
    asked = e.select(F.get_json_object(F.regexp_extract("s", r"\[TOOL:\w+\]\s*(\{.*?\})", 1), "$.query").alias("topic"), F.lit(2).alias("w"))
    return quoted.union(asked).groupBy("topic").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "topic").limit(30)


# Openings of a task.
PREFIXES = ("investiga sobre ", "investiga ", "hace un reporte sobre ", "hace un reporte de ", "busca ")


@query("evt_09", "WITH base, t AS (SELECT strip_accents(lower(trim(CASE session_id % 3 WHEN 0 THEN 'Investiga ' WHEN 1 THEN 'Hace un reporte sobre ' ELSE '' END || content))) AS g FROM episodes WHERE role = 'user'), w AS (SELECT regexp_extract(regexp_replace(g, '^(?:investiga sobre |investiga |hace un reporte sobre |hace un reporte de |busca )', ''), '^\\S+') AS topic FROM t) SELECT topic, count(*) AS n, least(1.0, count(*) / 5.0::DOUBLE) AS confidence FROM w WHERE topic <> '' GROUP BY 1 HAVING count(*) >= 3")
def evt_09(c):
    n = F.col("session_id") % 3
    goal = F.concat(F.when(n == 0, "Investiga ").when(n == 1, "Hace un reporte sobre ").otherwise(""), "content")
    bare = F.regexp_replace(T.strip_accents(F.lower(F.trim(goal))), "^(?:" + "|".join(PREFIXES) + ")", "")
    return c.episodes.where("role = 'user'").select(F.regexp_extract(bare, r"^\S+", 0).alias("topic")).where("topic != ''").groupBy("topic").agg(F.count("*").alias("n")).where("n >= 3").withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 5))


@query("evt_10", "WITH base, t AS (SELECT count_if(turn % 5 = 0) AS longer, count_if(turn % 5 = 1) AS shorter FROM episodes WHERE role = 'user') SELECT longer, shorter, CASE WHEN longer >= 3 AND longer > shorter THEN 'long' WHEN shorter >= 3 AND shorter > longer THEN 'short' ELSE 'none' END AS preference FROM t")
def evt_10(c):
    t = c.episodes.where("role = 'user'").agg(F.count_if(F.col("turn") % 5 == 0).alias("longer"), F.count_if(F.col("turn") % 5 == 1).alias("shorter"))
    return t.withColumn("preference", F.when((F.col("longer") >= 3) & (F.col("longer") > F.col("shorter")), "long").when((F.col("shorter") >= 3) & (F.col("shorter") > F.col("longer")), "short").otherwise("none"))


@query("evt_11", f"WITH base, {_GRAMS}, k AS (SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 20) SELECT gram, n, least(1.0, n / 10.0::DOUBLE) AS confidence FROM k WHERE n >= 3")
def evt_11(c):
    return tool_grams(c.trace).orderBy(F.desc("n"), "gram").limit(20).where("n >= 3").withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 10))


@query("evt_12", f"WITH base, {_GRAMS}, k AS (SELECT gram, count(*) AS n FROM g WHERE len(string_split(gram, '>')) <= 3 GROUP BY gram ORDER BY n DESC, gram LIMIT 10) SELECT gram, n FROM k WHERE n >= 3")
def evt_12(c):
    return tool_grams(c.trace, (2, 3)).orderBy(F.desc("n"), "gram").limit(10).where("n >= 3")


@query("evt_13", f"WITH base, s AS (SELECT session_id, max(created_at) AS last, count(*) AS turns FROM episodes GROUP BY 1) SELECT session_id, turns, last <= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE AS stale, last <= TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE AND turns >= 2 AS idle FROM s WHERE last <= TIMESTAMP '{NOW}'")
def evt_13(c):
    s = c.episodes.groupBy("session_id").agg(F.max("created_at").alias("last"), F.count("*").alias("turns"))
    ago = lambda m: F.lit(NOW).cast("timestamp") - F.expr(f"INTERVAL {m} MINUTES")
    return s.where(F.col("last") <= ago(0)).select("session_id", "turns", (F.col("last") <= ago(30)).alias("stale"), ((F.col("last") <= ago(5)) & (F.col("turns") >= 2)).alias("idle"))


@query("evt_14", "WITH base SELECT role AS topic, count(*) AS episodes, count(DISTINCT session_id) AS sessions FROM episodes GROUP BY 1 HAVING count(*) >= 3")
def evt_14(c):
    return c.episodes.groupBy(F.col("role").alias("topic")).agg(F.count("*").alias("episodes"), F.count_distinct("session_id").alias("sessions")).where("episodes >= 3")


# Mastery states from the lowest.
MASTERY = ("unknown", "exposed", "needs_review", "understood", "applied")


@query("evt_15", "WITH base, a AS (SELECT artifact_id, count(*) AS n, avg(least(1.0, latency_ms / 80.0)) AS m FROM trace WHERE stage IN ('purchase', 'signup') GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT artifact_id, n, round(m, 3) AS mean, CASE WHEN m >= 0.8 THEN 'applied' WHEN m >= 0.6 THEN 'understood' ELSE 'needs_review' END AS proposed, artifact_id % 5 AS current FROM a) SELECT artifact_id, n, mean, proposed FROM p WHERE list_position(['unknown', 'exposed', 'needs_review', 'understood', 'applied'], proposed) - 1 > current")
def evt_15(c):
    """Proposals from mean scores; a state is never lowered."""
    a = c.trace.where("stage IN ('purchase', 'signup')").groupBy("artifact_id").agg(F.count("*").alias("n"), F.avg(F.least(F.lit(1.0), F.col("latency_ms") / 80.0)).alias("m")).where("n >= 2")
    p = a.withColumn("proposed", F.when(F.col("m") >= 0.8, "applied").when(F.col("m") >= 0.6, "understood").otherwise("needs_review"))
    return p.where(F.array_position(T.literals(MASTERY), F.col("proposed")) - 1 > F.col("artifact_id") % 5).select("artifact_id", "n", F.round("m", 3).alias("mean"), "proposed")


@query("evt_16", "WITH base SELECT artifact_id, count(*) AS attempts, array_to_string(list(stage ORDER BY seq), ',') AS evidence, arg_max(latency_ms, seq) AS latest FROM trace WHERE stage <> 'view' GROUP BY 1")
def evt_16(c):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "stage"))), lambda s: s.stage)
    return c.trace.where("stage != 'view'").groupBy("artifact_id").agg(F.count("*").alias("attempts"), F.array_join(ordered, ",").alias("evidence"), F.max_by("latency_ms", "seq").alias("latest"))


@query("evt_17", "WITH base, o AS (SELECT seq, artifact_id, lead(seq) OVER (PARTITION BY artifact_id, stage ORDER BY seq) AS newer FROM trace WHERE ts >= TIMESTAMP '2024-01-10'), a AS (SELECT artifact_id, max(seq) AS acked FROM trace WHERE stage = 'signup' AND artifact_id % 2 = 0 GROUP BY 1) SELECT o.seq, d.device FROM o LEFT JOIN a USING (artifact_id), (SELECT unnest(['phone', 'desk']) AS device) d WHERE newer IS NULL AND o.seq > coalesce(acked, 0)")
def evt_17(c):
    """Outbox: the retention cut, the newest of a key, past the acknowledged mark, to each device."""
    kept = c.trace.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).withColumn("newer", F.lead("seq").over(Window.partitionBy("artifact_id", "stage").orderBy("seq"))).where("newer IS NULL")
    acked = c.trace.where("stage = 'signup' AND artifact_id % 2 = 0").groupBy("artifact_id").agg(F.max("seq").alias("acked"))
    due = kept.join(acked, "artifact_id", "left").where(F.col("seq") > F.coalesce("acked", F.lit(0)))
    return due.select("seq", F.explode(T.literals(["phone", "desk"])).alias("device"))


@query("evt_18")
def evt_18(c):
    """Pending drain: new chunks of a file source, in bounded micro-batches with a checkpoint; see corpusloom.streaming."""
    from corpusloom.streaming.jobs import drain

    return drain(c.spark, c.sf_dir)


@query("evt_19", "WITH base, i AS (SELECT 'doc:' || (doc_id % 100) AS key, text, doc_id AS at_seq FROM docs UNION ALL SELECT 'conv:' || session_id, content, turn FROM episodes) SELECT key, arg_max(text, at_seq) AS text FROM i GROUP BY 1")
def evt_19(c):
    a = c.docs.select(F.concat(F.lit("doc:"), (F.col("doc_id") % 100).cast("string")).alias("key"), F.col("text"), F.col("doc_id").alias("at_seq"))
    b = c.episodes.select(F.concat(F.lit("conv:"), F.col("session_id").cast("string")).alias("key"), F.col("content").alias("text"), F.col("turn").alias("at_seq"))
    return a.unionByName(b).groupBy("key").agg(F.max_by("text", "at_seq").alias("text"))


def roadmap_findings(units: DataFrame, strict: bool = True) -> DataFrame:
    """(roadmap, code, severity) from units (roadmap, unit, grounded, minutes)."""
    each = F.array(F.when(~F.col("grounded"), F.struct(F.lit("ungrounded_unit").alias("code"), F.lit("error" if strict else "warning").alias("severity"))), F.when(F.col("minutes") > 120, F.struct(F.lit("effort_outlier").alias("code"), F.lit("info").alias("severity"))))
    own = units.select("roadmap", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("roadmap", "f.code", "f.severity")
    n = units.groupBy("roadmap").agg(F.count("*").alias("n"))
    size = n.where("n < 3 OR n > 7").select("roadmap", F.when(F.col("n") < 3, "too_few_units").otherwise("too_many_units").alias("code"), F.lit("error").alias("severity"))
    return own.unionByName(size)


@query("evt_20", "WITH base, un AS (SELECT session_id AS roadmap, turn AS unit, turn % 3 <> 1 AS grounded, 60 + length(content) % 100 AS minutes FROM episodes) SELECT roadmap, code, severity, count(*) AS n FROM (SELECT roadmap, 'ungrounded_unit' AS code, 'error' AS severity FROM un WHERE NOT grounded UNION ALL SELECT roadmap, 'effort_outlier', 'info' FROM un WHERE minutes > 120 UNION ALL SELECT roadmap, CASE WHEN count(*) < 3 THEN 'too_few_units' ELSE 'too_many_units' END, 'error' FROM un GROUP BY roadmap HAVING count(*) < 3 OR count(*) > 7) GROUP BY ALL")
def evt_20(c):
    units = c.episodes.select(F.col("session_id").alias("roadmap"), F.col("turn").alias("unit"), (F.col("turn") % 3 != 1).alias("grounded"), (60 + F.length("content") % 100).alias("minutes"))
    return roadmap_findings(units).groupBy("roadmap", "code", "severity").agg(F.count("*").alias("n"))


@query("evt_21", f"WITH base, l AS (SELECT stage, max(ts) AS last FROM trace WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1) SELECT stage, CASE WHEN date_diff('second', last, TIMESTAMP '{NOW}') < 600 THEN 'cooldown' WHEN stage = 'error' THEN 'model_missing' ELSE 'eligible' END AS state FROM l")
def evt_21(c):
    now = F.lit(NOW).cast("timestamp")
    l = c.trace.where(F.col("ts") <= now).groupBy("stage").agg(F.max("ts").alias("last"))  # noqa: E741
    age = F.unix_timestamp(now) - F.unix_timestamp("last")
    return l.select("stage", F.when(age < 600, "cooldown").when(F.col("stage") == "error", "model_missing").otherwise("eligible").alias("state"))


@query("evt_22", "WITH base, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM episodes) SELECT session_id, substr(string_agg(role || ': ' || substr(content, 1, 600), chr(10) ORDER BY turn), 1, 12000) AS transcript FROM r WHERE r <= 40 AND n >= 2 GROUP BY 1")
def evt_22(c):
    r = c.episodes.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))).where("r <= 40")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, 600)).alias("s")))), lambda x: x.s)
    by = r.groupBy("session_id").agg(F.count("*").alias("n"), F.substring(F.array_join(parts, "\n"), 1, 12000).alias("transcript"))
    return by.where("n >= 2").select("session_id", "transcript")


# Extensions over the event table: windows with a late-data bound


@query("ext_tumbling", "WITH base SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, stage, count(*) AS n, round(sum(latency_ms), 4) AS total FROM trace GROUP BY ALL")
def ext_tumbling(c):
    return c.trace.groupBy(F.window("ts", "1 day").start.alias("day"), "stage").agg(F.count("*").alias("n"), F.round(F.sum("latency_ms"), 4).alias("total"))


@query("ext_sessions", "WITH base, l AS (SELECT artifact_id, ts, seq, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM trace WINDOW w AS (PARTITION BY artifact_id ORDER BY ts, seq)), s AS (SELECT artifact_id, ts, sum(new) OVER (PARTITION BY artifact_id ORDER BY ts, seq) AS k FROM l) SELECT artifact_id, min(ts) AS start, count(*) AS n FROM s GROUP BY artifact_id, k")
def ext_sessions(c):
    return c.trace.groupBy("artifact_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("artifact_id", F.col("w.start").alias("start"), "n")
