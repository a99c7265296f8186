from pyspark.sql import functions as F

from corpusloom.operators.corpus import Corpus
from corpusloom.operators.event_queries import ewma
from corpusloom.streaming import jobs

SF = "/root/testdata/sf0.001"
SCHEMA = "seq long, artifact_id long, stage string, status string, ts timestamp, score double"


def _stream(spark, tmp_path, parts):
    """A file stream that gives one part a batch, in order."""
    folder = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        __import__("time").sleep(0.05)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))


def _run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _row(seq, at, stage="view", artifact=1, score=0.5, status="ok"):
    import datetime

    return seq, artifact, stage, status, datetime.datetime.fromisoformat(at), score


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    parts = [[_row(1, "2024-01-01T01:00:00"), _row(2, "2024-01-03T00:00:00")], [_row(3, "2024-01-03T01:00:00")], [_row(4, "2024-01-01T02:00:00"), _row(5, "2024-01-06T00:00:00", status="failed")], [_row(6, "2024-01-09T00:00:00")]]
    _run(jobs.stage_windows(_stream(spark, tmp_path, parts)), "w1", "append", tmp_path)
    got = {r.start.day: (r.n, r.failed) for r in spark.table("w1").collect()}
    assert got[1] == (1, 0) and got[3] == (2, 0) and got[6] == (1, 1)


def test_sessions_close_after_a_gap(spark, tmp_path):
    parts = [[_row(1, "2024-01-01T01:00:00"), _row(2, "2024-01-01T01:20:00"), _row(3, "2024-01-01T03:00:00")], [_row(4, "2024-01-02T00:00:00")], [_row(5, "2024-01-03T00:00:00")]]
    _run(jobs.sessions(_stream(spark, tmp_path, parts)), "s1", "append", tmp_path)
    assert sorted(r.turns for r in spark.table("s1").collect())[-1] == 2


def test_confidence_equals_the_closed_form(spark, tmp_path):
    rows = [_row(i, f"2024-01-01T{i // 60:02}:{i % 60:02}:00", artifact=i % 3, score=(i * 37 % 100) / 100) for i in range(90)]
    _run(jobs.confidence(_stream(spark, tmp_path, [rows[:30], rows[30:60], rows[60:]])), "c1", "update", tmp_path)
    last = {r.artifact_id: r for r in spark.table("c1").groupBy("artifact_id").agg(F.max_by(F.struct("n", "confidence", "needs_research"), "n").alias("r")).select("artifact_id", "r.*").collect()}
    for r in ewma(spark.createDataFrame(rows, SCHEMA), "artifact_id", "seq", "score").collect():
        got = last[r.artifact_id]
        assert got.n == r.n and abs(got.confidence - r.confidence) < 1e-5 and got.needs_research == r.needs_research


def test_idle_keys_leave_the_state_and_late_rows_do_not_count(spark, tmp_path):
    day = lambda d, h=0: f"2024-01-{d:02}T{h:02}:00:00"
    parts = [
        [_row(1, day(1), artifact=1, score=1.0), _row(2, day(1), artifact=2, score=1.0), _row(8, day(1), artifact=3)],
        [_row(3, day(2), artifact=2, score=0.5)],
        # artifact 1 is idle for more than three days; the row of the first day is late
        [_row(4, day(6), artifact=2, score=0.5), _row(5, day(1, 1), artifact=2, score=0.0)],
        [_row(6, day(7), artifact=1, score=0.25)],
        [_row(7, day(8), artifact=1, score=0.25)],
    ]
    stream = jobs.confidence(_stream(spark, tmp_path, parts), late="1 hour", idle="3 days")
    query = _run(stream, "c2", "update", tmp_path)
    got = {(r.artifact_id, r.n): round(r.confidence, 6) for r in spark.table("c2").collect()}
    assert got[2, 3] == round(0.7 * (0.7 * 1.0 + 0.3 * 0.5) + 0.3 * 0.5, 6)
    assert (2, 4) not in got and (1, 3) not in got and got[1, 2] == 0.25
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress) >= 1


def test_outbox_keeps_the_newest_of_a_key(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[_row(1, "2024-01-01T00:00:00"), _row(2, "2024-01-01T01:00:00"), _row(3, "2024-01-01T00:30:00", stage="click")], [_row(4, "2024-01-02T00:00:00")]])
    jobs.latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["artifact_id", "stage"], "seq").awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3, 4]


def test_drain_gives_all_chunks_once(spark):
    got = jobs.drain(spark, SF)
    want = Corpus(spark, SF).chunks.select("document_id", "chunk_index", "chunk_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
