"""Plans that must hold where one key has most rows, and where nothing is configured."""

import os
import random
import re
import subprocess
import sys
import tempfile
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import curation, topics
from corpusloom.plans import metric_pairs
from corpusloom.plans.components import connected_components, least_nodes
from corpusloom.plans.metric_pairs import vector_pairs
from corpusloom.plans.ordered import lagged


def test_session_without_a_checkpoint_folder():
    code = "from corpusloom.session import local_session, materialize\ns = local_session(1, 1)\nassert not s.sparkContext.getConf().contains('spark.checkpoint.dir')\nassert [materialize(s.range(3)).count() for _ in 'ab'] == [3, 3]\nprint('fine')"
    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    got = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in got.stdout, got.stderr[-2000:]


def test_rows_before_in_hot_groups(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c", None, f"x{i % 50}"])) for i in range(3000)]
    rng.shuffle(rows)
    want, last = {}, {}
    for i, k in sorted(rows):
        want[i] = last.get(k) if k is not None else None
        last[k] = i
    df = spark.createDataFrame(rows, "i long, k string")
    for most in (10, 100, 10_000):
        got = {r.i: r.before for r in lagged(df, "k", "i", "i", "before", most).collect()}
        assert got == want


def test_no_task_gets_a_hot_group(spark):
    df = spark.range(20_000).select(F.col("id").alias("i"), F.when(F.col("id") % 5 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    out = lagged(df, "k", "i", "i", "before", 1_000).where("k = 'hot'")
    assert out.count() == 16_000 and out.where("before IS NULL").count() == 1
    assert out.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] <= 8_000


def test_components_of_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 4000)] + [(10_000 + i, 10_001 + i) for i in range(300)] + [(7, 7), (None, 3), (20_001, 20_000)]
    for most in (10, 1_000_000):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), most=most).collect()}
        assert all(got[i] == 0 for i in range(4000)) and all(got[10_000 + i] == 10_000 for i in range(301))
        assert got[20_001] == got[20_000] == 20_000 and len(got) == 4000 + 301 + 2
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
    names = spark.createDataFrame([("b", "c"), ("c", "d"), ("z", "y")], "a string, b string")
    assert sorted(map(tuple, connected_components(names).collect())) == [("b", "b"), ("c", "b"), ("d", "b"), ("y", "y"), ("z", "y")]


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    for n, m in ((50, 30), (400, 380), (3000, 2900)):
        x, y = (np.array([rng.randrange(n) for _ in range(m)]) for _ in "xy")
        up = list(range(n))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            up[max(find(a), find(b))] = min(find(a), find(b))
        assert least_nodes(n, x, y).tolist() == [find(i) for i in range(n)]


def _close(rows, cosine, digits=9, grouped=False):
    out = []
    for i, (a, v, g) in enumerate(rows):
        for b, w, h in rows[i + 1 :]:
            if None in (a, b, g, h) or a == b or (grouped and g != h) or not v or not w or len(v) != len(w) or not np.isfinite(np.array([*v, *w], float)).all():
                continue
            x, y = np.array(v), np.array(w)
            if (x @ x) * (y @ y) and round(float(x @ y / np.sqrt((x @ x) * (y @ y))), digits) >= cosine:
                out.append((min(a, b), max(a, b)))
    return sorted(out)


@pytest.mark.parametrize("block", [5, 40, 4096])
def test_pairs_above_a_cosine(spark, block):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 5))
    rows = [(int(i), [float(x) for x in centres[rng.integers(9)] + rng.normal(size=5) * rng.choice([0.05, 0.3])], int(rng.integers(3))) for i in rng.permutation(240)]
    rows += [(900, rows[0][1], rows[0][2]), (901, [0.0] * 5, 0), (902, None, 0), (903, [float("nan")] * 5, 0), (904, [1.0, None, 0.0, 0.0, 0.0], 0), (905, [1.0, 2.0], 0), (906, rows[1][1], None), (None, rows[1][1], 1), (900, rows[2][1], 1), (907, [], 1)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, label int, s double").repartition(3)
    good = [(a, v if v is None or None not in v else None, g if g is not None else -1) for a, v, g in rows]
    for cosine in (0.2, 0.95):
        got = vector_pairs(df, cosine, block=block)
        assert sorted((r.a, r.b) for r in got.collect()) == _close(good, cosine)
        assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().toString())
    got = vector_pairs(df, 0.9, group="label", digits=6, block=block)
    assert sorted((r.a, r.b) for r in got.collect()) == _close([r for r in good if r[2] >= 0], 0.9, 6, True)
    assert vector_pairs(df.limit(0), 0.5).count() == 0


def test_clustered_vectors_meet_few_others(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(64, 16))
    rows = [(i, [float(x) for x in centres[i % 64] + rng.normal(size=16) * 0.02]) for i in range(6400)]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", F.lit(0).alias("group"), F.size("v").alias("width"), "v")
    sent = metric_pairs._sent(df, df.groupBy("group", "width").agg(F.count("*").alias("n")), float(np.sqrt(2 - 2 * 0.95)), 100)
    # 256 cells, four a cluster: all pairs of cells would send each point 256 times
    assert sent.count() <= 5 * 6400


def _plain_linkage(ids, similarity, threshold):
    groups = {i: [i] for i in ids}
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    least = min(similarity.get((min(x, y), max(x, y)), -1.0) for x in groups[a] for y in groups[b])
                    if least >= threshold:
                        best = max(best or (least, a, b), (least, a, b))
        if best is None:
            return [sorted(groups[i]) for i in sorted(groups)]
        groups[best[1]] += groups.pop(best[2])


def _plain_pass(ids, similarity, threshold):
    clusters = []
    for i in ids:
        scored = [(max(similarity.get((j, i), -1.0) for j in members), -k) for k, members in enumerate(clusters)]
        s, k = max(scored, default=(0.0, 0))
        if s > 0 and s >= threshold:
            clusters[-k].append(i)
        else:
            clusters.append([i])
    return clusters


def test_sparse_folds_equal_plain_ones():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 14)
        sim = {(a, b): rng.choice([0.2, 0.5, 0.6, 0.7, 0.9]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6}
        for threshold in (0.0, 0.5):
            assert topics.complete_linkage(list(range(n)), sim, threshold) == _plain_linkage(list(range(n)), sim, threshold)
            assert topics.single_pass(list(range(n)), sim, threshold) == _plain_pass(list(range(n)), sim, threshold)


def test_linkage_in_rounds_equals_the_fold(spark):
    """Rounds of joins merge what the fold merges, with ties, whatever number of pairs is left to it."""
    rng = random.Random(12)
    sim = {(a, b): rng.choice([0.5, 0.6, 0.7, 0.9]) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.4}
    want = {i: min(g) for g in topics.complete_linkage(list(range(60)), sim, 0.5) for i in g}
    for most in (0, 60):
        left, groups = topics.linked(spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a long, b long, s double"), most)
        to = {r.vec_id: r.label for r in groups.collect()}
        rest = {(r.a, r.b): r.s for r in left.collect()}
        assert len(rest) <= most
        last = {i: min(g) for g in topics.complete_linkage(sorted(set(range(60)) - set(to)), rest, 0.5) for i in g}
        assert {i: last[to.get(i, i)] for i in range(60)} == want


def test_sparse_folds_take_a_hundred_thousand_pairs():
    rng = random.Random(6)
    sim = {}
    while len(sim) < 100_000:
        a, b = rng.randrange(20_000), rng.randrange(20_000)
        if a != b:
            sim[min(a, b), max(a, b)] = rng.random()
    hub = {(0, i): 0.9 for i in range(1, 20_000)}
    for fold in (topics.complete_linkage, topics.single_pass):
        began = time.perf_counter()
        assert sorted(x for g in fold(list(range(20_000)), sim | hub, 0.1) for x in g) == list(range(20_000))
        assert time.perf_counter() - began < 20


def test_acceptance_of_a_long_chain(spark):
    n = 10_000
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    docs = spark.range(n + 1).withColumnRenamed("id", "doc_id")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = sorted(r.doc_id for r in curation.accepted(docs, links).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == list(range(0, n + 1, 2)) and 0 < jobs < 20


def test_acceptance_by_task_by_group_and_in_rounds(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(150)} | {(400 + i, 401 + i) for i in range(9)}
    gone = set()
    for b in range(500):
        if any((a, b) in edges and a not in gone for a in range(b)):
            gone.add(b)
    docs, links = spark.range(500).withColumnRenamed("id", "doc_id"), spark.createDataFrame(sorted(edges), "a long, b long")
    for most in (10**6, 20, 3):
        assert sorted(r.doc_id for r in curation.accepted(docs, links, most=most).collect()) == [i for i in range(500) if i not in gone]
