import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators.catalog import QUERIES
from corpusloom.plans import nearest


def _plain(rows, queries, k, measure, own):
    pairs = rows.crossJoin(queries).where(F.lit(True) if own else F.col("id") != F.col("query_id"))
    s = nearest._expression(measure, F.col("v"), F.col("q"))
    s = -F.round(-s, 6) if measure == "l2" else F.round(s, 6)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.select("query_id", "id", "label", s.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _told(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("measure", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("own", [False, True])
def test_as_a_scan_tells(spark, measure, odd, own, monkeypatch):
    """Copies, ties by rounding, zero vectors and vectors that no matrix holds; several products and cuts a task."""
    monkeypatch.setattr(nearest, "_PAIRS", 400)
    monkeypatch.setattr(nearest, "_HELD", 50)
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vectors = [rng.choice(base) if rng.random() < 0.5 else [x + rng.choice([0, 1e-7, 1e-3]) for x in rng.choice(base)] for _ in range(500)]
    vectors[7], vectors[50], vectors[100] = [0.0] * 8, [0.0] * 8, [x * 1000 for x in base[0]]
    if odd:
        vectors[3], vectors[150], vectors[9], vectors[200] = None, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [1.0] * 7
    if odd and measure != "dot":
        vectors[11] = [1.0] * 5
    v = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(vectors)], "id long, v array<float>, label int").repartition(3)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    for k, block in ((1, 20_000), (30, 4)):
        got = nearest.nearest_rows(v, q, k, measure, ("label",), own, block).select("query_id", "id", "label", "score", "rank")
        assert _told(got) == _told(_plain(v, q, k, measure, own))


def test_rounding_is_spark_s(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(-2, 2, 2_000), (rng.integers(-(10**7), 10**7, 3_000) + 0.5) / 10**6, rng.uniform(-1e9, 1e9, 500), [0.0, -0.0, 1e-300, 1e300, 2.5e-6, -5e-7]])
    df = spark.createDataFrame([(i, float(y)) for i, y in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("r"))
    assert nearest.rounded(x).tolist() == [r.r for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("name", ["jn_06", "jn_14", "cur_10", "cur_11", "dup_08", "ret_04", "ret_05", "ret_06", "ret_07", "ret_08", "ret_09", "win_05", "win_06", "top_04", "flt_03"])
def test_no_row_for_each_pair(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan or name == "ret_06"
    assert "NOT (vec_id" not in plan


def test_limits(spark):
    v = spark.createDataFrame([], "id long, v array<float>")
    q = v.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    assert nearest.nearest_rows(v, q, 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        nearest.nearest_rows(v, q, 0)
    with pytest.raises(ValueError, match="measure"):
        nearest.nearest_rows(v, q, 1, "other")
