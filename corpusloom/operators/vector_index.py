"""A persisted vector index: inverted lists of a k-means coarse quantiser, with exact search by distance bounds.

Centres are made from a bounded sample; every row goes to the list of its nearest centre and is stored with its distance to it,
lists as partitions of the folder. Search takes queries in blocks of bounded size. It first scores the lists nearest to each query,
which bounds the distance of its k-th hit; a list then matters only if its nearest shell may hold something closer, and
in it, sorted by distance, only rows whose own distance to the centre differs from the query's by no more than that bound
(triangle inequality). The answer is that of a scan, whatever the centres are.

Metrics: cosine (distances between unit vectors) and l2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.metric_pairs import matrix, units
from corpusloom.session import materialize, sized, small_batches

#: Rows of the sample that centres are made from, and queries of one block.
SAMPLE_ROWS, BLOCK = 16_384, 5_000
_SLACK = 1e-5


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows of the sample; an empty one stays where it was."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        of = _gaps(points, centres).argmin(axis=1)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


class VectorIndex:
    """Index of vectors of one length in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine"):
        if metric not in ("cosine", "l2"):
            raise ValueError("metric: cosine or l2")
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric
        #: Rows scored by the last search, summed over queries, and what a scan would have scored.
        self.scored = self.whole = 0

    def _exists(self, name: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(conf).exists(place)

    def _centres(self) -> np.ndarray:
        table = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").toArrow()
        return matrix(table["c"])

    def _usable(self, v: str = "v"):
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return F.coalesce(finite & (F.exists(v, lambda x: x != 0) if self.metric == "cosine" else F.size(v) > 0), F.lit(False))

    def build(self, vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", lists: int | None = None) -> int:
        """Make centres and add all vectors; how many lists there are. By default about the root of the number of rows, 4,096 at most.

        Null vectors, those with null or non-finite components and, for cosine, zero vectors are left out.
        """
        rows = vectors.select(F.col(embedding).alias("v")).where(self._usable())
        n = rows.count()
        lists = lists or max(1, min(4096, int(n**0.5)))
        want = min(SAMPLE_ROWS, max(256, 64 * lists))
        # a bounded sample: the expected number is `want`
        sample = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, want / max(n, 1)) * (1 << 30))).limit(2 * want).toArrow()
        points = matrix(sample["v"]) if len(sample) else np.zeros((0, 1))
        if len(points):
            centres = kmeans(units(points) if self.metric == "cosine" else points, lists)
            self.spark.createDataFrame(pa.table({"list": pa.array(range(len(centres)), pa.int32()), "c": pa.array(centres.tolist(), pa.list_(pa.float64()))})).write.parquet(f"{self.path}/centres")
            self.append(vectors, key, embedding)
        return len(points) and len(centres)

    def append(self, vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> None:
        """Add vectors to the lists of the centres there are."""
        small_batches(self.spark)
        rows = vectors.select(F.col(key).alias("id"), F.col(embedding).alias("v")).where(self._usable())
        sent, unit = self.spark.sparkContext.broadcast(self._centres()), self.metric == "cosine"

        def assign(batches):
            for batch in batches:
                x = matrix(batch.column(1))
                gap = _gaps(units(x) if unit and len(x) else x.reshape(len(x), -1), sent.value) if len(x) else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gap.argmin(axis=1).astype(np.int32)), pa.array(gap.min(axis=1) if len(x) else np.zeros(0))], ["id", "v", "list", "far"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        placed = rows.mapInArrow(assign, f"id {kinds['id']}, v {kinds['v']}, list int, far double")
        # ranges of (list, far): a list of a third of all rows is cut into several files
        cut = placed.repartitionByRange("list", "far").sortWithinPartitions("list", "far")
        cut.write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")

    def delete(self, ids: DataFrame, key: str = "vec_id") -> None:
        """Take vectors out by id; searches pass over them."""
        ids.select(F.col(key).alias("id")).distinct().write.mode("append").parquet(f"{self.path}/gone")

    def live(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/lists")
        if self._exists("gone"):
            rows = rows.join(sized(self.spark.read.parquet(f"{self.path}/gone").distinct()), "id", "left_anti")
        return rows

    def search(self, queries: DataFrame, k: int = 10, key: str = "vec_id", embedding: str = "embedding", probes: int = 2, block: int = BLOCK, own: bool = False) -> DataFrame:
        """(query_id, id, score) of each query's best k rows; own: a row of the query's own id counts too. score is the cosine, or the
        distance with its sign turned, rounded to 6 digits; ties by id."""
        asked = queries.select(F.col(key).alias("query_id"), F.col(embedding).alias("v")).where(self._usable())
        kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
        out = self.spark.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['query_id']}, score double")
        if k <= 0:
            raise ValueError("limit must be positive")
        if not self._exists("lists"):
            return out
        blocks = max(1, -(-asked.count() // block))
        live, self._counter = self.live(), self.spark.sparkContext.accumulator(0)
        shells = {r.list: (r.low, r.high, r.n) for r in live.groupBy("list").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect()}
        self.whole, parts = 0, []
        for i in range(blocks):
            some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            # no more than about a block of queries
            table = some.toArrow()
            if len(table):
                self.whole += len(table) * sum(n for _, _, n in shells.values())
                parts.append(self._block(live, table, shells, k, probes, own, kinds["query_id"]))
        for part in parts:
            out = out.unionByName(part)
        self.scored = self._counter.value
        return out

    def _block(self, live: DataFrame, table: pa.Table, shells: dict, k: int, probes: int, own: bool, kind: str) -> DataFrame:
        raw = matrix(table["v"])
        q = units(raw) if self.metric == "cosine" else raw
        gap = _gaps(q, self._centres())
        held = np.array(sorted(shells))
        low, high = (np.array([shells[c][j] for c in held.tolist()]) for j in (0, 1))
        # a distance to a list's nearest member at least
        least = np.maximum(np.maximum(gap[:, held] - high, low - gap[:, held]), 0)
        first = np.argsort(np.where(np.isfinite(least), gap[:, held], np.inf), axis=1)[:, :probes]
        wanted = {c: np.flatnonzero((first == j).any(axis=1)) for j, c in enumerate(held.tolist())}
        ids = table["query_id"].combine_chunks()
        near = self._near(live, ids, q, gap, {c: x for c, x in wanted.items() if len(x)}, np.full(len(q), np.inf), k, own, kind)
        nth = Window.partitionBy("nr").orderBy("d", "id")
        best = materialize(near.withColumn("r", F.row_number().over(nth)).where(F.col("r") <= k), "near")
        bound = np.full(len(q), np.inf)
        for r in best.where(F.col("r") == k).select("nr", "d").collect():
            bound[r.nr] = r.d + _SLACK
        done = {c: set(x.tolist()) for c, x in wanted.items()}
        rest = {}
        for j, c in enumerate(held.tolist()):
            open_ = [x for x in np.flatnonzero(least[:, j] <= bound).tolist() if x not in done[c]]
            if open_:
                rest[c] = np.array(open_)
        found = best.drop("r")
        if rest:
            found = found.unionByName(self._near(live, ids, q, gap, rest, bound, k, own, kind))
        score = F.round(1 - F.col("d") * F.col("d") / 2, 6) if self.metric == "cosine" else -F.round("d", 6)
        # what ties after rounding is kept, the id decides; scores of hits alone are made again from the vectors
        hits = found.withColumn("s", score).withColumn("r", F.rank().over(Window.partitionBy("nr").orderBy(F.desc("s")))).where(F.col("r") <= k)
        told = hits.select(F.col("query").alias("query_id"), "id", F.col("s").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return told.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")

    def _near(self, live: DataFrame, ids: pa.Array, q: np.ndarray, gap: np.ndarray, wanted: dict, bound: np.ndarray, k: int, own: bool, kind: str) -> DataFrame:
        """(nr, query, id, d): of the lists each query wants, a batch's nearest rows, k and ties."""
        sent = self.spark.sparkContext.broadcast((ids, q, gap, wanted, bound))
        unit, counter = self.metric == "cosine", self._counter

        def run(batches):
            ids, q, gap, wanted, bound = sent.value
            names = ids.to_pylist()
            for batch in batches:
                lists, far = batch.column(3).to_numpy(), batch.column(2).to_numpy()
                row_ids = batch.column(0)
                nr, at, dist = [], [], []
                for c in np.unique(lists).tolist():
                    rows = np.flatnonzero(lists == c)
                    rows = rows[np.argsort(far[rows], kind="stable")]
                    x = matrix(batch.column(1).take(pa.array(rows)))
                    x = units(x) if unit else x
                    mine = row_ids.take(pa.array(rows)).to_pylist()
                    for i in wanted[c].tolist():
                        # rows whose distance to the centre differs from the query's by the bound at most
                        a = int(np.searchsorted(far[rows], gap[i, c] - bound[i], "left"))
                        b = int(np.searchsorted(far[rows], gap[i, c] + bound[i], "right"))
                        if a >= b:
                            continue
                        counter.add(int(b - a))
                        d = np.sqrt(np.maximum(((x[a:b] - q[i]) ** 2).sum(axis=1), 0))
                        if not own:
                            d[np.array(mine[a:b], object) == names[i]] = np.inf
                        if len(d) > k:
                            keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + _SLACK)
                        else:
                            keep = np.arange(len(d))
                        keep = keep[np.isfinite(d[keep])]
                        nr += [i] * len(keep)
                        at.append(rows[a + keep])
                        dist.append(d[keep])
                if nr:
                    yield pa.RecordBatch.from_arrays([pa.array(nr, pa.int32()), ids.take(pa.array(nr)), row_ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(dist))], ["nr", "query", "id", "d"])

        rows = live.where(F.col("list").isin(*wanted)) if wanted else live.limit(0)
        id_kind = live.schema["id"].dataType.simpleString()
        return rows.select("id", "v", "far", "list").mapInArrow(run, f"nr int, query {kind}, id {id_kind}, d double")
