"""Pairs of vectors above a cosine, without a join of all with all.

On unit vectors cosine >= c is distance <= r = sqrt(2 - 2c). Each point is in the cell of its nearest pivot, and cells are cut by
hash into blocks of bounded size. A point at distance d from a pivot can only be near points of that pivot's cell if d lies within
r of the cell's least and largest distance; it is sent to those pairs of blocks alone. A pair of blocks is one task,
which multiplies them and gives out what reaches the threshold. A short table is one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize, sized, small_batches

#: Rows of a sample that pivots are made from, pivots of one group, and what all groups of a pass may have.
SAMPLE_ROWS, PIVOTS, CELLS = 8_192, 256, 16_384
_EPS = 1e-9
_STEP = 1 << 21


def matrix(column) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (unit @ pivots.T), 0))


def farthest(unit: np.ndarray, most: int) -> np.ndarray:
    """Pivots by farthest-first traversal."""
    chosen, gap = [0], distances(unit, unit[:1])[:, 0]
    while len(chosen) < min(most, len(unit)) and gap.max() > _EPS:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(unit, unit[chosen[-1:]])[:, 0])
    return unit[chosen]


def _work(cosine: float, digits: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of a task: of its two blocks, or within one."""
        table = table.sort_by("id")
        v, ids = matrix(table["v"]), table["id"].combine_chunks()
        norm = np.sqrt((v * v).sum(axis=1))
        second = table["second"].to_numpy(zero_copy_only=False).astype(bool)
        task = table["task"][0].as_py()
        within = task >> 32 == task & 0xFFFFFFFF
        a = np.arange(len(v)) if within else np.flatnonzero(~second)
        b = a if within else np.flatnonzero(second)
        left, right, sims = [], [], []
        step = max(1, _STEP // max(1, len(b)))
        for at in range(0, len(a) if len(b) else 0, step):
            rows = a[at : at + step]
            s = np.round(np.clip(v[rows] @ v[b].T / (norm[rows][:, None] * norm[b]), -1, 1), digits)
            x, y = np.nonzero(s >= cosine)
            if within:
                keep = rows[x] < b[y]
                x, y = x[keep], y[keep]
            left.append(np.minimum(rows[x], b[y]))
            right.append(np.maximum(rows[x], b[y]))
            sims.append(s[x, y])
        x, y, s = (np.concatenate(z) if z else np.zeros(0, t) for z, t in ((left, np.int64), (right, np.int64), (sims, float)))
        # sorted by id, so the lesser place has the lesser id; equal ids are no pair
        out = pa.table({"a": ids.take(pa.array(x)), "b": ids.take(pa.array(y)), "s": s})
        return out.filter(pc.not_equal(out["a"], out["b"]))

    return run


def vector_pairs(vectors: DataFrame, cosine: float, key: str = "vec_id", embedding: str = "embedding", group: str | None = None, digits: int = 9, block: int = 4_096) -> DataFrame:
    """(a, b, s), a < b, of rows whose cosine, rounded to so many digits, is at least `cosine` (above -1); with group, of one group only.

    Null, empty and zero vectors, those with null or non-finite components, null ids and null groups are in no pair, nor are vectors of
    different lengths. Equal ids are no pair. The result is as long as there are pairs: the caller states a threshold that few reach.
    """
    small_batches(vectors.sparkSession)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = F.col(f"`{group}`") if group else F.lit(0)
    rows = vectors.select(F.col(key).alias("id"), own.alias("group"), F.col(embedding).alias("v"), F.size(embedding).alias("width"))
    rows = rows.where(F.col("id").isNotNull() & F.col("group").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = materialize(rows, "vectors")
    sizes = materialize(rows.groupBy("group", "width").agg(F.count("*").alias("n")), "sizes")
    large = materialize(sizes.where(F.col("n") > block), "large")
    some = large.count() > 0
    small = rows.join(sized(large.select("group", "width")), ["group", "width"], "left_anti") if some else rows
    # a group of one block: each has a task of its own
    tasks = small.select("group", "width", F.lit(0).cast("long").alias("task"), F.lit(False).alias("second"), "id", "v")
    if some:
        tasks = tasks.unionByName(_sent(rows, large, float(np.sqrt(max(0.0, 2 - 2 * (cosine - 10.0**-digits)))), block))
    kind = rows.schema["id"].dataType.simpleString()
    return tasks.groupBy("group", "width", "task").applyInArrow(_work(cosine, digits), f"a {kind}, b {kind}, s double")


def _sent(rows: DataFrame, large: DataFrame, r: float, block: int) -> DataFrame:
    """Rows of large groups, once for each task that they take part in; groups are dealt to passes of bounded pivots."""
    total = large.agg(F.sum(F.least(F.lit(PIVOTS), F.ceil(F.col("n") / block) * 4))).first()[0]
    passes = max(1, -(-total // CELLS))
    out = None
    for k in range(passes):
        these = large if passes == 1 else large.where(F.pmod(F.xxhash64("group", "width"), F.lit(passes)) == k)
        part = _pass(rows.join(sized(these), ["group", "width"]), r, block)
        out = part if out is None else out.unionByName(part)
    return out


def _pass(own: DataFrame, r: float, block: int) -> DataFrame:
    spark = own.sparkSession
    most = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / block) * 4)
    wanted = F.least(F.lit(SAMPLE_ROWS), most * 32)
    sample = own.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < wanted / F.col("n") * (1 << 30)).select("group", "width", most.alias("most"), "v")

    def choose(table: pa.Table) -> pa.Table:
        found = farthest(units(matrix(table["v"])), table["most"][0].as_py())
        first = pa.array([0] * len(found))
        return pa.table({"group": table["group"].take(first), "width": table["width"].take(first), "p": pa.array(found.tolist(), pa.list_(pa.float64()))})

    kind = own.schema["group"].dataType.simpleString()
    picked = sample.groupBy("group", "width").applyInArrow(choose, f"`group` {kind}, width int, p array<double>").toArrow()
    pivots: dict[tuple, list] = {}
    for g, w, p in zip(*(picked[c].to_pylist() for c in ("group", "width", "p")), strict=True):
        pivots.setdefault((g, w), []).append(p)
    sent = spark.sparkContext.broadcast({k: np.array(v) for k, v in pivots.items()})

    def near(batch, at):
        """Rows of each group of a batch with their distances to its pivots."""
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            groups.setdefault(key, []).append(i)
        for key, rows in groups.items():
            rows = np.array(rows)
            unit = units(matrix(batch.column(at).take(pa.array(rows))))
            # a group of whose rows none was drawn is one cell
            yield key, rows, distances(unit, sent.value[key]) if key in sent.value else np.zeros((len(rows), 1))

    def place(batches):
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for _, rows, gap in near(batch, 3):
                cell[rows], far[rows] = gap.argmin(axis=1), gap.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    names = {f.name: f.dataType.simpleString() for f in own.schema}
    fields = f"`group` {kind}, width int, id {names['id']}, v {names['v']}"
    placed = materialize(own.select("group", "width", "id", "v").mapInArrow(place, f"{fields}, cell int, far double"), "placed")
    leaves = placed.groupBy("group", "width", "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    # as many as a pass has pivots at most
    index: dict[tuple, dict[str, list]] = {}
    for x in leaves.orderBy("group", "width", "cell").toArrow().to_pylist():
        held = index.setdefault((x["group"], x["width"]), {c: [] for c in ("cell", "low", "high", "base", "blocks")})
        base = held["base"][-1] + held["blocks"][-1] if held["base"] else 0
        for c, value in (("cell", x["cell"]), ("low", x["low"]), ("high", x["high"]), ("base", base), ("blocks", -(-x["n"] // block))):
            held[c].append(value)
    told = spark.sparkContext.broadcast({k: {c: np.array(v) for c, v in x.items()} for k, x in index.items()})

    def visit(batches):
        for batch in batches:
            cells, salt = batch.column(4).to_numpy(), batch.column(6).to_numpy()
            for key, rows, gap in near(batch, 3):
                leaf = told.value[key]
                mine = np.searchsorted(leaf["cell"], cells[rows])
                far = gap[:, leaf["cell"]]
                reach = (far >= leaf["low"] - r - _EPS) & (far <= leaf["high"] + r + _EPS)
                reach[np.arange(len(rows)), mine] = True
                x, other = np.nonzero(reach)
                n = leaf["blocks"][other]
                own_block = leaf["base"][mine] + salt[rows] % leaf["blocks"][mine]
                x, other = np.repeat(x, n), np.repeat(leaf["base"][other], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                # block numbers from 1, as task 0 is that of small groups
                a, b = np.minimum(own_block[x], other) + 1, np.maximum(own_block[x], other) + 1
                for at in range(0, len(x), 4096):
                    part = slice(at, at + 4096)
                    at_rows = pa.array(rows[x[part]])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at_rows), batch.column(1).take(at_rows), pa.array(a[part] << 32 | b[part]), pa.array(own_block[x[part]] + 1 > a[part]), batch.column(2).take(at_rows), batch.column(3).take(at_rows)], ["group", "width", "task", "second", "id", "v"])

    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    return salted.mapInArrow(visit, f"`group` {kind}, width int, task long, second boolean, id {names['id']}, v {names['v']}")
