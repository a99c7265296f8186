"""Exact cosine links between embeddings of one label, by dual traversal of cover trees.

On unit vectors cosine >= c is Euclidean distance <= sqrt(2 - 2c), a metric, so covering radii bound all pairs below two
tree nodes. Equal vectors are one weighted point. A label of up to `block` points is one task. A larger one gets a top
level: centres that cover a bounded sample, and every point goes to its nearest. A cell is cut into rings as wide as the
threshold, each with its measured least and largest distance from the centre, and large rings by hash into blocks. A point
is sent to the tasks of those pairs of blocks alone that its own distances to both centres leave open, so cells that are
far apart never meet. A task builds the two cover trees of a pair of blocks and walks them together: node pairs too far
apart are pruned, node pairs that surely link are counted whole, the rest go down a level, and points are tested exactly.
Tasks return a count and one link per point, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.llm.rows import numbered, sized
from corpusloom.plans.components import connected_components
from corpusloom.session import materialize

_EPS = 1e-9
#: Levels of a tree: covering radii 2, 1, 1/2 ... and then single points.
_LEVELS = 8
_DENSE = 1 << 22


#: Rows and bytes of the sample that a label's top level is made from, and its centres at most.
SAMPLE_ROWS, SAMPLE_BYTES, CENTRES = 16_384, 64 << 20, 512
#: Centres of all labels that are told to the tasks at once; more labels are several passes.
CELLS = 16_384


def _width(column: pa.Array) -> dict[str, pa.Array]:
    return {"width": pa.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32))}


def usable(v: Column) -> Column:
    """Whether a vector has components, all finite and some not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(column: pa.Array) -> np.ndarray:
    """Rows of doubles, each times the power of two that brings its largest component to [0.5, 1): exact, and no square
    under- or overflows."""
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


class CoverTree:
    """Nested levels of a point set. Level k: centres (points), their real covering radii, and their ranges in level k + 1."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.unit, self.centre, self.radius, self.child, self.points = unit, [], [], [], []
        groups = [np.arange(n)]
        radius = 2.0
        for level in range(_LEVELS):
            centres, parts = [], []
            counts = []
            for group in groups:
                split = [(int(group[0]), group)] if level == 0 else self._cover(group, radius)
                centres += [c for c, _ in split]
                parts += [p for _, p in split]
                counts.append(len(split))
            if level:
                self.child.append(np.concatenate([[0], np.cumsum(counts)]))
            self._level(centres, parts)
            groups, radius = parts, radius / 2
            if all(len(p) == 1 for p in parts):
                break
        else:
            self.child.append(np.concatenate([[0], np.cumsum([len(p) for p in groups])]))
            flat = np.concatenate(groups)
            self._level(flat.tolist(), [np.array([x]) for x in flat])

    def _level(self, centres: list[int], parts: list[np.ndarray]) -> None:
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        flat = np.concatenate(parts)
        own = np.repeat(np.array(centres), np.diff(at))
        far = np.sqrt(((self.unit[flat] - self.unit[own]) ** 2).sum(axis=1))
        self.centre.append(np.array(centres))
        self.radius.append(np.maximum.reduceat(far, at[:-1]))
        self.points.append((flat, at))

    def _cover(self, group: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        """Greedy centres, each with the group's points within the radius that no earlier one took."""
        out = []
        while len(group):
            if len(group) == 1:
                out.append((int(group[0]), group))
                break
            gap = self.unit[group] - self.unit[group[0]]
            near = np.einsum("ij,ij->i", gap, gap) <= radius * radius
            out.append((int(group[0]), group[near]))
            group = group[~near]
        return out

    def below(self, level: int, node: int) -> np.ndarray:
        flat, at = self.points[level]
        return flat[at[node] : at[node + 1]]


def _near(gap: np.ndarray, ra: np.ndarray, rb: np.ndarray, limit: float) -> np.ndarray:
    return gap - ra - rb <= limit + _EPS


def _below(a: CoverTree, b: CoverTree, la: int, lb: int, i: np.ndarray, j: np.ndarray, limit: float):
    """Child pairs of node pairs that the radii leave open, with centre distances, in parts of bounded size."""
    ends = []
    for tree, level, node in ((a, la, i), (b, lb, j)):
        if level == len(tree.centre) - 1:
            ends.append((level, node, np.ones(len(node), np.int64)))
        else:
            ends.append((level + 1, tree.child[level][node], np.diff(tree.child[level])[node]))
    (na, fa, ca), (nb, fb, cb) = ends
    ua, ub = a.unit[a.centre[na]], b.unit[b.centre[nb]]
    size = ca * cb
    for k in np.flatnonzero(size > _DENSE // 16).tolist():
        # two nodes with many children: distances from a matrix product, and only what stays open is listed
        step, right = max(1, _DENSE // int(cb[k])), slice(fb[k], fb[k] + cb[k])
        for x in range(int(fa[k]), int(fa[k] + ca[k]), step):
            left = slice(x, min(x + step, int(fa[k] + ca[k])))
            gap = np.sqrt(np.maximum(2 - 2 * (ua[left] @ ub[right].T), 0))
            p, q = np.nonzero(_near(gap, a.radius[na][left, None], b.radius[nb][None, right], limit))
            yield na, nb, p + x, q + fb[k], gap[p, q]
    small = np.flatnonzero(size <= _DENSE // 16)
    part = np.cumsum(size[small]) // (_DENSE // 8)
    for k in np.split(small, np.flatnonzero(np.diff(part)) + 1) if len(small) else []:
        of = np.repeat(k, size[k])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
        p, q = fa[of] + nth // cb[of], fb[of] + nth % cb[of]
        gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", ua[p], ub[q]), 0))
        open_ = _near(gap, a.radius[na][p], b.radius[nb][q], limit)
        yield na, nb, p[open_], q[open_], gap[open_]


def dual_links(a: CoverTree, b: CoverTree, vectors_a: np.ndarray, vectors_b: np.ndarray, cosine: float):
    """(x, y, whole): arrays of points that link, pair by pair, or with whole each of x with each of y.

    Each linking pair of points is in exactly one. With a is b, pairs come in both orders and points with themselves.
    """
    limit = np.sqrt(2 - 2 * cosine)
    norm_a, norm_b = np.sqrt((vectors_a * vectors_a).sum(axis=1)), np.sqrt((vectors_b * vectors_b).sum(axis=1))
    root = np.zeros(1, np.int64)
    # depth first, so what is under way stays small
    todo = [(0, 0, root, root, np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.unit[a.centre[0]], b.unit[b.centre[0]]), 0)))]
    while todo:
        la, lb, i, j, gap = todo.pop()
        whole = gap + a.radius[la][i] + b.radius[lb][j] <= limit - _EPS
        if la == len(a.centre) - 1 and lb == len(b.centre) - 1:
            x, y = a.centre[la][i], b.centre[lb][j]
            hit = whole | (np.einsum("ij,ij->i", vectors_a[x], vectors_b[y]) / (norm_a[x] * norm_b[y]) >= cosine)
            yield x[hit], y[hit], False
            continue
        for x, y in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
            yield a.below(la, x), b.below(lb, y), True
        if not whole.all():
            todo += _below(a, b, la, lb, i[~whole], j[~whole], limit)


class _Groups:
    """Least point of each group under joins of many pairs at once."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
            p, q = self.up[x], self.up[y]
            apart = p != q
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(p, q)[apart], np.minimum(p, q)[apart])


def task_links(vectors: np.ndarray, weight: np.ndarray, second: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point: weight of the points that it links with across the two sides (or within, if second is all False); the
    least point of its local group."""
    n = len(vectors)
    unit = units(vectors)
    add, groups = np.zeros(n, np.int64), _Groups(n)
    a, b = np.flatnonzero(~second), np.flatnonzero(second)
    same = not len(b)
    if not len(a):
        return add, np.arange(n)
    ta = CoverTree(unit[a])
    tb, b = (ta, a) if same else (CoverTree(unit[b]), b)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for x, y, whole in dual_links(ta, tb, vectors[a], vectors[b], cosine):
        x, y = a[x], b[y]
        if whole:
            add[x] += weight[y].sum()
            if not same:
                add[y] += weight[x].sum()
            kept += [(x, np.repeat(x[:1], len(x))), (y, np.repeat(x[:1], len(y)))]
        else:
            np.add.at(add, x, weight[y])
            if not same:
                np.add.at(add, y, weight[x])
            kept.append((x, y))
        if sum(len(p) for p, _ in kept[-1:]) > _DENSE or len(kept) >= 4096:
            groups.join(*(np.concatenate(z) for z in zip(*kept, strict=True)))
            kept = []
    if kept:
        groups.join(*(np.concatenate(z) for z in zip(*kept, strict=True)))
    if same:
        add -= weight  # every point met itself
    return add, groups.up


def net(unit: np.ndarray, most: int) -> np.ndarray:
    """Centres of the finest cover of some points with at most so many, radii halving; else the first of the coarsest."""
    best = unit[:1]
    for radius in (1.0, 0.5, 0.25, 0.125):
        centres, rest = [], np.arange(len(unit))
        while len(rest) and len(centres) <= most:
            centres.append(rest[0])
            gap = unit[rest] - unit[rest[0]]
            rest = rest[np.einsum("ij,ij->i", gap, gap) > radius * radius]
        if len(centres) > most:
            return best if len(best) > most // 2 else unit[np.array(centres[:most])]
        best = unit[np.array(centres)]
    return best


def _centres(own: DataFrame, most: int, block: int) -> dict[tuple, np.ndarray]:
    """Centres by (label, width), each label's from a sample of its own rows, made in a task a label."""
    cells = F.least(F.lit(CENTRES), F.ceil(F.col("n") / block))
    wanted = F.least(F.lit(most), F.greatest(F.lit(64), 32 * cells))
    some = own.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < wanted / F.col("n") * (1 << 30)).select("label", "width", "n", "v")

    def run(table: pa.Table) -> pa.Table:
        # the expected number of rows is `most` or less
        found = net(units(scaled(table["v"])), min(CENTRES, -(-table["n"][0].as_py() // block)))
        return pa.table({"label": table["label"].slice(0, 1).take(pa.array([0] * len(found))), "width": table["width"].take(pa.array([0] * len(found))), "c": pa.array(found.tolist(), pa.list_(pa.float64()))})

    kind = own.schema["label"].dataType.simpleString()
    picked = some.groupBy("label", "width").applyInArrow(run, f"label {kind}, width int, c array<double>").toArrow()
    at: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(picked["label"].to_pylist(), picked["width"].to_pylist(), strict=True)):
        at.setdefault(key, []).append(i)
    return {key: np.array(picked["c"].take(pa.array(rows)).to_pylist()) for key, rows in at.items()}


def _leaves(points: DataFrame, large: DataFrame, sample_rows: int, block: int, wide: float, limit: float, cells: int = CELLS) -> DataFrame:
    """Rows (task, second, node, v, copies) of the points of large labels, one for each task that they take part in.

    Labels are dealt by hash to as many passes as keep what is told to the tasks bounded: each point is in one pass.
    """
    total, width = large.agg(F.sum(F.least(F.lit(CENTRES), F.ceil(F.col("n") / block))), F.max("width")).first()
    passes = max(1, -(-total // max(1, min(cells, SAMPLE_BYTES // (8 * width)))))
    most = min(sample_rows, max(64, SAMPLE_BYTES // (8 * width)))
    out = None
    for k in range(passes):
        these = large if passes == 1 else large.where(F.pmod(F.xxhash64("label", "width"), F.lit(passes)) == k)
        part = _pass(points.join(sized(these), ["label", "width"]), most, block, wide, limit, k)
        out = part if out is None else out.unionByName(part)
    return out


def _pass(own: DataFrame, most: int, block: int, wide: float, limit: float, nth: int) -> DataFrame:
    """_leaves() of some labels; the numbers of their tasks begin with that of the pass."""
    spark, points = own.sparkSession, own
    sent = spark.sparkContext.broadcast(_centres(own, most, block))
    kind = points.schema["label"].dataType.simpleString()
    fields = f"label {kind}, width int, node long, copies long, v {points.schema['v'].dataType.simpleString()}, cell int, ring int, far double"

    def groups(batch):
        """Rows of each (label, width) of a batch, with their distances to its centres."""
        at: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            at.setdefault(key, []).append(i)
        for key, rows in at.items():
            rows = np.array(rows)
            pivots = sent.value.get(key)
            if pivots is None:
                yield key, rows, np.zeros((len(rows), 1))
            else:
                yield key, rows, np.sqrt(np.maximum(2 - 2 * (units(scaled(batch.column(4).take(pa.array(rows)))) @ pivots.T), 0))

    def assign(batches):
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for _, rows, gap in groups(batch):
                cell[rows], far[rows] = gap.argmin(axis=1), gap.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array((far // wide).astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "ring", "far"])

    placed = materialize(own.select("label", "width", "node", "copies", "v").mapInArrow(textops.lean(assign), fields), "placed")
    leaves = placed.groupBy("label", "width", "cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    # no more rows than a pass has centres, times rings
    leaves = leaves.orderBy("label", "width", "cell", "ring").toArrow().to_pylist()
    # a pass numbers its blocks from a place of its own
    index, base = {}, nth << 24
    for x in leaves:
        x["base"], x["blocks"] = base, -(-x["n"] // block)
        base += x["blocks"]
        index.setdefault((x["label"], x["width"]), []).append(x)
    index = {key: ({(x["cell"], x["ring"]): k for k, x in enumerate(own)}, {c: np.array([x[c] for x in own]) for c in ("cell", "low", "high", "base", "blocks")}) for key, own in index.items()}
    told = spark.sparkContext.broadcast(index)

    def visit(batches):
        for batch in batches:
            parts = []
            block_of = textops.mix(batch.column(2).to_numpy().astype(np.uint64))
            cells, rings = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            for key, rows, gap in groups(batch):
                where, leaf = told.value[key]
                mine = np.array([where[x] for x in zip(cells[rows].tolist(), rings[rows].tolist(), strict=True)])
                far = gap[:, leaf["cell"]]
                reach = (far >= leaf["low"] - limit - _EPS) & (far <= leaf["high"] + limit + _EPS)
                reach[np.arange(len(rows)), mine] = True
                x, other = np.nonzero(reach)
                n = leaf["blocks"][other]
                own_block = leaf["base"][mine] + (block_of[rows] % leaf["blocks"][mine].astype(np.uint64)).astype(np.int64)
                x, other = np.repeat(x, n), np.repeat(leaf["base"][other], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                parts.append((rows[x], np.minimum(own_block[x], other) << 32 | np.maximum(own_block[x], other), own_block[x] > other))
            of, task, second = (np.concatenate(z) for z in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            for at in range(0, len(of), 4096):
                rows = pa.array(of[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(task[at : at + 4096]), pa.array(second[at : at + 4096].astype(bool)), *(batch.column(k).take(rows) for k in (2, 4, 3))], ["task", "second", "node", "v", "copies"])

    return placed.mapInArrow(textops.lean(visit), f"task long, second boolean, node long, v {points.schema['v'].dataType.simpleString()}, copies long")


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93, block: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """row (a struct of all columns), n_links, component_id, kept for each row of vectors.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at least
    `cosine`. n_links counts other rows, equal ones too; component_id is the smallest id that links reach, kept says that
    it is the row's own. Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. A null id counts in n_links; it is no component's id unless all are null (kept then).

    block: points that one side of a task holds; by default what 8 MB of doubles hold. sample_rows bounds the sample of
    each large label; it shapes the top level only, every point is placed and every link found.
    """
    rows = numbered(vectors, embedding, _width, "width int")
    good = rows.where(usable(F.col(f"row.`{embedding}`"))).select("rid", F.col(f"row.`{label}`").alias("label"), "width", F.col(f"row.`{embedding}`").alias("v"), F.col(f"row.`{vec_id}`").alias("id")).where("label IS NOT NULL")
    points = materialize(good.groupBy("label", "width", "v").agg(F.min("rid").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies")), "points")
    if block is None:
        block = max(1024, min(16_384, (8 << 20) // (8 * (points.agg(F.max("width")).first()[0] or 1))))
    # rings are a little wider than the threshold
    limit = float(np.sqrt(2 - 2 * cosine))
    sizes = points.groupBy("label", "width").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > block), "large")
    small = points.join(sized(large.select("label", "width")), ["label", "width"], "left_anti")

    def work(table: pa.Table) -> pa.Table:
        # one small label, or one pair of blocks: bounded by the block size
        table = table.sort_by("node")
        node = table["node"].to_numpy()
        second = table["second"].to_numpy(zero_copy_only=False).astype(bool) if "second" in table.column_names else np.zeros(len(node), bool)
        # an edge of two blocks that only one side's points come near
        add, top = (np.zeros(len(node), np.int64), np.arange(len(node))) if "task" in table.column_names and second.any() == second.all() and (table["task"][0].as_py() >> 32 != table["task"][0].as_py() & 0xFFFFFFFF) else task_links(scaled(table["v"]), table["copies"].to_numpy(), second, cosine)
        some = add > 0
        return pa.table({"node": node[some], "added": add[some], "link": node[top][some]})

    found = small.select("label", "width", "node", "v", "copies").groupBy("label", "width").applyInArrow(work, "node long, added long, link long")
    if large.limit(1).count():
        sent = _leaves(points, large, sample_rows, block, limit * (1 + 1e-6), limit)
        found = found.unionByName(sent.groupBy("task").applyInArrow(work, "node long, added long, link long"))
    found = materialize(found, "links")
    components = connected_components(found.where("node != link").select(F.col("node").alias("a"), F.col("link").alias("b")))
    counts = found.groupBy("node").agg(F.sum("added").alias("added"))
    # numbers alone until the component is known; what is joined to is written first, so a hot component can be split
    joined = points.select("node", "least", "copies").join(counts, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = materialize(joined.where("copies > 1 OR added > 0"), "joined")
    least = materialize(joined.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    told = materialize(joined.join(sized(least), "component").select("node", (F.col("copies") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"), "component_id"), "told")
    told = materialize(points.select("label", "width", "v", "node").join(sized(told), "node").drop("node"), "told")
    linked = materialize(good.select("rid", "label", "width", "v").join(told, ["label", "width", "v"]).select("rid", "n_links", "component_id"), "linked")
    out = rows.select("row", "rid").join(sized(linked), "rid", "left")
    own = F.col(f"row.`{vec_id}`")
    component = F.when(F.col("n_links").isNull(), own).otherwise(F.col("component_id"))
    return out.select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), own.eqNullSafe(component).alias("kept"))


#: The contract of op2 for DuckDB.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp ON comp.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
