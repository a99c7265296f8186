"""Topics: clustering over threshold graphs, hierarchy, labels and continuity.

Both clusterings look sequential, but no merge crosses a connected component of the graph of pairs at the threshold, and
order within one is kept. So pairs are found by a join, components by label propagation, and each is folded on its own.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.registry import query
from corpusloom.operators.relational_queries import _VEC, mean_vectors
from corpusloom.operators.scalar_queries import cosine
from corpusloom.plans.components import connected_components
from corpusloom.plans.metric_pairs import vector_pairs
from corpusloom.session import drop_scratch, materialize, sized

# Similarity that joins two documents, and that of a parent cluster.
THRESHOLD, PARENT_THRESHOLD = 0.52, 0.65
#: What the queries use instead, as the vectors of the test tables are nearly orthogonal (see FIXTURES.md).
FIXTURE_THRESHOLD, FIXTURE_PARENT = 0.3, 0.05


def complete_linkage(ids: list[int], similarity: dict[tuple[int, int], float], threshold: float) -> list[list[int]]:
    """Merge the most similar pair of groups (by least member similarity; the highest left, then right index of ties) until none
    reaches the threshold. Pairs that are not given are below it.

    Groups keep their neighbours that all members are near; those of a merged group are the ones that both had. The best pair
    comes from a heap, whose entries are checked when they come up, so work follows the pairs and not their square.
    """
    groups = {i: [i] for i in ids}
    near: dict[int, dict[int, float]] = {i: {} for i in ids}
    for (a, b), s in similarity.items():
        if s >= threshold:
            near[a][b] = near[b][a] = s
    heap = [(-s, -a, -b) for (a, b), s in similarity.items() if s >= threshold]
    heapq.heapify(heap)
    while heap:
        score, left, right = (-x for x in heapq.heappop(heap))
        if left not in groups or right not in groups or near[left].get(right) != score:
            continue
        groups[left] += groups.pop(right)
        mine, theirs = near[left], near.pop(right)
        for other in [*mine, *(x for x in theirs if x not in mine)]:
            both = min(mine.get(other, -1.0), theirs.get(other, -1.0)) if other not in (left, right) else -1.0
            if other in near:
                near[other].pop(right, None)
            if other in (left, right):
                mine.pop(other, None)
            elif both < threshold:
                mine.pop(other, None)
                near[other].pop(left, None)
            else:
                mine[other] = near[other][left] = both
                heapq.heappush(heap, (-both, -min(left, other), -max(left, other)))
    return [sorted(groups[i]) for i in sorted(groups)]


def single_pass(ids: list[int], similarity: dict[tuple[int, int], float], threshold: float) -> list[list[int]]:
    """In order, each joins the cluster of its most similar earlier member, if similar enough; the earliest of ties. Work follows the
    pairs."""
    earlier: dict[int, list[tuple[int, float]]] = {}
    for (a, b), s in similarity.items():
        earlier.setdefault(b, []).append((a, s))
    clusters: list[list[int]] = []
    of: dict[int, int] = {}
    for i in ids:
        best = max(((s, -of[j]) for j, s in earlier.get(i, ()) if j in of and s > 0.0 and s >= threshold), default=None)
        of[i] = -best[1] if best else len(clusters)
        if best:
            clusters[of[i]].append(i)
        else:
            clusters.append([i])
    return clusters


#: Pairs that tasks fold; of more, complete linkage merges in rounds of joins until no more are left.
FOLDED = 200_000


def linked(pairs: DataFrame, most: int = FOLDED) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, s) of groups after rounds of complete linkage, `most` at most, and (vec_id, label) of what was merged.

    A round merges all pairs that are the best of both their groups, in complete_linkage's order. No other merge makes a better pair of
    a group, ties included (a group keeps its lesser index), so these are pairs that it merges too, in whatever order. The pair of two
    groups stays if all pairs of their parts are there, with the least similarity.
    """
    groups = None
    while pairs.count() > most:
        k = F.struct("s", "a", "b").alias("k")
        best = pairs.select(F.col("a").alias("x"), k).unionByName(pairs.select(F.col("b").alias("x"), k)).groupBy("x").agg(F.max("k").alias("k"))
        joined = materialize(best.groupBy("k").agg(F.count("*").alias("n")).where("n = 2").select("k.a", "k.b"), "joined")
        to = sized(materialize(joined.select(F.col("a").alias("x"), F.col("a").alias("to")).unionByName(joined.select(F.col("b").alias("x"), F.col("a").alias("to"))), "to"))
        now = pairs
        for c in "ab":
            now = now.join(to.select(F.col("x").alias(c), F.col("to").alias("t" + c)), c, "left")
        x, y = F.coalesce("ta", "a"), F.coalesce("tb", "b")
        parts = F.when(F.col("ta").isNull(), 1).otherwise(2) * F.when(F.col("tb").isNull(), 1).otherwise(2)
        now = now.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "s", parts.alias("parts")).where("a != b")
        whole = now.where("parts > 1").groupBy("a", "b", "parts").agg(F.min("s").alias("s"), F.count("*").alias("n")).where("n = parts")
        left = materialize(now.where("parts = 1").select("a", "b", "s").unionByName(whole.select("a", "b", "s")), "pairs")
        drop_scratch(pairs)
        pairs, step = left, joined.select(F.col("b").alias("vec_id"), F.col("a").alias("label"))
        if groups is not None:
            on = to.select(F.col("x").alias("label"), "to")
            new = step.join(groups.select("vec_id"), "vec_id", "left_anti")
            step = groups.join(on, "label", "left").select("vec_id", F.coalesce("to", "label").alias("label")).unionByName(new)
        groups = materialize(step, "groups")
    return pairs, groups


def clustered(vectors: DataFrame, threshold: float, fold) -> DataFrame:
    """(vec_id, cluster): cluster is the smallest member. Vectors without any pair are clusters of their own."""
    pairs = vector_pairs(vectors, threshold)
    if fold is single_pass:
        # a vector looks at its most similar earlier ones alone: about one pair a vector is written and folded, however many there are
        most = F.rank().over(Window.partitionBy("b").orderBy(F.desc("s")))
        pairs = pairs.where("s > 0").withColumn("r", most).where("r = 1").drop("r")
    pairs, groups = materialize(pairs, "pairs"), None
    if fold is complete_linkage:
        pairs, groups = linked(pairs)
    parts = connected_components(pairs)
    edges = pairs.join(parts.select(F.col("node").alias("a"), "component"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        similarity = {(int(a), int(b)): float(s) for a, b, s in zip(pdf["a"], pdf["b"], pdf["s"], strict=True)}
        groups = fold(sorted({x for k in similarity for x in k}), similarity, threshold)
        rows = [(i, min(g)) for g in groups for i in g]
        return pd.DataFrame(rows, columns=["vec_id", "cluster"])

    found = edges.groupBy("component").applyInPandas(run, "vec_id long, cluster long")
    if groups is not None:
        # what was merged follows its label
        held = materialize(found, "found")
        follow = groups.join(held.withColumnRenamed("vec_id", "label"), "label", "left").select("vec_id", F.coalesce("cluster", "label").alias("cluster"))
        found = held.unionByName(follow)
    return vectors.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("cluster", "vec_id").alias("cluster"))


def _sample(c) -> DataFrame:
    return c.table("embeddings")


@query("top_c1")
def top_c1(c):
    """Complete linkage."""
    return clustered(_sample(c), FIXTURE_THRESHOLD, complete_linkage)


@query("top_c2")
def top_c2(c):
    """Single pass; clusters of two or more, with their coherence."""
    v = _sample(c)
    m = clustered(v, FIXTURE_THRESHOLD, single_pass)
    held = m.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2")
    members = m.join(held, "cluster").join(v.select("vec_id", "embedding"), "vec_id")
    near = members.join(mean_vectors(members, "cluster"), "cluster").select("cluster", "n", cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    return near.groupBy("cluster", "n").agg(F.round(F.avg("s"), 4).alias("coherence"))


_CEN = "t AS (SELECT label, unnest(generate_series(1, len(e))) AS pos, unnest(e) AS x FROM v), m AS (SELECT label, pos, round(avg(x), 6) AS m FROM t GROUP BY ALL), cen AS (SELECT label, list(m ORDER BY pos) AS c FROM m GROUP BY label)"
_CC = "round(list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))), 6)"


@query("top_c3", f"WITH {_VEC}, {_CEN}, p AS (SELECT a.label, b.label AS parent, {_CC} AS s FROM cen a JOIN cen b ON b.label < a.label) SELECT label, parent FROM p WHERE s > 0.05 QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, parent) = 1")
def top_c3(c):
    return parents(mean_vectors(c.table("embeddings")), FIXTURE_PARENT)


def parents(m: DataFrame, threshold: float = PARENT_THRESHOLD) -> DataFrame:
    """Parent: the most similar earlier cluster above a threshold, so the hierarchy has no cycle."""
    b = m.select(F.col("label").alias("parent"), F.col("centroid").alias("pc"))
    p = m.join(b, F.col("parent") < F.col("label")).select("label", "parent", F.round(cosine(F.col("centroid"), F.col("pc")), 6).alias("s")).where(F.col("s") > threshold)
    w = Window.partitionBy("label").orderBy(F.desc("s"), "parent")
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").select("label", "parent")


@query("top_c4", f"WITH {_VEC}, o AS (SELECT * FROM v WHERE vec_id % 5 <> 0), {_CEN.replace('FROM v', 'FROM o')}, p AS (SELECT v.vec_id, cen.label, round(list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c))), 6) AS s FROM v, cen WHERE v.vec_id % 5 = 0) SELECT vec_id, label, s FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1")
def top_c4(c):
    """Pending vectors join the nearest centroid of the clusters there are; centroids are few and broadcast."""
    v = c.table("embeddings")
    m = mean_vectors(v.where("vec_id % 5 != 0"))
    p = v.where("vec_id % 5 = 0").select("vec_id", "embedding").join(F.broadcast(m), F.lit(True)).select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("s"))
    return p.groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("label")).alias("l"))).alias("m")).select("vec_id", (-F.col("m.l")).alias("label"), F.col("m.s").alias("s"))


def labels(docs: DataFrame, key: str) -> DataFrame:
    """Label of each group: its four commonest content terms."""
    terms = docs.select(key, F.explode(F.filter(T.found(F.lower("text"), "[a-z]{4,}"), lambda w: ~w.isin(T.STOPWORDS))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    top = terms.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term"))).where("r <= 4")
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s.term), " / ").alias("label"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_LAB = f"tm AS (SELECT source, w AS term, count(*) AS n FROM (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda w: w NOT IN ({_STOP}))) AS w FROM documents) GROUP BY ALL), tr AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS r FROM tm), la AS (SELECT source, string_agg(term, ' / ' ORDER BY r) AS label FROM tr WHERE r <= 4 GROUP BY 1)"


@query("top_c5", f"WITH {_LAB} SELECT * FROM la")
def top_c5(c):
    return labels(c.docs, "source")


@query("top_c6", f"WITH {_LAB}, l AS (SELECT source, string_split(label, ' / ') AS t, CAST(substr(source, 4) AS INTEGER) AS k FROM la), p AS (SELECT a.source AS current, b.source AS previous, least(1.0, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE + 0.2 * (a.k = b.k + 10)::INT) AS s FROM l a, l b WHERE a.k >= 10 AND b.k < 10), m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY current ORDER BY s DESC, previous) = 1) SELECT current, CASE WHEN s < 0.25 THEN NULL ELSE previous END AS previous, CASE WHEN s < 0.25 THEN 'new' WHEN s >= 0.6 THEN 'stable' ELSE 'ambiguous' END AS relation, round(s, 4) AS score FROM m")
def top_c6(c):
    """Continuity of topics: label overlap and 0.2 a shared document; here those ten apart share one."""
    l = labels(c.docs, "source").select("source", F.split("label", " / ").alias("t"), F.substring("source", 4, 9).cast("int").alias("k"))  # noqa: E741
    a, b = l.where("k >= 10").select(F.col("source").alias("current"), F.col("t").alias("ta"), F.col("k").alias("ka")), l.where("k < 10").select(F.col("source").alias("previous"), F.col("t").alias("tb"), F.col("k").alias("kb"))
    s = F.least(F.lit(1.0), T.jaccard(F.col("ta"), F.col("tb")) + F.when(F.col("ka") == F.col("kb") + 10, 0.2).otherwise(0.0))
    p = a.join(F.broadcast(b), F.lit(True)).select("current", "previous", s.alias("s"))
    m = p.withColumn("r", F.row_number().over(Window.partitionBy("current").orderBy(F.desc("s"), "previous"))).where("r = 1")
    return m.select("current", F.when(F.col("s") >= 0.25, F.col("previous")).alias("previous"), F.when(F.col("s") < 0.25, "new").when(F.col("s") >= 0.6, "stable").otherwise("ambiguous").alias("relation"), F.round("s", 4).alias("score"))


def parent_categories(topics: DataFrame, key: str, terms: str, gate: int = 5, shared: int = 2, most: int = 8, tighter: int = 3) -> DataFrame:
    """(key, category): topics that share `shared` terms or more belong together, in groups of more than `most` only those that share
    `tighter`; the category is the smallest member. Topics alone have none, nor has any if there are no more than `gate`."""
    each = topics.select(F.col(key).alias("k"), F.explode(F.array_distinct(terms)).alias("term"))
    both = each.withColumnRenamed("k", "a").join(each.withColumnRenamed("k", "b"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    near = materialize(both.where(F.col("n") >= shared), "near")
    parts = connected_components(near.select("a", "b"))
    large = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component")
    within = parts.join(large, "component").select("node")
    inner = connected_components(near.where(F.col("n") >= tighter).join(within.withColumnRenamed("node", "a"), "a", "left_semi").select("a", "b"))
    found = parts.join(large, "component", "left_anti").select("node", "component").unionByName(inner.select("node", "component"))
    enough = topics.agg((F.count("*") > gate).alias("enough"))
    out = topics.select(key).join(found, topics[key] == found["node"], "left").join(F.broadcast(enough), F.lit(True))
    return out.select(key, F.when(F.col("enough"), F.col("component")).alias("category"))


_C7 = f"""WITH RECURSIVE {_LAB}, l AS (SELECT source, string_split(label, ' / ') AS t FROM la),
p AS (SELECT a.source AS a, b.source AS b, len(list_intersect(a.t, b.t)) AS s FROM l a JOIN l b ON a.source <> b.source),
r2 AS (SELECT source AS x, source AS y FROM l UNION SELECT r.x, p.b FROM r2 r JOIN p ON p.a = r.y AND p.s >= 2), c2 AS (SELECT x, min(y) AS c, count(*) AS n FROM r2 GROUP BY x),
r3 AS (SELECT x, x AS y FROM c2 WHERE n > 8 UNION SELECT r.x, p.b FROM r3 r JOIN p ON p.a = r.y AND p.s >= 3), c3 AS (SELECT x, min(y) AS c, count(*) AS n FROM r3 GROUP BY x)
SELECT source, CASE WHEN (SELECT count(*) FROM l) <= 5 THEN NULL WHEN c2.n > 8 THEN CASE WHEN c3.n > 1 THEN c3.c END WHEN c2.n > 1 THEN c2.c END AS category FROM l JOIN c2 ON c2.x = source LEFT JOIN c3 ON c3.x = source"""


@query("top_c7", _C7)
def top_c7(c):
    return parent_categories(labels(c.docs, "source").select("source", F.split("label", " / ").alias("t")), "source", "t")


def importance(n, full: float = 20.0):
    """0.5 and a share of `full` documents, 1 at most."""
    return F.round(F.least(F.lit(1.0), 0.5 + n / full), 4)


@query("top_c8", "SELECT source, count(*) AS documents, round(least(1.0, 0.5 + count(*) / 20.0::DOUBLE), 4) AS importance, 1.0::DOUBLE AS cohesion, 0.5::DOUBLE AS novelty FROM documents GROUP BY 1")
def top_c8(c):
    return c.docs.groupBy("source").agg(F.count("*").alias("documents"), importance(F.count("*")).alias("importance"), F.lit(1.0).alias("cohesion"), F.lit(0.5).alias("novelty"))


@query("top_c9", "WITH base, m AS (SELECT source, document_id, row_number() OVER (PARTITION BY source ORDER BY document_id) AS r FROM docs) SELECT source, chunk_id FROM m JOIN chunks k USING (document_id) WHERE r BETWEEN 2 AND 5 AND chunk_index = 0".replace("SELECT source, chunk_id", "SELECT m.source, chunk_id"))
def top_c9(c):
    """Up to four siblings of each topic's first document, the first chunk of each."""
    m = c.docs.select("source", "document_id").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("document_id"))).where("r BETWEEN 2 AND 5")
    return m.join(c.chunks.where("chunk_index = 0").select("document_id", "chunk_id"), "document_id").select("source", "chunk_id")
