"""Near-duplicates of documents by BagMinHash over word shingles, banded and verified.

A document is a multiset of its shingles (five words). Each shingle has Poisson processes on the dyadic levels [0,1),
[1,2), [2,4), [4,8)... of its weight; a point carries a value, a register and a place in its level, and counts for a
document if the place lies below the document's count of the shingle. So documents see the same points wherever their
weights agree, and a register's least point is shared with the probability of the weighted Jaccard similarity. Points
above what a full signature needs are never drawn.

Equal multisets are one node. Nodes that share a band are first compared with one central node of a bucket each, then,
where a bucket still holds several components, across these unless shingles that only one of them has rule a link out;
every link is verified on the multisets. So a large group of near copies costs about a comparison a member, and no link
between components that a band proposes is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.llm.rows import numbered, sized
from corpusloom.plans.components import connected_components
from corpusloom.session import drop_scratch, materialize

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * _UNIT


def multiset(shingles: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of each row's distinct shingles."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((shingles, row))
    row, shingles = row[order], shingles[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
    first = np.flatnonzero(new)
    return row[first], shingles[first], np.diff(np.append(first, len(row)))


def bag_signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """BagMinHash signatures, rows x registers, of the identities of the least points; rows without shingles are 0."""
    ids = np.zeros(rows * registers, np.uint64)
    best = np.full(rows * registers, np.inf)
    weight = np.bincount(row, count, rows)
    # one process for each level below the count; level k > 0 is [2^(k-1), 2^k)
    parts = []
    for k in range(64):
        low = 0 if k == 0 else 1 << (k - 1)
        at = np.flatnonzero(count > low)
        if not len(at):
            break
        parts.append((row[at], textops.mix(shingle[at] ^ np.uint64(k << 57)), np.full(len(at), max(low, 1), np.float64), np.full(len(at), low, np.float64), count[at].astype(np.float64)))
    if not parts:
        return ids.reshape(rows, registers)
    row, seed, rate, low, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    scale = registers / np.maximum(weight, 1)
    limit = scale * np.log(registers * 20.0)
    pending = np.unique(row)
    while len(pending):
        # all points up to the rows' limits; a row whose registers aren't all full gets a higher limit and starts anew
        use = np.isin(row, pending, kind="table")
        p_row, p_seed, p_rate, p_low, p_count = row[use], seed[use], rate[use], low[use], count[use]
        value, drawn = np.zeros(len(p_row)), np.zeros(len(p_row), np.int64)
        while len(p_row):
            n = np.maximum(1, np.ceil((limit[p_row] - value) * p_rate).astype(np.int64))
            first = np.cumsum(n) - n
            of = np.repeat(np.arange(len(p_row)), n)
            nth = np.arange(len(of)) - first[of]
            x1 = textops.mix(p_seed[of] + (nth + drawn[of] + 1).astype(np.uint64) * _GOLD)
            gaps = np.cumsum(-np.log(_uniform(x1)) / p_rate[of])
            x = value[of] + gaps - (gaps[first] - -np.log(_uniform(x1[first])) / p_rate)[of]
            x2 = textops.mix(x1 ^ _GOLD)
            place = p_low[of] + np.maximum(p_low[of], 1) * (1 - _uniform(x2))
            good = np.flatnonzero((x <= limit[p_row][of]) & (place < p_count[of]))
            cell = p_row[of[good]] * registers + ((x2[good] * _GOLD) >> np.uint64(40)).astype(np.int64) % registers
            np.minimum.at(best, cell, x[good])
            won = best[cell] == x[good]
            ids[cell[won]] = x1[good[won]]
            last = first + n - 1
            go = x[last] <= limit[p_row]
            value, drawn = x[last][go], (drawn + n)[go]
            p_row, p_seed, p_rate, p_low, p_count = p_row[go], p_seed[go], p_rate[go], p_low[go], p_count[go]
        short = ~np.isfinite(best.reshape(rows, registers)[pending]).all(axis=1)
        pending = pending[short]
        limit[pending] *= 2
    return ids.reshape(rows, registers)


def sketch(column: pa.Array, shingle_words: int, bands: int, band_rows: int) -> dict[str, pa.Array]:
    """For each text: size (shingles), f1 and f2 (fingerprint of the multiset) and the hashes of its bands."""
    data, offsets = textops.buffers(column)
    size, f1, f2, keys = [], [], [], []
    for lo, hi in textops.slices(offsets):
        rows = hi - lo
        shingles, ptr = textops.shingle_hashes(*textops.word_hashes(data, offsets[lo : hi + 1]), shingle_words)
        row, shingle, count = multiset(shingles, ptr)
        for out, salt in ((f1, 1), (f2, 2)):
            total = np.zeros(rows, np.uint64)
            np.add.at(total, row, textops.mix(shingle * _GOLD + textops.mix(count.astype(np.uint64) * np.uint64(2 * salt + 1))))
            out.append(total)
        size.append(np.diff(ptr))
        signature = bag_signatures(row, shingle, count, rows, bands * band_rows).reshape(rows, bands, band_rows)
        key = np.tile(np.arange(bands, dtype=np.uint64), (rows, 1))
        for j in range(band_rows):
            key = textops.mix(key * _GOLD + signature[:, :, j])
        keys.append(key)
    if not size:
        size, f1, f2, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros((0, bands), np.uint64)]
    size, key = np.concatenate(size), np.concatenate(keys)
    given = size > 0
    ptr = np.concatenate([[0], np.cumsum(given * bands)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ptr), pa.array(key[given].reshape(-1).view(np.int64)))
    return {"size": pa.array(size.astype(np.int64)), "f1": pa.array(np.concatenate(f1).view(np.int64)), "f2": pa.array(np.concatenate(f2).view(np.int64)), "bands": lists}


def overlap(a: tuple, b: tuple) -> int:
    """Size of the intersection of two multisets (sorted distinct values, counts, ...)."""
    (x, n, *_), (y, m, *_) = a, b
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    hit = y[at] == x
    return int(np.minimum(n[hit], m[at[hit]]).sum())


def _texts(pairs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(a, b, ta, tb): written pairs with both texts; only texts of pairs are shuffled."""
    ids = sized(materialize(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "ids"))
    texts = rows.select("rid", F.col(f"row.`{text}`").alias("t")).join(ids, "rid", "left_semi")
    both = pairs.join(texts.select(F.col("rid").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("rid").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb")


class _Bags:
    """Multisets of texts by row number (sorted distinct shingles, counts, size), kept while there is room."""

    def __init__(self, shingle_words: int, room: int = 4_000_000):
        self.kept, self.used, self.room, self.shingle_words = {}, 0, room, shingle_words

    def __call__(self, rid: int, text) -> tuple[np.ndarray, np.ndarray, int]:
        if rid not in self.kept:
            if self.used > self.room:
                self.kept.clear()
                self.used = 0
            data, offsets = textops.buffers(pa.array([text.as_py()], pa.large_string()))
            shingles = textops.shingle_hashes(*textops.word_hashes(data, offsets), self.shingle_words)[0]
            self.kept[rid] = (*np.unique(shingles, return_counts=True), len(shingles))
            self.used += len(shingles)
        return self.kept[rid]

    def pairs(self, batch):
        """Both multisets of each row of (a, b, ta, tb)."""
        for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            yield self(a, ta), self(b, tb)


def _verify(pairs: DataFrame, rows: DataFrame, text: str, shingle_words: int, tenths: int) -> DataFrame:
    """Of pairs (a, b) those whose multisets' Jaccard similarity is at least tenths / 10, written."""

    def check(batches):
        bags = _Bags(shingle_words)
        for batch in batches:
            keep = []
            for x, y in bags.pairs(batch):
                both = overlap(x, y)
                keep.append(10 * both >= tenths * (x[2] + y[2] - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(_texts(pairs, rows, text).mapInArrow(textops.lean(check), "a long, b long"), "links")


#: Bits of a sketch of what a text lacks of its pivot, in longs of 64.
_LACKS = 4


def lacking(bag: tuple, pivot: tuple) -> tuple[int, list[int]]:
    """How much of a multiset its pivot does not have, and a bitmap of what the pivot has beyond it.

    Each missing copy of a shingle sets one bit, so the bits of two texts' union count no more than what one of them lacks.
    """
    (x, n, _), (y, m, _) = bag, pivot
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    has = np.where(x[at] == y, n[at], 0) if len(x) else np.zeros(len(y), np.int64)
    missing = np.maximum(m - has, 0)
    copy = np.arange(int(missing.sum())) - np.repeat(np.cumsum(missing) - missing, missing) + np.repeat(has, missing)
    bit = textops.mix(np.repeat(y, missing) + copy.astype(np.uint64) * _GOLD) >> np.uint64(56)
    bits = [0] * _LACKS
    for v in set((bit % np.uint64(64 * _LACKS)).tolist()):
        bits[v // 64] |= 1 << (v % 64)
    return int(bag[2] - np.minimum(has, m).sum()), [v - (1 << 64) if v >> 63 else v for v in bits]


def _with_pivots(spread: DataFrame, rows: DataFrame, text: str, shingle_words: int) -> DataFrame:
    """Add pivot, pivot_size, extra (what is beyond the pivot and may be shared) and lacks (bitmap) to open rows.

    A node's pivot is the most drawn node of any of its buckets, so the members of a group of copies mostly have the same.
    """
    centres = _written(spread.groupBy("band").agg(F.max(F.struct("drawn", "node", "size")).alias("m")))
    pivots = materialize(spread.join(centres, "band").groupBy("node").agg(F.max("m").alias("m"), F.min(F.col("size") - F.col("common")).alias("own")).select(F.col("node").alias("a"), F.col("m.node").alias("b"), F.col("m.size").alias("pivot_size"), "own"), "pivots")

    def compare(batches):
        bags = _Bags(shingle_words)
        for batch in batches:
            beyond, bits = [], []
            for x, y in bags.pairs(batch):
                n, b = lacking(x, y)
                beyond.append(n)
                bits.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(beyond, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], ["a", "beyond", "lacks"])

    compared = _texts(pivots.select("a", "b"), rows, text).mapInArrow(textops.lean(compare), "a long, beyond long, lacks array<long>")
    told = materialize(pivots.join(compared, "a").select(F.col("a").alias("node"), F.col("b").alias("pivot"), "pivot_size", F.greatest(F.lit(0), F.col("beyond") - F.col("own")).alias("extra"), "lacks"), "lacks")
    return materialize(spread.join(told, "node").select("band", "node", "size", "drawn", "common", "pivot", "pivot_size", "extra", "lacks"), "open")


def _may_link(x: str, y: str, tenths: int):
    """Whether two open rows' structs may be similar enough: by what each can share, and by what both lack of one pivot."""
    a, b = F.col(x), F.col(y)
    both = F.least(a["size"], a["common"], b["size"], b["common"])
    lacks = sum((F.bit_count(a["lacks"][i].bitwiseOR(b["lacks"][i])) for i in range(_LACKS)), F.lit(0))
    closer = F.least(both, a["pivot_size"] - lacks + F.least(a["extra"], b["extra"]))
    return _reach(a["size"], b["size"], F.when(a["pivot"] == b["pivot"], closer).otherwise(both), tenths)


def _own_shingles(ids: DataFrame, rows: DataFrame, text: str, shingle_words: int) -> DataFrame:
    """(node, own): how many of a text's shingles are in no other text of ids, where there are some."""
    texts = rows.select("rid", F.col(f"row.`{text}`").alias("t")).join(ids.select(F.col("node").alias("rid")), "rid", "left_semi")

    def spread(batches):
        for batch in batches:
            data, offsets = textops.buffers(batch.column(1))
            rid = batch.column(0).to_numpy()
            for lo, hi in textops.slices(offsets):
                row, shingle, count = multiset(*textops.shingle_hashes(*textops.word_hashes(data, offsets[lo : hi + 1]), shingle_words))
                yield pa.RecordBatch.from_arrays([pa.array(rid[lo:hi][row]), pa.array(shingle.view(np.int64)), pa.array(count.astype(np.int64))], ["node", "shingle", "n"])

    each = texts.mapInArrow(textops.lean(spread), "node long, shingle long, n long")
    alone = each.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node"), F.sum("n").alias("n")).where("holders = 1")
    return alone.groupBy("node").agg(F.sum("n").alias("own"))


def _written(found: DataFrame) -> DataFrame:
    """A table of one row a band or component, written before it is joined: a join of two plain exchanges can be split where one is hot."""
    return sized(materialize(found, "bands"), 300_000)


def _mixed(spread: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    bands = spread.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("size").alias("least"), F.max("size").alias("most")).where("lo != hi").drop("lo", "hi")
    return spread.join(_written(bands), "band")


def _labelled(spread: DataFrame, found: DataFrame) -> DataFrame:
    labels = sized(materialize(found, "labels"))
    return spread.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _reach(n, m, both, tenths: int):
    """Whether multisets of sizes n and m with so much in common are similar enough."""
    return 10 * both >= tenths * (n + m - both)


def _open(within: DataFrame, found: DataFrame, rows: DataFrame, text: str, shingle_words: int, tenths: int) -> DataFrame:
    """Rows (band, node, size, drawn, common) of buckets with several components whose nodes may still link to another.

    Shingles that no other text of such buckets has can't be shared: common is what may be, and bounds a text's similarity
    to any of its bucket. The bound is exact, so nothing that links is left out; it ends most members of a group of copies
    with many edits each, which share their bands but no link, before any pair is made.
    """
    spread = materialize(_mixed(_labelled(within, found)), "mixed")
    own = materialize(_own_shingles(sized(materialize(spread.select("node").distinct(), "nodes")), rows, text, shingle_words), "own")
    spread = spread.join(sized(own), "node", "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0)))
    best = F.greatest(F.least("common", "most"), "least")
    spread = spread.where(_reach(F.col("size"), best, F.least(F.col("common"), best), tenths))
    spread = materialize(spread.select("band", "node", "size", "drawn", "common"), "close")
    return _with_pivots(spread, rows, text, shingle_words)


def _sides(mixed: DataFrame, name: str) -> DataFrame:
    return mixed.select(F.col("band").alias("band" + name), F.struct("drawn", "node", "size", "common", "component", "pivot", "pivot_size", "extra", "lacks").alias(name))


def _to_centres(mixed: DataFrame, tenths: int) -> DataFrame:
    """Pairs (a, b), a > b, of each node and the most drawn of its bucket, if that is of another component."""
    centres = _written(_sides(mixed, "y").groupBy("bandy").agg(F.max("y").alias("y")))
    pairs = _sides(mixed, "x").join(centres, F.col("bandx") == F.col("bandy")).where((F.col("x.component") != F.col("y.component")) & _may_link("x", "y", tenths))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _across(mixed: DataFrame, tenths: int) -> DataFrame:
    """Pairs (a, b), a > b, of one bucket and two components whose similarity may be enough."""
    pairs = _sides(mixed, "x").join(_sides(mixed, "y"), (F.col("bandx") == F.col("bandy")) & (F.col("x.component") < F.col("y.component")) & _may_link("x", "y", tenths))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def minhash_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, tenths: int = 8, bands: int = 32, band_rows: int = 4) -> DataFrame:
    """row (a struct of all columns), class_id, kept, class_size for each row of docs.

    Rows of one class are joined by links of similarity >= tenths / 10 between their multisets of shingles; words are those
    of textops.WORD with A-Z lower-cased, and a text of 1 to 4 words is one shingle. class_id is the smallest doc_id of the
    class, and kept holds for the row with it (the first of several; in a class without ids for its first row). Rows without
    words, as with null and empty texts, are classes of their own. An empty table gives no rows.
    """
    rows = numbered(docs, text, lambda column: sketch(column, shingle_words, bands, band_rows), "size long, f1 long, f2 long, bands array<long>")
    members = materialize(rows.where("size > 0").groupBy("f1", "f2").agg(F.min("rid").alias("node"), F.count("*").alias("n")), "nodes")
    nodes = rows.select("rid", "size", "bands").join(members.select(F.col("node").alias("rid")), "rid", "left_semi")
    banded = nodes.select(F.col("rid").alias("node"), "size", F.explode("bands").alias("band"))
    shared = _written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = materialize(banded.join(shared, "band"), "buckets")
    # a bucket's centre is the node that meets the most others over all its buckets: the least edited of a group of copies
    drawn = buckets.groupBy("node").agg(F.sum("n").alias("drawn"))
    within = materialize(buckets.join(drawn, "node").select("band", "node", "size", "drawn"), "drawn")
    drop_scratch(buckets)
    centres = _written(within.groupBy("band").agg(F.max(F.struct("drawn", "node")).alias("m")).select("band", F.col("m.node").alias("centre"), F.col("m.drawn").alias("pull")))
    stars = within.join(centres, "band").where("node != centre").groupBy("node", "centre").agg(F.struct(F.count("*").alias("n"), F.max("pull").alias("pull"), F.col("centre")).alias("m")).groupBy("node").agg(F.max("m").alias("m"))
    tested = materialize(stars.select(F.greatest("node", "m.centre").alias("a"), F.least("node", "m.centre").alias("b")).distinct(), "stars")
    links = _verify(tested, rows, text, shingle_words, tenths)
    found = connected_components(links)
    # buckets that still hold several components: compare across them what can link and has not been compared
    spread = _open(within, found, rows, text, shingle_words, tenths)
    for last in (False, False, True):
        pairs = (_across if last else _to_centres)(_mixed(_labelled(spread, found)), tenths)
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            continue
        more = _verify(pairs, rows, text, shingle_words, tenths)
        tested = tested.unionByName(pairs)
        if more.limit(1).count():
            links = links.unionByName(more)
            found = connected_components(links)
    drop_scratch(within)
    drop_scratch(spread)
    # classes of one row need no join; of the others, rows carry numbers only
    grouped = members.join(found, "node", "left").select("f1", "f2", "n", F.coalesce("component", "node").alias("component"))
    large = _written(grouped.groupBy("component").agg(F.sum("n").alias("class_size")).where("class_size > 1"))
    own = rows.select("rid", "f1", "f2", "size", F.col(f"row.`{doc_id}`").alias("id")).where("size > 0").join(grouped.join(large, "component").select("f1", "f2", "component", "class_size"), ["f1", "f2"])
    own = materialize(own.select("rid", "id", "component", "class_size"), "members")
    heads = _written(own.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "rid")).alias("head")))
    told = own.join(heads, "component").select("rid", F.col("head.id").alias("class_id"), (F.col("rid") == F.col("head.rid")).alias("kept"), "class_size")
    out = rows.select("row", "rid").join(sized(materialize(told, "told")), "rid", "left")
    alone = F.col("kept").isNull()
    return out.select("row", F.when(alone, F.col(f"row.`{doc_id}`")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("kept", F.lit(True)).alias("kept"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def minhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that minhash_classes() keeps, with the columns of docs."""
    return minhash_classes(docs, **options).where("kept").select("row.*")
