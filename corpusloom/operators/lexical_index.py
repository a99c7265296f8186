"""A persisted inverted index: append, delete by id, search with skipped blocks, and an audit.

In a folder: `rows`, one row a chunk with its counted terms; `blocks`, postings sorted by term and number, up to `block` of one term
in a row, with the largest count and the least length in it; `less`, what deleted chunks took from their terms; `gone`, the
deleted chunks. All but gone are partitioned by segment, blocks and less by term bucket too, so a search reads the
buckets of its terms alone. A segment is written once; nothing is changed in place.

Search is MaxScore in three passes over block rows, none of which moves a posting that can't matter: the rarest terms of a query give
a score that its k-th hit reaches at least; terms whose bounds together stay below it can't bring a hit alone, so only
blocks of the others are read, and of those not the ones whose own bound is too low; then the hits' counts of the rest are looked up
in blocks whose numbers reach over a hit. A bound is the weight of a block's largest count in its shortest text, so it holds for
any corpus average, and the answer is that of a scan. Postings that are read meet by ranges of chunk numbers, never as a row for each query.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.retrieval import counted
from corpusloom.session import drop_scratch, lean, materialize, sized

#: Terms of a batch of queries, pairs of query and term, and hits of a pass that are sent to the tasks.
TERMS, ASKED, HITS = 500_000, 2_000_000, 4_000_000
_SLACK = 2e-6
#: Chunk numbers of a range, as a power of two.
_BITS = 14


#: Rows of chunks whose postings are brought together before they are moved.
_ROWS = 16_000


def _posted(batches):
    """Rows (term, first, numbers, tfs, lens) of chunks (number, len, terms): a list for each term and range of chunk numbers."""

    def lists(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        terms = table["terms"].combine_chunks()
        row = np.repeat(np.arange(len(table)), terms.value_lengths().to_numpy())
        term, tf = terms.flatten().field("term").dictionary_encode(), terms.flatten().field("tf").to_numpy()
        number, size = table["number"].to_numpy()[row], table["len"].to_numpy()[row]
        code = term.indices.to_numpy()
        order = np.lexsort((number, code))
        code, number, tf, size = code[order], number[order], tf[order], size[order]
        part = number >> _BITS
        edge = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])))
        ends = np.append(edge, len(code))
        for at in range(0, len(edge) if len(code) else 0, 20_000):
            here = slice(ends[at], ends[min(at + 20_000, len(edge))])
            ptr = pa.array((ends[at : at + 20_001] - ends[at]).astype(np.int32))
            flat = [pa.ListArray.from_arrays(ptr, pa.array(x[here])) for x in (number, tf, size)]
            yield pa.RecordBatch.from_arrays([term.dictionary.take(pa.array(code[edge[at : at + 20_000]])), pa.array(number[edge[at : at + 20_000]]), *flat], ["term", "first", "numbers", "tfs", "lens"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= _ROWS:
            yield from lists(held)
            held, n = [], 0
    if held:
        yield from lists(held)


def _cut(block: int):
    """Rows (term, first, last, n, most, least, numbers, tfs, lens) of sorted lists of postings, as they stream by."""

    def run(batches):
        # postings of the term under way that fill no block yet
        open_, kept = None, [np.zeros(0, np.int64)] * 3

        def rows(terms: pa.Array, code: np.ndarray, number: np.ndarray, tf: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            within = np.arange(len(code)) - np.repeat(edge, np.diff(np.append(edge, len(code))))
            at = np.flatnonzero(within % block == 0)
            ptr = pa.array(np.append(at, len(code)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ptr, pa.array(x)) for x in (number, tf, size)]
            return pa.RecordBatch.from_arrays([terms.take(pa.array(code[at])), pa.array(np.minimum.reduceat(number, at)), pa.array(np.maximum.reduceat(number, at)), pa.array(np.diff(np.append(at, len(code)))), pa.array(np.maximum.reduceat(tf, at)), pa.array(np.minimum.reduceat(size, at)), *lists], ["term", "first", "last", "n", "most", "least", "numbers", "tfs", "lens"])

        for batch in batches:
            term = pa.concat_arrays([pa.array([open_], pa.string()), batch.column(0)]).dictionary_encode()
            flat = [np.concatenate([k, batch.column(i).flatten().to_numpy()]) for k, i in zip(kept, (1, 2, 3), strict=True)]
            code = np.repeat(term.indices.fill_null(0).to_numpy(), np.append(len(kept[0]), batch.column(1).value_lengths().to_numpy()))
            if not len(code):
                continue
            # whole blocks of the term under way are given out, the rest waits for what follows
            start = int(np.flatnonzero(np.append(True, code[1:] != code[:-1]))[-1])
            done = start + (len(code) - start) // block * block
            open_ = term.dictionary[int(code[-1])].as_py()
            kept = [x[done:] for x in flat]
            if done:
                yield rows(term.dictionary, code[:done], *(x[:done] for x in flat))
        if len(kept[0]):
            yield rows(pa.array([open_]), np.zeros(len(kept[0]), int), *kept)

    return run


def _weight(tf, size, average: float, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))


def _ranges(sent, counter):
    """Function over batches of blocks: their postings by range of chunk numbers; those of the broadcast numbers by segment alone, if there are any."""

    def run(batches):
        near = sent.value
        for batch in batches:
            segment = batch.column(0).to_numpy()
            lists = batch.column(4)
            number, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            tf, size = (batch.column(c).flatten().to_numpy() for c in (5, 6))
            if near is not None:
                keep = np.zeros(len(number), bool)
                for x in np.unique(segment).tolist():
                    mine = np.flatnonzero(segment[row] == x)
                    held = near.get(x, np.zeros(0, np.int64))
                    at = np.searchsorted(held, number[mine])
                    keep[mine[at < len(held)]] = held[at[at < len(held)]] == number[mine[at < len(held)]]
                number, row, tf, size = number[keep], row[keep], tf[keep], size[keep]
            counter.add(len(np.unique(row)))
            part = number >> _BITS
            edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]))) if len(row) else np.zeros(0, int)
            ptr, of = pa.array(np.append(edge, len(row)).astype(np.int32)), pa.array(row[edge])
            flat = [pa.ListArray.from_arrays(ptr, pa.array(x.astype(np.int32))) for x in (number & ((1 << _BITS) - 1), tf, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(part[edge]), batch.column(1).take(of), *flat], ["segment", "range", "term", "at", "tfs", "lens"])

    return run


def _sums(sent, weight, k: int, added: bool):
    """Function of a range's postings and of its deleted chunks, or, if added, of the hits that sums are added to."""

    def run(table: pa.Table, other: pa.Table | None) -> pa.Table:
        weights, lacks, left = sent.value
        term = table["term"].combine_chunks().dictionary_encode() if len(table) else pa.array([], pa.string()).dictionary_encode()
        lists = table["at"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))
        at, tf, size = ((table[c].combine_chunks() if len(table) else lists).flatten().to_numpy() for c in ("at", "tfs", "lens"))
        code = np.repeat(term.indices.to_numpy(), lists.value_lengths().to_numpy())
        order = np.argsort(code, kind="stable")
        at, part = at[order], weight(tf[order].astype(float), size[order].astype(float))
        edge = np.searchsorted(code[order], np.arange(len(term.dictionary) + 1))
        where = {t: slice(edge[i], edge[i + 1]) for i, t in enumerate(term.dictionary.to_pylist())}
        some = table if len(table) else other
        segment, base = some["segment"][0].as_py(), some["range"][0].as_py() << _BITS
        place = other["number"].to_numpy() - base if other is not None else np.zeros(0, np.int64)
        if added:
            asked, before = other["#q"].to_numpy(), other["s"].to_numpy()
            by = np.argsort(asked, kind="stable")
            bound = np.searchsorted(asked[by], np.arange(len(weights) + 1))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q, own in enumerate(weights):
            if added and bound[q] == bound[q + 1]:
                continue
            here = [(where[t], w) for t, w in own.items() if t in where]
            if not here and not added:
                continue
            total = np.zeros(1 << _BITS)
            for x, w in here:
                total[at[x]] += w * part[x]
            if added:
                mine = by[bound[q] : bound[q + 1]]
                found.append((q, place[mine], before[mine] + total[place[mine]]))
                continue
            total[place] = 0
            hit = np.flatnonzero((total > 0) & (total >= lacks[q]))
            if len(hit) > k:
                # what is left can't lift the others above the best k
                hit = hit[total[hit] >= np.partition(total[hit], len(hit) - k)[len(hit) - k] - left[q] - _SLACK]
            found.append((q, hit, total[hit]))
        n = np.array([len(x) for _, x, _ in found], np.int64)
        out = [np.repeat(np.array([q for q, _, _ in found], np.int32), n), np.full(n.sum(), segment, np.int32), *(np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in (1, 2))]
        return pa.table({"#q": pa.array(out[0], pa.int32()), "segment": pa.array(out[1], pa.int32()), "number": pa.array(out[2].astype(np.int64) + base), "s": pa.array(out[3], pa.float64())})

    return run


class LexicalIndex:
    """Index of chunks in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, block: int = 128, k1: float = 1.2, b: float = 0.75, pattern: str = T.WORD):
        self.spark, self.path, self.buckets, self.block, self.k1, self.b, self.pattern = spark, path.rstrip("/"), buckets, block, k1, b, pattern
        #: Block rows that the last search was given, and those it read.
        self.seen = self.read = 0

    def _exists(self, name: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(conf).exists(place)

    def _table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if self._exists(name) else None

    def _bucket(self, term: str = "term"):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def append(self, chunks: DataFrame, key: str = "chunk_id", carry: tuple[str, ...] = ()) -> int:
        """Add a segment of chunks (key, text and the columns of carry; keys that the index does not hold yet); its number."""
        rows = self._table("rows")
        segment = 0 if rows is None else rows.agg(F.max("segment")).first()[0] + 1
        at = f"{self.path}/rows/segment={segment}"
        words = counted(chunks.select(F.col(key).alias("chunk_id"), *carry, "text"), ("chunk_id", *carry), self.pattern, None)
        words.withColumn("number", F.monotonically_increasing_id()).write.parquet(at)
        lists = "numbers array<long>, tfs array<long>, lens array<long>"
        posted = materialize(self.spark.read.parquet(at).select("number", "len", "terms").mapInArrow(lean(_posted), f"term string, first long, {lists}").withColumn("bucket", self._bucket()), "posted")
        # ranges of (bucket, term, number): a term of a third of all chunks is cut into many
        ordered = posted.repartitionByRange("bucket", "term", "first").sortWithinPartitions("bucket", "term", "first")
        cut = ordered.select("term", "numbers", "tfs", "lens").mapInArrow(lean(_cut(self.block)), f"term string, first long, last long, n long, most long, least long, {lists}")
        cut.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/blocks/segment={segment}")
        drop_scratch(posted)
        return segment

    def delete(self, ids: DataFrame, key: str = "chunk_id") -> int:
        """Take chunks out by id; how many. Their postings stay in the blocks and are passed over."""
        rows = self._table("rows")
        if rows is None:
            return 0
        found = rows.join(ids.select(F.col(key).alias("chunk_id")).distinct(), "chunk_id", "left_semi")
        gone = self._table("gone")
        if gone is not None:
            found = found.join(gone.select("segment", "number"), ["segment", "number"], "left_anti")
        found = materialize(found, "gone")
        n = found.count()
        if n:
            found.select("segment", "number", "chunk_id", "len").write.mode("append").parquet(f"{self.path}/gone")
            less = found.select("segment", F.inline("terms")).groupBy("segment", "term").agg(F.count("*").alias("n"))
            less.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/less")
        return n

    def _size(self) -> tuple[int, float]:
        """Live chunks and their mean length."""
        n, size = self._table("rows").agg(F.count("*"), F.sum("len")).first()
        gone = self._table("gone")
        if gone is not None:
            m, less = gone.agg(F.count("*"), F.sum("len")).first()
            n, size = n - m, size - less
        return n, size / n if n else 1.0

    def search(self, queries: DataFrame, query_id: str, k: int = 10, carry: tuple[str, ...] = (), style: str = "log1p") -> DataFrame:
        """(query_id, chunk_id, carry, score, rank) of each query's best k live chunks; ties by chunk_id. queries: (query_id, term).

        A batch has at most 500,000 terms and 2,000,000 pairs; longer ones are to be asked in parts.
        """
        spark, kind = self.spark, queries.schema[query_id].dataType.simpleString()
        asked = queries.select(query_id, "term").limit(ASKED + 1).collect()
        terms = sorted({r.term for r in asked})
        if len(asked) > ASKED or len(terms) > TERMS:
            raise ValueError("the batch of queries is too large; ask it in parts")
        if k <= 0:
            raise ValueError("limit must be positive")
        fields = ", ".join(f"`{c}` {self._table('rows').schema[c].dataType.simpleString()}" for c in carry) if self._exists("rows") else ""
        none = spark.createDataFrame([], f"`{query_id}` {kind}, chunk_id string, {fields + ', ' if fields else ''}score double, rank int")
        if not terms or not self._exists("blocks"):
            return none
        n, average = self._size()
        wanted = spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", self._bucket())
        held = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())
        mine = lambda df: df.where(F.col("bucket").isin(held)).join(F.broadcast(wanted.drop("bucket")), "term", "left_semi")
        blocks = mine(self._table("blocks"))
        # counts and bounds by term, without the postings
        top = _weight(F.col("most"), F.col("least"), average, self.k1, self.b)
        heads = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(top).alias("top"), F.count("*").alias("rows"))
        if (less := self._table("less")) is not None:
            heads = heads.join(mine(less).groupBy("term").agg(F.sum("n").alias("less")), "term", "left").withColumn("df", F.col("df") - F.coalesce("less", F.lit(0)))
        known = {r.term: (self._idf(n, r.df, style), r.top, r.df, r.rows) for r in heads.select("term", "df", "top", "rows").collect() if r.df > 0}
        times: dict = {}
        for r in asked:
            if r.term in known:
                own = times.setdefault(r[0], {})
                own[r.term] = own.get(r.term, 0) + 1
        if not times:
            return none
        self.seen, self._counter = sum(known[t][3] for t in {t for own in times.values() for t in own}), spark.sparkContext.accumulator(0)
        # queries by number
        names = sorted(times, key=repr)
        weights = [{t: m * known[t][0] for t, m in times[q].items()} for q in names]
        bound = [{t: w * known[t][1] for t, w in own.items()} for own in weights]
        rare = []
        for own in weights:
            total, first = 0, {}
            for t in sorted(own, key=lambda t: (known[t][2], t)):
                if total >= k and first:
                    break
                first[t] = own[t]
                total += known[t][2]
            rare.append(first)
        nth = F.row_number().over(Window.partitionBy("#q").orderBy(F.desc("s")))
        least = {r.q: r.s for r in self._scores(blocks, rare, None, average, k).withColumn("r", nth).where(F.col("r") == k).select(F.col("#q").alias("q"), "s").collect()}
        floor = [least.get(q, 0.0) - _SLACK for q in range(len(names))]
        # terms from the least bound on that together stay below the floor bring no hit alone
        main, rest = [{} for _ in names], [{} for _ in names]
        for q, own in enumerate(bound):
            total = 0.0
            for t in sorted(own, key=lambda t: (own[t], t)):
                total += own[t]
                (rest if total < floor[q] else main)[q][t] = weights[q][t]
        room = [{t: floor[q] - (sum(own.values()) - own[t]) for t in main[q]} for q, own in enumerate(bound)]
        left = [sum(own[t] for t in rest[q]) for q, own in enumerate(bound)]
        hits = materialize(self._scores(blocks, main, room, average, k, [x - y for x, y in zip(floor, left, strict=True)], left), "hits")
        if any(rest):
            hits = self._scores(blocks, rest, None, average, k, hits=hits)
        hits = hits.withColumn("s", F.round("s", 6))
        best = materialize(hits.withColumn("r", F.rank().over(Window.partitionBy("#q").orderBy(F.desc("s")))).where(F.col("r") <= k), "best")
        self.read = self._counter.value
        told = spark.createDataFrame([(i, q) for i, q in enumerate(names)], f"`#q` int, `{query_id}` {kind}")
        out = self._table("rows").select("segment", "number", "chunk_id", *carry).join(sized(best), ["segment", "number"]).join(F.broadcast(told), "#q")
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("s"), "chunk_id"))).where(F.col("rank") <= k)
        return out.select(query_id, "chunk_id", *carry, F.col("s").alias("score"), "rank")

    @staticmethod
    def _idf(n: int, df: int, style: str) -> float:
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) if style == "log1p" else max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)

    def _scores(self, blocks: DataFrame, weights: list[dict], room: list[dict] | None, average: float, k: int, lacks: list[float] | None = None, left: list[float] | None = None, hits: DataFrame | None = None) -> DataFrame:
        """(q, segment, number, s): sums of the given terms' weights for live chunks, by query number. A block is read only if its bound reaches
        `room` for a query of its term. Postings meet by ranges of chunk numbers, where a task sums them in place and gives out what reaches
        `lacks` and may still be among a query's best k when `left` more is added. With hits, postings of those alone are read, and added to them."""
        spark, known = self.spark, set().union(*weights)
        need = dict.fromkeys(known, math.inf)
        for q, own in enumerate(weights):
            for t, w in own.items():
                need[t] = min(need[t], room[q][t] / w if room else -math.inf)
        asked = F.broadcast(spark.createDataFrame(list(need.items()), "term string, need double"))
        top = _weight(F.col("most"), F.col("least"), average, self.k1, self.b)
        rows = blocks.join(asked, "term").where(top >= F.col("need")).select("segment", "term", "first", "last", "numbers", "tfs", "lens")
        near = None
        if hits is not None and hits.count() <= HITS:
            told = hits.select("segment", "number").distinct().toArrow()
            segment, number = told["segment"].to_numpy(), told["number"].to_numpy()
            near = {int(x): np.sort(number[segment == x]) for x in np.unique(segment)}
        parts = rows.mapInArrow(_ranges(spark.sparkContext.broadcast(near), self._counter), "segment int, range long, term string, at array<int>, tfs array<int>, lens array<int>")
        weight = partial(_weight, average=average, k1=self.k1, b=self.b)
        of = spark.sparkContext.broadcast((weights, lacks or [0.0] * len(weights), left or [0.0] * len(weights)))
        other = self._table("gone") if hits is None else hits
        sums, fields = _sums(of, weight, k, hits is not None), "`#q` int, segment int, number long, s double"
        if other is None:
            return parts.groupBy("segment", "range").applyInArrow(lambda table: sums(table, None), fields)
        other = other.select("segment", F.shiftright("number", _BITS).alias("range"), "number", *(["#q", "s"] if hits is not None else []))
        return parts.groupBy("segment", "range").cogroup(other.groupBy("segment", "range")).applyInArrow(lambda table, more: sums(table, more), fields)

    def live(self) -> DataFrame:
        """Rows of the chunks that are not deleted."""
        rows, gone = self._table("rows"), self._table("gone")
        return rows if gone is None else rows.join(sized(gone.select("segment", "number")), ["segment", "number"], "left_anti")

    def audit(self) -> DataFrame:
        """One row: chunks, live, deleted, duplicate ids among live chunks, postings in blocks, postings the rows tell, terms."""
        rows, live = self._table("rows"), self.live()
        counts = rows.agg(F.count("*").alias("chunks"), F.sum(F.size("terms")).cast("long").alias("postings_told"))
        alive = live.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("live"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
        blocks = self._table("blocks").groupBy("term").agg(F.sum("n").alias("n"))
        held = blocks.agg(F.sum("n").alias("postings"), F.count("*").alias("terms"))
        return counts.join(alive, F.lit(True)).join(held, F.lit(True)).select("chunks", "live", (F.col("chunks") - F.col("live")).alias("deleted"), "duplicates", "postings", "postings_told", "terms")
