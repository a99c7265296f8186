"""Best-fit packing by large-item matching, planned on the histogram of lengths.

Pieces of equal length are interchangeable, so the packing is computed exactly for the whole corpus from at most
`capacity` counts, on the driver, and handed out as rank ranges per length. Pieces above a third of the capacity go at
most two to a bin, by greedy matching from the longest down (with two to a bin that makes the most pairs); smaller ones,
longest first, go to the bin with the least gap that holds them. No piece moves through a single task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.session import materialize, small_batches

#: Characters on which the two libraries' patterns surely agree; texts with others go through the slower one.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")


class Encoder:
    """Ids of a byte-level BPE tokenizer file; plain texts by a faster library with the same vocabulary."""

    def __init__(self, spec: str):
        import tiktoken

        self.spec, self.slow, model = spec, None, json.loads(spec)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.special = list(special)
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) or any(x in text for x in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_str(self.spec)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast(text, disallowed_special=()).astype("<u4", copy=False)


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids_crc32, (ids,) task, nth.

    A document is its ids and then end_id; a null text is empty. One longer than capacity is cut so that all pieces but
    the first are full. task and nth number the pieces of one length within the task that made them.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches):
        from pyspark import TaskContext

        encode, task, seen = encoder(spec.value), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            owner, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                got = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                n, a, k = len(got), 0, 0
                b = n % capacity or capacity
                while a < n:
                    part = got[a:b]
                    owner.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part.tobytes()))
                    nth.append(seen[b - a])
                    seen[b - a] += 1
                    if keep_ids:
                        ids.append(part)
                    a, b, k = b, b + capacity, k + 1
            out = {"doc_id": batch.column(0).take(pa.array(owner, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if keep_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out | {"task": pa.array([task] * len(owner), pa.int64()), "nth": pa.array(nth, pa.int64())})

    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{', ids array<long>' if keep_ids else ''}, task long, nth long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(textops.lean(cut), fields)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, pieces, first bin, offset) and the number of bins, for lengths 1 to capacity.

    The piece of that length with rank first + i lies in bin first bin + i at the offset. Bins with the same contents are
    ranges, and every step uses up a length or a range or splits one range, so slots depend on capacity, not on pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    done: Counter[int] = Counter()
    slots, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, first_bin: int, n: int, offset: int) -> None:
        slots.append((length, done[length], n, first_bin, offset))
        done[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] >= (2 if x == a else 1)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, bins, n, 0)
            if b is not None:
                put(b, bins, n, a)
            gaps.setdefault(capacity - a - (b or 0), []).append((bins, n))
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=None)
            if gap is None:
                gap, n = capacity, -(-left[s] // (capacity // s))
                first, bins = bins, bins + n
            else:
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            # the tightest bin stays the tightest until it can't hold another of this length
            each = gap // s
            full = min(n, left[s] // each)
            rest = left[s] - full * each if full < n else 0
            for i in range(each if full else 0):
                put(s, first, full, capacity - gap + i * s)
            for i in range(rest):
                put(s, first + full, 1, capacity - gap + i * s)
            for width, at, m in ((gap - each * s, first, full), (gap - rest * s, first + full, 1 if rest else 0), (gap, first + full + bool(rest), n - full - bool(rest))):
                if m > 0 and width:
                    gaps.setdefault(width, []).append((at, m))
    return slots, bins


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces() that are written down; the columns task and nth go.

    Every piece of an empty table, of repeated documents or with a null id is placed like any other.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    slots, _ = plan(histogram, capacity)
    # slots are bounded by capacity, see plan()
    table = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "s_length long, s_rank long, s_n long, s_bin long, s_offset long"))
    order = Window.partitionBy("length").orderBy("task")
    before = counts.where(F.col("length") < capacity).withColumn("before", F.sum("n").over(order) - F.col("n")).select(F.col("task").alias("b_task"), F.col("length").alias("b_length"), "before")
    columns = [c for c in cut.columns if c not in ("task", "nth")]
    short = cut.where(F.col("length") < capacity).join(before, (F.col("task") == F.col("b_task")) & (F.col("length") == F.col("b_length")))
    rank = F.col("before") + F.col("nth")
    short = short.withColumn("rank", rank).join(table, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_rank")) & (F.col("rank") < F.col("s_rank") + F.col("s_n")))
    short = short.select(*columns, (F.col("s_bin") + F.col("rank") - F.col("s_rank")).alias("sequence_id"), F.col("s_offset").alias("offset"))
    if not full:
        return short
    # a full piece is a sequence of its own; negative numbers keep apart from the bins
    own = -(F.shiftleft(F.col("task"), 38) + F.col("nth") + 1)
    return short.unionByName(cut.where(F.col("length") == capacity).select(*columns, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. See pieces() and plan()."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id, doc_id, text, keep_ids), "pieces"), capacity)
