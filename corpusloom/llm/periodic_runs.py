"""Runs of periodically repeated words, by the linear tandem-repeat method on suffix trees.

Words become numbers, and stretches in which every three words in a row come back often enough to lie in a run are laid side by
side, each followed by a number of its own (a lossless filter: most of a text is in none). Of that sequence a suffix tree is
made. Its Lempel-Ziv blocks give squares that cover the leftmost ones; from their places in the tree, walks along suffix
links find all rotations, so that the vocabulary of squares is complete; the leaves below a square's place are its occurrences.
Squares of one period that begin at consecutive words make a run.

All work is within a document or a bounded slice of short ones, so rows are never moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.session import small_batches

WORD = r"[^\x20\x09-\x0D]+"


class SuffixTree:
    """Suffix tree of a sequence of small numbers whose last one is unlike all others.

    Nodes below n are leaves, by rank of their suffixes; then come inner nodes; the last is the root. A node covers the ranks
    low to high.
    """

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        self.s = s
        rank = np.unique(s, return_inverse=True)[1].astype(np.int32)
        #: For each k, numbers of the words of length 2^k (cut at the end) by their start, in order; one place more.
        self.levels = [np.append(rank, np.int32(-1))]
        while rank.max() < n - 1:
            half = 1 << (len(self.levels) - 1)
            later = np.full(n, -1, np.int64)
            later[: n - half] = rank[half:]
            rank = np.unique(rank.astype(np.int64) * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int32)
            self.levels.append(np.append(rank, np.int32(-1)))
        self.rank = rank.astype(np.int64)
        self.suffix = np.argsort(self.rank)
        lcp = np.zeros(n + 1, np.int64)
        lcp[1:n] = self.forward(self.suffix[:-1], self.suffix[1:])
        self.lcp = lcp
        self._least = [lcp[:n].astype(np.int32)]
        while 2 << (len(self._least) - 1) <= n:
            half, row = 1 << (len(self._least) - 1), self._least[-1]
            self._least.append(np.minimum(row[:-half], row[half:]))
        self._nodes()

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common continuation from i and j, i != j."""
        i, j = i.copy(), j.copy()
        begun = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - begun

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends at i and j, i != j; 0 before the start."""
        i, j = i.copy(), j.copy()
        begun = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            step = ((a >= 0) & (b >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return begun - i

    def ranks(self, rank: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last rank of suffixes that share so many numbers with those of the given ranks."""
        low, high = rank.copy(), rank.copy()
        for k in range(len(self._least) - 1, -1, -1):
            row = self._least[k]
            a = low - (1 << k) + 1
            low -= ((a >= 1) & (row[np.clip(a, 0, len(row) - 1)] >= size)).astype(np.int64) << k
            a = high + 1
            high += ((a < len(row)) & (row[np.minimum(a, len(row) - 1)] >= size)).astype(np.int64) << k
        return low, high

    def _nodes(self) -> None:
        n = self.n
        inner = np.arange(1, n)
        low, high = self.ranks(inner, self.lcp[1:n])
        self._keys, first = np.unique(low * n + high, return_index=True)
        # the root covers all ranks and comes last
        root = int(np.flatnonzero(self._keys == n - 1)[0])
        self._id = np.arange(len(self._keys)) + n
        self._id[root + 1 :] -= 1
        self._id[root] = n + len(self._keys) - 1
        order = np.argsort(self._id)
        low, high, depth = low[first][order], high[first][order], self.lcp[1:n][first][order]
        leaves = np.arange(n)
        self.low, self.high = np.concatenate([leaves, low]), np.concatenate([leaves, high])
        self.depth = np.concatenate([n - self.suffix, depth])
        up = np.maximum(self.lcp[self.low], self.lcp[self.high + 1])
        self.parent = self.node(*self.ranks(self.low, up))
        self.parent[-1] = -1
        # suffix links: without its first number
        at = self.suffix[self.low]
        self.link = np.full(len(self.low), -1)
        leaf = np.flatnonzero(at[:n] + 1 < n)
        self.link[leaf] = self.rank[at[leaf] + 1]
        own = np.arange(n, len(self.low) - 1)
        self.link[own] = self.node(*self.ranks(self.rank[at[own] + 1], self.depth[own] - 1))

    def node(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Nodes by the ranks that they cover."""
        found = np.minimum(np.searchsorted(self._keys, low * self.n + high), len(self._keys) - 1)
        return np.where(low == high, low, self._id[found])

    def blocks(self) -> list[int]:
        """Starts of the Lempel-Ziv blocks, and n: each the longest stretch that also begins before it, or one number."""
        n, rank = self.n, self.rank.tolist()
        before, after, common = list(range(-1, n)), list(range(1, n + 2)), self.lcp.tolist()
        longest = [0] * n
        for i in range(n - 1, -1, -1):
            r = rank[i]
            a, q, p = common[r], after[r], before[r]
            b = common[q]
            longest[i] = a if a > b else b
            common[q] = b if a > b else a
            before[q] = p
            if p >= 0:
                after[p] = q
        starts, at = [], 0
        while at < n:
            starts.append(at)
            at += longest[at] or 1
        return [*starts, n]


def leftmost(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares that cover the leftmost square of each kind, from the blocks' ends."""
    edge = np.array(tree.blocks())
    size = np.diff(edge)
    # the centre in a block, and the second half reaching over its end
    block = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(block)) - np.repeat(edge[:-1], size) + 1
    end = edge[block + 1]
    q = end - k
    inside = end < tree.n
    q, k, end = q[inside], k[inside], end[inside]
    k1, k2 = tree.forward(q, end), tree.backward(q - 1, end - 1)
    ok = (k1 + k2 >= k) & (k1 > 0)
    found = [(np.maximum(q - k2, q - k + 1)[ok], k[ok])]
    # the start in a block or before it, and the second half reaching no further than the next
    reach = size + np.append(size[1:], 0)
    block = np.repeat(np.arange(len(size)), reach)
    k = np.arange(len(block)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
    h = edge[block]
    q = h + k
    inside = (q < tree.n) & (h > 0)
    k, h, q = k[inside], h[inside], q[inside]
    k1, k2 = tree.forward(h, q), tree.backward(h - 1, q - 1)
    ok = (k1 + k2 >= k) & (k1 > 0)
    found.append((np.maximum(h - k2, h - k + 1)[ok], k[ok]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def primitive(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power of a shorter word."""
    out, rest, factor = np.ones(len(start), bool), period.copy(), 2
    while (rest > 1).any():
        big = rest < factor * factor
        for prime, of in ((rest, big & (rest > 1)), (np.full_like(rest, factor), ~big & (rest % factor == 0))):
            at = np.flatnonzero(of)
            part = period[at] // prime[at]
            out[at] &= tree.forward(start[at], start[at] + part) < period[at] - part
        rest[big] = 1
        while (more := (rest > 1) & (rest % factor == 0)).any():
            rest[more] //= factor
        factor += 1
    return out


def vocabulary(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes at or below which each kind of square ends in the tree, and its length: the given ones and all their rotations."""
    size = 2 * period
    node = tree.node(*tree.ranks(tree.rank[start], size))
    begun = np.unique(np.stack([node, size]), axis=1)
    wide = tree.n + 1
    marked = set((begun[0] * wide + begun[1]).tolist())
    s, first = tree.s.tolist(), tree.suffix[tree.low].tolist()
    depth, parent, link = tree.depth.tolist(), tree.parent.tolist(), tree.link.tolist()
    letters = int(tree.s.max()) + 1
    below = np.flatnonzero(tree.parent >= 0)
    children = dict(zip((tree.parent[below] * letters + tree.s[tree.suffix[tree.low[below]] + tree.depth[tree.parent[below]]]).tolist(), below.tolist(), strict=True))
    for v, size in zip(*begun.tolist(), strict=True):
        while True:
            letter, u, rest = s[first[v]], link[v], size - 1
            while depth[parent[u]] >= rest:
                u = parent[u]
            if depth[u] > rest:
                if s[first[u] + rest] != letter:
                    break
            elif (u := children.get(u * letters + letter, -1)) < 0:
                break
            if u * wide + size in marked:
                break
            marked.add(u * wide + size)
            v = u
    keys = np.fromiter(marked, np.int64, len(marked))
    return keys // wide, keys % wide


def runs(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs of at least two periods."""
    start, period = leftmost(tree)
    own = primitive(tree, start, period)
    if not own.any():
        return (np.zeros(0, np.int64),) * 3
    node, size = vocabulary(tree, start[own], period[own])
    count = tree.high[node] - tree.low[node] + 1
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = tree.suffix[np.repeat(tree.low[node], count) + nth]
    key = np.sort(np.repeat(size // 2, count) * (tree.n + 1) + at)
    first = np.flatnonzero(np.append(True, np.diff(key) != 1))
    period, start = key[first] // (tree.n + 1), key[first] % (tree.n + 1)
    last = key[np.append(first[1:], len(key)) - 1] % (tree.n + 1)
    return start, last - start + 2 * period, period


def stretches(codes: np.ndarray, row: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words within rows that hold all runs: every three words in a row must come back in it.

    A run of so many periods, three words or more, holds each of its triples exponent - 1 times (fewer only if it has too few words).
    """
    least = max(exponent, least)
    n = len(codes)
    if n < least:
        return (np.zeros(0, np.int64),) * 2
    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    start, end = edge, np.append(edge[1:], n)
    start, end = (x[end - start >= least] for x in (start, end))
    if least < 4:
        return start, end
    often = max(1, min(exponent - 1, least - 2))
    while len(start):
        size = end - start
        own = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        whole = at + 2 < np.repeat(end, size)
        own, at = own[whole], at[whole]
        key = textops.mix(textops.mix(textops.mix(codes[at] + (own << 32)) + codes[at + 1].astype(np.uint64)) + codes[at + 2].astype(np.uint64))
        _, kind, count = np.unique(key, return_inverse=True, return_counts=True)
        good = count[kind] >= often
        ahead = np.append(False, (at[1:] == at[:-1] + 1) & (own[1:] == own[:-1]) & good[:-1])
        first = np.flatnonzero(good & ~ahead)
        behind = np.append(ahead[1:], False) & np.append(good[1:], False)
        last = np.flatnonzero(good & ~behind)
        a, b = at[first], at[last] + 3
        long = b - a >= least
        a, b = a[long], b[long]
        if (b - a).sum() > 0.95 * size.sum():
            return a, b
        start, end = a, b
    return start, end


def found_runs(codes: np.ndarray, row: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Runs (first word, length, period), by place, of rows of words that are given one after another."""
    a, b = stretches(codes, row, exponent, least)
    if not len(a):
        return np.zeros((0, 3), np.int64)
    size = b - a
    base = np.cumsum(size + 1) - size - 1
    s = np.empty(int(size.sum()) + len(size), np.int64)
    gap = base + size
    keep = np.ones(len(s), bool)
    keep[gap] = False
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    s[keep] = np.unique(codes[at], return_inverse=True)[1]
    s[gap] = s[keep].max() + 1 + np.arange(len(gap))
    start, length, period = runs(SuffixTree(s))
    long = length >= np.maximum(least, exponent * period)
    start, length, period = start[long], length[long], period[long]
    part = np.searchsorted(base, start, "right") - 1
    start = a[part] + start - base[part]
    return np.stack([start, length, period], axis=1)[np.lexsort([period, start])]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _rows(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, exponent: int, least: int) -> list[tuple]:
    """For each text of a slice: words, runs, and what is left when all periods but a run's first one go."""
    words = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(lo, hi)]
    n = np.array([len(w) for w in words])
    flat = [x for w in words for x in w]
    row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    found = found_runs(codes, row, exponent, least)
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    gone = np.cumsum(edge)[:-1] > 0
    own = row[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    ptr = np.searchsorted(own, np.arange(len(n) + 1))
    out = []
    for r, w in enumerate(words):
        mine = found[ptr[r] : ptr[r + 1]]
        if len(mine):
            keep = ~gone[first[r] : first[r] + n[r]]
            w = [w[k] for k in np.flatnonzero(keep).tolist()]
        out.append((int(n[r]), [{"start": a - int(first[r]), "length": b, "period": c} for a, b, c in mine.tolist()], b" ".join(w)))
    return out


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """For each row: doc_id, n_words, runs (array<struct<start,length,period>> by start, then period), collapsed.

    A run is a stretch of words with smallest period q and at least max(least, exponent * q) words (exponent 2 or more) that no
    neighbouring word extends. collapsed is the text's words, joined by blanks, without those that any run holds after its
    first q words. Words are what stands between ASCII white space. Null and empty texts have no words. Rows are kept as they are,
    repeated ones and null ids too; other columns are left out. A text is one step of work, in memory linear in its words
    that lie in repetitive stretches.
    """

    def run(batches):
        for batch in batches:
            data, offsets = textops.buffers(batch.column(1))
            found = [x for lo, hi in textops.slices(offsets) for x in _rows(data, offsets, lo, hi, exponent, least)]
            n, spans, left = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(_RUN)), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(textops.lean(run), fields)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tenth: bool = False) -> DataFrame:
    """doc_id and text, where about a tenth of the texts repeat from some word on, with a period that their id's crc32 tells.

    The place is the crc32 modulo the number of words; with tenth (op13's contract) a tenth of it, rounded down, is taken so.
    Null ids change nothing.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), h.alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    out = out.withColumn("w", F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.size("w")
    g = F.floor(F.col("h") / 10)
    a = ((g if tenth else F.col("h")) % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return out.select("doc_id", F.when(chosen & (n > 0), changed).otherwise(F.col("text")).alias("text"))


def strongest(spans: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of several the first."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    more = lambda s, x: s.isNull() | (x.length * s.period > s.length * x.period)
    return F.aggregate(spans, F.lit(None).cast(kind), lambda s, x: F.when(more(s, x), x).otherwise(s))


def report(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of periodic_runs()'s rows."""
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x.start, x.length, x.period), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long")
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
