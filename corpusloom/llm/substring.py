"""Substring dedup: content-defined windows by a gear rolling hash, deduplicated by digest.

A cut is a word start whose gear hash (over the bytes just before it) is the least within a radius, so cuts depend on
nearby bytes alone and come back right after an insertion. From each cut a variable chunk, the window, reaches to the
first cut that gives it a number of words. Windows are compared by digest over all documents: a repeated one is a run of
words that a single earlier text holds. Windows of one text that agree with the same source at the same distance form a
passage, which is grown by the source's bytes, over whole words. Passages of min_words words or more are cut out of all
but their first place, so nothing goes that no single earlier place holds as a whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import textops
from corpusloom.llm.rows import numbered, sized
from corpusloom.session import materialize

#: Bytes on both sides among which a cut's hash is the least, and bytes that the gear hash remembers.
RADIUS, WINDOW = 20, 8
#: Words that a window has at least: fewer where they are short, so that 50 words hold a window at any cut.
SEED_WORDS, SHORT_WORDS, SHORT_BYTES = 24, 16, 96
#: Words of a run of windows that is told as shared.
SHARED_WORDS = 25
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(1, 2**32, 256, dtype=np.uint32)
_b = np.arange(256)
_BLANK = (_b <= 32) | (_b == 127)
#: Characters of scripts without blanks, each a word: Thai, Lao, Burmese, Khmer, kana, Han.
_BLANKLESS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]
_NONE = np.uint32(0xFFFFFFFF)
#: Bytes of a source are asked for in blocks of 2^_BLOCK; so many blocks are broadcast at most.
_BLOCK, _BLOCK_ROWS = 6, 200_000
#: Largest values of the packed fields: bytes before and after a window, words beyond SHORT_WORDS.
_SIDE, _MORE = (1 << 12) - 1, (1 << 8) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i + width] at i, by doubling; windows end with the array."""
    have = 1
    while have * 2 <= width:
        y = x.copy()
        np.minimum(y[:-have], x[have:], out=y[:-have])
        x, have = y, have * 2
    rest = width - have
    if rest:
        y = x.copy()
        np.minimum(y[:-rest], x[rest:], out=y[:-rest])
        x = y
    return x


def cuts(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces between cuts in data, cut at row starts, and where each row's pieces begin in them."""
    n, k = len(data), len(rows) - 1
    pad = RADIUS + WINDOW
    of = np.repeat(np.arange(k), np.diff(rows))
    at = np.arange(n) + (of + 1) * pad
    total = n + (k + 1) * pad
    gear = np.zeros(total, np.uint32)
    gear[at] = _GEAR[data]
    have = 1
    while have < WINDOW:
        more = gear.copy()
        more[have:] += gear[:-have] << np.uint32(have)
        gear, have = more, have * 2
    # a cut may be at a word, or at any character of scripts without blanks
    blank = _BLANK[data]
    word = np.zeros(n, bool)
    if n:
        word[1:] = (blank[:-1] & ~blank[1:]) | (data[1:] >= 0xE0)
        word[rows[:-1][np.diff(rows) > 0]] = False
    score = np.full(total, _NONE)
    places = np.flatnonzero(word)
    spots = at[places]
    mixed = gear[spots - 1] * np.uint32(0x9E3779B1)
    score[spots] = np.minimum(mixed ^ (mixed >> np.uint32(15)), _NONE - np.uint32(1))
    left, right = _sliding_min(score, RADIUS), _sliding_min(score, RADIUS + 1)
    # ties cut too: text with a period within the radius is cut once a period, wherever its run begins
    best = (score[spots] <= left[spots - RADIUS]) & (score[spots] == right[spots])
    start = np.union1d(places[best], rows[:-1][np.diff(rows) > 0])
    end = np.append(start[1:], n) if len(start) else start
    return start, end, np.searchsorted(start, rows)


def word_starts(seg: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where a word begins: a run between blanks, a run of word bytes, or a character of a script without blanks.

    So a passage has no fewer words than by any of these counts.
    """
    first = np.zeros(len(seg), bool)
    edge = rows[:-1][np.diff(rows) > 0]
    for inside in (~_BLANK[seg], textops.WORD[seg]):
        if len(seg):
            begins = np.append(True, ~inside[:-1])
            begins[edge] = True
            first |= begins & inside
    lead = np.flatnonzero(seg >= 0xE0)
    if len(lead):
        b = [seg[np.minimum(lead + k, len(seg) - 1)].astype(np.int32) for k in range(3)]
        code = (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
        alone = (b[0] == 0xF0) & (b[1] >= 0xA0)
        for lo, hi in _BLANKLESS:
            alone |= (b[0] < 0xF0) & (code >= lo) & (code <= hi)
        first[lead[alone]] = True
    return first


_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def windows(column: pa.Array):
    """For each slice of rows: row, digest, packed place and shape of its windows; and a digest of each whole text.

    at: first byte << 32 | words before it. shape: bytes << 32, and 12 bits of the bytes before and 12 of those after it
    to which a source can agree where the windows beside it do not (a cut further off would agree too), and 8 bits of its
    words beyond SHORT_WORDS.
    """
    data, offsets = textops.buffers(column)
    for lo, hi in textops.slices(offsets):
        seg, rows = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end, ptr = cuts(seg, rows)
        up, down = _powers(len(start))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.hash_spans(seg, start, end) * up[:-1])])
        whole = textops.mix((prefix[ptr[1:]] - prefix[ptr[:-1]]) * down[ptr[:-1]] + np.diff(rows).astype(np.uint64))
        total = np.concatenate([[0], np.cumsum(word_starts(seg, rows))])
        of = np.repeat(np.arange(hi - lo), np.diff(ptr))
        last, soon = (np.searchsorted(total[end], total[start] + n) if len(start) else start for n in (SEED_WORDS, SHORT_WORDS))
        close = np.minimum(soon, len(end) - 1)
        last = np.where((soon < ptr[1:][of]) & (end[close] - start <= SHORT_BYTES), soon, last)
        # no window reaches beyond the end of one that begins in it
        last = np.minimum.accumulate(last[::-1])[::-1]
        some = np.flatnonzero(last < ptr[1:][of])
        last, of = last[some], of[some]
        digest = textops.mix((prefix[last + 1] - prefix[some]) * down[some] + (last - some).astype(np.uint64))
        a, b, head, tail = start[some], end[last], rows[:-1][of], rows[1:][of]
        before = np.minimum(a - head, a - start[np.maximum(some - 1, ptr[:-1][of])] + RADIUS + WINDOW)
        after = tail - b
        after[:-1] = np.where(of[1:] == of[:-1], np.minimum(after[:-1], b[1:] - b[:-1] + RADIUS + 1), after[:-1])
        more = total[b] - total[a] - SHORT_WORDS
        at = (a - head) << 32 | (total[a] - total[head])
        shape = (b - a) << 32 | np.minimum(before, _SIDE) << 20 | np.minimum(after, _SIDE) << 8 | np.minimum(more, _MORE)
        yield hi - lo, of, digest, at, shape, whole


_WIN = pa.struct([("digest", pa.int64()), ("at", pa.int64()), ("shape", pa.int64())])
_SELF = pa.struct([("at", pa.int64()), ("shape", pa.int64()), ("place", pa.int64())])


def _sketch(column: pa.Array) -> dict[str, pa.Array]:
    """content (a digest of the text), wins (each digest's first window) and again (later ones, with their first place)."""
    out: dict[str, list] = {k: [] for k in ("content", "n_wins", "n_again", "digest", "at", "shape", "at2", "shape2", "place")}
    for rows, of, digest, at, shape, whole in windows(column):
        order = np.lexsort((at, digest, of))
        d, r = digest[order], of[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(d) else order
        is_first, source = np.zeros(len(d), bool), np.zeros(len(d), np.int64)
        is_first[order], source[order] = new, first
        for key, value in (("content", whole.view(np.int64)), ("n_wins", np.bincount(of[is_first], minlength=rows)), ("n_again", np.bincount(of[~is_first], minlength=rows)), ("digest", digest[is_first].view(np.int64)), ("at", at[is_first]), ("shape", shape[is_first]), ("at2", at[~is_first]), ("shape2", shape[~is_first]), ("place", at[source[~is_first]] >> 32)):
            out[key].append(value)
    flat = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    lists = lambda n, kind, names: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat[n])]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[x]) for x in names], fields=list(kind)))
    return {"content": pa.array(flat["content"]), "wins": lists("n_wins", _WIN, ("digest", "at", "shape")), "again": lists("n_again", _SELF, ("at2", "shape2", "place"))}


def _unpacked(at: np.ndarray, shape: np.ndarray, source: np.ndarray, place: np.ndarray) -> list[tuple]:
    """(first byte, end, words before, words to its end, bytes before, bytes after, source, shift to the place there) of windows."""
    first, words = at >> 32, at & 0xFFFFFFFF
    columns = (first, first + (shape >> 32), words, words + SHORT_WORDS + (shape & _MORE), shape >> 20 & _SIDE, shape >> 8 & _SIDE, source, place - first)
    return list(zip(*(c.tolist() for c in columns), strict=True))


def _regions(wins: list[tuple]):
    """Windows (_unpacked) in stretches that they cover without a gap."""
    now: list[tuple] = []
    reach = 0
    for w in sorted(wins):
        if now and w[0] > reach:
            yield now
            now, reach = [], 0
        now.append(w)
        reach = max(reach, w[1])
    if now:
        yield now


def passages(wins: list[tuple], min_words: int):
    """(source, shift, pieces, low, high): pieces [a, b) that agree with the source `shift` bytes further on, and the
    bounds within which that can go on. Stretches too short for min_words are left out."""
    for region in _regions(wins):
        least, most = min(w[0] - w[4] for w in region), max(w[1] + w[5] for w in region)
        if max(w[3] for w in region) - region[0][2] + (region[0][0] - least + most - max(w[1] for w in region)) // 2 + 2 < min_words:
            continue
        starts, counts = [w[0] for w in region], [w[2] for w in region]
        groups: dict[tuple, list[list[list[int]]]] = {}
        for a, b, w0, w1, _, _, source, shift in region:
            own = groups.setdefault((source, shift), [])
            if own and a <= own[-1][-1][1]:
                piece = own[-1][-1]
                piece[1], piece[3] = max(piece[1], b), max(piece[3], w1)
            elif own and w0 - own[-1][-1][3] <= min_words:
                own[-1].append([a, b, w0, w1])
            else:
                own.append([[a, b, w0, w1]])
        for (source, shift), parts in groups.items():
            for pieces in parts:
                i = bisect_right(counts, pieces[0][2] - min_words) - 1
                j = bisect_left(counts, pieces[-1][3] + min_words)
                low = starts[i] if i >= 0 else least
                high = max(starts[j], pieces[-1][1]) if j < len(starts) else most
                yield source, shift, [(p[0], p[1]) for p in pieces], max(low, -shift, 0), high


def _gaps(pieces: list[tuple[int, int]], low: int, high: int):
    edges = [low, *(x for p in pieces for x in p), high]
    return [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if x < y]


def _fields(column: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row offsets and the fields of a list column of structs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    counts = column.value_lengths().fill_null(0).to_numpy()
    return np.concatenate([[0], np.cumsum(counts)]), [flat.field(flat.type.get_field_index(x)).to_numpy() for x in names]


_PART = pa.struct([("source", pa.int64()), ("shift", pa.int64()), ("pieces", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
_SPANS_SQL = "array<struct<start:bigint,end:bigint,words:bigint>>"
_WANT = pa.struct([("source", pa.int64()), ("block", pa.int64())])
_PLAN_SQL = f"ord long, parts array<struct<source:bigint,shift:bigint,pieces:array<bigint>,low:bigint,high:bigint>>, runs {_SPANS_SQL}, want array<struct<source:bigint,block:bigint>>"


def _plans(min_words: int):
    def run(batches):
        """For ord, found: passages that earlier texts may hold, runs of windows that others hold, and the blocks of earlier texts to
        compare (-1 names the text alone)."""
        for batch in batches:
            own = batch.column(0).to_numpy()
            ptr, (at, shape, first, place) = _fields(batch.column(1), "at", "shape", "first", "place")
            parts, runs, want = [], [], []
            for i, mine in enumerate(own.tolist()):
                cut = slice(ptr[i], ptr[i + 1])
                wins = _unpacked(at[cut], shape[cut], first[cut], place[cut] >> 32)
                spans = [(w[0][0], max(x[1] for x in w), max(x[3] for x in w) - w[0][2]) for w in _regions(wins)]
                runs.append([{"start": a, "end": b, "words": n} for a, b, n in spans if n >= SHARED_WORDS])
                found = list(passages([w for w in wins if w[6] != mine], min_words))
                parts.append([{"source": s, "shift": d, "pieces": [a << 32 | b for a, b in pieces], "low": low, "high": high} for s, d, pieces, low, high in found])
                asked = {(s, -1) for s, *_ in found}
                for s, d, pieces, low, high in found:
                    asked |= {(s, k) for x, y in _gaps(pieces, low, high) for k in range(x + d >> _BLOCK, (y + d - 1 >> _BLOCK) + 1)}
                want.append([{"source": s, "block": k} for s, k in asked])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(_PART)), pa.array(runs, _SPANS), pa.array(want, pa.list_(_WANT))], ["ord", "parts", "runs", "want"])

    return run


def _blocks(batches):
    """For (source, id, text, blocks): the bytes of each block."""
    for batch in batches:
        of, block, data = [], [], []
        for i, (text, blocks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            raw = text.encode()
            of += [i] * len(blocks)
            block += blocks
            data += [raw[k << _BLOCK : k + 1 << _BLOCK] if k >= 0 else b"" for k in blocks]
        at = pa.array(of, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(block, pa.int64()), pa.array(data, pa.binary())], ["source", "id", "block", "bytes"])


def _grown(text: bytes, fetch, shift: int, pieces: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Maximal stretches around the pieces that agree byte by byte with what fetch(from, to) gives, shift bytes further on."""
    same = lambda x, y: len(commonprefix([x, y]))
    a, b = pieces[0]
    a -= same(text[low:a][::-1], fetch(low + shift, a + shift)[::-1])
    out = []
    for x, y in pieces[1:]:
        mine, other = text[b:x], fetch(b + shift, x + shift)
        if mine != other:
            out.append((a, b + same(mine, other)))
            a = x - same(mine[::-1], other[::-1])
        b = y
    return [*out, (a, b + same(text[b:high], fetch(b + shift, high + shift)))]


def _trimmed(data: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """[a, b) without partial words at either end."""
    while a < b and not (a == 0 or _BLANK[data[a - 1]] or data[a] >= 0xE0):
        a += 1
    while b > a and not (b == len(data) or _BLANK[data[b - 1]] or _BLANK[data[b]] or data[b] >= 0xE0):
        b -= 1
    return a, b


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _clean(text: bytes, parts: list[dict], runs: list[dict], inside: list[tuple], around: list[dict], min_words: int):
    """Kept bytes, removed and shared spans (start, end, words), and the ids that removed passages come from."""
    data = np.frombuffer(text, np.uint8)
    total = np.concatenate([[0], np.cumsum(word_starts(data, np.array([0, len(data)])))])
    held: dict[int, dict[int, bytes]] = {}
    for x in around:
        held.setdefault(x["source"], {})[x["block"]] = x["bytes"]

    def fetcher(source):
        if source is None:
            return lambda x, y: text[x:y]
        blocks = held[source]
        return lambda x, y: b"".join(blocks[k] for k in range(x >> _BLOCK, (y - 1 >> _BLOCK) + 1))[x & (1 << _BLOCK) - 1 :][: y - x] if y > x else b""

    ids = {x["source"]: x["id"] for x in around}
    found = [(p["source"], p["shift"], [(x >> 32, x & 0xFFFFFFFF) for x in p["pieces"]], p["low"], p["high"]) for p in parts]
    removed, sources = [], set()
    for source, shift, pieces, low, high in [*found, *passages(inside, min_words)]:
        for a, b in _grown(text, fetcher(source), shift, pieces, low, min(high, len(text))):
            a, b = _trimmed(data, a, b)
            if total[b] - total[a] >= min_words:
                removed.append((a, b))
                if source is not None and ids[source] is not None:
                    sources.add(ids[source])
    removed = _union(removed)
    again = [(w[0][0], max(x[1] for x in w)) for w in _regions(inside)]
    shared = _union(removed + [(x["start"], x["end"]) for x in runs] + [(a, b) for a, b in again if total[b] - total[a] >= SHARED_WORDS])
    kept, at = [], 0
    for a, b in removed:
        kept.append(text[at:a])
        at = b
    told = lambda spans: [{"start": a, "end": b, "words": int(total[b] - total[a])} for a, b in spans]
    return b"".join([*kept, text[at:]]), told(removed), told(shared), sorted(sources)


def _ordered(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Written (rid, ord, id): ord follows the ids, nulls last, then the texts' digests and the other columns.

    So it does not depend on how the table is laid out; rows alike in all columns are alike in their results too.
    """
    row = rows.schema["row"].dataType
    others = [F.col(f"row.`{f.name}`") for f in row.fields if f.name != text and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    own = F.col(f"row.`{doc_id}`")
    keys = rows.select("rid", own.isNull().alias("none"), own.alias("id"), "content", F.xxhash64(F.lit(1), *others).alias("rest"))

    def number(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(at, at + len(batch)), pa.int64()), batch.column(1)], ["rid", "ord", "id"])
            at += len(batch)

    kind = row[doc_id].dataType.simpleString()
    return materialize(keys.orderBy("none", "id", "content", "rest", "rid").select("rid", "id").mapInArrow(number, f"rid long, ord long, id {kind}"), "order")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """row (a struct of all columns), kept_text, removed, shared, sources for each row of docs.

    removed are the byte spans (start, end, words) of min_words words or more that one earlier row holds, or the same row
    further up; kept_text is the text without them. Earlier is a smaller id (nulls last), and for equal ids a smaller digest
    of the text, whatever the layout of the table. shared adds runs of repeated windows, first places too, of SHARED_WORDS
    words or more. sources are the sorted ids of the rows that removed passages were found in. Words are counted at blanks,
    at punctuation and by characters of scripts without blanks, whichever begins one. A null text stays null and is in
    nothing; shorter texts are left alone, repeated or not. Ids may be null, repeated or of any type that sorts.

    A passage is found if a window in it (24 words from a cut on, 16 short ones) stands first in a row that holds min_words words of it.
    Digests have 64 bits; what is beyond the windows is compared byte by byte.
    """
    rows = numbered(docs, text, _sketch, "content long, wins array<struct<digest:bigint,at:bigint,shape:bigint>>, again array<struct<at:bigint,shape:bigint,place:bigint>>")
    order = _ordered(rows, doc_id, text)
    few = sized(order)
    each = rows.where(F.size("wins") > 0).select("rid", "wins").join(few.select("rid", "ord"), "rid").select("ord", F.inline("wins"))
    repeated = each.groupBy("digest").agg(F.min("ord").alias("first"), F.min_by("at", "ord").alias("place"), F.count("*").alias("n")).where("n > 1").select("digest", "first", "place")
    found = each.join(materialize(repeated, "repeated"), "digest").groupBy("ord").agg(F.collect_list(F.struct("at", "shape", "first", "place")).alias("found"))
    plans = materialize(found.mapInArrow(textops.lean(_plans(min_words)), _PLAN_SQL), "plans")
    asked = plans.select("ord", F.inline("want"))
    # a row is asked for each of its blocks once, however many want it
    owners = asked.select("source", "block").distinct().groupBy("source").agg(F.collect_list("block").alias("blocks"))
    owners = materialize(owners.join(few.select(F.col("ord").alias("source"), "rid", "id"), "source"), "owners")
    texts = rows.select("rid", F.col(f"row.`{text}`").alias("text")).join(sized(owners), "rid").select("source", "id", "text", "blocks")
    kind = rows.schema["row"].dataType
    id_kind = kind[doc_id].dataType
    blocks = materialize(texts.mapInArrow(textops.lean(_blocks), f"source long, id {id_kind.simpleString()}, block long, bytes binary"), "blocks")
    near = asked.join(sized(blocks, _BLOCK_ROWS), ["source", "block"]).groupBy("ord").agg(F.collect_list(F.struct("source", "id", "block", "bytes")).alias("around"))
    told = plans.where(F.size("parts") + F.size("runs") > 0).select("ord", "parts", "runs").join(near, "ord", "left").join(few.select("ord", "rid"), "ord")
    joined = rows.select("row", "rid", "again").join(told, "rid", "left")
    id_type = to_arrow_type(id_kind)

    def clean(batches):
        for batch in batches:
            row, column = batch.column(0), batch.column(0).field(batch.column(0).type.get_field_index(text))
            ptr, (at, shape, place) = _fields(batch.column(1), "at", "shape", "place")
            texts, removed, common, sources = [], [], [], []
            for i, value in enumerate(column):
                parts, runs = batch.column(2)[i].as_py() or [], batch.column(3)[i].as_py() or []
                kept, gone, both, origin = value.as_py(), [], runs, []
                if parts or ptr[i] < ptr[i + 1]:
                    cut = slice(ptr[i], ptr[i + 1])
                    inside = [(*w[:6], None, w[7]) for w in _unpacked(at[cut], shape[cut], at[cut], place[cut])]
                    kept, gone, both, origin = _clean(kept.encode(), parts, runs, inside, batch.column(4)[i].as_py() or [], min_words)
                    kept = kept.decode()
                texts.append(kept)
                removed.append(gone)
                common.append(both)
                sources.append(origin)
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string()), pa.array(removed, _SPANS), pa.array(common, _SPANS), pa.array(sources, pa.list_(id_type))], ["row", "kept_text", "removed", "shared", "sources"])

    fields = f"row {kind.simpleString()}, kept_text string, removed {_SPANS_SQL}, shared {_SPANS_SQL}, sources array<{id_kind.simpleString()}>"
    return joined.select("row", "again", "parts", "runs", "around").mapInArrow(textops.lean(clean), fields)


def deduplicated(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs with their columns and kept texts; rows of which nothing but blanks is left go."""
    out = substring_dedup(docs, text=text, **options)
    emptied = (F.size("removed") > 0) & (F.trim(F.regexp_replace("kept_text", r"\s+", " ")) == "")
    columns = [F.col("kept_text").alias(text) if c == text else F.length("kept_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*columns)
