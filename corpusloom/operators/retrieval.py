"""Retrieval over a batch of queries: BM25 postings, vector legs, rank fusion and evaluation. A batch is one plan."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.stem import STEP_2, STEP_3, STEP_4, stem
from corpusloom.operators.chunking import chunk_id
from corpusloom.operators.corpus import spread
from corpusloom.operators.registry import query
from corpusloom.plans.nearest import nearest_rows
from corpusloom.session import lean, materialize, sized, small_batches

#: Beside okapi's, which is for groups alone: see within().
BM25_STYLES = {
    "log1p": lambda n, df: F.log(1 + (n - df + 0.5) / (df + 0.5)),
    "floor": lambda n, df: F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6)),
}
#: Words of two letters or more.
LONGER = r"[\p{L}\p{N}_]{2,}"


def postings(texts: DataFrame, key: str, pattern: str = T.WORD) -> DataFrame:
    """(term, key, tf, len): counted on the map side before the one shuffle."""
    words = texts.select(key, T.found(F.lower("text"), pattern).alias("w"))
    return words.select(key, F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("term", key, "len").agg(F.count("*").alias("tf"))


#: Words as the stemmed index cuts them: letters and digits.
ALNUM = r"[^\W_]+"
#: Words whose stems a worker remembers.
_STEMS = 200_000


def counted(texts: DataFrame, keys: tuple[str, ...], pattern: str, terms: set[str] | None, stemmed: bool = False) -> DataFrame:
    """keys, len and terms (term, tf) of each text, one row a text: words are counted inside the row, so no word is shuffled.
    With terms, others are left out of the counts, not of len. stemmed: terms are the words' stems; a worker stems each distinct
    word once."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        found = regex.compile(pattern).findall if "\\p" in pattern and pattern != T.WORD else re.compile(r"\w+" if pattern == T.WORD else pattern).findall
        wanted, known = sent.value, {}
        kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

        def stems(words):
            out = Counter()
            for word, tf in Counter(words).items():
                if word not in known:
                    if len(known) >= _STEMS:
                        known.clear()
                    known[word] = stem(word)
                out[known[word]] += tf
            return out if wanted is None else {t: tf for t, tf in out.items() if t in wanted}

        for batch in batches:
            sizes, terms, tfs, ptr = [], [], [], [0]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = found(text) if text else []
                n = stems(words) if stemmed else Counter(words if wanted is None else filter(wanted.__contains__, words))
                sizes.append(len(words))
                terms += n.keys()
                tfs += n.values()
                ptr.append(len(terms))
            lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), lists], [*keys, "len", "terms"])

    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    small_batches(texts.sparkSession)
    return texts.select(*keys, F.lower("text").alias("#text")).mapInArrow(lean(run), f"{fields}, len long, terms array<struct<term:string,tf:bigint>>")


#: Cells of texts x queries, and meetings of a text's terms with queries, that a worker holds at a time: its memory doesn't follow the queries.
_CELLS = 1 << 20


def _best(scores: np.ndarray, most: int | None) -> np.ndarray:
    """Which scores (texts x queries) may be among a query's best `most`; a little more, as later rounding makes ties."""
    hit = scores > 0
    if most is not None and len(scores) > most:
        hit &= scores >= np.partition(scores, len(scores) - most, axis=0)[len(scores) - most] - 2e-6
    return hit


def scored(rows: DataFrame, keys: tuple[str, ...], query_id: str, stated: list, kind: str, avgdl: float, k1: float, b: float, most: int | None) -> DataFrame:
    """(query_id, keys, score) from counted() rows and a batch's (query, term, idf): scores of a text are summed where it is, so no
    posting is shuffled; with most, a task returns no more than the best of what it holds. Queries meet a batch of texts by blocks."""
    queries = sorted({q for q, _, _ in stated})
    number, terms = {q: i for i, q in enumerate(queries)}, {}
    for q, term, idf in stated:
        terms.setdefault(term, (idf, []))[1].append(number[q])
    # term and query as one number, in order: the queries of a block that have a term are a range
    pairs = np.array([i * len(queries) + q for i, (_, x) in enumerate(terms.values()) for q in sorted(x)], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((queries, {t: i for i, t in enumerate(terms)}, pairs, np.array([idf for idf, _ in terms.values()])))

    def run(batches):
        queries, number, pairs, idf = sent.value
        ids = pa.array(queries)
        for batch in batches:
            lists = batch.column(len(keys) + 1)
            flat = lists.flatten()
            term = np.array([number.get(x, -1) for x in flat.field(0).to_pylist()], np.int64)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            tf, size = flat.field(1).to_numpy().astype(float), batch.column(len(keys)).to_numpy().astype(float)
            known = term >= 0
            term, row, tf = term[known], row[known], tf[known]
            weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / avgdl))
            # the batch's terms, or all where they are fewer than its postings
            own, at = (np.arange(len(idf)) * len(queries), term) if len(idf) <= len(term) else np.unique(term * len(queries), return_inverse=True)
            width = max(1, _CELLS // max(1, len(batch)))
            for low in range(0, len(queries), width):
                high = min(low + width, len(queries))
                first = np.searchsorted(pairs, own + low)
                n = np.searchsorted(pairs, own + high) - first
                first, n = first[at], n[at]
                total = np.cumsum(n)
                place = row * (high - low) - own[at] - low
                scores = np.zeros(len(batch) * (high - low))
                start = 0
                while start < len(n):
                    # as many terms as meet _CELLS queries, one at least; sums grow in the order of the terms
                    end = max(start + 1, int(np.searchsorted(total, total[start] - n[start] + _CELLS, "right")))
                    some = n[start:end]
                    of = np.repeat(np.arange(start, end), some)
                    ask = pairs[np.repeat(first[start:end] - (np.cumsum(some) - some), some) + np.arange(len(of))]
                    np.add.at(scores, place[of] + ask, weight[of])
                    start = end
                scores = scores.reshape(len(batch), -1)
                x, q = np.nonzero(_best(scores, most))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + low)), *(batch.column(i).take(pa.array(x)) for i in range(len(keys))), pa.array(scores[x, q])], [query_id, *keys, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    small_batches(rows.sparkSession)
    return rows.mapInArrow(lean(run), f"`{query_id}` {kind}, {fields}, score double").withColumn("score", F.round("score", 6))


def okapi(texts: list, asked: list, k1: float, b: float, found) -> list[tuple]:
    """(query, key, score) of the matches of (query, term) among a group's (key, text); found gives a text's words. A term of more than
    half of the texts gets a quarter of the mean IDF over all terms. Texts of one key and length count as one, as in a grouping by both."""
    sizes, merged, df = [], {}, Counter()
    for key, text in texts:
        n = Counter(found(text or ""))
        sizes.append(n.total())
        if (held := merged.setdefault((key, sizes[-1]), n)) is not n:
            held.update(n)
    for n in merged.values():
        df.update(n.keys())
    raw = {n: math.log((len(texts) - n + 0.5) / (n + 0.5)) for n in set(df.values())}
    low = 0.25 * sum(raw[n] * k for n, k in Counter(df.values()).items()) / max(1, len(df))
    wanted: dict[str, list] = {}
    for (q, t), times in Counter(asked).items():
        if t in df:
            wanted.setdefault(t, []).append((q, times * (low if raw[df[t]] < 0 else raw[df[t]])))
    scores: dict[tuple, float] = {}
    for (key, size), n in merged.items():
        norm = k1 * (1 - b + b * size * len(sizes) / max(1, sum(sizes)))
        # a query may be as long as its texts
        for t in n.keys() & wanted.keys():
            for q, weight in wanted[t]:
                scores[q, key] = scores.get((q, key), 0.0) + weight * n[t] * (k1 + 1) / (n[t] + norm)
    return [(q, key, score) for (q, key), score in scores.items()]


def within(groups: DataFrame, query_id: str, k1: float, b: float, pattern: str, cut: tuple[int, int] | None = None) -> DataFrame:
    """(group columns, query_id, key, score) of the matches of each group's queries in its own texts, by okapi(). groups: any columns,
    then texts (array of key, a string, and lower-case text; with cut a whole text, whose windows of that size and overlap have their
    number as key) and asked (array of query and term). A group is a row, so its statistics need no shuffle."""
    keys = groups.columns[:-2]
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    query, key = groups.schema["asked"].dataType.elementType["query"].dataType.simpleString(), "int" if cut else "string"

    def run(batches):
        # as \w is letters, numbers and the underscore
        found = re.compile(pattern.replace(r"[\p{L}\p{N}_]", r"\w")).findall
        for batch in batches:
            out = []
            for row, (texts, asked) in enumerate(zip(*batch.columns[-2:], strict=True)):
                texts = texts.as_py()
                if cut:
                    size, step = cut[0], cut[0] - cut[1]
                    texts = [(i, texts[i * step : i * step + size].lower()) for i in range(1 + max(0, -((size - len(texts)) // step)))]
                else:
                    texts = [(x["key"], x["text"]) for x in texts]
                out += [(row, *x) for x in okapi(texts, list(zip(*(asked.values.field(i).to_pylist() for i in range(2)), strict=True)), k1, b, found)]
            row, q, place, score = zip(*out, strict=True) if out else ((), (), (), ())
            own = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(q, batch.schema.field(len(keys) + 1).type.value_type.field("query").type), pa.array(place, pa.int32() if cut else pa.string()), pa.array(score, pa.float64())], [*keys, query_id, "key", "score"])

    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    small_batches(groups.sparkSession)
    return groups.mapInArrow(lean(run), f"{fields}, `{query_id}` {query}, key {key}, score double").withColumn("score", F.round("score", 6))


#: Distinct terms, and pairs of query and term, of a batch of queries that are sent to the words; more of them are joined.
_TERMS, _ASKED = 500_000, 2_000_000


def bm25(texts: DataFrame, key: str, queries: DataFrame, query_id: str, k1: float = 1.2, b: float = 0.75, style: str = "log1p", pattern: str = T.WORD, prefix: tuple[str, ...] = (), carry: tuple[str, ...] = (), most: int | None = None, stemmed: bool = False) -> DataFrame:
    """(query_id, key, carry, score) of every match; queries has (query_id, term); a term that a query has twice counts twice. With prefix columns, both sides are
    partitioned by them and statistics are per partition: the texts of one meet as a row. Without, texts are read once, into a
    written table of counts. With most, matches that can't be among a query's best so many may be left out."""
    if prefix:
        if stemmed or carry or style != "okapi":
            raise ValueError("within groups: okapi, unstemmed, the key alone")
        by = texts.groupBy(*prefix).agg(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.lower("text").alias("text"))).alias("texts"))
        asked = queries.groupBy(*prefix).agg(F.collect_list(F.struct(F.col(query_id).alias("query"), "term")).alias("asked"))
        return within(by.join(asked, list(prefix)), query_id, k1, b, pattern).select(*prefix, query_id, F.col("key").cast(texts.schema[key].dataType).alias(key), "score")
    few = [r.term for r in queries.select("term").distinct().limit(_TERMS + 1).collect()]
    terms = set(few) if len(few) <= _TERMS else None
    rows = materialize(counted(texts, (key, *carry), pattern, terms, stemmed), "counted")
    stats = rows.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"))
    post = rows.select(key, *carry, "len", F.inline("terms"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    stated = queries.join(df, "term").join(F.broadcast(stats), F.lit(True))
    if terms is not None:
        # a batch of queries goes to the counts
        found = stated.select(query_id, "term", BM25_STYLES[style](F.col("N"), F.col("df")).alias("idf"), "avgdl").limit(_ASKED + 1).collect()
        if len(found) <= _ASKED:
            return scored(rows, (key, *carry), query_id, [(r[0], r[1], r[2]) for r in found], queries.schema[query_id].dataType.simpleString(), found[0].avgdl if found else 1.0, k1, b, most)
    tf, norm = F.col("tf"), 1 - b + b * F.col("len") / F.col("avgdl")
    weight = BM25_STYLES[style](F.col("N"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * norm)
    return post.join(stated, "term").groupBy(query_id, key, *carry).agg(F.round(F.sum(weight), 6).alias("score"))


def ranked(hits: DataFrame, by: str, key: str, k: int, score: str = "score") -> DataFrame:
    """Best k per query with rank from 1; ties by key. A window group limit keeps k rows a task before the shuffle."""
    if k <= 0:
        raise ValueError("limit must be positive")
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_per_document(hits: DataFrame, by: str, document: str) -> DataFrame:
    w = Window.partitionBy(by, document).orderBy("rank")
    return hits.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def rrf(legs: DataFrame, by: str, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (by, key, leg, rank)."""
    return legs.groupBy(by, key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))


def weighted_fusion(left: DataFrame, right: DataFrame, by: str, key: str, wl: float = 0.5, wr: float = 0.5) -> DataFrame:
    """Scores scaled to [0, 1] per query and leg (equal scores: 1) and summed by weight; a missing leg counts 0."""

    def scaled(leg: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(by)
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        return leg.select(by, key, F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)).alias(name))

    both = scaled(left, "l").join(scaled(right, "r"), [by, key], "full")
    return both.select(by, key, F.round(wl * F.coalesce("l", F.lit(0.0)) + wr * F.coalesce("r", F.lit(0.0)), 6).alias("score"))


def in_blocks(queries: DataFrame, key: str, block: int = 20_000) -> list[DataFrame]:
    """Queries dealt by hash to parts of about `block` rows at most: each part is small enough to be sent to all tasks."""
    n = max(1, -(-queries.count() // block))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


# Queries


def items(c, pattern: str = T.WORD, most: int | None = None) -> DataFrame:
    """(item_id, term) of the benchmark's items."""
    words = F.array_distinct(T.found(F.lower("text"), pattern))
    return c.table("benchmark").select("item_id", F.explode(F.slice(words, 1, most) if most else words).alias("term"))


def _bm25_cte(style: str, k1: float, b: float, word: str = T.WORD, most: int | None = None) -> str:
    idf = "ln(1 + (n - df + 0.5) / (df + 0.5))" if style == "log1p" else "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"
    qw = f"list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, {most or 100000})"
    return f"""q AS (SELECT item_id, unnest({qw}) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '{word}') AS w FROM benchmark)),
tk AS (SELECT chunk_id, regexp_extract_all(lower(text), '{word}') AS w FROM chunks), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk),
po AS (SELECT term, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
lex AS (SELECT item_id, chunk_id, round(sum({idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / avgdl))), 6) AS score FROM q JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def stemmed_items(c, table: str = "benchmark", key: str = "item_id") -> DataFrame:
    """(item_id, term) of the items' stemmed words, each as often as the item has it."""
    words = counted(c.table(table).select(key, "text"), (key,), ALNUM, None, stemmed=True)
    return words.select(key, F.inline("terms")).select(key, "term", F.explode(F.sequence(F.lit(1), F.col("tf").cast("int"))).alias("n")).drop("n")


def _porter_sql() -> str:
    """stems (w, t) of words (w) in SQL: measures as patterns, one common table expression a step."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    some, more, vowel, short = f"^({c})?{v}{c}", f"^({c})?{v}{c}{v}{c}", f"^({c})?[aeiouy]", f"^{c}[aeiouy][^aeiouwxy]$"
    one = f"^({c})?{v}{c}({v})?$"
    cut = lambda n: f"left(x, length(x) - {n})"

    def step(rules: dict[str, str], test: str) -> str:
        each = sorted(rules, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN length(x) > {len(k)} AND ends_with(x, '{k}') THEN CASE WHEN regexp_matches({cut(len(k))}, '{test}'){' AND right(' + cut(3) + ', 1) IN (chr(115), chr(116))' if k == 'ion' else ''} THEN {cut(len(k))} || '{rules[k]}' ELSE x END" for k in each) + " ELSE x END"

    fixed = f"CASE WHEN length(x) > 2 AND right(x, 2) IN ('at', 'bl', 'iz') THEN x || 'e' WHEN length(x) > 1 AND right(x, 1) = left(right(x, 2), 1) AND right(x, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN {cut(1)} WHEN regexp_matches(x, '{one}') AND regexp_matches(x, '{short}') THEN x || 'e' ELSE x END"
    steps = [
        f"CASE WHEN length(x) > 4 AND ends_with(x, 'sses') OR length(x) > 3 AND ends_with(x, 'ies') THEN {cut(2)} WHEN length(x) > 2 AND ends_with(x, 'ss') THEN x WHEN length(x) > 1 AND ends_with(x, 's') THEN {cut(1)} ELSE x END",
        # a bar marks a word that lost ed or ing
        f"CASE WHEN length(x) > 3 AND ends_with(x, 'eed') THEN CASE WHEN regexp_matches({cut(3)}, '{some}') THEN {cut(1)} ELSE x END WHEN length(x) > 2 AND ends_with(x, 'ed') THEN CASE WHEN regexp_matches({cut(2)}, '{vowel}') THEN '|' || {cut(2)} ELSE x END WHEN length(x) > 3 AND ends_with(x, 'ing') THEN CASE WHEN regexp_matches({cut(3)}, '{vowel}') THEN '|' || {cut(3)} ELSE x END ELSE x END",
        f"CASE WHEN f THEN {fixed} ELSE x END",
        f"CASE WHEN ends_with(x, 'y') AND regexp_matches({cut(1)}, '{vowel}') THEN {cut(1)} || 'i' ELSE x END",
        step(STEP_2, some), step(STEP_3, some), step(dict.fromkeys(STEP_4, ""), more),
        f"CASE WHEN ends_with(x, 'e') AND (regexp_matches({cut(1)}, '{more}') OR regexp_matches({cut(1)}, '{one}') AND NOT regexp_matches({cut(1)}, '{short}')) THEN {cut(1)} ELSE x END",
        f"CASE WHEN ends_with(x, 'll') AND regexp_matches({cut(1)}, '{more}') THEN {cut(1)} ELSE x END",
    ]
    out = ["p0 AS (SELECT w, CASE WHEN starts_with(w, 'y') THEN 'Y' || substr(w, 2) ELSE w END AS x FROM words WHERE strlen(w) BETWEEN 3 AND 64)"]
    barred = "(SELECT w, starts_with(x, '|') AS f, ltrim(x, '|') AS x FROM p2)"
    out += [f"p{i + 1} AS (SELECT w, {s} AS x FROM {barred if i == 2 else f'p{i}'})" for i, s in enumerate(steps)]
    return ", ".join(out) + f", stems AS (SELECT w, replace(x, 'Y', 'y') AS t FROM p{len(steps)} UNION ALL SELECT w, w FROM words WHERE strlen(w) NOT BETWEEN 3 AND 64)"


_FTS = f"""tw AS (SELECT chunk_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS v FROM chunks), qt AS (SELECT item_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark),
words AS (SELECT DISTINCT unnest(v) AS w FROM tw UNION SELECT w FROM qt), {_porter_sql()},
q AS (SELECT item_id, t AS term FROM qt JOIN stems USING (w)), st AS (SELECT count(*) AS n, avg(len(v)) AS avgdl FROM tw),
po AS (SELECT t AS term, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(v) AS len, unnest(v) AS w FROM tw) JOIN stems USING (w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
lex AS (SELECT item_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL)"""


@query("ret_01", f"WITH base, {_FTS} SELECT item_id, chunk_id, score FROM lex QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 10")
def ret_01(c):
    """OR semantics over stemmed words without accents, IDF with a floor; a word that a question repeats counts again."""
    return ranked(bm25(c.chunks, "chunk_id", stemmed_items(c), "item_id", style="floor", pattern=ALNUM, most=10, stemmed=True), "item_id", "chunk_id", 10).drop("rank")


@query("ret_02", f"WITH base, {_bm25_cte('log1p', 1.2, 0.75)}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM lex), d AS (SELECT r.item_id, chunk_id, document_id, score, rank FROM r JOIN chunks USING (chunk_id) WHERE rank <= 30 QUALIFY row_number() OVER (PARTITION BY item_id, document_id ORDER BY rank) = 1) SELECT item_id, chunk_id, document_id, score FROM d QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank) <= 5")
def ret_02(c):
    """Flagship: BM25 over chunks, best chunk of each document, five documents an item."""
    top = ranked(bm25(c.chunks, "chunk_id", items(c), "item_id", carry=("document_id",), most=30), "item_id", "chunk_id", 30)
    hits = first_per_document(top, "item_id", "document_id")
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))).where("r <= 5").select("item_id", "chunk_id", "document_id", "score")


_OKAPI = "q AS (SELECT document_id, unnest(regexp_extract_all(lower(regexp_extract(text, '^[^\\n]*')), '[\\p{L}\\p{N}_]{2,}')) AS term FROM docs), tk AS (SELECT document_id, chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM chunks), st AS (SELECT document_id, count(*) AS n, avg(len(w)) AS avgdl FROM tk GROUP BY 1), po AS (SELECT document_id, term, chunk_id, len, count(*) AS tf FROM (SELECT document_id, chunk_id, len(w) AS len, unnest(w) AS term FROM tk) GROUP BY ALL), df AS (SELECT document_id, term, count(*) AS df FROM po GROUP BY ALL), raw AS (SELECT document_id, term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN st USING (document_id)), me AS (SELECT document_id, avg(idf) AS m FROM raw GROUP BY 1)"


@query("ret_03", f"WITH base, {_OKAPI} SELECT document_id, chunk_id, round(sum(CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN po USING (document_id, term) JOIN raw USING (document_id, term) JOIN me USING (document_id) JOIN st USING (document_id) GROUP BY ALL")
def ret_03(c):
    """BM25 within each document: its blocks against the words of its own first line, repeated ones again. A document is scored where
    it is read; rows that share an id are one document, and meet by it."""
    terms = T.found(F.lower(F.regexp_extract("text", r"^[^\n]*", 0)), LONGER)
    again = materialize(c.docs.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id"), "again")
    shared = again.limit(1).count() > 0
    docs = c.docs.join(again, "document_id", "left_anti") if shared else c.docs
    docs = spread(docs.where("document_id IS NOT NULL")).where(F.length("text") > 0).select("document_id", F.col("text").alias("texts"), F.transform(terms, lambda t: F.struct(F.lit(0).alias("query"), t.alias("term"))).alias("asked"))
    hits = within(docs, "q", 1.5, 0.75, LONGER, (512, 64)).select("document_id", chunk_id("document_id", "key").alias("chunk_id"), "score")
    if shared:
        q = c.docs.join(again, "document_id", "left_semi").select("document_id", F.explode(terms).alias("term")).withColumn("q", F.lit(0))
        some = c.chunks.join(again, "document_id", "left_semi")
        # parts of two texts at one place are one chunk
        hits = hits.unionByName(bm25(some, "chunk_id", q, "q", 1.5, 0.75, style="okapi", pattern=LONGER, prefix=("document_id",)).drop("q"))
    return hits


_DENSE = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 50 = 0)"
_D = "den AS (SELECT query_id, vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS score FROM v, q WHERE vec_id <> query_id), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM den QUALIFY rank <= 30)"
_S = "spa AS (SELECT query_id, vec_id, round(list_dot_product(e[1:16], q[1:16]), 6) AS score FROM v, q WHERE vec_id <> query_id), sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM spa QUALIFY rank <= 30)"


def vector_leg(c, k: int, measure: str, width: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) of the stated query set (ids divisible by 50) against all other rows; width: first dimensions alone."""
    part = lambda x: F.slice(x, 1, width) if width else F.col(x)
    v = c.table("embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), part("embedding").alias("q"))
    found = nearest_rows(v.select(F.col("vec_id").alias("id"), part("embedding").alias("v")), q, k, measure)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def dense_leg(c, k: int = 30) -> DataFrame:
    return vector_leg(c, k, "cosine")


def sparse_leg(c, k: int = 30) -> DataFrame:
    """A second, different signal: the dot product over a quarter of the dimensions."""
    return vector_leg(c, k, "dot", 16)


@query("ret_04", f"WITH {_DENSE} SELECT query_id, vec_id, -round(sqrt(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS score FROM v, q WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def ret_04(c):
    return vector_leg(c, 10, "l2").drop("rank")


@query("ret_05", f"WITH {_DENSE}, {_D} SELECT query_id, vec_id, score FROM dr WHERE rank <= 10")
def ret_05(c):
    return dense_leg(c, 10).drop("rank")


@query("ret_06", f"WITH {_DENSE}, {_D}, {_S} SELECT query_id, vec_id, spa.score FROM spa JOIN dr USING (query_id, vec_id) WHERE spa.score > 0")
def ret_06(c):
    """Only the dense candidates are scored again, and only positive scores stay."""
    pool = dense_leg(c).select("query_id", "vec_id").distinct()
    part = lambda x: F.slice(x, 1, 16)
    dot = F.aggregate(F.zip_with(part("embedding"), part("q"), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, z: s + z)
    v = c.table("embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return pool.join(v, "vec_id").join(asked, "query_id").select("query_id", "vec_id", F.round(dot, 6).alias("score")).where("score > 0")


@query("ret_07", f"WITH {_DENSE}, {_D}, {_S}, u AS (SELECT query_id, vec_id, rank FROM dr UNION ALL SELECT query_id, vec_id, rank FROM sr), f AS (SELECT query_id, vec_id, round(sum(1 / (60.0 + rank)), 9) AS score FROM u GROUP BY ALL) SELECT query_id, vec_id, score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def ret_07(c):
    legs = dense_leg(c).unionByName(sparse_leg(c))
    return ranked(rrf(legs, "query_id", "vec_id"), "query_id", "vec_id", 10).drop("rank")


@query("ret_08", f"WITH {_DENSE}, {_D}, {_S}, u AS (SELECT query_id, vec_id, rank - 1 AS r FROM dr UNION ALL SELECT query_id, vec_id, rank - 1 FROM sr) SELECT query_id, vec_id, round(sum(1 / (60.0 + r + 1)), 9) AS score FROM u GROUP BY ALL")
def ret_08(c):
    """The same with ranks from 0."""
    return rrf(dense_leg(c).unionByName(sparse_leg(c)), "query_id", "vec_id")


def _scaled(leg: str) -> str:
    return f"(SELECT query_id, vec_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM {leg} WINDOW w AS (PARTITION BY query_id))"


@query("ret_09", f"WITH {_DENSE}, {_D}, {_S} SELECT query_id, vec_id, round(0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score FROM {_scaled('dr')} a FULL JOIN {_scaled('sr')} b USING (query_id, vec_id)")
def ret_09(c):
    return weighted_fusion(dense_leg(c), sparse_leg(c), "query_id", "vec_id")


def rerank(hits: DataFrame, text: str, question: str) -> DataFrame:
    """Default scorer of the pluggable reranker: logistic of the share of question terms that the text holds."""
    share = T.coverage(T.tokens(question), T.tokens(text))
    return hits.withColumn("rerank", F.round(1 / (1 + F.exp(-(share * 8 - 4))), 6))


_R2 = f"{_bm25_cte('log1p', 1.2, 0.75)}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 10)"
_TK = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{{2,}}')))"


def _lexical(c, k: int = 10) -> DataFrame:
    return ranked(bm25(c.chunks, "chunk_id", items(c), "item_id", most=k), "item_id", "chunk_id", k)


def _reranked(c) -> DataFrame:
    hits = _lexical(c).join(c.chunks.select("chunk_id", "text"), "chunk_id").join(c.table("benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    return rerank(hits, "text", "question")


@query("ret_10", f"WITH base, {_R2.replace('{', '{').replace('}', '}')}, t AS (SELECT r.item_id, r.chunk_id, " + _TK.format(x="b.text") + " AS a, " + _TK.format(x="k.text") + " AS t FROM r JOIN chunks k USING (chunk_id) JOIN benchmark b USING (item_id)) SELECT item_id, chunk_id, round(1 / (1 + exp(-(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, t)) / len(a)::DOUBLE END * 8 - 4))), 6) AS rerank FROM t")
def ret_10(c):
    return _reranked(c).select("item_id", "chunk_id", "rerank")


@query("ret_11", f"WITH base, {_R2} SELECT item_id, chunk_id, rank FROM r")
def ret_11(c):
    """Without a reranker the order stays."""
    return _lexical(c).select("item_id", "chunk_id", "rank")


#: Dimensions of the default text vectors: a term counts in the dimension that its digest begins with.
_DIMENSIONS = 256


def text_vectors(texts: list[str]) -> np.ndarray:
    """Default embedding of lower-case texts, a plug-in: term counts by dimension."""
    known: dict[str, int] = {}
    out = np.zeros((len(texts), _DIMENSIONS))
    for i, text in enumerate(texts):
        for word in re.findall(r"\w+", text or ""):
            if word not in known:
                known[word] = sha256(word.encode()).digest()[0]
            out[i, known[word]] += 1
    return out


def text_leg(chunks: DataFrame, questions: list, query_id: str, kind: str, keys: tuple[str, ...], most: int, vectors=text_vectors) -> DataFrame:
    """(query_id, keys, score): cosine of every chunk's vector with those of a bounded batch of (id, lower-case text), the best of
    each task; chunks don't move, and questions meet a batch of them by blocks."""
    sent = chunks.sparkSession.sparkContext.broadcast([(q, t) for q, t in questions])

    def run(batches):
        ids = pa.array([q for q, _ in sent.value])
        asked = vectors([t for _, t in sent.value])
        norms = np.sqrt((asked * asked).sum(axis=1))
        for batch in batches:
            v = vectors(batch.column(len(keys)).to_pylist())
            own = np.sqrt((v * v).sum(axis=1))[:, None]
            width = max(1, _CELLS // max(1, len(v)))
            for low in range(0, len(ids), width):
                size = own * norms[low : low + width]
                scores = np.divide(v @ asked[low : low + width].T, size, out=np.zeros(size.shape), where=size > 0)
                x, q = np.nonzero(_best(scores, most))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + low)), *(batch.column(i).take(pa.array(x)) for i in range(len(keys))), pa.array(scores[x, q])], [query_id, *keys, "score"])

    fields = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)
    small_batches(chunks.sparkSession)
    return chunks.select(*keys, F.lower("text").alias("#text")).mapInArrow(lean(run), f"`{query_id}` {kind}, {fields}, score double").withColumn("score", F.round("score", 6))


_HYBRID = f"""WITH base, {_bm25_cte('log1p', 1.2, 0.75)},
lr AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 30),
cv AS (SELECT chunk_id, substr(sha256(t), 1, 2) AS d, count(*)::DOUBLE AS n FROM (SELECT chunk_id, unnest(w) AS t FROM tk) GROUP BY ALL),
qv AS (SELECT item_id, substr(sha256(t), 1, 2) AS d, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS t FROM benchmark) GROUP BY ALL),
cn AS (SELECT chunk_id, sqrt(sum(n * n)) AS c FROM cv GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(n * n)) AS q FROM qv GROUP BY 1),
dot AS (SELECT item_id, chunk_id, sum(cv.n * qv.n) AS s FROM qv JOIN cv USING (d) GROUP BY ALL),
den AS (SELECT item_id, chunk_id, round(s / (c * q), 6) AS score FROM dot JOIN cn USING (chunk_id) JOIN qn USING (item_id)),
dr AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM den QUALIFY rank <= 30),
fu AS (SELECT item_id, chunk_id, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM lr UNION ALL SELECT * FROM dr) GROUP BY ALL),
fr AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM fu QUALIFY rank <= 30),
fd AS (SELECT f.item_id, f.chunk_id, document_id, text FROM fr f JOIN chunks USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY f.item_id, document_id ORDER BY rank) = 1),
rr AS (SELECT item_id, chunk_id, document_id, {_TK.format(x="b.text")} AS a, {_TK.format(x="fd.text")} AS t FROM fd JOIN benchmark b USING (item_id)),
sc AS (SELECT item_id, chunk_id, document_id, round(1 / (1 + exp(-(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, t)) / len(a)::DOUBLE END * 8 - 4))), 6) AS rerank FROM rr)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5"""


@query("ret_12", _HYBRID)
def ret_12(c):
    """Search as users call it: a lexical and a dense leg over all chunks fused, best chunk of a document, reranked, cut."""
    asked = c.table("benchmark").select("item_id", F.lower("text").alias("t"))
    kind = asked.schema["item_id"].dataType.simpleString()
    dense = reduce(DataFrame.unionByName, [text_leg(c.chunks, [(r.item_id, r.t) for r in part.collect()], "item_id", kind, ("chunk_id",), 30) for part in in_blocks(asked, "item_id", 5_000)])
    legs = _lexical(c, 30).unionByName(ranked(dense, "item_id", "chunk_id", 30))
    fused = ranked(rrf(legs, "item_id", "chunk_id"), "item_id", "chunk_id", 30)
    hits = first_per_document(fused.join(c.chunks.select("chunk_id", "document_id", "text"), "chunk_id"), "item_id", "document_id")
    scored = rerank(hits.join(c.table("benchmark").select("item_id", F.col("text").alias("question")), "item_id"), "text", "question")
    return ranked(scored, "item_id", "chunk_id", 5, "rerank").select("item_id", "chunk_id", "document_id", "rerank", "rank")


@query("ret_13", f"WITH base, {_R2}, t AS (SELECT item_id, " + _TK.format(x="b.text") + " AS need FROM benchmark b), g AS (SELECT r.item_id, list_distinct(flatten(list(" + _TK.format(x="k.text") + "))) AS have, count(*) AS hits, count(DISTINCT document_id) AS documents FROM r JOIN chunks k USING (chunk_id) GROUP BY 1) SELECT item_id, hits, documents, CASE WHEN len(list_filter(need, lambda w: NOT list_contains(have, w))) = 0 THEN 'sufficient' WHEN len(list_intersect(need, have)) > 0 THEN 'partial' ELSE 'insufficient' END AS evidence FROM g JOIN t USING (item_id)")
def ret_13(c):
    """Hits, documents and whether all required terms are covered."""
    hits = _lexical(c).join(c.chunks.select("chunk_id", "document_id", "text"), "chunk_id")
    got = hits.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list(T.tokens("text")))).alias("have"), F.count("*").alias("hits"), F.count_distinct("document_id").alias("documents"))
    need = c.table("benchmark").select("item_id", T.tokens("text").alias("need"))
    label = F.when(F.size(F.array_except("need", "have")) == 0, "sufficient").when(F.size(F.array_intersect("need", "have")) > 0, "partial").otherwise("insufficient")
    return got.join(need, "item_id").select("item_id", "hits", "documents", label.alias("evidence"))


@query("ret_14")
def ret_14(c):
    """Context package: hits in rank order while they fit a token budget, and its hash."""
    from corpusloom.operators.relational_queries import within_budget

    hits = _lexical(c).join(c.chunks.select("chunk_id", "content_hash", "text"), "chunk_id").withColumn("cost", T.token_estimate("text"))
    kept = within_budget(hits, "item_id", "rank", "cost", 600).join(hits, ["item_id", "rank"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content_hash"))), lambda s: s.content_hash)
    return kept.groupBy("item_id").agg(F.count("*").alias("chunks"), F.sum("cost").alias("tokens"), F.sha2(F.array_join(parts, "|"), 256).alias("package_hash"))


@query("ret_15", "WITH base, h AS (SELECT b.item_id, count(k.chunk_id) AS n FROM benchmark b LEFT JOIN chunks k ON contains(k.text, b.text) GROUP BY 1) SELECT item_id, n, CASE WHEN n = 0 THEN 'none' WHEN n < 3 THEN 'partial' ELSE 'good' END AS coverage FROM h")
def ret_15(c):
    """The items are a stated query set, sent to the chunks in blocks."""
    asked = c.table("benchmark").select("item_id", F.col("text").alias("q"))
    found = [c.chunks.select("text").join(F.broadcast(x), F.contains("text", F.col("q"))) for x in in_blocks(asked, "item_id")]
    hits = reduce(DataFrame.unionByName, found).groupBy("item_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return c.table("benchmark").select("item_id").join(hits, "item_id", "left").select("item_id", n.alias("n"), F.when(n == 0, "none").when(n < 3, "partial").otherwise("good").alias("coverage"))


def _graph(c) -> tuple[DataFrame, DataFrame]:
    """Clusters (source tags) with parents, and their members."""
    n = F.substring("source", 4, 9).cast("int")
    clusters = c.docs.select(n.alias("cluster")).distinct().withColumn("parent", F.when(F.col("cluster") > 0, F.floor((F.col("cluster") - 1) / 3).cast("int")))
    return clusters, c.docs.select(n.alias("cluster"), "document_id")


def neighbours(clusters: DataFrame, frontier: DataFrame) -> DataFrame:
    """Parent, children and siblings of the frontier's clusters."""
    f = frontier.select("seed", F.col("cluster").alias("at")).join(clusters.select(F.col("cluster").alias("at"), F.col("parent").alias("up")), "at")
    # three equality joins, not one on alternatives
    other = clusters.select("cluster", "parent")
    up = f.where("up IS NOT NULL").select("seed", F.col("up").alias("cluster"))
    down = f.join(other, F.col("parent") == F.col("at")).select("seed", "cluster")
    side = f.join(other, F.col("parent") == F.col("up")).where("cluster != at").select("seed", "cluster")
    return up.unionByName(down).unionByName(side).distinct()


def hops(clusters: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """(seed, cluster, hop) reached in at most so many steps, each at its first; seeds: (seed), or (seed, cluster) of several entries."""
    start = F.col("cluster") if "cluster" in seeds.columns else F.col("seed")
    seen = seeds.select("seed", start.alias("cluster"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, most + 1):
        frontier = neighbours(clusters, frontier).join(seen.select("seed", "cluster"), ["seed", "cluster"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def navigated(hits: DataFrame, queries: DataFrame, entries: DataFrame, clusters: DataFrame, members: DataFrame, chunks: DataFrame, least: int = 3, most: int = 2, each: int = 5) -> DataFrame:
    """(query_id, hop, cluster, chunk_id): a query's hits (hop 0, cluster -1), and, where they are fewer than `least` or of fewer documents,
    up to `each` other chunks of every cluster that is reached in `most` hops.

    hits: (query_id, chunk_id, document_id). Entry clusters are those of the hits' documents, or else those of entries
    (query_id, cluster). All entries count as visited from the start.
    """
    counted_ = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("d"))
    poor = queries.select("query_id").join(counted_, "query_id", "left").where((F.coalesce("n", F.lit(0)) < least) | (F.coalesce("d", F.lit(0)) < least))
    own = hits.join(members, "document_id").select("query_id", "cluster").distinct()
    given = entries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    seeds = own.unionByName(given.select("query_id", "cluster")).join(poor.select("query_id"), "query_id", "left_semi").withColumnRenamed("query_id", "seed")
    reached = hops(clusters, seeds, most).where("hop > 0").withColumnRenamed("seed", "query_id")
    held = reached.join(members, "cluster").join(chunks.select("document_id", "chunk_id", "chunk_index"), "document_id").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id", "cluster").orderBy("document_id", "chunk_index")
    more = held.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("query_id", "hop", "cluster", "chunk_id")
    return hits.select("query_id", F.lit(0).alias("hop"), F.lit(-1).alias("cluster"), "chunk_id").unionByName(more)


_HOPS = """cl AS (SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS cluster, CASE WHEN CAST(substr(source, 4) AS INTEGER) > 0 THEN (CAST(substr(source, 4) AS INTEGER) - 1) // 3 END AS parent FROM docs),
ed AS (SELECT a.cluster AS x, b.cluster AS y FROM cl a JOIN cl b ON a.cluster <> b.cluster AND (a.parent = b.cluster OR b.parent = a.cluster OR a.parent = b.parent)),
hi AS (SELECT item_id, chunk_id, document_id, CAST(substr(k.source, 4) AS INTEGER) AS cluster FROM benchmark b JOIN chunks k ON contains(k.text, b.text) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY chunk_id) <= 10),
po AS (SELECT b.item_id, count(chunk_id) AS n, count(DISTINCT document_id) AS d FROM benchmark b LEFT JOIN hi USING (item_id) GROUP BY 1 HAVING n < 3 OR d < 3),
se AS (SELECT DISTINCT item_id, cluster FROM po JOIN hi USING (item_id) UNION SELECT item_id, CAST(item_id % 20 AS INTEGER) FROM po WHERE n = 0),
h1 AS (SELECT DISTINCT item_id, y AS cluster FROM se JOIN ed ON x = cluster WHERE (item_id, y) NOT IN (SELECT (item_id, cluster) FROM se)),
h2 AS (SELECT DISTINCT item_id, y AS cluster FROM h1 JOIN ed ON x = cluster WHERE (item_id, y) NOT IN (SELECT (item_id, cluster) FROM se) AND (item_id, y) NOT IN (SELECT (item_id, cluster) FROM h1)),
hp AS (SELECT item_id, cluster, 1 AS hop FROM h1 UNION ALL SELECT item_id, cluster, 2 FROM h2)"""


@query("ret_16", f"WITH base, {_HOPS} SELECT item_id, 0 AS hop, -1 AS cluster, chunk_id FROM hi UNION ALL (SELECT item_id, hop, hp.cluster, chunk_id FROM hp JOIN chunks k ON CAST(substr(k.source, 4) AS INTEGER) = hp.cluster QUALIFY row_number() OVER (PARTITION BY item_id, hp.cluster ORDER BY document_id, chunk_index) <= 5)")
def ret_16(c):
    """Chunks that hold an item; where they are fewer than three, or of fewer than three documents, two hops over the topic graph,
    five chunks a neighbour. An item without a hit enters at a stated cluster."""
    clusters, members = _graph(c)
    asked = c.table("benchmark").select("item_id", F.col("text").alias("q"))
    found = reduce(DataFrame.unionByName, [c.chunks.select("chunk_id", "document_id", "text").join(F.broadcast(x), F.contains("text", F.col("q"))) for x in in_blocks(asked, "item_id")])
    hits = found.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("chunk_id"))).where("r <= 10")
    hits = materialize(hits.select(F.col("item_id").alias("query_id"), "chunk_id", "document_id"), "hits")
    queries = asked.select(F.col("item_id").alias("query_id"))
    entries = queries.withColumn("cluster", (F.col("query_id") % 20).cast("int"))
    return navigated(hits, queries, entries, clusters, members, c.chunks).withColumnRenamed("query_id", "item_id")


@query("ret_17", "WITH lb AS (SELECT label, 'topic ' || label || ' the of ' || CASE WHEN label % 2 = 0 THEN 'with' ELSE 'that' END AS l FROM (SELECT DISTINCT label FROM embeddings)), t AS (SELECT item_id, label, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), list_distinct(regexp_extract_all(l, '[a-z0-9]+')))) AS n FROM benchmark, lb) SELECT item_id, label, CAST(n AS BIGINT) AS shared FROM t WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, label) <= 2")
def ret_17(c):
    n = F.col("label")
    labels = c.table("embeddings").select("label").distinct().select("label", F.concat(F.lit("topic "), n.cast("string"), F.lit(" the of "), F.when(n % 2 == 0, "with").otherwise("that")).alias("l"))
    words = lambda x: F.array_distinct(T.found(F.lower(x), "[a-z0-9]+"))
    # items and labels meet in the words that they share
    each = lambda df, key, x: df.select(key, F.explode(words(x)).alias("w"))
    pairs = each(c.table("benchmark"), "item_id", "text").join(each(labels, "label", "l"), "w").groupBy("item_id", "label").agg(F.count("*").alias("shared"))
    return ranked(pairs, "item_id", "label", 2, "shared").drop("rank")


_MEM = _bm25_cte("log1p", 1.2, 0.75, most=8).replace("FROM chunks)", "FROM (SELECT session_id || ':' || turn AS chunk_id, content AS text FROM episodes WHERE role = 'user'))")


def _memory(c) -> DataFrame:
    m = c.episodes.where("role = 'user'").select(F.concat_ws(":", "session_id", "turn").alias("chunk_id"), F.col("content").alias("text"))
    return ranked(bm25(m, "chunk_id", items(c, most=8), "item_id"), "item_id", "chunk_id", 20)


_NEWEST = "nw AS (SELECT session_id || ':' || turn AS chunk_id FROM episodes WHERE role = 'user' ORDER BY created_at DESC, chunk_id LIMIT 20)"


def recalled(c, questions: DataFrame, most: int = 20) -> DataFrame:
    """(item_id, chunk_id, score) of the memories that a question's first eight words recall; a question without words recalls the
    newest ones, without a score."""
    m = c.episodes.where("role = 'user'").select(F.concat_ws(":", "session_id", "turn").alias("chunk_id"), F.col("content").alias("text"), "created_at")
    words = F.slice(T.found(F.lower("text"), T.WORD), 1, 8)
    terms = questions.select("item_id", F.explode(words).alias("term"))
    hits = ranked(bm25(m, "chunk_id", terms, "item_id"), "item_id", "chunk_id", most).select("item_id", "chunk_id", "score")
    newest = m.orderBy(F.desc("created_at"), "chunk_id").limit(most).select("chunk_id")
    empty = questions.where(F.size(words) == 0).select("item_id")
    return hits.unionByName(empty.join(F.broadcast(newest), F.lit(True)).withColumn("score", F.lit(None).cast("double")))


_ASKED_SQL = "bm AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN '?!' ELSE text END AS text FROM benchmark)"
_MEM8 = _MEM[_MEM.index("),", _MEM.index("FROM benchmark")) + 2 :]


@query("ret_18", f"WITH base, {_ASKED_SQL}, q AS (SELECT item_id, unnest(list_slice(regexp_extract_all(lower(text), '{T.WORD}'), 1, 8)) AS term FROM bm),{_MEM8}, {_NEWEST} SELECT item_id, chunk_id, score FROM (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 20) UNION ALL SELECT item_id, chunk_id, NULL::DOUBLE FROM bm, nw WHERE text = '?!'")
def ret_18(c):
    """Memory recall: the first eight words, any of them, within one scope; every tenth question here has none."""
    asked = c.table("benchmark").select("item_id", F.when(F.col("item_id") % 10 == 0, "?!").otherwise(F.col("text")).alias("text"))
    return recalled(c, asked)


@query("ret_19", f"WITH base, {_MEM}, l AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 20), s AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY length(chunk_id) DESC, chunk_id) AS rank FROM l), u AS (SELECT item_id, chunk_id, rank FROM l UNION ALL SELECT item_id, chunk_id, rank FROM s), f AS (SELECT item_id, chunk_id, round(sum(1 / (60.0 + rank)), 9) AS score FROM u GROUP BY ALL) SELECT item_id, chunk_id, score FROM f WHERE chunk_id NOT LIKE '%:0' ")
def ret_19(c):
    """Two memory lists fused; the scope filter comes after the fusion."""
    l = _memory(c).select("item_id", "chunk_id", "rank")  # noqa: E741
    s = l.select("item_id", "chunk_id", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.length("chunk_id")), "chunk_id")).alias("rank"))
    return rrf(l.unionByName(s), "item_id", "chunk_id").where("chunk_id NOT LIKE '%:0'")


@query("win_05", f"WITH {_DENSE}, {_D}, {_S} SELECT query_id, vec_id, 'dense' AS leg, rank FROM dr UNION ALL SELECT query_id, vec_id, 'sparse', rank FROM sr")
def win_05(c):
    leg = lambda df, name: df.select("query_id", "vec_id", F.lit(name).alias("leg"), "rank")
    return leg(dense_leg(c), "dense").unionByName(leg(sparse_leg(c), "sparse"))


@query("win_06", f"WITH {_DENSE}, {_D} SELECT query_id, label, vec_id FROM dr JOIN (SELECT vec_id, label FROM v) USING (vec_id) QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) = 1")
def win_06(c):
    return first_per_document(dense_leg(c).join(c.table("embeddings").select("vec_id", "label"), "vec_id"), "query_id", "label").select("query_id", "label", "vec_id")


@query("top_01", f"WITH base, {_bm25_cte('log1p', 1.2, 0.75)} SELECT item_id, chunk_id, score FROM lex QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 3")
def top_01(c):
    return _lexical(c, 3).drop("rank")


# Evaluation


def synthetic_queries(c, size: int = 100, terms: int = 5) -> DataFrame:
    """(chunk_id, document_id, term): a hash-ordered sample of long chunks and the top terms of each; two terms at least."""
    from corpusloom.operators.relational_queries import top_terms

    sample = c.chunks.where(F.length("text") >= 100).select("chunk_id", "document_id", "text").orderBy(F.sha2("chunk_id", 256), "chunk_id").limit(size)
    top = top_terms(sample, "chunk_id", terms)
    enough = top.groupBy("chunk_id").count().where("count >= 2").select("chunk_id")
    return top.join(enough, "chunk_id", "left_semi").join(sample.select("chunk_id", "document_id"), "chunk_id").select("chunk_id", "document_id", "term")


_EV = "sm AS (SELECT chunk_id, document_id, text FROM chunks WHERE length(text) >= 100 ORDER BY sha256(chunk_id), chunk_id LIMIT 100), tt AS (SELECT * FROM (SELECT chunk_id, w AS term, count(*) AS n FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM sm) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, term) <= 5), ev AS (SELECT chunk_id, document_id, term FROM tt JOIN sm USING (chunk_id) WHERE chunk_id IN (SELECT chunk_id FROM tt GROUP BY 1 HAVING count(*) >= 2))"
_EVR = _EV + """, q AS (SELECT chunk_id AS item_id, term FROM ev), tk AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM chunks), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk),
po AS (SELECT term, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM tk) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
lex AS (SELECT item_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL),
rk AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 20),
pq AS (SELECT e.chunk_id AS item_id, min(rank) FILTER (WHERE r.chunk_id = e.chunk_id) AS c_rank, min(rank) FILTER (WHERE k.document_id = e.document_id) AS d_rank FROM (SELECT DISTINCT chunk_id, document_id FROM ev) e LEFT JOIN rk r ON r.item_id = e.chunk_id LEFT JOIN chunks k ON k.chunk_id = r.chunk_id GROUP BY 1)"""


def judged(c) -> DataFrame:
    """Per evaluation query the ranks of its chunk and of its document, null where not found."""
    # the sample is bounded and used three times: written once
    ev = materialize(synthetic_queries(c), "queries")
    hits = ranked(bm25(c.chunks, "chunk_id", ev.select(F.col("chunk_id").alias("item_id"), "term"), "item_id", most=20), "item_id", "chunk_id", 20)
    hits = hits.join(c.chunks.select("chunk_id", F.col("document_id").alias("hit_document")), "chunk_id")
    want = ev.select(F.col("chunk_id").alias("item_id"), "document_id").distinct()
    both = want.join(hits, "item_id", "left")
    return both.groupBy("item_id").agg(F.min(F.when(F.col("chunk_id") == F.col("item_id"), F.col("rank"))).alias("c_rank"), F.min(F.when(F.col("hit_document") == F.col("document_id"), F.col("rank"))).alias("d_rank"))


def recall(rank: str, k: int) -> Column:
    return F.round(F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))), 4)


def reciprocal(rank: str) -> Column:
    return F.round(F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))), 4)


def ndcg(rank: str, k: int) -> Column:
    gain = F.when(F.col(rank) <= k, 1 / F.log2(F.col(rank) + 1)).otherwise(0.0)
    return F.round(F.avg(gain), 4)


@query("evl_01", f"WITH base, {_EV} SELECT chunk_id, document_id, term FROM ev")
def evl_01(c):
    return synthetic_queries(c)


@query("evl_02", f"WITH base, {_EVR} SELECT round(avg(coalesce((c_rank <= 10)::INT, 0)), 4) AS chunk_recall, round(avg(coalesce((d_rank <= 10)::INT, 0)), 4) AS document_recall FROM pq")
def evl_02(c):
    return judged(c).agg(recall("c_rank", 10).alias("chunk_recall"), recall("d_rank", 10).alias("document_recall"))


@query("evl_03", f"WITH base, {_EVR} SELECT round(avg(coalesce(1.0 / c_rank, 0)), 4) AS mrr FROM pq")
def evl_03(c):
    return judged(c).agg(reciprocal("c_rank").alias("mrr"))


@query("evl_04", f"WITH base, {_EVR} SELECT round(avg(CASE WHEN c_rank <= 10 THEN 1 / log2(c_rank + 1) ELSE 0 END), 4) AS ndcg FROM pq")
def evl_04(c):
    return judged(c).agg(ndcg("c_rank", 10).alias("ndcg"))


@query("evl_05", f"WITH base, {_EVR} SELECT count(*) AS queries, round(avg(coalesce((c_rank <= 1)::INT, 0)), 4) AS recall_1, round(avg(coalesce((c_rank <= 5)::INT, 0)), 4) AS recall_5, round(avg(coalesce(1.0 / c_rank, 0)), 4) AS mrr, round(avg(CASE WHEN c_rank <= 10 THEN 1 / log2(c_rank + 1) ELSE 0 END), 4) AS ndcg_10 FROM pq")
def evl_05(c):
    return judged(c).agg(F.count("*").alias("queries"), recall("c_rank", 1).alias("recall_1"), recall("c_rank", 5).alias("recall_5"), reciprocal("c_rank").alias("mrr"), ndcg("c_rank", 10).alias("ndcg_10"))


_CITED = "ci AS (SELECT chunk_id AS cited, CASE WHEN chunk_index % 9 = 0 THEN 'sha256:stale' ELSE content_hash END AS stated FROM chunks WHERE doc_id % 6 = 0 UNION ALL SELECT 'chunk:none' || doc_id, 'x' FROM docs WHERE doc_id % 50 = 0)"


def _cited(c) -> DataFrame:
    a = c.chunks.where("doc_id % 6 = 0").select(F.col("chunk_id").alias("cited"), F.when(F.col("chunk_index") % 9 == 0, "sha256:stale").otherwise(F.col("content_hash")).alias("stated"))
    return a.union(c.docs.where("doc_id % 50 = 0").select(F.concat(F.lit("chunk:none"), F.col("doc_id").cast("string")), F.lit("x")))


@query("evl_06", f"WITH base, {_CITED} SELECT count(*) AS citations, count(k.chunk_id) AS existing, count_if(k.content_hash = stated) AS matching FROM ci LEFT JOIN chunks k ON k.chunk_id = cited")
def evl_06(c):
    j = _cited(c).join(c.chunks.select("chunk_id", "content_hash"), F.col("cited") == F.col("chunk_id"), "left")
    return j.agg(F.count("*").alias("citations"), F.count("chunk_id").alias("existing"), F.count_if(F.col("content_hash") == F.col("stated")).alias("matching"))


def claim_support(claims: DataFrame) -> DataFrame:
    """claims: (id, claim, evidence array). Adds score (best share of claim tokens), numbers_ok and level."""
    from corpusloom.operators.scalar_queries import NUMBERS

    words = T.tokens("claim")
    numbers = lambda x: F.array_distinct(T.found(x, NUMBERS))
    score = F.round(F.coalesce(F.array_max(F.transform("evidence", lambda e: T.coverage(words, T.tokens(e)))), F.lit(0.0)), 4)
    ok = F.forall("evidence", lambda e: F.size(F.array_except(numbers("claim"), numbers(e))) == 0)
    level = F.when(F.size("evidence") == 0, "unsupported").when(~F.col("numbers_ok"), F.when(F.col("score") >= 0.25, "partial").otherwise("unsupported")).when(F.col("score") >= 0.35, "supported").when(F.col("score") >= 0.12, "partial").otherwise("unsupported")
    return claims.withColumn("score", score).withColumn("numbers_ok", ok).withColumn("level", level)


@query("evl_07", "WITH base, cl AS (SELECT item_id, b.text || ' 12' AS claim, CASE WHEN item_id % 3 = 0 THEN 'x ' || b.text || ' 12 kg' WHEN item_id % 3 = 1 THEN d.text ELSE b.text || ' 12' END AS ev FROM benchmark b JOIN docs d ON d.doc_id = item_id), t AS (SELECT item_id, " + _TK.format(x="claim") + " AS a, " + _TK.format(x="ev") + " AS e, regexp_extract_all(claim, '\\d+(?:[.,]\\d+)?(?:\\s?[%xkKMGbgm]+)?') AS na, regexp_extract_all(ev, '\\d+(?:[.,]\\d+)?(?:\\s?[%xkKMGbgm]+)?') AS ne FROM cl), s AS (SELECT item_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, e)) / len(a)::DOUBLE END, 4) AS score, len(list_filter(na, lambda x: NOT list_contains(ne, x))) = 0 AS numbers_ok FROM t) SELECT item_id, score, numbers_ok, CASE WHEN NOT numbers_ok THEN CASE WHEN score >= 0.25 THEN 'partial' ELSE 'unsupported' END WHEN score >= 0.35 THEN 'supported' WHEN score >= 0.12 THEN 'partial' ELSE 'unsupported' END AS level FROM s")
def evl_07(c):
    n = F.col("item_id")
    j = c.table("benchmark").join(c.docs.select("doc_id", F.col("text").alias("doc")), n == F.col("doc_id"))
    evidence = F.when(n % 3 == 0, F.concat(F.lit("x "), "text", F.lit(" 12 kg"))).when(n % 3 == 1, F.col("doc")).otherwise(F.concat("text", F.lit(" 12")))
    claims = j.select("item_id", F.concat("text", F.lit(" 12")).alias("claim"), F.array(evidence).alias("evidence"))
    return claim_support(claims).select("item_id", "score", "numbers_ok", "level")


@query("evl_08", "WITH t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY ALL), d AS (SELECT w, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, w AS term, round(tf * ln(1 + n / df::DOUBLE), 6) AS weight FROM t JOIN d USING (w), n WHERE df < n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 5) SELECT doc_id, term, weight FROM r WHERE doc_id IN (SELECT doc_id FROM r GROUP BY 1 HAVING count(*) >= 3)")
def evl_08(c):
    """Per document its five strongest TF-IDF terms; three at least."""
    # words are counted where the text is; weights are made there too while the counts of terms are few, and five a document move
    t = materialize(counted(spread(c.docs), ("doc_id",), "[a-z]{4,}", None), "counted").select("doc_id", F.inline("terms"))
    if c.docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        t = t.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    df = sized(materialize(t.groupBy("term").agg(F.count("*").alias("df")), "frequencies"))
    n = c.docs.agg(F.count("*").alias("n"))
    w = t.join(df, "term").join(F.broadcast(n), F.col("df") < F.col("n")).select("doc_id", "term", F.round(F.col("tf") * F.log(1 + F.col("n") / F.col("df")), 6).alias("weight"))
    top = ranked(w, "doc_id", "term", 5, "weight")
    return top.withColumn("k", F.count("*").over(Window.partitionBy("doc_id"))).where("k >= 3").select("doc_id", "term", "weight")


@query("evl_09", f"WITH base, {_EVR}, {_CITED}, x AS (SELECT count(*) AS n, count(k.chunk_id) AS e, count_if(k.content_hash = stated) AS m FROM ci LEFT JOIN chunks k ON k.chunk_id = cited) SELECT (SELECT round(avg(coalesce((d_rank <= 5)::INT, 0)), 4) FROM pq) AS hit_5, (SELECT round(avg(coalesce((c_rank <= 5)::INT, 0) / 5.0), 4) FROM pq) AS precision_5, round(e / n::DOUBLE, 4) AS existence, round(m / n::DOUBLE, 4) AS hash_match FROM x")
def evl_09(c):
    a = judged(c).agg(recall("d_rank", 5).alias("hit_5"), F.round(F.avg(F.coalesce((F.col("c_rank") <= 5).cast("double"), F.lit(0.0)) / 5), 4).alias("precision_5"))
    x = evl_06(c).select(F.round(F.col("existing") / F.col("citations"), 4).alias("existence"), F.round(F.col("matching") / F.col("citations"), 4).alias("hash_match"))
    return a.join(x, F.lit(True))


def _recall_sql(name: str, chunks: str) -> str:
    return f"""{name}tk AS (SELECT chunk_id, document_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {chunks}), {name}st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}tk),
{name}po AS (SELECT term, chunk_id, document_id, len, count(*) AS tf FROM (SELECT chunk_id, document_id, len(w) AS len, unnest(w) AS term FROM {name}tk) GROUP BY ALL), {name}df AS (SELECT term, count(*) AS df FROM {name}po GROUP BY term),
{name}rk AS (SELECT e.chunk_id AS item_id, p.chunk_id, any_value(p.document_id) AS document_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM ev e JOIN {name}po p USING (term) JOIN {name}df USING (term), {name}st GROUP BY e.chunk_id, p.chunk_id QUALIFY row_number() OVER (PARTITION BY e.chunk_id ORDER BY score DESC, p.chunk_id) <= 10),
{name}r AS (SELECT round(avg((document_id IN (SELECT document_id FROM {name}rk WHERE item_id = w.chunk_id))::INT), 4) AS recall FROM (SELECT DISTINCT chunk_id, document_id FROM ev) w)"""


_WIDER = "c2 AS (SELECT document_id, 'chunk:' || substr(sha256(document_id || ':' || i), 1, 16) AS chunk_id, substr(text, i * 700 + 1, 800) AS text FROM (SELECT *, unnest(generate_series(0, CASE WHEN length(text) = 0 THEN -1 ELSE CAST(greatest(0, ceil((length(text) - 800) / 700.0)) AS BIGINT) END)) AS i FROM docs))"


@query("evl_10", f"WITH base, {_EV}, {_WIDER}, {_recall_sql('a', 'chunks')}, {_recall_sql('b', 'c2')} SELECT 'original' AS chunks, recall FROM ar UNION ALL SELECT 'rechunked', recall FROM br")
def evl_10(c):
    """Document recall on the chunks as they are and on chunks of another size."""
    from corpusloom.operators import chunking

    # the sample is bounded and used for both: written once
    ev = materialize(synthetic_queries(c), "queries")
    out = []
    for name, chunks in (("original", c.chunks), ("rechunked", chunking.fixed_window(c.docs, 800, 100))):
        hits = ranked(bm25(chunks, "chunk_id", ev.select(F.col("chunk_id").alias("item_id"), "term"), "item_id", carry=("document_id",), most=10), "item_id", "chunk_id", 10)
        hits = hits.select("item_id", "document_id").distinct()
        want = ev.select(F.col("chunk_id").alias("item_id"), "document_id").distinct()
        out.append(want.join(hits.withColumn("hit", F.lit(1.0)), ["item_id", "document_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("recall")).select(F.lit(name).alias("chunks"), "recall"))
    return out[0].unionByName(out[1])


@query("src_14")
def src_14(c):
    """Main content of pages as a source of documents: the selected blocks as Markdown."""
    from corpusloom.operators.html_blocks import html_06

    return html_06(c)
