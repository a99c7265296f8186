"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Benchmark windows (13 words, or a shorter item whole) must occur exactly in a document. Containment of all words is asked
for, so one necessary prefix token per window is enough: its rarest word by corpus count. Documents' words are joined
with those tokens on the map side, positions and lengths bound the window, a second rare word is compared, and the whole
window is verified. Windows are joined in blocks of bounded size, each broadcast; documents never move, only their hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """Words of a text, only A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER), F.lit(WORDS), F.lit(0))


def windows(benchmark: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: w (words), items (sorted distinct ids as strings). Items without words and null ids have none."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words(text).alias("v")).where(F.size("v") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("v") - width + 1))
    each = items.select("item", "v", F.explode(starts).alias("s")).select("item", F.slice("v", F.col("s"), width).alias("w"))
    return each.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def anchored(docs_words: DataFrame, found: DataFrame) -> DataFrame:
    """Windows with their rarest word as anchor and the next rarest as a second test; one row a window.

    docs_words: v (words of each document). Corpus counts are taken of the windows' words alone.
    """
    terms = found.select(F.explode("w").alias("word")).distinct()
    # the vocabulary of the benchmark is counted and sent in blocks like the windows; a longer one is joined by shuffle
    # outer: else the optimizer infers a filter on the words and splits each text twice more
    small = terms.count() <= 200_000
    each = docs_words.select(F.explode_outer("v").alias("word"))
    # a longer vocabulary meets counted words, one row each, so a common word is no hot key
    counts = each.join(F.broadcast(terms), "word").groupBy("word").count() if small else each.groupBy("word").count().join(terms, "word")
    placed = found.withColumn("wid", F.xxhash64(F.array_join("w", " "))).select("w", "items", "wid", F.posexplode("w").alias("off", "word"))
    # counts has no more rows than terms
    placed = placed.join(F.broadcast(counts) if small else counts, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("wid", "w").orderBy("count", "word", "off"))
    top = placed.withColumn("r", rank).where("r <= 2")
    return top.groupBy("wid", "w").agg(F.first("items").alias("items"), F.max(F.when(F.col("r") == 1, F.col("word"))).alias("anchor"), F.max(F.when(F.col("r") == 1, F.col("off"))).alias("off"), F.max(F.when(F.col("r") == 1, F.col("count"))).alias("count"), F.max(F.when(F.col("r") == 2, F.col("word"))).alias("second"), F.max(F.when(F.col("r") == 2, F.col("off"))).alias("off2")).where("count > 0")


def _scan(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int, share: int, block: int) -> DataFrame:
    """contamination() by distinct id and text (h1, h2), with the number of such rows (copies)."""
    found = windows(benchmark, width, item_id, item_text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = rows.select("doc_id", F.xxhash64("t").alias("h1"), F.crc32(F.col("t").cast("binary")).alias("h2"), words("t").alias("v"))
    anchors = materialize(anchored(rows.select(words("t").alias("v")), found), "anchors")
    n = anchors.count()
    blocks = -(-n // block)
    anchors = anchors.withColumn("k", F.pmod("wid", F.lit(max(blocks, 1))))
    # each document also has one empty word, which meets a row of its own: so documents without hits stay in the same pass
    marked = split.select("doc_id", "h1", "h2", "v", F.posexplode_outer(F.concat("v", F.array(F.lit("")))).alias("pos", "word"))
    mark = docs.sparkSession.range(1).select(F.lit("").alias("anchor"))
    parts = []
    for k in range(max(blocks, 1)):
        these = anchors.where(F.col("k") == k).drop("k", "wid", "count")
        if k == 0:
            these = these.unionByName(mark, allowMissingColumns=True)
        start = F.col("pos") - F.col("off")
        fits = (start >= 0) & (start + F.size("w") <= F.size("v"))
        near = F.col("second").isNull() | (F.try_element_at("v", (start + F.col("off2") + 1).cast("int")) == F.col("second"))
        same = F.slice("v", F.greatest(start + 1, F.lit(1)), F.size("w")) == F.col("w")
        joined = marked.join(F.broadcast(these), (F.col("word") == F.col("anchor")) & (F.col("w").isNull() | F.when(fits & near, same).otherwise(False)))
        parts.append(joined.select("doc_id", "h1", "h2", F.when(F.col("w").isNull(), F.size("v")).alias("n_words"), F.when(F.col("w").isNotNull(), F.struct(start.alias("s"), (start + F.size("w")).alias("e"))).alias("hit"), "items"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    by = hits.groupBy("doc_id", "h1", "h2").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    covered = F.aggregate(F.array_sort("hits"), zero, lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, a.e))).alias("n"), F.greatest(a.e, x.e).alias("e")), lambda a: a.n)
    out = by.select("doc_id", "h1", "h2", "copies", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, share: int = 20, block: int = 100_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A document word is hit if it lies in an occurrence of a window; contaminated: n_hit > 0 and share * n_hit >= n_words.
    Null and empty texts have no words and are clean; null benchmark texts or ids are left out; an empty benchmark hits
    nothing. Repeated rows give repeated results; rows that share an id but not a text are kept apart.
    """
    out = _scan(docs, benchmark, doc_id, text, item_id, item_text, width, share, block)
    # repeated rows have met in one group
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("c")).drop("c")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, share: int = 20, block: int = 100_000) -> DataFrame:
    """The rows of docs that contamination() does not call contaminated, with their columns."""
    found = _scan(docs, benchmark, doc_id, text, item_id, item_text, width, share, block)
    keys = materialize(found.where("contaminated").select(F.col("doc_id").alias("#id"), F.col("h1").alias("#h1"), F.col("h2").alias("#h2")), "contaminated")
    # a table of numbers: broadcast while it is short
    keys = F.broadcast(keys) if keys.count() <= 1_000_000 else keys
    whole = F.coalesce(F.col(text), F.lit(""))
    same = F.col(doc_id).eqNullSafe(F.col("#id")) & (F.xxhash64(whole) == F.col("#h1")) & (F.crc32(whole.cast("binary")) == F.col("#h2"))
    return docs.join(keys, same, "left_anti")


#: The contract of op7 for DuckDB.
ORACLE = r"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(list_slice(v, s, s + 12), ' ') AS w, least(len(v), 13) AS n
  FROM (SELECT item, v, unnest(generate_series(1, greatest(1, len(v) - 12))) AS s FROM iw WHERE len(v) > 0)),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.r, d.s, win.n, win.item FROM (SELECT r, v, n, unnest(generate_series(1, len(v) - n + 1)) AS s FROM dw, sizes WHERE len(v) >= n) d
  JOIN win ON win.n = d.n AND win.w = array_to_string(list_slice(d.v, d.s, d.s + d.n - 1), ' ')),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT r, s, n FROM occ)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS l FROM occ GROUP BY r)
SELECT doc_id, CAST(len(v) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(v) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
