"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is cut into runs of letters, digits and punctuation. Features, hashed into 2^bits places, are the 1- to 3-grams of
these words and the 1- to 3-grams of their shapes (class, case and length), which carry over to words never seen. Values are
log(1 + count), scaled to length 1. The score is the logistic function of one sparse dot product. Only the text is used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.session import materialize, small_batches

_b = np.arange(256)
_letter = ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
_digit = (_b >= 48) & (_b <= 57)
_blank = (_b <= 32) | (_b == 127)
#: 0 blank, 1 letter, 2 digit, 3 punctuation.
CLASS = np.where(_blank, 0, np.where(_letter, 1, np.where(_digit, 2, 3))).astype(np.uint8)
_UPPER = ((_b >= 65) & (_b <= 90)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature places and values of some rows, and where each row's begin; places are distinct within a row."""
    seg, rows = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    low, kind = textops.LOWER[seg], CLASS[seg]
    edge = np.ones(len(seg) + 1, bool)
    if len(seg):
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[rows] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    ptr = np.searchsorted(start, rows)
    word = textops.hash_spans(low, start, end)
    caps = np.concatenate([[0], np.cumsum(_UPPER[seg])])
    upper, size = caps[end] - caps[start], end - start
    first = _UPPER[seg[start]] if len(start) else upper
    case = np.where(upper == 0, 0, np.where(upper == size, 1, np.where((upper == 1) & (first == 1), 2, 3)))
    # punctuation keeps its bytes; words keep class, case and a coarse length
    shape = np.where(kind[start] == 3, word, textops.mix((kind[start].astype(np.uint64) << np.uint64(8)) | (case.astype(np.uint64) << np.uint64(4)) | np.minimum(size // 4, 7).astype(np.uint64))) if len(start) else word
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    parts, where = [], []
    for runs, salt in ((word, 1), (shape, 7)):
        gram = textops.mix(runs + np.uint64(salt))
        parts.append(gram)
        where.append(row)
        for n in (2, 3):
            gram = textops.mix(gram[:-1] * np.uint64(31) + runs[n - 1 :])
            whole = row[n - 1 :] == row[: max(len(row) - n + 1, 0)]
            parts.append(gram[whole])
            where.append(row[n - 1 :][whole])
    place = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique((np.concatenate(where) << bits) | place, return_counts=True)
    row, value = key >> bits, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, len(ptr) - 1))
    return key & ((1 << bits) - 1), value / norm[row], np.searchsorted(row, np.arange(len(ptr)))


def _rows(column: pa.Array, bits: int):
    """features() of a column, slice by slice, with the number of rows."""
    data, offsets = textops.buffers(column)
    for lo, hi in textops.slices(offsets):
        yield hi - lo, *features(data, offsets[lo : hi + 1], bits)


class Ftrl:
    """Follow-the-regularised-leader, per-coordinate, for the logistic loss; the last coordinate is the bias."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, place: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(place, -1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(table: pa.Table, bits: int, epochs: int, seed: int = 7, step: int = 500) -> np.ndarray:
    """Weights after some passes over the rows of (id, text, label), in an order that does not depend on theirs.

    Rows are taken a few at a time and their features made anew in each pass, so only the texts stay in memory.
    """
    model, rng = Ftrl(bits), np.random.default_rng(seed)
    order = pc.sort_indices(table, [("id", "ascending"), ("label", "ascending"), ("text", "ascending")]).to_numpy()
    for _ in range(epochs):
        for at in range(0, len(order), step):
            part = table.take(pa.array(order[at : at + step]))
            labels, done = part["label"].to_numpy(), 0
            for n, place, value, ptr in _rows(part["text"].combine_chunks(), bits):
                for i in rng.permutation(n):
                    model.learn(place[ptr[i] : ptr[i + 1]], value[ptr[i] : ptr[i + 1]], int(labels[done + i]))
                done += n
    return model.weights()


def scores(texts: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    """Probability of label 1 for each row."""
    out = [np.bincount(np.repeat(np.arange(n), np.diff(ptr)), weights[place] * value, n) for n, place, value, ptr in _rows(texts, bits)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out) + weights[-1], -35, 35))) if out else np.zeros(0)


def in_training(doc_id: str):
    """The fold that may be learned from: crc32 of the id as text is no multiple of 5. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bits: int = 18, epochs: int = 2, max_rows: int = 8_000, max_bytes: int = 64 << 20) -> np.ndarray:
    """Train on at most about max_rows labelled rows outside the held-out fold, picked by a hash of the id, of max_bytes at most.

    The sample is bounded, so one task trains on it and only the weights come to the driver: rows are taken whole, in the
    hash's order, until max_bytes are used; texts of more than an eighth of that are not learned from. Null labels and null ids are
    left out, as are labels other than 0 and 1. Of rows that share an id the least text and the larger label count, once. Without any labelled row all weights are 0 and each score is 0.5.
    """
    usable = labels.where(in_training(doc_id) & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = usable.count()
    order = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    if n > max_rows:
        usable = usable.where(order < int(max_rows / n * (1 << 30)))
    picked = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(usable), "id")
    # an id that occurs often counts once
    short = picked.where(F.octet_length("text") <= max_bytes // 8)
    picked = materialize(short.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "sample")
    # numbers of a sample of bounded rows
    size = picked.select("id", F.octet_length("text").cast("long").alias("size"), order.alias("h"))
    if (size.agg(F.sum("size")).first()[0] or 0) > max_bytes:
        kept = size.withColumn("used", F.sum("size").over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= max_bytes)
        picked = picked.join(F.broadcast(kept.select("id")), "id", "left_semi")

    def learn(batches):
        # the sample is bounded by max_rows and max_bytes, so it fits one worker
        parts = list(batches)
        if not parts:
            return
        w = train(pa.Table.from_batches(parts), bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(w.astype(np.float32).tobytes(), 1)], pa.binary())], ["w"])

    found = picked.select(F.col("id").cast("string").alias("id"), "text", "label").repartition(1).mapInArrow(textops.lean(learn), "w binary").first()
    return np.frombuffer(zlib.decompress(found["w"]), np.float32).astype(np.float64) if found else np.zeros((1 << bits) + 1)


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, after the columns named in carry.

    Null and empty texts get the score of the bias alone. Repeated rows each get theirs. A null id counts as held out.
    """
    small_batches(docs.sparkSession)
    bits = (len(weights) - 2).bit_length()
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [f for f in docs.schema.fields if f.name in carry and f.name not in (doc_id, "held_out", "score", "predicted")]

    def run(batches):
        for batch in batches:
            got = scores(batch.column(batch.num_columns - 1), sent.value, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], [*batch.schema.names[:-1], "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(doc_id).alias("doc_id"), (~in_training(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("#text"))
    out = rows.mapInArrow(textops.lean(run), (fields + ", " if fields else "") + f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    bits, at = (len(weights) - 2).bit_length(), docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), sent.value, bits) >= threshold))

    return docs.mapInArrow(textops.lean(run), docs.schema)
