"""Chunking: one document row to many chunk rows with offsets and content-addressed ids."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import lexical_density, python_lexical_density
from corpusloom.session import lean, small_batches


def chunk_id(document_id: Column | str, index: Column | str) -> Column:
    return F.concat(F.lit("chunk:"), F.substring(F.sha2(F.concat_ws(":", document_id, F.col(index) if isinstance(index, str) else index), 256), 1, 16))


def content_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def windows(text: Column | str = "text", size: int = 512, overlap: int = 64) -> Column:
    """Array of windows of `size` characters that share `overlap` with the next; empty for empty text.

    Each match of the pattern is a step, and looks ahead over its window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    step, x = size - overlap, F.col(text) if isinstance(text, str) else text
    last = F.greatest(F.lit(0), F.ceil((F.length(x) - size) / F.lit(float(step)))).cast("int")
    return F.slice(F.regexp_extract_all(x, F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), last + 1)


def fixed_window(docs: DataFrame, size: int = 512, overlap: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """windows() as rows, with ids, hashes and offsets; none for empty text. A map over rows, no shuffle."""
    n = F.length("text")
    each = docs.where(n > 0).select("document_id", *keep, n.alias("whole"), F.posexplode(windows("text", size, overlap)).alias("i", "text"))
    start = F.col("i") * (size - overlap)
    return each.select("document_id", *[k for k in keep if k == "doc_id"], F.col("i").cast("long").alias("chunk_index"), chunk_id("document_id", "i").alias("chunk_id"), "text", content_hash(F.col("text")).alias("content_hash"), start.cast("long").alias("char_start"), F.least(start + size, F.col("whole")).cast("long").alias("char_end"), *[k for k in keep if k != "doc_id"])


def map_span(chunks: DataFrame, spans: str = "spans") -> DataFrame:
    """Add span: the first of a document's spans that contains the chunk's start, its end clipped; else the first span."""
    inside = F.filter(spans, lambda s: (s.offset_start <= F.col("char_start")) & (F.col("char_start") < s.offset_end))
    hit = F.try_element_at(inside, F.lit(1))
    chosen = F.struct(hit.artifact_id.alias("artifact_id"), hit.page.alias("page"), F.col("char_start").alias("offset_start"), F.least(F.col("char_end"), hit.offset_end).alias("offset_end"))
    return chunks.withColumn("span", F.when(hit.isNotNull(), chosen).otherwise(F.try_element_at(F.col(spans), F.lit(1))))


def token_windows(docs: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """Windows of blank-separated tokens, joined by one space."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    step = size - overlap
    each = docs.select("document_id", words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / F.lit(float(step)))).cast("int")
    return each.select("document_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("document_id", F.col("i").cast("long").alias("chunk_index"), F.array_join(F.slice("w", F.col("i") * step + 1, size), " ").alias("text"))


#: Separators from the coarsest to single characters.
_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")


def _units(text: str, size: int, separators: tuple[str, ...]) -> Iterator[str]:
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else ()
    if not sep:
        yield from text
        return
    at = 0
    while at <= len(text):
        cut = text.find(sep, at)
        part = text[at : cut + len(sep)] if cut >= 0 else text[at:]
        if len(part) <= size or not finer:
            yield part
        else:
            yield from pieces(part, size, 0, finer)
        if cut < 0:
            return
        at = cut + len(sep)


def pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = _SEPARATORS) -> Iterator[str]:
    """Pieces of at most size characters, cut at the coarsest separator that occurs, joined up to size with overlap; one at a time,
    so that a long text is never held as a list of its parts."""
    run = ""
    for unit in _units(text, size, separators) if text else ():
        if run and len(run) + len(unit) > size:
            if x := run.strip():
                yield x
            tail = run[len(run) - overlap :] if overlap else ""
            run = tail if len(tail) + len(unit) <= size else ""
        run += unit
    if x := run.strip():
        yield x


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = _SEPARATORS) -> list[str]:
    return list(pieces(text, size, overlap, separators))


#: Pieces of a batch that a worker hands on.
_PIECES = 2_000


def recursive(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """document_id, chunk_index, text of the recursive splitter; rows stay in their partitions, a worker holds one text and its next
    pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string()]
        for b in batches:
            every = ((d.as_py(), i, t) for d, text in zip(*b.columns, strict=True) for i, t in enumerate(pieces(text.as_py() or "", size, overlap)))
            while rows := list(islice(every, _PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["document_id", "chunk_index", "text"])

    small_batches(docs.sparkSession)
    return docs.select("document_id", "text").mapInArrow(lean(run), "document_id string, chunk_index long, text string")


def semantic_groups(similarities: list[float], sizes: list[int], most: int = 3000, threshold: float = 0.3, least: int = 500) -> list[int]:
    """Group number of each sentence; similarities[i] is between sentences i and i + 1. A short last group joins the one before."""
    groups, size, g = [0] if sizes else [], sizes[0] if sizes else 0, 0
    for i in range(1, len(sizes)):
        if size >= most or (similarities[i - 1] < threshold and size >= least):
            g, size = g + 1, 0
        groups.append(g)
        size += sizes[i]
    if g > 0 and size < least:
        groups = [min(x, g - 1) for x in groups]
    return groups


def semantic(docs: DataFrame, dims: int = 64) -> DataFrame:
    """document_id, chunk_index, text: sentences grouped while neighbours' hashed term vectors are alike."""
    import re
    import zlib

    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, text in zip(b["document_id"], b["text"], strict=True):
                sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if s.strip()]
                v = np.zeros((len(sentences), dims))
                for i, s in enumerate(sentences):
                    for w in s.lower().split():
                        v[i, zlib.crc32(w.encode()) % dims] += 1
                norm = np.linalg.norm(v, axis=1)
                near = [float(v[i] @ v[i + 1] / (norm[i] * norm[i + 1])) if norm[i] and norm[i + 1] else 0.0 for i in range(len(v) - 1)]
                groups = semantic_groups(near, [len(s) for s in sentences])
                for g in sorted(set(groups)):
                    rows.append((d, g, " ".join(s for s, x in zip(sentences, groups, strict=True) if x == g)))
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "text"])

    small_batches(docs.sparkSession)
    return docs.select("document_id", "text").mapInPandas(lean(run), "document_id string, chunk_index long, text string")


def rechunk_triggers(chunks: DataFrame, low: float = 0.4, always: float = 0.2, share: float = 0.3) -> DataFrame:
    """Per document: chunks, low_chunks, needs_rechunk, by the lexical density of its chunks."""
    d = chunks.select("document_id", lexical_density("text").alias("ld"))
    by = d.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("ld") < low).alias("low_chunks"), F.min("ld").alias("least"))
    return by.select("document_id", "chunks", "low_chunks", ((F.col("low_chunks") / F.col("chunks") > share) | (F.col("least") < always)).alias("needs_rechunk"))


def merge_low_density(texts: list[str], low: float = 0.4, always: float = 0.2, most: int = 2048) -> list[tuple[str, int]]:
    """Neighbouring chunks of low density joined by a newline while they fit; each with the number of merges."""
    out, i = [], 0
    while i < len(texts):
        text, merges = texts[i], 0
        density = python_lexical_density(text)
        for following in texts[i + 1 :]:
            after = python_lexical_density(following)
            fits = len(text) + len(following) <= most
            both = density < low and after < low
            if not fits or not (both or density < always or (after < always and density < low)):
                break
            text, merges = f"{text}\n{following}", merges + 1
            density = python_lexical_density(text)
        out.append((text, merges))
        i += merges + 1
    return out


def adaptive(chunks: DataFrame, low: float = 0.4, share: float = 0.3, fallback_size: int = 800, fallback_overlap: int = 100) -> DataFrame:
    """Rechunked documents: document_id, chunk_index, text, merges. Documents are bounded groups; others are not shuffled in."""
    marked = chunks.join(rechunk_triggers(chunks, low).where("needs_rechunk").select("document_id"), "document_id", "left_semi")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_index")
        merged = merge_low_density(pdf["text"].tolist(), low)
        poor = [python_lexical_density(t) < low for t, _ in merged]
        if sum(poor) / len(poor) > share:
            merged = [(piece, m) for (t, m), bad in zip(merged, poor, strict=True) for piece in (split_recursively(t, fallback_size, fallback_overlap) if bad else [t])]
        return pd.DataFrame({"document_id": pdf["document_id"].iloc[0], "chunk_index": range(len(merged)), "text": [t for t, _ in merged], "merges": [m for _, m in merged]})

    return marked.groupBy("document_id").applyInPandas(fold, "document_id string, chunk_index long, text string, merges long")


def overlap_coverage(chunks: DataFrame) -> DataFrame:
    """Gap from each chunk's end to the next one's start: negative where they overlap, 0 for the last."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.select("document_id", "chunk_index", F.coalesce(F.lead("char_start").over(w) - F.col("char_end"), F.lit(0)).alias("gap"))
