"""Token counts without a shuffle: a broadcast table of frequent pre-tokens, worker caches for the rest.

SentencePiece BPE merges never cross the start of a space run, as no piece holds the space mark after another
character, nor a newline, which is always a byte token of its own. So a text's count is the sum over its space-separated
pre-tokens (cut before newlines too). The frequent ones are looked up in a small table made on the driver from a bounded
sample; that table and the caches only save work, every count is the library's.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.session import small_batches

#: The library's mark for a space.
MARK = "▁"


class _Lengths(dict):
    """Pre-token to number of tokens; what is missing is encoded, and kept while there is room."""

    def __init__(self, encode, known: dict[str, int], room: int):
        super().__init__(known)
        self.known, self.room, self.encode = known, len(known) + room, encode

    def __missing__(self, word: str) -> int:
        # a newline can't join with the mark that the library puts first, which is not in the text
        n = len(self.encode(word)) - word.startswith("\n")
        if len(word) <= 64:
            if len(self) >= self.room:
                self.clear()
                self.update(self.known)
            self[word] = n
        return n


def run_lengths(encode, room: int) -> _Lengths:
    """Keyed by pre-tokens with their marks; the library adds the first mark itself, and an only mark is one token."""
    return _Lengths(lambda x: encode(x[1:]) if len(x) > 1 else [0], {}, room)


def count_tokens(text: str, plain: _Lengths, runs: _Lengths) -> int:
    """Tokens of one text."""
    if not text:
        return 0
    marked = MARK + text.replace(" ", MARK)
    if MARK * 2 in marked or marked.endswith(MARK):
        return sum(runs[x] for x in re.findall(f"{MARK}+[^{MARK}]*", marked))
    # a newline after a space stays with that space's mark; elsewhere it begins a pre-token
    cut = marked.replace("\n", MARK + "\n") if "\n" in marked else marked
    if MARK * 2 in cut:
        return sum(runs[x] for x in re.findall(f"{MARK}+[^{MARK}]*", marked))
    return sum(map(plain.__getitem__, cut.split(MARK)[1:]))


def frequent(docs: DataFrame, text: str, encode, sample_rows: int, table_size: int) -> dict[str, int]:
    """Token counts of the commonest pre-tokens in at most sample_rows texts of bounded length."""
    seen: Counter[str] = Counter()
    for row in docs.where(F.length(text) <= 20_000).select(text).limit(sample_rows).collect():
        seen.update(x for x in row[0].replace("\n", " \n").split(" ") if x and MARK not in x)
    lengths = _Lengths(encode, {}, table_size)
    return {x: lengths[x] for x, _ in seen.most_common(table_size)}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, sample_rows: int = 1000, table_size: int = 20_000, cache_size: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row, by a SentencePiece BPE model file with byte fallback.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are kept as they are; other columns are
    left out. An empty table gives no rows. sample_rows and table_size bound what is sent to the driver and broadcast.
    """
    from sentencepiece import SentencePieceProcessor

    with open(model, "rb") as f:
        proto = f.read()
    small_batches(docs.sparkSession)
    known = frequent(docs, text, SentencePieceProcessor(model_proto=proto).encode, sample_rows, table_size)
    sent = docs.sparkSession.sparkContext.broadcast((proto, known))

    def count(batches):
        from sentencepiece import SentencePieceProcessor

        proto, known = sent.value
        encode = SentencePieceProcessor(model_proto=proto).encode
        plain, runs = _Lengths(encode, known, cache_size), run_lengths(encode, cache_size // 4)
        for batch in batches:
            n = [count_tokens(x, plain, runs) if x else 0 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    counted = rows.mapInArrow(textops.lean(count), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
