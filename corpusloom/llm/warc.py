"""WARC archives: written by Spark's text sink, read back in byte ranges with boundary-chain verification.

Writing: every row of a page table becomes a response record, or a revisit record where a smaller page id has the same
payload. Reading, as bytes: the files are split at every "WARC/1.", inside payloads too. Tasks emit each candidate's offset
and that of its successor, by its Content-Length, and follow chains to the end of their byte range. Pointer jumping over
the ranges, from each file's start, keeps the candidates that are real records; magic inside payloads is never reached.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.session import materialize, scratch_path, small_batches

#: What begins a record, and what may follow it.
MAGIC = b"WARC/1."
_VERSIONS = (b"0\r\n", b"1\r\n")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A digest table of so many rows at most is broadcast; a longer one is joined by shuffle.
_BROADCAST_ROWS = 200_000


def records(pages: DataFrame, page_id: str = "page_id", content: str = "html", url: str = "url", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One record (column value, without its last line end) for each row.

    Of equal payloads of at least `least` bytes that with the smallest id is the response and the others revisit it; rows
    that share the smallest id too are all responses. A null page is an empty payload. A null id is never referred to, but
    may revisit; without any id to refer to such rows are responses. Only digests that occur twice are joined back.
    """
    payload = F.coalesce(F.col(content), F.lit(""))
    target = F.col(url) if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(page_id).alias("id"), payload.alias("payload"), F.regexp_replace(target, r"[\r\n]", "").alias("url"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    shared = materialize(rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"), "digests")
    few = shared.count() <= _BROADCAST_ROWS
    rows = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    revisit = F.coalesce(~F.col("first").eqNullSafe(F.col("id")) & F.col("first").isNotNull(), F.lit(False))

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")

    # escaped, so any text can be an id; a null one has no colon
    urn = lambda x: F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(x.cast("string"))), F.lit("")), F.lit(">"))
    length = F.lit(len(_HTTP)) + F.when(revisit, 0).otherwise(F.col("size"))
    value = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", urn(F.col("id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Profile", F.when(revisit, _PROFILE)),
        field("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        field("X-Payload-Length", F.col("size").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")),
        F.lit("\r\n" + _HTTP),
        F.when(revisit, "").otherwise(F.col("payload")),
        F.lit("\r\n"),
    )
    return rows.select(value.alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write records() as WARC files into a folder of any file system that Spark writes to."""
    records(pages, **options).write.option("lineSep", "\r\n").text(path)


_FIELD = re.compile(r"^([A-Za-z-]+):[ \t]*([^\r\n]*)", re.M)
_KINDS = "block long, place long, size long, header long, length long, type string, id string, refers string, uri string, digest string, full long, got_bytes long, got_digest string, payload binary, follows long"


def _parse(raw: bytes) -> tuple[int, dict[str, str]] | None:
    """Bytes of a header with its empty line, and its fields in lower case; None if it isn't one. Odd bytes in it are replaced."""
    stop = raw.find(b"\r\n\r\n")
    if stop < 0 or not raw.startswith(_VERSIONS):
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(raw[:stop].decode("utf-8", "replace"))}
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "").strip()) or "warc-type" not in fields:
        return None
    return stop + 4, fields


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header."""
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if at >= 0 and block.startswith(b"HTTP/") else block


def _candidates(keep: bool):
    magic = len(MAGIC)

    def run(batches):
        """Rows of a byte range in order; place is the offset of a row's magic in its range, follows where its chain leaves it."""
        key, place, rows = None, 0, []

        def flush():
            if not rows:
                return None
            leave: dict[int, int] = {}
            for r in reversed(rows):
                end = None if r["length"] is None else r["place"] + magic + r["header"] + r["length"] + 4
                r["follows"] = None if end is None else leave.get(end, end)
                leave[r["place"]] = r["follows"] if r["follows"] is not None else -1
            out = pa.RecordBatch.from_pylist(rows, schema=schema)
            rows.clear()
            return out

        text, long = pa.string(), pa.int64()
        schema = pa.schema([("file", text), ("block", long), ("place", long), ("size", long), ("header", long), ("length", long), ("type", text), ("id", text), ("refers", text), ("uri", text), ("digest", text), ("full", long), ("got_bytes", long), ("got_digest", text), ("payload", pa.binary()), ("follows", long)])
        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (file, block):
                    done = flush()
                    if done:
                        yield done
                    # what stands before a file's first magic is no record
                    key, place = (file, block), 0 if block == 0 else magic
                raw = value
                at, place = place - magic, place + len(raw) + magic
                row = dict.fromkeys(schema.names) | {"file": file, "block": block, "place": at, "size": len(raw)}
                head = _parse(value) if at >= 0 or block else None
                if head:
                    n, f = head
                    length = int(f["content-length"])
                    row |= {"header": n, "length": length, "type": f["warc-type"], "id": f.get("warc-record-id"), "refers": f.get("warc-refers-to"), "uri": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest"), "full": int(f["x-payload-length"]) if f.get("x-payload-length", "").isdigit() else None}
                    if n + length <= len(raw):
                        payload = _payload(raw[n : n + length])
                        row |= {"got_bytes": len(payload), "got_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if keep else None}
                rows.append(row)
        done = flush()
        if done:
            yield done

    return run


def _walk(table: pa.Table) -> pa.Table:
    """Of one byte range's candidates those that the chain from its entry reaches."""
    rows = {r["place"]: r for r in table.to_pylist()}
    at, out = table["entry"][0].as_py(), []
    while at in rows:
        out.append(rows[at])
        if rows[at]["length"] is None:
            break
        at += len(MAGIC) + rows[at]["header"] + rows[at]["length"] + 4
    return pa.Table.from_pylist(out, schema=table.schema)


def _reached(entries: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(file, at) of all entries on the chains from the starts, by pointer jumping: entries are (file, at, to)."""
    reach, jump = starts, entries
    for _ in range(hops):
        new = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).where(F.col("at").isNotNull())
        reach = materialize(reach.unionByName(new).distinct(), "reach")
        on = jump.select(F.col("file"), F.col("at").alias("to"), F.col("to").alias("to2"))
        jump = materialize(jump.join(on, ["file", "to"]).select("file", "at", F.col("to2").alias("to")), "jump")
    return reach


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row a record: file, offset, type, id, refers, uri, payload_bytes, payload_digest, verified, (payload).

    Versions 1.0 and 1.1, also as .gz (a file a task, offsets of the unpacked bytes); payloads are bytes of any kind.
    payload_bytes and payload_digest (lower-case hex SHA-256) are of the full payload: read and checked for records that
    hold it, as stated for revisits. verified is false where a record's payload does not match its stated digest. A file
    that is cut short ends with its last record that is whole; one that does not begin with the magic line has none.
    """
    small_batches(spark)
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    rows = materialize(raw.mapInArrow(textops.lean(_candidates(keep_payload)), "file string, " + _KINDS), "candidates")
    magic = F.lit(len(MAGIC))
    sums = rows.groupBy("file", "block").agg(F.sum(F.col("size") + magic).alias("bytes"))
    # a few rows a file: one for each byte range that holds a row's start
    order = Window.partitionBy("file").orderBy("block")
    bases = sums.select("file", "block", (F.sum("bytes").over(order) - F.col("bytes") - F.when(F.col("block") > 0, magic).otherwise(0)).alias("base"), F.row_number().over(order).alias("nth"))
    bases = materialize(bases, "bases")
    most = bases.agg(F.max("nth")).first()[0] or 0
    placed = rows.join(bases, ["file", "block"])
    head = F.col("base") + F.col("place")
    if most > 1:
        leaves = placed.select("file", head.alias("at"), (F.col("base") + F.col("follows")).alias("to"))
        aims = leaves.select("file", F.col("to").alias("at")).where(F.col("at").isNotNull()).unionByName(rows.select("file").distinct().withColumn("at", F.lit(0).cast("long"))).distinct()
        entries = materialize(leaves.join(aims, ["file", "at"]), "entries")
        starts = materialize(entries.where("at = 0").select("file", "at"), "starts")
        reach = _reached(entries, starts, (most - 1).bit_length())
    else:
        reach = rows.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    entry = placed.select("file", "block", "place", head.alias("at")).join(reach, ["file", "at"]).groupBy("file", "block").agg(F.min("place").alias("entry"))
    # a byte range has a bounded number of candidates
    real = placed.join(entry, ["file", "block"]).groupBy("file", "block").applyInArrow(_walk, placed.join(entry, ["file", "block"]).schema)
    real = materialize(real.where("length IS NOT NULL").withColumn("offset", head), "records")
    torn = real.where("got_bytes IS NULL")
    if torn.limit(1).count():
        real = real.where("got_bytes IS NOT NULL").unionByName(_mend(raw, rows, bases, torn, keep_payload).select(real.columns))
    stated = F.regexp_replace("digest", "^sha256:", "")
    holds = F.col("type") != "revisit"
    out = real.select("file", "offset", "type", "id", "refers", "uri", F.when(holds, F.col("got_bytes")).otherwise(F.coalesce("full", "got_bytes")).alias("payload_bytes"), F.when(holds, F.col("got_digest")).otherwise(F.coalesce(stated, F.col("got_digest"))).alias("payload_digest"), F.coalesce(~holds | stated.isNull() | (stated == F.col("got_digest")), F.lit(True)).alias("verified"), "payload")
    return out if keep_payload else out.drop("payload")


def _mend(raw: DataFrame, rows: DataFrame, bases: DataFrame, torn: DataFrame, keep: bool, stretch: int = 1 << 16) -> DataFrame:
    """Real records whose payload holds the magic line: their bytes are put together from the rows that they span."""
    magic, size = F.lit(len(MAGIC)), len(MAGIC)

    def number(batches):
        key, place = None, 0
        for batch in batches:
            places = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (file, block):
                    key, place = (file, block), 0 if block == 0 else size
                places.append(place - size)
                place += len(value) + size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["file", "block", "value", "place"])

    files = torn.select("file").distinct()
    texts = raw.mapInArrow(textops.lean(number), "file string, block long, value binary, place long").join(files, "file", "left_semi").join(bases, ["file", "block"])
    # rows and records meet in stretches of a file, not in the file, which may hold many of both
    nth = lambda x: F.floor(x / stretch)
    texts = texts.select("file", (F.col("base") + F.col("place")).alias("from"), "value").withColumn("nth", nth(F.col("from")))
    spans = torn.select("file", F.col("offset").alias("r"), (F.col("offset") + magic + F.col("header") + F.col("length")).alias("stop"))
    spans = spans.withColumn("nth", F.explode(F.sequence(nth(F.col("r")), nth(F.col("stop") - 1))))
    # the rows of one record: no more bytes than it has itself
    parts = texts.join(spans, ["file", "nth"]).where((F.col("from") >= F.col("r")) & (F.col("from") < F.col("stop")))
    whole = parts.groupBy("file", "r").agg(F.array_sort(F.collect_list(F.struct("from", "value"))).alias("parts"))
    joined = torn.drop("got_bytes", "got_digest", "payload").join(whole, (torn["file"] == whole["file"]) & (torn["offset"] == whole["r"])).drop(whole["file"]).drop("r")

    def finish(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                whole = MAGIC.join(p["value"] for p in r["parts"])
                block = whole[r["header"] : r["header"] + r["length"]]
                if len(block) == r["length"]:
                    payload = _payload(block)
                    out.append({k: v for k, v in r.items() if k != "parts"} | {"got_bytes": len(payload), "got_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if keep else None})
            text, long = pa.string(), pa.int64()
            own = [f for f in batch.schema if f.name != "parts"]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*own, ("got_bytes", long), ("got_digest", text), ("payload", pa.binary())]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "parts")
    return joined.mapInArrow(textops.lean(finish), fields + ", got_bytes long, got_digest string, payload binary")


def archive_round_trip(pages: DataFrame, path: str | None = None, page_id: str = "page_id") -> DataFrame:
    """Write pages as archives (into the shared folder unless a path is given) and read them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to, verified for each row; see records() for nulls and ties.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, page_id=page_id)
    kind = pages.schema[page_id].dataType.simpleString()
    own = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1))).cast(kind)
    read = read_archives(spark, path)
    return read.select(own("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", own("refers")).alias("refers_to"), "verified")


#: The contract of op5 for DuckDB.
ORACLE = """
SELECT page_id, strlen(p) AS payload_bytes, sha256(p) AS payload_digest,
  CASE WHEN strlen(p) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(p) >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS verified
FROM (SELECT page_id, coalesce(html, '') AS p, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
