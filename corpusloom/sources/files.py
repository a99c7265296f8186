"""File sources: scan, type detection, safety gates, parsers and feeds. Sinks: upserts, tombstones, exports."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from corpusloom.functions import text as T
from corpusloom.session import lean, materialize, small_batches

# Leading bytes of file types.
MAGIC = {"application/pdf": "25504446", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/gif": "47494638", "application/zip": "504B0304", "application/x-ole": "D0CF11E0A1B11AE1"}
# Extensions and parsers.
EXTENSIONS = {"html": "text/html", "htm": "text/html", "json": "application/json", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg"}
MOST_BYTES = 200 * 1024 * 1024


def scan(spark: SparkSession, folder: str, skip_suffixes: tuple[str, ...] = (".tmp", ".part", ".lock")) -> DataFrame:
    """All files below a folder: path, modificationTime, length, content; dot files and skipped suffixes left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    keep = ~name.startswith(".")
    for suffix in skip_suffixes:
        keep = keep & ~name.endswith(suffix)
    return files.where(keep)


def register(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Content-addressed artifacts, each once, without those that are known already."""
    new = files.withColumn("artifact_id", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    first = new.groupBy("artifact_id").agg(F.min("path").alias("source_uri"), F.first("length").alias("byte_size"))
    return first if known is None else first.join(known.select("artifact_id"), "artifact_id", "left_anti")


def starts_with(content: Column, signature: str) -> Column:
    return F.hex(F.substring(content, 1, len(signature) // 2)) == signature


def detect_mime(content: Column, name: Column) -> Column:
    """Leading bytes first, then the extension, then whether it is UTF-8 text."""
    out = F.when(F.is_valid_utf8(content.cast("string")) & (F.length(content) > 0), "text/plain").otherwise("application/octet-stream")
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    for e, mime in EXTENSIONS.items():
        out = F.when(ext == e, mime).otherwise(out)
    for mime, signature in reversed(MAGIC.items()):
        out = F.when(starts_with(content, signature), mime).otherwise(out)
    return out


def route(mime: Column) -> Column:
    """Parser of a type."""
    return F.when(mime == "application/pdf", "pymupdf").when(mime.startswith("text/html"), "html").when(mime == "application/json", "json").when(mime.startswith("text/"), "text").when(mime.startswith("image/"), "image").otherwise("unknown")


def file_type(content: Column) -> Column:
    """Any one signature suffices: a bare RIFF is taken for webp."""
    head = F.hex(F.substring(content, 1, 16))
    low = F.lower(F.substring(content, 1, 256).cast("string"))
    html = F.contains(low, F.lit("<html")) | F.contains(low, F.lit("<!doctype"))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif").when(head.startswith("52494646"), "webp").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "ole2").when(html, "html").otherwise("unknown")


def validated(files: DataFrame, content: str = "content", length: str = "length", expected: str = "expected") -> DataFrame:
    """Add reject: why a download is refused, null if it is fine."""
    n = F.col(length)
    reason = F.when(n == 0, "empty").when(n > MOST_BYTES, "too large").when((F.col(expected) != "unknown") & (file_type(F.col(content)) != F.col(expected)), "type mismatch")
    return files.withColumn("reject", reason)


def quarantine(files: DataFrame, folder: str) -> DataFrame:
    """Write what is refused with its reason and return the rest; scanners plug in by adding reasons."""
    files.where("reject IS NOT NULL").write.mode("append").partitionBy("reject").parquet(folder)
    return files.where("reject IS NULL").drop("reject")


def html_text(x: Column | str) -> Column:
    """Text of a page without scripts, styles, comments and tags, by patterns alone."""
    y = F.regexp_replace(T.col(x), r"(?is)<script[^>]*>.*?</script>", " ")
    y = F.regexp_replace(y, r"(?is)<style[^>]*>.*?</style>", " ")
    y = F.regexp_replace(F.regexp_replace(y, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(y, "\n{3,}", "\n\n"), "[ \t]{2,}", " "), r"^\s+|\s+$", "")


@F.pandas_udf(StructType().add("content", "string").add("keys", "string"))
def _json_document(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for x in raw:
        try:
            data = None if x is None else json.loads(x)
        except ValueError:
            rows.append((x, None))
            continue
        own = isinstance(data, dict) and isinstance(data.get("text"), str)
        text = data["text"] if own else None if x is None else json.dumps(data, indent=2, ensure_ascii=False, sort_keys=True)
        rows.append((text, ",".join(sorted(k for k in data if not own or k != "text")) if isinstance(data, dict) else "" if x is not None else None))
    return pd.DataFrame(rows, columns=["content", "keys"])


def json_document(x: Column | str) -> tuple[Column, Column]:
    """Content of the text key, if it is a string, or else the whole printed anew with sorted keys and two blanks a level; and the
    sorted (other) keys. What can't be read stays as it is, without keys."""
    read = _json_document(T.col(x))
    return read["content"], read["keys"]


def parse(files: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """path, pages and needs_ocr (under a tenth of the pages have more than 50 characters) by a pluggable page parser."""

    def run(batches):
        for b in batches:
            pages = [parser(x) for x in b["content"]]
            rich = [sum(len(p) > 50 for p in ps) for ps in pages]
            yield pd.DataFrame({"path": b["path"], "pages": pages, "needs_ocr": [bool(ps) and r < 0.1 * len(ps) for ps, r in zip(pages, rich, strict=True)]})

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(lean(run), "path string, pages array<string>, needs_ocr boolean")


def feed_entries(feeds: DataFrame, xml: str, since: str, pattern: str = ".*") -> DataFrame:
    """url, title, published of RSS and Atom items not older than a date."""
    item = "//*[local-name()='item' or local-name()='entry']"
    get = lambda path: F.xpath(F.col(xml), F.lit(f"{item}/{path}"))
    links = F.concat(get("*[local-name()='link']/text()"), get("*[local-name()='link']/@href"))
    entries = F.arrays_zip(links.alias("url"), get("*[local-name()='title']/text()").alias("title"), get("*[local-name()='pubDate' or local-name()='updated']/text()").alias("published"))
    flat = feeds.select(F.explode(entries).alias("e")).select("e.url", "e.title", "e.published")
    return flat.where(F.col("url").rlike(pattern) & (F.substring("published", 1, 10) >= since))


def sitemap_urls(maps: DataFrame, xml: str, since: str, most: int = 500) -> DataFrame:
    """loc and lastmod of a sitemap after a cutoff, newest first."""
    get = lambda tag: F.xpath(F.col(xml), F.lit(f"//*[local-name()='url']/*[local-name()='{tag}']/text()"))
    flat = maps.select(F.explode(F.arrays_zip(get("loc").alias("loc"), get("lastmod").alias("lastmod"))).alias("e")).select("e.loc", "e.lastmod")
    return flat.where(F.col("lastmod") >= since).orderBy(F.desc("lastmod"), "loc").limit(most)


@F.pandas_udf(StructType().add("children", ArrayType(StringType())).add("entries", ArrayType(StructType().add("loc", "string").add("lastmod", "string"))))
def _sitemap(xml: pd.Series) -> pd.DataFrame:
    rows = []
    for x in xml:
        try:
            root = ElementTree.fromstring(x or "")
        except ElementTree.ParseError:
            rows.append(([], []))
            continue
        space = root.tag.split("}")[0] + "}" if root.tag.startswith("{") else ""
        maps = root.findall(space + "sitemap")
        urls = [] if maps else root.findall(space + "url")
        text = lambda n, tag: (n.findtext(space + tag) or "").strip() or None  # noqa: B023, E731
        rows.append(([y for n in maps if (y := text(n, "loc"))], [{"loc": text(n, "loc"), "lastmod": text(n, "lastmod")} for n in urls if text(n, "loc")]))
    return pd.DataFrame(rows, columns=["children", "entries"])


def sitemap_tree(maps: DataFrame, roots: DataFrame, since: str | None = None, pattern: str | None = None, exclude: tuple[str, ...] = (), most: int = 500, depth: int = 20) -> DataFrame:
    """loc and lastmod of all sitemaps below the roots, in the order of the files, at most so many a call.

    maps: fetched files (url, xml), urls unique; roots: (url). An index's children are followed, each file once, so a cycle ends; what
    was not fetched or can't be read gives nothing. Entries older than since go; those without a readable date stay. pattern is
    searched for in the path; addresses with a part of exclude go.
    """
    none = F.array().cast("array<int>")
    read = materialize(maps.where(F.col("url").isNotNull()).select("url", _sitemap("xml").alias("m")).select("url", "m.children", "m.entries"), "sitemaps")
    frontier = materialize(roots.select("url").distinct().select("url", none.alias("place")).join(read.select("url"), "url", "left_semi"), "frontier")
    seen = frontier
    for _ in range(depth):
        below = frontier.join(read.select("url", "children"), "url").select("place", F.posexplode("children").alias("n", "child"))
        below = below.groupBy(F.col("child").alias("url")).agg(F.min(F.concat("place", F.array("n"))).alias("place"))
        frontier = materialize(below.join(seen.select("url"), "url", "left_anti").join(read.select("url"), "url", "left_semi"), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    leaves = seen.join(read.where(F.size("children") == 0), "url").select("place", "url", F.posexplode("entries").alias("n", "e"))
    rows = leaves.select("place", "url", "n", "e.loc", "e.lastmod")
    if since:
        at = F.try_to_timestamp("lastmod")
        rows = rows.where(at.isNull() | (at >= F.lit(since).cast("timestamp")))
    if pattern:
        rows = rows.where(F.regexp_extract("loc", r"^[a-zA-Z][^:/?#]*://[^/?#]*([^?#]*)", 1).rlike(pattern))
    for part in exclude:
        rows = rows.where(~F.contains("loc", F.lit(part)))
    return rows.orderBy("place", "url", "n").limit(most).select("loc", "lastmod")


def api_items(responses: DataFrame, body: str, template: str, since: str) -> DataFrame:
    """url and date of the items of JSON responses, addresses made from a template with {id}."""
    items = F.from_json(F.get_json_object(F.col(body), "$.items"), "array<struct<id:string,date:string>>")
    flat = responses.select(F.explode(items).alias("i")).select("i.id", "i.date")
    return flat.where(F.col("date") >= since).select(F.replace(F.lit(template), F.lit("{id}"), F.col("id")).alias("url"), "date")


def configured(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, site and url of plain configuration files of `site:` and `- url` lines; other lines and urls before any site are left out.

    A file is one row and its lines are read where it is, each once.
    """

    def run(batches):
        for batch in batches:
            for name, whole in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                site, sites, urls = None, [], []
                for line in re.split("\r?\n", whole or ""):
                    line = line.strip(" ")
                    if line.startswith("- "):
                        if site is not None:
                            sites.append(site)
                            urls.append(line[2:4098].strip(" "))
                    elif line.endswith(":"):
                        site = line[:-1].rstrip(" ")
                for at in range(0, len(urls), 20_000):
                    n = len(urls[at : at + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, batch.schema.field(0).type), pa.array(sites[at : at + 20_000]), pa.array(urls[at : at + 20_000])], [key, "site", "url"])

    small_batches(files.sparkSession)
    return files.select(key, text).mapInArrow(lean(run), f"`{key}` {files.schema[key].dataType.simpleString()}, site string, url string")


# Sinks


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("#r", F.row_number().over(w)).where("`#r` = 1").drop("#r")


def merge_metadata(old: DataFrame, new: DataFrame, key: str, columns: list[str], extras: str) -> DataFrame:
    """Per column the new value or else the old; maps are merged, new entries first."""
    j = old.alias("o").join(new.alias("n"), key, "full")
    empty = F.create_map().cast("map<string,string>")
    old_map, new_map = F.coalesce(F.col(f"o.{extras}"), empty), F.coalesce(F.col(f"n.{extras}"), empty)
    kept = F.map_filter(old_map, lambda k, v: ~F.map_contains_key(new_map, k))
    return j.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns], F.map_concat(kept, new_map).alias(extras))


def tombstone(rows: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """Mark rows whose key is in a delete set."""
    gone = dead.select(key).distinct().withColumn("#dead", F.lit(True))
    return rows.join(gone, key, "left").withColumn("tombstoned", F.coalesce("#dead", "tombstoned")).drop("#dead")


def manifest(statuses: DataFrame) -> DataFrame:
    """One row an artifact with its stages as a sorted list of stage=status."""
    pairs = F.array_sort(F.collect_set(F.concat_ws("=", "stage", "status")))
    return statuses.groupBy("artifact_id").agg(F.array_join(pairs, ",").alias("stages"), F.count("*").alias("events"))


def report_lines(summary: DataFrame, title: str) -> list[str]:
    """Markdown of a short summary; more than 1,000 rows are an error, not cut."""
    rows = summary.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a report takes a summary of at most 1,000 rows")
    return [f"# {title}", "", *[f"- {json.dumps(r.asDict(), default=str, sort_keys=True)}" for r in rows]]
