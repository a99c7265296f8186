"""Main content of pages: text blocks by a tree walk, scored by BM25 and structure, the best kept in document order."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.corpus import spread
from corpusloom.operators.registry import query
from corpusloom.operators.retrieval import LONGER, bm25
from corpusloom.session import lean, materialize, small_batches

# Elements that are never content, those that always are, and those that hold text.
EXCLUDED = frozenset("nav footer header aside script style form iframe noscript svg canvas template".split())
PROTECTED = frozenset("article main p h1 h2 h3 h4 h5 h6 pre code blockquote figcaption time address cite q em strong b i mark small".split())
INCLUDED = frozenset(
    "article main section div p span blockquote pre code h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th "
    "figure figcaption details summary em strong b i mark small time address cite q".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
WHOLE = (*HEADINGS, "pre", "code", "blockquote")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NEGATIVE = re.compile(r"\b(?:nav(?:igation)?|footer|sidebar|ads|advert|promo|social|share|comment|cookie|banner|popup|modal|overlay|widget|related|newsletter|subscribe|signup|login|breadcrumb|pagination|menu|toolbar|skip-link|screen-reader)\b", re.I)
POSITIVE = re.compile(r"\b(?:article|content|main|body|post|entry|story|text|prose)\b", re.I)


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def walk(self):
        """This node and all below it, in document order, without recursion."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            if isinstance(node, Node):
                todo.extend(reversed(node.children))

    def text(self) -> str:
        return " ".join(x.strip() for x in self.walk() if isinstance(x, str) and x.strip())

    def signs(self) -> str:
        return f"{self.attrs.get('class') or ''} {self.attrs.get('id') or ''}"


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.at.tag == tag:
            self.at = self.at.up
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Node:
    t = _Tree()
    t.feed(page or "")
    t.close()
    return t.root


def blocks(page: str) -> list[tuple[str, str, int, int]]:
    """(text, tag, positive signs, negative signs) of the leaf-most content elements."""
    root, dropped = tree(page), set()
    for n in root.walk():
        if not isinstance(n, Node) or n.tag in ("", "html", "body", "head", "title"):
            continue
        signs = f"{n.signs()} {n.attrs.get('role') or ''}"
        kept = n.tag in PROTECTED or any(isinstance(x, Node) and x is not n and x.tag in PROTECTED for x in n.walk())
        hidden = n.tag not in PROTECTED and (n.attrs.get("aria-hidden") or "").lower() == "true"
        if n.tag in EXCLUDED or hidden or (not kept and NEGATIVE.search(signs)):
            dropped.add(n)
    for n in dropped:
        n.up.children = [x for x in n.up.children if x is not n]
    out = []
    for n in root.walk():
        if not isinstance(n, Node) or n.tag not in INCLUDED:
            continue
        if n.tag not in WHOLE and any(isinstance(x, Node) and x.tag in INCLUDED for x in n.children):
            continue
        text = n.text()
        if text and (len(text.split()) >= 5 or len(text) >= 20):
            out.append((text, n.tag, len(POSITIVE.findall(n.signs())), len(NEGATIVE.findall(n.signs()))))
    return out


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block, text, tag, positive, negative; rows stay in their partitions."""

    def run(batches):
        for b in batches:
            rows = [(p, i, *x) for p, page in zip(b["page_id"], b["html"], strict=True) for i, x in enumerate(blocks(page))]
            yield pd.DataFrame(rows, columns=["page_id", "block", "text", "tag", "positive", "negative"])

    small_batches(pages.sparkSession)
    return spread(pages.select("page_id", "html")).mapInPandas(lean(run), "page_id long, block int, text string, tag string, positive int, negative int")


def scored(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Add score: BM25 of a block within its page against the page's title, first h1, description and keywords, adjusted by
    structure and length."""
    first = lambda pattern: F.regexp_extract("html", pattern, 1)
    meta = lambda name: F.concat_ws(" ", first(rf"(?is)<meta[^>]*name=[\"']?{name}[\"']?[^>]*content=[\"']([^\"']*)"), first(rf"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*name=[\"']?{name}\b"))
    topic = F.concat_ws(" ", first("(?is)<title[^>]*>(.*?)</title>"), F.regexp_replace(first(r"(?is)<h1\b[^>]*>(.*?)</h1>"), "<[^>]*>", " "), meta("description"), meta("keywords"))
    topics = pages.select("page_id", F.trim(topic).alias("topic"))
    terms = topics.select("page_id", F.explode(T.found(F.lower("topic"), LONGER)).alias("term")).withColumn("q", F.lit(0))
    hits = bm25(found, "block", terms, "q", 1.5, 0.75, style="okapi", pattern=LONGER, prefix=("page_id",)).select("page_id", "block", "score")
    n = F.size(T.words_of("text"))
    factor = F.when(F.col("tag").isin(*HEADINGS), 1.5).otherwise(1.0) * (1 + 0.1 * F.col("positive")) * F.when(F.col("negative") > 0, F.greatest(F.lit(0.1), 1 - 0.2 * F.col("negative"))).otherwise(1.0) * F.when(n < 10, 0.5).when(n > 100, 1.2).otherwise(1.0)
    # without a topic, or without any word to find it by, all blocks of a page are equal
    worded = found.groupBy("page_id").agg(F.bool_or(F.col("text").rlike(LONGER)).alias("worded")).join(topics, "page_id")
    plain = worded.select("page_id", ((F.col("topic") == "") | ~F.col("worded")).alias("plain"))
    joined = found.join(hits, ["page_id", "block"], "left").join(plain, "page_id")
    base = F.when(F.col("plain"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return joined.withColumn("score", F.greatest(F.lit(0.0), F.round(base * factor, 6))).drop("plain")


def selected(blocks_: DataFrame, most: int = 50) -> DataFrame:
    """All headings, and the best other blocks of at least a twentieth of the best score."""
    head = F.col("tag").isin(*HEADINGS)
    page = Window.partitionBy("page_id")
    ranked = blocks_.withColumn("headings", F.count_if(head).over(page)).withColumn("best", F.max(F.when(~head, F.col("score"))).over(page))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("page_id", head).orderBy(F.desc("score"), "block")))
    return ranked.where(head | ((F.col("r") <= most - F.col("headings")) & (F.col("score") >= F.col("best") * 0.05))).drop("headings", "best", "r")


def _scored(c) -> DataFrame:
    # pages are parsed once
    return scored(materialize(page_blocks(c.table("pages")), "blocks"), c.table("pages"))


_EXCLUDED = "nav|footer|header|aside|script|style|form|iframe|noscript|svg|canvas|template"


@query("html_01", f"SELECT page_id, length(regexp_replace(regexp_replace(html, '(?is)<({_EXCLUDED})\\b[^>]*>.*?</({_EXCLUDED})>', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS rest FROM pages")
def html_01(c):
    """Excluded elements and comments out, by patterns: the flat form of what the tree walk does."""
    y = F.regexp_replace("html", rf"(?is)<({'|'.join(sorted(EXCLUDED))})\b[^>]*>.*?</({'|'.join(sorted(EXCLUDED))})>", "")
    return c.table("pages").select("page_id", F.length(F.regexp_replace(y, "(?s)<!--.*?-->", "")).cast("long").alias("rest"))


@query("html_02")
def html_02(c):
    """What the negative patterns leave: blocks by tag."""
    return page_blocks(c.table("pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("html_03")
def html_03(c):
    return page_blocks(c.table("pages"))


@query("html_04")
def html_04(c):
    return _scored(c).select("page_id", "block", "score")


@query("html_05")
def html_05(c):
    return selected(_scored(c)).select("page_id", "block", "tag", "score")


@query("html_06")
def html_06(c):
    """Markdown: heading marks by level, blocks in order."""
    mark = F.when(F.col("tag").isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "))).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("block", F.concat(mark, F.col("text")).alias("s"))))
    return selected(_scored(c)).groupBy("page_id").agg(F.array_join(F.transform(parts, lambda x: x.s), "\n\n").alias("markdown"))


#: Signs of a content area, of a date, and parts of paths that are no articles.
AREA = re.compile(r"content|articles|news|posts|feed", re.I)
DATED = re.compile(r"/(20\d{2})[/-]\d{2}[/-]\d{2}/")
RESERVED = "category tag author page search feed rss recent-posts about contact privacy terms".split()
_OTHER = ("#", "javascript:", "mailto:", "tel:", "whatsapp:", "telegram:")


def _article(href: str) -> bool:
    return bool(href) and not href.startswith(_OTHER) and not any(x in href.lower() for x in T.SKIP_LINKS)


def links(page: str, url: str) -> list[str]:
    """Addresses of articles of the same host, each once, in the order in which they are found: the first link of each article
    element; article-like links of the main element or else of the first content area; dated links; and, if these are fewer than three,
    article-like links below the page's own path."""
    root, base = tree(page), urlsplit(url)
    below = lambda n: [x for x in n.walk() if isinstance(x, Node) and x.tag == "a" and x.attrs.get("href") is not None]
    nodes = [n for n in root.walk() if isinstance(n, Node)]
    own = base.path.rstrip("/")
    found: dict[str, None] = {}
    for n in nodes:
        if n.tag == "article" and (first := below(n)[:1]) and first[0].attrs["href"]:
            found.setdefault(first[0].attrs["href"])
    area = next((n for n in nodes if n.tag == "main"), None) or next((n for n in nodes if n.tag == "div" and any(AREA.search(x) for x in (n.attrs.get("class") or "").split())), None)
    for a in below(area) if area else []:
        if _article(a.attrs["href"]):
            found.setdefault(a.attrs["href"])
    every = [a.attrs["href"] for a in below(root)]
    for href in every:
        if DATED.search(href):
            found.setdefault(href)
    if len(found) < 3:
        for href in every:
            full = urljoin(url, href)
            at = urlsplit(full)
            if at.netloc == base.netloc and at.path.startswith(own + "/") and at.path.rstrip("/") != own and not any(x in at.path.lower() for x in RESERVED) and _article(href):
                found.setdefault(full)
    out: dict[str, None] = {}
    for href in found:
        at = urlsplit(urljoin(url, href.strip()))
        # parameters and fragments tell no other page; queries do
        if at.scheme.lower() in ("http", "https") and at.netloc.lower() == base.netloc.lower() and at.path.rstrip("/") != own:
            path = re.sub(r";[^/]*$", "", at.path) or "/"
            out.setdefault(f"{at.scheme.lower()}://{at.netloc.lower()}{path}" + (f"?{at.query}" if at.query else ""))
    return list(out)


@query("html_07")
def html_07(c):
    """Pages play the listing at the root of their host: their own addresses have nothing below them."""

    def run(batches):
        for b in batches:
            rows = [(p, i, x) for p, u, h in zip(b["page_id"], b["url"], b["html"], strict=True) for i, x in enumerate(links(h, u))]
            yield pd.DataFrame(rows, columns=["page_id", "place", "link"])

    root = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    return c.table("pages").select("page_id", F.concat(root, F.lit("/")).alias("url"), "html").mapInPandas(lean(run), "page_id long, place long, link string")
