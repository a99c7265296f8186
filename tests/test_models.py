"""Queries without SQL against plain versions of their rules."""

import hashlib
import math
import re
from collections import Counter

import pytest

from corpusloom.operators import html_blocks
from corpusloom.operators.catalog import QUERIES
from corpusloom.operators.corpus import Corpus
from corpusloom.operators.html_blocks import HEADINGS, blocks

SF = "/root/testdata/sf0.001"


def _words(text):
    return [w for w in re.findall(r"\w+", text.lower()) if len(w) > 1]


def _topic(page):
    first = lambda pattern: (re.search(pattern, page, re.I | re.S) or ["", ""])[1]
    meta = lambda name: first(rf"<meta[^>]*name=[\"']?{name}[\"']?[^>]*content=[\"']([^\"']*)") + " " + first(rf"<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*name=[\"']?{name}\b")
    return " ".join([first("<title[^>]*>(.*?)</title>"), re.sub("<[^>]*>", " ", first(r"<h1\b[^>]*>(.*?)</h1>")), meta("description"), meta("keywords")]).strip()


def _scores(page):
    """(block, tag, text, score) of a page: Okapi BM25 with epsilon .25 against its topic, then structure and length."""
    found = blocks(page)
    texts, asked = [_words(t) for t, *_ in found], _words(_topic(page))
    n = len(texts)
    df = Counter(w for t in texts for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw) if raw else 0.0
    mean = sum(map(len, texts)) / n if n else 0
    out = []
    for i, ((text, tag, positive, negative), t) in enumerate(zip(found, texts, strict=True)):
        score = 1.0 if not _topic(page) or not any(texts) else sum((raw[w] if raw[w] >= 0 else low) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in asked if w in t)
        score *= (1.5 if tag in HEADINGS else 1.0) * (1 + 0.1 * positive) * (max(0.1, 1 - 0.2 * negative) if negative else 1.0)
        size = len(text.split())
        out.append((i, tag, text, max(0.0, score * (0.5 if size < 10 else 1.2 if size > 100 else 1.0))))
    return out


def _kept(rows, most=50):
    heads = {i for i, tag, *_ in rows if tag in HEADINGS}
    rest = sorted((r for r in rows if r[0] not in heads), key=lambda r: (-round(r[3], 6), r[0]))
    best = max((r[3] for r in rest), default=0.0)
    return sorted(heads | {r[0] for r in rest[: max(0, most - len(heads))] if round(r[3], 6) >= round(best, 6) * 0.05})


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_block_scores(spark, pages):
    got = {(r.page_id, r.block): r.score for r in QUERIES["html_04"](spark, SF).collect()}
    want = {(p, i): s for p, page in pages.items() for i, _, _, s in _scores(page)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_selected_blocks_and_markdown(spark, pages):
    got = {}
    for r in QUERIES["html_05"](spark, SF).collect():
        got.setdefault(r.page_id, []).append(r.block)
    assert {p: sorted(b) for p, b in got.items()} == {p: k for p, page in pages.items() if (k := _kept(_scores(page)))}
    marked = lambda tag, text: "#" * int(tag[1]) + " " + text if tag in HEADINGS else text
    texts = {r.page_id: r.markdown for r in QUERIES["html_06"](spark, SF).collect()}
    assert texts == {p: "\n\n".join(marked(rows[i][1], rows[i][2]) for i in _kept(rows)) for p, page in pages.items() if (rows := _scores(page))}


def test_pages_without_a_topic_score_one(spark):
    pages = spark.createDataFrame([(1, "<p>one two three four five</p><h2>a heading of five words</h2>"), (2, "<title>five</title><p>one two three four five</p><p>six seven eight nine ten</p><p>six seven eight nine ten</p>")], "page_id long, html string")
    got = {(r.page_id, r.block): r.score for r in html_blocks.scored(html_blocks.page_blocks(pages), pages).collect()}
    assert got[1, 0] == 0.5 and got[1, 1] == 0.75 and got[2, 0] > 0 and got[2, 1] == 0.0


def _plain_blocks(node):
    """Leaf-most content elements by recursion."""
    out = []
    for x in node.children:
        if isinstance(x, str):
            continue
        inner = [y for y in x.children if not isinstance(y, str) and y.tag in html_blocks.INCLUDED]
        if x.tag in html_blocks.INCLUDED and (x.tag in html_blocks.WHOLE or not inner):
            text = x.text()
            if text and (len(text.split()) >= 5 or len(text) >= 20):
                out.append((text, x.tag))
        out += _plain_blocks(x)
    return out


def test_blocks_by_recursion(spark, pages):
    got = {}
    for r in QUERIES["html_03"](spark, SF).orderBy("page_id", "block").collect():
        got.setdefault(r.page_id, []).append((r.text, r.tag))
    for p, page in pages.items():
        root = html_blocks.tree(page)
        # what is dropped is dropped by flat rules on each element, before
        for n in [n for n in root.walk() if not isinstance(n, str)]:
            signs = f"{n.signs()} {n.attrs.get('role') or ''}"
            safe = any(not isinstance(x, str) and x.tag in html_blocks.PROTECTED for x in n.walk())
            if n.up is not None and n.tag not in ("html", "body", "head", "title") and (n.tag in html_blocks.EXCLUDED or (n.attrs.get("aria-hidden") == "true" and n.tag not in html_blocks.PROTECTED) or (not safe and html_blocks.NEGATIVE.search(signs))):
                n.up.children = [x for x in n.up.children if x is not n]
        assert got.get(p, []) == _plain_blocks(root)
    counts = {(r.page_id, r.tag): r.n for r in QUERIES["html_02"](spark, SF).collect()}
    assert counts == Counter((p, tag) for p, rows in got.items() for _, tag in rows)


def _bm25(texts, asked):
    """Scores by text of the asked words."""
    words = {k: re.findall(r"\w+", t.lower()) for k, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for t in words.values() for w in set(t))
    out = Counter()
    for k, t in words.items():
        tf = Counter(t)
        for w in asked:
            if tf[w]:
                out[k] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return out


def test_context_packages(spark):
    c = Corpus(spark, SF)
    chunks = {r.chunk_id: r for r in c.chunks.select("chunk_id", "content_hash", "text").collect()}
    texts = {k: r.text for k, r in chunks.items()}
    got = {r.item_id: (r.chunks, r.tokens, r.package_hash) for r in QUERIES["ret_14"](spark, SF).collect()}
    for item in c.table("benchmark").limit(6).collect():
        scores = _bm25(texts, dict.fromkeys(re.findall(r"\w+", item.text.lower())))
        top = sorted(scores, key=lambda k: (-round(scores[k], 6), k))[:10]
        used, kept = 0, []
        for k in top:
            cost = max(1, math.ceil(len(texts[k].encode()) / 4))
            if used + cost <= 600:
                used, kept = used + cost, [*kept, chunks[k].content_hash]
        assert got[item.item_id] == (len(kept), used, hashlib.sha256("|".join(kept).encode()).hexdigest())
