"""Scalar text functions as Columns, so they stay in generated code; Python forms only where Spark has no counterpart."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English function words that carry no content.
STOPWORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might must can this that these those i you he she it we they"
).split()
# Domains with a quality bonus.
TRUSTED_DOMAINS = (
    "arxiv.org developer.nvidia.com blog.google research.meta.ai openai.com anthropic.com huggingface.co thehackernews.com "
    "www.cisa.gov www.microsoft.com vllm.ai claude.com www.emergentmind.com blog.isecauditors.com"
).split()
HIGH_TRUST = "arxiv.org github.com docs.python.org developer.mozilla.org w3.org ietf.org nist.gov ieee.org acm.org".split()
MEDIUM_TRUST = "wikipedia.org stackoverflow.com medium.com dev.to hackernews.com thehackernews.com".split()
# Signs of a wall instead of content.
GARBAGE = ("enable javascript", "please enable javascript", "cookie consent", "accept cookies to continue", "access denied", "403 forbidden", "captcha")
WALLS = ("sign in", "log in", "accept cookies", "cookie policy", "enable javascript")
BOILERPLATE = ("subscribe", "privacy policy", "all rights reserved")
# Parts of addresses that are no articles.
SKIP_LINKS = (
    "/tag/ /category/ /author/ /page/ /feed /rss /sitemap /search /login /register /about /contact /privacy /terms "
    ".jpg .png .gif .css .js facebook.com twitter.com x.com linkedin.com youtube.com instagram.com"
).split()
ACTION_VERBS = (
    r"\b(?:should|must|need to|recommend|implement|deploy|configure|install|update|patch|upgrade|migrate|enable|disable|set up"
    r"|follow|ensure|verify|check|monitor|alert|block|allow|restrict|encrypt|backup)\b"
)
WORD = r"[\p{L}\p{N}_]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found(x: Column | str, pattern: str) -> Column:
    """All matches as an array."""
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(0))


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def squeeze(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def normalized_hash(x: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(squeeze(F.lower(col(x))), 256))


def content_words(x: Column | str) -> Column:
    return F.filter(found(F.lower(col(x)), "[a-zA-Z]{2,}"), lambda w: ~w.isin(STOPWORDS))


def lexical_density(x: Column | str) -> Column:
    words = content_words(x)
    return ratio(F.size(F.array_distinct(words)), F.size(words))


def python_lexical_density(text: str) -> float:
    words = [w for w in re.findall("[a-z]{2,}", text.lower()) if w not in STOPWORDS]
    return len(set(words)) / len(words) if words else 0.0


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return ratio(F.size(F.array_intersect(a, b)), least)


def coverage(terms: Column, words: Column) -> Column:
    """Share of distinct terms among the words."""
    return ratio(F.size(F.array_intersect(terms, words)), F.size(F.array_distinct(terms)))


def long_tokens(x: Column | str) -> Column:
    """Distinct tokens of at least four letters, digits, underscores or hyphens."""
    return F.array_distinct(found(F.lower(col(x)), r"[\p{L}\p{N}_-]{4,}"))


def tokens(x: Column | str) -> Column:
    """Distinct ASCII tokens of two or more letters or digits that stand as whole words."""
    return F.array_distinct(found(F.lower(col(x)), r"(?<![\p{L}\p{N}_])[a-z0-9]{2,}+(?![\p{L}\p{N}_])"))


def casefold(x: Column | str) -> Column:
    """Lower case with sharp s spelled out: what case folding does to the languages of the corpus."""
    return F.replace(F.lower(col(x)), F.lit("ß"), F.lit("ss"))


def clean_text(x: Column | str) -> Column:
    """Private-use characters to blanks, replacement characters out, composed form, runs of newlines and blanks cut, stripped."""
    y = F.regexp_replace(F.regexp_replace(col(x), r"[\x{E000}-\x{F8FF}]", " "), r"\x{FFFD}", "")
    y = F.regexp_replace(F.regexp_replace(nfc(y), "\n{3,}", "\n\n"), "[ \t]{2,}", " ")
    return F.regexp_replace(y, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def strip_accents(x: pd.Series) -> pd.Series:
    """Combining marks dropped after decomposition."""
    return x.map(lambda v: v if v is None or v.isascii() else "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn"))


def title(x: Column | str) -> Column:
    """First line that is not blank, without heading marks and a title label, at most 200 characters."""
    line = F.coalesce(F.try_element_at(F.filter(F.split(col(x), "\n"), lambda s: F.trim(s) != ""), F.lit(1)), F.lit(""))
    bare = F.trim(F.regexp_replace(F.trim(line), "^#+", ""))
    return F.substring(F.trim(F.regexp_replace(bare, "(?i)^title:", "")), 1, 200)


def header(x: Column | str, name: str) -> Column:
    """Value of a `Name:` line within the first 2000 characters; empty if there is none."""
    return F.trim(F.regexp_extract(F.substring(col(x), 1, 2000), rf"(?im)^[ \t]*{name}:([^\n]*)$", 1))


def normalize_url(x: Column | str) -> Column:
    """Scheme and host in lower case, no fragment, / for an empty path; '' if it is no http(s) address."""
    y = F.trim(col(x))
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme, host = F.lower(F.regexp_extract(y, pattern, 1)), F.lower(F.regexp_extract(y, pattern, 2))
    path, query = F.regexp_extract(y, pattern, 3), F.regexp_extract(y, pattern, 4)
    bare = F.regexp_replace(path, ";[^/]*$", "")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(bare == "", "/").otherwise(bare), F.when(query == "?", "").otherwise(query))).otherwise("")


def host(x: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.trim(col(x)), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def urls(x: Column | str) -> Column:
    """Distinct http(s) addresses in prose, closing punctuation trimmed, in order."""
    each = F.transform(found(x, r"https?://[^\s<>()\[\]\"']+"), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", ""))
    return F.array_distinct(F.filter(each, lambda u: u != ""))


def query_from_url(x: Column | str) -> Column:
    path = F.regexp_replace(F.regexp_extract(col(x), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    slug = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?i)\.(html?|php|aspx?|jsp)$", "")
    words = F.trim(F.regexp_replace(slug, "[-_+]+", " "))
    return F.when((F.length(words) >= 3) & words.rlike(r"\p{L}{3,}"), words).otherwise("")


def trust_label(domain: Column | str) -> Column:
    d = F.lower(col(domain))
    has = lambda names: F.exists(literals(names), lambda n: F.contains(d, n))
    return F.when(has(HIGH_TRUST), "high").when(has(MEDIUM_TRUST), "medium").otherwise("low")


def token_estimate(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(col(x)) / 4).cast("int"))


def bounded(x: Column | str, fallback: float) -> Column:
    """Number clamped to [0, 1]; the fallback for what is none."""
    y = col(x).try_cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)), F.lit(fallback))


def occurrences(x: Column, needle: str) -> Column:
    """How often a plain string occurs, without overlaps."""
    return (F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))) / len(needle)


def total(x: Column, needles) -> Column:
    out = F.lit(0.0)
    for n in needles:
        out = out + occurrences(x, n)
    return out


def words_of(x: Column | str) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(col(x), r"\s+"), lambda w: w != "")


def snippet_relevance(query: Column | str, heading: Column | str, snippet: Column | str) -> Column:
    q, t = tokens(query), tokens(heading)
    both = tokens(F.concat_ws(" ", col(heading), col(snippet)))
    bonus = 0.15 * F.size(F.array_intersect(q, t)) / F.size(q)
    return F.when((F.size(q) == 0) | (F.size(both) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(q, both)) / F.size(q) + bonus))


def content_quality(x: Column | str, query: Column | str) -> Column:
    """0 for short, unrelated or walled content; else length and query density weighted."""
    text, q = col(x), tokens(query)
    hits = F.size(F.array_intersect(q, tokens(text)))
    start = F.lower(F.substring(text, 1, 2000))
    walled = F.exists(literals(GARBAGE), lambda g: F.contains(start, g))
    density = F.when(F.size(q) == 0, 0.5).otherwise(hits / F.size(q))
    score = 0.4 * F.least(F.lit(1.0), F.length(text) / 5000) + 0.6 * density
    return F.when((F.length(text) < 200) | ((F.size(q) > 0) & (hits == 0)) | walled, 0.0).otherwise(score)


def page_gate(x: Column | str) -> Column:
    """Score of article text; 0.1 for too little text and for walls."""
    low, n = F.lower(col(x)), F.size(words_of(x))
    score = 0.5 + F.least(n / 2000, F.lit(0.35)) - F.least(total(low, BOILERPLATE) / 10, F.lit(0.25))
    return F.when((n < 40) | ((total(low, WALLS) >= 3) & (n < 250)), 0.1).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))


def page_score(x: Column | str, heading: Column | str) -> Column:
    w = words_of(x)
    n = F.size(w)
    varied = F.size(F.array_distinct(F.transform(w, F.lower))) / n > 0.35
    score = 0.35 + F.when(col(heading) != "", 0.15).otherwise(0.0) + F.when(n >= 100, 0.25).otherwise(0.0) + F.when(n >= 500, 0.15).otherwise(0.0) + F.when(varied, 0.1).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))
