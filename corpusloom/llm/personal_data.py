"""Personal data in texts, in DataFrame operations only.

Each kind has a pattern that proposes spans, a check that confirms them (Luhn for cards, mod 97 for account numbers, ranges
and digit counts for others), a score, and context words that raise it when they stand near. Spans that reach the threshold
stay. A text is cut by the pattern, so places follow from the lengths of what lies between: no text is moved or searched twice
unless it holds a proposal. Patterns are written so that a search takes time in proportion to the text: repeated groups
are possessive (Java would recurse on others) and long runs are entered at their start alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _address(m: Column) -> Column:
    """Parts of at most 255, whatever zeros lead."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _luhn(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _dialled(m: Column) -> Column:
    return F.length(F.translate(m, " ().-+", "")).between(9, 15)


def mod97(m: Column) -> Column:
    """The remainder of an account number: first four characters last, letters as 10 to 35."""
    plain = F.translate(m, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda n, c: (n * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97)


def _account(m: Column) -> Column:
    return F.length(F.translate(m, " ", "")).between(15, 34) & (mod97(m) == 1)


def _social(m: Column) -> Column:
    """Area, group and serial numbers that are given out."""
    area = F.substring(m, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[a-f]")


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. A span stays if its score, with `bonus` where a context word is near, reaches the threshold."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    bonus: float
    #: Pattern of lower-case context words.
    context: str
    #: A literal without which a text has no span.
    needs: str = ""
    #: What may not stand right before or after.
    not_before: str = ""
    not_after: str = ""


#: Fixed patterns, with the scores that put them above or below THRESHOLD without context.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.9, 0.1, "mail|contact|write to|reach", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _address, 0.6, 0.3, "address|host|server|client", "."),
    # only runs of 13 digits or more: shorter ones fail the count
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+", _luhn, 0.8, 0.2, "card|visa|credit|payment|debit"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _dialled, 0.7, 0.2, "phone|tel|call|mobile|fax", "+"),
)
ADDED = (
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}", _account, 0.8, 0.2, "iban|account|bank|transfer", "", r"[A-Za-z0-9]\z", r"\A[A-Za-z0-9]"),
    Kind("ssn", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", _social, 0.3, 0.5, "ssn|social security|taxpayer", "-", r"[A-Za-z0-9-]\z", r"\A[A-Za-z0-9-]"),
    Kind("tel", r"\(?[0-9][0-9][0-9]\)?[-. ][0-9][0-9][0-9][-. ][0-9][0-9][0-9][0-9]", None, 0.3, 0.4, "phone|tel|call|mobile|fax", "", r"[A-Za-z0-9]\z|[0-9][-. ]\z|\+[0-9. ()-]*\z", r"\A[A-Za-z0-9]|\A[-. ][0-9]"),
    Kind("accesskey", r"AKIA[0-9A-Z]{16}", None, 0.9, 0.1, "aws|access|key", "AKIA", r"[A-Za-z0-9]\z", r"\A[A-Za-z0-9]"),
    Kind("secret", r"[0-9a-f]{16,}", _mixed, 0.2, 0.6, "password|passwd|secret|token|key", "", r"[A-Za-z0-9]\z", r"\A[A-Za-z0-9]"),
)
THRESHOLD, WINDOW = 0.5, 60
_BLOCK = 256


def running(lengths: Column) -> Column:
    """Sums of what stands before each element, block by block, so long arrays take no quadratic time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda k: k * _BLOCK + 1)
    cut = F.transform(blocks, lambda k: F.slice(lengths, k, _BLOCK))
    none = F.array().cast("array<bigint>")
    inner = lambda x: F.aggregate(x, F.struct(F.lit(0).cast("long").alias("t"), none.alias("a")), lambda s, y: F.struct((s.t + y).alias("t"), F.array_append(s.a, s.t).alias("a")))
    start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<array<bigint>>").alias("a"))
    whole = F.aggregate(F.transform(cut, inner), start, lambda s, x: F.struct((s.t + x.t).alias("t"), F.array_append(s.a, F.transform(x.a, lambda v: v + s.t)).alias("a")), lambda s: F.flatten(s.a))
    return F.when(F.size(lengths) > 0, whole).otherwise(none)


def _placed(matches: Column, gaps: Column, window: int) -> Column:
    """array of struct(start, m, before, after) from the matches of a pattern and what lies around them."""
    n = F.size(matches)
    heads, tails = F.slice(gaps, 1, n), F.slice(gaps, 2, n)
    both = F.zip_with(heads, matches, lambda g, m: F.concat(g, m))
    offsets = running(F.transform(both, lambda x: F.length(x).cast("long")))
    earlier = F.slice(F.concat(F.array(F.lit("")), both), 1, n)
    item = lambda x: F.struct((x.o + F.length(x.g)).alias("start"), x.m.alias("m"), F.right(F.concat(F.right(x.e, F.lit(window)), x.g), F.lit(window)).alias("before"), F.left(x.t, F.lit(window)).alias("after"), F.right(x.g, F.lit(16)).alias("left"))
    return F.transform(F.arrays_zip(offsets.alias("o"), heads.alias("g"), tails.alias("t"), matches.alias("m"), earlier.alias("e")), item)


def _spans(kind: Kind, placed: Column, threshold: float) -> Column:
    """array of struct(kind, start, end, score) of the proposals that stay."""
    near = lambda x: F.lower(F.concat_ws(" ", x.before, x.after)).rlike(kind.context)
    score = lambda x: F.when(near(x), kind.score + kind.bonus).otherwise(F.lit(kind.score))

    def stays(x: Column) -> Column:
        ok = F.lit(True) if kind.valid is None else kind.valid(x.m)
        if kind.not_before:
            ok &= ~x.left.rlike(kind.not_before)
        if kind.not_after:
            ok &= ~x.after.rlike(kind.not_after)
        return ok if kind.score >= threshold else ok & (score(x) >= threshold)

    return F.transform(F.filter(placed, stays), lambda x: F.struct(F.lit(kind.name).alias("kind"), x.start.alias("start"), (x.start + F.length(x.m)).alias("end"), score(x).alias("score")))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = BASE + ADDED, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """For each row: doc_id, and for each kind a column of its name, array<struct<kind,start,end,score>> by start.

    Spans of a kind are leftmost and do not overlap; a match that fails its check is dropped without another try; spans of
    different kinds are found independently and may overlap. Places are code points, ends exclusive. Context is what stands
    within `window` characters before a span, over the last span of the kind at most, or after it up to the next. Null and
    empty texts have no spans; rows are kept as they are, repeated and null ids too; other columns are left out.
    """
    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    matches = {f"m_{k.name}": F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)) for k in kinds}
    out = out.withColumns({f"m_{k.name}": F.when(F.col("text").contains(k.needs), m).otherwise(none) if k.needs else m for k, m in zip(kinds, matches.values(), strict=True)})
    out = out.withColumns({f"g_{k.name}": F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)).otherwise(none) for k in kinds}).drop("text")
    out = out.select("doc_id", *(F.when(F.size(f"m_{k.name}") > 0, _placed(F.col(f"m_{k.name}"), F.col(f"g_{k.name}"), window)).alias(f"p_{k.name}") for k in kinds))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return out.select("doc_id", *(F.coalesce(_spans(k, F.col(f"p_{k.name}"), threshold), empty).alias(k.name) for k in kinds))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def report(found: DataFrame, base: tuple[Kind, ...] = BASE, added: tuple[Kind, ...] = ADDED) -> DataFrame:
    """Counts and digests of personal_data()'s spans: doc_id, n_<base kind>, base_sha256, spans, n_added, scores (in hundredths)."""
    found = found.select("*", F.concat(*(F.col(k.name) for k in base)).alias("#base"), F.concat(*(F.col(k.name) for k in added)).alias("#added"))
    scores = F.array_join(F.transform(F.concat("#base", "#added"), lambda x: F.round(x.score * 100).cast("int").cast("string")), ",")
    return found.select(
        "doc_id", *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base), F.sha2(listed(F.col("#base")), 256).alias("base_sha256"),
        listed(F.concat("#base", "#added")).alias("spans"), F.size("#added").cast("long").alias("n_added"), scores.alias("scores"),
    )


def _oracle() -> str:
    """The contract of op11 and the added kinds for DuckDB, with plain patterns."""
    kinds = [
        ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true", 90, 10, "mail|contact|write to|reach", "", ""),
        ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0", 60, 30, "address|host|server|client", "", ""),
        ("card", "[0-9]([\\x20-]?[0-9])+", "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) + 1 - i] AS INT) ELSE (2 * CAST(d[length(d) + 1 - i] AS INT)) // 10 + (2 * CAST(d[length(d) + 1 - i] AS INT)) % 10 END)) % 10 = 0", 80, 20, "card|visa|credit|payment|debit", "", ""),
        ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15", 70, 20, "phone|tel|call|mobile|fax", "", ""),
        ("iban", "[A-Z][A-Z][0-9][0-9]( ?[A-Z0-9]){11,30}", "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND CAST(CAST(CAST(CAST(n[:30] AS HUGEINT) % 97 AS VARCHAR) || n[31:] AS HUGEINT) % 97 AS INT) = 1", 80, 20, "iban|account|bank|transfer", "[A-Za-z0-9]\\z", "\\A[A-Za-z0-9]"),
        ("ssn", "[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", "m[1:3] NOT IN ('000', '666') AND m[1:3] < '900' AND m[5:6] <> '00' AND m[8:11] <> '0000'", 30, 50, "ssn|social security|taxpayer", "[A-Za-z0-9-]\\z", "\\A[A-Za-z0-9-]"),
        ("tel", "\\(?[0-9][0-9][0-9]\\)?[-. ][0-9][0-9][0-9][-. ][0-9][0-9][0-9][0-9]", "true", 30, 40, "phone|tel|call|mobile|fax", "[A-Za-z0-9]\\z|[0-9][-. ]\\z|\\+[0-9. ()-]*\\z", "\\A[A-Za-z0-9]|\\A[-. ][0-9]"),
        ("accesskey", "AKIA[0-9A-Z]{16}", "true", 90, 10, "aws|access|key", "[A-Za-z0-9]\\z", "\\A[A-Za-z0-9]"),
        ("secret", "[0-9a-f]{16,}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-f]')", 20, 60, "password|passwd|secret|token|key", "[A-Za-z0-9]\\z", "\\A[A-Za-z0-9]"),
    ]
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    number = "array_to_string(list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4], ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    ctes, parts = [], []
    for i, (name, pattern, valid, score, bonus, context, before, after) in enumerate(kinds):
        edges = (f" AND NOT regexp_matches(right(g, 16), '{before}')" if before else "") + (f" AND NOT regexp_matches(left(t, 60), '{after}')" if after else "")
        ctes.append(f"""
{name}0 AS (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM d WHERE regexp_matches(text, '{pattern}')),
{name}1 AS (SELECT r, unnest(generate_series(1, len(ms))) AS k, ms, gs FROM {name}0),
{name}2 AS (SELECT r, k, ms[k] AS m, gs[k] AS g, gs[k + 1] AS t, CASE WHEN k > 1 THEN gs[k - 1] || ms[k - 1] ELSE '' END AS e FROM {name}1),
{name}3 AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY k) - length(m) AS s, {digits} AS d, {number if name == "iban" else "''"} AS n,
  {score} + CASE WHEN regexp_matches(lower(right(right(e, 60) || g, 60) || ' ' || left(t, 60)), '{context}') THEN {bonus} ELSE 0 END AS p FROM {name}2),
{name} AS (SELECT r, {i} AS kind, CAST(s AS BIGINT) AS s, '{name}:' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS x, p FROM {name}3 WHERE p >= 50 AND ({valid}){edges})""")
        parts.append(f"SELECT * FROM {name}")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),{",".join(ctes)},
f AS (SELECT r, count(*) FILTER (kind = 0) AS e, count(*) FILTER (kind = 1) AS i, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind = 3) AS p, count(*) FILTER (kind > 3) AS a,
  string_agg(x, ',' ORDER BY kind, s) FILTER (kind < 4) AS b, string_agg(x, ',' ORDER BY kind, s) AS l, string_agg(CAST(p AS VARCHAR), ',' ORDER BY kind, s) AS q FROM ({" UNION ALL ".join(parts)}) GROUP BY r)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(l, '') AS spans,
  coalesce(a, 0) AS n_added, coalesce(q, '') AS scores FROM d LEFT JOIN f USING (r)"""


ORACLE = _oracle()
