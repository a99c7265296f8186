import random
import re

import pyarrow as pa

from corpusloom.llm import license_scan as scan

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score string, spans int"


def _base(text):
    words = WORDS.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in scan.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def _hits(words, sequence, least):
    """(end, place, length) of the longest common parts that end at a word and a place of a template and can't go on."""
    out = []
    for end in range(1, len(words) + 1):
        for place in range(1, len(sequence) + 1):
            n = 0
            while n < min(end, place) and words[end - n - 1] == sequence[place - n - 1]:
                n += 1
            if n >= least and not (end < len(words) and place < len(sequence) and words[end] == sequence[place]):
                out.append((end, place, n))
    return out


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        automaton, words = scan.Automaton(sequences), [rng.randint(0, 4) for _ in range(15)]
        got = automaton.matches(words, 2, automaton.held(2))
        assert sorted(got) == sorted((e, t, p, n) for t, s in enumerate(sequences) for e, p, n in _hits(words, s, 2))


def _best_chain(hits, gap):
    """Most covered words over all sets of hits in order in the text and the template, with bounded gaps."""
    best = 0
    for chosen in range(1, 1 << len(hits)):
        chain = [h for i, h in enumerate(hits) if chosen >> i & 1]
        covered = chain[0][2]
        for (b_end, b_place, _), (end, place, size) in zip(chain, chain[1:], strict=False):
            new = size - max(0, b_end - (end - size), b_place - (place - size))
            if not (b_end < end and b_place < place and end - size - b_end <= gap and new > 0):
                break
            covered += new
        else:
            best = max(best, covered)
    return best


def test_chaining_against_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        sequence = [rng.randint(0, 5) for _ in range(10)]
        words = []
        while len(words) < 22:
            at = rng.randint(0, 7)
            words += sequence[at : at + rng.randint(2, 5)] + [9] * rng.randint(0, 3)
        hits = sorted(_hits(words, sequence, 2))[:12]
        scanner = scan.Scanner({"a": ["x y z"]}, {}, 2, 2, 0.5)
        got = scanner.chained(hits, 0.0)
        assert max((c for *_, c in got), default=0) == _best_chain(hits, 2)
        for (a, b, _), (c, d, _) in zip(got, got[1:], strict=False):
            assert a <= b < c <= d


def _spans(text, **options):
    templates = options.get("templates", scan.TEMPLATES)
    *_, spans = next(iter(scan.Scanner(templates, scan.BASE, 3, 12, 0.7).scan(pa.array([text], pa.large_string()))))
    return spans


def test_every_notice_that_covers_enough_is_told():
    notice = "one two three four five six seven eight nine ten".split()
    worn = [*notice[:4], "other", *notice[5:]]
    text = " ".join([*notice, *["gap"] * 40, *worn, *["gap"] * 40, *notice[:5]])
    spans = _spans(text, templates={"x": [" ".join(notice)]})
    assert [(s["first_word"], s["last_word"], s["covered"]) for s in spans] == [(0, 9, 10), (50, 59, 9)]


def test_a_part_shared_with_a_longer_match_counts_for_both():
    templates = {"a": ["p q r s t u v w"], "b": ["q r s t u x y"]}
    spans = _spans("0 p q r s t u v w 0 0", templates=templates)
    assert {s["label"]: s["covered"] for s in spans} == {"a": 8, "b": 5}


def test_rows(spark):
    rng = random.Random(6)
    parts = ["cc", "BY", "by", "NC", "All rights", "reserved", "general public license", "GNU", "the", "über", "x1", "Licensed under CC BY-NC 4.0.", "\n", "É"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "!!!", "CC BY", "cc by " * 5000, scan.TEMPLATES["mit"][1], "All rights", texts[0]]
    rows = [(None if i == 3 else i, t, "clash", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in scan.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc, text, *_ in rows:
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    mit = got[len(texts) - 3]
    assert mit.labels == "mit" and mit.score == 1.0 and mit.spans[0].first_word == 0 and mit.spans[0].last_word == mit.n_words - 1
    assert got[81].score == 0 and got[81].labels == ""
    assert scan.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans_survive_edits():
    notice = scan.TEMPLATES["apache"][2]
    words = notice.split()
    words[10:11] = ["something", "else"]
    text = "intro words here " + " ".join(words) + " more text"
    *_, labels, score, spans = next(iter(scan.Scanner(scan.TEMPLATES, scan.BASE, 3, 12, 0.7).scan(pa.array([text], pa.large_string()))))
    assert "apache" in labels and 0.9 < score < 1 and spans
