"""Branches that the driver's tables do not reach, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, curation, retrieval, scalar_queries, topics
from corpusloom.operators.event_queries import roadmap_findings
from corpusloom.operators.html_blocks import blocks, links
from corpusloom.operators.relational_queries import within_budget
from corpusloom.plans.components import connected_components
from corpusloom.sources import files


def _docs(spark, texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def test_fixed_window_edges(spark):
    got = {r.document_id: r.n for r in chunking.fixed_window(_docs(spark, ["", "x" * 512, "x" * 513, None])).groupBy("document_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"d1": 1, "d2": 2}
    with pytest.raises(ValueError):
        chunking.fixed_window(_docs(spark, [""]), 10, 10)


def test_recursive_split_keeps_sizes_and_words():
    text = "\n\n".join(" ".join(f"word{i}" for i in range(n)) for n in (3, 200, 5, 90)) + "x" * 1500
    parts = chunking.split_recursively(text, 300, 0)
    assert all(len(p) <= 300 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())


def test_merge_of_low_density():
    low, rich = "1 2 3 " * 20, "alpha beta gamma delta epsilon"
    assert chunking.merge_low_density([low, low, rich]) == [(f"{low}\n{low}\n{rich}", 2)]
    assert chunking.merge_low_density(["1 " * 1024, "1 "]) == [("1 " * 1024, 0), ("1 ", 0)]
    assert chunking.merge_low_density([rich, rich]) == [(rich, 0), (rich, 0)]


def test_semantic_groups():
    assert chunking.semantic_groups([0.1, 0.9, 0.1], [600, 600, 600, 600]) == [0, 1, 1, 2]
    assert chunking.semantic_groups([0.1], [600, 10]) == [0, 0] and chunking.semantic_groups([], []) == []


def test_clean_text(spark):
    df = _docs(spark, ["  a b�c\n\n\n\nd  e\té ", None])
    assert [r[0] for r in df.select(T.clean_text("text")).collect()] == ["a bc\n\nd e\té", None]


def test_empty_sets(spark):
    df = _docs(spark, [""])
    row = df.select(T.jaccard(T.tokens("text"), T.tokens(F.lit("a bb"))), T.containment(T.tokens("text"), T.tokens("text")), T.lexical_density("text")).first()
    assert tuple(row) == (0.0, 0.0, 0.0)


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, 6), (1, 2, 5), (1, 3, 4)], "k int, o int, c int")
    assert sorted(r.o for r in within_budget(df, "k", "o", "c", 10).collect()) == [1, 3]


def test_fusion_of_single_hits(spark):
    leg = lambda key: spark.createDataFrame([(1, key, 3.0)], "q int, k string, score double")
    got = {r.k: r.score for r in retrieval.weighted_fusion(leg("a"), leg("b"), "q", "k").collect()}
    assert got == {"a": 0.5, "b": 0.5}
    with pytest.raises(ValueError):
        retrieval.ranked(leg("a"), "q", "k", 0)


def test_claim_levels(spark):
    rows = [(1, "the model has seven billion parameters", ["this model has seven billion parameters overall"]), (2, "latency fell by 40 %", ["latency fell by 30 % last year"]), (3, "unrelated words entirely here", ["nothing"]), (4, "any claim", [])]
    got = {r.id: r.level for r in retrieval.claim_support(spark.createDataFrame(rows, "id int, claim string, evidence array<string>")).collect()}
    assert got == {1: "supported", 2: "partial", 3: "unsupported", 4: "unsupported"}


def test_policy(spark):
    rows = [("configured_scrape", "promote", None), ("configured_scrape", "duplicate", 0.9), ("agent_research", "promote", 0.71), ("agent_research", "promote", 0.69), ("agent_research", "promote", None), ("unknown", "promote", 1.0)]
    df = spark.createDataFrame(rows, "p string, d string, s double")
    assert [r[0] for r in df.select(F.coalesce(curation.policy(F.col("p"), F.col("d"), F.col("s")), F.lit(False))).collect()] == [True, False, True, False, False, False]


def test_tiers_of_ties_and_a_single_candidate(spark):
    schema = "document_id string, doc_id long, decision string, duplicate_of string, score double"
    rows = [(f"d{i}", i, "promote", None, s) for i, s in enumerate([0.9, 0.9, 0.5])] + [("x", 9, "defer", None, 0.1)]
    got = {r.document_id: (r.tier, r["rank"], r.percentile) for r in curation.tiers(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"d0": ("auto_promote", 1, 1.0), "d1": ("auto_promote", 2, 1.0), "d2": ("auto_reject", 3, 0.0), "x": ("hard_reject", 0, 0.0)}
    one = curation.tiers(spark.createDataFrame(rows[:1], schema)).first()
    assert (one.tier, one.percentile) == ("auto_promote", 1.0)


def test_similar_pairs_write_no_pair_that_only_shares_a_word(spark, monkeypatch):
    """One rare word in all sets makes no candidates of them; links and their words are those of brute force."""
    rng = random.Random(9)
    sets = [(i, sorted({"same", *(f"w{rng.randrange(400)}" for _ in range(30))})) for i in range(300)]
    sets += [(300 + i, sorted({*sets[i][1][:-1], f"y{i}"})) for i in range(40)]
    counts, whole = {}, curation.materialize

    def noted(df, name="table"):
        out = whole(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(curation, "materialize", noted)
    found = curation.similar_pairs(spark.createDataFrame(sets, "doc_id long, w array<string>"), "doc_id", "w", share=1).collect()
    near = {(a, b) for a, x in sets for b, y in sets if a < b and 10 * len(set(x) & set(y)) >= 8 * len(set(x) | set(y))}
    assert {(r.a, r.b) for r in found} == near and len(near) >= 40
    assert counts["pairs"] <= 2 * len(near)


def test_similar_pairs_write_words_once_and_compare_in_blocks(spark, monkeypatch):
    """A set is one row of prefixes, words are written once and move for pairs alone; groups larger than a task are cut."""
    rng = random.Random(4)
    base = [[f"v{k}x{i}" for i in range(30)] for k in range(4)]
    sets = [(i, sorted({w for w in base[i % 4] if rng.random() > 0.05} | {f"own{i}"})) for i in range(120)]
    sets += [(200 + i, sets[i][1]) for i in range(5)] + [(300 + i, [f"alone{i}n{k}" for k in range(12)]) for i in range(20)]
    tables, whole = [], curation.materialize

    def noted(df, name="table"):
        tables.append((name, df.schema.simpleString(), (out := whole(df, name)).count()))
        return out

    monkeypatch.setattr(curation, "materialize", noted)
    monkeypatch.setattr(curation, "_HELD", 7, raising=False)
    found = curation.similar_pairs(spark.createDataFrame(sets, "doc_id long, w array<string>"), "doc_id", "w").collect()
    of, copies = dict(sets), {200 + i for i in range(5)}
    near = {(a, b): len({*of[a]} & {*of[b]}) / len({*of[a]} | {*of[b]}) for a in of for b in of if a < b and not {a, b} & copies}
    want = sorted([(a, b, round(s, 6)) for (a, b), s in near.items() if s >= 0.8] + [(i - 200, i, 1.0) for i in copies])
    assert sorted((r.a, r.b, r.similarity) for r in found) == want and len(want) > 100
    assert [name for name, schema, _ in tables if "array<string>" in schema] == ["sets"]
    assert {n for name, _, n in tables if name == "prefixes"} == {140}


def test_accepted_documents_write_words_once(spark, tmp_path, monkeypatch):
    from corpusloom.operators.catalog import QUERIES

    rng = random.Random(8)
    texts = [" ".join([f"own{i}", *(f"b{i % 9}w{k}" for k in range(25) if rng.random() > 0.04)]) for i in range(90)]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    schemas, whole = [], curation.materialize
    monkeypatch.setattr(curation, "materialize", lambda df, name="table": (schemas.append(df.schema.simpleString()), whole(df, name))[1])
    got = sorted(r.doc_id for r in QUERIES["dup_06_accepted"](spark, str(tmp_path)).collect())
    sets, kept = [{*t.split()} for t in texts], []
    for i, x in enumerate(sets):
        if not any(10 * len(x & sets[k]) >= 8 * len(x | sets[k]) for k in kept):
            kept.append(i)
    assert got == kept and 9 <= len(kept) < 90
    assert sum("array<string>" in x for x in schemas) == 1


def test_similar_pairs_and_acceptance_against_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(60)}" for _ in range(20)] for _ in range(6)]
    sets = [(i, sorted({w if rng.random() > 0.06 else f"x{rng.randrange(99)}" for w in base[i % 6]})) for i in range(60)] + [(100, []), (101, [])]
    df = spark.createDataFrame(sets, "doc_id long, w array<string>")
    near = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and 10 * len(set(x) & set(y)) >= 8 * len(set(x) | set(y))}
    pairs = curation.similar_pairs(df, "doc_id", "w")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}
    same = {(a, b) for a, b in near if dict(sets)[a] == dict(sets)[b]}
    assert {p for p in found if p not in same} <= near
    full = spark.createDataFrame(sorted(near), "a long, b long") if near else pairs
    kept = []
    for d, x in sets:
        if not any((k, d) in near for k in kept):
            kept.append(d)
    assert sorted(r.doc_id for r in curation.accepted(df, full).collect()) == kept


def test_cluster_folds():
    ids, sim = [1, 2, 3], {(1, 2): 0.6, (2, 3): 0.6}
    assert topics.complete_linkage(ids, sim, 0.5) == [[1], [2, 3]]
    assert topics.single_pass(ids, sim, 0.5) == [[1, 2, 3]]
    assert topics.single_pass([1, 2], {}, 0.5) == [[1], [2]]


def test_folds_by_component_equal_the_whole():
    rng = random.Random(1)
    for _ in range(60):
        ids = list(range(9))
        sim = {(a, b): rng.choice([0.2, 0.5, 0.6, 0.7]) for a in ids for b in ids if a < b and rng.random() < 0.4}
        strong, up = {k: s for k, s in sim.items() if s >= 0.5}, list(ids)
        for a, b in strong:
            x, y = up[a], up[b]
            up = [x if u == y else u for u in up]
        for fold in (topics.complete_linkage, topics.single_pass):
            parts = [g for c in set(up) for g in fold([i for i in ids if up[i] == c], {k: s for k, s in strong.items() if up[k[0]] == c}, 0.5)]
            assert sorted(map(sorted, parts)) == sorted(map(sorted, fold(ids, strong, 0.5)))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 140)) and got[200] == got[199] == 199
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_graph_hops(spark):
    clusters = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, None)], "cluster int, parent int")
    got = {(r.cluster, r.hop) for r in retrieval.hops(clusters, spark.createDataFrame([(1,)], "seed int")).collect()}
    assert got == {(1, 0), (0, 1), (2, 1)}


def test_navigation_hops_only_where_hits_are_few(spark):
    clusters = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, None)], "cluster int, parent int")
    members = spark.createDataFrame([(k, f"d{k}{i}") for k in range(4) for i in range(4)], "cluster int, document_id string")
    chunks = spark.createDataFrame([(f"d{k}{i}", f"c{k}{i}{j}", j) for k in range(4) for i in range(4) for j in range(2)], "document_id string, chunk_id string, chunk_index int")
    queries = spark.createDataFrame([(q,) for q in range(1, 6)], "query_id long")
    rows = [(1, "c100", "d10"), (1, "c110", "d11"), (1, "c120", "d12")]  # three hits of three documents: enough
    rows += [(2, "c100", "d10"), (2, "c101", "d10"), (2, "c110", "d11")]  # three hits of two documents
    rows += [(3, "c300", "d30"), (5, "c100", "d10"), (5, "c200", "d20")]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id string, document_id string")
    entries = spark.createDataFrame([(4, 2), (5, 3)], "query_id long, cluster int")
    got = {}
    for r in retrieval.navigated(hits, queries, entries, clusters, members, chunks).where("hop > 0").collect():
        got.setdefault((r.query_id, r.cluster, r.hop), []).append(r.chunk_id)
    # the lone cluster has no neighbours; entries serve only a query without hits; both entries of query 5 are visited
    assert {k: len(v) for k, v in got.items()} == {(2, 0, 1): 5, (2, 2, 1): 5, (4, 0, 1): 5, (4, 1, 1): 5, (5, 0, 1): 5}
    assert sorted(got[2, 0, 1]) == ["c000", "c001", "c010", "c011", "c020"]


def test_central_chunks_of_a_document(spark):
    fill = lambda w, n: (w + " ") * n
    # seven windows of 448 characters, the third and the last about something else
    parts = [fill("alpha beta", 41)[:448], fill("alpha gamma", 40)[:448], fill("zeta", 90)[:448], fill("beta alpha", 41)[:448], fill("gamma beta", 41)[:448], fill("alpha", 75)[:448], fill("omega", 75)[:448]]
    rows = [("long", "".join(parts)), ("short", "one two"), ("none", ""), ("null", None), ("wide", "x" * 20_000)]
    got = {r.document_id: r.text for r in curation.representative_texts(spark.createDataFrame(rows, "document_id string, text string")).collect()}
    assert set(got) == {"long", "short", "wide"} and got["short"] == "one two"
    kept = got["long"].split("\n\n")
    assert len(kept) == 5 and [k[:5] for k in kept] == ["alpha", "alpha", "beta ", "gamma", "alpha"]
    assert len(got["wide"]) == 5 * 512 + 4 * 2 and len(curation.representative_texts(spark.createDataFrame([("a", "y" * 9000)], "document_id string, text string"), most=30).first().text) == 5000


def test_recall_without_words_takes_the_newest(spark):
    from types import SimpleNamespace

    told = spark.createDataFrame([("s", i, "user" if i % 2 else "assistant", f"word{i} tea", i) for i in range(30)], "session_id string, turn long, role string, content string, created_at long")
    asked = spark.createDataFrame([(1, "?!"), (2, "word3 a b c d e f g word5"), (3, "nothing")], "item_id long, text string")
    got = [(r.item_id, r.chunk_id) for r in retrieval.recalled(SimpleNamespace(episodes=told), asked, 3).collect()]
    assert sorted(got) == [(1, "s:25"), (1, "s:27"), (1, "s:29"), (2, "s:3")]


def test_sitemaps_of_sitemaps(spark):
    index = lambda *x: "<sitemapindex xmlns='http://s'>" + "".join(f"<sitemap><loc> {y} </loc></sitemap>" for y in x) + "</sitemapindex>"
    urls = lambda *x: "<urlset>" + "".join(f"<url><loc>{a}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</url>" for a, d in x) + "</urlset>"
    maps = {
        "root": index("b", "a", "root", "missing", "broken"), "a": index("leaf2", "b", "a"), "b": urls(("http://h/p/1", "2024-02-01"), ("http://h/p/old", "2023-12-31"), ("http://h/p/2", None)),
        "leaf2": urls(("http://h/p/3", "soon"), ("http://h/no/4", None), ("http://h/p/skip", None), ("http://h/p/5", "2024-01-01T00:00:00Z")), "broken": "<urlset><url>", "other": urls(("http://h/p/6", None)), "empty": None,
    }
    df, roots = spark.createDataFrame(list(maps.items()), "url string, xml string"), spark.createDataFrame([("root",)], "url string")
    got = lambda **kw: [r.loc.rsplit("/", 1)[1] for r in files.sitemap_tree(df, roots, **kw).collect()]
    assert got() == ["1", "old", "2", "3", "4", "skip", "5"]
    assert got(since="2024-01-01", pattern="^/p/", exclude=("skip",)) == ["1", "2", "3", "5"]
    assert got(most=2) == ["1", "old"] and got(depth=0) == []


def test_json_is_printed_with_sorted_keys(spark):
    import json

    rows = ['{"b": 1, "a": {"d": [1, {"z": 1, "y": null}], "c": "é\\n"}}', '{"text": "hello", "k": 1, "a": 2}', '{"text": 5, "a": 1}', "[3, 1.50, true]", '"s"', "not json", None, "{}"]
    content, keys = files.json_document("x")
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "x string").select(content, keys).collect()]
    plain = lambda x: json.dumps(json.loads(x), indent=2, ensure_ascii=False, sort_keys=True)
    assert got == [(plain(rows[0]), "a,b"), ("hello", "a,k"), (plain(rows[2]), "a,text"), (plain(rows[3]), ""), ('"s"', ""), ("not json", None), (None, None), ("{}", "")]


def test_message_classes(spark):
    rows = ["Hola!", "quién sos?", "ejecuta la tarea", "que sabes de mi", "plan de estudio", "transformers"]
    got = [r[0] for r in _docs(spark, rows).select(scalar_queries.message_class("text")).collect()]
    assert got == ["greeting", "identity", "command", "memory", "roadmap", "knowledge"]


def test_roadmap_findings(spark):
    units = spark.createDataFrame([(1, 1, True, 60), (1, 2, False, 130)], "roadmap int, unit int, grounded boolean, minutes int")
    assert {r.code for r in roadmap_findings(units).collect()} == {"ungrounded_unit", "effort_outlier", "too_few_units"}


def test_blocks_and_links():
    page = "<body><nav>menu of the site here</nav><div class='sidebar'>some words that are dropped here</div><div class='sidebar'><p>kept words as it holds a paragraph</p></div><p>short</p><h1>A heading of five words</h1><p>one two three four five</p><a href='/2024/a'>x</a></body>"
    assert [(t, tag) for t, tag, *_ in blocks(page)] == [("kept words as it holds a paragraph", "p"), ("A heading of five words", "h1"), ("one two three four five", "p")]
    assert blocks("") == [] and blocks(None) == []


def test_links_by_four_heuristics():
    base = "https://e.org/list/"
    assert links("<a href='/2024/a'>x</a>", base) == []
    # the first link of an article, whatever it looks like
    assert links("<article><a href='/tag/x'>1</a><a href='/second'>2</a></article>", base)[0] == "https://e.org/tag/x"
    page = "<article><a href='/a'>1</a></article><div class='sidebar'><a href='/side'>s</a></div><div class='my-posts x'><a href='/b?q=1#f'>2</a><a href='/login'>no</a><a href='mailto:x'>no</a></div><div class='feed'><a href='/second-area'>no</a></div><a href='/x/2024/01/15/c'>3</a><a href='https://other.org/2024/01/15/d'>no</a>"
    assert links(page, base) == ["https://e.org/a", "https://e.org/b?q=1", "https://e.org/x/2024/01/15/c"]
    # a main element comes before a content area
    assert links("<div class=content><a href=/no>1</a></div><main><a href=/m1>1</a><a href=/m2>2</a><a href=/m3>3</a></main>", base) == ["https://e.org/m1", "https://e.org/m2", "https://e.org/m3"]
    # fewer than three: what is below the page's own path
    assert links("<a href='one'>1</a><a href='/list/two'>2</a><a href='/list/tag/x'>no</a><a href='/elsewhere'>no</a><a href='/list'>no</a><a href='/list/a.png'>no</a><a href='HTTPS://E.ORG/list/Three'>no: another host to the letter</a>", base) == ["https://e.org/list/one", "https://e.org/list/two"]
    assert links("", base) == [] and links("<a>x</a><a href=''>y</a>", base) == []


def test_files_are_scanned_registered_and_upserted(spark, tmp_path):
    for name, body in (("a.txt", b"x"), ("b.pdf", b"%PDF-1"), (".hidden", b"h"), ("c.tmp", b"t"), ("copy.txt", b"x")):
        (tmp_path / name).write_bytes(body)
    found = files.scan(spark, str(tmp_path))
    assert files.register(found).count() == 2 and found.count() == 3
    assert files.register(found, files.register(found)).count() == 0
    mimes = {r.path.rsplit("/", 1)[-1]: r.mime for r in found.withColumn("mime", files.detect_mime(F.col("content"), F.regexp_extract("path", "([^/]*)$", 1))).collect()}
    assert mimes == {"a.txt": "text/plain", "b.pdf": "application/pdf", "copy.txt": "text/plain"}
    rows = lambda *x: spark.createDataFrame(x, "k int, v int, at int")
    assert {(r.k, r.v) for r in files.upsert(rows((1, 1, 1), (2, 1, 1)), rows((1, 2, 2)), "k", "at").collect()} == {(1, 2), (2, 1)}


def test_without_a_shared_folder_a_cluster_is_refused():
    from types import SimpleNamespace

    import pytest

    from corpusloom.session import shared_dir

    unset = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: unset)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=context))


def test_parent_categories_split_large_groups(spark):
    from corpusloom.operators.topics import parent_categories

    # nine topics in a chain of two shared terms, three of them also share a third
    terms = [[f"t{i}", f"u{i}", f"t{i + 1}", f"u{i + 1}"] for i in range(9)]
    for i in (3, 4, 5):
        terms[i].append("extra")
    rows = [(f"k{i}", t) for i, t in enumerate(terms)] + [("a1", ["p", "q"]), ("a2", ["p", "q"]), ("b", ["z"])]
    got = {r.k: r.category for r in parent_categories(spark.createDataFrame(rows, "k string, t array<string>"), "k", "t").collect()}
    assert got == {f"k{i}": "k3" if i in (3, 4, 5) else None for i in range(9)} | {"a1": "a1", "a2": "a1", "b": None}
    few = spark.createDataFrame(rows[-3:], "k string, t array<string>")
    assert {r.category for r in parent_categories(few, "k", "t").collect()} == {None}


def test_pages_lose_no_character_and_reports_are_not_cut(spark):
    import pytest

    from corpusloom.sources import files, queries

    text = "aé日🙂" * 1500
    assert "".join(queries._parts(text.encode())) == text and len(queries._parts(text.encode())) == 3
    assert len(files.report_lines(spark.range(1000), "t")) == 1002
    with pytest.raises(ValueError, match="1,000"):
        files.report_lines(spark.range(1001), "t")


def test_single_pass_folds_about_one_pair_a_vector(spark, monkeypatch):
    """Clusters are those of a fold over all pairs, ties included, of which only the best of each vector are written."""
    rng = random.Random(4)
    rows = [(i, [float(rng.choice([-1, 1, 2])) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    pairs = {(r.a, r.b): r.s for r in topics.vector_pairs(df, 0.3).collect()}
    want = {i: min(g) for g in topics.single_pass([i for i, _ in rows], pairs, 0.3) for i in g}
    counts, whole = {}, topics.materialize

    def noted(df, name="table"):
        out = whole(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(topics, "materialize", noted)
    assert {r.vec_id: r.cluster for r in topics.clustered(df, 0.3, topics.single_pass).collect()} == want
    assert counts["pairs"] < len(pairs) / 4


def test_strongest_terms_move_five_a_document(spark, tmp_path):
    """Words of a text are not shuffled; rows of one document id count together, as its SQL has it."""
    from corpusloom.operators.catalog import QUERIES

    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(300)]
    rows = [(i // 2 if i < 10 else i, " ".join(rng.choice(words) for _ in range(60)), "en", "src1", 0) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["evl_08"](spark, str(tmp_path))
    tf = {}
    for d, text, *_ in rows:
        for w in text.split():
            tf[d, w] = tf.get((d, w), 0) + 1
    got = {(r.doc_id, r.term) for r in out.collect()}
    assert len(got) == 5 * len({d for d, _ in tf}) and got <= tf.keys()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan and "regexp_extract_all" not in plan


def test_both_chunkings_are_asked_the_same_written_queries(spark, monkeypatch):
    """The sample over all chunks is taken once."""
    from corpusloom.operators.catalog import QUERIES

    names, whole = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, name="table": names.append(name) or whole(df, name))
    assert QUERIES["evl_10"](spark, "/root/testdata/sf0.001").count() == 2
    assert names.count("queries") == 1


def test_recursive_split_holds_no_list_of_a_text_s_parts():
    """A text without any separator, of characters that are objects of their own."""
    import tracemalloc

    text = "".join(chr(0x4E00 + i % 20_000) for i in range(1_000_000))
    tracemalloc.start()
    n = sum(len(x) for x in chunking.pieces(text, 512, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) and peak < 1_000_000


def test_curation_moves_no_text(spark):
    """Texts are measured in one pass before any join."""
    from corpusloom.operators.corpus import Corpus

    d = curation.curated(Corpus(spark, "/root/testdata/sf0.001"))
    assert "text" not in d.columns
    assert "recommend|implement" not in d._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="blanks"):
        curation.sub_scores(d, ("two words",))
