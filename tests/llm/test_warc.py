import gzip
import hashlib
import random

import pytest

from corpusloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def _expected(rows):
    first = {}
    for page, _, text in rows:
        if page is not None:
            first[text or ""] = min(page, first.get(text or "", page))
    out = []
    for page, _, text in rows:
        raw, least = (text or "").encode(), first.get(text or "")
        revisit = len(raw) >= 100 and least is not None and page != least
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least if revisit else None, True))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_round_trip_with_magic_inside_payloads(spark):
    fake = "x" * 50 + "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "tail\n" * 5
    rows = [(1, "http://a", "é" * 60), (2, "http://b", "é" * 60), (3, None, None), (4, "u\r\nX: y", fake), (5, "c", fake), (6, "d", "WARC/1.1\r\n" * 40), (7, "e", ""), (7, "e", "z" * 200), (7, "e", "z" * 200), (None, "f", "z" * 200), (None, None, None), (8, "g", "short"), (9, "h", "short"), (10, "i", "a\r\nb\r\n\r\nWARC/1.1\r\n")]
    assert _got(warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3))) == _expected(rows)


def test_small_byte_ranges_need_pointer_jumping(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "ß", "\r\n", "WARC/1.1\r\n", "\r\n\r\n"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, f"http://{i}", rng.choice(texts)) for i in range(150)]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = warc.read_archives(spark, path, keep_payload=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and all(r.verified for r in got)
    by = {r.id: r for r in got}
    for page, _, text in rows:
        r = by[f"<urn:page:{page}>"]
        if r.type == "response":
            assert bytes(r.payload) == text.encode()
        else:
            assert r.payload_digest == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.archive_round_trip(empty).count() == 0
    rows = spark.createDataFrame([(1, "u", "p" * 120, "clash", 3), (2, "u", "p" * 120, "clash", 4)], SCHEMA + ", value string, digest int")
    assert _got(warc.archive_round_trip(rows)) == _expected([(1, "u", "p" * 120), (2, "u", "p" * 120)])


def _archive(records):
    """Bytes of an archive of (version, type, id, block) and where each record begins."""
    out, places = b"", []
    for version, kind, name, block in records:
        places.append(len(out))
        out += f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out, places


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_foreign_archives_with_any_bytes(spark, tmp_path, version, packed):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    bodies = [b"caf\xe9 \xff\xfe", b"\x00\x01\x00nul\r\n\r\n", b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n", b"WARC/WARC/1.WARC/1.1\r\n\xe9", b"", bytes(range(256)) * 20]
    raw, places = _archive([(version, "response", f"r{i}", http + b) for i, b in enumerate(bodies)] + [("1.1", "warcinfo", "info", b"software: x\r\n")])
    folder = tmp_path / "in"
    folder.mkdir()
    if packed:
        # one member a record, as crawlers write them
        cut = [*places, len(raw)]
        (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)))
    else:
        (folder / "a.warc").write_bytes(raw)
    got = {r.id: r for r in warc.read_archives(spark, str(folder), keep_payload=True).collect()}
    assert len(got) == len(bodies) + 1 and sorted(r.offset for r in got.values()) == places
    for i, body in enumerate(bodies):
        r = got[f"<r{i}>"]
        assert (bytes(r.payload), r.payload_bytes, r.payload_digest) == (body, len(body), hashlib.sha256(body).hexdigest())


def test_ids_of_any_text_come_back(spark):
    ids = ["", "a\r\nb", "<x>:%41 é+", " ", None, "WARC/1.1\r\n"]
    df = spark.createDataFrame([(x, "u", "p" * 150 if i else "q") for i, x in enumerate(ids)], SCHEMA.replace("page_id long", "page_id string"))
    got = warc.archive_round_trip(df).collect()
    assert sorted(map(repr, (r.page_id for r in got))) == sorted(map(repr, ids))
    least = min(x for x in ids[1:] if x is not None)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {least}


def test_a_file_cut_short_ends_with_its_last_whole_record(spark, tmp_path):
    raw, places = _archive([("1.1", "response", f"r{i}", b"x" * 50) for i in range(3)])
    (tmp_path / "a.warc").write_bytes(raw[:-30])
    assert sorted(r.offset for r in warc.read_archives(spark, str(tmp_path)).collect()) == places[:2]
