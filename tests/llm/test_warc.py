"""WARC archives: exact round trips, the index against a plain search, and odd inputs."""

import gzip
import hashlib
import random

import pytest
from millrace.llm import warc

from .brute import sample  # isort: skip

SCHEMA = "page_id long, url string, html string, key string, file string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "f", "d") for i, u, h in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [t for _, t in sample(8, 30)]
    hosts = ["http://a.example.com", "https://User:pw@A.Example.com:443", "http://b.example.com:8080", "ftp://c.org", "http://example.com"]
    out = [(i, f"{rng.choice(hosts)}/p{rng.randrange(12)}?q={rng.randrange(3)}#x{i}", rng.choice(texts)) for i in range(150)]
    copy = "<p>copy</p>" * 20
    out += [(1000 + i, f"http://hot.example.com/{i % 3}", copy) for i in range(300)]  # a hot host, a hot payload, few keys
    return [*out, (5000, None, None), (5001, "", ""), (5002, "http://x/\r\nWARC-Type: fake\r\n\r\n%41 é", "\r\n\r\nWARC/1.1\r\n\r\n"), (5003, "no scheme", "x" * 99), (5004, "é://ü", "x" * 99), (5005, "http://é.fr/ü", "é" * 50), (5006, "u", "é" * 50)]


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) by the contract, row by row."""
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == body and j is not None] if len(body) >= 100 else []
        first = min(same, default=i)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=repr)


def read(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


def test_round_trip(spark, rows):
    archive = warc.Archive.write(pages_of(spark, rows).repartition(5), block=7)
    pages = pages_of(spark, rows)
    assert read(archive.find(pages)) == expected(rows)
    whole = {r["page_id"]: r for r in archive.resolved(pages).collect()}
    for i, u, h in rows:
        assert bytes(whole[i]["payload"]) == (h or "").encode() and whole[i]["url"] == u
    # the files are gzip members one after the other, each a WARC record
    files = [p for p in archive_files(archive, "archives") if p.endswith(".gz")]
    text = b"".join(gzip.open(p).read() for p in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)


def archive_files(archive, part):
    folder = warc.Folder(archive.root)
    return [f.path for f in folder.fs.get_file_info(warc.arrow_fs.FileSelector(f"{folder.root}/{part}"))]


def test_lookups(spark, rows):
    """Every capture of a key and nothing else, however blocks and files cut it."""
    pages = pages_of(spark, rows).repartition(4)
    captures = warc.write_archives(pages, root := warc.shared_folder(spark) + "/look", file_bytes=2000)
    assert captures.select("file").distinct().count() > 4
    want = sorted(tuple(r) for r in captures.fillna(-1, ["page_id"]).collect())
    for files, block in ((1, 1), (3, 2), (5, 11), (16, 3000)):
        index = warc.write_index(captures, root, files, block)
        top = [tuple(r) for r in index.collect()]
        found = warc.Index(warc.Folder(root), top)
        assert sum(r[3] for r in top) == len(rows) and len(top) <= files
        keys = sorted({k for k, *_ in want})
        for key in [*keys, "", "zzz", "com,example,a)/p", "com,example,hot)/1x"]:
            got = [(k, i if i != warc._NO_ID else -1, *rest) for k, i, *rest in found.find(key)]
            assert sorted(got) == [e for e in want if e[0] == key]
        before = found.reads
        assert len(list(found.find("com,example,hot)/1", 1100, 1150))) == len([i for i in range(100, 151) if i % 3 == 1]) and found.reads - before <= 2 + 1 + 60 // block + 2 * files
    some = warc.locate(index, root, spark.createDataFrame([("HTTP://hot.EXAMPLE.com:80/2#f", None), ("http://hot.example.com/0", 1003), ("http://nowhere/", 1)], "url string, page_id long"))
    assert sorted(r["page_id"] for r in some.collect()) == sorted([1003, *(1000 + i for i in range(300) if i % 3 == 2)])


def test_keys():
    assert warc.url_key("http://www.Example.com:80/a/B?c=d#e") == "com,example,www)/a/B?c=d" and warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key(None) == warc.url_key("") == "" and warc.url_key("http://u@h.org?x") == "org,h)?x"


def test_nulls_repeats_and_empty(spark):
    big = "y" * 200
    rows = [(3, "a", big), (3, "a", big), (None, "b", big), (7, None, big), (None, None, None), (9, "c", "z" * 100), (None, "d", "w" * 120), (None, "e", "w" * 120)]
    pages = pages_of(spark, rows)
    archive = warc.Archive.write(pages)
    found = archive.find(pages).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in found if r["page_id"] is not None) == [(3, "response", None), (3, "response", None), (7, "revisit", 3), (9, "response", None)]
    assert sorted(((r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found if r["page_id"] is None), key=repr) == [("response", None, 0), ("response", None, 120), ("response", None, 120), ("revisit", 3, 200)]
    none = warc.Archive.write(pages.limit(0))
    assert none.find(pages).count() == 0 and archive.find(pages.limit(0)).count() == 0


def test_damage_is_found():
    member = warc.record(1, "http://a/", b"payload" * 30, hashlib.sha256(b"payload" * 30).hexdigest(), None, "1970-01-01T00:00:00Z")
    assert warc.parse(member).payload == b"payload" * 30
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(gzip.decompress(member).replace(b"payload" * 3, b"pay1oad" * 3)))
