"""WARC archives with a two-level capture index: captures sorted by reversed-host key in compressed blocks, and a sparse directory of these."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_batches, rows_of, shared_folder, stored, table

#: Fixed value: what a revisit record says it is.
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?(.*)", re.DOTALL)
_PORTS = {"http": "80", "https": "443"}


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then port, path and query: pages of a host, and hosts of a domain, are neighbours.

    The scheme is left out, as are fragments, user names and default ports; hosts are lower-cased. Null gives an empty key.
    """
    if not url:
        return ""
    scheme, host, port, rest = _URL.match(url).groups()
    port = "" if port is None or port == _PORTS.get((scheme or "").lower()) else ":" + port
    return ",".join(reversed(host.lower().split("."))) + port + ")" + (rest.partition("#")[0] or "/")


def _header_value(text: str) -> str:
    """A URL without characters that would end a header line; ``unquote`` gives them back."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: tuple[int, str | None] | None, date: str) -> bytes:
    """One record, a gzip member of its own: a response with its payload, or a revisit of an earlier one with the same payload."""
    lines = [
        "WARC/1.1", "WARC-Type: " + ("response" if original is None else "revisit"), f"WARC-Date: {date}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if original is not None:
        lines += [f"WARC-Profile: {_SAME}", f"WARC-Refers-To: <urn:page:{original[0]}>", f"WARC-Refers-To-Date: {date}"]
        if original[1] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header_value(original[1])}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if original is None else b""
    lines.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


@dataclass
class Capture:
    """What a record says when it's read again. ``payload`` is None for a revisit; ``payload_bytes`` is the full payload's length."""

    page_id: int | None
    url: str | None
    record_type: str
    payload_digest: str
    payload_bytes: int
    payload: bytes | None
    refers_to: int | None
    refers_to_url: str | None


def _headers(text: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def parse(member: bytes) -> Capture:
    """A record from its gzip member; lengths and the digest of a response's payload are checked."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    own = _headers(head)
    block = rest[: int(own["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(_headers(http)["content-length"])
    kind, digest = own["warc-type"], own["warc-payload-digest"].removeprefix("sha256:")
    if not head.startswith(b"WARC/1.") or rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {own.get('warc-record-id')}")
    number = lambda name: int(x) if (x := own.get(name, "<urn:page:>")[10:-1]) else None
    uri = lambda name: unquote(own[name]) if name in own else None
    return Capture(number("warc-record-id"), uri("warc-target-uri"), kind, digest, length, payload if kind == "response" else None, number("warc-refers-to"), uri("warc-refers-to-target-uri"))


class Folder:
    """Files under a folder that all executors share, by any of Arrow's file systems."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = arrow_fs.FileSystem.from_uri(root)

    def create(self, name: str) -> pa.NativeFile:
        self.fs.create_dir(f"{self.root}/{name}".rpartition("/")[0], recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def open(self, name: str) -> pa.NativeFile:
        return self.fs.open_input_file(f"{self.root}/{name}")


def duplicates(pages: DataFrame, least: int = 100) -> DataFrame:
    """``(digest, first_id, first_url)`` for payloads of at least ``least`` bytes that several rows have; the smallest id is the first."""
    known = pages.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= least)
    first = known.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    return stored(first.filter("n > 1 AND first IS NOT NULL").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "same-payloads")


_CAPTURES = "key string, page_id long, file string, start long, length long"


def write_archives(pages: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z", least: int = 100, file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for every page into gzipped WARC files of about ``file_bytes`` under ``root``; gives ``(key, page_id, file, start,
    length)`` for each, stored.

    Of rows with equal payloads of at least ``least`` bytes those with the smallest ``page_id`` are responses, all others
    revisits of it. A task that is run again writes files of new names; only those named in the result count.
    """
    read = pages.select(F.col("page_id").cast("long"), "url", "html")
    same = duplicates(read, least)
    # stored before, so that Spark knows its size: sent to all tasks if small; else payloads move once, and a hot one is split
    met = read.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256)).join(same, "digest", "left").select("page_id", "url", "html", "digest", "first_id", "first_url")
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(root)

        def rows() -> Iterator[tuple]:
            out, name, at = None, "", 0
            for page_id, url, html, digest, first_id, first_url in rows_of(batches):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                    out = folder.create(name)
                original = None if first_id is None or first_id == page_id else (first_id, first_url)
                out.write(member := record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, original, date))
                yield url_key(url), page_id, name, at, len(member)
                at += len(member)
            if out is not None:
                out.close()

        yield from in_batches(rows(), schema, 4096)

    return stored(met.mapInArrow(write, _CAPTURES), "captures")


_ENTRY = tuple[str, int, str, int, int]  # key, page_id (-1 - 2**63 for null), file, start, length
_NO_ID = -(1 << 63)


def write_index(captures: DataFrame, root: str, files: int = 16, block: int = 3000) -> DataFrame:
    """Sort captures by key into index files of compressed blocks of ``block`` entries; gives one row for each file, stored: ``(file, first_key,
    first_id, entries, directory_start, directory_length)``.

    A file is one range of keys (and page ids, so that a key that many captures have is split). Behind its blocks lies its directory,
    with the first entry, place and length of each block: 1 row in ``block``. The rows given here are the top of it: ``files`` at most.
    """
    schema = pa.schema([("file", pa.string()), ("first_key", pa.string()), ("first_id", pa.int64()), ("entries", pa.int64()), ("directory_start", pa.int64()), ("directory_length", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, name = Folder(root), f"index/{uuid.uuid4().hex}.idx"
        directory, held, at, n, out = [], [], 0, 0, None

        def end() -> None:
            nonlocal at
            body = zlib.compress("\n".join(json.dumps(e) for e in held).encode(), 6)
            out.write(body)
            directory.append([*held[0][:2], at, len(body)])
            at += len(body)
            held.clear()

        for entry in rows_of(batches):
            out = out or folder.create(name)
            held.append(entry)
            n += 1
            if len(held) >= block:
                end()
        if out is not None:
            if held:
                end()
            body = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(body)
            out.close()
            yield from in_batches([(name, directory[0][0], directory[0][1], n, at, len(body))], schema)

    whole = captures.withColumn("page_id", F.coalesce("page_id", F.lit(_NO_ID))).select("key", "page_id", "file", "start", "length")
    ranged = whole.repartitionByRange(files, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "start")
    return stored(ranged.mapInArrow(write, "file string, first_key string, first_id long, entries long, directory_start long, directory_length long"), "index-files")


class Index:
    """Looks keys up: a binary search over the files' first entries, one over the file's directory, one in the block that is read."""

    def __init__(self, folder: Folder, top: list[tuple]) -> None:
        self.folder, self.top = folder, sorted(top, key=lambda r: r[1:3])
        self.firsts = [list(r[1:3]) for r in self.top]
        self.directories: dict[int, tuple[list, list]] = {}
        self.open: dict[int, pa.NativeFile] = {}
        self.block: tuple = (None, None, [])
        self.reads = 0

    def _read(self, number: int, start: int, length: int) -> bytes:
        if number not in self.open:
            self.open = {number: self.folder.open(self.top[number][0])}  # keys come in order: one file at a time
        self.reads += 1
        return zlib.decompress(self.open[number].read_at(length, start))

    def _directory(self, number: int) -> tuple[list, list]:
        """A file's blocks, and the first entry of each."""
        if number not in self.directories:
            blocks = json.loads(self._read(number, *self.top[number][4:6]))
            self.directories = {number: (blocks, [b[:2] for b in blocks])}
        return self.directories[number]

    def _entries(self, number: int, at: int) -> list:
        if self.block[:2] != (number, at):
            _, _, start, length = self._directory(number)[0][at]
            self.block = (number, at, [json.loads(x) for x in self._read(number, start, length).split(b"\n")])
        return self.block[2]

    def find(self, key: str, low: int = _NO_ID, high: int = (1 << 63) - 1) -> Iterator[_ENTRY]:
        """The captures of a key whose page ids are from ``low`` to ``high``, in the order of the index."""
        before = lambda firsts: max(0, bisect_left(firsts, [key, low]) - 1)  # noqa: E731  entries of the key may begin before a first entry that equals it
        number = before(self.firsts)
        while number < len(self.top) and self.firsts[number] <= [key, high]:
            _, firsts = self._directory(number)
            for at in range(before(firsts), bisect_right(firsts, [key, high])):
                found = self._entries(number, at)
                a = bisect_left(found, [key, low], key=lambda e: e[:2])
                while a < len(found) and found[a][:2] <= [key, high]:
                    yield tuple(found[a])
                    a += 1
            number += 1


def locate(index: DataFrame, root: str, wanted: DataFrame, tasks: int = 16) -> DataFrame:
    """``(key, page_id, file, start, length)`` of the captures of ``wanted``, distinct rows of ``(url, page_id)``; with a null ``page_id`` all of its url.

    Wanted keys are sorted into ranges, so that a task reads neighbouring blocks, each once. Tasks get the top of the index, one row for each index file.
    """
    top = [tuple(r) for r in index.select("file", "first_key", "first_id", "entries", "directory_start", "directory_length").collect()]
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.schema([("key", pa.string()), ("low", pa.int64())])
        yield from in_batches(((url_key(url), _NO_ID if page_id is None else page_id) for url, page_id in rows_of(batches)), own, 8192)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(Folder(root), top)

        def rows() -> Iterator[tuple]:
            for key, low in rows_of(batches):
                for key, page_id, *place in found.find(key, low, low if low != _NO_ID else (1 << 63) - 1):
                    yield key, None if page_id == _NO_ID else page_id, *place

        yield from in_batches(rows(), schema, 8192)

    asked = wanted.select("url", F.col("page_id").cast("long")).mapInArrow(keyed, "key string, low long").distinct()
    return asked.repartitionByRange(tasks, "key", "low").sortWithinPartitions("key", "low").mapInArrow(look, _CAPTURES)


def read_records(places: DataFrame, root: str, payloads: bool = True, tasks: int = 16, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records at ``places``: ``(page_id, url, record_type, payload_digest, payload_bytes, refers_to, refers_to_url, payload)``; a revisit's payload is null.

    Places are sorted by file and offset; neighbours less than ``gap`` bytes apart are read at once, up to ``most`` bytes.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("refers_to", pa.int64()), ("refers_to_url", pa.string()), ("payload", pa.binary()),
    ])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(root)

        def members() -> Iterator[bytes]:
            name, source, held = None, None, []

            def taken() -> Iterator[bytes]:
                if held:
                    begin = held[0][0]
                    body = source.read_at(held[-1][0] + held[-1][1] - begin, begin)
                    yield from (body[s - begin : s - begin + n] for s, n in held)

            for file, start, length in rows_of(batches, 4096):
                if file != name or held and (start - held[-1][0] - held[-1][1] > gap or start + length - held[0][0] > most):
                    yield from taken()
                    held = []
                if file != name:
                    name, source = file, folder.open(file)
                held.append((start, length))
            yield from taken()

        def rows() -> Iterator[tuple]:
            for c in map(parse, members()):
                yield c.page_id, c.url, c.record_type, c.payload_digest, c.payload_bytes, c.refers_to, c.refers_to_url, c.payload if payloads else None

        yield from in_batches(rows(), schema, 256)

    ranged = places.select("file", "start", "length").repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")
    return ranged.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_to_url string, payload binary")


class Archive:
    """Archives and their index in one folder; what is written is a set of files and the two small tables that name them."""

    def __init__(self, spark: SparkSession, root: str, index: DataFrame) -> None:
        self.spark, self.root, self.index = spark, root, index
        self.tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    @staticmethod
    def write(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least: int = 100, block: int = 3000) -> Archive:
        """Write records of all ``pages`` (``page_id, url, html``) to a new folder under the shared one, then their index.

        Nulls: a null html is an empty payload; a null url has the empty key and no target; a null ``page_id`` is no first of equal
        payloads. Repeated rows are records each; of equal payloads all rows with the smallest id are responses. Very long
        pages are written whole. Empty tables give an archive without files. Other columns are ignored.
        """
        spark = pages.sparkSession
        root = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        captures = write_archives(pages, root, date, least)
        return Archive(spark, root, write_index(captures, root, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), block))

    def find(self, wanted: DataFrame, payloads: bool = True) -> DataFrame:
        """The records of ``wanted`` (``url``, and ``page_id`` or null for all captures of the url), as ``read_records`` gives them."""
        # each once, though asked for by id and by url; stored, as finding their ranges would look up twice
        places = stored(locate(self.index, self.root, wanted, self.tasks).distinct(), "places")
        return read_records(places, self.root, payloads, self.tasks)

    def resolved(self, wanted: DataFrame) -> DataFrame:
        """As ``find``, with a revisit's payload taken from the response it refers to, which is looked up in the index as well."""
        found = stored(self.find(wanted), "found")
        targets = found.filter("refers_to IS NOT NULL").select(F.col("refers_to_url").alias("url"), F.col("refers_to").alias("page_id")).distinct()
        # of rows with the first's id that differ in what they hold, the one with the digest asked for
        firsts = self.find(targets).select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("first_payload"))
        firsts = firsts.filter("first_payload IS NOT NULL").withColumn("n", F.row_number().over(W.partitionBy("refers_to", "payload_digest").orderBy("first_payload"))).filter("n = 1").drop("n")
        joined = found.join(firsts, ["refers_to", "payload_digest"], "left")
        return joined.select(*(c for c in found.columns if c != "payload"), F.coalesce("payload", "first_payload").alias("payload"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written, then each looked up in the index and read back."""
    pages = table(spark, sf_dir, "pages")
    found = Archive.write(pages).find(pages.select("url", "page_id"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
