"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record, one archive file per task, and returns one capture row
per record. ``build_index`` sorts the captures by reversed-host URL key into compressed blocks of
``BLOCK_LINES`` lines and writes, per range of keys, a sparse directory with one line per block. ``lookup``
finds a capture by bisecting the ranges, the range's directory and the lines of one block, and then reads
just the byte range of the record.

Files go to a folder that all executors share, through ``pyarrow.fs`` (local and shared mounts, HDFS, object
stores). File names are drawn anew by every task attempt; only those of attempts that ended are ever named
in the capture table, so a repeated task leaves an orphan file but no wrong row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import shared_uri, slices, stage, width

#: Payloads of at least this size are stored once.
MIN_REVISIT = 1000
BLOCK_LINES = 1000
CAPTURES = "at string, file string, offset long, length long"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a folder path without a scheme is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def url_key(url: str | None) -> str:
    """Reversed-host form of a URL: ``http://a.example.com/x?y`` gives ``com,example,a)/x?y``."""
    text = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip())
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return text
    if not host:
        return text
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:capture:{'' if page_id is None else page_id}:{digest}>"


def page_of(identifier: str) -> int | None:
    text = identifier.split(":")[2]
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, is_revisit: bool) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header and leaves the payload out."""
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    uri = lambda u: quote(u or "", safe=":/?#[]@!$&'()*+,;=%~-._")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest.hexdigest())}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {uri(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest.hexdigest())}", *([f"WARC-Refers-To-Target-URI: {uri(refers_url)}"] if refers_url else [])] if is_revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of one record and its payload; a stored payload that does not fit its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def with_roles(pages: DataFrame) -> DataFrame:
    """``pages`` with ``revisit``, ``refers_to`` and ``refers_url``: of equal payloads the largest page_id is kept.

    Equal payloads meet as digests, combined before they move; pages themselves are dealt by their own id, so
    a payload that a third of all pages share makes no large group.
    """
    small = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), "url")
    large = small.where(F.col("size") >= MIN_REVISIT)
    first = large.groupBy("digest").agg(F.max_by(F.struct("page_id", "url"), "page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1 AND kept IS NOT NULL")
    roles = (
        large.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("kept.page_id")))
        .select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("kept.page_id").alias("refers_to"), F.col("kept.url").alias("refers_url")).distinct()
    )
    match = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.sha1(F.coalesce("html", F.lit(""))) == F.col("r_digest"))
    joined = pages.join(roles, match, "left")
    return joined.select("page_id", "url", "html", F.col("r_digest").isNotNull().alias("revisit"), "refers_to", "refers_url")


def sort_key(url: str | None, page_id: int | None) -> str:
    """Text by which captures are ordered: the URL key, a blank (less than any character of a key), the page (null first)."""
    return f"{url_key(url)} {'' if page_id is None else f'{page_id + 2**63:020d}'}"


def create(uri: str) -> pa.NativeFile:
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` (``page_id, url, html``) as a record; returns the captures.

    The captures are settled before they are used, so that no later step writes archives again.
    """

    def run(batches):
        out, file, place = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        names = ("page_id", "url", "html", "revisit", "refers_to", "refers_url")
        for b in slices(batches):
            out = out or create(file)
            rows: dict[str, list] = {"at": [], "file": [], "offset": [], "length": []}
            for page_id, url, html, revisit, refers_to, refers_url in zip(*(b[c].to_pylist() for c in names), strict=True):
                member = gzip.compress(record(page_id, url, (html or "").encode(), refers_to, refers_url, revisit), 6, mtime=0)
                out.write(member)
                for column, value in zip(rows.values(), (sort_key(url, page_id), file, place, len(member)), strict=True):
                    column.append(value)
                place += len(member)
            yield pa.RecordBatch.from_pydict(rows)
        if out is not None:
            out.close()

    return stage(with_roles(pages).mapInArrow(run, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str) -> list[dict]:
    """Sort captures into compressed blocks, with a sparse directory of the blocks for each key range.

    Returns one small entry per range (at most as many as shuffle partitions): the range's first key and the
    name of its two files. The captures of a hot URL spread over ranges by page.
    """

    def run(batches):
        blocks, stream, place, name, held = [], None, 0, f"{folder}/{uuid.uuid4().hex}", []

        def block() -> None:
            nonlocal place, held
            data = zlib.compress("\n".join(held).encode(), 6)
            stream.write(data)
            blocks.append([held[0].partition("\t")[0], place, len(data)])
            place, held = place + len(data), []

        for b in batches:
            stream = stream or create(name + ".cdx")
            for row in zip(*(b[c].to_pylist() for c in ("at", "file", "offset", "length")), strict=True):
                held.append("\t".join(map(str, row)))
                if len(held) == BLOCK_LINES:
                    block()
        if stream is not None:
            if held:
                block()
            stream.close()
            with create(name + ".dir") as d:
                d.write(zlib.compress(json.dumps(blocks).encode(), 6))
            yield pa.RecordBatch.from_pydict({"first": [blocks[0][0]], "name": [name]})

    ranged = captures.repartitionByRange(width(captures.sparkSession), "at").sortWithinPartitions("at")
    ranges = stage(ranged.mapInArrow(run, "first string, name string"), "ranges")
    return [r.asDict() for r in ranges.orderBy("first").collect()]


@lru_cache(maxsize=64)
def reader(uri: str) -> pa.NativeFile:
    system, path = opened(uri)
    return system.open_input_file(path)


@lru_cache(maxsize=8)
def directory(name: str) -> tuple[list[str], list[list]]:
    data = reader(name + ".dir")
    blocks = json.loads(zlib.decompress(data.read_at(data.size(), 0)))
    return [b[0] for b in blocks], blocks


@lru_cache(maxsize=8)
def block_lines(name: str, offset: int, length: int) -> list[str]:
    return zlib.decompress(reader(name + ".cdx").read_at(length, offset)).decode().split("\n")


def captures_of(at: str, whole_url: bool, ranges: list[dict]):
    """``(file, offset, length)`` of the captures with this key, by bisection of ranges, directory and block.

    With ``whole_url`` the key is a URL key and a blank, and all its pages count.
    """
    r = max(0, bisect_left([x["first"] for x in ranges], at) - 1)
    for entry in ranges[r:]:
        firsts, blocks = directory(entry["name"])
        for _, offset, length in blocks[max(0, bisect_left(firsts, at) - 1) :]:
            lines = block_lines(entry["name"], offset, length)
            for line in lines[bisect_left(lines, at) :]:
                found, file, place, size = line.split("\t")
                if not (found.startswith(at) if whole_url else found == at):
                    if found > at:
                        return
                    continue
                yield file, int(place), int(size)


def lookup(keys: DataFrame, ranges: list[dict], whole_url: bool = False) -> DataFrame:
    """Read the captures of ``keys`` (``url, page_id``; with ``whole_url`` all pages of each url) from the archives.

    Keys are deduplicated, sorted and dealt by range, so neighbouring keys share directory and block. Returns the
    parsed records; keys without a capture give no row.
    """

    def keyed(batches):
        for b in batches:
            rows = zip(b["url"].to_pylist(), b["page_id"].to_pylist(), strict=True)
            yield pa.RecordBatch.from_pydict({"at": [sort_key(u, None if whole_url else p) for u, p in rows]})

    def read(batches):
        for b in slices(batches):
            rows = [
                parsed(gzip.decompress(reader(file).read_at(length, offset)))
                for at in b["at"].to_pylist() for file, offset, length in captures_of(at, whole_url, ranges)
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    ats = keys.select("url", "page_id").mapInArrow(keyed, "at string").distinct()
    return ats.repartitionByRange(width(keys.sparkSession), "at").sortWithinPartitions("at").mapInArrow(read, RECORDS)


def archive_and_read_back(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives, index them, and read every capture back by its key.

    Returns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``. Of pages with
    equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest page_id keeps the payload.

    Defined cases: null html is an empty payload; a null or hostless url is indexed under its own text; pages
    without a page_id can only be revisits (responses where no page of the group has an id); equal page_ids give one
    record each, all responses if they hold the kept page; an empty table gives no rows; other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    folder = shared_uri(pages.sparkSession, "warc")
    ranges = build_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    return lookup(pages, ranges)
