"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, table
from kindred.session import cut, scratch_path

MIN_BYTES = 1000
BLOCK_LINES = 1000
DATE = "1970-01-01T00:00:00Z"
_CRLF = b"\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "sort_key string, file string, at long, length long"


def open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and plain path of a shared folder named by a URI or a path."""
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def reversed_host(url: str | None) -> str:
    """Sort key of a URL: host parts from the top domain down, then path and query.

    Scheme, user, default port and fragment go; a null URL has the key ``)``.
    What can't be parsed is kept as it is, behind ``)``.
    """
    if not url:
        return ")"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")" + url
    name = ",".join(reversed(host.split("."))) if host else ""
    at = f":{port}" if port and port not in (80, 443) else ""
    return f"{name}{at}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def sort_key(url: str | None, page_id: int | None) -> str:
    """Key of one capture: the URL's key, then the page's number in fixed width (a null number first)."""
    # White space would end the key early in an index line.
    key = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in reversed_host(url))
    return f"{key} " + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or, with ``refers_to``, a revisit with the HTTP headers alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = _CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
                       b"Content-Length: %d" % len(payload), b"", b""])
    body = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "" if c >= " ")
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + body + _CRLF * 2


def parse(data: bytes) -> dict:
    """Type, page, referred page, URL, payload (None in a revisit), its length and digest of one record."""
    head, _, rest = data.partition(_CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[:int(fields["Content-Length"])].partition(_CRLF * 2)
    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])

    def page(uri: str | None):
        number = uri.removeprefix("<urn:page:").removesuffix(">") if uri else ""
        return int(number) if number else None

    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    return {"record_type": kind, "page_id": page(fields["WARC-Record-ID"]), "refers_to": page(fields.get("WARC-Refers-To")),
            "url": fields.get("WARC-Target-URI", ""), "payload": payload if kind == "response" else None,
            "payload_bytes": int(sent["Content-Length"]), "payload_digest": digest}


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html, refers_to``: the page each page's record refers to, null for responses.

    Of equal payloads of ``min_bytes`` or more the largest page_id is the response.
    Equality is that of SHA-1 and length, grouped with map-side combine; only
    digests that occur twice are joined back.
    """
    html = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
                         F.octet_length(html).alias("bytes"))
    again = cut(known.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").select("digest", "first_page"), "again")
    refers = F.when((F.col("bytes") >= min_bytes) & (F.coalesce(F.col("page_id") != F.col("first_page"),
                                                               F.col("first_page").isNotNull())), F.col("first_page"))
    return known.join(again, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(plan: DataFrame, folder: str, date: str = DATE, level: int = 3) -> DataFrame:
    """Write one archive of gzip members per task; returns the written table of ``CAPTURES``.

    A file's name is its own for each attempt, and only files named in the
    returned table count, so a lost or repeated task leaves at most an unused file.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        store.create_dir(f"{base}/archive", recursive=True)
        name = f"archive/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], date),
                                           level, mtime=0)
                    out.write(member)
                    rows.append((sort_key(row["url"], row["page_id"]), name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["sort_key", "file", "at", "length"]),
                                                 pa.schema([("sort_key", pa.string()), ("file", pa.string()),
                                                            ("at", pa.int64()), ("length", pa.int64())]), preserve_index=False)
        finally:
            if out is not None:
                out.close()

    return cut(plan.mapInArrow(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Write the sorted index; returns (first key, file) of each part in order: at most one per shuffle partition.

    Captures are range-partitioned by key (which holds the page, so one URL may
    span parts). A part is a file of gzip blocks of ``block_lines`` sorted lines
    and a directory beside it with the first key, place and length of each block.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        store.create_dir(f"{base}/index", recursive=True)
        name = f"index/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        directory, lines, at, out = [], [], 0, None

        def flush() -> None:
            nonlocal at, lines
            block = gzip.compress("".join(lines).encode(), 6, mtime=0)
            out.write(block)
            directory.append([lines[0].rsplit(" ", 3)[0], at, len(block)])
            at, lines = at + len(block), []

        for batch in batches:
            for key, file, place, length in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                lines.append(f"{key} {file} {place} {length}\n")
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{base}/{name}.dir", compression=None) as side:
            side.write("".join(json.dumps(d) + "\n" for d in directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first_key", "part"])

    ordered = captures.select("sort_key", "file", "at", "length").repartitionByRange("sort_key", "file", "at")
    parts = cut(ordered.sortWithinPartitions("sort_key", "file", "at").mapInArrow(write, "first_key string, part string"), "parts")
    return sorted((r["first_key"], r["part"]) for r in parts.collect())


class Index:
    """Reader of one folder's index inside a task; keeps the last block and one directory in memory."""

    def __init__(self, folder: str):
        self.store, self.base = open_folder(folder)
        self.part, self.block = None, (None, None)

    def _open(self, part: str) -> None:
        with self.store.open_input_file(f"{self.base}/{part}.dir") as f:
            self.directory = [json.loads(x) for x in f.read().decode().splitlines()]
        self.firsts = [d[0] for d in self.directory]
        self.part, self.block = part, (None, None)

    def _lines(self, number: int) -> list[str]:
        if self.block[0] != number:
            _, at, length = self.directory[number]
            with self.store.open_input_file(f"{self.base}/{self.part}.cdx.gz") as f:
                data = f.read_at(length, at)
            # Not splitlines(): a key may hold U+0085, U+2028 or U+2029.
            self.block = (number, gzip.decompress(data).decode().removesuffix("\n").split("\n"))
        return self.block[1]

    def find(self, part: str, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, at, length) of the captures with this key, by binary search in the directory, then in the blocks."""
        if part != self.part:
            self._open(part)
        number = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        prefix = key + " "
        while number < len(self.directory) and self.firsts[number] <= key:
            lines = self._lines(number)
            i = bisect.bisect_left(lines, key, key=lambda x: x.rsplit(" ", 3)[0])
            while i < len(lines) and lines[i].startswith(prefix):
                file, at, length = lines[i].rsplit(" ", 3)[1:]
                yield file, int(at), int(length)
                i += 1
            if i < len(lines):
                return
            number += 1


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_captures(keys: DataFrame, folder: str, parts: list[tuple[str, str]], with_payload: bool = False) -> DataFrame:
    """Records of the captures named in ``keys`` (sort_key), one row each; keys without a capture give none.

    The first keys of the parts (one per shuffle partition) go to every task.
    Keys go to the part they may lie in, sorted; a task opens a part's directory
    once, binary-searches it and a block, and reads only the bytes of the record.
    Payload digests and lengths of responses are taken from the bytes read.
    """
    firsts = [k for k, _ in parts]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder)
        handle, opened = None, None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
                           + [("payload", pa.binary())] * with_payload)
        for batch in batches:
            found = []
            for key in batch.column("sort_key").to_pylist():
                # A key that begins parts may lie at the end of the part before as well.
                low = max(bisect.bisect_left(firsts, key) - 1, 0)
                for i in range(low, max(bisect.bisect_right(firsts, key), low + 1)):
                    found.extend(index.find(parts[i][1], key) if i < len(parts) else [])
            rows = []
            for file, at, length in sorted(found):
                if file != opened:
                    if handle:
                        handle.close()
                    handle, opened = index.store.open_input_file(f"{index.base}/{file}"), file
                got = parse(zlib.decompress(handle.read_at(length, at), 31))
                if got["payload"] is not None:
                    got["payload_bytes"], got["payload_digest"] = len(got["payload"]), hashlib.sha1(got["payload"]).hexdigest()
                rows.append(got)
            yield from pa.Table.from_pylist(rows, schema).to_batches()
        if handle:
            handle.close()

    # As many parts as there are shuffle partitions: the keys are small, the records behind them aren't.
    width = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.select("sort_key").distinct().repartitionByRange(width, "sort_key").sortWithinPartitions("sort_key")
    return dealt.mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def page_keys(pages: DataFrame) -> DataFrame:
    """``sort_key`` of every row's capture."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(map(sort_key, batch.column("url").to_pylist(),
                                                        batch.column("page_id").to_pylist()), pa.string())], ["sort_key"])

    return map_batches(pages.select("url", "page_id"), work, "sort_key string")


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, date: str = DATE,
            block_lines: int = BLOCK_LINES) -> tuple[str, list[tuple[str, str]]]:
    """Write archives and index of ``pages`` (page_id, url, html) below ``folder``; returns folder and index parts.

    The folder is in the shared work folder unless given. Null html is an empty
    payload, a null URL has the key ``)``, a null page_id an empty record number.
    Repeated rows get a record each. Equal payloads of which no row has a page_id
    are all responses. Other columns are not read. An empty table has no files.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    captures = write_archives(planned(pages, min_bytes), folder, date)
    return folder, write_index(captures, folder, block_lines)


def op6_warc(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    where, parts = archive(pages)
    return read_captures(page_keys(pages), where, parts).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as payload_digest from p),
w as (select payload_digest, max(page_id) as first_page from d where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id is distinct from first_page then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from first_page then first_page end as refers_to
from d left join w using (payload_digest)
"""
