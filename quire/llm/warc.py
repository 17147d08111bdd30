"""WARC archives: pages as records in gzip members of their own, and a sequential reader that verifies them."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column, dropped, read, shared_path, shipped, staged

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes read from an archive, and inflated from a member, at once.
READ_BYTES, INFLATE_BYTES = 1 << 20, 1 << 20
#: Bytes of payloads in one batch of rows, and of headers before a blank line at most.
BATCH_BYTES, HEADER_BYTES = 8 << 20, 1 << 20
#: Heads of repeated payloads travel to the tasks if they take no more than this; beyond it the join shuffles.
BROADCAST_BYTES, KEY_BYTES = 32 << 20, 96
DATE = "2024-01-01T00:00:00Z"
#: The two revisions read, the revisit profile, base32's letters.
VERSIONS = ("WARC/1.1", "WARC/1.0")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "path string, number long, offset long, record_type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, payload binary, error string"


def digest(sha1_hex: Column) -> Column:
    """The bare upper-case base32 form of a SHA-1 in hexadecimal: four times 40 bits, eight letters each."""
    fields = [F.lpad(F.conv(F.substring(sha1_hex, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*fields), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def encoded(kind: str, record_id: str, uri: str, date: str, payload: bytes, sha1: str, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit's block is the response's head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", uri)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows as they will be written, the table behind them): id, row, url, payload, sha1, again (whether a row is a revisit), response and head (id and row of the one that it refers to).

    Payloads are equal if their SHA-1, length and another hash are. Rows are written once with
    their digests and a number, so the largest id's row is the same one wherever it is asked
    for; only digests are grouped, with partial aggregation, and only heads of repeated
    payloads are joined back.
    """
    text = F.coalesce(column(pages, payload_col, "string"), F.lit("")).cast("binary")
    rows = pages.select(column(pages, id_col, "long").alias("id"), F.coalesce(column(pages, url_col, "string"), F.lit("")).alias("url"), text.alias("payload"))
    rows = rows.withColumns({"sha1": digest(F.sha1("payload")), "other": F.xxhash64("payload"), "bytes": F.octet_length("payload").cast("long"), "row": F.monotonically_increasing_id()})
    held = staged(rows, "pages")
    first = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "row")).alias("h")
    heads = staged(held.filter(F.col("bytes") >= least).groupBy("sha1", "other", "bytes").agg(first, F.count("*").alias("c")).filter("c > 1").select("sha1", "other", "bytes", F.col("h.id").alias("response"), F.col("h.row").alias("head")), "heads")
    small = F.broadcast(heads) if heads.count() * KEY_BYTES <= BROADCAST_BYTES else heads
    again = F.col("head").isNotNull() & (F.col("head") != F.col("row"))
    return held.join(small, ["sha1", "other", "bytes"], "left").select("id", "row", "url", "payload", "sha1", again.alias("again"), "response", "head"), held


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row to .warc.gz archives in a folder that all executors reach; returns path, records and bytes.

    Of rows whose payloads are equal and of at least `least` bytes, that of the largest id is a
    `response` (of repeats of that id one), the others are `revisit` records of it; all other
    rows are responses. A null payload is empty, a null url too, a null id is written as such and
    is smaller than any other. Other columns are not written. Tasks stream their rows to archives
    of about archive_bytes, named anew by each attempt; only those in the returned table count,
    so a lost or repeated task leaves no wrong record. An empty table gives no archive.
    """
    spark = shipped(pages.sparkSession)
    rows, held = marked(pages, id_col, url_col, payload_col, least)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, path, n, size = None, [], "", 0, 0
        for b in batches:
            for id_, row, url, payload, sha1, again, response, head in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    files, top = opened(folder)
                    files.create_dir(top, recursive=True)
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    path, n, size = f"{folder}/{file}", 0, 0
                    out = files.open_output_stream(f"{top}/{file}", compression=None)
                name = lambda i, r: f"urn:page:{'none' if i is None else i}:{r}"
                kind, refers_to = ("revisit", name(response, head)) if again else ("response", None)
                member = encoded(kind, name(id_, row), url, date, payload, sha1, refers_to)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            p, r, s = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(r, pa.int64()), pa.array(s, pa.int64())], ["path", "records", "bytes"])

    archives = staged(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")
    dropped(held)
    return archives


class Broken(ValueError):
    """What is wrong with a record; `lost` if the reader can't find the next one."""

    def __init__(self, what: str, lost: bool):
        super().__init__(what)
        self.lost = lost


class Members:
    """The gzip members of a stream, one after another, inflated piece by piece."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest, self.at = stream, b"", 0  # at: bytes of finished members
        self.z, self.used, self.ready = None, 0, b""

    def begin(self) -> bool:
        """Turns to the next member; false at the end."""
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
        self.z, self.used, self.ready = zlib.decompressobj(31), 0, b""
        return bool(self.rest)

    def more(self) -> bytes:
        """Up to INFLATE_BYTES of the member's content; empty at its end."""
        while not self.z.eof:
            if not self.rest:
                self.rest = self.stream.read(READ_BYTES)
                if not self.rest:
                    raise Broken("the archive ends within a record", True)
            try:
                got = self.z.decompress(self.rest, INFLATE_BYTES)
            except zlib.error as e:
                raise Broken(f"gzip: {e}", True) from None
            left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.used, self.rest = self.used + len(self.rest) - len(left), left
            if got:
                return got
        return b""

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes of the member, in pieces."""
        while n:
            piece = self.ready or self.more()
            if not piece:
                raise Broken("shorter than its Content-Length", False)
            self.ready, piece = piece[n:], piece[:n]
            n -= len(piece)
            yield piece

    def head(self) -> bytes:
        """All up to the next blank line, which is passed over."""
        got = self.ready
        while (end := got.find(b"\r\n\r\n")) < 0:
            piece = self.more() if len(got) < HEADER_BYTES else b""
            if not piece:
                raise Broken("no end of the header", False)
            got += piece
        self.ready = got[end + 4 :]
        return got[:end]

    def finish(self) -> int:
        """Passes over what is left of the member; its length."""
        self.ready = b""
        while self.more():
            pass
        self.at += self.used
        return self.used


def fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields (names in lower case; continued lines joined) of a header."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    pairs = (x.partition(":") for x in lines[1:])
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in pairs}


def _length(value: str | None) -> int:
    if value is None or not re.fullmatch(r"[0-9]+", value):
        raise Broken("no Content-Length", False)
    return int(value)


def record(m: Members, payload: bool) -> dict:
    """The record that the member holds: its block is framed by Content-Length, read in pieces and held against its digests.

    Digests are checked if they are SHA-1 (the archives' own kind); others are passed on.
    """
    first, f = fields(m.head())
    if first not in VERSIONS:
        raise Broken(f"not a WARC record: {first[:20]!r}", False)
    size, kind = _length(f.get("content-length")), f.get("warc-type")
    http = f.get("content-type", "").startswith("application/http")
    whole, body, kept, head, seen = hashlib.sha1(), hashlib.sha1(), [], b"", None if http else 0
    for piece in m.take(size):
        whole.update(piece)
        if seen is None:  # still in the http head
            head += piece
            if (end := head.find(b"\r\n\r\n")) < 0:
                if len(head) > HEADER_BYTES:
                    raise Broken("no end of the http header", False)
                continue
            piece, head, seen = head[end + 4 :], head[:end], 0
        body.update(piece)
        seen += len(piece)
        if payload and kind != "revisit":
            kept.append(piece)
    if b"".join(m.take(4)) != b"\r\n\r\n" or m.ready or m.more():
        raise Broken("longer than its Content-Length", False)
    said = f.get("warc-payload-digest", "").rpartition(":")
    for name, own in (("warc-block-digest", whole), *([("warc-payload-digest", body)] if kind != "revisit" else [])):
        algorithm, _, value = f.get(name, "").rpartition(":")
        if algorithm.lower() == "sha1" and value.upper() != base64.b32encode(own.digest()).decode():
            raise Broken(f"{name[5:]} doesn't fit", False)
    n = _length(fields(head)[1].get("content-length")) if kind == "revisit" and http else seen or 0
    if kind == "response" and http and (says := fields(head)[1].get("content-length")) is not None and says != str(n):
        raise Broken("payload and its http Content-Length differ", False)
    name = lambda k: f[k].strip("<>") if k in f else None
    return {"record_type": kind, "record_id": name("warc-record-id"), "refers_to": name("warc-refers-to"), "target_uri": f.get("warc-target-uri"), "date": f.get("warc-date"), "payload_digest": said[2] or base64.b32encode(body.digest()).decode(), "payload_bytes": n, "payload": b"".join(kept) if payload and kind != "revisit" else None, "error": None}


def records(stream: BinaryIO, payload: bool = True) -> Iterator[dict]:
    """The records of one archive in order, each with its number and place; a broken one has only those and `error`.

    After a broken record that ends where its member does, reading goes on with the next; after a
    broken or cut member nothing more of the archive can be trusted, and it ends.
    """
    m, number = Members(stream), 0
    while m.begin():
        at = {"number": number, "offset": m.at}
        try:
            row = record(m, payload)
        except Broken as e:
            row = {"error": str(e)}
            if e.lost:
                yield at | row
                return
        try:
            m.finish()
        except Broken as e:
            yield at | {"error": str(e)}
            return
        yield at | row
        number += 1


def read_warc(spark: SparkSession, archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record of the archives (a table with `path`): RECORD.

    Archives are dealt one to a task and read from front to back, a megabyte at a time; nothing
    but a record's payload, if asked for, is held whole. Broken records are rows with `error`
    and nulls; see records. An archive that can't be opened is one such row. Null paths are left out.
    """
    shipped(spark)
    schema = pa.schema([("path", pa.string()), ("number", pa.int64()), ("offset", pa.int64()), *[(c, pa.string()) for c in ("record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest")], ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    files, inner = opened(path)
                    stream = files.open_input_stream(inner, compression=None)
                except (OSError, ValueError) as e:
                    rows.append({"path": path, "error": str(e)[:200]})
                    continue
                with stream:
                    for r in records(stream, payload):
                        rows.append({"path": path} | r)
                        held += len(r.get("payload") or b"") + 200
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    paths = archives.filter("path is not null").select("path")
    return paths.repartition(max(1, min(paths.count(), 100_000))).mapInArrow(scan, RECORD)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `pages` written to archives in the shared folder and read back; a record that doesn't verify fails the query.

    See write_warc for odd rows.
    """
    archives = write_warc(read(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    found = read_warc(spark, archives, payload=False)
    sound = lambda c: F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error")).cast("string")).otherwise(F.col(c))
    number = lambda c: F.when(F.split_part(c, F.lit(":"), F.lit(3)) != "none", F.split_part(c, F.lit(":"), F.lit(3))).cast("long")
    return found.select(number(sound("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select *, strlen(html) as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as head, row_number() over (partition by html order by page_id desc nulls last) as r from p),
b as (select *, list_transform([0, 1, 2, 3], lambda f: ('0x' || substr(hex, 10 * f + 1, 10))::bigint) as fields from h)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', ((fields[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::bigint + 1, 1)), '') as payload_digest,
  case when r = 1 then 'response' else 'revisit' end as record_type, case when r > 1 then head end as refers_to from b
"""
