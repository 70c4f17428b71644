"""WARC archives: one gzip member per record, written by Spark's committed file writer, read in sequence.

plan_records: payload digests (SHA-1, base32) and which records are revisits. Of records with equal
payloads of at least `revisit_from` bytes, those with the smallest page_id are responses and the
others revisits of it; smaller payloads are always responses. The smallest id per payload is
aggregated (map side first) and written as a table, so that the join back is a plain shuffle join
whose hot payloads adaptive execution splits.

write_archives: each record becomes one gzip member and one row of a text table. The line separator
of that table is itself an empty gzip member, so every file is a plain multi-member .warc.gz that any
WARC reader opens, and the files go through Spark's commit protocol to any store that Spark writes.

read_archives: files come as binaryFile rows; each is inflated in steps of 64 KB, member by member
with one zlib object each; headers end at the empty line, Content-Length frames the block, and the
block and payload digests are computed and compared. A revisit's block holds the response's HTTP
header, whose Content-Length is the full payload's size.

Defined cases: null html is the empty payload; a null url leaves the target out; null page ids are
never smallest, and are revisits only where a record with an id holds the payload; a repeated page
id at the smallest place gives several responses; an empty table gives an empty archive folder; a
record that breaks a rule raises WarcError, with the file's name. A payload of any length is one record, held
by one task; an archive file is read whole by one task, so one of over 2 GB is refused; columns beside page_id, url
and html are never read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, text_of, written

STEP = 1 << 16
#: An empty gzip member (RFC 1952), between records.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


def plan_records(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(page_id, url, html) -> page_id, url, payload, sha1 (hex), refers_to (null: a response)."""
    payload = F.encode(text_of("html"), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    heads = rows.filter(F.length("payload") >= revisit_from).groupBy("sha1").agg(F.min("page_id").alias("head"), F.count("*").alias("n"))
    heads = written(heads.filter("n > 1 and head is not null").select(F.col("sha1").alias("head_sha1"), "head"), "warc-heads")
    joined = rows.join(heads, rows["sha1"] == heads["head_sha1"], "left")
    other = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select("page_id", "url", "payload", "sha1", F.when(other, F.col("head")).alias("refers_to"))


def _block_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "WARC-Block-Digest: " + _block_digest(block),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b[c] for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True)
        out = [gzip_member(build_record(*(x.as_py() for x in row))) for row in rows]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(records: DataFrame, folder: str) -> None:
    """One folder of multi-member gzip files; a file is as large as its task's share of the rows."""
    members = records.mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")
    ).text(folder)


def iter_members(data: memoryview) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member in turn; a member is read to its end before the next."""
    at = 0
    while at < len(data):
        inflate = zlib.decompressobj(31)

        def pieces(inflate=inflate) -> Iterator[bytes]:
            nonlocal at
            while not inflate.eof:
                if at >= len(data):
                    raise WarcError("cut gzip member")
                step = bytes(data[at : at + STEP])
                out = inflate.decompress(step, STEP)
                while not inflate.eof and inflate.unconsumed_tail:
                    yield out
                    out = inflate.decompress(inflate.unconsumed_tail, STEP)
                at += len(step) - len(inflate.unused_data)
                if out:
                    yield out

        got = pieces()
        yield got
        for _ in got:
            pass


def parse_record(pieces: Iterator[bytes]) -> dict | None:
    """One record from its inflated pieces; None for an empty member."""
    head = bytearray()
    for piece in pieces:
        head += piece
        if (end := head.find(b"\r\n\r\n")) >= 0:
            break
    else:
        if head:
            raise WarcError("a record without end of header")
        return None
    version, *lines = bytes(head[:end]).decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise WarcError(f"unknown version {version[:20]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    body = bytearray(head[end + 4 :])
    for piece in pieces:
        body += piece
    if len(body) != size + 4 or bytes(body[size:]) != b"\r\n\r\n":
        raise WarcError("content length and record end differ")
    block = bytes(body[:size])
    if fields.get("warc-block-digest", _block_digest(block)) != _block_digest(block):
        raise WarcError("block digest differs")
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("a block without end of HTTP header")
    http_fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    if fields["warc-type"] == "response":
        if _block_digest(payload) != fields["warc-payload-digest"] or len(payload) != int(http_fields["content-length"]):
            raise WarcError("payload digest or length differs")
    return {"fields": fields, "payload": payload, "payload_bytes": int(http_fields["content-length"])}


def _id(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "null") else None


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
)


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _SCHEMA if with_payload else pa.schema(list(_SCHEMA)[:-1])
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows, held = [], 0
                for member in iter_members(memoryview(content.as_buffer())):
                    try:
                        record = parse_record(member)
                    except (WarcError, KeyError, zlib.error) as e:
                        raise WarcError(f"{path.as_py()}: {e!r}") from e
                    if record is None:
                        continue
                    f = record["fields"]
                    row = {
                        "page_id": _id(f["warc-record-id"]),
                        "payload_bytes": record["payload_bytes"],
                        "payload_digest": f["warc-payload-digest"].removeprefix("sha1:"),
                        "record_type": f["warc-type"],
                        "refers_to": _id(f.get("warc-refers-to")),
                        "url": f.get("warc-target-uri"),
                    }
                    if with_payload:
                        row["payload"] = record["payload"]
                        held += len(record["payload"])
                    rows.append(row)
                    if len(rows) >= 5000 or held > 32 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives in folder, digests verified."""
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_read(with_payload), kinds + (", payload binary" if with_payload else ""))


def archive_pages(spark: SparkSession, pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archives(plan_records(pages, revisit_from), folder)
    return read_archives(spark, folder)


