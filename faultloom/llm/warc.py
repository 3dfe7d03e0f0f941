"""WARC archives of one Zstandard frame per record, with the dictionary in a leading skippable frame.

Writing: tasks stream their rows into archive files in the shared folder, each under a name of its own
attempt, and return a manifest; only files a manifest names are read, so a lost or repeated attempt
leaves nothing behind in the result. Reading: tasks open the manifest's files, take the dictionary from the
leading frame, decode one frame at a time and check headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import arrow_uri
from .shared import Scratch

#: Fixed values of the format: the dictionary's skippable frame, Zstandard's frame and dictionary marks.
SKIPPABLE = 0x184D2A5D.to_bytes(4, "little")
FRAME = 0xFD2FB528.to_bytes(4, "little")
TRAINED = 0xEC30A437.to_bytes(4, "little")
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads from this size on are deduplicated; an archive is closed beyond ARCHIVE_BYTES.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
#: Bounds of the sample and the size of the dictionary, which tasks receive.
DICTIONARY_ROWS = 400
DICTIONARY_TEXT = 16_384
DICTIONARY_BYTES = 32_768
DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that does not keep to the format."""


def record_bytes(record: dict) -> bytes:
    """One WARC record: its headers and a block that is an HTTP response, without a body for a revisit."""
    payload = record["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record["record_type"] == "revisit" else http + payload
    digest = base64.b32encode(bytes.fromhex(record["payload_digest"])).decode()
    headers = [
        ("WARC-Type", record["record_type"]),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, record['name'])}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(record["url"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-Id", "" if record["page_id"] is None else str(record["page_id"])),
    ]
    if record["record_type"] == "revisit":
        headers.append(("WARC-Profile", IDENTICAL))
        headers.append(("X-Refers-To-Page-Id", str(record["refers_to"])))
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    """Header values hold one line: controls and line ends become percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m.group()), url or "")


def parse_record(raw: bytes) -> dict:
    """Headers and block of one record; everything that is declared must agree with what is there."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise WarcError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.lower() in headers:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing or not headers["content-length"].isdigit():
        raise WarcError(f"missing or bad headers {sorted(missing)}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block's length is not the declared one")
    block = rest[:size]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != _sha1_32(block):
        raise WarcError("the block does not match its digest")
    return {"headers": headers, "block": block}


def _sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_of(record: dict) -> dict:
    """The page of a response or revisit record; a response's payload must match length and digest."""
    headers, block = record["headers"], record["block"]
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"unexpected record type {kind}")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", http)
    if not mark or not length:
        raise WarcError("no HTTP header in the block")
    if kind == "response" and (len(payload) != int(length[1]) or _sha1_32(payload) != headers["warc-payload-digest"]):
        raise WarcError("the payload does not match its length or digest")
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return {
        "page_id": int(page) if page else None,
        "url": headers.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(length[1]),
        "payload_digest": base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "record_type": kind,
        "refers_to": int(refers) if refers else None,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return SKIPPABLE + len(dictionary).to_bytes(4, "little") + dictionary


def read_dictionary(stream) -> bytes:
    """The dictionary of an archive's leading frame, itself perhaps compressed; the stream stands after it."""
    mark, size = stream.read(4), stream.read(4)
    if mark != SKIPPABLE or len(size) != 4:
        raise WarcError("no leading dictionary frame")
    held = stream.read(int.from_bytes(size, "little"))
    if len(held) != int.from_bytes(size, "little"):
        raise WarcError("the dictionary frame is cut short")
    if held[:4] == FRAME:
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    if held and held[:4] != TRAINED:
        raise WarcError("not a Zstandard dictionary")
    return held


def read_archive(stream, block: int = 1 << 20):
    """Records of an archive, one Zstandard frame at a time; memory holds one record and one block."""
    held = read_dictionary(stream)
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    pending = b""
    while True:
        if not pending:
            pending = stream.read(block)
            if not pending:
                return
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            if not pending:
                pending = stream.read(block)
                if not pending:
                    raise WarcError("the archive ends within a frame")
            try:
                parts.append(frame.decompress(pending))
            except zstandard.ZstdError as failure:
                raise WarcError(f"bad frame: {failure}") from failure
            pending = frame.unused_data if frame.eof else b""
        yield parse_record(b"".join(parts))


def train_dictionary(pages: DataFrame, html: str) -> bytes:
    """A dictionary from a bounded sample of pages; empty where the sample is too small to train on."""
    body = F.substring(F.coalesce(F.col(html), F.lit("")), 1, DICTIONARY_TEXT)
    rows = pages.select(body.alias("text")).where("length(text) > 0").limit(DICTIONARY_ROWS).collect()
    samples = [r.text.encode() for r in rows]
    if len(samples) < 16 or sum(map(len, samples)) < 10 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def write_archives(records: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``records`` (page_id, url, html, payload_digest, record_type, refers_to, name).

    Returns the manifest ``(path, records, bytes)``. Evaluating it writes; write the manifest once.
    """

    uri = arrow_uri(folder)

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
        out, path, count, size, made = None, "", 0, 0, []
        for batch in batches:
            cols = batch.schema.names
            for values in zip(*(batch.column(i) for i in range(batch.num_columns))):
                row = {c: v.as_py() for c, v in zip(cols, values)}
                row["payload"] = (row.pop("html") or "").encode()
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, count, size = store.open_output_stream(path), 0, 0
                    out.write(dictionary_frame(dictionary))
                frame = press.compress(record_bytes(row))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    made.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, count, size))
        paths, counts, sizes = zip(*made) if made else ((),) * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["path", "records", "bytes"],
        )

    wanted = ("page_id", "url", "html", "payload_digest", "record_type", "refers_to", "name")
    return records.select(*wanted).mapInArrow(run, "path string, records long, bytes long")


PAGE = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Pages of the archives a manifest names; an archive holding another number of records is an error."""
    names = [n for n in PAGE.names if payloads or n != "payload"]
    schema = pa.schema([PAGE.field(n) for n in names])

    uri = arrow_uri(folder)

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen, held, size = 0, [], 0
                with store.open_input_stream(path) as stream:
                    for record in read_archive(stream):
                        page = page_of(record)
                        held.append({n: page[n] for n in names})
                        seen, size = seen + 1, size + (len(page["payload"] or b"") if payloads else 0)
                        if len(held) >= 5000 or size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if seen != wanted:
                    raise WarcError(f"{path} holds {seen} records, not {wanted}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    ddl = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)
    return manifest.select("path", "records").mapInArrow(run, ddl)


def mark_revisits(pages: DataFrame, page: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Pages with digest, record type and the page that a revisit refers to.

    Of equal payloads of at least REVISIT_BYTES bytes, rows of the largest page id are responses (all of
    them, where the id repeats) and the others revisits; equality is that of SHA-256 and length. Null ids
    refer to the largest id there is, and are responses where there is none.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.col(html).alias("html"),
        F.monotonically_increasing_id().alias("at"),
        F.sha1(body).alias("payload_digest"),
        F.when(F.length(body) >= REVISIT_BYTES, F.sha2(body, 256)).alias("same"),
    )
    top = pages.select(
        F.col(page).cast("long").alias("page_id"),
        F.when(F.length(body) >= REVISIT_BYTES, F.sha2(body, 256)).alias("same"),
    )
    top = top.where("same is not null").groupBy("same").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    joined = rows.join(top.where("n > 1 and top is not null").drop("n"), "same", "left")
    revisit = F.coalesce(F.col("top") > F.coalesce("page_id", F.col("top") - 1), F.lit(False))
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("top")).alias("refers_to"),
        F.concat_ws(":", F.lit("page"), "page_id", "at").alias("name"),
    )


def archive_round_trip(pages: DataFrame, page: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back, without the payloads.

    Returns ``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per page, the first three
    of the full payload. Null html is an empty payload, a null url an empty target; null ids stay null.
    Repeated rows are records of their own. An empty table writes no archive. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path()
    dictionary = train_dictionary(pages, html)
    manifest = scratch.table(write_archives(mark_revisits(pages, page, html, url), folder, dictionary))
    files = manifest.repartition(F.col("path"))
    back = read_archives(files, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
