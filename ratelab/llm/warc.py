"""WARC archives in Zstandard: one frame per record, a shared dictionary in a leading skippable frame.

The writer makes response records, and revisit records for payloads that another page has too. The reader
loads the dictionary, decodes frame by frame, and checks headers, lengths and digests; what is wrong with a
record is told in its row, never raised.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab.llm.frames import file_system, read_files, settle

# Fixed values of the formats.
ZSTD_MAGIC, DICTIONARY_MAGIC, SKIPPABLE = b"\x28\xb5\x2f\xfd", 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

ARCHIVE_BYTES = 8 << 20
DICTIONARY_ROWS, DICTIONARY_PAGE_BYTES, DICTIONARY_BYTES = 1000, 64 << 10, 64 << 10
RECORD_BYTES = 1 << 30


def record_id(page_id: int | None, digest: str) -> str:
    """A URN for a page: a version 8 UUID of its id and 58 bits of the payload digest, or 4 without an id."""
    tail = int(digest[:16], 16)
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=int(digest[:32], 16), version=4)}>"
    value = page_id & 0xFFFFFFFFFFFFFFFF
    number = (value >> 16) << 80 | 8 << 76 | ((value >> 4) & 0xFFF) << 64 | 2 << 62 | (value & 0xF) << 58 | tail >> 6
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(record: str | None) -> int | None:
    """The page id in a URN of record_id; None for any other."""
    found = re.fullmatch(r"<urn:uuid:([0-9a-f-]{36})>", record or "")
    number = uuid.UUID(found[1]).int if found else 0
    if number >> 76 & 0xF != 8:
        return None
    value = (number >> 80) << 16 | (number >> 64 & 0xFFF) << 4 | number >> 58 & 0xF
    return value - (1 << 64) if value >> 63 else value


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, date: str = DATE) -> bytes:
    """The record of a page; digest is the payload's SHA-1 in hexadecimal, response_id the page it repeats."""
    revisit = response_id is not None and response_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Target-URI": quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{base32(digest)}",
        "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(response_id, digest)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, id_col: str, html_col: str, rows: int = DICTIONARY_ROWS,
                     page_bytes: int = DICTIONARY_PAGE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from at most `rows` pages of at most `page_bytes`, those with the smallest hash of the id; b"" if they are too few.

    It only helps compression; every page is archived whole.
    """
    html = F.col(f"`{html_col}`").cast("string")
    few = pages.select(F.xxhash64(F.col(f"`{id_col}`")).alias("place"), html.alias("html")).where((F.octet_length("html") > 0) & (F.octet_length("html") <= page_bytes))
    last = few.select("place").distinct().orderBy("place").limit(rows).agg(F.max("place")).first()[0]
    chosen = few.where(F.col("place") <= last).groupBy("place").agg(F.min("html").alias("html"))  # one page per hash
    samples = [r.html.encode() for r in chosen.orderBy("place").collect()] if last is not None else []
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    """An archive: the compressed dictionary in a skippable frame, then a frame per record."""
    parts = []
    if dictionary:
        packed = zstandard.ZstdCompressor(level).compress(dictionary)
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level, dict_data=data, write_checksum=True, write_content_size=True)
    return b"".join(parts + [compressor.compress(r) for r in records])


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page to archives in folder; returns the manifest (name, n_records, n_bytes).

    Of pages with equal payloads the one with the largest id is the response and the others revisit it; rows
    that share the largest id are responses alike, rows without an id revisit it too, and where no page of the
    group has an id all are responses. Null html is an empty payload. A task attempt writes files of its own
    names, and only the manifest tells which files count. An empty table gives no archive.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", "response_id")
    dictionary = train_dictionary(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        part, held, size = TaskContext.get().partitionId(), [], 0

        def put() -> pa.RecordBatch:
            name, data = f"{part:06d}-{uuid.uuid4().hex}.warc.zst", archive(held, dictionary)
            with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": [len(held)], "n_bytes": [len(data)]})

        for batch in batches:
            for values in zip(*batch.columns):
                held.append(record(*(v.as_py() for v in values)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return settle(joined.mapInArrow(run, "name string, n_records long, n_bytes long"))


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(offset, end, magic) of each frame; ends early, with magic -1, where the chain of frames breaks."""
    at = 0
    while at < len(data):
        try:
            magic = struct.unpack_from("<I", data, at)[0]
            if magic in SKIPPABLE:
                end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            elif data[at:at + 4] == ZSTD_MAGIC:
                end = _frame_end(data, at)
            else:
                raise ValueError("no frame")
            if end > len(data):
                raise ValueError("cut off")
        except (ValueError, struct.error, IndexError, zstandard.ZstdError):
            yield at, len(data), -1
            return
        yield at, end, magic
        at = end


def _frame_end(data: bytes, at: int) -> int:
    """Past the blocks of a frame (three-byte headers: last flag, kind, size) and its check sum."""
    end = at + zstandard.frame_header_size(data[at:at + 18])
    last = False
    while not last:
        head = int.from_bytes(data[end:end + 3], "little")
        if end + 3 > len(data):
            raise ValueError("cut off")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("no block")
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * (data[at + 4] >> 2 & 1)


def parse(raw: bytes) -> dict:
    """The fields of one record; `problem` says what is wrong with it, or is None."""
    out: dict = {"record_type": None, "record_id": None, "refers_to": None, "target_uri": None, "payload_bytes": None,
                 "payload_digest": None, "payload": None, "problem": None}
    head, split, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not split or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return out | {"problem": "no WARC header"}
    pairs = [line.partition(":") for line in lines[1:]]
    headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
    out |= {"record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"),
            "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri")}
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if not headers.get(n)]
    if missing or not all(colon for _, colon, _ in pairs) or len(headers) != len(pairs):
        return out | {"problem": f"bad headers: {', '.join(missing) or 'malformed or repeated'}"}
    length = headers["content-length"]
    if not re.fullmatch(r"\d{1,18}", length) or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"problem": "the block is not as long as Content-Length says"}
    block = rest[:-4]
    digest = lambda data: f"sha1:{base32(hashlib.sha1(data).hexdigest())}"
    if headers.get("warc-block-digest", digest(block)) != digest(block):
        return out | {"problem": "the block digest differs"}
    http, split, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", http)
    if not split or not http.startswith(b"HTTP/") or not size:
        return out | {"problem": "no HTTP header"}
    told, size = headers.get("warc-payload-digest"), int(size[1])
    out |= {"payload_bytes": size, "payload_digest": told.partition(":")[2] if told else None}
    if headers["warc-type"] == "revisit":
        if payload or not told or headers.get("warc-profile") != REVISIT_PROFILE or not out["refers_to"]:
            return out | {"problem": "no complete revisit"}
        return out
    if len(payload) != size:
        return out | {"problem": "the payload is not as long as its header says"}
    if told is not None and told != digest(payload):
        return out | {"problem": "the payload digest differs"}
    return out | {"payload": payload, "payload_digest": digest(payload).partition(":")[2]}


def records(data: bytes) -> Iterator[dict]:
    """Every record of an archive with its offset."""
    loaded, first = None, True
    for at, end, magic in frames(data):
        if magic in SKIPPABLE:
            if first and magic == DICTIONARY_MAGIC:
                content = data[at + 8:end]
                if content[:4] == ZSTD_MAGIC:
                    content = zstandard.ZstdDecompressor().decompress(content, max_output_size=RECORD_BYTES)
                loaded = zstandard.ZstdCompressionDict(content)
            first = False
            continue
        first = False
        if magic == -1:
            yield parse(b"") | {"problem": "the frame is damaged or cut off", "offset": at}
            continue
        try:
            size = zstandard.frame_content_size(data[at:at + 18])
            if size > RECORD_BYTES:
                raise zstandard.ZstdError("too large")
            raw = zstandard.ZstdDecompressor(dict_data=loaded).decompress(data[at:end], max_output_size=RECORD_BYTES if size < 0 else 0)
        except zstandard.ZstdError as error:
            yield parse(b"") | {"problem": f"the frame cannot be decoded: {error}", "offset": at}
            continue
        yield parse(raw) | {"offset": at}


RECORD = ("name string, offset long, record_type string, record_id string, refers_to string, target_uri string, "
          "payload_bytes long, payload_digest string, payload binary, page_id long, refers_to_page long, problem string")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record (or damaged place) of the archives that the manifest names, in columns RECORD.

    payload is null for revisits; payload_bytes and payload_digest are those of the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for found in records(content.as_py()):
                    rows.append(found | {"name": name.as_py(), "page_id": page_of(found["record_id"]), "refers_to_page": page_of(found["refers_to"])})
                    size += len(found["payload"] or b"") + 500
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in RECORD.split(", "))])
    return read_files(manifest.select("name"), folder).select("name", "content").mapInArrow(run, RECORD)
