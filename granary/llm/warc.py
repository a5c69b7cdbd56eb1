"""WARC archives with a Zstandard dictionary.

Each archive begins with a skippable frame that holds the dictionary; every record is a frame of
its own. Equal payloads are stored once: the page with the smallest id is the response, the others
are revisits of it. Only digests and ids are compared to find them; a page's text moves once, by
its id, so a payload with many copies gathers nowhere.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import lowest, stored, work_path

#: Fixed values of the formats: the dictionary frame's magic, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES = 64 << 10
#: Records that teach the dictionary, at most, and bytes taken of each.
SAMPLE_ROWS, SAMPLE_BYTES = 1_500, 16 << 10
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "granary:page").int >> 80


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page id, so that references need no index."""
    number = 0 if page_id is None else page_id & (2**64 - 1)
    high = (_SPACE << 16) | 0x8000 | (4 if page_id is None else number >> 62)
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | (2 << 62) | (number & (2**62 - 1)))}>"


def page_of(record: str) -> int | None:
    """The page id that a record id holds."""
    whole = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if (whole >> 64) & 4:
        return None
    number = (((whole >> 64) & 3) << 62) | (whole & (2**62 - 1))
    return number - 2**64 if number >> 63 else number


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the reply's head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    target = re.sub(r"[\s<>]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    return _record(headers, http.encode() + (b"" if revisit else payload))


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; few or tiny samples serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class _Archive:
    """One archive under a name of its own until it is whole, so a lost task leaves no half file."""

    def __init__(self, system: fs.FileSystem, path: str, dictionary: bytes, attempt: int):
        self.system, self.path, self.open_path = system, path, f"{path}.{attempt}.open"
        self.out = system.open_output_stream(self.open_path, compression=None)
        frame = zstandard.ZstdCompressor().compress(dictionary)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=given)
        self.records, self.size = 0, 0
        info = b"format: WARC File Format 1.1\r\n"
        self.add(_record([
            ("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"),
        ], info))
        self.records = 0

    def add(self, record: bytes) -> None:
        frame = self.coder.compress(record)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)  # of an earlier attempt at the same rows
        self.system.move(self.open_path, self.path)
        return self.path, self.records, self.size


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row into ``folder``; returns ``(path, records, bytes)`` per archive.

    ``folder`` is a path or URI of a file system that the tasks reach. Payloads of fewer than
    ``least_bytes`` are always responses. Null texts are empty, null addresses "about:blank". A
    null id counts as larger than any, and is a response where no equal payload has an id. Rows
    that repeat the smallest id of a payload are all responses. An empty table writes no archive.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    small = stored(rows.select("id", "digest", F.octet_length("payload").alias("size")), "pages")
    firsts = small.where(f"size >= {least_bytes} and id is not null")
    firsts = stored(firsts.groupBy("digest").agg(F.min("id").alias("first")), "firsts")
    again = small.join(firsts, "digest").where(f"not (id <=> first) and size >= {least_bytes}")
    again = stored(again.select(F.col("id").alias("of"), F.col("digest").alias("equal"), "first").distinct(), "revisits")
    full = rows.join(again, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("equal")), "left")

    # pages to learn from are chosen by their digests; only their payloads' beginnings travel
    chosen = lowest(small, F.xxhash64("digest", "id"), ["id"], SAMPLE_ROWS, small.count())
    chosen = chosen.select(F.col("id").alias("of"), F.col("digest").alias("equal")).distinct()
    cut = F.substring(F.col("payload").cast("binary"), 1, SAMPLE_BYTES).alias("payload")
    taught = rows.join(
        F.broadcast(chosen), F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("equal")), "left_semi"
    )
    taught = taught.groupBy("digest", "id").agg(F.min(F.struct("url", cut)).alias("page")).orderBy("digest", "id")
    samples = [page_record(r["id"], r["page"]["url"], bytes(r["page"]["payload"]), None, False) for r in taught.collect()]
    dictionary = build_dictionary(samples)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        archive, done = None, []
        for batch in batches:
            for page_id, address, text, first in zip(*(batch.column(k) for k in range(4))):
                if archive is None:
                    name = f"{root}/pages-{task.partitionId():05d}-{len(done):03d}.warc.zst"
                    archive = _Archive(system, name, dictionary, task.taskAttemptId())
                raw = (text.as_py() or "").encode()
                archive.add(page_record(page_id.as_py(), address.as_py(), raw, first.as_py(), first.is_valid))
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        kinds = (pa.string(), pa.int64(), pa.int64())
        columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["path", "records", "bytes"])

    made = full.select("id", "url", "payload", "first").mapInArrow(write, "path string, records long, bytes long")
    return stored(made, "archives")


def archived_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive, a record at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("The archive does not begin with a dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(source.read(size))
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    reader = zstandard.ZstdDecompressor(dict_data=given).stream_reader(source, read_across_frames=True)
    text = io.BufferedReader(reader, 1 << 16)
    while text.readline():
        headers = {}
        while (line := text.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = text.read(int(headers["Content-Length"]))
        text.read(4)
        yield headers, block


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])``.

    A response's payload is digested again and must match its header; a revisit's size and digest
    are those that its headers state for the full payload. Archives are read as streams.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(path, compression=None) as source:
                    for headers, block in archived_records(source):
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = headers["WARC-Type"] == "revisit"
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        if not revisit and (payload_digest(body), len(body)) != (digest, size):
                            raise ValueError(f"{path}: a payload differs from its headers")
                        refers = page_of(headers["WARC-Refers-To"]) if revisit else None
                        rows.append((
                            page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest,
                            headers["WARC-Type"], refers, *([body] if payloads and not revisit else [None] * payloads),
                        ))
                        held += len(body) * payloads + 200
                        if held > 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        *([("payload", pa.binary())] if payloads else []),
    ]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds]
        )

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    each = archives.select("path").repartition(max(1, archives.count()), "path")
    return each.mapInArrow(read, schema + (", payload binary" if payloads else ""))


def new_folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    return work_path(spark, "warc")
