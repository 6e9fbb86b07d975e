"""WARC writer with dictionary compression (.warc.zst).

Each partition writes its records to files of its own.  A file's Zstandard
dictionary is trained on all the records that the file holds, and stored in a
skippable frame (magic 0x184D2A5D) at its start; every record then is one frame
compressed with it, so a reader fetches a single record by offset after reading
the leading frame.  Nothing passes through the driver: files appear next to one
another in the target folder, and the returned index says where each record is.

A file has the number of its partition and of the task attempt in its name.  A
repeated or speculative attempt writes other files, and the index lists only
those of the attempt that succeeded.

Results for odd input:
* control signs and blanks in a url are percent-encoded in the record, so that no url
  adds header lines; the index has the url as it was;
* fewer than 16 records, or records too uniform to train on, have no trained
  dictionary: the leading frame then holds their first ``DICTIONARY`` bytes as a plain
  content dictionary, which readers treat alike; every record is written as well;
* the pages have no fetch time, so all records are dated ``DATE``;
* null html is written as an empty body, null url as an empty target;
* records with a null id are written, their id in the index is null;
* repeated rows are written as often as they occur, in input order; ties don't
  occur; a very long page is one record, at most its file grows beyond
  ``FILE_BYTES``;
* an empty table writes no file and gives an empty index; other columns are never
  read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, uri

MAGIC = 0x184D2A5D
FILE_BYTES = 48 << 20
DICTIONARY = 64 << 10
LEVEL = 9
DATE = "2024-01-01T00:00:00Z"
_INDEX = "file string, offset bigint, length bigint, record_length bigint, payload_digest string"


def record(url: str, body: bytes, date: str = DATE) -> bytes:
    """One response record; its id is derived from target and body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    url = re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{x:02X}" for x in m.group().encode()), url)
    name = uuid.uuid5(uuid.NAMESPACE_URL, url + hashlib.sha1(body).hexdigest())
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    )
    return head.encode() + http + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on all records; plain content where there is too little to train on."""
    import zstandard

    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(size, records, k=1024, d=8).as_bytes()
        except zstandard.ZstdError:  # too small or too uniform to train on
            pass
    return b"".join(records)[:size]


def archive(records: list[bytes], level: int = LEVEL) -> tuple[bytes, list[bytes]]:
    """The leading frame and a frame for each record."""
    import zstandard

    content = build_dictionary(records)
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=level)
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
    return struct.pack("<II", MAGIC, len(content)) + content, [c.compress(r) for r in records]


def read_dictionary(data: bytes) -> bytes:
    """The dictionary of a file, from its first bytes on."""
    magic, n = struct.unpack("<II", data[:8])
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    return data[8 : 8 + n]


def read_record(data: bytes, offset: int, length: int) -> bytes:
    """One record of a file."""
    import zstandard

    d = zstandard.ZstdCompressionDict(read_dictionary(data))
    return zstandard.ZstdDecompressor(dict_data=d).decompress(data[offset : offset + length])


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Lazily writes ``pages`` into ``folder``, a URI that every executor reaches; (page_id, url, file, offset, length, record_length, payload_digest)."""
    d = pick(pages, page_id=id_col, url=url_col, html=body_col)
    target = uri(folder)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(target)
        held: list[tuple] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            head, frames = archive([r for *_, r in held])
            at, rows = len(head), []
            for (i, u, sha, r), f in zip(held, frames):
                rows.append((i, u, name, at, len(f), len(r), sha))
                at += len(f)
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/{name}.part") as out:
                out.write(head)
                for f in frames:
                    out.write(f)
            system.move(f"{root}/{name}.part", f"{root}/{name}")
            cols = list(zip(*rows))
            types = [kind, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "url", "file", "offset", "length", "record_length", "payload_digest"])

        kind = pa.int64()
        for b in it:
            kind = b.schema.field(0).type
            for i, u, h in zip(*(c.to_pylist() for c in b.columns)):
                body = (h or "").encode()
                r = record(u or "", body)
                held.append((i, u, hashlib.sha1(body).hexdigest(), r))
                size += len(r)
                if size >= file_bytes:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return d.mapInArrow(run, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, {_INDEX}")
