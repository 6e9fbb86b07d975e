import hashlib
import os
import struct
import zlib

import zstandard

from quarry.llm import warc
from quarry.llm.common import table


def local(folder):
    return folder.removeprefix("file://")


def test_round_trip_of_every_page(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    index = warc.write_warc(pages.repartition(3), f"file://{tmp_path}").collect()
    want = {r.page_id: (r.url, r.html) for r in pages.select("page_id", "url", "html").collect()}
    assert sorted(r.page_id for r in index) == sorted(want)
    files = {f: (tmp_path / f).read_bytes() for f in {r.file for r in index}}
    for r in index:
        raw = warc.read_record(files[r.file], r.offset, r.length)
        assert len(raw) == r.record_length
        head, http, body = raw.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n", 2)
        assert f"WARC-Target-URI: {want[r.page_id][0]}".encode() in head and head.startswith(b"WARC/1.1\r\n") and http.startswith(b"HTTP/1.1 200")
        assert body.decode() == want[r.page_id][1] and hashlib.sha1(body).hexdigest() == r.payload_digest
        length = int(head.split(b"\r\nContent-Length: ")[1])
        assert length == len(http) + 4 + len(body)


def test_file_is_a_dictionary_frame_and_a_frame_a_record(spark, sf, tmp_path):
    index = warc.write_warc(table(spark, sf, "pages").coalesce(1), str(tmp_path), file_bytes=400_000).collect()
    by_file = {}
    for r in index:
        by_file.setdefault(r.file, []).append(r)
    assert len(by_file) > 1 and sorted(by_file) == sorted(os.listdir(tmp_path))
    for f, rows in by_file.items():
        data = (tmp_path / f).read_bytes()
        magic, n = struct.unpack("<II", data[:8])
        assert magic == warc.MAGIC
        at = 8 + n
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and data[at : at + 4] == b"\x28\xb5\x2f\xfd"
            at += r.length
        assert at == len(data)


def test_dictionary_pays(spark, sf):
    records = [warc.record(r.url, r.html.encode()) for r in table(spark, sf, "pages").select("url", "html").collect()]
    _, frames = warc.archive(records)
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert sum(map(len, frames)) < 0.9 * sum(len(plain.compress(r)) for r in records) < sum(len(zlib.compress(r, 1)) for r in records)


def test_warc_odd(spark, tmp_path):
    rows = [(1, "http://a.example/", "<p>x</p>", 1), (1, "http://a.example/", "<p>x</p>", 1), (2, None, None, 2), (None, "http://b.example/é", "", 3), (3, "http://c.example/", "<b>long</b>" * 200_000, 4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, HTML int")
    index = warc.write_warc(pages.coalesce(1), f"file://{tmp_path}").collect()
    assert [r.page_id for r in index] == [1, 1, 2, None, 3]
    bodies = [warc.read_record((tmp_path / r.file).read_bytes(), r.offset, r.length).split(b"\r\n\r\n", 2)[2].removesuffix(b"\r\n\r\n").decode() for r in index]
    assert bodies == [(r[2] or "") for r in rows]
    assert warc.write_warc(pages.where("false"), f"file://{tmp_path}/none").count() == 0
    assert not (tmp_path / "none").exists()


def read_through(data):
    """A reader of its own: from the first byte to the last, without an index, by the streaming interface."""
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    n = int.from_bytes(data[4:8], "little")
    rest, out = data[8 + n :], []
    while rest:
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompressobj()
        raw = d.decompress(rest)
        assert d.eof
        rest = d.unused_data
        lines, _, block = raw.partition(b"\r\n\r\n")
        version, *fields = lines.decode().split("\r\n")
        head = dict(f.split(": ", 1) for f in fields)
        assert version == "WARC/1.1" and len(head) == len(fields) == 7 and block[int(head["Content-Length"]) :] == b"\r\n\r\n"
        out.append((head, block[: int(head["Content-Length"])].partition(b"\r\n\r\n")[2].decode()))
    return out


def test_another_reader_finds_the_same_records(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    warc.write_warc(pages, f"file://{tmp_path}", file_bytes=300_000).collect()
    got = sorted((head["WARC-Target-URI"], body) for f in tmp_path.iterdir() for head, body in read_through(f.read_bytes()))
    assert got == sorted((r.url, r.html) for r in pages.select("url", "html").collect())


def test_urls_add_no_header_lines_and_few_records_have_a_plain_dictionary(spark, tmp_path):
    rows = [(1, "http://a.example/x\r\nWARC-Type: forged\r\n\r\nbody", "<p>one</p>"), (2, "http://b.example/ \u2028\x85", "<p>two</p>")]
    index = warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), f"file://{tmp_path}").collect()
    assert [r.url for r in index] == [r[1] for r in rows]
    (f,) = tmp_path.iterdir()
    got = read_through(f.read_bytes())
    assert [head["WARC-Target-URI"] for head, _ in got] == ["http://a.example/x%0D%0AWARC-Type:%20forged%0D%0A%0D%0Abody", "http://b.example/%20%E2%80%A8%C2%85"]
    assert [b for _, b in got] == ["<p>one</p>", "<p>two</p>"] and {head["WARC-Type"] for head, _ in got} == {"response"}
    assert warc.read_dictionary(f.read_bytes()).startswith(b"WARC/1.1")
