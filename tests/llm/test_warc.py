import hashlib
import zlib

import pytest

from corpusmill.llm import warc

SCHEMA = "page_id BIGINT, url STRING, html STRING, digest STRING, file STRING"


def convert(spark, path, rows):
    files = warc.write_arc(spark.createDataFrame(rows, SCHEMA), f"{path}/arc")
    out = warc.convert(files, f"{path}/arc", f"{path}/warc")
    return files, out, warc.read_warc(out, f"{path}/warc").collect()


def test_pages_come_back_with_revisits(spark, path):
    big, other = "é<p>" * 400 + "\r\n\r\nWARC/1.1\r\n", "x" * 1_000
    rows = [(1, "http://a/ b", big), (5, None, big), (3, "http://c\r\n/", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", "")]
    rows += [(None, "u", big), (8, "v", other), (8, "v", other), (9, "w", "y" * 999), (10, "w", "y" * 999), (11, "l", "long " * 500_000)]
    _, _, got = convert(spark, path, [(*r, "d", "f") for r in rows])
    expected = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = html == big and page_id != 5
        expected.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    expected.remove(next(e for e in expected if e[0] == 8))
    expected.append((8, 1_000, hashlib.sha1(other.encode()).hexdigest(), "revisit", 8))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(expected, key=key)
    assert {r.date for r in got} == {"2024-01-01T00:00:00Z"}


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_by_version(path, version):
    archive = warc.Archive(path, "a.arc.gz")
    archive.add(warc.arc_start("a.arc.gz", version), 0)
    fields = {"URL": "http://a/ b c", "IP-address": "1.2.3.4", "Archive-date": "19970102", "Content-type": "text/plain"}
    archive.add(warc.arc_line(version, fields, 5) + b"h\nllo\n")
    archive.add(warc.arc_line(version, fields | {"URL": "u"}, 0) + b"\n")
    archive.publish()
    one, two = warc.arc_file(path, "a.arc.gz")
    assert (one.url, one.date, one.payload, one.page_id) == ("http://a/ b c", "19970102", b"h\nllo", None)
    assert (two.url, two.payload) == ("u", b"")
    record = warc.warc_record("a", one, None)
    assert b"WARC-Type: resource" in record and b"WARC-Date: 1997-01-02T00:00:00Z" in record


def test_damage_is_found(spark, path):
    _, out, _ = convert(spark, path, [(1, "u", "z" * 50, "d", "f")])
    name = out.first().file
    filesystem, root = warc.open_folder(f"{path}/warc")
    with filesystem.open_input_stream(f"{root}/{name}", compression=None) as source:
        raw, plain = source.read(), b""
    while raw:
        member = zlib.decompressobj(31)
        plain += member.decompress(raw)
        raw = member.unused_data
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    with filesystem.open_output_stream(f"{root}/{name}", compression=None) as sink:
        sink.write(packer.compress(plain.replace(b"zzz", b"zyz", 1)) + packer.flush())
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(out, f"{path}/warc").collect()


def test_no_pages(spark, path):
    assert convert(spark, path, [])[2] == []
