import base64
import gzip
import hashlib

import pytest

from echosieve.llm import warc

PAGES = "page_id long, url string, html string, digest string, original long"


def brute(rows):
    groups = {}
    for i, _, h, *_ in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h, *_ in rows:
        ids = [x for x in groups[h or ""] if x is not None]
        top = max(ids) if ids else None
        revisit = top is not None and i != top
        data = (h or "").encode()
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i % 3}?q=é ü", ["<p>é</p>", "", None, "x" * 300_000, f"only {i}"][i % 5], "d", 1) for i in range(60)]
    rows += [(7, "u", "same id", "d", 1), (7, "u", "same id", "d", 1), (None, None, "lone", "d", 1), (None, None, "<p>é</p>", "d", 1), (99, None, "a\r\n\r\nWARC/1.1\r\n\r\n", "d", 1)]
    df = spark.createDataFrame(rows, PAGES)
    got = sorted((tuple(r) for r in warc.archived(df).collect()), key=str)
    assert got == brute(rows)
    index = warc.write_archives(df, f"file://{tmp_path}/out", archive_bytes=2000)
    assert index.count() > 4
    texts = {(r.page_id, r.payload) for r in warc.read_archives(index).collect() if r.record_type == "response"}
    want = {(i, h or "") for (i, _, h, *_), b in zip(rows, [None] * len(rows), strict=True)}
    assert texts <= want and len({t for _, t in texts}) == len({t for _, t in want})


def test_least_bytes_and_no_pages(spark):
    df = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcd", "", 0), (4, "u", "abcd", "", 0)], PAGES)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived(df, least_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_seen():
    data = warc.record(1, "http://h", b"abc", warc.payload_digest(b"abc"), None, False)
    assert warc.parse(data)["payload"] == "abc"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abc\r\n", b"abd\r\n"))


def members(path):
    """Records of an archive by a reader of its own: gzip members, header lines, blocks of the stated length."""
    data = gzip.decompress(path.read_bytes())
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        assert version == b"WARC/1.1"
        fields = dict(x.decode().split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        block, data = rest[:n], rest[n:]
        assert data.startswith(b"\r\n\r\n")
        data = data[4:]
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        out.append((fields, block))
    return out


def test_archives_are_as_the_standard_has_them(spark, tmp_path):
    rows = [(i, f"http://h/{i}", ["<p>é</p>", "", f"only {i}"][i % 3], "d", 1) for i in range(30)] + [(40, None, None, "d", 1)]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/out", archive_bytes=3000, date="2024-02-03T04:05:06Z")
    found = [members(p) for p in tmp_path.glob("out/*.warc.gz")]
    assert len(found) == index.count()
    by_id = {}
    for archive in found:
        assert archive[0][0]["WARC-Type"] == "warcinfo" and archive[0][0]["Content-Type"] == "application/warc-fields"
        for fields, block in archive[1:]:
            assert fields["Content-Type"] == "application/http; msgtype=response" and fields["WARC-Date"] == "2024-02-03T04:05:06Z"
            by_id[fields["WARC-Record-ID"]] = fields, block
    assert len(by_id) == len(rows)
    for fields, block in by_id.values():
        message, _, body = block.partition(b"\r\n\r\n")
        status, *lines = message.split(b"\r\n")
        assert status == b"HTTP/1.1 200 OK"
        length = int(dict(x.split(b": ", 1) for x in lines)[b"Content-Length"])
        if fields["WARC-Type"] == "revisit":
            original, first = by_id[fields["WARC-Refers-To"]]
            assert body == b"" and original["WARC-Type"] == "response" and fields["WARC-Refers-To-Date"] == original["WARC-Date"]
            assert fields.get("WARC-Refers-To-Target-URI") == original.get("WARC-Target-URI")
            body = first.partition(b"\r\n\r\n")[2]
        assert len(body) == length and fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
