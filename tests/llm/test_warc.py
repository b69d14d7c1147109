import base64
import hashlib
import io
import zipfile

import pytest

from nimbusops.llm import warc, zips

ROWS = [(1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "ü", "é" * 100_000), (0, "z", "<p>one</p>"),
        (None, "n", "<p>one</p>"), (6, "q", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "r", "<p>two</p>"), (7, "r", "<p>two</p>"), (8, "s", "<p>two</p>")]


def expected(rows, least):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == body and i is not None]
        first = min(same) if same and page_id is not None and len(body) >= least else page_id
        out.append((str(page_id) if page_id is not None else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if first == page_id else "revisit", None if first == page_id else str(first)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, archive_bytes", [(0, warc.ARCHIVE_BYTES), (5, 200), (10**6, 1)])
def test_round_trip(spark, least, archive_bytes):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, sha1 string").coalesce(2)
    rows = warc.round_trip(pages, least, archive_bytes).collect()
    got = sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == expected(ROWS, least)
    kept = {r.record_id: bytes(r.payload) for r in rows if r.record_type == "response" and r.record_id}
    assert kept["5"] == ("é" * 100_000).encode() and kept["6"] == ROWS[7][2].encode()
    assert warc.round_trip(pages.where("false")).count() == 0


def listed(body):
    source = io.BytesIO(body)
    members = zips.directory(source, len(body))
    return {m.name: zips.read_at(source, zips.body_at(source, m), m.size) for m in members}


def test_zip_layouts():
    members = [("a/one.bin", b"123"), ("é.txt", b""), ("big", bytes(range(256)) * 300)]
    out = io.BytesIO()
    zips.write(out, members)
    assert listed(out.getvalue()) == dict(members)
    with zipfile.ZipFile(out) as z:  # the standard library agrees
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == dict(members)
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        for name, body in members:
            z.writestr(name, body)
        z.comment = b"a comment with PK\x05\x06 inside"
    assert listed(plain.getvalue()) == dict(members)
    wide = io.BytesIO()
    with zipfile.ZipFile(wide, "w", zipfile.ZIP_STORED) as z, z.open("m", "w", force_zip64=True) as f:
        f.write(b"abc")
    assert listed(wide.getvalue()) == {"m": b"abc"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d", b"x" * 100)
    with pytest.raises(ValueError, match="not stored"):
        listed(packed.getvalue())
    with pytest.raises(ValueError):
        listed(b"not an archive")


def test_a_broken_payload_is_noticed():
    raw = warc.record(1, "u", b"payload", None)
    assert warc.parse(raw)["payload"] == b"payload"
    assert warc.parse(warc.record(2, "u", b"payload", 1))["payload"] == b""
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
