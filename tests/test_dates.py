"""Dates inside made files of every kind, whole, broken and cut at every place."""

import io
import random
import struct
import zipfile

import pytest

from quarry.sources.dates import EDGE, Ranges, date_in, embedded_dates


def archive(member, xml, padding=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if padding:
            z.writestr("big.bin", random.Random(0).randbytes(padding), zipfile.ZIP_STORED)
        z.writestr(member, xml)
    return out.getvalue()


CORE = '<a xmlns:d="http://purl.org/dc/terms/"><d:created>{}</d:created></a>'
META = '<o xmlns:m="urn:oasis:names:tc:opendocument:xmlns:meta:1.0"><m:creation-date>{}</m:creation-date></o>'


def jpeg(order, original, plain=None):
    texts = [(0x0132, plain)] if plain else []
    n = len(texts) + 1
    at = 8 + 2 + 12 * n + 4
    first = struct.pack(order + "H", n)
    data = b""
    for tag, t in texts:
        first += struct.pack(order + "HHII", tag, 2, 20, at + len(data))
        data += t.encode() + b"\0"
    sub = at + len(data)
    first += struct.pack(order + "HHII", 0x8769, 4, 1, sub) + struct.pack(order + "I", 0)
    data += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 36867, 2, 20, sub + 18) + struct.pack(order + "I", 0) + (original.encode() + b"\0" if original else b" " * 20)
    tiff = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8) + first + data
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda" + b"x" * 100


def box(name, body, long=False):
    return struct.pack(">I4sQ", 1, name, len(body) + 16) + body if long else struct.pack(">I4s", len(body) + 8, name) + body


SECONDS = 3_849_080_400  # 2025-12-20T13:00:00Z since 1904
MOVIE = lambda version, where, long=False: (box(b"ftyp", b"isom") + (box(b"mdat", b"m" * 500_000, long) if where == "end" else b"") + box(b"moov", box(b"free", b"") + box(b"mvhd", bytes([version, 0, 0, 0]) + struct.pack(">Q" if version else ">I", SECONDS) + b"\0" * 90)))
GOOD = [
    ("ooxml", archive("docProps/core.xml", CORE.format("2024-05-06T07:08:09Z")), "2024-05-06T07:08:09"),
    ("ooxml", archive("docProps/core.xml", CORE.format("2024-05-06T07:08:09+02:00"), 1_000_000), "2024-05-06T05:08:09"),
    ("odf", archive("meta.xml", META.format(" 2023-01-02T03:04:05.678 ")), "2023-01-02T03:04:05"),
    ("pdf", b"%PDF-1.4\n" + b"x" * 300_000 + b"/Info << /CreationDate (D:20260312093000+01'00') >>\n%%EOF", "2026-03-12T08:30:00"),
    ("pdf", b"%PDF-1.4\n<< /CreationDate(D:2020) >>" + b"x" * 300_000, "2020-01-01T00:00:00"),
    ("exif", jpeg("<", "2019:08:07 06:05:04"), "2019-08-07T06:05:04"),
    ("exif", jpeg(">", None, "2018:08:07 06:05:04"), "2018-08-07T06:05:04"),
    ("container", MOVIE(0, "start"), "2025-12-20T13:00:00"),
    ("container", MOVIE(1, "end"), "2025-12-20T13:00:00"),
    ("container", MOVIE(0, "end", True), "2025-12-20T13:00:00"),
]
NONE = [("ooxml", archive("other.xml", "x")), ("ooxml", archive("docProps/core.xml", CORE.format("soon"))), ("ooxml", archive("docProps/core.xml", "<a")), ("pdf", b"%PDF /CreationDate (D:20261399)"), ("pdf", b""), ("exif", b"\xff\xd8\xff"), ("exif", b"GIF89a"), ("container", box(b"ftyp", b"x")), ("container", struct.pack(">I4s", 3, b"moov"))]


def found(kind, data):
    ranges = Ranges(io.BytesIO(data))
    date = date_in(ranges, kind)
    return date and date.strftime("%Y-%m-%dT%H:%M:%S"), ranges.bytes_read


@pytest.mark.parametrize("kind,data,want", GOOD)
def test_dates(kind, data, want):
    got, n = found(kind, data)
    assert got == want and n <= min(len(data), 3 * EDGE)
    rng = random.Random(1)
    for _ in range(40):  # cut off or spoilt anywhere: a date or none, never an error
        found(kind, data[: rng.randrange(len(data))])
        at = rng.randrange(len(data))
        found(kind, data[:at] + rng.randbytes(3) + data[at + 3 :])


@pytest.mark.parametrize("kind,data", NONE)
def test_no_date(kind, data):
    assert found(kind, data)[0] is None


def test_files(spark, tmp_path):
    names = {"a.docx": GOOD[1], "b.ODT": GOOD[2], "c.pdf": GOOD[3], "d.jpg": GOOD[5], "e.mp4": GOOD[8]}
    for name, (_, data, _) in names.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(x,) for x in [*names, "gone.pdf", "note.txt"]], "path string")
    got = {r.path: r for r in embedded_dates(paths, str(tmp_path)).collect()}
    assert set(got) == {*names, "gone.pdf"} and got["gone.pdf"].embedded is None
    for name, (kind, data, want) in names.items():
        assert (got[name].source, got[name].embedded) == (kind, want + "Z") and 0 < got[name].bytes_read <= 3 * EDGE
