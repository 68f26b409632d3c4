"""Dates that files carry inside: range reads of the few bytes that hold them, nothing of the rest.

Office files are zip archives (their directory is at the end), PDF files name
their information at the end or the start, photographs begin with their EXIF
block, and film containers list their boxes.  Whatever is malformed, cut off or
absent gives null.
"""

from __future__ import annotations

import datetime
import io
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import dispatch, segments
from quarry.sources.contents import opened

EDGE = 64 << 10  # bytes of a range read
MEMBER = 4 << 20  # of a compressed member of an archive
#: By extension, how a file keeps its date; the members and elements of both office families.
BY_EXTENSION = {"pdf": "pdf", "docx": "ooxml", "xlsx": "ooxml", "pptx": "ooxml", "odt": "odf", "ods": "odf", "odp": "odf"}
MEMBERS = {
    "ooxml": ("docProps/core.xml", "{http://purl.org/dc/terms/}created"),
    "odf": ("meta.xml", "{urn:oasis:names:tc:opendocument:xmlns:meta:1.0}creation-date"),
}
EXIF_IFD, DATE_ORIGINAL, DATE_TIME = 0x8769, 36867, 306
BOX_EPOCH = datetime.datetime(1904, 1, 1, tzinfo=datetime.timezone.utc)
PDF_DATE = re.compile(rb"/CreationDate\s*\(D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:(Z)|([+-])(\d\d)'?(\d\d)?'?)?")


class Ranges(io.RawIOBase):
    """A seekable file that reads EDGE bytes at a time, keeps the ranges it has read and counts them."""

    def __init__(self, file):
        self.file, self.at, self.bytes_read, self.kept = file, 0, 0, {}
        self.size = file.seek(0, 2) if not hasattr(file, "size") else file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.size, self.at + n)
        out = []
        while self.at < end:
            block = self.at // EDGE
            if block not in self.kept:
                self.file.seek(block * EDGE)
                self.kept[block] = self.file.read(min(EDGE, self.size - block * EDGE))
                self.bytes_read += len(self.kept[block])
            part = self.kept[block][self.at - block * EDGE : end - block * EDGE]
            if not part:
                break
            out.append(part)
            self.at += len(part)
        return b"".join(out)


def _office(f: Ranges, kind: str) -> datetime.datetime | None:
    member, tag = MEMBERS[kind]
    with zipfile.ZipFile(f) as archive:
        info = archive.getinfo(member)
        if info.compress_size > MEMBER or info.file_size > 8 * MEMBER:
            return None
        node = ElementTree.fromstring(archive.read(info)).find(f".//{tag}")
    text = (node.text or "").strip() if node is not None else ""
    return _utc(datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))) if text else None


def _utc(t: datetime.datetime) -> datetime.datetime:
    return t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)


def _pdf(f: Ranges) -> datetime.datetime | None:
    f.seek(max(0, f.size - EDGE))
    found = PDF_DATE.findall(f.read(EDGE))
    if not found:  # the last update writes last, but many writers put it first
        f.seek(0)
        found = PDF_DATE.findall(f.read(EDGE))
    if not found:
        return None
    year, *rest, zulu, sign, hours, minutes = found[-1]
    month, day, hour, minute, second = (int(x) if x else d for x, d in zip(rest, (1, 1, 0, 0, 0)))
    shift = datetime.timedelta(hours=int(hours or 0), minutes=int(minutes or 0)) * (-1 if sign == b"-" else 1)
    return datetime.datetime(int(year), month, day, hour, minute, second, tzinfo=datetime.timezone(shift))


def _exif(f: Ranges) -> datetime.datetime | None:
    if f.read(2) != b"\xff\xd8":
        return None
    while True:
        mark, size = struct.unpack(">2sH", f.read(4))
        if mark[0] != 0xFF or mark[1] in (0xD9, 0xDA):
            return None
        if mark[1] == 0xE1 and (body := f.read(size - 2))[:6] == b"Exif\0\0":
            return _tiff_date(body[6:])
        if mark[1] != 0xE1:
            f.seek(size - 2, 1)


def _tiff_date(tiff: bytes) -> datetime.datetime | None:
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]

    def entries(at: int) -> dict[int, tuple[int, int, int]]:
        (n,) = struct.unpack_from(order + "H", tiff, at)
        out = {}
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * i)
            out[tag] = (kind, count, value)
        return out

    def text(of: dict, tag: int) -> str | None:
        kind, count, value = of.get(tag, (0, 0, 0))
        return tiff[value : value + count].split(b"\0")[0].decode("ascii").strip() if kind == 2 and count > 4 else None

    first = entries(struct.unpack_from(order + "I", tiff, 4)[0])
    raw = None
    if EXIF_IFD in first:
        try:
            raw = text(entries(first[EXIF_IFD][2]), DATE_ORIGINAL)
        except (struct.error, ValueError):
            raw = None
    raw = raw or text(first, DATE_TIME)
    return datetime.datetime.strptime(raw, "%Y:%m:%d %H:%M:%S").replace(tzinfo=datetime.timezone.utc) if raw else None


def _container(f: Ranges) -> datetime.datetime | None:
    at, end = 0, f.size
    while at + 8 <= end:
        f.seek(at)
        size, name = struct.unpack(">I4s", f.read(8))
        head = 8
        if size == 1:
            (size,) = struct.unpack(">Q", f.read(8))
            head = 16
        size = size or end - at
        if size < head:
            return None
        if name == b"moov":
            end, at = min(end, at + size), at + head
            continue
        if name == b"mvhd":
            version = f.read(4)[0]
            (seconds,) = struct.unpack(">Q", f.read(8)) if version == 1 else struct.unpack(">I", f.read(4))
            return BOX_EPOCH + datetime.timedelta(seconds=seconds) if seconds else None
        at += size
    return None


READERS = {"pdf": _pdf, "exif": _exif, "container": _container, "ooxml": lambda f: _office(f, "ooxml"), "odf": lambda f: _office(f, "odf")}


def date_in(f: Ranges, kind: str) -> datetime.datetime | None:
    """The date that a file of a kind carries, in UTC; null where it has none or is broken."""
    try:
        found = READERS[kind](f)
        return found and found.astimezone(datetime.timezone.utc)
    except (OSError, ValueError, KeyError, IndexError, OverflowError, struct.error, zipfile.BadZipFile, zlib.error, ElementTree.ParseError, RuntimeError, NotImplementedError, EOFError):
        return None


def embedded_dates(files: DataFrame, root: str) -> DataFrame:
    """path, source, embedded (UTC) and bytes_read of files (path below ``root``) of a kind that keeps a date.

    The extension tells the kind, else images are asked for EXIF and sound and
    film for their container.  Files are read in ranges of 64 kB, most in one or
    two; one that can't be opened has no date.
    """
    name = F.try_element_at(segments(F.col("path")), F.lit(-1))
    extension = F.lower(F.regexp_extract(name, "\\.([^.]*)$", 1))
    by = F.coalesce(*[F.when(extension == e, k) for e, k in BY_EXTENSION.items()])
    media = dispatch(name)["media_type"]
    source = F.coalesce(by, F.when(media == "image", "exif").when(media.isin("audio", "video"), "container"))

    def run(batches):
        for rows in batches:
            out = []
            for path, kind in zip(rows["path"], rows["source"]):
                found, n = None, 0
                try:
                    with opened(root, path, seekable=True) as f:
                        ranges = Ranges(f)
                        found = date_in(ranges, kind)
                        n = ranges.bytes_read
                except OSError:
                    pass
                out.append((path, kind, found.strftime("%Y-%m-%dT%H:%M:%SZ") if found else None, n))
            yield pd.DataFrame(out, columns=["path", "source", "embedded", "bytes_read"])

    asked = files.select("path", source.alias("source")).filter("source is not null")
    return asked.mapInPandas(run, "path string, source string, embedded string, bytes_read bigint")
