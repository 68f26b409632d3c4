"""Bytes of chosen files: hashed and decoded once, by tasks of equal bytes; and what local reading can tell of a file."""

from __future__ import annotations

import codecs
import hashlib
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import dispatch, segments, vision_readable
from quarry.operators.catalog import restore_plan
from quarry.operators.staged import running_sum

CHUNK = 1 << 20  # bytes of a file in memory, but for its text
TASK_BYTES = 128 << 20
OPENING = 64 << 10  # bytes that a file counts for at least


def opened(root: str, path: str, seekable: bool = False):
    """A binary stream of a file below a root: a local folder or an address that pyarrow's file systems know."""
    where = f"{root.rstrip('/')}/{path}"
    kind = urlparse(where).scheme
    if kind in ("", "file"):
        return open(urlparse(where).path if kind else where, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(where)
    return system.open_input_file(inner) if seekable else system.open_input_stream(inner)


def _scan(root: str):
    def one(path: str, wanted: bool):
        digest, n, text, bad = hashlib.sha256(), 0, [], False
        decoder = codecs.getincrementaldecoder("utf-8")("strict")
        loose = codecs.getincrementaldecoder("utf-8")("replace")
        try:
            with opened(root, path) as f:
                while block := f.read(CHUNK):
                    digest.update(block)
                    n += len(block)
                    if wanted:
                        text.append(loose.decode(block))
                        bad = bad or _fails(decoder, block)
        except OSError as e:
            return None, None, None, None, f"unreadable: {type(e).__name__}"
        if wanted:
            text.append(loose.decode(b"", True))
            bad = bad or _fails(decoder, b"", True)
        return n, digest.hexdigest(), "".join(text) if wanted else None, bad if wanted else None, "read"

    def run(batches):
        for rows in batches:
            for path, wanted in zip(rows["path"], rows["wants_text"]):  # a text at a time
                yield pd.DataFrame([(path, *one(path, bool(wanted)))], columns=["path", "n_bytes", "sha256", "text", "bad_bytes", "state"])

    return run


def _fails(decoder, block: bytes, final: bool = False) -> bool:
    try:
        decoder.decode(block, final)
    except UnicodeDecodeError:
        return True
    return False


def scanned(chosen: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, n_bytes, sha256, text, bad_bytes and state of ``chosen`` (path below ``root``, size, wants_text).

    Each file is read once, in blocks; its text is kept where it is wanted, with
    U+FFFD for bytes that are no UTF-8, which ``bad_bytes`` tells.  A file that
    can't be opened or read has nulls and the state ``unreadable: ...``, and ends no task.
    Files are dealt in order of their names into tasks of ``task_bytes``, so
    neither many small nor a few large files make a task long; one file is the least.
    """
    weighed = chosen.select("path", "wants_text", F.greatest("size", F.lit(OPENING)).cast("long").alias("weight"))
    placed = running_sum(weighed, [], ["path"], "weight", "to")
    total = placed.agg(F.coalesce(F.max("to"), F.lit(0))).first()[0]
    n = max(1, -(-total // task_bytes))
    dealt = placed.withColumn("task", F.floor((F.col("to") - F.col("weight")) / task_bytes)).repartitionByRange(int(n), "task")
    return dealt.select("path", "wants_text").mapInPandas(_scan(root), "path string, n_bytes bigint, sha256 string, text string, bad_bytes boolean, state string")


def extraction(path: Column, text: Column) -> Column:
    """Struct of media_type, text, needs_reader, hint and reason of a file, from its name and, for a text file, its text."""
    name = F.try_element_at(segments(path), F.lit(-1))
    kind = dispatch(name)["media_type"]
    empty = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}]+", "")) == ""
    seen = vision_readable(F.regexp_extract(name, "(\\.[^.]*)$", 1))
    reason = (
        F.when(kind == "text", F.when(empty, "empty").otherwise("text_extracted"))
        .when(kind == "pdf", "pdf_needs_reader")
        .when(kind == "image", F.when(seen, "image_needs_vision").otherwise("image_not_vision_readable"))
        .when(kind.isin("audio", "video"), "av_needs_reader")
        .otherwise("unsupported_local_extraction")
    )
    hint = F.when(kind == "pdf", "ocr").when((kind == "image") & seen, "vision").when(kind.isin("audio", "video"), "av")
    kept = F.when(kind == "text", F.when(empty, "").otherwise(text))
    return F.struct(kind.alias("media_type"), kept.alias("text"), hint.isNotNull().alias("needs_reader"), hint.alias("hint"), reason.alias("reason"))


def restore_from(mirror: DataFrame, library: DataFrame, mirror_root: str, library_root: str, meta: str = "_meta") -> DataFrame:
    """path and state of a restore, by the bytes of both trees (path, size): hidden files of the mirror count, those of the library don't, nor does the mirror's own folder."""
    ready = lambda files: files.withColumn("wants_text", F.lit(False))
    left = scanned(ready(mirror.filter(segments(F.col("path"))[0] != meta)), mirror_root).select("path", F.coalesce("sha256", F.lit("unreadable source")).alias("sha256"))
    # of the library only files that the mirror has need their bytes
    right = library.join(left.select("path"), "path", "left_semi")
    right = scanned(ready(right), library_root).select("path", F.coalesce("sha256", F.lit("unreadable target")).alias("sha256"))
    others = library.filter(~F.try_element_at(segments(F.col("path")), F.lit(-1)).startswith(".")).join(left.select("path"), "path", "left_anti").select("path", F.lit("").alias("sha256"))
    return restore_plan(left, right.unionByName(others))
