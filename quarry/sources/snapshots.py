"""A catalogue snapshot of any size: one JSON document, read in byte ranges by many tasks.

Spark's text reader cuts the document at every ``}``, wherever the ranges lie,
so no cut parts a backslash from what it escapes.  A first pass tells of each
range what it does to the nesting, once for a start inside a string and once outside;
these are composed in order, and then each range knows where it starts.  A
second pass cuts out the records; the pieces of those that lie in several ranges
are put together.  The reader doesn't tell whether a file ends with the ``}`` that
it cuts at, so the last one of a range is held back, and the size of the file tells.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = re.compile(rb'"documents"\s*:\s*$')
_STATE = "file string, start bigint, quoted boolean, stack string, ended boolean"


def _structure(text: bytes, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places, steps, quoted after) of the brackets of a text outside strings; a step is 1 or -1."""
    raw = np.frombuffer(text, np.uint8)
    quote = np.flatnonzero(raw == 34)
    slash = raw == 92
    if len(quote) and slash.any():
        at = np.flatnonzero(slash)
        begins = np.r_[True, np.diff(at) > 1]
        size = np.diff(np.r_[np.flatnonzero(begins), len(at)])
        after = at[begins] + size
        quote = np.setdiff1d(quote, after[size % 2 == 1], assume_unique=True)
    up = (raw == 123) | (raw == 91)
    at = np.flatnonzero(up | (raw == 125) | (raw == 93))
    outside = (np.searchsorted(quote, at) + quoted) % 2 == 0
    at = at[outside]
    return at, np.where(up[at], 1, -1), bool((len(quote) + quoted) % 2)


def _kind(text: bytes, at: int) -> str:
    """What opens at a place: an object, an array, or D for the array of documents."""
    return "{" if text[at] == 123 else "D" if _KEY.search(text, max(0, at - 64), at) else "["


def _effect(text: bytes, quoted: bool) -> tuple[bool, int, str]:
    """(quoted after, levels that close, levels that open) of a text."""
    at, step, after = _structure(text, quoted)
    if not len(at):
        return after, 0, ""
    level = np.cumsum(step)
    closed = max(0, -int(level.min()))
    later = np.minimum.accumulate(level[::-1])[::-1]
    opened = np.flatnonzero((step == 1) & (level <= later) & (level > -closed))
    return after, closed, "".join(_kind(text, int(at[i])) for i in opened)


def _then(stack: str, closed: int, opened: str) -> tuple[int, str]:
    """(levels closed below the stack's, the stack after)."""
    return max(0, closed - len(stack)), stack[: max(0, len(stack) - closed)] + opened


def _ranges(batches):
    """(row, text) of each piece of a range in turn, some pieces at a time, without the last ``}`` of the range."""
    last = None
    for batch in batches:
        table = batch.to_pandas()
        change = (table["file"] != table["file"].shift()) | (table["start"] != table["start"].shift())
        for _, part in table.groupby(change.cumsum(), sort=False):
            first = part.iloc[0]
            key = (first["file"], first["start"])
            yield first, (("}" if key == last else "") + "}".join(part["value"])).encode()
            last = key


def _effects(batches):
    import pyarrow as pa

    now, told, size, n = None, None, 0, 0

    def row():
        return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "size": size, "n": n} | {f"{k}{q}": v for q in (0, 1) for k, v in zip(("quoted", "closed", "opened"), told[q])}])

    for first, text in _ranges(batches):
        key = (first["file"], int(first["start"]))
        if now is not None and key != now:
            yield row()
        if key != now:
            now, told, size, n = key, [(False, 0, ""), (True, 0, "")], int(first["size"]), 1
        n += len(text)
        for q in (0, 1):
            quoted, closed, stack = told[q]
            after, c, o = _effect(text, quoted)
            more, stack = _then(stack, c, o)
            told[q] = (after, closed + more, stack)
    if now is not None:
        yield row()


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    """The state before each range: whether in a string, the open levels, and whether it ends with ``}``."""
    rows = rows.sort_values(["file", "start"])
    rows["ended"] = rows["file"].duplicated(keep="last") | (rows.groupby("file")["n"].transform("sum") <= rows["size"])
    quoted, stack, out = False, "", []
    for r in rows.itertuples():
        out.append((r.file, r.start, quoted, stack, r.ended))
        q = int(quoted)
        quoted = bool((r.quoted0, r.quoted1)[q])
        stack = _then(stack, (r.closed0, r.closed1)[q], (r.opened0, r.opened1)[q])[1]
        if r.ended and not quoted:
            stack = stack[:-1]
    return pd.DataFrame(out, columns=["file", "start", "quoted", "stack", "ended"])


class _Cutter:
    """Cuts the records out of one range; ``inside`` tells whether one is open, of which ``held`` are the bytes in this range."""

    def __init__(self, quoted: bool, stack: str):
        self.quoted, self.stack = quoted, stack
        self.held: list[bytes] = []
        self.inside, self.own = stack[:2] == "{D" and len(stack) > 2, False

    def cut(self, text: bytes):
        at, step, after = _structure(text, self.quoted)
        depth = len(self.stack)
        level = depth + np.cumsum(step)
        low = np.flatnonzero(np.minimum(level, level - step) <= 2)
        top, begin = self.stack[:2], 0
        for i in low.tolist():
            place, now = int(at[i]), int(level[i])
            if step[i] == 1:
                if now <= 2:
                    top = top[: now - 1] + _kind(text, place)
                elif top == "{D":
                    self.inside, self.own, begin = True, True, place
            elif now == 2 and self.inside:
                self.held.append(text[begin : place + 1])
                yield "whole" if self.own else "tail", b"".join(self.held)
                self.held, self.inside = [], False
            elif now < 2:
                top = top[: max(now, 0)]
        if self.inside:
            self.held.append(text[begin:])
        _, closed, opened = _effect(text, self.quoted)
        self.stack, self.quoted = _then(self.stack, closed, opened)[1], after

    def rest(self):
        if self.inside and self.held:
            yield "head" if self.own else "middle", b"".join(self.held)


def _records(batches):
    import pyarrow as pa

    def rows(key, found):
        found = list(found)
        if found:
            yield pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "kind": k, "text": t.decode()} for k, t in found])

    now = cutter = None
    ended = False

    def done():
        if ended:
            yield from rows(now, cutter.cut(b"}"))
        yield from rows(now, cutter.rest())

    for first, text in _ranges(batches):
        key = (first["file"], int(first["start"]))
        if key != now:
            if cutter is not None:
                yield from done()
            now, cutter, ended = key, _Cutter(bool(first["quoted"]), first["stack"]), bool(first["ended"])
        yield from rows(now, cutter.cut(text))
    if cutter is not None:
        yield from done()


def read_large_snapshot(spark: SparkSession, path: str, document: str) -> DataFrame:
    """The documents of a snapshot, one JSON object with an array ``documents``, in the files at ``path`` in order of their names.

    ``document`` is their struct type in DDL.  Ranges are those of Spark's
    reader (``spark.sql.files.maxPartitionBytes``), so a file of any size is read
    by many tasks, twice; what is gathered is one row a range.  A record may
    lie in any number of ranges.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value")
    effect = ", ".join(f"quoted{q} boolean, closed{q} bigint, opened{q} string" for q in (0, 1))
    effects = pieces.mapInArrow(_effects, f"file string, start bigint, size bigint, n bigint, {effect}")
    states = effects.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_states, _STATE)  # one row a range
    known = pieces.join(F.broadcast(states), ["file", "start"]).select("file", "start", "value", "quoted", "stack", "ended")
    cut = known.mapInArrow(_records, "file string, start bigint, kind string, text string")
    # a tail goes with the last head before it
    rank = F.when(F.col("kind") == "head", 1).otherwise(0)
    parts = cut.filter("kind != 'whole'").withColumn("place", F.struct("file", "start", rank.alias("rank")))
    of = F.expr("sum(CASE WHEN kind = 'head' THEN 1 ELSE 0 END) OVER (ORDER BY place)")  # two rows a range at most
    joined = parts.withColumn("of", of).groupBy("of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text"))
    whole = cut.filter("kind = 'whole'").select("text").unionByName(joined.select("text"))
    return whole.select(F.from_json("text", document).alias("d")).select("d.*")
