"""Content-defined anchors: the part of a corpus that can hold repeated windows.

Every window of W units (words or bytes) has a minimizer, the least of its
k-unit sub-windows by a mixed hash, the leftmost on ties.  Equal windows have
equal minimizers, so a window whose minimizer occurs once in the corpus is
unique and needs no further look.  Consecutive windows with one minimizer
form a run; runs, about 2 / (W - k + 2) of the units, are all that is counted
over the whole corpus, and only runs with a repeated minimizer go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage
from .vectext import U64, Powers, Words, mix, slices, text_column, tidy

RUNS = "array<struct<h:bigint,first:int,n:int,c:bigint>>"
_gram_powers = Powers(0xC2B2AE3D27D4EB4F)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def polynomials(units: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial modulo 2**64 of the k units from each unit on.

    A collision only joins two anchors, so this cheaper modulus will do here.
    """
    n = len(units)
    _gram_powers.grow(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(units * _gram_powers.up[:n], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * _gram_powers.down[: n - k + 1]) if n >= k else np.zeros(0, U64)


def runs_of(grams: np.ndarray, cuts: np.ndarray, window: int, k: int):
    """(gram hash, row, first window, windows) of each run of windows of one minimizer.

    ``cuts`` bounds the rows in units; windows never cross them.
    """
    n, w = int(cuts[-1]), window - k + 1
    none = np.zeros(0, np.int64)
    if n < window or len(grams) < w:
        return np.zeros(0, U64), none, none, none
    packed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    at = (sliding_min(packed, w) & U64(0xFFFFFFFF)).astype(np.int64)[: n - window + 1]
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[: len(at)]
    good = np.flatnonzero(np.arange(len(at)) + window <= cuts[row + 1])
    if not len(good):
        return np.zeros(0, U64), none, none, none
    at, row = at[good], row[good]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    count = np.diff(np.r_[new, len(good)])
    return grams[at[new]], row[new], good[new] - cuts[row[new]], count


def _anchor_batches(unit: str, window: int, k: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            key, tk = batch.column("k").to_numpy(zero_copy_only=False), batch.column("tk").to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                if unit == "word":
                    words = Words(data, offsets, a, b)
                    grams, cuts = polynomials(words.hash, k), words.rows
                else:
                    cuts = offsets[a : b + 1] - offsets[a]
                    grams = polynomials(data[offsets[a] : offsets[b]].astype(U64) + U64(1), k)
                h, row, first, n = runs_of(grams, cuts, window, k)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(key[a + row]), pa.array(tk[a + row]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                        ["h", "k", "tk", "first", "n"],
                    )

    return run


def repeated_runs(keyed: DataFrame, keys: list[str], stage: Stage, unit: str, window: int, k: int) -> DataFrame:
    """Documents that hold runs with a repeated minimizer: keys, text, runs."""
    anchors = keyed.mapInArrow(tidy(_anchor_batches(unit, window, k)), "h bigint, k bigint, tk bigint, first int, n int")
    seen = stage.cut(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "anchors")
    per_doc = anchors.join(seen, "h").groupBy(keys).agg(F.collect_list(F.struct("h", "first", "n", "c")).alias("runs"))
    per_doc = stage.cut(per_doc, "runs")  # its shuffles are released before the texts move
    out = stage.cut(keyed.join(per_doc, keys), "candidates")
    stage.drop(seen, per_doc)
    return out


def run_columns(col: pa.Array):
    """(document of each run, h, first, n, c) of a runs column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten()
    doc = np.repeat(np.arange(len(col)), np.asarray(pa.compute.list_value_length(col)))
    return doc, *(np.asarray(flat.field(i)) for i in range(4))
