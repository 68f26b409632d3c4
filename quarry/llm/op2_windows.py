"""Substring dedup on words: Rabin-Karp hashes of fixed word windows, counted in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import repeated_runs, run_columns
from .staging import Stage, from_key, table, text_keys
from .vectext import Words, slices, text_column, tidy

WINDOW, GRAM = 35, 15


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[i], first[i] + 1, ... (n[i] of them) for each i, and the i of each."""
    of = np.repeat(np.arange(len(n)), n)
    start = np.cumsum(n) - n
    return np.repeat(first - start, n) + np.arange(len(of)), of


def _window_batches(window: int):
    """Two 64-bit hashes of every window of the candidate runs."""

    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            key, tk = (np.asarray(batch.column(x)) for x in ("k", "tk"))
            doc, _, first, n, _ = run_columns(batch.column("runs"))
            order = np.argsort(doc, kind="stable")
            doc, first, n = doc[order], first[order], n[order]
            for a, b in slices(offsets):
                words = Words(data, offsets, a, b)
                h1, h2 = words.windows(window, 0)[0], words.windows(window, 1)[0]
                lo, hi = np.searchsorted(doc, [a, b])
                if lo == hi:
                    continue
                pos, of = spread(first[lo:hi].astype(np.int64), n[lo:hi])
                row = doc[lo:hi][of]
                at = words.rows[row - a] + pos
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(key[row]), pa.array(tk[row]), pa.array(pos.astype(np.int32))],
                    ["w1", "w2", "k", "tk", "pos"],
                )

    return run


def covered(pos: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units lie in [p, p + width) for some p."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, pos, 1)
    np.add.at(edge, np.minimum(pos + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _removal_batches(window: int):
    def run(batches):
        for batch in batches:
            texts, ks, repeated = batch.column("text"), batch.column("k"), batch.column("pos")
            data, offsets = text_column(texts)
            n_words, n_removed, kept, spans = [], [], [], []
            for a, b in slices(offsets):
                words = Words(data, offsets, a, b)
                raw = words.raw.tobytes()
                for i in range(a, b):
                    lo, hi = words.rows[i - a], words.rows[i - a + 1]
                    start, end = words.start[lo:hi].tolist(), words.end[lo:hi].tolist()
                    pos = repeated[i].values
                    if pos is None or not len(pos):
                        keep, removed = range(hi - lo), []
                    else:
                        mask = covered(np.asarray(pos).astype(np.int64), window, hi - lo)
                        keep = np.flatnonzero(~mask).tolist()
                        s, e = spans_of(mask)
                        removed = [{"first": int(x), "last": int(y)} for x, y in zip(s, e, strict=True)]
                    n_words.append(hi - lo)
                    n_removed.append(hi - lo - len(keep))
                    kept.append(b" ".join([raw[start[j] : end[j]] for j in keep]).decode())
                    spans.append(removed)
            yield pa.RecordBatch.from_arrays(
                [ks, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                ["k", "n_words", "n_removed", "kept", "spans"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove words covered by a window of ``window`` words that occurs elsewhere.

    Takes doc_id and text, whatever other columns there are.  Returns doc_id,
    n_words, n_removed, kept (kept words joined by one space) and spans, the
    maximal removal intervals [first, last) in words, one row per input row.

    Windows are judged on the input, so every copy of a repeated passage goes.
    Words are runs of bytes outside ASCII white space.  A null or empty text
    has no words; texts shorter than the window lose nothing; an empty table
    gives an empty result; a row given twice counts as two places, so it loses
    all its windows; rows that share a doc_id are told apart by their text; a
    null doc_id is kept as null.  No text or group is held whole by one task
    beyond the text itself: windows are counted by partial aggregation and the
    counts joined back, a join that adaptive execution may split when skewed.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "substring")
    keyed, keys = text_keys(docs)
    candidates = repeated_runs(keyed, keys, stage, "word", window, gram)
    windows = candidates.mapInArrow(tidy(_window_batches(window)), "w1 bigint, w2 bigint, k bigint, tk bigint, pos int")
    repeated = stage.cut(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w1", "w2"), "repeated")
    places = windows.join(repeated, ["w1", "w2"]).groupBy(keys).agg(F.collect_list("pos").alias("pos"))
    places = stage.cut(places, "places")
    stage.keep(places)
    schema = "k bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<first:bigint,last:bigint>>"
    found = keyed.join(places, keys, "left").select("k", "text", F.coalesce("pos", F.array().cast("array<int>")).alias("pos"))
    return found.mapInArrow(tidy(_removal_batches(window)), schema).select(from_key().alias("doc_id"), "n_words", "n_removed", "kept", "spans")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
