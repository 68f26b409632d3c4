"""Suffix-array dedup on bytes: per-shard suffix arrays, merged across shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import repeated_runs, run_columns
from .op2_windows import covered, spans_of, spread
from .staging import Stage, from_key, table, text_keys
from .suffixes import suffix_array
from .vectext import U64, mix, rolled, text_column, tidy

WINDOW, GRAM = 100, 24
SHARD_BYTES = 1 << 18  # text of one suffix array
HOT = 8_000  # slices of one anchor in one shard at most, about

SLICES = "shard bigint, hot boolean, k bigint, tk bigint, first int, n int, slice binary"
FOUND = "k bigint, tk bigint, first int, n int, w1 bigint, w2 bigint"


def _slice_batches(window: int):
    """The bytes of each candidate run, dealt to shards by anchor.

    Runs of an anchor that occurs often are dealt to several shards by document and place.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            key, tk = (np.asarray(batch.column(x)) for x in ("k", "tk"))
            doc, h, first, n, count = run_columns(batch.column("runs"))
            parts = -(-count // HOT)
            salt = (mix(key[doc].view(U64) + first.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(33)).astype(np.int64) % parts
            shard = h ^ (salt * -0x61C8864680B583EB)
            for a in range(0, len(doc), 20_000):
                b = min(len(doc), a + 20_000)
                lo = offsets[doc[a:b]] + first[a:b]
                take, _ = spread(lo, n[a:b].astype(np.int64) + window - 1)
                cut = np.r_[0, np.cumsum(n[a:b] + window - 1)].astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(data[take].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[a:b]), pa.array(parts[a:b] > 1), pa.array(key[doc[a:b]]), pa.array(tk[doc[a:b]]), pa.array(first[a:b]), pa.array(n[a:b]), body],
                    ["shard", "hot", "k", "tk", "first", "n", "slice"],
                )

    return run


def _shard(rows: list[pa.RecordBatch], window: int):
    """Windows that also start earlier in this shard, and the first of each for hot anchors.

    Equal slices are one text, at the earliest of their places; every window
    of the others also starts there.  The suffix array of the distinct slices
    groups equal windows: neighbours that share ``window`` bytes or more.
    """
    t = pa.Table.from_batches(rows).combine_chunks()
    k, tk, first, n = (t.column(x).to_numpy() for x in ("k", "tk", "first", "n"))
    hot, body = t.column("hot").to_numpy(), t.column("slice").to_pylist()
    order = np.lexsort((first, tk, k))
    doc = np.empty(len(k), np.int64)  # rank of each document
    doc[order] = np.cumsum(np.r_[False, (k[order[1:]] != k[order[:-1]]) | (tk[order[1:]] != tk[order[:-1]])])
    place = (doc << 32) | first
    earliest: dict[bytes, int] = {}
    rep = np.empty(len(k), np.int64)
    for i in order.tolist():
        rep[i] = earliest.setdefault(body[i], i)
    own = np.arange(len(k))
    later = place != place[rep]
    reps = np.flatnonzero(rep == own)
    text = np.frombuffer(b"".join([body[i] for i in reps.tolist()]), np.uint8)
    size = np.array([len(body[i]) for i in reps.tolist()], np.int64)
    cuts = np.r_[0, np.cumsum(size)]
    sa, lcp = suffix_array(text, cuts)
    group = np.cumsum(lcp < window)
    fits = np.repeat(cuts[:-1] + n[reps], size)[sa] > sa  # places where a whole window fits
    group, at = group[fits], sa[fits]
    of = np.repeat(np.arange(len(reps)), size)[at]
    # groups of windows that may also lie in other shards: their first places go on
    group_hot = np.zeros(len(group), bool)
    if hot.any():
        anywhere = np.zeros(len(k), bool)
        anywhere[rep[hot]] = True
        group_hot = (np.bincount(group, weights=anywhere[reps[of]]) > 0)[group]
    several = np.flatnonzero((np.bincount(group)[group] > 1) | group_hot)
    group, at, of, group_hot = group[several], at[several], of[several], group_hot[several]
    src = reps[of]
    spot = place[src] + (at - cuts[of])
    order = np.lexsort((spot, group))
    group, src, spot, at, group_hot = group[order], src[order], spot[order], at[order], group_hot[order]
    head = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else np.zeros(0, np.int64)
    gone = spot != spot[lead]
    where = spot & 0xFFFFFFFF
    hits = np.lexsort((where[gone], src[gone]))
    hs, hw = src[gone][hits], where[gone][hits]
    new = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (hw[1:] != hw[:-1] + 1)]) if len(hs) else np.zeros(0, np.int64)
    lens = np.diff(np.r_[new, len(hs)])
    x = np.r_[np.flatnonzero(later), hs[new]]
    nothing = np.zeros(len(x), np.int64)
    yield k[x], tk[x], np.r_[first[later], hw[new]], np.r_[n[later], lens], nothing, nothing
    group_hot &= head
    if group_hot.any():
        src, where, at = src[group_hot], where[group_hot], at[group_hot]
        w1, w2 = (rolled(mix(text.astype(U64) + U64(1 + 1000 * i)), window, i)[at] for i in range(2))
        yield k[src], tk[src], where, np.ones(len(src), np.int64), w1.view(np.int64), w2.view(np.int64)


def _shard_batches(window: int):
    """Blocks of whole shards, of SHARD_BYTES or one shard, each with its suffix array."""

    def emit(rows):
        for out in _shard(rows, window):
            if len(out[0]):
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, kind)) for x, kind in zip(out, kinds, strict=True)], ["k", "tk", "first", "n", "w1", "w2"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            ids = np.asarray(batch.column("shard"))
            edges = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            bytes_at = np.r_[0, np.cumsum(np.asarray(pa.compute.binary_length(batch.column("slice"))))]
            a = 0
            for e in edges[:-1].tolist():
                # a block may end before row e, where another shard begins
                if size + bytes_at[e] - bytes_at[a] >= SHARD_BYTES and (e > 0 or ids[0] != last):
                    if e > a:
                        held.append(batch.slice(a, e - a))
                    yield from emit(held)
                    held, size, a = [], 0, e
            if len(ids):
                held.append(batch.slice(a))
                size += int(bytes_at[-1] - bytes_at[a])
                last = ids[-1]
        if held:
            yield from emit(held)

    return run


def _merge_batches(batches):
    """Of windows sorted by hash and place, those whose like also starts earlier.

    The list of a partition is sorted, so runs begin where neighbours differ and
    a row's run is looked up there; the last window of a batch is carried to the next.
    """
    tail = None
    for batch in batches:
        cols = [np.asarray(batch.column(x)) for x in ("w1", "w2", "k", "tk", "first")]
        if tail is not None:
            cols = [np.r_[t, c] for t, c in zip(tail, cols, strict=True)]
        w1, w2, k, tk, first = cols
        if not len(w1):
            continue
        new = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        lead = new[np.searchsorted(new, np.arange(len(w1)), "right") - 1]
        gone = (k != k[lead]) | (tk != tk[lead]) | (first != first[lead])
        tail = [c[lead[-1] : lead[-1] + 1] for c in cols]
        m = int(gone.sum())
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(k[gone]), pa.array(tk[gone]), pa.array(first[gone]), pa.array(np.ones(m, np.int32))], ["k", "tk", "first", "n"])


def _removal_batches(window: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            runs = batch.column("hits")
            n_removed, kept, spans = [], [], []
            for i in range(batch.num_rows):
                raw, hits = data[offsets[i] : offsets[i + 1]], runs[i].values
                if hits is None or not len(hits):
                    n_removed.append(0)
                    kept.append(raw.tobytes())
                    spans.append([])
                    continue
                pos, _ = spread(np.asarray(hits.field(0)).astype(np.int64), np.asarray(hits.field(1)).astype(np.int64))
                mask = covered(pos, window, len(raw))
                n_removed.append(int(mask.sum()))
                kept.append(raw[~mask].tobytes())
                spans.append([{"first": int(x), "last": int(y)} for x, y in zip(*spans_of(mask), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                ["k", "n_bytes", "n_removed", "kept", "spans"],
            )

    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove bytes covered by a ``window``-byte string that also starts earlier.

    Takes doc_id and text, whatever other columns there are.  Returns doc_id,
    n_bytes, n_removed, kept (binary, remaining bytes) and spans, the maximal
    removed runs [first, last) in bytes, one row per input row.  Earlier means
    a smaller doc_id (null is the smallest), or an earlier start in the same
    document; overlaps count; strings are judged on the input.

    A null or empty text has no bytes; texts shorter than the window lose
    nothing; an empty table gives an empty result; a row given twice is one
    document, so neither loses to the other; rows that share a doc_id but not
    the text are ordered by a hash of it.  Only slices around byte anchors that
    occur twice or more reach a suffix array.  Equal windows share an anchor
    and so a shard; an anchor with more than HOT slices is dealt to several
    shards by document and place, and their windows are merged by hash.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "suffixes")
    keyed, keys = text_keys(docs)
    candidates = repeated_runs(keyed, keys, stage, "byte", window, gram)
    dealt = candidates.mapInArrow(tidy(_slice_batches(window)), SLICES)
    found = stage.cut(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(_shard_batches(window)), FOUND), "found")
    merged = found.filter("w1 != 0 or w2 != 0").repartition("w1", "w2").sortWithinPartitions("w1", "w2", "k", "tk", "first")
    merged = merged.mapInArrow(tidy(_merge_batches), "k bigint, tk bigint, first int, n int")
    hits = found.filter("w1 = 0 and w2 = 0").select("k", "tk", "first", "n").union(merged)
    places = stage.cut(hits.groupBy(keys).agg(F.collect_list(F.struct("first", "n")).alias("hits")), "places")
    stage.keep(places)
    schema = "k bigint, n_bytes bigint, n_removed bigint, kept binary, spans array<struct<first:bigint,last:bigint>>"
    out = keyed.join(places, keys, "left").select("k", "text", F.coalesce("hits", F.array().cast("array<struct<first:int,n:int>>")).alias("hits"))
    return out.mapInArrow(tidy(_removal_batches(window)), schema).select(from_key().alias("doc_id"), "n_bytes", "n_removed", "kept", "spans")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
