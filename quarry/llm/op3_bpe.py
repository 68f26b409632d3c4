"""Byte-level BPE over whole documents: encode, and decode the ids again."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import loaded
from .staging import NO_ID, from_key, table
from .vectext import slices, text_column, tidy

BATCH_BYTES = 3 << 20


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    return str(public_tokenizers.path(name))


def lists(values: np.ndarray, cuts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(kind)))


def _encode_batches(path: str, pattern: str):
    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            _, offsets = text_column(batch.column("text"))
            for a, b in slices(offsets, BATCH_BYTES):
                part = batch.slice(a, b - a)
                ids, cuts = bpe.encode([x or "" for x in part.column("text").to_pylist()])
                raw, ends = bpe.decode(ids, cuts)
                decoded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("k"), lists(ids, cuts, np.int32), decoded], ["k", "ids", "decoded"])

    return run


def bpe_encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary, the bytes of the ids).

    ``path`` is a file of ranks, read where the work is done; it must be at the
    same place on every machine.  Pre-tokens are the matches of ``pattern``;
    special tokens are ordinary text.  A null or empty text has no ids; every
    row gives one row, repeated or not; other columns are ignored; an empty
    table gives an empty result.  No shuffle: a task holds a few megabytes of
    text, or one longer text, and a cache of bounded size.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    out = keyed.mapInArrow(tidy(_encode_batches(path, pattern)), "k bigint, ids array<int>, decoded binary")
    return out.select(from_key().alias("doc_id"), "ids", "decoded")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode_decode(table(spark, sf_dir, "documents"), ranks_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
