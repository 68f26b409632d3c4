"""Token counts by section: documents are encoded once, tokens attributed by offset."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import loaded
from .staging import NO_ID, from_key, table
from .vectext import slices, text_column, tidy

RULES = ("first", "last", "most")
BATCH_BYTES = 1 << 20


def token_spans(text: str, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens ``ids`` of a text, ``size`` being the bytes of each id; one that holds part of a character spans it."""
    ends = np.cumsum(size[ids])
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return ends - size[ids], ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
    return char[ends - size[ids]], char[ends - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross an edge) of sections [edges[i], edges[i + 1])."""
    a = np.searchsorted(edges, start, "right") - 1
    b = np.searchsorted(edges, end - 1, "right") - 1
    if rule == "first":
        of = a
    elif rule == "last":
        of = b
    else:  # the section with most of the characters, the earlier on ties
        of = a.copy()
        for i in np.flatnonzero(a != b).tolist():
            inner = np.minimum(edges[a[i] + 1 : b[i] + 2], end[i]) - np.maximum(edges[a[i] : b[i] + 1], start[i])
            of[i] = a[i] + int(np.argmax(inner))
    return np.bincount(of, minlength=len(edges) - 1), int((a != b).sum())


def line_edges(text: str) -> np.ndarray:
    """Edges of the lines of a text, each with its newline; an empty text has no line."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(chars == 10) + 1
    return np.unique(np.r_[0, ends, len(chars)])


def _count_batches(path: str, pattern: str, rule: str):
    def run(batches):
        bpe = loaded(path, pattern)
        size = np.diff(bpe.token_at)
        for batch in batches:
            _, offsets = text_column(batch.column("text"))
            for a, b in slices(offsets, BATCH_BYTES):
                part = batch.slice(a, b - a)
                total, crossing, ends, counts = [], [], [], []
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids, at = bpe.encode(texts)
                for i, text in enumerate(texts):
                    start, end = token_spans(text, ids[at[i] : at[i + 1]], size)
                    edges = line_edges(text)
                    n, over = attribute(start, end, edges, rule) if len(edges) > 1 else (np.zeros(0, np.int64), 0)
                    total.append(len(start))
                    crossing.append(over)
                    ends.append(edges[1:])
                    counts.append(n)
                cuts = pa.array(np.r_[0, np.cumsum([len(x) for x in ends])].astype(np.int32))
                flat = lambda x: pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(total, pa.int64()), pa.array(crossing, pa.int64()), flat(ends), flat(counts)], ["k", "n_tokens", "n_crossing", "section_ends", "section_tokens"])

    return run


def section_tokens(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, rule: str = "first") -> DataFrame:
    """doc_id, n_tokens, n_crossing, section_ends and section_tokens of each document.

    Every document is encoded once, as a whole, by the ranks at ``path`` (on
    every machine).  Sections are its lines, each with its newline, so they
    cover the text.  A token belongs to the section its characters lie in; one
    that crosses an edge goes by ``rule`` to the section of its "first" or
    "last" character, or to the one with "most" of them (the earlier on ties),
    so the sections' counts add up to n_tokens.  section_ends are in code
    points.  A null or empty text has no section and no token; repeated rows
    give a row each; other columns are ignored; an empty table gives an empty
    result.  No shuffle; a task holds a megabyte of
    text or one longer text, whatever runs of one character it has.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "k bigint, n_tokens bigint, n_crossing bigint, section_ends array<bigint>, section_tokens array<bigint>"
    return keyed.mapInArrow(tidy(_count_batches(path, pattern, rule)), schema).select(from_key().alias("doc_id"), "n_tokens", "n_crossing", "section_ends", "section_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = section_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return out.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "n_crossing", F.coalesce(F.array_max("section_tokens"), F.lit(0)).alias("max_section_tokens"), F.sha2(F.array_join("section_tokens", ","), 256).alias("section_tokens_sha256"))
