"""Spelling variant grouping: a pigeonhole join of words that one edit parts.

A word of l code points is cut into an even pair of segments, so one edit
leaves one of them whole.  The segments of each word are indexed by l; a word
probes the index of its own length and of the next shorter one, at the place
of each segment counted from the end that the edit can't have moved.  Where too
many words share a segment, what lies beside it is cut in two again, and so on
down to one code point, so no key pairs more than PAIRS words that are no
variants of each other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, has_rows, table
from .vectext import slices, text_column, tidy

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
DELETE_EVERY = 199
PAIRS = 4096  # candidates of one key
SLICE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def letter_runs(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(runs, their rows) of maximal runs of A-Z, a-z and U+00C0 to U+00FF in rows a..b, A-Z lower-cased."""
    lo, hi = int(offsets[a]), int(offsets[b])
    raw = data[lo:hi]
    small = raw | 32
    lead = raw == 0xC3  # in UTF-8 the lead byte of just these 64
    letter = ((small >= 97) & (small <= 122)) | lead
    letter[1:] |= lead[:-1]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    cuts = offsets[a : b + 1] - lo
    inner = cuts[:-1][cuts[:-1] < hi - lo]
    begins[inner] = letter[inner]
    start = np.flatnonzero(begins)
    at = (np.cumsum(letter) - letter)[start]  # among the letters alone
    edges = pa.py_buffer(np.r_[at, np.count_nonzero(letter)].astype(np.int32))
    runs = pa.Array.from_buffers(pa.binary(), len(start), [None, edges, pa.py_buffer(_LOWER[raw[letter]])])
    return runs.dictionary_encode(), np.searchsorted(cuts, start, "right") - 1


def _spoil(word: str, h: int) -> str:
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def _count(every: int | None):
    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            ids = batch.column("id").to_pylist()
            for a, b in slices(offsets, SLICE):
                runs, rows = letter_runs(data, offsets, a, b)
                names = runs.dictionary.to_pylist()
                code = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.bincount(code, minlength=len(names))
                spoilt: dict[str, int] = {}
                if every:
                    prefix = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[a:b]]
                    pairs, times = np.unique((rows.astype(np.int64) << 32) | code, return_counts=True)
                    who = pairs & 0xFFFFFFFF
                    h = np.fromiter((zlib.crc32(names[c], prefix[r]) for r, c in zip((pairs >> 32).tolist(), who.tolist())), np.int64, len(pairs))
                    for j in np.flatnonzero(h % every == 0).tolist():
                        word = _spoil(names[who[j]].decode(), int(h[j]))
                        n[who[j]] -= times[j]
                        spoilt[word] = spoilt.get(word, 0) + int(times[j])
                words = pa.concat_arrays([runs.dictionary.cast(pa.string()), pa.array(list(spoilt), pa.string())])
                n = np.r_[n, np.fromiter(spoilt.values(), np.int64, len(spoilt))].astype(np.int64)
                keep = pa.array((n > 0) & (pc.utf8_length(words).to_numpy(zero_copy_only=False) >= MIN_LENGTH))
                yield pa.RecordBatch.from_arrays([words.filter(keep), pa.array(n).filter(keep)], ["word", "n"])

    return run


def word_counts(docs: DataFrame, every: int | None = None) -> DataFrame:
    """word and n of the frequent words; with ``every``, one run in so many is misspelt first, by its hash."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    part = rows.mapInArrow(tidy(_count(every)), "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _key(items: DataFrame) -> DataFrame:
    """``items`` with k, a hash of the length, the shift and both ends that are taken to match; a false match is verified away."""
    ends = F.left("word", F.col("p")), F.right("word", F.col("s"))
    return items.withColumn("k", F.xxhash64("l", "d", "p", "s", *ends))


def _segments(words: DataFrame) -> DataFrame:
    """(word, n, probes, l, d, p, s): word as an entry or a probe of words of l code points, one of l + d, that share p code points at the front and s at the end."""
    length = F.char_length("word")
    halves = lambda l: [(F.floor(l / 2), F.lit(0)), (F.lit(0), l - F.floor(l / 2))]  # noqa: E731, E741
    each = []
    for d in (0, 1):
        for probes, l in ((False, length), (True, length - d)):  # noqa: E741
            for p, s in halves(l):
                each.append(F.struct(F.lit(probes).alias("probes"), l.cast("int").alias("l"), F.lit(d).alias("d"), p.cast("int").alias("p"), s.cast("int").alias("s")))
    return words.select("word", "n", F.explode(F.array(*each)).alias("x")).select("word", "n", "x.*")


def _finer(items: DataFrame) -> DataFrame:
    """The same items, with what lies between their ends cut in two again; a last code point may match on either side of an inserted one."""
    r = F.col("l") - F.col("p") - F.col("s")
    first, second = F.greatest(F.floor(r / 2), F.lit(1)), F.when(r == 1, 1).otherwise(r - F.floor(r / 2))
    part = lambda p, s: F.struct((F.col("p") + p).cast("int").alias("p"), (F.col("s") + s).cast("int").alias("s"))
    cut = F.explode(F.array(part(first, F.lit(0)), part(F.lit(0), second))).alias("x")
    return items.select("word", "n", "probes", "l", "d", cut).select("word", "n", "probes", "l", "d", "x.p", "x.s")


def _apart() -> Column:
    """Whether the pair differs by exactly one code point."""
    return F.levenshtein("word", "other", 1) == 1


def near_words(words: DataFrame, stage: Stage, pairs: int = PAIRS) -> DataFrame:
    """(word, n, other, other_n), each pair of near words once, of distinct ``words`` with n."""
    items, found = _key(_segments(words)), []
    while True:
        items = stage.cut(items, "items")
        sizes = items.groupBy("k").agg(F.count_if(~F.col("probes")).alias("entries"), F.count_if("probes").alias("asked")).filter("entries > 0 and asked > 0")
        rest = F.col("l") - F.col("p") - F.col("s")
        whole = (F.col("entries") * F.col("asked") <= pairs) | (rest < 1) | ((rest == 1) & (F.col("d") == 0))
        sized = items.join(sizes, "k").withColumn("whole", whole)
        sized = stage.cut(sized.drop("entries", "asked"), "sized")
        now = sized.filter("whole").select("k", "word", "n", "probes", "d")
        left = now.filter("not probes").select("k", "word", "n")
        right = now.filter("probes").select("k", F.col("word").alias("other"), F.col("n").alias("other_n"), "d")
        # words of one length meet twice
        met = left.join(right, "k").filter((F.col("d") == 1) | (F.col("word") < F.col("other"))).filter(_apart())
        found.append(stage.cut(met.select("word", "n", "other", "other_n"), "near"))
        stage.drop(items)
        items = sized.filter("not whole")
        if not has_rows(items):
            break
        items = _key(_finer(items))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _roots(forms: DataFrame, stage: Stage) -> DataFrame:
    """word and root of each word with a form, by pointer jumping: counts grow along a chain, so it ends."""
    now = stage.cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stage.cut(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        going = has_rows(new.filter("moved"))
        stage.drop(now)
        now = new
        if not going:
            return now.select("word", "root")


def spelling_variants(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct ``words`` (word of at least two code points, n).

    Two words are near if one inserted, deleted or replaced code point parts
    them.  The form of a word is its near word of largest n (of equals the
    least by code points) where that is at least RATIO times its own n; its root
    is where the forms lead in the end, itself without one.  n_near counts near
    words.  Null words are left out; an empty table gives an empty result;
    other columns are ignored; a word of any length is one row.

    Verification comes below the removal of duplicates, as few candidates pass
    it.  Keys that would pair over ``pairs`` words are refined, and at the last
    level all words under a key are near to each other, at most as many as the
    alphabet has letters, so no key is paired whole.
    """
    stage = Stage(words.sparkSession, "spelling")
    words = stage.cut(words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null"), "words")
    near = stage.cut(near_words(words, stage, pairs), "pairs")
    both = near.unionByName(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best")
    by = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    good = -F.col("best.m") >= RATIO * F.col("n")
    by = stage.cut(by.select("word", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(by.filter("form is not null"), stage)
    out = words.join(by, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, one run in 199 misspelt by its hash; a null id counts as an empty one."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), DELETE_EVERY))
