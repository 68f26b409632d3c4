"""Benchmark decontamination: a join on spaced seeds, then verification with substitutions allowed."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, from_key, table, text_keys
from .vectext import U64, Words, mix, slices, text_column, tidy

# Masks over 10 word positions, 6 of them read.  With a fifth of the words replaced at
# random, some mask fits between the replaced words of 99 % or more of the overlaps of each length from 13 on.
MASKS = ("1001110011", "1111001001", "1101000111", "1001101101")
SPAN = len(MASKS[0])
MIN_OVERLAP = 13  # words of an overlap at least, or the whole item if it is shorter
MIN_ITEM = 5  # items with fewer words are too short to tell
SAME, OF = 4, 5  # so many of so many positions of an overlap must agree
CELL = 64  # words of a document that share a row of hits, at least
FILTER_BITS = (1 << 16, 1 << 28)  # least and greatest size of the seed filter: 32 MB at most
FILTER_PROBES = 3
HOT = 16  # places of items from which a seed is joined by the words around it
REACH = 9  # words on either side that are looked at then
LONE = (-3, SPAN + 2)  # where the only agreement around a seed can lie: at the end of an overlap of 13 words
AROUND = (*range(-REACH, 0), *range(SPAN, SPAN + REACH))  # places of these words, from a seed's first one on
BROADCAST_SEEDS = 1 << 20  # benchmark seeds, or items, that are broadcast at most
BROADCAST_WORDS = 1 << 22  # and words of broadcast items
BROADCAST_DOCS = 100_000
_ODD = [U64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(SPAN + MIN_OVERLAP)]


def short_masks(n: int) -> list[str]:
    """Masks over a short item of n words, one of which avoids any n // 5 replaced words.

    One replaced word lies in one of 3 residues, two lie in two of 4 at most;
    the masks ignore each residue, or each pair of them.
    """
    gone = n // OF
    return ["".join("01"[i % (gone + 2) not in out] for i in range(n)) for out in combinations(range(gone + 2), gone)]


def seeds(mixed: list[np.ndarray], mask: str, salt: int) -> np.ndarray:
    """Hash of the words that a mask reads, from each word on; ``mixed`` has the words' hashes for each position."""
    n = len(mixed[0]) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, salt, U64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total += mixed[i][i : i + n]
    return mix(total)


def masks(lengths: list[int]) -> list[tuple[str, int, int]]:
    """(mask, salt, item length or 0) of all seeds: those of long items, then of each short length."""
    out = [(m, 1 + i, 0) for i, m in enumerate(MASKS)]
    for n in lengths:
        out += [(m, 1000 * n + i, n) for i, m in enumerate(short_masks(n))]
    return out


def _mixed(word: np.ndarray, wanted: list[tuple[str, int, int]]) -> list[np.ndarray]:
    return [mix(word ^ _ODD[i]) for i in range(max(len(m) for m, _, _ in wanted))]


def _item_batches(lengths: list[int]):
    """Seeds of the items: every place of the long ones, the whole of the short ones."""
    wanted = masks(lengths)

    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            item, ik = (np.asarray(batch.column(x)) for x in ("item", "ik"))
            for a, b in slices(offsets):
                w = Words(data, offsets, a, b, lower=True)
                size = np.diff(w.rows)
                row = np.repeat(np.arange(b - a), size)
                mixed = _mixed(w.hash, wanted)
                for mask, salt, n in wanted:
                    h = seeds(mixed, mask, salt)
                    at = np.arange(len(h))
                    if n:
                        fits = (size[row[at]] == n) & (at == w.rows[row[at]])
                    else:
                        fits = (size[row[at]] >= MIN_OVERLAP) & (at + len(mask) <= w.rows[row[at] + 1])
                    at = at[fits]
                    if len(at):
                        r = row[at]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[at].view(np.int64)), pa.array(item[a + r]), pa.array(ik[a + r]), pa.array((at - w.rows[r]).astype(np.int32)), pa.array(np.full(len(at), n == 0))],
                            ["seed", "item", "ik", "at", "long"],
                        )

    return run


def _around(word: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: np.ndarray):
    """(bit of a place, rows, keys): a seed's hash with the word at each place around it, where its text has one."""
    for bit, d in enumerate(AROUND):
        x = at + d
        has = np.flatnonzero((x >= lo) & (x < hi))
        yield bit, has, mix(mix(seed[has].view(U64) + U64(bit + 1)) ^ word[x[has]]).view(np.int64)


def _item_around_batches(batches):
    """Hot seeds of items with the words around them."""
    for batch in batches:
        data, offsets = text_column(batch.column("text"))
        yield from _around_rows(batch, data, offsets, batch.column("places"), np.zeros(batch.num_rows, np.int64), ["item", "ik"])


def _hit_around_batches(batches):
    """Hot seeds of cells of documents with the words around them."""
    for batch in batches:
        data, offsets = text_column(batch.column("text"))
        yield from _around_rows(batch, data, offsets, batch.column("places"), np.asarray(batch.column("first")).astype(np.int64), ["k", "tk", "cell"])


def _around_rows(batch, data, offsets, places, first, names):
    """Rows of ``places`` (seed, at) with their keys; ``first`` is the place of a text's first word."""
    ends = np.asarray(places.offsets)
    flat = places.values
    seed, at = (np.asarray(flat.field(x)) for x in ("seed", "at"))
    for a, b in slices(offsets):
        w = Words(data, offsets, a, b, lower=True)
        lo, hi = int(ends[a]), int(ends[b])
        row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        here = at[lo:hi].astype(np.int64) - first[a + row]
        for bit, has, key in _around(w.hash, w.rows[row] + here, w.rows[row], w.rows[row + 1], seed[lo:hi]):
            if len(has):
                take = pa.array(a + row[has])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).take(take) for x in names), pa.array(at[lo:hi][has].astype(np.int32)), pa.array(np.full(len(has), 1 << bit, np.int32)), pa.array(key)],
                    [*names, "at", "bit", "key"],
                )


def hot_pairs(own: DataFrame, known: DataFrame, hits: DataFrame, items: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs of documents and items that share a hot seed and what an overlap around it needs.

    ``hot`` is broadcast by the caller if it may be.  A window of 13 to 39 words
    of which four fifths agree has 7 disagreements at most, so two of the words
    that agree outside a seed in it lie within 9 places of the seed; a window of
    13 words may have only one, which is the third word from it.  A longer
    overlap holds such a window of 20 words or more.  So seeds meet by the words
    around them, and a phrase of many items meets only what goes on alike.
    """
    places = lambda at: F.collect_set(F.struct("seed", F.col(at).alias("at"))).alias("places")
    of_items = known.join(hot, "seed").groupBy("item", "ik").agg(places("at")).join(items, ["item", "ik"])
    of_items = of_items.select("item", "ik", "text", "places").mapInArrow(tidy(_item_around_batches), "item bigint, ik bigint, at int, bit int, key bigint")
    of_docs = own.join(hot, "seed").groupBy("k", "tk", "cell").agg(places("p"))
    of_docs = of_docs.join(hits.select("k", "tk", "cell", "first", "text"), ["k", "tk", "cell"])
    of_docs = of_docs.select("k", "tk", "cell", "first", "text", "places").mapInArrow(tidy(_hit_around_batches), "k bigint, tk bigint, cell int, at int, bit int, key bigint")
    both = of_docs.withColumnRenamed("at", "p").distinct().join(of_items, ["key", "bit"])
    agree = both.groupBy("k", "tk", "cell", "item", "ik", "p", "at").agg(F.bit_or("bit").alias("bits"))
    lone = sum(1 << AROUND.index(x) for x in LONE)
    return agree.filter((F.bit_count("bits") >= 2) | (F.col("bits").bitwiseAND(lone) != 0)).select("k", "tk", "cell", "item", "ik", (F.col("p") - F.col("at")).alias("place"))


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(h ^ _ODD[i]) & U64(bits - 1)) for i in range(FILTER_PROBES)]


def _probe_batches(bits: int):
    def run(batches):
        for batch in batches:
            h = np.asarray(batch.column("seed")).view(U64)
            at = np.concatenate(_probes(h, bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).view(np.int64)), pa.array(np.left_shift(U64(1), at & U64(63)).view(np.int64))], ["cell", "bit"])

    return run


def seed_filter(seeds_: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the benchmark's seeds, of bounded size however many there are.

    Beyond its size it lets more document seeds through to the join, which decides.
    """
    bits = FILTER_BITS[0]
    while bits < min(96 * count, FILTER_BITS[1]):
        bits *= 2
    cells = seeds_.select("seed").mapInArrow(tidy(_probe_batches(bits)), "cell bigint, bit bigint").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[np.asarray(cells.column("cell").combine_chunks())] = np.asarray(cells.column("bit").combine_chunks()).view(U64)
    return out


def _hit_batches(lengths: list[int], passing: np.ndarray, longest: int):
    """Cells of documents that hold seeds of the benchmark: the seeds, and the words that an item laid there can reach."""
    wanted, bits, cell = masks(lengths), len(passing) * 64, max(CELL, longest)
    hit_type = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))

    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            key, tk = (np.asarray(batch.column(x)) for x in ("k", "tk"))
            for a, b in slices(offsets):
                w = Words(data, offsets, a, b, lower=True)
                row = np.repeat(np.arange(b - a), np.diff(w.rows))
                end = w.rows[row + 1]
                mixed = _mixed(w.hash, wanted)
                found = []
                for mask, salt, _ in wanted:
                    h = seeds(mixed, mask, salt)
                    live = np.flatnonzero(np.arange(len(h)) + len(mask) <= end[: len(h)])
                    for at in _probes(h, bits) if len(live) else ():
                        p = at[live]
                        live = live[(passing[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1) == 1]
                    found.append(np.stack([live, h[live].view(np.int64)], 1))
                found = np.concatenate(found)
                if not len(found):
                    continue
                at, seed = found[:, 0], found[:, 1]
                r = row[at]
                place = at - w.rows[r]
                order = np.lexsort((place // cell, r))
                r, place, seed = r[order], place[order], seed[order]
                new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (place[1:] // cell != place[:-1] // cell)])
                first = np.maximum(place[new] // cell * cell - longest, 0)
                last = np.minimum((place[new] // cell + 1) * cell + longest, np.diff(w.rows)[r[new]])
                raw = w.raw.tobytes()
                texts = []
                for x, lo, hi in zip(r[new].tolist(), first.tolist(), last.tolist(), strict=True):
                    texts.append(raw[w.start[w.rows[x] + lo] : w.end[w.rows[x] + hi - 1]].decode())
                hits = pa.ListArray.from_arrays(pa.array(np.r_[new, len(r)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(seed), pa.array(place.astype(np.int32))], ["seed", "at"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a + r[new]]), pa.array(tk[a + r[new]]), pa.array((place[new] // cell).astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(texts, pa.string()), hits.cast(hit_type)],
                    ["k", "tk", "cell", "first", "text", "hits"],
                )

    return run


def longest_overlap(same: np.ndarray) -> tuple[int, int]:
    """The longest [a, b) that begins and ends with an agreement and has SAME of OF positions agree; the first of equals."""
    n = len(same)
    total = np.r_[0, np.cumsum(np.where(same, OF - SAME, -SAME))]
    least = np.minimum.accumulate(np.where(same, total[:n], n * OF))
    ends = np.flatnonzero(same) + 1
    if not len(ends):
        return 0, 0
    starts = np.searchsorted(-least, -total[ends])  # the first place from which the sum is not negative
    starts = np.minimum(starts, ends - 1)
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best])


def overlap(same: np.ndarray, n: int) -> tuple[int, int] | None:
    """The overlap [a, b) of an item of n words laid along a document, if there is one; short items must lie in it whole."""
    if n < MIN_OVERLAP:
        return (0, n) if len(same) == n and OF * int(same.sum()) >= SAME * n else None
    a, b = longest_overlap(same)
    return (a, b) if b - a >= MIN_OVERLAP else None


def _verify_batches(batches):
    """Overlaps of items and documents around their common seeds, word by word."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            sides = []
            for name in ("text", "item_text"):
                data, offsets = text_column(part.column(name))
                sides.append(Words(data, offsets, 0, part.num_rows, lower=True))
            d, i = sides
            names = pa.concat_arrays([d.names(), i.names()]).dictionary_encode().indices
            names = np.asarray(names)
            dw, iw = names[: len(d.start)], names[len(d.start) :]
            place, first = (np.asarray(part.column(x)).astype(np.int64) for x in ("place", "first"))
            rows, agree, size, start = [], [], [], []
            for r in range(part.num_rows):
                doc, item = dw[d.rows[r] : d.rows[r + 1]], iw[i.rows[r] : i.rows[r + 1]]
                at = int(place[r] - first[r])  # of the item's first word among the words given
                x, y = max(0, -at), min(len(item), len(doc) - at)
                found = overlap(doc[at + x : at + y] == item[x:y], len(item)) if y > x else None
                if found:
                    rows.append(r)
                    agree.append(int((doc[at + x : at + y] == item[x:y])[found[0] : found[1]].sum()))
                    size.append(found[1] - found[0])
                    start.append(int(place[r]) + x + found[0])
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k").take(take), part.column("tk").take(take), part.column("item").take(take), pa.array(agree, pa.int64()), pa.array(size, pa.int64()), pa.array(start, pa.int64())],
                    ["k", "tk", "item_id", "n_same", "n_overlap", "first_word"],
                )


MATCH = "k bigint, tk bigint, item_id bigint, n_same bigint, n_overlap bigint, first_word bigint"


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, stage: Stage) -> DataFrame:
    """Overlaps by document key (k, tk) and item_id."""
    keyed, _ = text_keys(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.coalesce("text", F.lit("")).alias("text")).filter("item is not null")
    items = stage.cut(items.withColumn("ik", F.xxhash64("text")).distinct(), "items")
    # words as the longest run of other than white space; a bound is enough for the reach
    words = F.size(F.split(F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")), " ")).cast("long")
    sizes = items.select(words.alias("n")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest"), F.collect_set(F.when(F.col("n") < MIN_OVERLAP, F.col("n"))).alias("short")).first()
    if not sizes["items"]:
        return docs.sparkSession.createDataFrame([], MATCH)
    lengths = sorted(n for n in sizes["short"] if n >= MIN_ITEM)
    known = stage.cut(items.mapInArrow(tidy(_item_batches(lengths)), "seed bigint, item bigint, ik bigint, at int, long boolean"), "seeds")
    count = known.count()
    if not count:
        return docs.sparkSession.createDataFrame([], MATCH)
    passing = seed_filter(known, count)
    hits = keyed.mapInArrow(tidy(_hit_batches(lengths, passing, int(sizes["longest"]))), "k bigint, tk bigint, cell int, first int, text string, hits array<struct<seed:bigint,at:int>>")
    hits = stage.cut(hits, "hits")
    own = hits.select("k", "tk", "cell", F.explode("hits").alias("h")).select("k", "tk", "cell", "h.seed", F.col("h.at").alias("p"))
    hot = stage.cut(known.filter("long").groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("seed"), "hot")
    some = hot.count()
    hot = F.broadcast(hot) if some <= BROADCAST_SEEDS else hot
    right = known.join(hot, "seed", "left_anti") if some else known
    right = F.broadcast(right) if count <= BROADCAST_SEEDS else right
    pairs = own.join(right, "seed").select("k", "tk", "cell", "item", "ik", (F.col("p") - F.col("at")).alias("place"))
    if some:
        pairs = pairs.union(hot_pairs(own, known, hits, items, hot))
    pairs = stage.cut(pairs.distinct(), "pairs")
    texts = items.select("item", "ik", F.col("text").alias("item_text"))
    texts = F.broadcast(texts) if sizes["items"] <= BROADCAST_SEEDS and sizes["words"] <= BROADCAST_WORDS else texts
    stage.keep(items, hits, pairs)
    both = pairs.join(hits.select("k", "tk", "cell", "first", "text"), ["k", "tk", "cell"]).join(texts, ["item", "ik"])
    return both.select("k", "tk", "item", "place", "first", "text", "item_text").mapInArrow(tidy(_verify_batches), MATCH)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, benchmark item) that overlap: the leaks.

    Takes doc_id, text and item_id, text; other columns are ignored.  Words are
    lower-cased runs outside ASCII white space.  Fixed masks ignore 4 of 10
    positions, so a seed survives words replaced there.  The seeds of all
    documents are joined with those of all items, and around each common seed
    the item is laid along the document, word by word: an overlap has 13 words
    or more, four fifths of them equal, the first and last among these.  An
    item of 5 to 12 words must lie in the document whole, with a fifth of its
    words replaced at most; its masks miss none.  Items of fewer than 5 words
    are not searched.  Returns doc_id, item_id, n_same, n_overlap and
    first_word (in the document) of the overlap with most equal words, the
    longest and then the first of equals.

    Null or empty texts overlap nothing, items without an id are left out; a
    document row given twice is told once, as is an item given twice; rows that
    share a doc_id are told under it; empty tables give an empty result.

    Documents are read once, by a filter of the benchmark's seeds of bounded
    size; what passes it is a seed and the words around it, so texts do not
    move, long ones are cut into cells.  A seed of many items meets documents by
    the words around it too (``hot_pairs``), so a phrase that items share does
    not pair all of them with all documents that have it.  The benchmark's side
    of a join is broadcast if its measured size allows it, and shuffled
    otherwise.
    """
    found = benchmark_overlaps(docs, benchmark, Stage(docs.sparkSession, "decontam"))
    best = found.groupBy("k", "item_id").agg(F.max(F.struct("n_same", "n_overlap", (-F.col("first_word")).alias("f"))).alias("b"))
    return best.select(from_key().alias("doc_id"), "item_id", F.col("b.n_same").alias("n_same"), F.col("b.n_overlap").alias("n_overlap"), (-F.col("b.f")).alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, with all its columns, without the documents that overlap a benchmark item.

    Null and empty texts stay; of rows that share a doc_id those go whose text
    overlaps an item; repeated rows go or stay together; an empty table of
    either kind leaves ``docs`` as it is.
    """
    stage = Stage(docs.sparkSession, "decontam")
    found = benchmark_overlaps(docs, benchmark, stage)
    bad = stage.cut(found.select(F.col("k").alias("_k"), F.col("tk").alias("_tk")).distinct(), "leaks")
    stage.keep(bad)
    if bad.count() <= BROADCAST_DOCS:
        bad = F.broadcast(bad)
    repeats = bad.filter("_tk != 0").take(1)
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    tk = F.xxhash64(F.coalesce("text", F.lit(""))) if repeats else F.lit(0).cast("long")
    return docs.join(bad, (k == bad["_k"]) & (tk == bad["_tk"]), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
