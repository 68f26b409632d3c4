"""Language-model scores: context-tree weighting over binary-decomposed bytes.

The last DEPTH bytes are the context of a byte, which eight binary decisions
spell, the highest bit first.  A node is a context of 0 to DEPTH bytes and the
bits told so far; it holds how often 0 and 1 followed in training, the
Krichevsky-Trofimov probability of that, and its mixture, half and half, with the
product over the contexts that are one byte longer.  All of it follows from
one table, the counts of (context, byte) in the corpus, which grows with it and
is never held whole: nodes of the last three context bytes or more are worked
out in groups that share these bytes (at most 2 ** 24 rows each, whatever the
corpus), the shallower ones by three aggregations of at most 2 ** 24, 65,280 and
255 rows.

Documents are dealt into blocks.  A block asks once for each (context, byte)
and each token in it, learns counts and probabilities by a join, and scores
its texts; so a task holds one block and its distinct questions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, table
from .vectext import release, slices, text_column, tidy

DEPTH, SPLIT = 5, 3  # bytes of a context; of them those that a group shares
BLOCK = 32 << 20  # bytes of text; a longer text is a block
SLICE = 1 << 20  # bytes of text whose contexts are looked up together
WORDS = 2 << 20  # and whose words are
PENDING = 2 << 20  # distinct contexts of slices that wait to be merged
CHUNK = 1 << 18  # rows of the counts that are worked out together, whole groups at least
EDGE = 255  # no byte of UTF-8; fills the context at the start, and ends a text
FOUND = "block bigint, gram bigint, token string, n bigint"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = _LOWER.copy()
_BLANK[9:14] = 32


# ---- texts -----------------------------------------------------------------


def _blocks(batches):
    """The rows with the number of their block: runs of rows of a partition of BLOCK bytes."""
    from pyspark import TaskContext

    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        _, offsets = text_column(batch.column("text"))
        ends = offsets[1:] - offsets[0]
        names = np.zeros(len(ends), np.int64)
        start = 0
        while start < len(ends):
            base = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, base + BLOCK - held, "right")), start + (held == 0))
            names[start:stop] = block
            if stop < len(ends):
                block, held = block + 1, 0
            else:
                held += int(ends[-1]) - base
            start = stop
        yield pa.RecordBatch.from_arrays([pa.array(names), *batch.columns], ["block", *batch.schema.names])


def grams(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of each byte and end of rows a..b, A-Z lower-cased: the context, nearest byte first, then the byte."""
    lo, hi = int(offsets[a]), int(offsets[b])
    size = np.diff(offsets[a : b + 1])
    start = np.cumsum(size + DEPTH + 1) - (size + DEPTH + 1)
    text = np.full(hi - lo + (b - a) * (DEPTH + 1), EDGE, np.uint8)
    inside = np.ones(len(text), bool)
    for i in range(DEPTH):
        inside[start + i] = False
    told = inside.copy()
    inside[start + DEPTH + size] = False
    text[inside] = _LOWER[data[lo:hi]]
    key = np.zeros(len(text) - DEPTH, np.uint64)
    for i in range(1, DEPTH + 1):
        key = (key << np.uint64(8)) | text[DEPTH - i : len(text) - i]
    key = (key << np.uint64(8)) | text[DEPTH:]
    return key[told[DEPTH:]], np.repeat(np.arange(b - a), size + 1)


def tokens(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(tokens, their rows) of rows a..b: lower-cased words, and the empty token that ends each text."""
    lo, hi = int(offsets[a]), int(offsets[b])
    text = _BLANK[data[lo:hi]]
    cuts = offsets[a : b + 1] - lo
    word = text != 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = cuts[:-1][cuts[:-1] < hi - lo]
    begins[inner] = word[inner]
    start = np.flatnonzero(begins)
    at = (np.cumsum(word) - word)[start]
    edges = np.r_[at, np.full(b - a + 1, np.count_nonzero(word))].astype(np.int32)  # then the ends, which are empty
    flat = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(text[word])])
    return flat.dictionary_encode(), np.r_[np.searchsorted(cuts, start, "right") - 1, np.arange(b - a)]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


class _Questions:
    """Distinct grams and tokens of a block, with their counts in training texts."""

    def __init__(self):
        self.keys, self.n = [], []
        self.names, self.c = [], []
        self.waiting = 0

    def add(self, data, offsets, a, b, learn: np.ndarray) -> None:
        key, row = grams(data, offsets, a, b)
        key = np.sort((key << np.uint64(1)) | learn[row].astype(np.uint64))
        at = _runs(key >> np.uint64(1))
        self.keys.append(key[at] >> np.uint64(1))
        self.n.append(np.add.reduceat((key & np.uint64(1)).astype(np.int64), at))
        word, row = tokens(data, offsets, a, b)
        self.names.append(word.dictionary)
        self.c.append(np.bincount(word.indices.to_numpy(), learn[row], len(word.dictionary)).astype(np.int64))
        self.waiting += len(at)
        if self.waiting > PENDING:
            self.merge()

    def merge(self) -> None:
        key, n = np.concatenate(self.keys), np.concatenate(self.n)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = _runs(key)
        self.keys, self.n = [key[at]], [np.add.reduceat(n[order], at)]
        names = pa.concat_arrays(self.names).dictionary_encode()
        c = np.bincount(names.indices.to_numpy(), np.concatenate(self.c), len(names.dictionary)).astype(np.int64)
        self.names, self.c, self.waiting = [names.dictionary], [c], 0

    def told(self, block: int):
        self.merge()
        for name, values, counts in (("gram", pa.array(self.keys[0].astype(np.int64)), self.n[0]), ("token", self.names[0].cast(pa.string()), self.c[0])):
            for i in range(0, len(values), 1 << 16):
                part = values[i : i + (1 << 16)]
                none = {"gram": pa.nulls(len(part), pa.int64()), "token": pa.nulls(len(part), pa.string())}
                columns = none | {"block": pa.array(np.full(len(part), block)), "n": pa.array(counts[i : i + (1 << 16)]), name: part}
                yield pa.RecordBatch.from_arrays([columns[x] for x in ("block", "gram", "token", "n")], ["block", "gram", "token", "n"])


def _ask(batches):
    now, block = None, None
    for batch in batches:
        data, offsets = text_column(batch.column("text"))
        names = batch.column("block").to_numpy()
        learn = ~np.asarray(batch.column("held_out"))
        edges = np.r_[_runs(names), len(names)]
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if now is not None and names[first] != block:
                yield from now.told(block)
                now = None
            block, now = int(names[first]), now or _Questions()
            part = offsets[first : last + 1]
            for a, b in slices(part, SLICE):
                now.add(data, part, a, b, learn[first + a : first + b])
    if now is not None:
        yield from now.told(block)


# ---- the tree --------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of numbers from 1/2 on, by Stirling's series from 8 above."""
    low, y = np.ones_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        low = np.where(small, low * y, low)
        y = y + small
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - np.log(np.pi)


def weigh(zeros, ones, below) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the mixture, weight of the own estimate, its probability of a one) of nodes; ``below`` is the log of the product over their children."""
    own = log_kt(zeros, ones)
    both = np.logaddexp(own, below)
    return both - np.log(2), np.exp(own - both), (ones + 0.5) / (zeros + ones + 1)


def _parent(node: np.ndarray) -> np.ndarray:
    """A node (context, bits) without the farthest byte of the context."""
    return ((node >> 16) << 8) | (node & 255)


class _Bit:
    """The nodes of one binary decision of sorted grams, from depth DEPTH up to SPLIT."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, k: int):
        byte = gram & 255
        self.one = (byte >> (7 - k)) & 1
        node = ((gram >> 8) << 8) | ((256 | byte) >> (8 - k))
        at = _runs(node)
        self.of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(node)]))  # the node of each gram
        zeros = np.add.reduceat(n * (1 - self.one), at).astype(float)
        ones = np.add.reduceat(n * self.one, at).astype(float)
        log = log_kt(zeros, ones)
        self.levels = [(node[at], zeros, ones, log, None, (ones + 0.5) / (zeros + ones + 1), None)]
        for _ in range(DEPTH - SPLIT):
            node, zeros, ones, log = self.levels[-1][:4]
            up, to = np.unique(_parent(node), return_inverse=True)
            zeros, ones, below = (np.bincount(to, x, len(up)) for x in (zeros, ones, log))
            log, w, p = weigh(zeros, ones, below)
            self.levels.append((up, zeros, ones, log, w, p, to))

    def predicted(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each gram's bit; a, b, q are what the shallower nodes give to the node at ``keys``."""
        at = np.searchsorted(keys, self.levels[-1][0])
        a, b, q = a[at], b[at], q[at]
        for depth in range(DEPTH - SPLIT, -1, -1):
            _, zeros, ones, _, w, p, _ = self.levels[depth]
            q = np.where(zeros + ones > 0, a + b * p, q)  # contexts that training has not seen tell nothing
            if depth:
                down = self.levels[depth][6]
                a, b = (a + b * w * p)[down], (b * (1 - w))[down]
                q = q[down]
        q = q[self.of]
        return np.log10(np.where(self.one == 1, q, 1 - q))


def _groups(batches, names: list[str]):
    """Columns of rows sorted by ``part``, as arrays of whole groups of at least CHUNK rows."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([batch.column(x).to_numpy(zero_copy_only=False) for x in names])
        rows += batch.num_rows
        if rows >= CHUNK:
            one = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(one[0], one[0][-1]))
            if last:
                yield [x[:last] for x in one]
            held, rows = [[x[last:] for x in one]], rows - last
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _deep_nodes(batches):
    """Nodes of depth SPLIT with counts and mixtures, of grams sorted by their first bytes and themselves."""
    for _, gram, n in _groups(batches, ["part", "gram", "n"]):
        for k in range(8):
            node, zeros, ones, log, *_ = _Bit(gram, n, k).levels[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, zeros, ones, log)], ["node", "zeros", "ones", "log"])


def _weighed(batches):
    for batch in batches:
        zeros, ones, below = (batch.column(x).to_numpy() for x in ("zeros", "ones", "below"))
        log, w, p = weigh(zeros, ones, below)
        yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(x) for x in (zeros, ones, log, w, p))], ["node", "zeros", "ones", "log", "w", "p"])


def _probabilities(batches):
    """gram and log10 of its probability, of grams and of nodes of depth SPLIT with what comes from above, sorted alike."""
    for _, kind, gram, n, a, b, q in _groups(batches, ["part", "kind", "gram", "n", "a", "b", "q"]):
        above, own = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        order = above[np.argsort(gram[above], kind="stable")]
        keys, a, b, q = gram[order], a[order], b[order], q[order]
        gram, n = gram[own], n[own]
        total = np.zeros(len(gram))
        for k in range(8):
            total += _Bit(gram, n, k).predicted(keys, a, b, q)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(total)], ["gram", "value"])


def model(stage: Stage, counts: DataFrame) -> DataFrame:
    """(gram, value): log10 of the probability of the byte of each gram in its context, by staged ``counts`` (gram, n) of training."""
    first = F.shiftright("gram", 8 * (DEPTH - SPLIT + 1))
    part = counts.select(first.alias("part"), "gram", "n").repartition("part").sortWithinPartitions("part", "gram")
    deep = stage.cut(part.mapInArrow(tidy(_deep_nodes), "node bigint, zeros double, ones double, log double"), "nodes")
    up = lambda c: F.shiftleft(F.shiftright(c, 16), 8) + c.bitwiseAND(255)
    levels, below = [], deep
    for _ in range(SPLIT):
        sums = below.groupBy(up(F.col("node")).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("below"))
        below = stage.cut(sums.mapInArrow(tidy(_weighed), "node bigint, zeros double, ones double, log double, w double, p double"), "nodes")
        levels.append(below)
    # from the root down: a + b * (what a longer context says) is the mixture so far, q the deepest estimate with data
    above, seen = None, F.col("zeros") + F.col("ones") > 0
    for depth, level in enumerate(reversed(levels)):
        own = level.select("node", "w", "p", seen.alias("seen"))
        if above is None:
            above = own.select("node", (F.col("w") * F.col("p")).alias("a"), (1 - F.col("w")).alias("b"), F.col("p").alias("q"))
            continue
        # at most 255 nodes without a context, 65,280 with one byte of it
        own = own.withColumn("up", up(F.col("node"))).join(F.broadcast(above.withColumnRenamed("node", "up")), "up")
        told = F.when(F.col("seen"), F.col("a") + F.col("b") * F.col("p")).otherwise(F.col("q"))
        above = own.select("node", (F.col("a") + F.col("b") * F.col("w") * F.col("p")).alias("a"), (F.col("b") * (1 - F.col("w"))).alias("b"), told.alias("q"))
    node = deep.select("node").withColumn("up", up(F.col("node"))).join(above.withColumnRenamed("node", "up"), "up")
    node = node.select(F.shiftright("node", 8).alias("part"), F.lit(0).alias("kind"), F.col("node").alias("gram"), F.lit(0).cast("long").alias("n"), "a", "b", "q")
    zero = F.lit(0.0)
    own = counts.select(first.alias("part"), F.lit(1).alias("kind"), "gram", "n", zero.alias("a"), zero.alias("b"), zero.alias("q"))
    rows = node.unionByName(own).repartition("part").sortWithinPartitions("part", "kind", "gram")
    out = stage.cut(rows.mapInArrow(tidy(_probabilities), "gram bigint, value double"), "model")
    stage.drop(deep, *levels)
    return out


# ---- scores ----------------------------------------------------------------


def _score(n_all: int, n_kinds: int):
    floor = np.log10(n_all + n_kinds + 1)

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        one = told.select(["gram", "value"]).filter(pc.is_valid(told.column("gram")))
        key = one.column("gram").to_numpy().astype(np.uint64)
        order = np.argsort(key)
        key, value = key[order], one.column("value").to_numpy()[order]
        one = told.select(["token", "n"]).filter(pc.is_valid(told.column("token")))
        words = one.column("token").combine_chunks().cast(pa.binary())
        count = one.column("n").to_numpy()
        del told, one, order
        out = []
        for batch in docs.to_batches():
            data, offsets = text_column(batch.column("text"))
            score = np.zeros(batch.num_rows)
            for a, b in slices(offsets, SLICE):
                gram, row = grams(data, offsets, a, b)
                packed = np.sort((gram << np.uint64(16)) | row.astype(np.uint64))  # a slice has fewer rows than 2 ** 16
                gram = packed >> np.uint64(16)
                at = _runs(gram)
                logs = np.repeat(value[np.searchsorted(key, gram[at])], np.diff(np.r_[at, len(gram)]))
                score[a:b] = np.bincount((packed & np.uint64(0xFFFF)).astype(np.int64), logs, b - a)
            for a, b in slices(offsets, WORDS):
                word, row = tokens(data, offsets, a, b)
                c = count[pc.index_in(word.dictionary, words).to_numpy()][word.indices.to_numpy()]
                base = np.bincount(row, np.log10(c + 1.0) - floor, b - a)
                known = np.bincount(row, c > 0, b - a).astype(np.int64)
                n = np.bincount(row, minlength=b - a)
                size = np.diff(offsets[a : b + 1])
                part = batch.slice(a, b - a)
                columns = [part.column("doc_id"), part.column("held_out"), *(pa.array(x) for x in (n, known, base, score[a:b], size + 1))]
                out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]))
        del docs, key, value, words, count
        release()
        return pa.Table.from_batches(out)

    return run


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each document.

    The models learn from the documents where ``held_out`` is false or null.
    A-Z are lower-cased.  ``score`` is log10 of the probability of all bytes of
    the text and its end, by context-tree weighting with contexts of up to DEPTH
    bytes; a longer context that training has not seen tells nothing, so the
    longest one seen has the last word, and the probabilities of the bytes
    still add up to one.  bits_per_byte is its code length over the bytes, the
    end included.  ``base_score`` is the unigram score with 1 added to each
    count.  A null or empty text has its end alone; null ids and repeated rows
    give rows of their own, and are learnt from each time; other columns are
    ignored; an empty table gives an empty result.  A text of any length is one
    row of its block, walked in slices only between rows, so one task must hold
    it some thirty times over.
    """
    stage = Stage(docs.sparkSession, "ctw")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = stage.cut(rows.mapInArrow(tidy(_blocks), f"block bigint, doc_id {kind}, held_out boolean, text string"), "blocks", "zstd")
    asked = stage.cut(blocks.select("block", "held_out", "text").mapInArrow(tidy(_ask), FOUND), "asked")
    by_gram, by_token = asked.filter("gram is not null"), asked.filter("token is not null")
    counts = stage.cut(by_gram.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    words = stage.cut(by_token.groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    values = model(stage, counts)
    none = F.lit(None)
    told = by_gram.select("block", "gram").join(values, "gram").select("block", "gram", none.cast("string").alias("token"), "value", none.cast("long").alias("n"))
    told = told.unionByName(by_token.select("block", "token").join(words, "token").select("block", none.cast("long").alias("gram"), "token", none.cast("double").alias("value"), "n"))
    told = stage.cut(told, "told", "zstd")
    stage.keep(blocks, told)
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint"
    out = stage.cut(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(*total), schema), "scores")
    stage.keep(out)
    bits = (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total[0]).cast("long").alias("train_tokens"), "base_score", "score", bits)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
