"""MinHash near-dedup with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import HEAVY, components
from .staging import NO_ID, Stage, from_key, has_rows, table
from .vectext import U64, Words, mix, rolled, slices, text_column, tidy

SHINGLE = 5
#: threshold in per cent -> (rows of a band, bands): a pair at the threshold shares no band with probability under 1e-5.
BANDING = {85: (8, 40), 80: (7, 50)}
SKETCH_ROWS = 1 << 11  # documents sketched at a time
STEP = 32  # hashes compared at a time
MISS = 1e-6  # posterior probability below which a pair is given up
BLOCK = 128  # documents on one side of a block comparison
PAIRS = 500  # pairs that are confirmed at a time
PIVOTS = 4  # members of the largest class of a bucket that outliers meet first


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (x[:n] >> U64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> U64(32)).astype(np.uint32)


def shingle_sets(data, offsets, a: int, b: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct shingles of rows a..b, row after row."""
    words = Words(data, offsets, a, b, lower=True)
    h, _ = words.windows(size)
    out, counts = [], []
    for lo, hi in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if hi - lo >= size:
            s = np.unique(h[lo : hi - size + 1])
        elif hi > lo:  # the whole sequence as one
            s = mix(rolled(words.hash[lo:hi], hi - lo) + U64(hi - lo))
        else:
            s = np.zeros(0, U64)
        out.append(s)
        counts.append(len(s))
    return np.concatenate(out) if out else np.zeros(0, U64), np.array(counts, np.int64)


def _sketch_batches(rows: int, bands: int):
    k = rows * bands
    mul, xor = _constants(k)
    weights = mix(np.arange(1, rows + 1, dtype=U64))

    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            for a, b in slices(offsets, rows=SKETCH_ROWS):
                h, counts = shingle_sets(data, offsets, a, b)
                full = np.flatnonzero(counts)
                first = (np.cumsum(counts) - counts)[full]
                m = len(full)
                f1, f2 = np.zeros(b - a, U64), np.zeros(b - a, U64)
                least = np.zeros((b - a, k), np.uint32)
                if m:
                    f1[full] = np.add.reduceat(mix(h), first)
                    f2[full] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), first)
                    v = (h >> U64(32)).astype(np.uint32)
                    for i in range(k):
                        least[full, i] = np.minimum.reduceat((v ^ xor[i]) * mul[i], first)
                keys = np.zeros((b - a, bands), U64)
                for i in range(rows):
                    keys += mix(least[:, i::rows].astype(U64) + weights[i]) * weights[i]
                keys = mix(keys + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))
                sig = ((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
                cut = pa.py_buffer((np.arange(b - a + 1) * k).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k").slice(a, b - a),
                        pa.array(counts),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, cut, pa.py_buffer(sig.tobytes())]),
                        pa.ListArray.from_arrays(pa.array((np.arange(b - a + 1) * bands).astype(np.int32)), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["k", "n", "f1", "f2", "sig", "bands"],
                )

    return run


def least_matches(n: int, threshold: float, miss: float = MISS) -> int:
    """Fewest matches of n hashes with P(similarity >= threshold | matches) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail at t is the lower tail of a binomial of n + 1 trials at m.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def surviving(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, matches) of the pairs x[i], y[j] that no batch of hashes rules out."""
    live = np.arange(len(i))
    same = np.zeros(len(i), np.int64)
    for at in range(0, x.shape[1], STEP):
        to = min(at + STEP, x.shape[1])
        for p in range(0, len(live), 1 << 14):
            part = live[p : p + (1 << 14)]
            same[part] += (x[i[part], at:to] == y[j[part], at:to]).sum(1)
        live = live[same[live] >= least_matches(to, percent / 100)]
        if not len(live):
            break
    return live, same[live]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted distinct sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def exact_sets(sides: list[Words], size: int = SHINGLE) -> list[list[np.ndarray]]:
    """The sets of shingles of each row of each side, as numbers that equal shingles share and no others.

    Words are numbered by a dictionary, then two, four and five words by the
    numbers of their parts, so no hash decides.
    """
    names = pa.concat_arrays([w.names() for w in sides]).dictionary_encode().indices
    word = np.asarray(names).astype(np.int64)
    number, have = word, 1
    steps = []  # parts that make up ``size``: doubled as far as it goes, then one by one
    while have * 2 <= size:
        steps.append(have)
        have *= 2
    steps += [1] * (size - have)
    have = 1
    for step in steps:
        left, right = number[: max(0, len(word) - have - step + 1)], (number if step == have else word)[have:]
        right = right[: len(left)]
        number = np.unique(left * (int(right.max()) + 1 if len(right) else 1) + right, return_inverse=True)[1] if len(left) else left
        have += step
    out, at = [], 0
    whole: dict[bytes, int] = {}  # sequences shorter than a shingle
    for w in sides:
        own = []
        for lo, hi in zip((w.rows[:-1] + at).tolist(), (w.rows[1:] + at).tolist(), strict=True):
            if hi - lo >= size:
                own.append(np.unique(number[lo : hi - size + 1]))
            elif hi > lo:
                own.append(np.array([-1 - whole.setdefault(word[lo:hi].tobytes(), len(whole))], np.int64))
            else:
                own.append(np.zeros(0, np.int64))
        out.append(own)
        at += len(w.start)
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.uint8)


def _prune_batches(percent: int):
    def run(batches):
        for batch in batches:
            i = np.arange(batch.num_rows)
            live, _ = surviving(_matrix(batch.column("sig")), _matrix(batch.column("sig2")), i, i, percent)
            if len(live):
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(live)), batch.column("b").take(pa.array(live))], ["a", "b"])

    return run


def _verified(percent: int):
    """The linked pairs of a block; its rows are texts (k, text) and pairs (k, other)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        other = t.column("other")
        held, pairs = t.filter(other.is_null()), t.filter(other.is_valid())
        k = np.asarray(held.column("k"))
        data, offsets = text_column(held.column("text"))
        sets = exact_sets([Words(data, offsets, 0, len(k), lower=True)])[0]
        at = {x: i for i, x in enumerate(k.tolist())}
        a, b = pairs.column("k").to_pylist(), pairs.column("other").to_pylist()
        good = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if linked(sets[at[x]], sets[at[y]], percent)]
        return pa.table({"a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([b[i] for i in good], pa.int64())})

    return run


def in_blocks(pairs: DataFrame, count: int) -> DataFrame:
    """Pairs (a, b) with a block of about PAIRS of them, in which few ends occur again elsewhere.

    The pairs lie on a grid of the hashes of their ends.  An end of very many
    pairs, at most HEAVY of those, has blocks of its own, by the other end.
    """
    many = max(PAIRS, count // HEAVY)
    grid = max(1, round((count / PAIRS) ** 0.5))
    part = lambda x, n: F.pmod(F.xxhash64(x, F.lit(5)), n)
    out = pairs
    for x in ("a", "b"):
        heavy = pairs.groupBy(x).agg(F.count(F.lit(1)).alias(f"n{x}")).filter(F.col(f"n{x}") > many)
        out = out.join(F.broadcast(heavy), x, "left")
    own = lambda x, y: F.when(F.col(f"n{x}").isNotNull(), F.xxhash64(F.lit(x), x, part(y, F.ceil(F.col(f"n{x}") / PAIRS).cast("long"))))
    return out.select("a", "b", F.coalesce(own("a", "b"), own("b", "a"), F.xxhash64(part("a", F.lit(grid)), part("b", F.lit(grid)))).alias("block"))


def _crossing(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(outliers, members) of a block, of different classes, that no batch of hashes rules out; best matches first.

    A pair counts in the first bucket that it shares only.
    """
    col = lambda x: t.column(x).combine_chunks() if isinstance(t.column(x), pa.ChunkedArray) else t.column(x)
    outlier, label, n, band = (np.asarray(col(x)) for x in ("outlier", "label", "n", "band"))
    sig = _matrix(col("sig"))
    bands = np.asarray(col("bands").flatten()).reshape(len(n), -1)
    i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(outlier), np.flatnonzero(~outlier), indexing="ij"))
    fit = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
    i, j = i[fit], j[fit]
    live, same = surviving(sig, sig, i, j, percent)
    live = live[np.argsort(-same, kind="stable")]
    i, j = i[live], j[live]
    first = np.array([int((bands[x] == bands[y]).argmax()) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    mine = bands[i, first] == band[0] if len(i) else np.zeros(0, bool)
    return i[mine], j[mine]


def _block_ends(percent: int):
    """The rows of a block that stand in a pair that survives: their texts are needed."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        return t.take(pa.array(np.unique(np.concatenate(_crossing(t, percent)))))

    return run


def _block_links(percent: int):
    """Links between the classes of a block, each pair confirmed on its full sets unless its classes are joined by then."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        label, k = np.asarray(t.column("label")), np.asarray(t.column("k"))
        data, offsets = text_column(t.column("text"))
        sets = exact_sets([Words(data, offsets, 0, len(k), lower=True)])[0]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found = []
        for x, y in zip(*(side.tolist() for side in _crossing(t, percent)), strict=True):
            a, b = root(int(label[x])), root(int(label[y]))
            if a != b and linked(sets[x], sets[y], percent):
                parent[max(a, b)] = min(a, b)
                found.append((int(k[x]), int(k[y])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class Linker:
    """Confirms candidate pairs and keeps the link class of every document in a bucket."""

    def __init__(self, stage: Stage, reps: DataFrame, members: DataFrame, texts: DataFrame, percent: int):
        self.stage, self.reps, self.members, self.texts, self.percent = stage, reps, members, texts, percent
        self.labels = None  # k, label of the documents with a link

    def confirm(self, pairs: DataFrame) -> None:
        """Verify staged pairs (a, b) on their full sets and join the classes of those that are linked."""
        dealt = self.stage.cut(in_blocks(pairs, pairs.count()), "dealt")
        held = dealt.select("block", F.col("a").alias("k")).union(dealt.select("block", "b")).distinct().join(self.texts, "k")
        rows = held.select("block", "k", "text", F.lit(None).cast("long").alias("other"))
        rows = rows.union(dealt.select("block", "a", F.lit(None).cast("string"), "b"))
        self._join(self.stage.cut(rows.groupBy("block").applyInArrow(_verified(self.percent), "a bigint, b bigint"), "links"))
        self.stage.drop(dealt)

    def _join(self, links: DataFrame) -> None:
        if self.labels is None:
            self.labels = self.stage.cut(components(self.stage, links).select(F.col("node").alias("k"), "label"), "labels")
            return
        if not has_rows(links):
            return
        ends = self._labelled(links.select(F.col("a").alias("k"), "b")).select(F.col("label").alias("a"), F.col("b").alias("k"))
        ends = self._labelled(ends.select("a", "k")).select("a", F.col("label").alias("b"))
        joined = self.stage.cut(components(self.stage, ends).select(F.col("node").alias("label"), F.col("label").alias("least")), "joined")
        known = self.labels.unionByName(joined.select(F.col("label").alias("k"), "label")).distinct()
        self.labels = self.stage.cut(known.join(joined, "label", "left").groupBy("k").agg(F.min(F.coalesce("least", "label")).alias("label")), "labels")

    def prune(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose posterior of reaching the threshold holds through all batches of hashes."""
        left = self.reps.select(F.col("k").alias("a"), "n", "sig")
        right = self.reps.select(F.col("k").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))
        sized = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * self.percent
        pairs = pairs.join(left, "a").join(right, "b").filter(sized).select("a", "b", "sig", "sig2")
        return self.stage.cut(pairs.mapInArrow(tidy(_prune_batches(self.percent)), "a bigint, b bigint").distinct(), "survivors")

    def _labelled(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.labels, "k", "left").withColumn("label", F.coalesce("label", "k"))

    def mixed(self) -> tuple[DataFrame, DataFrame]:
        """(band, k, label) of the members of buckets with several classes, and (band, top, members, outliers, pivots).

        A bucket of two has had its only pair compared.
        """
        rows = self._labelled(self.members.filter("c > 2").select("band", "k"))
        pick = [F.min(F.struct(F.xxhash64("k", F.lit(i)).alias("h"), F.col("k").alias("k"))).alias(f"p{i}") for i in range(PIVOTS)]
        sizes = rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"), *pick)
        own = F.struct("c", "label", *[F.col(f"p{i}.k").alias(f"p{i}") for i in range(PIVOTS)])
        bands = sizes.groupBy("band").agg(F.sum("c").alias("members"), F.count(F.lit(1)).alias("classes"), F.max(own).alias("top")).filter("classes > 1")
        pivots = F.array_distinct(F.array(*[F.col(f"top.p{i}") for i in range(PIVOTS)]))
        bands = self.stage.cut(bands.select("band", F.col("top.label").alias("top"), "members", (F.col("members") - F.col("top.c")).alias("outliers"), pivots.alias("pivots")), "mixed")
        return rows.join(bands.select("band"), "band"), bands

    def by_pivots(self) -> None:
        """Outliers of each bucket against a few members of its largest class."""
        rows, bands = self.mixed()
        out = rows.join(bands.select("band", "top", "pivots"), "band").filter("label != top").select("k", F.explode("pivots").alias("p"))
        self.confirm(self.prune(out.select(F.col("k").alias("a"), F.col("p").alias("b")).distinct()))

    def by_blocks(self) -> None:
        """Outliers of each bucket against all its members, in blocks of about BLOCK by BLOCK.

        Blocks are compared by signatures first, and again with the texts of the
        documents in a pair that survived: those pairs are confirmed where they
        lie, and only links leave a block.
        """
        rows, bands = self.mixed()
        if not has_rows(bands):
            return
        parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        rows = rows.join(bands.select("band", "top", parts("members").alias("mb"), parts("outliers").alias("ob")), "band").join(self.reps, "k")
        place = lambda parts, seed: F.pmod(F.xxhash64("k", F.lit(seed)), parts).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
        own = ["band", "k", "label", "n", "sig", "bands"]
        members = rows.select(*own, F.lit(False).alias("outlier"), place(F.col("mb"), 1).alias("j"), every(F.col("ob")).alias("i"))
        outliers = rows.filter("label != top").select(*own, F.lit(True).alias("outlier"), place(F.col("ob"), 2).alias("i"), every(F.col("mb")).alias("j"))
        both = members.unionByName(outliers)
        ends = self.stage.cut(both.groupBy("band", "i", "j").applyInArrow(_block_ends(self.percent), both.schema), "ends")
        held = ends.join(self.texts, "k").groupBy("band", "i", "j")
        self._join(self.stage.cut(held.applyInArrow(_block_links(self.percent), "a bigint, b bigint"), "crossing"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Takes doc_id and text, whatever other columns there are.  A document's set
    is its distinct 5-word shingles over lower-cased words (A-Z; words are runs
    outside ASCII white space), or its whole sequence of words if shorter.  Two
    documents are linked when 100 * intersection >= percent * union;
    component_id is the least doc_id reachable and kept tells whether it is the
    document's own.

    Equal sets form classes by a 128-bit fingerprint, and each class goes on as
    its least document.  Minhash bands give buckets of candidates.  Signature
    batches drop pairs whose posterior of reaching the threshold falls below
    1e-6, and the rest are confirmed on the words of their full sets.  First
    every member of a bucket is compared with its least document; then, in
    buckets whose members are of several link classes, those outside the
    largest one with a few of its members; and where classes still differ,
    with all members, in blocks of signatures.  So every two documents that
    share a bucket are compared unless they are in one class already, and no
    class is expanded into pairs.

    Null or empty texts have no shingles and stand alone; so do rows with a
    null doc_id (component_id null, kept).  Rows that share a doc_id are one
    document for linking; repeated rows give a row each; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    rows, bands = BANDING[percent]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = stage.cut(keyed.mapInArrow(tidy(_sketch_batches(rows, bands)), "k bigint, n bigint, f1 bigint, f2 bigint, sig binary, bands array<bigint>"), "sketches")
    set_key = ["f1", "f2", "n"]
    some = sketch.filter((F.col("n") > 0) & (F.col("k") != NO_ID))
    classes = stage.cut(some.groupBy(set_key).agg(F.min("k").alias("rep")), "classes")
    reps = stage.cut(some.join(classes.withColumnRenamed("rep", "k"), [*set_key, "k"]).select("k", "n", "sig", "bands"), "reps")

    spread = reps.select("k", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("k").alias("b"), F.max("k").alias("top"), F.count(F.lit(1)).alias("c")).filter("b < top").select("band", "b", "c")
    buckets = stage.cut(buckets, "buckets")
    members = stage.cut(spread.join(buckets, "band"), "members")
    stage.drop(buckets)
    texts = stage.cut(keyed.join(stage.cut(members.select("k").distinct(), "candidates"), "k"), "texts")
    link = Linker(stage, reps, members, texts, percent)
    link.confirm(link.prune(members.filter("k != b").select(F.col("k").alias("a"), "b").distinct()))
    link.by_pivots()
    link.by_blocks()

    nodes = link.labels.select(F.col("k").alias("rep"), F.col("label").alias("component"))
    known = stage.cut(classes.join(nodes, "rep", "left").select(*set_key, F.coalesce("component", "rep").alias("component")), "components")
    stage.keep(sketch, known)
    mine = F.when(F.col("k") != NO_ID, F.coalesce("component", "k"))
    # null ids share a key with nothing: their sets are looked up, but not used
    out = sketch.select("k", *set_key).join(known, set_key, "left").select(from_key().alias("doc_id"), F.col("n").alias("n_shingles"), mine.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs``, with all its columns, with one document of each component: the least.

    Null and empty texts and rows with a null doc_id stay, repeated or not.  Of
    rows that share a doc_id one stays, that of the least hash of its columns.
    An empty table gives an empty one.
    """
    stage = Stage(docs.sparkSession, "neardup")
    gone = stage.cut(near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    out = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if has_rows(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")):
        row = F.xxhash64(F.to_json(F.struct(*docs.columns)))
        first = out.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(row).alias("_row"))
        one = out.withColumn("_hash", row).join(first, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_row")), "left_semi")
        out = one.drop("_hash").dropDuplicates(["doc_id"]).unionByName(out.filter("doc_id is null"))
    return out


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
