"""Embedding whitening: blockwise TSQR of the centred rows, one-sided Jacobi on R.

Four scans of the vectors.  The first adds up integers, the second compresses
each partition's centred rows to one triangle R, which are merged by the dozen
on the executors, the third measures the whitened covariance, the last writes.
Only sums over a dimension or a pair of components reach the driver, and one R.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, table
from .vectext import tidy

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
ROWS = 4096  # of a block
FAN = 12  # triangles that one task merges
LARGEST = 2.0**62


def vectors(batch: pa.RecordBatch, d: int | None = None):
    """(ids, x) of the valid rows in blocks; x holds a row of longs for each, all of ``d`` entries where given."""
    col = batch.column("v")
    size = np.diff(np.asarray(col.offsets, np.int64))
    size[np.asarray(col.is_null())] = 0
    flat = col.flatten()
    c = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), np.float64)
    bad = ~(np.abs(np.floor(SCALE * c)) < LARGEST)
    start = np.cumsum(size) - size
    n_bad = np.r_[0, np.cumsum(bad)]
    fine = (size > 0) & (n_bad[start + size] == n_bad[start])
    ids = batch.column("id")
    for k in [d] if d else np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == k))
        for i in range(0, len(rows), ROWS):
            part = rows[i : i + ROWS]
            x = np.floor(SCALE * c[start[part][:, None] + np.arange(k)]).astype(np.int64) + SHIFT
            yield ids.take(pa.array(part)), x


def _sums(batches):
    """Sums of the upper and lower halves of the entries by length and dimension, and the largest entry."""
    total: dict[int, list] = {}
    for batch in batches:
        for _, x in vectors(batch):
            t = total.setdefault(x.shape[1], [0, 0, 0, 0])
            t[0] += len(x)
            t[1] = t[1] + (x >> 32).sum(0)
            t[2] = t[2] + (x & 0xFFFFFFFF).sum(0)
            t[3] = max(t[3], int(np.abs(x).max()))
    for d, (n, high, low, most) in total.items():
        one = np.full(d, 1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (d * one, np.arange(d), n * one, high, low, most * one)], ["d", "i", "n", "high", "low", "most"])


class Centre:
    """Exact n * x - S, and what follows from it; whole numbers of Python where 64 bits may not do."""

    def __init__(self, n: int, s: list[int], most: int):
        self.n = n
        self.wide = 2 * n * most >= 1 << 62
        self.s = np.array(s, object if self.wide else np.int64)

    def exact(self, x: np.ndarray) -> np.ndarray:
        return self.n * (x.astype(object) if self.wide else x) - self.s

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n"""
        return (self.exact(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S) ** 2 of each row."""
        y = self.exact(x)
        if self.wide or (y.astype(np.float64) ** 2).sum(1).max() > 9e18:
            y = y.astype(object)
        return (y * y).sum(1).tolist()


def _fold(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")


def _square(r: np.ndarray, d: int) -> bytes:
    return np.vstack([r, np.zeros((d - len(r), d))]).tobytes()


def _triangles(d: int, centre: Centre):
    def run(batches):
        r = None
        for batch in batches:
            for _, x in vectors(batch, d):
                r = _fold(r, centre.rows(x))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([_square(r, d)], pa.binary())})

    return run


def _merged(d: int):
    def run(group: pa.Table) -> pa.Table:
        r = None
        for one in group.column("r").to_pylist():
            r = _fold(r, np.frombuffer(one).reshape(d, d))
        return pa.table({"r": pa.array([_square(r, d)], pa.binary())})

    return run


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) of a square matrix, by one-sided rotations.

    A sweep takes every pair of columns once, d / 2 disjoint pairs at a time;
    it ends when no pair is farther from a right angle than rounding.
    """
    d = r.shape[1]
    m = d + d % 2
    a, v = np.zeros((len(r), m)), np.eye(m)
    a[:, :d] = r
    ring = np.arange(m)
    for _ in range(sweeps):
        turned = False
        for _ in range(m - 1):
            p, q = ring[: m // 2], ring[: m // 2 - 1 : -1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if on.any():
                turned = True
                z = (yy - xx) / np.where(on, 2 * xy, 1.0)
                t = np.where(on, np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                x, y = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * x - s * y, s * x + c * y
            ring = np.r_[ring[:1], np.roll(ring[1:], 1)]
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))[:d] if m == d else np.sqrt((a * a).sum(0))
    if m != d:  # the column that made the count even stays zero and apart
        keep = np.flatnonzero(np.abs(v[d]) < 0.5)
        sigma, v = sigma[keep], v[:d, keep]
    order = np.argsort(-sigma, kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return sigma[order], v * sign


def _grams(d: int, centre: Centre, turn: np.ndarray):
    """Sum of the products of each pair of whitened components over a partition."""

    def run(batches):
        total = None
        for batch in batches:
            for _, x in vectors(batch, d):
                w = centre.rows(x) @ turn
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            k = turn.shape[1]
            i = np.arange(k * k)
            yield pa.RecordBatch.from_arrays([pa.array(i // k), pa.array(i % k), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def _whitened(d: int, centre: Centre, turn: np.ndarray):
    def run(batches):
        k = turn.shape[1]
        for batch in batches:
            for ids, x in vectors(batch, d):
                w = centre.rows(x) @ turn
                at = np.repeat(np.arange(len(x)), k)
                dev = pa.array(centre.deviation(x), pa.decimal128(38, 0)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), dev, pa.array(w.ravel())], ["vec_id", "component", "deviation", "whitened"])

    return run


def whitening(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each valid row and component.

    A row is valid where its vector holds neither nulls nor numbers that are
    not finite or whose 64-fold leaves 62 bits, and at least one entry; its
    entries c become x = floor(64 c) + 1000000.  Where the valid vectors differ
    in length, those of the most frequent length count (the longest on ties)
    and the others give no row.  ``deviation`` is a decimal(38,0).  Components
    are numbered by falling variance; those without any (numerically, rank
    below the dimension) are left out, as their whitened values don't exist, so
    equal vectors alone give an empty result, as an empty table does.  Null and
    repeated ids give rows of their own; other columns are ignored.

    No key is shuffled: partitions are summed and compressed alone, so hot keys
    and copies change nothing.  A task holds a block of 4,096 rows and two
    triangles, the driver one triangle and a sum for each pair of components.
    """
    stage = Stage(table.sparkSession, "whiten")
    kind = table.schema[id_column].dataType
    rows = table.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v")).filter("v is not null")
    out_schema = f"vec_id {kind.simpleString()}, component int, deviation decimal(38,0), whitened double"

    sums = rows.mapInArrow(tidy(_sums), "d bigint, i bigint, n bigint, high bigint, low bigint, most bigint")
    sums = sums.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.max("most").alias("most"))
    sums = stage.cut(sums, "sums")
    best = sums.groupBy("d").agg(F.max("n").alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = table.sparkSession.createDataFrame([], f"{out_schema}, n bigint, explained double, identity_error double").select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    if best is None:
        return empty
    d, n = best["d"], best["n"]
    s = [(r["high"] << 32) + r["low"] for r in sorted(sums.filter(F.col("d") == d).collect(), key=lambda r: r["i"])]  # one row a dimension
    centre = Centre(n, s, best["most"])

    part = stage.cut(rows.mapInArrow(tidy(_triangles(d, centre)), "r binary").withColumn("i", F.spark_partition_id()), "triangles")
    while part.count() > 1:
        merged = part.withColumn("i", F.floor(F.col("i") / FAN).cast("int")).groupBy("i").applyInArrow(lambda key, g: _merged(d)(g).append_column("i", pa.array([key[0].as_py()], pa.int32())), "r binary, i int")
        part = stage.cut(merged, "merged")
    r = np.frombuffer(part.first()["r"]).reshape(d, d)
    sigma, v = jacobi(r)
    k = min(components, int((sigma > sigma[0] * d * np.finfo(float).eps).sum()) if sigma[0] > 0 else 0)
    if not k:
        return empty
    turn = v[:, :k] * (np.sqrt(n) / sigma[:k])  # whitens a centred row
    explained = (sigma**2 / (sigma**2).sum())[:k]

    grams = rows.mapInArrow(tidy(_grams(d, centre, turn)), "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    error = grams.agg(F.max(F.abs(F.col("s") / n - (F.col("i") == F.col("j")).cast("double")))).first()[0]
    out = rows.mapInArrow(tidy(_whitened(d, centre, turn)), out_schema)
    share = F.get(F.array(*map(F.lit, explained.tolist())), F.col("component") - 1)
    stage.keep()
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
