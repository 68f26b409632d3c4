"""Greedy selection and running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import frame_budget


def distinct_hashes(hashes: Column, min_bits: int = 8) -> Column:
    """Indices kept by a greedy pass: at least ``min_bits`` from every kept hash; null always."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    far = lambda kept, x: F.forall(kept, lambda k: F.coalesce(F.bit_count(k["h"].bitwiseXOR(x["h"])) >= min_bits, F.lit(True)))
    kept = F.aggregate(placed, empty, lambda acc, x: F.when(x["h"].isNull() | far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return F.transform(kept, lambda x: x["i"])


def frame_plan(duration: Column, highlights: Column, budget: Column | None = None) -> Column:
    """Ascending timestamps to sample: head, tail, the midpoints of highlights in their order, then even spacing."""
    total = frame_budget(duration) if budget is None else budget
    gap = F.greatest(F.lit(0.4), duration / total / 2)
    head = F.bround(F.least(F.lit(1.0), 0.05 * duration), 3)
    tail = F.bround(F.least(F.greatest(duration - 1.5, 0.95 * duration), F.greatest(duration - 0.05, F.lit(0.0))), 3)
    middle = F.coalesce(F.transform(highlights, lambda h: F.bround(h, 3)), F.array().cast("array<double>"))
    even = F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda i: F.bround(duration * i / (total + 1), 3))
    wanted = F.concat(F.array(tail), middle, even)
    fits = lambda acc, t: (F.size(acc) < total) & (t >= 0) & (t <= duration) & F.forall(acc, lambda x: F.abs(x - t) >= gap)
    taken = F.aggregate(wanted, F.array(head), lambda acc, t: F.when(fits(acc, t), F.concat(acc, F.array(t))).otherwise(acc))
    return F.when((duration <= 0) | (total <= 0), F.array().cast("array<double>")).otherwise(F.array_sort(taken))


def moments(found: Column, duration: Column, wanted: int) -> Column:
    """The first ``wanted`` of (start, end, why) that begin in the recording, their ends clamped to it."""
    usable = F.filter(found, lambda m: m["start"].isNotNull() & (m["start"] >= 0) & (m["start"] <= duration))
    clamp = lambda m: F.struct(m["start"].alias("start"), F.least(F.greatest(F.coalesce(m["end"], m["start"]), m["start"]), duration).alias("end"), F.substring(F.trim(F.coalesce(m["why"], F.lit(""))), 1, 80).alias("why"))
    return F.transform(F.slice(F.coalesce(usable, F.array().cast("array<struct<start:double,end:double,why:string>>")), 1, wanted), clamp)


def within_budget(rows: DataFrame, group: list[str], order: list, size: Column, budget: int, most: int | None = None) -> DataFrame:
    """Rows of each group while their running size stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    keep = F.col("used") <= budget
    return out.filter(keep & (F.col("rank") <= most) if most else keep)


def limited_sets(sets: DataFrame, limit: int) -> DataFrame:
    """The leading sets (by ord) while their files stay within the limit; the first always.

    Every set has a file, so only the first ``limit`` sets, or one, can be taken.
    """
    w = Window.orderBy("ord")
    sets = sets.orderBy("ord").limit(max(1, limit))
    out = sets.withColumn("used", F.sum("n_files").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    return out.filter((F.col("rank") == 1) | (F.col("used") <= limit))
