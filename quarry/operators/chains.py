"""Rows through an ordered chain of injected tasks, as calls to several sellers' models are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.staged import staged

Task = Callable[[DataFrame], DataFrame]


def through_chain(rows: DataFrame, entries: list[tuple[str, str, Task]], fallback: dict[str, Column], retries: int = 2, key: str = "doc_id") -> DataFrame:
    """``rows`` with the columns of ``fallback``, and provider, model, used_fallback, reason and calls.

    ``entries`` are (provider, model, task) in order of preference.  A task takes
    the rows that are still open, with ``attempt`` from 0 on, and returns the key, ``error``
    (null where it succeeded) and the columns of ``fallback``, for some or
    all of them, each at most once; a row it is silent on counts as the error
    ``no_answer``.  A failing row is asked again ``retries`` times, then the next
    entry has it; what no entry answers takes the fallback, with the last error as reason
    (``no_provider`` of an empty chain).  Every round is written before the next
    begins, so no row is asked twice for one attempt, even after a lost executor
    of a later round, and each round reads only the open rows.
    """
    open_rows, answered = None, []
    for provider, model, task in entries:
        for attempt in range(retries + 1):
            left = rows if open_rows is None else rows.join(open_rows.select(key), key, "left_semi")
            told = task(left.withColumn("attempt", F.lit(attempt))).select(key, "error", F.struct(*fallback).alias("told"), F.lit(True).alias("spoke"))
            before = rows.select(key, F.lit(0).alias("calls")) if open_rows is None else open_rows.select(key, "calls")
            j = before.join(told, key, "left")
            error = F.when(F.col("spoke").isNull(), "no_answer").otherwise(F.col("error"))
            done = staged(j.select(key, (F.col("calls") + 1).alias("calls"), error.alias("reason"), "told", F.lit(provider).alias("provider"), F.lit(model).alias("model")))
            answered.append(done.filter("reason is null"))
            open_rows = done.filter("reason is not null")
            if not open_rows.take(1):
                break
        else:
            continue
        break
    last = open_rows if open_rows is not None else rows.select(key, F.lit(0).alias("calls"), F.lit("no_provider").alias("reason"))
    out = last.select(key, "calls", "reason", F.lit("fallback").alias("provider"), F.lit("fallback").alias("model"), F.lit(True).alias("used_fallback"))
    if not answered:
        return rows.join(out, key).select(*rows.columns, *[c.alias(n) for n, c in fallback.items()], "provider", "model", "used_fallback", "reason", "calls")
    out = out.withColumn("told", F.lit(None).cast(answered[0].schema["told"].dataType))
    for part in answered:
        out = out.unionByName(part.withColumn("used_fallback", F.lit(False)))
    told = [F.when(F.col("used_fallback"), c).otherwise(F.col(f"told.{n}")).alias(n) for n, c in fallback.items()]
    return rows.join(out, key).select(*rows.columns, *told, "provider", "model", "used_fallback", "reason", "calls")
