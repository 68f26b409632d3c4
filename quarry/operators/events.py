"""Analytics over the append-only action log.  ``seq`` is the order of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(events: DataFrame, filed: Column, last: int) -> DataFrame:
    """run_id, first_time and filed count of the last runs, by first appearance."""
    by = events.filter("run_id is not null").groupBy("run_id").agg(F.min_by("event_time", "seq").alias("first_time"), F.count_if(filed).alias("n_filed"), F.min("seq").alias("first_seq"))
    return by.orderBy(F.desc("first_seq")).limit(last)


def latest_run(events: DataFrame) -> DataFrame:
    return events.filter("run_id is not null").agg(F.max_by("run_id", "seq").alias("run_id"))


def last_per(events: DataFrame, key: list[str], value: str) -> DataFrame:
    """The value of the last event of each key."""
    return events.groupBy(*key).agg(F.max_by(value, "seq").alias(value), F.max("seq").alias("last_seq"))


def undo_plan(placed: DataFrame, origins: DataFrame, known: DataFrame) -> DataFrame:
    """operation_id, path and what undo would do, in the order the blocks are tested."""
    last = placed.groupBy("operation_id").agg(F.max_by("path_after", "seq").alias("path"), F.max("seq").alias("seq"))
    first = origins.groupBy("operation_id").agg(F.min_by("path_before", "seq").alias("origin"), F.min_by("in_inbox", "seq").alias("in_inbox"))
    j = last.join(first, "operation_id", "left").join(known.select("path").distinct().withColumn("is_known", F.lit(True)), "path", "left")
    state = F.when(F.col("origin").isNull(), "no_origin").when(~F.col("in_inbox"), "origin_outside_inbox").when(F.col("is_known").isNull(), "unknown_to_catalog").otherwise("restorable")
    return j.select("operation_id", "path", "origin", state.alias("state"))


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last n events in log order; 0 means all."""
    return events.orderBy("seq") if n == 0 else events.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def transitions(events: DataFrame, key: str, state: str, legal: DataFrame) -> DataFrame:
    """Each step of a key and whether the state graph has it; ``legal`` is (from_state, to_state)."""
    steps = events.withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy("seq"))).filter("from_state is not null").withColumnRenamed(state, "to_state")
    return steps.join(F.broadcast(legal.withColumn("is_legal", F.lit(True))), ["from_state", "to_state"], "left").withColumn("is_legal", F.coalesce("is_legal", F.lit(False)))


#: The counters of a batch that other steps than filing tell.
STEPS = ("regrouped", "collapsed_nestings", "rescan_moved", "rescan_new", "recovered", "aborted")


def batch_summary(results: DataFrame, steps: DataFrame) -> DataFrame:
    """One row with the fourteen counters of a batch.

    ``results`` has a row a filed document: flow_state, pending, organized,
    mirror_failed; a pending one counts as that alone, whatever its state.
    ``steps`` has kind and n of what the other steps did, several rows of a kind
    adding up; kinds that are none are left out.
    """
    pending, state = F.coalesce("pending", F.lit(False)), F.coalesce("flow_state", F.lit(""))
    stored = ~pending & (state == "LIBRARY_STORED")
    count = lambda when, name: F.count_if(when).alias(name)
    of = results.agg(
        count(stored, "processed"), count(~pending & (state == "INBOX_TRASH_PENDING_MANUAL"), "duplicates"), count(~pending & (state == "USER_CONFIRMATION_REQUIRED"), "manual_reviews"),
        count(pending, "pending_decisions"), count(stored & F.coalesce("organized", F.lit(False)), "organized"), count(~pending & state.startswith("ERROR"), "errors"),
        count(F.coalesce("mirror_failed", F.lit(False)), "mirror_failures"), F.count(F.lit(1)).alias("total"),
    )
    others = steps.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in STEPS])
    return of.join(others)  # one row each
