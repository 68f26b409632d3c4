"""Diagnostics: rows of section, check, state (OK, WARN, FAIL, SKIP) and detail, and the integrity line of a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.metering import CHARGES

SHOWN = 5


def _rows(df: DataFrame, section: str, check: Column, state: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), check.alias("check"), state.alias("state"), detail.alias("detail"))


def queue(files: DataFrame) -> DataFrame:
    """Files (path) still in the queue are a failure: some run broke off; the first names are shown."""
    name = F.substring_index("path", "/", -1)
    first = files.select(name.alias("name")).orderBy("name").limit(SHOWN).agg(F.array_sort(F.collect_list("name")).alias("shown"))
    one = files.agg(F.count(F.lit(1)).alias("n")).join(first)  # one row each
    more = F.when(F.col("n") > SHOWN, F.concat(F.lit(", and "), F.col("n") - SHOWN, F.lit(" more"))).otherwise("")
    return _rows(one, "Queue", F.lit("queue_empty"), F.when(F.col("n") > 0, "FAIL").otherwise("OK"), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(": "), F.array_join("shown", ", "), more)).otherwise("empty"))


def chains(tasks: DataFrame, chain: DataFrame, keys: DataFrame) -> DataFrame:
    """Of each task (task) its chain (task, n, provider, model) in order, and of each seller that needs a key (provider, is_set) whether it is there where a chain calls it."""
    by = chain.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":", "provider", "model").alias("e")))), lambda x: x["e"]), ",").alias("all"))
    told = tasks.select("task").distinct().join(by, "task", "left")
    a = _rows(told, "AI", F.concat(F.lit("task_"), F.lower("task")), F.when(F.col("all").isNull(), "WARN").otherwise("OK"), F.coalesce("all", F.lit("no provider chain")))
    used = keys.join(chain.select("provider").distinct().withColumn("used", F.lit(True)), "provider", "left")
    state = F.when(F.col("used").isNull(), "SKIP").when(F.col("is_set"), "OK").otherwise("FAIL")
    b = _rows(used, "AI", F.concat(F.lit("key_"), F.col("provider")), state, F.when(state == "SKIP", "no chain calls it").when(state == "OK", "set").otherwise("unset, but a chain calls it"))
    return a.unionByName(b)


def pricing(chain: DataFrame, prices: DataFrame, local: tuple[str, ...]) -> DataFrame:
    """Whether the first entry of each task's chain has a price, and one that is still listed; ``prices`` has price columns, free and absent_since."""
    first = chain.groupBy("task").agg(F.min_by(F.struct("provider", "model"), "n").alias("e")).select("task", "e.*")
    known = F.coalesce("free", F.lit(False))
    for name in CHARGES:
        if name in prices.columns:
            known = known | F.col(name).isNotNull()
    best = prices.filter(known).groupBy("provider", "model").agg(F.max_by("absent_since", F.coalesce("absent_since", F.lit("~"))).alias("absent_since"), F.lit(True).alias("has"))
    j = first.join(best, ["provider", "model"], "left")
    at_home = F.col("provider").isin(*local)
    state = F.when(at_home, "SKIP").when(F.col("has").isNull() | F.col("absent_since").isNotNull(), "WARN").otherwise("OK")
    entry = F.concat_ws(":", "provider", "model")
    detail = F.when(at_home, F.concat("provider", F.lit(" bills nothing"))).when(F.col("has").isNull(), F.concat(entry, F.lit(" has no price"))).when(F.col("absent_since").isNotNull(), F.concat(entry, F.lit(" is listed no more since "), F.col("absent_since"))).otherwise(entry)
    return _rows(j, "Pricing", F.concat(F.lit("price_"), F.lower("task")), state, detail)


def catalogue(rows: DataFrame) -> DataFrame:
    """How many rows there are, and whether they tell the flow state."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    there = "flow_state" in rows.columns
    a = _rows(n, "Catalog", F.lit("catalog_db"), F.when(F.col("n") > 0, "OK").otherwise("WARN"), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" documents"))).otherwise("empty"))
    b = _rows(n, "Catalog", F.lit("catalog_schema"), F.lit("OK" if there else "WARN"), F.lit("flow_state is there" if there else "flow_state is not there"))
    return a.unionByName(b)


def integrity_line(status: DataFrame, days: int = 30) -> DataFrame:
    """One row, ``line``: what a status says of the checks, from n_rows, n_overdue and oldest_days."""
    oldest = F.when(F.col("oldest_days").isNotNull(), F.concat(F.lit(", oldest "), F.col("oldest_days").cast("string"), F.lit(" day(s) ago"))).otherwise("")
    n = F.col("n_rows").cast("string")
    return status.select(
        F.when(F.col("n_rows") == 0, "no documents filed yet").when(F.col("n_overdue") == 0, F.concat(F.lit("all "), n, F.lit(f" document(s) verified within {days} days"), oldest)).otherwise(F.concat(n, F.lit(" document(s)"), oldest, F.lit("; "), F.col("n_overdue").cast("string"), F.lit(" overdue"))).alias("line")
    )
