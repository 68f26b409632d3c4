"""Usage metering, price resolution, calibration and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import json_value

# The names under which replies tell each unit, in a usage block and at the top.
UNITS = {
    "tokens_in": ("prompt_tokens", "input_tokens"),
    "tokens_out": ("completion_tokens", "output_tokens"),
    "pages": ("pages_processed", "pages"),
    "audio_seconds": ("prompt_audio_seconds", "audio_seconds"),
}
TOP_UNITS = {"tokens_in": "prompt_eval_count", "tokens_out": "eval_count"}


def extract_units(body: Column) -> Column:
    """Struct tokens_in, tokens_out, pages, audio_seconds, measured of a provider reply in JSON.

    A unit is measured where its key stands, whatever its value; values that
    are no whole number, or a text of one, count 0, and fractions are cut.
    """
    parsed = json_value(body)
    cells = {}
    for unit, names in UNITS.items():
        paths = [f"$.{block}.{name}" for block in ("usage", "usage_info") for name in names]
        cells[unit] = paths + ([f"$.{TOP_UNITS[unit]}"] if unit in TOP_UNITS else [])
    there = lambda p: F.try_variant_get(parsed, p, "variant").isNotNull()

    def number(p: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(parsed, p, "variant"))
        text = F.try_variant_get(parsed, p, "string")
        whole = F.trim(text).try_cast("bigint")
        cut = F.try_variant_get(parsed, p, "double").try_cast("bigint")
        value = F.when(kind == "STRING", F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), whole)).when(kind != "BOOLEAN", cut)
        return F.coalesce(value, F.lit(0).cast("bigint"))

    measured = F.lit(False)
    for paths in cells.values():
        for p in paths:
            measured = measured | there(p)
    return F.struct(*[sum((number(p) for p in paths), F.lit(0).cast("bigint")).alias(unit) for unit, paths in cells.items()], measured.alias("measured"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, units (those of UNITS that ``calls`` has, negative ones as 0) and unmeasured calls by provider, model and task."""
    positive = lambda c: F.sum(F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))).alias(c)
    units = [positive(u) for u in UNITS if u in calls.columns]
    return calls.groupBy("provider", "model", "task").agg(F.count(F.lit(1)).alias("calls"), *units, F.count_if(~F.coalesce("measured", F.lit(False))).alias("unmeasured"))


def billed_first(rows: DataFrame, billed: Column) -> DataFrame:
    """Usage entries in the order in which they are shown: billed ones, then by tokens, pages and seconds of sound, the most first, then by task."""
    units = [F.desc(F.col("tokens_in") + F.col("tokens_out")), *[F.desc(u) for u in ("pages", "audio_seconds") if u in rows.columns]]
    return rows.orderBy(F.desc(billed), *units, "task", "provider", "model")


def usage_totals(rows: DataFrame, billed: Column) -> DataFrame:
    total = F.sum("calls")
    own = F.coalesce(F.sum(F.when(billed, F.col("calls"))), F.lit(0))
    return rows.agg(total.alias("calls"), own.alias("billed_calls"), (total - own).alias("local_calls"), F.sum(F.when(billed, F.col("tokens_in"))).alias("billed_in"), F.sum(F.when(billed, F.col("tokens_out"))).alias("billed_out"))


def calibration(rows: DataFrame, least: int = 4) -> DataFrame:
    """Mean units of a measured call by task, where there are enough."""
    means = {"tokens_in": "mean_in", "tokens_out": "mean_out", "pages": "mean_pages"}
    units = {u: m for u, m in means.items() if u in rows.columns}
    by = rows.groupBy("task").agg(F.sum("calls").alias("c"), F.sum("unmeasured").alias("u"), *[F.sum(u).alias(f"s_{u}") for u in units])
    n = F.col("c") - F.col("u")
    return by.filter(n >= least).select("task", n.alias("measured"), *[(F.col(f"s_{u}") / n).alias(m) for u, m in units.items()])


def newest_of_family(prices: DataFrame, families: DataFrame) -> DataFrame:
    """provider, model, label: the newest generation of each mapped family that its own seller still publishes.

    The version after the family's name is compared as a float; withdrawn
    generations count where no other is left, and equals at the top give no label.
    """
    keys = prices.filter(F.coalesce(F.col("kind"), F.lit("model")) == "model").select("provider", F.col("model").alias("label"), "absent_since").distinct()
    version = F.regexp_extract(F.expr("substring(label, length(family) + 1)"), "^\\s+(\\d+(?:\\.\\d+)?)\\b", 1)
    hit = families.select("provider", "model", "family").join(keys, "provider").filter(F.col("label").startswith(F.col("family")))
    hit = hit.withColumn("v", F.nullif(version, F.lit("")).cast("double")).filter("v is not null")
    live = F.max(F.col("absent_since").isNull()).over(Window.partitionBy("provider", "model"))
    hit = hit.withColumn("any_live", live).filter(~F.col("any_live") | F.col("absent_since").isNull())
    top = hit.groupBy("provider", "model").agg(F.max("v").alias("v"))
    best = hit.join(top, ["provider", "model", "v"]).groupBy("provider", "model").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label"))
    return best.filter("n = 1").select("provider", "model", "label")


def resolve_prices(wanted: DataFrame, prices: DataFrame, families: DataFrame) -> DataFrame:
    """The price row of each wanted (provider, model).

    Order: own name at the provider, at any (``*``), then the family's newest
    label at the provider, at any.
    """
    labels = newest_of_family(prices, families)
    w = wanted.select("provider", "model").distinct().join(labels, ["provider", "model"], "left")
    options = F.array(*[F.struct(F.lit(i).alias("priority"), p.alias("p"), m.alias("m")) for i, (p, m) in enumerate(((F.col("provider"), F.col("model")), (F.lit("*"), F.col("model")), (F.col("provider"), F.col("label")), (F.lit("*"), F.col("label"))))])
    rows = prices.filter(F.coalesce(F.col("kind"), F.lit("model")) == "model").select(F.col("provider").alias("p"), F.col("model").alias("m"), F.struct("in_per_mtok", "out_per_mtok", "free").alias("price"))
    tried = w.select("provider", "model", F.explode(options).alias("o")).select("provider", "model", "o.*").join(rows, ["p", "m"])
    best = tried.groupBy("provider", "model").agg(F.min_by("price", "priority").alias("price"), F.min("priority").alias("priority"))
    return wanted.select("provider", "model").distinct().join(best, ["provider", "model"], "left").select("provider", "model", "price.*", "priority")


#: Units by the price column that charges them, and how many of them the price is for.
CHARGES = {"in_per_mtok": ("tokens_in", 1e6), "out_per_mtok": ("tokens_out", 1e6), "per_1k_pages": ("pages", 1e3), "per_audio_minute": ("audio_seconds", 60.0), "per_audio_second": ("audio_seconds", 1.0)}


def cost(columns: list[str]) -> Column:
    """Cost by those of the price columns and units that a table has; null without any price, 0 if free."""
    parts = [(F.col(price), F.col(unit) / per) for price, (unit, per) in CHARGES.items() if price in columns and unit in columns]
    known = F.lit(False)
    total = F.lit(0.0)
    for price, amount in parts:
        known = known | price.isNotNull()
        total = total + F.coalesce(price * amount, F.lit(0.0))
    return F.when(F.coalesce(F.col("free"), F.lit(False)), F.lit(0.0)).when(known, total)


def staleness(prices: DataFrame, today: Column, days: int = 180) -> DataFrame:
    """Age of the oldest price, its date, and whether the table is stale."""
    age = F.max(F.datediff(today, F.col("updated")))
    return prices.agg(age.cast("long").alias("age_days"), F.min("updated").alias("as_of"), (age > days).alias("is_stale"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
