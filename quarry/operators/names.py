"""Names that stay unique, among those there are and among those just given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.staged import running_sum, staged

_STEM, _NUMBERED = "^(.*?)((?<=[^./])\\.[^./]*)?$", "^(.*)__([1-9][0-9]*)$"


def _named(base: Column, number: Column) -> Column:
    """The number-th name that a path may take: 0 is the path itself."""
    ext = F.regexp_extract(base, "(?<=[^./])(\\.[^./]*)$", 1)
    return F.when(number == 0, base).otherwise(F.concat(F.regexp_extract(base, _STEM, 1), F.lit("__"), number.cast("string"), ext))


def _places(names: DataFrame) -> DataFrame:
    """(base, number) of each list of names that a path (column path) stands in: its own at 0, and that of its stem without the number."""
    stem, ext = F.regexp_extract("path", _STEM, 1), F.regexp_extract("path", "(?<=[^./])(\\.[^./]*)$", 1)
    number = F.regexp_extract(stem, _NUMBERED, 2).try_cast("long")
    other = F.struct(F.concat(F.regexp_extract(stem, _NUMBERED, 1), ext).alias("base"), number.alias("number"))
    own = F.struct(F.col("path").alias("base"), F.lit(0).cast("long").alias("number"))
    return names.withColumn("_x", F.explode(F.filter(F.array(own, other), lambda x: x["number"].isNotNull()))).select("*", "_x.*").drop("_x")


def _numbers(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` (base, free, ...) with ``number``, the free-th number from 0 on that is not taken; ``taken`` has base and number.

    The m-th taken number t leaves t - m free ones below it, so a row has as
    many taken numbers before it as have at most ``free`` such: one running
    count over rows and taken numbers in order.
    """
    m = running_sum(taken.withColumn("_one", F.lit(1).cast("long")), ["base"], ["number"], "_one", "_m")
    gaps = m.select("base", (F.col("number") - F.col("_m") + 1).alias("free"), F.lit(0).alias("kind"), F.col("number").alias("tie"), F.lit(1).cast("long").alias("one"))
    asked = rows.select("base", "free").distinct().select("base", "free", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("one"))
    count = running_sum(gaps.unionByName(asked), ["base"], ["free", "kind", "tie"], "one", "below").filter("kind = 1")
    return rows.join(count.select("base", "free", "below"), ["base", "free"]).withColumn("number", F.col("free") + F.col("below")).drop("below")


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """doc_id and path of ``wanted`` (doc_id, path), with ``__1``, ``__2`` ... where a path is taken, earlier ids first.

    Equal to a loop over the ids in order, each taking the first name of its
    list that neither ``taken`` nor an earlier id has.  Rows claim names in
    rounds.  The rows of one path share a list, so the i-th of them claims its
    i-th free name at once; of several claims to a name that stands in two lists
    the least id wins, and is then in the way of later ids of the other list.
    A name once claimed is held by that id or an earlier one in the end, so no
    claim comes too late in its list, and when no name is claimed twice all
    claims are right.  Where no wanted path is the numbered form of another
    one, the first round is the last.  Rows without a path keep none.
    """
    rows = wanted.select("doc_id", F.col("path").alias("base")).withColumn("_one", F.lit(1).cast("long"))
    none = rows.filter("base is null").select("doc_id", F.col("base").alias("path"))
    rows = running_sum(rows.filter("base is not null"), ["base"], ["doc_id"], "_one", "rank").select("doc_id", "base", (F.col("rank") - 1).alias("rank"))
    rows = staged(rows)
    blocked = staged(_places(taken.select("path").filter("path is not null").distinct()).select("base", "number").distinct())
    held = None
    while True:
        if held is None:
            free = rows.withColumn("free", F.col("rank"))
        else:
            # names of a list that rows of other lists hold, by their place among the names that are not taken
            foreign = _places(held).filter(F.col("base") != F.col("of")).join(rows.select("base").distinct(), "base", "left_semi")
            foreign = foreign.join(blocked, ["base", "number"], "left_anti")
            low = running_sum(
                blocked.select("base", "number", F.lit(None).cast("long").alias("by"), F.lit(1).cast("long").alias("one")).unionByName(foreign.select("base", "number", F.col("doc_id").alias("by"), F.lit(0).cast("long").alias("one"))),
                ["base"], ["number"], "one", "below",
            )
            by = low.filter("by is not null").groupBy("base").agg(F.array_sort(F.collect_list(F.struct((F.col("number") - F.col("below")).alias("at"), "by"))).alias("others"))
            skip = F.aggregate(F.coalesce("others", F.array().cast("array<struct<at:bigint,by:bigint>>")), F.col("rank"), lambda n, x: F.when((x["by"] < F.col("doc_id")) & (x["at"] <= n), n + 1).otherwise(n))
            free = rows.join(by, "base", "left").select("doc_id", "base", "rank", skip.alias("free"))
        claims = staged(_numbers(free, blocked).select("doc_id", F.col("base").alias("of"), _named(F.col("base"), F.col("number")).alias("path")))
        every = claims if held is None else claims.unionByName(held.select("doc_id", "of", "path"))
        new = staged(every.groupBy("path").agg(F.min(F.struct("doc_id", "of")).alias("m")).select("m.doc_id", "m.of", "path"))
        if not claims.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
            return claims.select("doc_id", "path").unionByName(none)
        held = new
