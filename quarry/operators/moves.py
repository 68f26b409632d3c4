"""Moves of files and folders applied to catalogue rows: rewrites of path prefixes, composed before they touch a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.staged import running_sum, staged


def prefixes(path: Column, own: bool = True) -> Column:
    """The folders above a path, outermost first, and with ``own`` the path itself."""
    parts = F.split(path, "/")
    n = F.size(parts) if own else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def _beyond(path: Column, prefix: Column) -> Column:
    """What a path has after one of its prefixes, with the slash."""
    return F.substring(path, F.length(prefix) + 1, F.length(path))


def _longest(rows: DataFrame, keys: list[str], path: str, rules: DataFrame, *told: str) -> DataFrame:
    """keys and ``hit``: the rule of the longest prefix of ``path``, a struct of its prefix and ``told``; rows without one are left out."""
    each = rows.select(*keys, F.explode(prefixes(F.col(path))).alias("prefix"))
    on = [k for k in keys if k in rules.columns and k != "prefix"]
    found = each.join(rules.select(*on, "prefix", *told), [*on, "prefix"])
    return found.groupBy(*keys).agg(F.max_by(F.struct("prefix", *told), F.length("prefix")).alias("hit"))


def _composed(rules: DataFrame) -> DataFrame:
    """Rules (g, prefix, target) of pairs of neighbouring groups, 2 p before 2 p + 1, as one group p.

    A rule sends a path at or below its prefix, and below no longer prefix of
    the group, to its target.  Of a first A and a second B come: each rule of A
    with its target sent on by B; each rule of B below a target of A, pulled
    back to where that came from; and each rule of B that no rule of A precedes.
    """
    side = lambda s: rules.filter(F.pmod("g", F.lit(2)) == s).select(F.floor(F.col("g") / 2).cast("long").alias("p"), "prefix", "target")
    a, b = side(0), side(1)
    a_named = a.select("p", F.col("prefix").alias("src"), "target")
    on = _longest(a_named, ["p", "src", "target"], "target", b.withColumnRenamed("target", "to"), "to")
    first = a_named.join(on, ["p", "src", "target"], "left")
    first = first.select("p", F.col("src").alias("prefix"), F.coalesce(F.concat("hit.to", _beyond(F.col("target"), F.col("hit.prefix"))), F.col("target")).alias("target"))
    below = b.select("p", F.col("prefix").alias("q"), F.col("target").alias("to"), F.explode(prefixes(F.col("prefix"), False)).alias("target"))
    back = below.join(a_named, ["p", "target"]).select("p", "src", "to", F.concat("src", _beyond(F.col("q"), F.col("target"))).alias("back"))
    nearest = _longest(back.select("p", "back").distinct(), ["p", "back"], "back", a)
    second = back.join(nearest, ["p", "back"]).filter(F.col("hit.prefix") == F.col("src")).select("p", F.col("back").alias("prefix"), F.col("to").alias("target"))
    untouched = b.select("p", F.col("prefix").alias("q"), F.col("target").alias("to"))
    had = _longest(untouched, ["p", "q"], "q", a)
    third = untouched.join(had, ["p", "q"], "left_anti").select("p", F.col("q").alias("prefix"), F.col("to").alias("target"))
    return first.unionByName(second).unionByName(third).withColumnRenamed("p", "g")


def composed(moves: DataFrame) -> DataFrame:
    """prefix and target: the longest-prefix rewrite that equals the moves (ord, src, dst) one after the other.

    Neighbours are composed in pairs, all pairs at once, so n moves take log n
    rounds, however long a chain of them is.
    """
    numbered = moves.select("ord", F.col("src").alias("prefix"), F.col("dst").alias("target"))
    places = running_sum(numbered.select("ord", F.lit(1).cast("long").alias("one")), [], ["ord"], "one", "place").select("ord", (F.col("place") - 1).alias("g"))
    rules = staged(numbered.join(places, "ord").select("g", "prefix", "target"))
    last = rules.agg(F.max("g")).first()[0]
    if last is None:
        return numbered.select("prefix", "target")
    while last:
        rules = staged(_composed(rules))
        last //= 2
    return rules.select("prefix", "target")


def repointed(rows: DataFrame, moves: DataFrame, now: str) -> DataFrame:
    """Catalogue rows after the moves (ord, src, dst), each of one file or of a folder with all below it, in order.

    A row that some move meets gets its new path and name, ``now`` as date, and
    no pending decision.  A null path is met by none.  Each move has an ``ord`` of its own.
    """
    rules = composed(moves)
    hit = _longest(rows.select("doc_id", "current_path").filter("current_path is not null"), ["doc_id", "current_path"], "current_path", rules, "target")
    j = rows.join(hit.select("doc_id", "hit"), "doc_id", "left")
    moved = F.col("hit").isNotNull()
    path = F.concat("hit.target", _beyond(F.col("current_path"), F.col("hit.prefix")))
    new = {
        "current_path": F.when(moved, path).otherwise(F.col("current_path")),
        "current_filename": F.when(moved, F.substring_index(path, "/", -1)).otherwise(F.col("current_filename")),
        "updated_at_utc": F.when(moved, F.lit(now)).otherwise(F.col("updated_at_utc")),
        "pending_decision": F.when(~moved, F.col("pending_decision")),
    }
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])
