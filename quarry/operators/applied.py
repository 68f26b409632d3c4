"""Plans applied to the catalogue: changes of many kinds, each row's own in order, and what became of each."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.operators.catalog import DELETED, PENDING, STORED
from quarry.operators.names import unique_names

TRASHED = "LIBRARY_TRASHED"
#: The states that may go to the trash, and those of the flow.
TO_TRASH = ("USER_CONFIRMATION_REQUIRED", STORED)
ROW = ("doc_id", "sha256", "current_filename", "current_path", "status", "updated_at_utc", "flow_state", "pending_decision", "content_json", "last_verified_utc")
#: What the fold over a row's changes carries: is the row there, was it placed, its category.
_STATE = "struct<here:boolean,filename:string,path:string,status:string,updated:string,flow:string,pending:string,content:string,verified:string,placed:bigint,category:string,outcomes:array<struct<seq:bigint,kind:string,outcome:string>>>"


@F.pandas_udf(StringType())
def _filed(content: pd.Series, category: pd.Series) -> pd.Series:
    """Fiches with another category; what is no JSON object stays as it is."""

    def one(text, where):
        if text is None or where is None:
            return text
        try:
            fiche = json.loads(text)
        except ValueError:
            return text
        return json.dumps(fiche | {"category_path": where}) if isinstance(fiche, dict) else text

    return pd.Series([one(*x) for x in zip(content, category)], dtype=object)


def _step(library: str, trash: str) -> Callable[[Column, Column], Column]:
    """The fold's step: a change of a row that is in a state, by kind.

    ``resolve`` files a parked row under ``target`` (null: no valid category);
    ``trash`` takes a file below the library to the trash; ``undo`` drops the row
    whose file went back, if its path is still ``target``; ``delete`` leaves a tombstone;
    ``verify`` tells that the content of a stored row was right.
    """

    def step(s: Column, c: Column) -> Column:
        kind, target = c["kind"], c["target"]
        inside = F.coalesce(s["path"].startswith(library + "/"), F.lit(False))
        legal = F.coalesce(s["flow"], F.lit(STORED)).isin(*TO_TRASH)
        outcome = (
            F.when(~s["here"], "unknown_to_catalog")
            .when(kind == "resolve", F.when(s["status"] != PENDING, "not_pending").when(target.isNull(), "invalid_path").otherwise("applied"))
            .when(kind == "trash", F.when(~inside, "outside_library").when(~legal, "illegal_transition").otherwise("applied"))
            .when(kind == "undo", F.when(~s["path"].eqNullSafe(target), "unknown_to_catalog").otherwise("applied"))
            .when(kind == "delete", F.when(s["status"] == DELETED, "already_deleted").otherwise("applied"))
            .when(kind == "verify", F.when(s["status"] != STORED, "not_stored").otherwise("applied"))
            .otherwise("unknown_kind")
        )
        done = outcome == "applied"
        on = lambda k: done & (kind == k)
        none = F.lit(None).cast("string")
        pick = lambda *cases, other: _cases(cases, other)
        return F.struct(
            (s["here"] & ~on("undo")).alias("here"),
            pick((on("delete"), F.lit("")), other=s["filename"]).alias("filename"),
            pick((on("resolve"), F.concat(F.lit(library + "/"), target, F.lit("/"), s["filename"])), (on("trash"), F.concat(F.lit(trash), F.substring(s["path"], len(library) + 1, 1 << 30))), (on("delete"), F.lit("")), other=s["path"]).alias("path"),
            pick((on("resolve"), F.lit(STORED)), (on("trash"), F.lit(TRASHED)), (on("delete"), F.lit(DELETED)), other=s["status"]).alias("status"),
            pick((done & kind.isin("resolve", "trash", "delete"), c["at"]), other=s["updated"]).alias("updated"),
            pick((on("resolve"), F.lit(STORED)), (on("trash"), F.lit(TRASHED)), (on("delete"), none), other=s["flow"]).alias("flow"),
            pick((done & kind.isin("resolve", "trash", "delete"), none), other=s["pending"]).alias("pending"),
            pick((on("delete"), none), other=s["content"]).alias("content"),
            pick((on("verify"), c["at"]), other=s["verified"]).alias("verified"),
            pick((done & kind.isin("resolve", "trash"), c["seq"]), (on("delete"), F.lit(None).cast("long")), other=s["placed"]).alias("placed"),
            pick((on("resolve"), target), (on("delete"), none), other=s["category"]).alias("category"),
            F.concat(s["outcomes"], F.array(F.struct(c["seq"].alias("seq"), kind.alias("kind"), outcome.alias("outcome")))).alias("outcomes"),
        )

    return step


def _cases(cases, other: Column) -> Column:
    out = None
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(other)


def changed(rows: DataFrame, changes: DataFrame, library: str, trash: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the changes, outcome of each change) of catalogue ``rows`` (columns ROW) and changes (seq, doc_id, kind, target, at).

    A row's changes are applied in order of ``seq``, which has no ties, each to
    what the one before has left; one that the row's state doesn't allow is
    refused with a reason and changes nothing.  Files that were placed keep their
    paths apart: in order of their last placing change each takes the first
    free name, next to all rows that were not placed.  A change of no row is
    ``unknown_to_catalog``.  The changes of one row are one array, so a row may
    have as many as a task can hold.
    """
    lists = changes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "target", "at"))).alias("c"))
    empty = F.array().cast("array<struct<seq:bigint,kind:string,outcome:string>>")
    state = F.struct(
        F.coalesce("_here", F.lit(False)).alias("here"), F.col("current_filename").alias("filename"), F.col("current_path").alias("path"), F.col("status").alias("status"), F.col("updated_at_utc").alias("updated"), F.col("flow_state").alias("flow"),
        F.col("pending_decision").alias("pending"), F.col("content_json").alias("content"), F.col("last_verified_utc").alias("verified"), F.lit(None).cast("long").alias("placed"), F.lit(None).cast("string").alias("category"), empty.alias("outcomes"),
    ).cast(_STATE)
    step = _step(library, trash)
    j = rows.select(*ROW, F.lit(True).alias("_here")).join(lists, "doc_id", "full_outer")
    none = F.array().cast("array<struct<seq:bigint,kind:string,target:string,at:string>>")
    fold = F.aggregate(F.coalesce(F.col("c").cast("array<struct<seq:bigint,kind:string,target:string,at:string>>"), none), state, lambda s, c: step(s, c).cast(_STATE))
    after = j.select("doc_id", "sha256", fold.alias("s"))
    outcomes = after.select("doc_id", F.explode("s.outcomes").alias("o")).select("doc_id", "o.seq", "o.kind", "o.outcome")
    live = after.filter("s.here").select("doc_id", "sha256", "s.*")
    placed = live.filter("placed is not null").select(F.col("placed").alias("doc_id"), "path")
    given = unique_names(placed, live.filter("placed is null and path != ''").select("path")).select(F.col("doc_id").alias("placed"), F.col("path").alias("given"))
    live = live.join(given, "placed", "left").withColumn("path", F.coalesce("given", "path"))
    name = F.when(F.col("placed").isNotNull(), F.substring_index("path", "/", -1)).otherwise(F.col("filename"))
    new = live.select(
        "doc_id", "sha256", name.alias("current_filename"), F.col("path").alias("current_path"), "status", F.col("updated").alias("updated_at_utc"), F.col("flow").alias("flow_state"),
        F.col("pending").alias("pending_decision"), F.when(F.col("category").isNotNull(), _filed(F.col("content"), F.col("category"))).otherwise(F.col("content")).alias("content_json"), F.col("verified").alias("last_verified_utc"),
    )
    return new, outcomes


def counters(outcomes: DataFrame) -> DataFrame:
    """kind, outcome and n of applied changes."""
    return outcomes.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))
