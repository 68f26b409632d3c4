"""Catalogue maintenance, integrity and reconciliation, as plans over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STORED, PENDING, DELETED = "LIBRARY_STORED", "DECISION_PENDING", "DELETED"


def upsert(base: DataFrame, updates: DataFrame, keep: tuple[str, ...] = ("last_verified_utc",)) -> DataFrame:
    """Rows of ``base`` overwritten by those of ``updates`` on doc_id; the last by seq wins.

    Every column but those in ``keep`` is overwritten, nulls included.
    """
    last = updates.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in updates.columns if c != "doc_id"]), "seq").alias("u"))
    pick = lambda c: F.col(f"b.{c}") if c in keep else F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}"))
    rows = base.select("doc_id", F.struct(*[c for c in base.columns if c != "doc_id"]).alias("b"))
    return rows.join(last, "doc_id", "full_outer").select("doc_id", *[pick(c).alias(c) for c in base.columns if c != "doc_id"])


def tombstone(rows: DataFrame, which: Column, when: Column) -> DataFrame:
    """Deleted rows keep id and hash, get their date, and lose name, path, flow state, decision and fiche."""
    # What a tombstone leaves in each column.
    left = {"current_filename": F.lit(""), "current_path": F.lit(""), "status": F.lit(DELETED), "updated_at_utc": when, "content_json": F.lit(None).cast("string"), "pending_decision": F.lit(None).cast("string"), "flow_state": F.lit(None).cast("string")}
    return rows.select(*[F.when(which, left[c]).otherwise(F.col(c)).alias(c) if c in left else F.col(c) for c in rows.columns])


def purge(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "doc_id", "left_anti")


def mark_verified(rows: DataFrame, ids: DataFrame, when: str) -> DataFrame:
    hit = ids.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    out = rows.join(hit, "doc_id", "left")
    return out.withColumn("last_verified_utc", F.when(F.col("_hit"), F.lit(when)).otherwise(F.col("last_verified_utc"))).drop("_hit")


def majority_language(rows: DataFrame, column: str = "language") -> DataFrame:
    """The most frequent language; of equals the first by name."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.lower(F.trim(column)).alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(1)


def duplicates(rows: DataFrame) -> DataFrame:
    """sha256, copies and first_id of every hash that repeats."""
    return rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def first_wins(rows: DataFrame) -> DataFrame:
    """Each row with ``is_duplicate``: whether an earlier one has its hash."""
    first = rows.groupBy("sha256").agg(F.min("doc_id").alias("kept_id"))
    return rows.join(first, "sha256").select("doc_id", "kept_id", (F.col("doc_id") != F.col("kept_id")).alias("is_duplicate"))


def redeposits(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Incoming rows by what the catalogue knows of their hash: live, deleted or new."""
    known = catalogue.groupBy("sha256").agg(F.count_if(F.col("status") != DELETED).alias("live"), F.max(F.when(F.col("status") == DELETED, F.col("updated_at"))).alias("deleted_at"))
    state = F.when(F.coalesce("live", F.lit(0)) > 0, "live").when(F.col("deleted_at").isNotNull(), "deleted").otherwise("new")
    return incoming.join(known, "sha256", "left").select("doc_id", state.alias("state"), "deleted_at")


def scrub_queue(rows: DataFrame, limit: int) -> DataFrame:
    """The least recently verified rows, never verified first."""
    return rows.orderBy(F.asc_nulls_first("last_verified"), "doc_id").limit(limit)


def integrity_status(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Counts of rows and of overdue ones, and the greatest age in days."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_verified")) / 86400)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(age >= days, F.lit(True))).alias("n_overdue"), F.max(age).alias("oldest_days"))


def scrub_matrix(library: DataFrame, copies: DataFrame, mirror: DataFrame) -> DataFrame:
    """ok, corrupt or missing for both copies of each document, and the remedy."""
    state = lambda h: F.when(h.isNull(), "missing").when(h == F.col("sha256"), "ok").otherwise("corrupt")
    j = library.join(copies.select("path", F.col("sha256").alias("h1")), "path", "left").join(mirror.select("path", F.col("sha256").alias("h2")), "path", "left")
    j = j.select("path", state(F.col("h1")).alias("library"), state(F.col("h2")).alias("mirror"))
    one_ok = (F.col("library") == "ok") | (F.col("mirror") == "ok")
    remedy = F.when((F.col("library") == "ok") & (F.col("mirror") == "ok"), "none").when(one_ok, F.when(F.col("library") == "ok", "copy_to_mirror").otherwise("restore_from_mirror")).otherwise("lost")
    return j.withColumn("remedy", remedy)


def rescan_plan(disk: DataFrame, rows: DataFrame, preserved: DataFrame) -> DataFrame:
    """path, doc_id and action of every file and row that differ.

    ``disk`` has path and sha256 of managed files, ``preserved`` paths that are
    there but not managed, ``rows`` doc_id, path, sha256, status and ord.  Per
    hash the i-th unknown file takes the i-th gone row (moved); then comes
    duplicate where a live row is present or one has moved, readded for the
    i-th deleted row, else new.  Gone rows left over are deleted.
    """
    live = rows.filter(F.col("status") != DELETED)
    present = disk.select("path").unionByName(preserved.select("path")).distinct()
    unknown = disk.join(live.select("path"), "path", "left_anti")
    unknown = unknown.withColumn("i", F.row_number().over(Window.partitionBy("sha256").orderBy("path")))
    gone = live.join(present, "path", "left_anti").withColumn("i", F.row_number().over(Window.partitionBy("sha256").orderBy("ord", "doc_id")))
    dead = rows.filter(F.col("status") == DELETED).withColumn("i", F.row_number().over(Window.partitionBy("sha256").orderBy("ord", "doc_id")))
    here = live.join(present, "path", "left_semi").groupBy("sha256").agg(F.lit(True).alias("is_present"))
    n_gone = gone.groupBy("sha256").agg(F.count(F.lit(1)).alias("g"))
    u = unknown.join(gone.select("sha256", "i", F.col("doc_id").alias("gone_id")), ["sha256", "i"], "left").join(here, "sha256", "left").join(n_gone, "sha256", "left")
    u = u.join(dead.select("sha256", "i", F.col("doc_id").alias("dead_id")), ["sha256", "i"], "left")
    action = F.when(F.col("gone_id").isNotNull(), "moved").when(F.coalesce("is_present", F.lit(False)) | (F.coalesce("g", F.lit(0)) > 0), "duplicate").when(F.col("dead_id").isNotNull(), "readded").otherwise("new")
    files = u.withColumn("action", action).select("path", F.when(F.col("action") == "moved", F.col("gone_id")).when(F.col("action") == "readded", F.col("dead_id")).alias("doc_id"), "action")
    left = gone.join(unknown.select("sha256", "i"), ["sha256", "i"], "left_anti").select("path", "doc_id", F.lit("deleted").alias("action"))
    return files.unionByName(left)


def compare_copies(left: DataFrame, right: DataFrame, key: str, value: str, names: tuple[str, str, str, str]) -> DataFrame:
    """key and state of a full outer comparison: names for left only, right only, equal, different."""
    j = left.select(key, F.col(value).alias("a"), F.lit(1).alias("l")).join(right.select(key, F.col(value).alias("b"), F.lit(1).alias("r")), key, "full_outer")
    state = F.when(F.col("r").isNull(), names[0]).when(F.col("l").isNull(), names[1]).when(F.col("a").eqNullSafe(F.col("b")), names[2]).otherwise(names[3])
    return j.select(key, state.alias("state"))


def restore_plan(mirror: DataFrame, library: DataFrame) -> DataFrame:
    return compare_copies(mirror, library, "path", "sha256", ("restore", "library_only", "identical", "differs"))


def snapshot_diff(snapshot: DataFrame, rows: DataFrame) -> DataFrame:
    return compare_copies(snapshot, rows, "doc_id", "updated_at", ("missing_in_db", "missing_in_snapshot", "same", "stale"))
