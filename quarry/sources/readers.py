"""Readers and writers: tables, the action log, snapshots, prices, file inventories."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.exprs import price

EVENT = "event_id string, event_time_utc string, operation_id string, action string, status string, message string, path_before string, path_after string, run_id string, _corrupt_record string"
FICHE = "name string, document_date string, series boolean, category_path string, alternatives array<string>, summary string, keywords array<string>, entities map<string,string>, language string, source_folder string, original_filename string, effective_date string, read_via string, provider string, model string, analyzed_at string"
_MODEL = "struct<in_per_mtok:double,out_per_mtok:double,per_1k_pages:double,per_audio_minute:double,per_audio_second:double,free:boolean,absent_since:string,kind:string,display_name:string>"
PRICES = f"schema_version int, currency string, updated string, source string, models map<string,{_MODEL}>, providers map<string, struct<currency:string,updated:string,checked_utc:string,source:string,models:map<string,{_MODEL}>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The action log; blank, broken and non-object lines are left out."""
    rows = spark.read.schema(EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter("_corrupt_record is null and coalesce(event_id, action, operation_id, event_time_utc, run_id) is not null").drop("_corrupt_record")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_snapshot(spark: SparkSession, path: str, document: str) -> DataFrame:
    """The documents of a catalogue snapshot; ``document`` is their struct type in DDL."""
    whole = spark.read.schema(f"meta struct<schema_version:bigint,library_root:string>, documents array<{document}>").option("multiLine", True).json(path)
    return whole.select(F.explode("documents").alias("d")).select("d.*")


UNIT_PRICES = ("in_per_mtok", "out_per_mtok", "per_1k_pages", "per_audio_minute", "per_audio_second")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """provider, model, currency, updated, checked_utc, source, display_name, prices, free, kind, absent_since of price files of schema 1 or 2.

    A file of another schema has no rows.  One of schema 1 names no sellers, and
    its models are those of ``*``.  A price that is no usable one is null, whatever
    stands there; only a plain true is free; empty texts are none; a model goes
    by its key where it has no name, and prices are in USD where no currency is told.
    """
    whole = spark.read.schema(PRICES).option("multiLine", True).json(path).filter("coalesce(schema_version, 1) in (1, 2)")
    any_provider = F.map_from_arrays(F.array(F.lit("*")), F.array(F.struct("currency", "updated", F.lit(None).cast("string").alias("checked_utc"), "source", "models")))
    rows = whole.select(F.explode(F.coalesce("providers", any_provider)).alias("provider", "p"))
    rows = rows.select("provider", "p.*").select("provider", "currency", "updated", "checked_utc", "source", F.explode("models").alias("model", "m")).filter("m is not null")
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "provider", "model", F.coalesce(told("currency"), F.lit("USD")).alias("currency"), told("updated").alias("updated"), told("checked_utc").alias("checked_utc"), told("source").alias("source"),
        F.coalesce(told("m.display_name"), F.col("model")).alias("display_name"), *[price(F.col(f"m.{u}")).alias(u) for u in UNIT_PRICES], F.coalesce("m.free", F.lit(False)).alias("free"), told("m.kind").alias("kind"), told("m.absent_since").alias("absent_since"),
    )


def parse_fiche(rows: DataFrame, column: str = "content_json") -> DataFrame:
    """Add ``fiche``: the parsed JSON; a broken one is a struct of nulls."""
    return rows.withColumn("fiche", F.from_json(column, FICHE))


class InventorySource(DataSource):
    """Files below a root, hidden ones too (Spark's own listing skips those)."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return "path string, size bigint, mtime double, is_symlink boolean, is_hidden boolean"

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader(self.options["path"])


class InventoryReader(DataSourceReader):
    """One partition for each entry of the root."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        return [InputPartition(x) for x in sorted(os.listdir(self.root))] or [InputPartition("")]

    def read(self, partition):
        def row(path):
            rel = os.path.relpath(path, self.root)
            s = os.lstat(path)
            return rel, s.st_size, s.st_mtime, os.path.islink(path), any(p.startswith(".") for p in rel.split("/"))

        if not partition.value:
            return
        top = os.path.join(self.root, partition.value)
        if os.path.isdir(top) and not os.path.islink(top):
            for d, _, names in os.walk(top):
                for n in sorted(names):
                    yield row(os.path.join(d, n))
        else:
            yield row(top)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(InventorySource)
    return spark.read.format("inventory").load(root)
