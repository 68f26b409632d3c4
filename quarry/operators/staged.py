"""Tables written on the way, and running sums that put no key in one task."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None
_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _own_dir


def at(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def delete(spark: SparkSession, path: str) -> None:
    fs, found = at(spark, path)
    fs.delete(found, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan ends there, and nothing above it runs twice.

    The files go at the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    _kept[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete_all() -> None:
    for path, spark in _kept.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)


class Manifests:
    """Numbered manifests below a folder; the greatest is the state of what lies there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/manifests"

    def last(self) -> dict | None:
        fs, found = at(self.spark, self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []
        names = [x for x in names if x.endswith(".json")]
        if not names:
            return None
        stream = fs.open(at(self.spark, f"{self.path}/{names[-1]}")[1])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, manifest: dict) -> dict:
        """Make the next version of ``manifest``: it is written aside and renamed, which fails if another writer was first."""
        manifest = manifest | {"version": manifest["version"] + 1}
        fs, aside = at(self.spark, f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = at(self.spark, f"{self.path}/{self.name(manifest)}")[1]
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer has made version {manifest['version']} of {self.path}")
        return manifest

    @staticmethod
    def name(manifest: dict) -> str:
        return f"{manifest['version']:09d}.json"


class Table:
    """A table of versions: each is written whole beside the last and then switched to, so a reader sees one or the other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifests = spark, path, Manifests(spark, path)

    def read(self) -> DataFrame | None:
        """The last version, or None."""
        last = self.manifests.last()
        return None if last is None else self.spark.read.parquet(f"{self.path}/{last['data']}")

    def write(self, df: DataFrame) -> DataFrame:
        """The next version; ``df`` may be made from the last one."""
        last = self.manifests.last() or {"version": 0}
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{data}")
        self.manifests.put(last | {"data": data})
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{data}")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its keys up to and with itself, by ``order``, which has no ties.

    Rows are dealt in ranges of keys and order, so a key of any size lies in
    many tasks; each adds up its own rows, and the sums of the ranges before
    come by a join of one row a key and range.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy("_range", *keys).orderBy(*order)
    dealt = staged(dealt.withColumn(name, F.sum(value).over(own)))
    each = dealt.groupBy("_range", *keys).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(F.struct("_range", *keys).alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    out = dealt.join(each, F.struct("_range", *keys).eqNullSafe(F.col("_at")))
    return out.select(*df.columns, (F.col(name) + F.col("_before")).alias(name))
