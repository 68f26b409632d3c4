"""Shared plumbing: staged tables in the shared checkpoint folder, document keys.

``Stage.cut`` writes a table under ``spark.checkpoint.dir`` (read from the
session) and reads it back.  The lineage ends there, every executor can read
the copy, and a lost executor costs only the tasks that ran on it.  Shuffle
files of a cut are released as soon as it has been written.  Operators delete
the tables that their result does not read; the others go with the next stage
of a pipeline, or at the end of the program.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEAN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
_own_dir: str | None = None
_open: dict[str, SparkSession] = {}  # folders of staged tables that may still be read
_lock = threading.Lock()
_writing: dict[str, list] = {}  # by session: writers now, and the settings before them
NO_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder of staged tables; a temporary one only where driver and executors are one process."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="quarry-stages-")
    return _own_dir


@contextlib.contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """While tables are staged: shuffle files are released, Arrow batches are small.

    The settings of the session come back with its last writer, of whatever thread.
    """
    me = str(id(spark._jsparkSession))
    with _lock:
        now = _writing.setdefault(me, [0, {key: spark.conf.get(key, None) for key in _LEAN}])
        now[0] += 1
        for key, value in _LEAN.items():
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            now[0] -= 1
            if not now[0]:
                for key, value in _writing.pop(me)[1].items():
                    if value is None:
                        spark.conf.unset(key)
                    else:
                        spark.conf.set(key, value)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged() -> set[str]:
    """Folders of staged tables that have not been deleted."""
    return set(_open)


def discard(roots: set[str]) -> None:
    """Delete folders of staged tables, once no plan reads them."""
    for root in roots:
        spark = _open.pop(root, None)
        if spark is not None:
            _delete(spark, root)


@atexit.register
def _discard_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        discard(staged())


class Stage:
    """Staged tables of one operator call, each under a name of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: set[str] = set()

    def cut(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        _open[self.root] = self.spark
        with lean(self.spark):
            df.write.parquet(path, compression=codec)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that no later plan reads."""
        for df in frames:
            self.paths.discard(df._quarry_path)
            _delete(self.spark, df._quarry_path)

    def keep(self, *frames: DataFrame) -> None:
        """Delete all staged tables but these, which a result still reads."""
        for path in self.paths - {df._quarry_path for df in frames}:
            self.paths.discard(path)
            _delete(self.spark, path)


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def text_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` as (k, tk, text): a key for each row that survives re-reading.

    ``k`` is doc_id (null: the least long); ``tk`` is 0 unless some doc_id
    repeats, and then a hash of the text, so rows that share a doc_id stay
    apart and exact repeats of a row are the same document.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"))
    repeats = has_rows(ids.groupBy("k").count().filter("count > 1"))
    tk = F.xxhash64(F.coalesce("text", F.lit(""))) if repeats else F.lit(0).cast("long")
    return (
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
            tk.alias("tk"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ),
        ["k", "tk"],
    )


def from_key(k: str = "k"):
    """The doc_id that a key stands for."""
    return F.when(F.col(k) != NO_ID, F.col(k))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
