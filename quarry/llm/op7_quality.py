"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, table

SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
HOST_LIMIT = 0.6  # a host goes when its shrunk failure rate is above this
BROADCAST_HOSTS = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words found twice or more in the text."""

    def of_hashes(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            twins = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            at = F.array_sort(F.transform(twins, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            add = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"))
            return F.aggregate(at, start, add, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, of_sorted))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, of_hashes))


def text_metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE_RUN, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    long = lambda c, name: c.cast("long").alias(name)
    return let(
        of_words,
        lambda w: F.struct(
            long(w["n"], "n_words"),
            long(F.length(F.translate(text, SPACE, "")), "word_chars"),
            long(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), "n_symbols"),
            long(dup_lines, "n_dup_lines"),
            long(w["r"], "n_repeat_words"),
        ),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def rejected_hosts(judged: DataFrame) -> DataFrame:
    """Hosts whose failure rate, shrunk to the corpus by a beta prior, is over HOST_LIMIT.

    The prior's mean is the corpus rate; its weight comes from the spread of
    the hosts' rates beyond what chance gives (method of moments).  Only the
    three sums behind it, one row, reach the driver.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    one = hosts.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.count(F.lit(1)).alias("h"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff")).first()
    n, f = one["n"] or 0, one["f"] or 0
    if not n or not f:
        return hosts.select("host").filter(F.lit(False))
    mean = f / n
    chance = mean * (1 - mean)
    spread = max(one["ff"] / n - mean * mean - chance * one["h"] / n, 1e-9)
    weight = min(max(chance / spread - 1, 1.0), 1e6)
    return hosts.filter((F.col("f") + mean * weight) / (F.col("n") + weight) > HOST_LIMIT).select("host")


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: metrics, base_failed, host_rejected and kept.

    Takes doc_id, text and a host column (null is a host of its own).  A
    document fails by itself when it has fewer than 20 words, or when over 30 %
    of its words lie in 8-word windows found twice or more.  A host goes as a
    whole when its shrunk failure rate is over HOST_LIMIT, and then its other
    documents go too.  Null or empty texts have no words and fail; repeated
    rows count each; other columns are ignored; an empty table gives an empty
    result.  Failures are pre-aggregated by host before the shuffle, and the
    few rejected hosts are broadcast only while they are few.
    """
    stage = Stage(docs.sparkSession, "quality")
    m = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"), text_metrics(F.col("text")).alias("m"))
    m = stage.cut(m.select("doc_id", "host", "m.*"), "metrics")
    m = m.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    bad = stage.cut(rejected_hosts(m), "hosts").withColumn("host_rejected", F.lit(True))
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    out = m.join(bad, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` without the documents that ``quality_rules`` rejects.

    The texts are measured once: a copy of ``docs`` with the verdicts is
    staged, in which the failing documents have lost their texts.  The host
    rates read only two of its columns.
    """
    stage = Stage(docs.sparkSession, "quality")
    flag = "_failed"
    while flag in docs.columns:
        flag += "_"
    failed = let(text_metrics(F.col("text")), lambda x: base_failed(x["n_words"], x["n_repeat_words"]))
    judged = docs.withColumn(flag, failed).withColumn("text", F.when(~F.col(flag), F.col("text")))
    judged = stage.cut(judged, "judged")
    of_host = F.coalesce(F.col(host).cast("string"), F.lit("\x00"))
    bad = stage.cut(rejected_hosts(judged.select(of_host.alias("host"), F.col(flag).alias("base_failed"))), "hosts")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    return judged.filter(~F.col(flag)).join(bad, of_host == bad["host"], "left_anti").drop(flag)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(COLUMNS)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, i, w[i : i + 7] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), q AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM p) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS j FROM q) GROUP BY r
), m AS (
  SELECT d.doc_id, d.host, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.r = rep.r
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY host
), a AS (
  SELECT sum(f) / sum(n) AS mean, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2
         - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n), 1e-9) AS spread FROM h
), g AS (
  SELECT mean, least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) AS weight FROM a
), bad AS (
  SELECT host FROM h, g WHERE (f + mean * weight) / (n + weight) > 0.6 AND mean > 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host NOT IN (SELECT host FROM bad) AS kept FROM b
"""
