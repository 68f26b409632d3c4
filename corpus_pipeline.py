"""Training-corpus pipeline: five stages over documents, each staged as Parquet.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept.  All but the last return the columns of documents, whatever
others there are.  A null or empty text has no words, so the quality rules
reject it; where a stage is called alone, it passes the others unchanged.
Repeated rows are judged alike; near-dedup leaves one row of a doc_id, and all
rows without one.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.op1_minhash import drop_near_duplicates
from quarry.llm.op3_bpe import bpe_encode_decode, ranks_path
from quarry.llm.op4_decontam import drop_contaminated
from quarry.llm.op7_quality import keep_quality
from quarry.llm.op10_secrets import redact_secrets
from quarry.llm.staging import Stage, discard, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules, or whose host does, go."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return drop_near_duplicates(docs, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; n_chars follows."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text."""
    out = bpe_encode_decode(docs, ranks_path())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("byte-level BPE", tokenize),
]

#: No stage after the first can be told in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES[:-1]):
        before = staged() | {stage.root}
        done = stage.cut(f(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(staged() - before)  # what the stage read
        if i:
            stage.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
