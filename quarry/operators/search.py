"""What search is made of: fixed words and weights, query terms, similarity, the vocabulary, synonyms, body changes."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.exprs import tokens

# Single words left out of an OR query, French and English.
STOP_WORDS = set(
    """
    le la les un une des du de d l et ou ni mais donc car que qui quoi dont a au aux en dans sur sous par pour avec sans chez vers entre ce cet cette ces
    mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs je tu il elle on nous vous ils elles est sont etre ont avoir plus moins tres pas ne
    the a an of to in on for with without and or nor but is are be been this that these those his her its their our your my it as at by from
    """.split()
)
WEIGHTS = {"name": 5.0, "keywords": 4.0, "entities": 3.0, "summary": 1.0, "content": 2.0, "category": 2.0}


def terms_of(spark: SparkSession, query: str) -> list[list[str]]:
    """The phrases of a query: its words, each as its tokens; a local relation, which runs no job."""
    if not query.split():
        return []
    rows = spark.sql("SELECT * FROM VALUES (:words) AS t(words)", args={"words": F.array(*map(F.lit, query.split()))})
    found = rows.select(F.transform("words", tokens).alias("p")).first()["p"]
    return [list(p) for p in found if p]


def vocabulary(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """term and df: the documents that hold it."""
    every = F.array_distinct(F.concat(*[tokens(F.col(source)) for source in columns.values()]))
    return docs.select(F.explode(every).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def folded(word: str) -> str:
    """A word without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def similarity(low: str, cutoff: float):
    """Ratcliff-Obershelp similarity of a term to the query word ``low``; 0 below the cutoff."""

    @F.pandas_udf("double")
    def ratio(terms: pd.Series) -> pd.Series:
        m = difflib.SequenceMatcher(None)
        m.set_seq2(low)
        out = []
        for term in terms:
            m.set_seq1(term)
            out.append(m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0)
        return pd.Series(out, dtype="float64")

    return ratio


def with_synonyms(category: Column, synonyms: dict[str, list[str]]) -> Column:
    """The segments of a category and their synonyms, as one text."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    parts = F.split(category, "/")
    return F.array_join(F.flatten(F.transform(parts, lambda s: F.concat(F.array(s), F.coalesce(F.try_element_at(table, s), F.array().cast("array<string>"))))), " ")


def refresh_bodies(live: DataFrame, bodies: DataFrame) -> DataFrame:
    """sha256 and action of each cache change: live hashes to read, orphans to prune."""
    live = live.select("sha256").distinct()
    missing = live.join(bodies, "sha256", "left_anti").withColumn("action", F.lit("add"))
    orphans = bodies.select("sha256").distinct().join(live, "sha256", "left_anti").withColumn("action", F.lit("prune"))
    return missing.unionByName(orphans)
