"""Slugs of odd letters, in time that grows with the text."""

from pyspark.sql import functions as F

from quarry.functions.exprs import slug


def test_slug_of_odd_letters(spark):
    """Letters that are spelled out, dropped, or no letter, in a text of which no letter is tried against all of a class."""
    texts = ["ﬁn ½ x", "a\0b", "ĳ_ -ß-", "😀", "é_è--ñ", "ŉ’…", None, "", "__a-_-b--c__", "x" * 5 + "\x7f", "① (⒜"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", slug(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == ["fin-12-x", "a-b", "ij", "file", "e_e-n", "n", "file", "file", "a_b-c", "xxxxx", "file"]
    long = spark.range(1).select(F.length(slug(F.repeat(F.lit("aé ß"), 1_000_000))).alias("n"))
    assert long.first().n == 3_000_000 - 1
