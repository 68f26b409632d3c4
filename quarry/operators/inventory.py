"""Walks over a file inventory: path, size, mtime and is_symlink of every file below a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import ARCHIVES, BASE_FOLDERS, MEDIA_ZONES, classifiable, dispatch, hidden, prefixes_of, segments, within


def inbox_files(files: DataFrame) -> DataFrame:
    """Dropped files by path, links left out."""
    return files.filter(~F.col("is_symlink")).orderBy("path")


def repository_roots(files: DataFrame) -> DataFrame:
    """Folders that hold a ``.git`` entry, file or folder, by path (the root itself is the empty one)."""
    root = F.regexp_extract(F.concat(F.lit("/"), F.col("path")), "^(.*?)/\\.git(?:/.*)?$", 1)
    return files.filter(F.array_contains(segments(F.col("path")), ".git")).select(F.regexp_replace(root, "^/", "").alias("root")).distinct().orderBy("root")


def _zoned(files: DataFrame) -> DataFrame:
    """Visible files that are no links, and whether each is in a zone that is kept as it is."""
    seen = files.filter(~F.col("is_symlink") & ~hidden(F.col("path")))
    roots = repository_roots(files).withColumn("_in", F.lit(True))
    above = seen.select("path", F.explode(F.concat(F.array(F.lit("")), prefixes_of(F.col("path")))).alias("root"))
    inside = above.join(roots, "root").select("path").distinct().withColumn("_repo", F.lit(True))
    kept = F.coalesce(F.col("_repo"), F.lit(False)) | within(F.col("path"), ARCHIVES + MEDIA_ZONES)
    return seen.join(inside, "path", "left").withColumn("in_zone", kept).drop("_repo")


def library_files(files: DataFrame) -> DataFrame:
    """Documents that may be filed: outside hidden folders, repositories, archives and media, by path."""
    return _zoned(files).filter("not in_zone").drop("in_zone").orderBy("path")


def indexable_files(files: DataFrame) -> DataFrame:
    """Documents inside such a zone, which are only indexed, by path."""
    return _zoned(files).filter("in_zone").drop("in_zone").orderBy("path")


def index_eligible(files: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """Files whose text is indexed: text and PDF up to a size."""
    return files.filter(dispatch(F.col("path"))["media_type"].isin("text", "pdf") & (F.col("size") <= most_bytes))


def category_paths(files: DataFrame) -> DataFrame:
    """Folders at or below a classifiable base that exists, by label."""
    spark = files.sparkSession
    folders = files.select(F.explode(prefixes_of(F.col("path"))).alias("label")).distinct()
    above = folders.select("label", F.explode(F.concat(prefixes_of(F.col("label")), F.array("label"))).alias("base"))
    return above.join(classifiable(spark), "base", "left_semi").select("label").distinct().orderBy("label")


def branch_files(files: DataFrame, branch: str, most: int = 30, depth: int = 2) -> DataFrame:
    """Files of a branch down to ``depth`` folders below it, relative to it, the newest first."""
    rel = F.substring(F.col("path"), len(branch) + 2, 1 << 20)
    here = files.filter(F.col("path").startswith(branch + "/") & ~F.col("is_symlink")).select(rel.alias("rel"), "mtime")
    return here.filter(F.size(segments(F.col("rel"))) <= depth + 1).orderBy(F.desc("mtime"), "rel").limit(most)


def nearest_branches(wanted: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, ord and label: the nearest existing folder of each of the first wanted paths, once a document.

    ``wanted`` has doc_id, ord and path (a normalised category).
    """
    folders = files.select(F.explode(prefixes_of(F.col("path"))).alias("label")).distinct()
    first = wanted.groupBy("doc_id", "path").agg(F.min("ord").alias("ord"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).filter(F.col("r") <= most)
    above = first.select("doc_id", "ord", F.explode(F.concat(prefixes_of(F.col("path")), F.array("path"))).alias("label"))
    near = above.join(folders, "label").groupBy("doc_id", "ord").agg(F.max_by("label", F.size(F.split("label", "/"))).alias("label"))
    return near.groupBy("doc_id", "label").agg(F.min("ord").alias("ord"))


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (path) with no file below them, the deepest first."""
    held = files.select(F.explode(prefixes_of(F.col("path"))).alias("path")).distinct()
    return folders.select("path").distinct().join(held, "path", "left_anti").orderBy(F.desc(F.size(segments(F.col("path")))), "path")


def bodies(rows: DataFrame, sidecars: DataFrame, texts: DataFrame, most: int = 100_000) -> DataFrame:
    """doc_id and body of stored rows: the sidecar ``.name.txt`` beside the file first, else its own text, else empty."""
    name = F.try_element_at(segments(F.col("path")), F.lit(-1))
    beside = F.concat(F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(name)), F.lit("."), name, F.lit(".txt"))
    j = rows.select("doc_id", "path", beside.alias("sidecar")).join(sidecars.select(F.col("path").alias("sidecar"), F.col("text").alias("own")), "sidecar", "left")
    j = j.join(texts.select("path", "text"), "path", "left")
    return j.select("doc_id", F.substring(F.coalesce("own", "text", F.lit("")), 1, most).alias("body"))


def work_sets(files: DataFrame) -> DataFrame:
    """Work sets of an inbox: a folder at its top is one, a loose file is one by itself; by first path."""
    parts = segments(F.col("path"))
    top = F.when(F.size(parts) > 1, parts[0])
    return files.groupBy(F.coalesce(top, F.lit("")).alias("folder"), F.coalesce(top, F.col("path")).alias("set_key")).agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path")).orderBy("first_path")


def extensions(files: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent extensions, the first by name of equals."""
    ext = F.coalesce(F.nullif(F.regexp_extract(F.lower("path"), "(?<=[^./])\\.([^./]+)$", 1), F.lit("")), F.lit("none"))
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(most)


def mirror_plan(library: DataFrame, mirror: DataFrame) -> DataFrame:
    """path and action that bring a mirror up to its library: copy, keep, or replace (the old copy set aside)."""
    j = library.select("path", F.col("sha256").alias("a")).join(mirror.select("path", F.col("sha256").alias("b")), "path", "left")
    return j.select("path", F.when(F.col("b").isNull(), "copy").when(F.col("a") == F.col("b"), "keep").otherwise("replace").alias("action"))


def expired(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Files (mtime in seconds) strictly older than a number of days."""
    return files.filter(F.col("mtime") < F.unix_timestamp(now) - days * 86400)


def base_folders(spark) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BASE_FOLDERS], "base string")


def layout_conflicts(roots: DataFrame) -> DataFrame:
    """name_a, name_b and kind of each two roots (name, path), name_a the lesser, of which one is the other (equal) or lies in it (contained).

    Paths meet by equality with the folders above one another, so roots may be many.
    """
    from quarry.operators.moves import prefixes

    path = F.regexp_replace(F.trim("path"), "/+$", "")
    clean = roots.select("name", path.alias("path")).filter("path is not null")
    above = clean.select(F.col("name").alias("inner"), F.col("path").alias("own"), F.explode(prefixes(F.col("path"))).alias("path"))
    met = above.join(clean, "path").filter("inner != name and (own != path or inner < name)")
    kind = F.when(F.col("own") == F.col("path"), "equal").otherwise("contained")
    return met.select(F.least("inner", "name").alias("name_a"), F.greatest("inner", "name").alias("name_b"), kind.alias("kind"))
