"""Path columns: segments, zones, categories, series routes, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import safe_stem, slug

# Extensions by media type.
EXTENSIONS = {
    "pdf": "pdf",
    "text": "txt md rtf doc docx odt epub srt sh",
    "office": "xls xlsx ods csv tsv ppt pptx odp",
    "image": "jpg jpeg png gif bmp tif tiff webp heic heif svg psd xcf raw dng cr2 nef arw raf rw2 orf srw",
    "video": "mp4 mkv avi mov wmv flv webm m4v mpg mpeg 3gp",
    "audio": "mp3 wav flac aac m4a ogg opus wma aiff",
    "archive": "zip rar 7z tar gz bz2 xz tar.gz tar.bz2 tar.xz tgz tbz2 txz",
}
MEDIA = {e: kind for kind, names in EXTENSIONS.items() for e in names.split()}
# Image extensions that a vision model reads.
VISION = "jpg jpeg png webp gif bmp tif tiff heic heif avif mpo".split()
# The base folders of a library, and the zones of the user among them.
BASE_FOLDERS = (
    "Personal", "Personal/Administrative", "Personal/Administrative/Identity", "Personal/Administrative/Taxes",
    "Personal/Administrative/Banking", "Personal/Administrative/Insurance", "Personal/Administrative/Health",
    "Personal/Administrative/Housing", "Personal/Administrative/Utilities", "Personal/Administrative/Telecom",
    "Personal/Administrative/Vehicle", "Personal/Education", "Personal/Hobbies", "Personal/Social-media",
    "Personal/Misc", "Personal/Archive", "Work", "Work/Employment", "Work/Employment/Administrative",
    "Work/Employment/Payslips", "Work/Business", "Work/Business/Administrative", "Work/Business/Invoices",
    "Work/Business/Expenses", "Work/Business/Clients", "Work/Misc", "Work/Archive", "Media", "Media/Music",
    "Media/Films", "Manual_Review",
)
ARCHIVES, MEDIA_ZONES, REVIEW = ("Personal/Archive", "Work/Archive"), ("Media",), "Manual_Review"


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def trimmed(path: Column) -> Column:
    """Segments without blanks around them, empty ones left out."""
    return F.filter(F.transform(F.split(path, "/", -1), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def suffixes(name: Column) -> tuple[Column, Column]:
    """(compound, last) extension in lower case without the first dot; null if none."""
    last = F.nullif(F.regexp_extract(F.lower(name), "(?<=[^.])\\.([^.]+)$", 1), F.lit(""))
    two = F.nullif(F.regexp_extract(F.lower(name), "(?<=[^.])\\.([^.]+\\.[^.]+)$", 1), F.lit(""))
    return two, last


def dispatch(name: Column) -> Column:
    """Struct of media_type and reason: the compound extension first, then the last."""
    table = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    two, last = suffixes(name)
    found = F.coalesce(F.try_element_at(table, F.coalesce(two, F.lit(""))), F.try_element_at(table, F.coalesce(last, F.lit(""))))
    reason = F.when(last.isNull(), "no_extension").when(found.isNull(), "unknown_extension").otherwise("known")
    return F.struct(F.coalesce(found, F.lit("unknown")).alias("media_type"), reason.alias("reason"))


def hidden(path: Column) -> Column:
    return F.exists(segments(path), lambda s: s.startswith("."))


def starts_with(parts: Column, base: Column) -> Column:
    """Whether ``base`` is a prefix of ``parts``, segment by segment."""
    return (F.size(base) <= F.size(parts)) & (F.slice(parts, F.lit(1), F.size(base)) == base)


def collapse_nesting(path: Column) -> Column:
    """The path with runs of one segment made single."""
    parts = segments(path)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == s), acc).otherwise(F.concat(acc, F.array(s)))), "/")


def normalise_category(frame: DataFrame, path: str, bases: DataFrame, depth: int) -> DataFrame:
    """Add ``base`` and ``category``: the longest base that prefixes a path, the rest as safe stems.

    Segments are trimmed and empty ones left out; one without a letter or digit is ``file``.

    ``bases`` has one column ``base``.  Paths are exploded into their prefixes
    and joined by equality, so the bases may be many; a path under no base has
    nulls.
    """
    keyed = frame.withColumn("_parts", trimmed(F.col(path)))
    prefixes = keyed.select(F.col(path).alias("_path"), "_parts").distinct().withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_parts"), F.lit(1)))))
    hits = prefixes.withColumn("_base", F.array_join(F.slice("_parts", 1, F.col("_n")), "/")).join(bases.select(F.col("base").alias("_base")).distinct(), "_base")
    best = hits.groupBy("_path").agg(F.max_by("_base", "_n").alias("base"), F.max("_n").alias("_n"), F.first("_parts").alias("_p"))
    rest = F.transform(F.slice("_p", F.col("_n") + 1, F.size("_p")), safe_stem)
    kept = F.slice(F.concat(segments(F.col("base")), rest), 1, depth) if depth else F.concat(segments(F.col("base")), rest)
    best = best.select("_path", "base", F.array_join(kept, "/").alias("category"))
    return keyed.join(best, keyed[path] == best["_path"], "left").drop("_parts", "_path")


def series_route(category: Column, series: Column, issuer: Column, year: Column, base_depth: Column) -> Column:
    """A series gets its issuer below a bare base, and its year below that, once."""
    parts = segments(category)
    bare = F.size(parts) == base_depth
    with_issuer = F.when(series & bare & issuer.isNotNull(), F.concat(parts, F.array(slug(issuer)))).otherwise(parts)
    deeper = F.size(with_issuer) > base_depth
    last = F.try_element_at(with_issuer, F.lit(-1))
    dated = series & deeper & year.rlike("^\\d{4}$") & ~last.rlike("^\\d{4}$")
    return F.array_join(F.when(dated, F.concat(with_issuer, F.array(year))).otherwise(with_issuer), "/")


def within(path: Column, zones: tuple[str, ...]) -> Column:
    """Whether a path lies in one of a few fixed zones, segment by segment."""
    parts = segments(path)
    out = F.lit(False)
    for zone in zones:
        names = zone.split("/")
        out = out | (F.slice(parts, 1, len(names)) == F.array(*map(F.lit, names)))
    return out


def vision_readable(extension: Column) -> Column:
    return F.regexp_replace(F.lower(extension), "^\\.+", "").isin(VISION)


def classifiable(spark) -> DataFrame:
    """The base folders that a document may be filed in: those outside the user's zones and the review folder."""
    rows = spark.createDataFrame([(b,) for b in BASE_FOLDERS], "base string")
    return rows.filter(~within(F.col("base"), ARCHIVES + MEDIA_ZONES) & (F.col("base") != REVIEW))


def review_path(frame: DataFrame, path: str, bases: DataFrame, depth: int) -> DataFrame:
    """Add ``category``: as ``normalise_category``, but a base is met in any case and a new root may be named."""
    keyed = frame.withColumn("_parts", trimmed(F.col(path)))
    prefixes = keyed.select(F.col(path).alias("_path"), "_parts").distinct().withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_parts"), F.lit(1)))))
    hits = prefixes.withColumn("_base", F.lower(F.array_join(F.slice("_parts", 1, F.col("_n")), "/")))
    own = bases.groupBy(F.lower("base").alias("_base")).agg(F.min("base").alias("_name"))
    best = hits.join(own, "_base", "left").groupBy("_path").agg(F.max_by(F.col("_name"), F.when(F.col("_name").isNotNull(), F.col("_n"))).alias("_name"), F.max(F.when(F.col("_name").isNotNull(), F.col("_n"))).alias("_n"), F.first("_parts").alias("_p"))
    rest = F.transform(F.slice("_p", F.coalesce("_n", F.lit(0)) + 1, F.size("_p")), safe_stem)
    full = F.concat(F.when(F.col("_name").isNotNull(), F.split("_name", "/")).otherwise(F.array().cast("array<string>")), rest)
    full = F.slice(full, 1, depth) if depth else full
    best = best.select("_path", F.nullif(F.array_join(full, "/"), F.lit("")).alias("category"))
    return keyed.join(best, keyed[path] == best["_path"], "left").drop("_parts", "_path")


def reroot(path: Column, old: str, new: str) -> Column:
    """A path below ``old`` moved below ``new``; others, the empty one too, as they are."""
    return F.when(path == old, F.lit(new)).when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(path)


def prefixes_of(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
