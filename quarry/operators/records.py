"""Catalogue rows and their fiches: listings, cleaning, routing, names, snapshots, batch summaries and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import cleaned, cleaned_list, cleaned_path, day, json_value, safe_stem, strip_timestamp
from quarry.functions.paths import REVIEW, dispatch, normalise_category, reroot, segments
from quarry.operators.catalog import DELETED, PENDING, STORED

LANGUAGE = "^[a-z]{2,8}(-[a-z]{2,8})?$"


def list_documents(rows: DataFrame) -> DataFrame:
    """All rows, the last updated first; decisions and check dates are not told."""
    return rows.drop("pending_decision", "last_verified_utc").orderBy(F.desc("updated_at_utc"), "doc_id")


def pending_decisions(rows: DataFrame) -> DataFrame:
    """Parked rows, the oldest first, with the reason and each option of their decision by number."""
    decision = F.from_json("pending_decision", "reason string, options array<string>")
    parked = rows.filter(F.col("status") == PENDING).select("doc_id", "updated_at_utc", decision.alias("d"))
    return parked.select("doc_id", "updated_at_utc", "d.reason", F.posexplode_outer("d.options").alias("n", "option")).orderBy("updated_at_utc", "doc_id", "n")


def confirmed_timestamps(rows: DataFrame) -> DataFrame:
    """When the content of each stored row was last known to be right."""
    return rows.filter(F.col("status") == STORED).select("doc_id", F.coalesce("last_verified_utc", "updated_at_utc").alias("confirmed_utc"))


def with_content(rows: DataFrame) -> DataFrame:
    """Stored rows whose fiche is a JSON object, with it as a variant."""
    parsed = json_value(F.col("content_json"))
    stored = rows.filter((F.col("status") == STORED) & F.col("content_json").isNotNull()).withColumn("fiche", parsed)
    return stored.filter(F.schema_of_variant("fiche").startswith("OBJECT"))


def clean_analysis(replies: DataFrame) -> DataFrame:
    """Typed columns of an analysis reply (doc_id, reply): each value of the wrong type is null."""
    parsed = replies.select("doc_id", json_value(F.col("reply")).alias("v"))
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get("v", p, "variant")) == "STRING", F.try_variant_get("v", p, "string"))
    items = lambda p: F.transform(F.try_variant_get("v", p, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    stem = F.regexp_replace(cleaned(text("$.name")), "^[\"']+|[\"']+$", "")
    date = F.trim(text("$.date"))
    return parsed.select(
        "doc_id",
        F.when(stem.isNotNull(), safe_stem(stem)).alias("name"),
        F.when(day(date).isNotNull(), date).alias("document_date"),
        cleaned_path(text("$.category")).alias("category_path"),
        cleaned_list(items("$.alternatives"), cleaned_path).alias("alternatives"),
        cleaned_list(items("$.keywords")).alias("keywords"),
    )


def effective_day(fiche_json: Column, modified: Column, now: Column) -> Column:
    """The date of a filed document: effective, else its own, else the file's, else today."""
    fiche = F.from_json(fiche_json, "effective_date string, document_date string")
    return F.coalesce(day(F.trim(fiche["effective_date"])), day(F.trim(fiche["document_date"])), modified, now)


def fiche_year(fiche_json: Column) -> Column:
    """The first four characters of a fiche's date, or of its effective one, where these are digits."""
    fiche = F.from_json(fiche_json, "effective_date string, document_date string")
    year = lambda x: F.when(x.rlike("^[0-9]{4}"), F.substring(x, 1, 4))
    return F.coalesce(year(fiche["document_date"]), year(fiche["effective_date"]))


def route(analyses: DataFrame, bases: DataFrame, depth: int) -> DataFrame:
    """Where each document goes: doc_id, route, options and reason.

    ``analyses`` has doc_id, organized_path, category_path, alternatives and
    reason.  The set's decision comes first, then the category, then the
    alternatives as options of a pending decision, else manual review.
    """
    asked = F.concat(F.array(F.struct(F.lit(0).alias("n"), F.col("organized_path").alias("path")), F.struct(F.lit(1).alias("n"), F.col("category_path").alias("path"))), F.transform(F.coalesce("alternatives", F.array().cast("array<string>")), lambda a, i: F.struct((i + 2).alias("n"), a.alias("path"))))
    each = analyses.select("doc_id", F.explode(asked).alias("a")).select("doc_id", "a.n", "a.path").filter("path is not null")
    good = normalise_category(each, "path", bases, depth).filter("category is not null")
    one = good.groupBy("doc_id", "category").agg(F.min("n").alias("n"))  # an option is told once
    alternatives = good.filter("n > 1").groupBy("doc_id", "category").agg(F.min("n").alias("n")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "category"))), lambda x: x["category"]).alias("options"))
    best = one.filter("n < 2").groupBy("doc_id").agg(F.min_by("category", "n").alias("placed"))
    j = analyses.select("doc_id", "reason").join(best, "doc_id", "left").join(alternatives, "doc_id", "left")
    placed = F.col("placed").isNotNull()
    return j.select(
        "doc_id",
        F.coalesce("placed", F.lit(REVIEW)).alias("route"),
        F.when(~placed, F.col("options")).alias("options"),
        F.when(~placed & F.col("options").isNotNull(), F.coalesce(F.nullif("reason", F.lit("")), F.lit("uncertain_with_options"))).alias("reason"),
    )


def with_series_entity(routes: DataFrame, bases: DataFrame, folders: DataFrame) -> DataFrame:
    """doc_id and route of ``routes`` (doc_id, route, series, issuer): a series at a bare base gets its issuer's folder below it.

    ``folders`` (path) are the library's; the first child of the base by name
    that is the issuer's slug in any case is used again.
    """
    asked = routes.join(bases.select(F.col("base").alias("route"), F.lit(True).alias("bare")).distinct(), "route", "left")
    entity = F.when(F.col("series") & F.col("bare"), F.nullif(safe_stem("issuer"), F.lit("")))
    asked = asked.withColumn("entity", F.when(F.trim(F.col("issuer")) != "", entity)).withColumn("low", F.lower("entity"))
    parent, child = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.substring_index("path", "/", -1)
    there = folders.select(parent.alias("route"), child.alias("child")).groupBy("route", F.lower("child").alias("low")).agg(F.min("child").alias("child"))
    j = asked.join(there, ["route", "low"], "left")
    return j.select("doc_id", F.concat_ws("/", "route", F.coalesce("child", "entity")).alias("route"))


def name_sync(rows: DataFrame) -> DataFrame:
    """doc_id, old and new name of stored rows whose file was renamed by hand."""
    stem = strip_timestamp(F.regexp_replace("current_filename", "(?<=[^.])\\.[^.]*$", ""))
    named = with_content(rows).select("doc_id", F.try_variant_get("fiche", "$.name", "string").alias("old_name"), stem.alias("new_name"))
    return named.filter((F.col("new_name") != "") & ~F.col("old_name").eqNullSafe(F.col("new_name")))


def enrich_keywords(rows: DataFrame, added: DataFrame, force: bool = False) -> DataFrame:
    """doc_id, outcome (enriched, skipped or failed) and keywords of stored rows with a fiche.

    ``added`` has doc_id and terms (array), as a translation gave them.
    """
    fiche = F.from_json("content_json", "keywords array<string>, keywords_enriched boolean")
    own = with_content(rows).select("doc_id", fiche.alias("f")).select("doc_id", F.coalesce("f.keywords", F.array().cast("array<string>")).alias("own"), F.coalesce("f.keywords_enriched", F.lit(False)).alias("done"))
    j = own.join(added.select("doc_id", "terms"), "doc_id", "left")
    none = F.coalesce(F.size("terms"), F.lit(0)) <= 0
    outcome = F.when(F.col("done") & F.lit(not force), "skipped").when(none, "failed").otherwise("enriched")
    j = j.withColumn("outcome", outcome)
    return j.select("doc_id", "outcome", F.when(F.col("outcome") == "enriched", F.array_distinct(F.concat("own", "terms"))).otherwise(F.col("own")).alias("keywords"))


def aligned(documents: DataFrame, verdicts: DataFrame, value: str, fallback: str) -> DataFrame:
    """Each document of a set (set_id, index) with the verdict of its place, the last one told, or its own fallback.

    ``verdicts`` has set_id, seq, index and ``value``; one outside the set is left out.
    """
    last = verdicts.groupBy("set_id", "index").agg(F.max_by(F.struct(value), "seq").alias("v"))
    told = F.when(F.col("v").isNotNull(), cleaned_path(F.col(f"v.{value}"))).otherwise(F.col(fallback))
    return documents.join(last, ["set_id", "index"], "left").withColumn(value, told).drop("v")


def find_listed(references: DataFrame, listed: DataFrame) -> DataFrame:
    """doc_id and path of each reference (doc_id, ref): the listed path itself, else the only one of that bare name."""
    bare = lambda x: strip_timestamp(F.try_element_at(F.split(x, "/"), F.lit(-1)))
    refs = references.select("doc_id", F.regexp_replace(F.trim("ref"), "^/+|/+$", "").alias("ref")).filter("ref != ''").withColumn("bare", bare(F.col("ref")))
    paths = listed.select(F.col("path").alias("ref")).distinct()
    names = paths.groupBy(bare(F.col("ref")).alias("bare")).agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("only"))
    j = refs.join(paths.withColumn("exact", F.col("ref")), "ref", "left").join(names.filter("n = 1"), "bare", "left")
    return j.select("doc_id", F.coalesce("exact", "only").alias("path"))


def regroup_guards(moves: DataFrame, listed: DataFrame, rows: DataFrame) -> DataFrame:
    """path, target and refusal (null if it may go) of files that a grouping would move deeper."""
    known = rows.groupBy("path").agg(F.max_by("status", "updated_at_utc").alias("status"))
    j = moves.join(listed.select("path").distinct().withColumn("_listed", F.lit(True)), "path", "left").join(known, "path", "left")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    refusal = F.when(F.col("_listed").isNull(), "not_listed").when(F.col("status").isNull(), "not_catalogued").when(F.col("status") != STORED, "not_stored").when(~F.col("target").startswith(F.concat(parent, F.lit("/"))), "not_deeper")
    return j.select("path", "target", refusal.alias("refusal"))


def nesting_conflicts(paths: DataFrame, collapsed: Column) -> DataFrame:
    """Collapsed paths that several paths would share."""
    return paths.withColumn("collapsed", collapsed).groupBy("collapsed").agg(F.count_distinct("path").alias("n")).filter("n > 1")


def snapshot(rows: DataFrame, library_root: str, now: str, source: str) -> DataFrame:
    """section, updated_at_utc, doc_id and value: the lines of a snapshot, which in that order are one JSON document.

    The first line has the meta data, then comes a line a row, the last updated
    first, with its fiche inline, then the end.  So a catalogue of any size is
    written by many tasks, and only a reader of the whole file needs it whole.
    """
    columns = [c for c in rows.columns if c not in ("content_json", "pending_decision", "last_verified_utc")]
    parsed = json_value(F.col("content_json"))
    content = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    text = F.to_json(F.struct(*columns, content.alias("content")), {"ignoreNullFields": "false"})
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max("updated_at_utc").alias("latest"))
    newest = rows.agg(F.max_by("doc_id", F.struct("updated_at_utc", -F.col("doc_id"))).alias("first_id"))  # one row
    meta = F.struct(F.lit("1.0").alias("schema_version"), F.lit(now).alias("generated_at_utc"), F.lit(source).alias("source_db"), F.lit(library_root).alias("library_root"), F.col("n").alias("documents_count"), F.col("latest").alias("last_update_utc"))
    none = [F.lit(None).cast("string").alias("updated_at_utc"), F.lit(None).cast("long").alias("doc_id")]
    first = head.select(F.lit(0).alias("section"), *none, F.concat(F.lit('{"meta": '), F.to_json(meta), F.lit(', "documents": [')).alias("value"))
    each = rows.select("updated_at_utc", "doc_id", text.alias("t")).join(F.broadcast(newest), F.col("doc_id") == F.col("first_id"), "left")
    each = each.select(F.lit(1).alias("section"), "updated_at_utc", "doc_id", F.when(F.col("first_id").isNull(), F.concat(F.lit(","), F.col("t"))).otherwise(F.col("t")).alias("value"))
    last = rows.sparkSession.range(1).select(F.lit(2).alias("section"), *none, F.lit("]}").alias("value"))
    return first.unionByName(each).unionByName(last).orderBy("section", F.desc("updated_at_utc"), "doc_id")


def snapshot_documents(lines: DataFrame, document: str) -> DataFrame:
    """The documents (a struct in DDL) of the lines of a snapshot; a broken line has none."""
    own = F.regexp_replace("value", "^,", "")
    return lines.filter("section = 1").select(F.from_json(own, document).alias("d")).select("d.*")


def rebuild(documents: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """Catalogue rows of snapshot documents, their paths below a new root."""
    return documents.withColumn("current_path", reroot(F.col("current_path"), old_root, new_root))


def verify_catalog(rows: DataFrame | None, documents: DataFrame | None) -> DataFrame:
    """One row: what is there of a catalogue and its snapshot, their counts, and whether one can mend the other."""
    spark = (rows if rows is not None else documents).sparkSession
    none = spark.range(1).select(F.lit(None).cast("long").alias("n"))
    count = lambda x: none if x is None else x.agg(F.count(F.lit(1)).alias("n"))
    j = count(rows).withColumnRenamed("n", "db_count").join(count(documents).withColumnRenamed("n", "snapshot_count"))  # one row each
    there, kept = F.col("db_count").isNotNull(), F.col("snapshot_count").isNotNull()
    return j.select("db_count", "snapshot_count", there.alias("integrity_ok"), kept.alias("snapshot_present"), (there & kept & (F.col("db_count") == F.col("snapshot_count"))).alias("in_sync"), (~there & kept).alias("recoverable"))


def dry_run(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: total, duplicates, manual_reviews and processed of an inbox (ord, path, sha256), the first of equals counting."""
    known = rows.filter(F.col("status") != DELETED).select("sha256").distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("ord")) == 1
    j = files.withColumn("_first", first).join(known, "sha256", "left")
    twice = ~F.col("_first") | F.col("_known").isNotNull()
    readable = dispatch(F.try_element_at(segments(F.col("path")), F.lit(-1)))["reason"] == "known"
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(twice).alias("duplicates"), F.count_if(~twice & ~readable).alias("manual_reviews"), F.count_if(~twice & readable).alias("processed"))


def estimate_calls(files: DataFrame, chains: dict[str, bool]) -> DataFrame:
    """One row of call counts by task, fewest and most, of an inbox (path, has_audio, has_video, seconds).

    ``chains`` tells which tasks have a provider; a task without one makes no
    calls.  An audio or video file without a duration can't be read.
    """
    from quarry.functions.exprs import frame_budget

    has = {t: F.lit(bool(chains.get(t))) for t in ("IMAGE", "OCR", "TRANSCRIBE", "VIDEO", "ANALYSIS", "NAMING", "ORGANIZE")}
    kind = dispatch(F.try_element_at(segments(F.col("path")), F.lit(-1)))["media_type"]
    f = files.withColumn("kind", kind)
    av = F.col("kind").isin("audio", "video") & (F.coalesce("seconds", F.lit(0.0)) > 0)
    frames = F.when(av & F.col("has_video"), frame_budget(F.col("seconds"))).otherwise(0)
    top = F.when(F.size(segments(F.col("path"))) > 1, segments(F.col("path"))[0])
    one = f.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("kind") == "image").alias("vision"),
        F.count_if(F.col("kind") == "pdf").alias("maybe_ocr"),
        F.count_if(~F.col("kind").isin("image", "pdf", "text", "office") & ~av).alias("unreadable"),
        F.count_if(av & F.col("has_audio")).alias("transcribe"),
        F.coalesce(F.sum(frames), F.lit(0)).alias("frames"),
        F.count_if(av & F.col("has_audio") & (frames > 2)).alias("highlights"),
        F.count_distinct(top).alias("sets"),
    )
    gate = lambda c, *tasks: F.when(F.forall(F.array(*[has[t] for t in tasks]), lambda x: x), c).otherwise(F.lit(0))
    image = gate(F.col("vision"), "IMAGE") + gate(F.col("frames"), "IMAGE")
    ocr = gate(F.col("maybe_ocr"), "OCR") + gate(F.col("vision"), "OCR", "IMAGE")
    tasks = {
        "IMAGE": (image, image), "OCR": (F.lit(0), ocr), "TRANSCRIBE": (gate(F.col("transcribe"), "TRANSCRIBE"),) * 2, "VIDEO": (gate(F.col("highlights"), "TRANSCRIBE", "VIDEO"),) * 2,
        "ANALYSIS": (gate(F.col("files") - F.col("unreadable"), "ANALYSIS"),) * 2, "NAMING": (gate(F.col("sets"), "NAMING"),) * 2, "ORGANIZE": (gate(F.col("sets"), "ORGANIZE"),) * 2,
    }
    rows = F.array(*[F.struct(F.lit(t).alias("task"), low.cast("long").alias("calls_low"), high.cast("long").alias("calls_high")) for t, (low, high) in tasks.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")


# What a call of a task weighs until it has been measured (tokens in, tokens out, pages), and the tasks whose values are guesses.
DEFAULT_PROFILES = {
    "ANALYSIS": (2650.0, 300.0, 0.0),
    "VIDEO": (2000.0, 200.0, 0.0),
    "NAMING": (1060.0, 250.0, 0.0),
    "ORGANIZE": (1060.0, 250.0, 0.0),
    "IMAGE": (1500.0, 350.0, 0.0),
    "OCR": (0.0, 0.0, 2.0),
}
COARSE_TASKS = ("IMAGE", "OCR")
PRICES = ("in_per_mtok", "out_per_mtok", "per_1k_pages", "per_audio_minute", "per_audio_second")


def forecast(calls: DataFrame, chain: DataFrame, measured: DataFrame, prices: DataFrame, local: tuple[str, ...], audio_seconds: float = 0.0, ceiling: float | None = None) -> DataFrame:
    """One row: low and high cost of the calls to come, and what the figure rests on.

    ``calls`` has task, calls_low, calls_high; ``chain`` task, provider and model (the
    first entry); ``measured`` task, mean_in, mean_out, mean_pages of tasks with a
    history, others weigh DEFAULT_PROFILES; ``prices`` provider, model,
    currency, the columns PRICES, free, absent_since.  Means times counts are
    cut to whole units; transcription is billed by ``audio_seconds``
    alone.  Each unit costs what the table names a price for.  A model without any
    price is told as unpriced, unless its provider is local, and makes the
    figure a floor; tasks without a chain make no calls.  Several currencies give no total.
    calibrated, coarse, currencies, unpriced and withdrawn (model:day) are sorted texts.
    """
    spark = calls.sparkSession
    seeds = spark.createDataFrame([(t, *v) for t, v in DEFAULT_PROFILES.items()], "task string, seed_in double, seed_out double, seed_pages double")
    told = measured.select("task", F.struct("mean_in", "mean_out", "mean_pages").alias("m"))
    j = calls.filter("calls_high > 0").join(chain, "task").join(told, "task", "left").join(F.broadcast(seeds), "task", "left").join(prices, ["provider", "model"], "left")
    audio, free = F.col("task") == "TRANSCRIBE", F.coalesce("free", F.lit(False))
    priced = free | F.coalesce(*PRICES).isNotNull()
    weight = lambda name: F.when(F.col("m").isNotNull(), F.coalesce(f"m.mean_{name}", F.lit(0.0))).otherwise(F.coalesce(f"seed_{name}", F.lit(0.0)))
    units = lambda n, name: F.when(audio, 0).otherwise(F.floor(F.col(n) * weight(name)))
    seconds = F.when(audio, F.lit(float(audio_seconds))).otherwise(0.0)
    cost = lambda x, price: F.coalesce(x * F.col(price), F.lit(0.0))
    part = lambda n: F.when(priced & ~free, cost(units(n, "in") / 1e6, "in_per_mtok") + cost(units(n, "out") / 1e6, "out_per_mtok") + cost(units(n, "pages") / 1e3, "per_1k_pages") + cost(seconds / 60, "per_audio_minute") + cost(seconds, "per_audio_second")).otherwise(0.0)
    names = lambda when, c: F.array_join(F.array_sort(F.collect_set(F.when(when, c))), ",")
    seen = F.col("m").isNotNull()
    one = j.agg(
        F.coalesce(F.sum(part("calls_low")), F.lit(0.0)).alias("low"), F.coalesce(F.sum(part("calls_high")), F.lit(0.0)).alias("high"),
        F.coalesce(F.sum(F.when(priced, F.col("calls_low"))), F.lit(0)).alias("calls_low"), F.coalesce(F.sum(F.when(priced, F.col("calls_high"))), F.lit(0)).alias("calls_high"),
        names(priced, F.col("currency")).alias("currencies"), names(~priced & ~F.col("provider").isin(*local), F.col("model")).alias("unpriced"),
        names(priced & ~audio & seen, F.col("task")).alias("calibrated"), names(priced & ~seen & F.col("task").isin(*COARSE_TASKS), F.col("task")).alias("coarse"),
        names(priced & F.col("absent_since").isNotNull(), F.concat_ws(":", "model", "absent_since")).alias("withdrawn"),
    )
    several = F.col("currencies").contains(",")
    one = one.select(
        F.when(~several, F.round("low", 9)).alias("cost_low"), F.when(~several, F.round("high", 9)).alias("cost_high"), "calls_low", "calls_high", "currencies", "unpriced", "calibrated", "coarse", "withdrawn", (F.col("unpriced") != "").alias("is_floor"),
    )
    return one.withColumn("over_ceiling", F.coalesce(F.col("cost_high") > ceiling, F.lit(False)) if ceiling is not None else F.lit(False))


def price_tables(tables: DataFrame) -> DataFrame:
    """The rows of the first table of a seller's prices that is usable, by priority (priority, usable, ...)."""
    first = tables.filter("usable").agg(F.min("priority").alias("priority"))
    return tables.join(F.broadcast(first), "priority").drop("usable")  # one row


def model_families(rows: DataFrame) -> DataFrame:
    """provider, model, family of a mapping column (``provider:model`` to family); malformed entries are left out."""
    each = rows.select(F.explode("families").alias("key", "family")).filter(F.col("key").contains(":") & cleaned(F.col("family")).isNotNull())
    return each.select(F.lower(F.trim(F.substring_index("key", ":", 1))).alias("provider"), F.trim(F.regexp_extract("key", "^[^:]*:(.*)$", 1)).alias("model"), F.trim("family").alias("family"))


def can_price(prices: DataFrame, wanted: DataFrame, local: tuple[str, ...]) -> DataFrame:
    """One row, ``can_price``: whether every paid seller has a model with a price, its own or any seller's; any at all if none is named."""
    priced = F.coalesce(F.col("free"), F.lit(False)) | F.col("in_per_mtok").isNotNull() | F.col("out_per_mtok").isNotNull()
    have = prices.filter(priced).select("provider").distinct()
    any_seller = have.agg(F.count_if(F.col("provider") == "*").alias("n_any"), F.count(F.lit(1)).alias("n"))
    paid = wanted.filter(~F.col("provider").isin(*local)).select("provider").distinct()
    j = paid.join(have.withColumn("has", F.lit(True)), "provider", "left").agg(F.count(F.lit(1)).alias("sellers"), F.count_if(F.col("has").isNull()).alias("without"))
    one = j.join(any_seller)  # one row each
    return one.select(F.when(F.col("sellers") == 0, F.col("n") > 0).otherwise((F.col("n_any") > 0) | (F.col("without") == 0)).alias("can_price"))


def refresh_due(checked: Column, now: Column, days: int = 7) -> Column:
    """Whether a week has passed since the last attempt, or there was none."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(checked) >= days * 86400, F.lit(True))


def overdue(last: Column, now: Column, days: int = 30) -> Column:
    """Whether a reminder is due: never done, or at least so many whole days ago."""
    return F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(last)) / 86400) >= days, F.lit(True))


def user_language(setting: str | None, majority: DataFrame) -> DataFrame:
    """One row, ``language``: the setting, else the majority's, where they look like a code, else English."""
    code = lambda c: F.when(c.rlike(LANGUAGE), c)
    return majority.agg(F.first("language").alias("m")).select(F.coalesce(code(F.lit(setting).cast("string")), code(F.col("m")), F.lit("en")).alias("language"))


def media_tags(probes: DataFrame, labels: dict[str, str]) -> DataFrame:
    """doc_id and tags: labelled tags of a probe (doc_id, probe in JSON), the container's before the streams', the first of a name."""
    shape = "format struct<tags: map<string,string>>, streams array<struct<tags: map<string,string>>>"
    p = probes.select("doc_id", F.from_json("probe", shape).alias("p"))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    entries = lambda m: F.coalesce(F.map_entries(m), empty)
    every = F.concat(entries(F.col("p.format.tags")), F.flatten(F.transform(F.coalesce("p.streams", F.array().cast("array<struct<tags:map<string,string>>>")), lambda s: entries(s["tags"]))))
    tags = F.filter(F.transform(every, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), cleaned(e["value"]).alias("value"))), lambda e: e["value"].isNotNull())
    pick = lambda name: F.get(F.filter("t", lambda e: e["key"] == name), 0)["value"]
    return p.select("doc_id", tags.alias("t")).select("doc_id", F.filter(F.array(*[F.struct(F.lit(label).alias("label"), pick(key).alias("value")) for key, label in labels.items()]), lambda x: x["value"].isNotNull()).alias("tags"))


# A number as a probe writes it; a sign, fraction or exponent may be there.
_SECONDS = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"


def media_probe(probes: DataFrame) -> DataFrame:
    """Duration, kinds of streams and verdict of a media probe's answer.

    Takes ``code`` (the exit of the probe, null where the file was not there)
    and ``probe`` (its answer in JSON) and adds duration_seconds, has_audio,
    has_video, ok and reason; other columns stay.  An answer that is not JSON,
    or of another exit than 0, is ``unreadable_media``, one without a stream of
    sound or pictures ``no_media_stream``; both tell no duration.  A duration
    that is no number, not finite or below 0 is 0; streams that are no objects
    are passed over.  An object that names a key twice counts as not JSON.
    """
    read = probes.withColumn("_v", F.when(F.col("code") == 0, json_value(F.col("probe"))))
    streams = F.coalesce(F.try_variant_get("_v", "$.streams", "array<variant>"), F.array().cast("array<variant>"))
    read = read.withColumn("_kinds", F.transform(streams, lambda s: F.try_variant_get(s, "$.codec_type", "string")))
    raw = F.trim(F.try_variant_get("_v", "$.format.duration", "string"))
    seconds = F.when(raw.rlike(_SECONDS), raw.try_cast("double"))
    sound, pictures = F.array_contains(F.array_compact("_kinds"), "audio"), F.array_contains(F.array_compact("_kinds"), "video")
    reason = F.when(F.col("code").isNull(), "file_missing").when(F.col("_v").isNull(), "unreadable_media").when(~(sound | pictures), "no_media_stream")
    out = read.select(*probes.columns, reason.alias("reason"), seconds.alias("_s"), sound.alias("has_audio"), pictures.alias("has_video"))
    ok = F.col("reason").isNull()
    usable = ok & (F.col("_s") >= 0) & (F.col("_s") < float("inf"))
    return out.select(
        *probes.columns, F.when(usable, F.col("_s")).otherwise(0.0).alias("duration_seconds"), (ok & F.col("has_audio")).alias("has_audio"), (ok & F.col("has_video")).alias("has_video"), ok.alias("ok"), "reason"
    )


def stranded(files: DataFrame, origins: DataFrame, inbox: str) -> DataFrame:
    """path and target of files left in the queue: back to where they came from inside the inbox, else to its root."""
    j = files.join(origins.select(F.col("queued").alias("path"), "origin"), "path", "left")
    name = F.try_element_at(segments(F.col("path")), F.lit(-1))
    return j.select("path", F.when(F.col("origin").startswith(inbox + "/"), F.col("origin")).otherwise(F.concat(F.lit(inbox + "/"), name)).alias("target"))


def checks(*tables: tuple[str, DataFrame]) -> DataFrame:
    """check, state and detail of several diagnostic tables under one another."""
    out = None
    for name, rows in tables:
        part = rows.select(F.lit(name).alias("check"), "state", F.col("detail").cast("string").alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def through(rows: DataFrame, task: Callable[[DataFrame], DataFrame] | None, fallback: dict[str, Column]) -> DataFrame:
    """Rows through an injected task (a call to a model, say), one row of columns by doc_id; the fallback where it tells nothing.

    Without a task every row takes the fallback, as an installation without a provider does.
    """
    if task is None:
        return rows.select("*", *[c.alias(n) for n, c in fallback.items()])
    told = task(rows).select("doc_id", F.struct(*fallback).alias("_told"))
    return rows.join(told, "doc_id", "left").select(*rows.columns, *[F.coalesce(F.col(f"_told.{n}"), c).alias(n) for n, c in fallback.items()])
