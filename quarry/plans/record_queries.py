"""Queries over inventories, catalogue rows and fiches, with their oracles.

The test tables have no file tree and no fiches: the inputs are columns made of
``documents`` by expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import exprs as E
from quarry.functions import paths as P
from quarry.operators import catalog as C
from quarry.operators import inventory as I
from quarry.operators import metering as M
from quarry.operators import records as R
from quarry.operators import sampling as G
from quarry.plans.search_queries import _bm25, _index, scrub_matrix
from quarry.sources.readers import table

NOW = "2026-01-01 00:00:00"
FILES = {
    "doc_id": "doc_id",
    "path": """CASE doc_id % 12 WHEN 0 THEN 'Personal/Hobbies/' || lang || '/f' || doc_id || '.txt' WHEN 1 THEN 'Work/Business/Clients/' || source || '/f' || doc_id || '.pdf'
        WHEN 2 THEN 'Personal/Archive/old/' || lang || '/f' || doc_id || '.docx' WHEN 3 THEN 'Media/Music/' || source || '/t' || doc_id || '.mp3' WHEN 4 THEN 'Work/code/' || source || '/src/m' || doc_id || '.sh'
        WHEN 5 THEN 'Work/code/' || source || '/.git/objects/o' || doc_id WHEN 6 THEN '.hidden/h' || doc_id || '.txt' WHEN 7 THEN 'Personal/Administrative/Taxes/2024/' || lang || '/deep/f' || doc_id || '.pdf'
        WHEN 8 THEN 'loose' || doc_id || '.JPG' WHEN 9 THEN 'Drop' || (doc_id % 5) || '/a/f' || doc_id || '.mp4' WHEN 10 THEN 'Manual_Review/f' || doc_id ELSE 'Personal/Hobbies/f' || doc_id || '.weird' END""",
    "size": "n_chars * 1000",
    "mtime": "CAST(1767225600 - doc_id * 7200 AS DOUBLE)",
    "is_symlink": "doc_id % 29 = 0",
}
ROWS = {
    "doc_id": "doc_id",
    "current_filename": "'2024-05-06_10-11-12__' || source || '-' || doc_id || '.txt'",
    "current_path": "CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 10 = 9 THEN '/older/lib/x' ELSE '/old/lib/' || lang || '/f' || doc_id END",
    "status": "CASE WHEN doc_id % 11 = 0 THEN 'DELETED' WHEN doc_id % 7 = 0 THEN 'DECISION_PENDING' ELSE 'LIBRARY_STORED' END",
    "updated_at_utc": "'2026-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || 'T00:00:00Z'",
    "content_json": """CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'no json' WHEN doc_id % 17 = 0 THEN '[1]' ELSE '{"name": "' || source || '-' || (doc_id - doc_id % 3) || '", "keywords": ["k' || (doc_id % 4) || '", "x"], "keywords_enriched": '
        || (CASE WHEN doc_id % 6 = 1 THEN 'true' ELSE 'false' END) || ', "document_date": "' || (CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE '2024-3-' || (doc_id % 30 + 1) END) || '", "effective_date": ' || (CASE WHEN doc_id % 9 = 0 THEN '"2023-12-31"' ELSE 'null' END) || '}' END""",
    "pending_decision": """CASE WHEN doc_id % 7 = 0 THEN '{"reason": "r' || (doc_id % 2) || '", "options": [' || (CASE WHEN doc_id % 3 = 0 THEN '' ELSE '"A/' || lang || '", "B"' END) || ']}' END""",
    "last_verified_utc": "CASE WHEN doc_id % 3 = 0 THEN '2026-02-01T00:00:00Z' END",
}


def _made(spark, d, columns, of="documents"):
    return table(spark, d, of).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _sql(columns, of="documents"):
    return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {of})"


_F, _R = _sql(FILES), _sql(ROWS)
#: DuckDB: the folders above a path, and whether a file is in a zone that is kept.
_UP = "list_transform(range(1, len(string_split({p}, '/'))), lambda i: array_to_string(string_split({p}, '/')[1:i], '/'))"
_ZONE = f"""z AS (SELECT f.*, path LIKE 'Personal/Archive/%' OR path LIKE 'Work/Archive/%' OR path LIKE 'Media/%' OR EXISTS (SELECT 1 FROM {_F} g WHERE g.path LIKE '%/.git/%' AND starts_with(f.path, split_part(g.path, '.git/', 1))) AS in_zone
    FROM {_F} f WHERE NOT is_symlink AND path NOT LIKE '.%' AND path NOT LIKE '%/.%')"""
_KIND = "CASE WHEN {p} LIKE '%.txt' OR {p} LIKE '%.docx' OR {p} LIKE '%.sh' THEN 'text' WHEN {p} LIKE '%.pdf' THEN 'pdf' WHEN {p} LIKE '%.mp3' THEN 'audio' WHEN {p} LIKE '%.mp4' THEN 'video' WHEN lower({p}) LIKE '%.jpg' THEN 'image' ELSE 'unknown' END"
_kind = _KIND.replace("{p}", "path")
_OBJ = "status = 'LIBRARY_STORED' AND content_json LIKE '{%'"

# ---- walks -----------------------------------------------------------------


def inbox_walk(spark, d):
    return I.inbox_files(_made(spark, d, FILES)).select("path", "size")


def library_walk(spark, d):
    return I.library_files(_made(spark, d, FILES)).select("path")


def indexable_walk(spark, d):
    return I.index_eligible(I.indexable_files(_made(spark, d, FILES))).select("path", "size")


def repository_roots(spark, d):
    return I.repository_roots(_made(spark, d, FILES))


def category_paths(spark, d):
    return I.category_paths(_made(spark, d, FILES))


def branch_files(spark, d):
    return I.branch_files(_made(spark, d, FILES), "Personal/Administrative/Taxes/2024")


def empty_folders(spark, d):
    files = _made(spark, d, FILES)
    folders = files.select(F.explode(P.prefixes_of(F.col("path"))).alias("path")).distinct()
    return I.empty_folders(folders, files.filter("doc_id % 12 in (0, 4, 7) and doc_id % 3 != 0"))


def nearest_branches(spark, d):
    wanted = _made(spark, d, {"doc_id": "doc_id", "a": "'Personal/Hobbies/' || lang || '/new'", "b": "'Work/Business/Clients/none/none'", "c": "'Personal/Hobbies/' || lang", "e": "'Personal/Misc/x'"})
    wanted = wanted.select("doc_id", F.posexplode(F.array("a", "b", "c", "e")).alias("ord", "path"))
    return I.nearest_branches(wanted, _made(spark, d, FILES))


def body_texts(spark, d):
    files = _made(spark, d, FILES | {"text": "text"})
    beside = files.filter("doc_id % 4 = 0").select(F.regexp_replace("path", "([^/]+)$", ".$1.txt").alias("path"), F.concat(F.lit("ocr "), "doc_id").alias("text"))
    out = I.bodies(files, beside, files.filter("doc_id % 4 != 1").select("path", "text"))
    return out.select("doc_id", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("sha256"))


def work_sets(spark, d):
    return I.work_sets(_made(spark, d, FILES)).select("folder", "set_key", "n_files")


def repository_inventory(spark, d):
    files = _made(spark, d, FILES).filter("path like 'Work/code/%'").withColumn("root", F.regexp_extract("path", "^(Work/code/[^/]+)", 1))
    total = files.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return I.extensions(files).crossJoin(total.agg(F.count(F.lit(1)).alias("n_roots")))  # six rows by one


def mirror_plan(spark, d):
    files = _made(spark, d, FILES | {"sha256": "lang || doc_id"})
    mirror = files.filter("doc_id % 3 != 0").withColumn("sha256", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("sha256")))
    return I.mirror_plan(files, mirror)


def trash_expired(spark, d):
    return I.expired(_made(spark, d, FILES), F.lit(NOW).cast("timestamp"), 30).agg(F.count(F.lit(1)).alias("n"), F.min("mtime").alias("oldest"))


def zones(spark, d):
    ext = F.coalesce(P.suffixes(F.col("path"))[1], F.lit(""))
    x = _made(spark, d, FILES).select("doc_id", P.within(F.col("path"), P.ARCHIVES).alias("in_archive"), P.within(F.col("path"), P.MEDIA_ZONES).alias("in_media"), P.hidden(F.col("path")).alias("is_hidden"), P.vision_readable(ext).alias("vision"))
    return x


_LABEL = "CASE doc_id % 17 WHEN 16 THEN NULL WHEN 15 THEN 'Nowhere' ELSE {0} END"
_BASE_LIST = [*sorted(P.BASE_FOLDERS)]


def classifiable_folders(spark, d):
    """Documents by the base folder that a label names, of the folders that a document may be filed in."""
    names = ", ".join(f"'{b}'" for b in _BASE_LIST)
    made = _made(spark, d, {"base": _LABEL.format(f"element_at(array({names}), CAST(n_chars % {len(_BASE_LIST)} AS INT) + 1)")})
    return made.join(P.classifiable(spark), "base").groupBy("base").agg(F.count(F.lit(1)).alias("n"))


# ---- rows and fiches -------------------------------------------------------


def list_documents(spark, d):
    return R.list_documents(_made(spark, d, ROWS))


def pending_decisions(spark, d):
    return R.pending_decisions(_made(spark, d, ROWS)).withColumn("n", F.col("n").cast("long"))


def confirmed_timestamps(spark, d):
    return R.confirmed_timestamps(_made(spark, d, ROWS))


def name_sync(spark, d):
    return R.name_sync(_made(spark, d, ROWS))


def enrich_keywords(spark, d):
    terms = _made(spark, d, {"doc_id": "doc_id", "terms": "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE lang || ',x,k1' END"}).withColumn("terms", F.split("terms", ","))
    return R.enrich_keywords(_made(spark, d, ROWS), terms).withColumn("keywords", F.array_join("keywords", ","))


def fiche_dates(spark, d):
    fiche = F.col("content_json")
    day = R.effective_day(fiche, F.when(F.col("doc_id") % 2 == 0, F.lit("2025-05-05").cast("date")), F.lit("2026-01-01").cast("date"))
    return _made(spark, d, ROWS).filter("content_json like '{%'").select("doc_id", day.cast("string").alias("day"), R.fiche_year(fiche).alias("year"))


REPLY = {
    "doc_id": "doc_id",
    "reply": """'{"name": ' || (CASE WHEN doc_id % 4 = 0 THEN '17' ELSE '" `Tax  letter ' || lang || '` "' END) || ', "date": "' || (CASE WHEN doc_id % 3 = 0 THEN '2024-02-31' ELSE '2024-02-11' END)
        || '", "category": ' || (CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '" /Personal/' || (CASE WHEN doc_id % 2 = 0 THEN 'Hobbies' ELSE 'Nowhere' END) || '/' || lang || '/ "' END)
        || ', "alternatives": ["Work/Business/", 3, " ", "Nope", "Work/Business"], "keywords": ["' || source || '", " ", null, " b "]}'""",
}


def clean_analysis(spark, d):
    out = R.clean_analysis(_made(spark, d, REPLY))
    return out.withColumns({c: F.array_join(c, "|") for c in ("alternatives", "keywords")})


def route_analysis(spark, d):
    a = R.clean_analysis(_made(spark, d, REPLY)).withColumns({"organized_path": F.when(F.col("doc_id") % 10 == 0, "Work/Misc/Sub folder"), "reason": F.when(F.col("doc_id") % 7 == 0, F.lit("low"))})
    a = a.withColumn("alternatives", F.when(F.col("doc_id") % 3 != 0, F.col("alternatives")))
    return R.route(a, P.classifiable(spark), 4).withColumn("options", F.array_join("options", "|"))


def review_route(spark, d):
    rows = _made(spark, d, {"doc_id": "doc_id", "label": "CASE doc_id % 4 WHEN 0 THEN 'personal/HOBBIES/ My ' || lang WHEN 1 THEN 'New Root/' || source WHEN 2 THEN ' / ' ELSE 'WORK/misc/a/b/c/d' END"})
    return P.review_path(rows, "label", P.classifiable(spark), 4).select("doc_id", "category")


def placements(spark, d):
    docs = _made(spark, d, {"set_id": "CAST(floor(doc_id / 10) AS BIGINT)", "index": "doc_id % 10", "own": "'own/' || source"})
    told = _made(spark, d, {"set_id": "CAST(floor(doc_id / 10) AS BIGINT)", "seq": "doc_id", "index": "(doc_id * 3) % 14", "path": "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE '/told/' || lang || '/' END"})
    return R.aligned(docs, told, "path", "own").select("set_id", "index", "path")


def listed_files(spark, d):
    listed = _made(spark, d, {"path": "lang || '/2024-05-06_10-11-12__' || source || '-' || (doc_id % 40) || '.txt'"})
    refs = _made(spark, d, {"doc_id": "doc_id", "ref": "CASE doc_id % 3 WHEN 0 THEN '/' || lang || '/2024-05-06_10-11-12__' || source || '-' || (doc_id % 40) || '.txt' WHEN 1 THEN source || '-' || (doc_id % 60) || '.txt' ELSE '/ ' END"})
    return R.find_listed(refs, listed)


def regroup_refusals(spark, d):
    path = "lang || '/f' || doc_id"
    moves = _made(spark, d, {"doc_id": "doc_id", "path": path, "target": "CASE WHEN doc_id % 4 = 0 THEN 'xx/f' || doc_id ELSE lang || '/deep/f' || doc_id END"})
    rows = _made(spark, d, ROWS | {"path": path}).filter("doc_id % 9 != 0")
    return R.regroup_guards(moves, moves.filter("doc_id % 5 != 0"), rows).select("path", "refusal")


def nesting_conflicts(spark, d):
    paths = _made(spark, d, {"path": "lang || '/' || lang || '/' || source || (CASE WHEN doc_id % 3 = 0 THEN '/' || source ELSE '' END)"})
    return R.nesting_conflicts(paths, P.collapse_nesting(F.col("path")))


SNAPSHOT = "doc_id bigint, current_filename string, current_path string, status string, updated_at_utc string, content struct<name:string,document_date:string>"


def snapshot_rebuild(spark, d):
    lines = R.snapshot(_made(spark, d, ROWS), "/old/lib", "2026-02-01T00:00:00Z", "catalog")
    rows = R.rebuild(R.snapshot_documents(lines, SNAPSHOT), "/old/lib", "/new")
    return rows.select("doc_id", "current_path", "status", F.col("content.name").alias("name"))


def snapshot_meta(spark, d):
    first = R.snapshot(_made(spark, d, ROWS), "/old/lib", "2026-02-01T00:00:00Z", "catalog").filter("section = 0")
    get = lambda p: F.get_json_object(F.concat("value", F.lit("]}")), f"$.meta.{p}")
    return first.select(get("documents_count").cast("long").alias("n"), get("last_update_utc").alias("latest"), get("library_root").alias("root"))


def verify_catalog(spark, d):
    rows = _made(spark, d, ROWS)
    a, b, c = R.verify_catalog(rows, rows.filter("doc_id % 2 = 0")), R.verify_catalog(None, rows), R.verify_catalog(rows, rows)
    return a.withColumn("case", F.lit("stale")).unionByName(b.withColumn("case", F.lit("lost"))).unionByName(c.withColumn("case", F.lit("same")))


def dry_run_batch(spark, d):
    files = _made(spark, d, FILES | {"text": "text"}).select(F.col("doc_id").alias("ord"), "path", F.sha2("text", 256).alias("sha256"))
    rows = _made(spark, d, ROWS | {"text": "text"}).filter("doc_id % 6 = 0").select("status", F.sha2("text", 256).alias("sha256"))
    return R.dry_run(files, rows)


AV = FILES | {"has_audio": "doc_id % 24 != 9", "has_video": "doc_id % 12 = 9", "seconds": "CASE WHEN doc_id % 36 = 3 THEN 0.0 ELSE CAST(doc_id % 2000 AS DOUBLE) END"}


def calls_estimate(spark, d):
    every = dict.fromkeys(("IMAGE", "OCR", "TRANSCRIBE", "VIDEO", "ANALYSIS", "NAMING", "ORGANIZE"), True)
    a = R.estimate_calls(_made(spark, d, AV), every).withColumn("chains", F.lit("all"))
    return a.unionByName(R.estimate_calls(_made(spark, d, AV), every | {"OCR": False, "TRANSCRIBE": False}).withColumn("chains", F.lit("some")))


def stranded_files(spark, d):
    files = _made(spark, d, {"path": "'queue/q' || doc_id || '.txt'"})
    origins = _made(spark, d, {"queued": "'queue/q' || doc_id || '.txt'", "origin": "CASE WHEN doc_id % 3 = 0 THEN 'elsewhere/a' ELSE 'inbox/' || lang || '/a' || doc_id || '.txt' END", "doc_id": "doc_id"}).filter("doc_id % 5 != 0")
    return R.stranded(files, origins, "inbox")


LABELS = {"title": "Title", "artist": "Artist", "date": "Date"}
PROBE = {"doc_id": "doc_id", "probe": """'{"format": {"duration": "12.5"' || (CASE WHEN doc_id % 3 = 0 THEN '' ELSE ', "tags": {"TITLE ": " ' || source || ' ", "artist": " "}' END) || '}, "streams": [{"tags": {"title": "s' || doc_id || '", "Artist": "' || lang || '"}}, {}]}'"""}


def media_tags(spark, d):
    text = F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["label"], t["value"])), "|")
    return R.media_tags(_made(spark, d, PROBE), LABELS).select("doc_id", text.alias("tags"))


PROBED = {
    "doc_id": "doc_id",
    "code": "CASE WHEN n_chars % 11 != 0 THEN CASE WHEN n_chars % 13 = 0 THEN 1 ELSE 0 END END",
    "probe": """CASE n_chars % 9 WHEN 0 THEN '{"format":{"duration":"' || n_chars || '.5"},"streams":[{"codec_type":"audio"},null,3,{"codec_type":"' || lang || '"}]}'
        WHEN 1 THEN '{"format":{"duration":' || n_chars || '},"streams":[{"codec_type":"video"},{"codec_type":"audio","tags":{"title":"' || source || '"}}]}'
        WHEN 2 THEN '{"format":{"duration":"N/A"},"streams":[{"codec_type":"video"}]}' WHEN 3 THEN '{"format":{"duration":"-' || n_chars || '"},"streams":[{"codec_type":"audio"}]}'
        WHEN 4 THEN '{"format":{"duration":"' || n_chars || '"},"streams":[{"codec_type":"' || lang || '"}]}' WHEN 5 THEN text
        WHEN 6 THEN '{"format":{"duration":"9"},"streams":[{"codec_type":"audio"}]' WHEN 7 THEN '{"streams":[{"codec_type":"video"},{}],"format":null}' END""",
}


def media_probes(spark, d):
    return R.media_probe(_made(spark, d, PROBED)).select("doc_id", "duration_seconds", "has_audio", "has_video", "ok", "reason")


# ---- providers, prices, settings, texts ------------------------------------


def provider_chains(spark, d):
    raw = _made(spark, d, {"doc_id": "doc_id", "raw": "CASE doc_id % 4 WHEN 0 THEN ' Paid:m1:x , bad, :m, home: ,home:m' || (doc_id % 3) WHEN 1 THEN '' WHEN 2 THEN NULL ELSE lang || ':' || source END"})
    each = raw.select("doc_id", F.posexplode(E.provider_chain(F.col("raw"))).alias("n", "e"))
    return each.select("doc_id", F.col("n").cast("long").alias("n"), "e.provider", "e.model")


def configured_providers(spark, d):
    return provider_chains(spark, d).select("provider").distinct()


def price_sources(spark, d):
    """Price rows of four tables, of which the first can't be used: those of the first that can."""
    rows = _made(spark, d, {"priority": "doc_id % 4", "usable": "doc_id % 4 > 0", "model": "source || '-' || doc_id", "price": "CAST(CASE WHEN doc_id % 3 > 0 THEN n_chars END AS DOUBLE)"})
    return R.price_tables(rows).select(F.col("priority").cast("long").alias("priority"), "model", "price")


def model_families(spark, d):
    rows = _made(spark, d, {"doc_id": "doc_id", "k": "CASE doc_id % 3 WHEN 0 THEN 'Paid:m' || (doc_id % 7) WHEN 1 THEN 'nocolon' ELSE lang || ':x:y' END", "v": "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'Fam ' || source END"})
    return R.model_families(rows.select("doc_id", F.create_map("k", "v").alias("families"))).distinct()


def can_price(spark, d):
    """Whether the sellers that documents of a language name have each a price, which some sources lack."""
    priced = {"provider": "source", "in_per_mtok": "CASE WHEN n_chars % 5 = 0 THEN CAST(n_chars AS DOUBLE) END", "out_per_mtok": "CASE WHEN n_chars % 7 = 0 THEN 0.5D END", "free": "CASE WHEN n_chars % 11 = 0 THEN true END"}
    prices = _made(spark, d, priced).filter("provider not in ('src1', 'src2')").unionByName(_made(spark, d, priced | {"in_per_mtok": "CAST(NULL AS DOUBLE)", "out_per_mtok": "CAST(NULL AS DOUBLE)", "free": "CAST(NULL AS BOOLEAN)"}))
    cases = {"all": "true", "some": "source in ('src3', 'src4')", "dry": "source in ('src2', 'src3')", "local": "source = 'src1'"}
    out = None
    for name, which in cases.items():
        wanted = _made(spark, d, {"provider": "source"}).filter(which.replace("source", "provider"))
        one = R.can_price(prices, wanted, ("src1",)).withColumn("case", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def reminders(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    last = F.when(F.col("o_orderkey") % 7 != 0, at)
    now = F.lit("1996-06-15 12:00:00").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", R.refresh_due(last, now).alias("refresh_due"), R.overdue(last, now).alias("backup_due"))


def user_language(spark, d):
    rows = table(spark, d, "documents").select("lang")
    a = R.user_language("fr-be", C.majority_language(rows, "lang")).withColumn("case", F.lit("set"))
    b = R.user_language("Français", C.majority_language(rows, "lang")).withColumn("case", F.lit("majority"))
    return a.unionByName(b).unionByName(R.user_language(None, C.majority_language(rows.limit(0), "lang")).withColumn("case", F.lit("none")))


def document_markers(spark, d):
    text = _made(spark, d, {"doc_id": "doc_id", "t": "lang || chr(10) || (CASE doc_id % 3 WHEN 0 THEN 'DOCUMENT: oui' || chr(10) || 'x' || chr(10) || ' document : No ' WHEN 1 THEN 'DOCUMENT: maybe' ELSE 'Document:YES' END) || chr(10) || source"})
    return text.select("doc_id", E.document_marker(F.col("t")).alias("m")).select("doc_id", F.regexp_replace("m.text", "\\n+", "/").alias("text"), "m.is_document")


def context_texts(spark, d):
    text = _made(spark, d, {"doc_id": "doc_id", "t": "'# head' || chr(10) || lang || ' <!-- a' || chr(10) || 'b --> ' || source || chr(10) || '  # note' || chr(10) || 'end' || doc_id"})
    return text.select("doc_id", F.regexp_replace(E.clean_context(F.col("t"), 30), "\\s+", " ").alias("context"))


def probe_plan(spark, d):
    s = F.col("p_size").cast("double") * 3
    seg = F.array(F.struct(s.alias("start"), (s + 2).alias("end"), F.lit("x").alias("text")))
    ms = lambda x: F.array_join(F.transform(x, lambda v: F.bround(v * 1000, 0).cast("long").cast("string")), ",")
    again = E.rescaled(seg, 1.25)
    return table(spark, d, "part").select("p_partkey", ms(E.probe_offsets(s, 7.5)).alias("offsets"), ms(F.array(again[0]["start"], again[0]["end"], E.midpoint(s, s + 1), E.midpoint(s, s - 1))).alias("times"), E.duration_text(s * 100).alias("shown"))


def run_settings(spark, d):
    rows = _made(spark, d, {"doc_id": "doc_id", "s": "CASE doc_id % 4 WHEN 0 THEN ' 1,2 ' WHEN 1 THEN '9' WHEN 2 THEN 'fast' ELSE NULL END"})
    return rows.select("doc_id", E.clamped(F.col("s"), 1.0, 1.5, 1.25).alias("speed"))


def reply_units(spark, d):
    body = """CASE doc_id % 6 WHEN 0 THEN '{"usage": {"prompt_tokens": ' || doc_id || ', "input_tokens": "7", "completion_tokens": 2.9}}' WHEN 1 THEN '{"usage_info": {"pages_processed": 3, "pages": true}}'
        WHEN 2 THEN '{"usage": {"prompt_audio_seconds": null}}' WHEN 3 THEN '{"prompt_eval_count": 5, "eval_count": ' || doc_id || '}' WHEN 4 THEN 'none' ELSE '{"usage": [], "other": 1}' END"""
    return _made(spark, d, {"doc_id": "doc_id", "b": body}).select("doc_id", M.extract_units(F.col("b")).alias("u")).select("doc_id", "u.tokens_in", "u.tokens_out", "u.pages", "u.audio_seconds", F.coalesce("u.measured", F.lit(False)).alias("measured"))


def versions(spark, d):
    v = "CASE doc_id % 6 WHEN 0 THEN '1.2' WHEN 1 THEN 'v1.2.3' WHEN 2 THEN ' 1.20.' || doc_id || '.dev4+g1' WHEN 3 THEN '0.12.' || doc_id || '+x.1' WHEN 4 THEN '1.2.3rc1' ELSE NULL END"
    return _made(spark, d, {"doc_id": "doc_id", "v": v}).select("doc_id", F.array_join(E.release(F.col("v")), ".").alias("release"))


def reply_json(spark, d):
    t = """CASE doc_id % 4 WHEN 0 THEN 'x {"a":' || doc_id || '} y {"b":2}' WHEN 1 THEN 'so {no} ' || chr(96) || chr(96) || chr(96) || 'json' || chr(10) || '{"a":' || doc_id || '}' || chr(10) || chr(96) || chr(96) || chr(96) WHEN 2 THEN ' {"a":' || doc_id || '} ' ELSE '[1] {bad' END"""
    return _made(spark, d, {"doc_id": "doc_id", "t": t}).select("doc_id", E.json_object(F.col("t")).alias("found"))


def date_hints(spark, d):
    hints = E.evidence([("embedded", E.day(F.when(F.col("doc_id") % 2 == 0, "2024-3-1"))), ("modified", E.day(F.when(F.col("doc_id") % 3 != 0, "2025-01-02").otherwise("x")))])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(hints, lambda h: F.concat_ws(" ", h["source"], h["day"].cast("string"))), ", ").alias("hints"))


def highlights(spark, d):
    m = lambda a, b, w: F.struct(F.lit(a).cast("double").alias("start"), F.lit(b).cast("double").alias("end"), F.lit(w).alias("why"))
    found = F.array(m(-1, 2, "a"), m(5, 9, " b "), m(20, None, None), m(30, 10, "c"), m(None, 3, "d"), m(8, 99, "e"))
    kept = G.moments(found, F.col("p_size").cast("double"), 3)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["start"].cast("long"), x["end"].cast("long"), x["why"])), ",").alias("moments"))


def scrub_counters(spark, d):
    return scrub_matrix(spark, d).agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(F.col("remedy") == r).alias(r) for r in ("none", "copy_to_mirror", "restore_from_mirror", "lost")])


def sidecars_kept(spark, d):
    rows = _made(spark, d, {"doc_id": "doc_id", "read_via": "CASE doc_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'vision' ELSE 'text' END", "text": "CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE lang END"})
    return rows.filter(F.col("read_via").isin("ocr", "vision") & E.cleaned(F.col("text")).isNotNull()).select("doc_id", "text")


def log_prefilter(spark, d):
    """Only lines with the word are parsed."""
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", "value")).alias("line")).filter(F.col("line").contains('"purchase"'))
    return rows.select("event_id", F.from_json("line", "event_type string, value double").alias("e")).select("event_id", "e.event_type", "e.value")


def search_expanded(spark, d):
    """Any word of a query or of an expansion table, each once."""
    return _index(spark, d).search_any(" ".join(dict.fromkeys(["pathetic", *["moron", "pathetic", "the"]])))


def analysis_injected(spark, d):
    """Rows through a task that answers for some of them."""
    rows = _made(spark, d, {"doc_id": "doc_id", "lang": "lang"})
    task = lambda df: df.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("ai-"), "lang").alias("name"), F.lit(None).cast("string").alias("reason"))
    fallback = {"name": F.concat(F.lit("file-"), "doc_id"), "reason": F.lit("no_provider")}
    return R.through(rows, task, fallback).select("doc_id", "name", "reason").unionByName(R.through(rows.filter("doc_id < 5"), None, fallback).select(-F.col("doc_id") - 1, "name", "reason").toDF("doc_id", "name", "reason"))


def media_folders(spark, d):
    """One fiche for every file of a media folder."""
    files = _made(spark, d, FILES).filter(P.within(F.col("path"), P.MEDIA_ZONES)).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    fiche = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return files.join(fiche, "folder").select("doc_id", "folder", "n", "bytes")


def filed_names(spark, d):
    """Route and name of a new file below its base: series entity and year, then the dated name."""
    rows = _made(spark, d, {"doc_id": "doc_id", "name": "source || ' letter ' || doc_id || '.pdf'", "series": "doc_id % 2 = 0", "source": "source", "day": "'2024-0' || (doc_id % 9 + 1) || '-15'"})
    route = P.series_route(F.lit("Personal/Administrative/Taxes"), F.col("series"), F.col("source"), F.substring("day", 1, 4), F.lit(3))
    return rows.select("doc_id", F.concat(route, F.lit("/"), E.timestamped_name(F.col("name"), F.col("day").cast("timestamp"))).alias("path"))


def trash_plan(spark, d):
    """Live rows that may go to the trash and where to, others with a refusal."""
    rows = _made(spark, d, ROWS)
    refusal = F.when(F.col("status") == C.DELETED, "already_deleted").when(~F.col("current_path").startswith("/old/lib/"), "outside_library")
    target = F.when(refusal.isNull(), P.reroot(F.col("current_path"), "/old/lib", "/trash"))
    return rows.select("doc_id", target.alias("target"), refusal.alias("refusal"))


def diagnostics(spark, d):
    rows = _made(spark, d, ROWS)
    count = rows.agg(F.count_if(F.col("status") == C.PENDING).alias("n"))
    a = count.select(F.when(F.col("n") > 0, "WARN").otherwise("OK").alias("state"), F.col("n").alias("detail"))
    b = rows.agg(F.count_if(F.col("content_json").isNull() & (F.col("status") == C.STORED)).alias("detail")).select(F.when(F.col("detail") > 0, "WARN").otherwise("OK").alias("state"), "detail")
    c = verify_catalog(spark, d).filter("case = 'same'").select(F.when(F.col("in_sync"), "OK").otherwise("FAIL").alias("state"), F.col("db_count").alias("detail"))
    return R.checks(("pending", a), ("content", b), ("snapshot", c))


QUERIES = {
    f.__name__: f
    for f in (
        inbox_walk, library_walk, indexable_walk, repository_roots, category_paths, branch_files, empty_folders, nearest_branches, body_texts, work_sets, repository_inventory, mirror_plan, trash_expired, zones,
        classifiable_folders, list_documents, pending_decisions, confirmed_timestamps, name_sync, enrich_keywords, fiche_dates, clean_analysis, route_analysis, review_route, placements, listed_files,
        regroup_refusals, nesting_conflicts, snapshot_rebuild, snapshot_meta, verify_catalog, dry_run_batch, calls_estimate, stranded_files, media_tags, media_probes, provider_chains, configured_providers,
        price_sources, model_families, can_price, reminders, user_language, document_markers, context_texts, probe_plan, run_settings, reply_units, versions, reply_json, date_hints, highlights, scrub_counters,
        sidecars_kept, log_prefilter, search_expanded, analysis_injected, media_folders, filed_names, trash_plan, diagnostics,
    )
}

_BASES = ", ".join(f"('{b}')" for b in P.BASE_FOLDERS if b != P.REVIEW and not b.startswith("Media") and b not in P.ARCHIVES)
_FREE = f"b AS (SELECT base FROM (VALUES {_BASES}) t(base))"
_BARE = "regexp_replace(list_last(string_split({p}, '/')), '^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}-[0-9]{2}-[0-9]{2}__', '')"
_up = lambda p: _UP.replace("{p}", p)
_bare = lambda p: _BARE.replace("{p}", p)
_STEP = "CASE WHEN s IS NULL OR s <= 0 THEN 0 WHEN s < 30 THEN 3 WHEN s < 120 THEN 4 WHEN s < 300 THEN 5 WHEN s < 900 THEN 7 WHEN s < 1800 THEN 9 ELSE 12 END"


def _estimate(name: str, ocr: bool, transcribe: bool) -> str:
    o, t = int(ocr), int(transcribe)
    av = "kind IN ('audio', 'video') AND s > 0"
    return f"""SELECT '{name}' AS chains, unnest([{{'task': 'IMAGE', 'l': v + fr, 'h': v + fr}}, {{'task': 'OCR', 'l': 0, 'h': {o} * (pdf + v)}}, {{'task': 'TRANSCRIBE', 'l': {t} * tr, 'h': {t} * tr}}, {{'task': 'VIDEO', 'l': {t} * hi, 'h': {t} * hi}},
    {{'task': 'ANALYSIS', 'l': n - bad, 'h': n - bad}}, {{'task': 'NAMING', 'l': tops, 'h': tops}}, {{'task': 'ORGANIZE', 'l': tops, 'h': tops}}]) AS x FROM (SELECT count(*)::BIGINT AS n, count_if(kind = 'image')::BIGINT AS v, count_if(kind = 'pdf')::BIGINT AS pdf,
    count_if(kind NOT IN ('image', 'pdf', 'text', 'office') AND NOT ({av}))::BIGINT AS bad, count_if({av} AND has_audio)::BIGINT AS tr, coalesce(sum(CASE WHEN {av} AND has_video THEN {_STEP} ELSE 0 END), 0)::BIGINT AS fr,
    count_if({av} AND has_audio AND has_video AND {_STEP} > 2)::BIGINT AS hi, count(DISTINCT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) END)::BIGINT AS tops FROM (SELECT *, seconds AS s, {_kind} AS kind FROM {_sql(AV)}))"""


ORACLES = {
    "inbox_walk": f"SELECT path, size FROM {_F} WHERE NOT is_symlink",
    "library_walk": f"WITH {_ZONE} SELECT path FROM z WHERE NOT in_zone",
    "indexable_walk": f"WITH {_ZONE} SELECT path, size FROM z WHERE in_zone AND size <= 2000000 AND {_kind} IN ('text', 'pdf')",
    "repository_roots": f"SELECT DISTINCT split_part(path, '/.git/', 1) AS root FROM {_F} WHERE path LIKE '%/.git/%'",
    "category_paths": f"WITH {_FREE}, u AS (SELECT DISTINCT unnest({_up('path')}) AS label FROM {_F}) SELECT label FROM u WHERE EXISTS (SELECT 1 FROM b WHERE label = base OR starts_with(label, base || '/'))",
    "branch_files": f"SELECT path[33:] AS rel, mtime FROM {_F} WHERE starts_with(path, 'Personal/Administrative/Taxes/2024/') AND NOT is_symlink AND len(string_split(path, '/')) <= 7 ORDER BY mtime DESC, rel LIMIT 30".replace("path[33:]", "path[36:]"),
    "empty_folders": f"SELECT DISTINCT path FROM (SELECT unnest({_up('path')}) AS path FROM {_F}) WHERE path NOT IN (SELECT unnest({_up('path')}) FROM {_F} WHERE doc_id % 12 IN (0, 4, 7) AND doc_id % 3 != 0)",
    "nearest_branches": f"""WITH u AS (SELECT DISTINCT unnest({_up('path')}) AS label FROM {_F}), w AS (SELECT doc_id, unnest([{{'ord': 0, 'p': 'Personal/Hobbies/' || lang || '/new'}}, {{'ord': 1, 'p': 'Work/Business/Clients/none/none'}}, {{'ord': 2, 'p': 'Personal/Hobbies/' || lang}}]) AS x FROM documents),
    n AS (SELECT doc_id, x.ord AS ord, arg_max(label, length(label)) AS label FROM w JOIN u ON x.p = label OR starts_with(x.p, label || '/') GROUP BY 1, 2) SELECT doc_id, label, min(ord) AS ord FROM n GROUP BY 1, 2""",
    "body_texts": "SELECT doc_id, length(b)::BIGINT AS n_chars, sha256(b) AS sha256 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ocr ' || doc_id WHEN 1 THEN '' ELSE coalesce(text, '')[1:100000] END AS b FROM documents)",
    "work_sets": f"SELECT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END AS folder, split_part(path, '/', 1) AS set_key, count(*)::BIGINT AS n_files FROM {_F} GROUP BY 1, 2",
    "repository_inventory": f"WITH f AS (SELECT * FROM {_F} WHERE path LIKE 'Work/code/%') SELECT CASE WHEN path LIKE '%.sh' THEN 'sh' ELSE 'none' END AS ext, count(*)::BIGINT AS n, (SELECT count(DISTINCT split_part(path, '/', 3)) FROM f)::BIGINT AS n_roots FROM f GROUP BY 1 ORDER BY n DESC, ext LIMIT 6",
    "mirror_plan": f"SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'copy' WHEN doc_id % 4 = 0 THEN 'replace' ELSE 'keep' END AS action FROM {_F}",
    "trash_expired": f"SELECT count(*)::BIGINT AS n, min(mtime) AS oldest FROM {_F} WHERE mtime < epoch(TIMESTAMP '{NOW}') - 30 * 86400",
    "zones": f"SELECT doc_id, path LIKE 'Personal/Archive/%' OR path LIKE 'Work/Archive/%' AS in_archive, path LIKE 'Media/%' AS in_media, path LIKE '.%' OR path LIKE '%/.%' AS is_hidden, lower(path) LIKE '%.jpg' AS vision FROM {_F}",
    "classifiable_folders": f"WITH {_FREE}, m AS (SELECT " + _LABEL.format("[" + ", ".join(f"'{b}'" for b in _BASE_LIST) + f"][(n_chars % {len(_BASE_LIST)})::INT + 1]") + " AS base FROM documents) SELECT base, count(*)::BIGINT AS n FROM m WHERE base IN (SELECT base FROM b) GROUP BY base",
    "list_documents": f"SELECT * EXCLUDE (pending_decision, last_verified_utc) FROM {_R} ORDER BY updated_at_utc DESC, doc_id",
    "pending_decisions": f"SELECT doc_id, updated_at_utc, 'r' || (doc_id % 2) AS reason, CASE WHEN doc_id % 3 != 0 THEN n END AS n, CASE WHEN doc_id % 3 != 0 THEN CASE n WHEN 0 THEN 'A/' || lang ELSE 'B' END END AS option FROM {_sql(ROWS | {'lang': 'lang'})}, (VALUES (0::BIGINT), (1)) v(n) WHERE status = 'DECISION_PENDING' AND (n = 0 OR doc_id % 3 != 0)",
    "confirmed_timestamps": f"SELECT doc_id, coalesce(last_verified_utc, updated_at_utc) AS confirmed_utc FROM {_R} WHERE status = 'LIBRARY_STORED'",
    "name_sync": f"SELECT doc_id, source || '-' || (doc_id - doc_id % 3) AS old_name, source || '-' || doc_id AS new_name FROM {_sql(ROWS | {'source': 'source'})} WHERE {_OBJ} AND doc_id % 3 != 0",
    "enrich_keywords": f"SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'skipped' WHEN doc_id % 8 = 0 THEN 'failed' ELSE 'enriched' END AS outcome, 'k' || (doc_id % 4) || ',x' || CASE WHEN doc_id % 6 = 1 OR doc_id % 8 = 0 THEN '' ELSE ',' || lang || CASE WHEN doc_id % 4 = 1 THEN '' ELSE ',k1' END END AS keywords FROM {_sql(ROWS | {'lang': 'lang'})} WHERE {_OBJ}",
    "fiche_dates": f"""WITH j AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '2023-12-31' END AS e, CASE WHEN doc_id % 4 != 0 THEN '2024-03-' || lpad((doc_id % 30 + 1)::VARCHAR, 2, '0') END AS o FROM {_R} WHERE content_json LIKE '{{%')
    SELECT doc_id, coalesce(e, o, CASE WHEN doc_id % 2 = 0 THEN '2025-05-05' END, '2026-01-01') AS day, coalesce(CASE WHEN o IS NOT NULL THEN '2024' END, e[1:4]) AS year FROM j""",
    "clean_analysis": "SELECT doc_id, CASE WHEN doc_id % 4 != 0 THEN 'Tax-letter-' || lang END AS name, CASE WHEN doc_id % 3 != 0 THEN '2024-02-11' END AS document_date, CASE WHEN doc_id % 5 != 0 THEN 'Personal/' || CASE WHEN doc_id % 2 = 0 THEN 'Hobbies' ELSE 'Nowhere' END || '/' || lang END AS category_path, 'Work/Business|Nope|Work/Business' AS alternatives, source || '|b' AS keywords FROM documents",
    "route_analysis": """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Work/Misc/Sub-folder' WHEN doc_id % 5 != 0 THEN 'Personal/' || CASE WHEN doc_id % 2 = 0 THEN 'Hobbies/' ELSE 'Nowhere/' END || lang END AS r, CASE WHEN doc_id % 3 != 0 THEN 'Work/Business' END AS o FROM documents)
    SELECT doc_id, CASE WHEN r IS NULL THEN 'Manual_Review' WHEN r LIKE 'Personal/Nowhere/%' THEN 'Personal/Nowhere/' || split_part(r, '/', 3) ELSE r END AS route, CASE WHEN r IS NULL THEN o END AS options, CASE WHEN r IS NULL AND o IS NOT NULL THEN CASE WHEN doc_id % 7 = 0 THEN 'low' ELSE 'uncertain_with_options' END END AS reason FROM x""",
    "review_route": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Personal/Hobbies/My-' || lang WHEN 1 THEN 'New-Root/' || source WHEN 3 THEN 'Work/Misc/a/b' END AS category FROM documents",
    "placements": """WITH t AS (SELECT doc_id // 10 AS set_id, (doc_id * 3) % 14 AS index, arg_max(CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'told/' || lang END, doc_id) AS p FROM documents GROUP BY 1, 2)
    SELECT d.doc_id // 10 AS set_id, d.doc_id % 10 AS index, CASE WHEN p IS NULL THEN 'own/' || source WHEN p != '' THEN p END AS path FROM documents d LEFT JOIN t ON t.set_id = d.doc_id // 10 AND t.index = d.doc_id % 10""",
    "listed_files": f"""WITH l AS (SELECT DISTINCT lang || '/2024-05-06_10-11-12__' || source || '-' || (doc_id % 40) || '.txt' AS p FROM documents), n AS (SELECT {_bare('p')} AS b, min(p) AS p FROM l GROUP BY 1 HAVING count(*) = 1)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '/2024-05-06_10-11-12__' || source || '-' || (doc_id % 40) || '.txt' ELSE n.p END AS path FROM documents LEFT JOIN n ON doc_id % 3 = 1 AND b = source || '-' || (doc_id % 60) || '.txt' WHERE doc_id % 3 < 2""",
    "regroup_refusals": f"SELECT lang || '/f' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'not_listed' WHEN doc_id % 9 = 0 THEN 'not_catalogued' WHEN status != 'LIBRARY_STORED' THEN 'not_stored' WHEN doc_id % 4 = 0 THEN 'not_deeper' END AS refusal FROM {_sql(ROWS | {'lang': 'lang'})}",
    "nesting_conflicts": "SELECT lang || '/' || source AS collapsed, count(DISTINCT doc_id % 3 = 0)::BIGINT AS n FROM documents GROUP BY 1 HAVING n > 1",
    "snapshot_rebuild": f"SELECT doc_id, CASE WHEN current_path LIKE '/old/lib/%' THEN '/new' || current_path[9:] ELSE current_path END AS current_path, status, CASE WHEN content_json LIKE '{{%' THEN source || '-' || (doc_id - doc_id % 3) END AS name FROM {_sql(ROWS | {'source': 'source'})}",
    "snapshot_meta": f"SELECT count(*)::BIGINT AS n, max(updated_at_utc) AS latest, '/old/lib' AS root FROM {_R}",
    "verify_catalog": "WITH n AS (SELECT count(*)::BIGINT AS a, count_if(doc_id % 2 = 0)::BIGINT AS b FROM documents) SELECT a AS db_count, b AS snapshot_count, true AS integrity_ok, true AS snapshot_present, a = b AS in_sync, false AS recoverable, 'stale' AS \"case\" FROM n UNION ALL SELECT NULL, a, false, true, false, true, 'lost' FROM n UNION ALL SELECT a, a, true, true, true, false, 'same' FROM n",
    "dry_run_batch": f"""WITH k AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 6 = 0 AND doc_id % 11 != 0), f AS (SELECT *, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS later FROM {_sql(FILES | {'text': 'text'})}), g AS (SELECT later OR h IN (SELECT h FROM k) AS dup, {_kind} != 'unknown' AS ok FROM f)
    SELECT count(*)::BIGINT AS total, count_if(dup)::BIGINT AS duplicates, count_if(NOT dup AND NOT ok)::BIGINT AS manual_reviews, count_if(NOT dup AND ok)::BIGINT AS processed FROM g""",
    "calls_estimate": f"SELECT chains, x.task AS task, x.l::BIGINT AS calls_low, x.h::BIGINT AS calls_high FROM ({_estimate('all', True, True)} UNION ALL {_estimate('some', False, False)})",
    "stranded_files": "SELECT 'queue/q' || doc_id || '.txt' AS path, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'inbox/q' || doc_id || '.txt' ELSE 'inbox/' || lang || '/a' || doc_id || '.txt' END AS target FROM documents",
    "media_tags": "SELECT doc_id, 'Title=' || CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id ELSE source END || '|Artist=' || lang AS tags FROM documents",
    "media_probes": f"""WITH p AS (SELECT {', '.join(f'{x} AS {name}' for name, x in PROBED.items())} FROM documents), j AS (SELECT doc_id, code, CASE WHEN code = 0 AND json_valid(probe) THEN probe END AS v FROM p),
    k AS (SELECT doc_id, code, v, try_cast(json_extract_string(v, '$.format.duration') AS DOUBLE) AS s, coalesce(list_contains(json_extract(v, '$.streams[*].codec_type')::VARCHAR[], '"audio"'), false) AS a,
        coalesce(list_contains(json_extract(v, '$.streams[*].codec_type')::VARCHAR[], '"video"'), false) AS w FROM j),
    r AS (SELECT *, CASE WHEN code IS NULL THEN 'file_missing' WHEN v IS NULL THEN 'unreadable_media' WHEN NOT (a OR w) THEN 'no_media_stream' END AS reason FROM k)
    SELECT doc_id, CASE WHEN reason IS NULL AND s >= 0 AND isfinite(s) THEN s ELSE 0 END::DOUBLE AS duration_seconds, reason IS NULL AND a AS has_audio, reason IS NULL AND w AS has_video, reason IS NULL AS ok, reason FROM r""",
    "provider_chains": "SELECT doc_id, n, CASE WHEN doc_id % 4 = 3 THEN lang WHEN n = 0 THEN 'paid' ELSE 'home' END AS provider, CASE WHEN doc_id % 4 = 3 THEN source WHEN n = 0 THEN 'm1:x' ELSE 'm' || (doc_id % 3) END AS model FROM documents, (VALUES (0::BIGINT), (1)) v(n) WHERE doc_id % 4 = 0 OR (doc_id % 4 = 3 AND n = 0)",
    "configured_providers": "SELECT DISTINCT CASE WHEN doc_id % 4 = 3 THEN lang WHEN n = 0 THEN 'paid' ELSE 'home' END AS provider FROM documents, (VALUES (0), (1)) v(n) WHERE doc_id % 4 = 0 OR (doc_id % 4 = 3 AND n = 0)",
    "price_sources": "SELECT 1::BIGINT AS priority, source || '-' || doc_id AS model, CASE WHEN doc_id % 3 > 0 THEN n_chars END::DOUBLE AS price FROM documents WHERE doc_id % 4 = 1",
    "model_families": "SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'paid' ELSE lang END AS provider, CASE doc_id % 3 WHEN 0 THEN 'm' || (doc_id % 7) ELSE 'x:y' END AS model, 'Fam ' || source AS family FROM documents WHERE doc_id % 3 != 1 AND doc_id % 5 != 0",
    "can_price": """WITH h AS (SELECT DISTINCT source FROM documents WHERE source NOT IN ('src1', 'src2') AND (n_chars % 5 = 0 OR n_chars % 7 = 0 OR n_chars % 11 = 0)), w AS (SELECT DISTINCT c, source FROM documents, (VALUES ('all'), ('some'), ('dry'), ('local')) v(c)
    WHERE (c = 'all' OR c = 'some' AND source IN ('src3', 'src4') OR c = 'dry' AND source IN ('src2', 'src3') OR c = 'local' AND source = 'src1') AND source != 'src1')
    SELECT v.c AS "case", CASE WHEN count(w.source) = 0 THEN (SELECT count(*) FROM h) > 0 ELSE count(*) FILTER (w.source IS NOT NULL AND w.source NOT IN (SELECT source FROM h)) = 0 END AS can_price FROM (VALUES ('all'), ('some'), ('dry'), ('local')) v(c) LEFT JOIN w ON w.c = v.c GROUP BY v.c""",
    "reminders": "WITH x AS (SELECT o_orderkey, epoch(TIMESTAMP '1996-06-15 12:00:00') - epoch(CASE WHEN o_orderkey % 7 != 0 THEN o_orderdate::TIMESTAMP END) AS s FROM orders) SELECT o_orderkey, coalesce(s >= 7 * 86400, true) AS refresh_due, coalesce(floor(s / 86400) >= 30, true) AS backup_due FROM x",
    "user_language": "WITH m AS (SELECT lower(trim(lang)) AS l, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, l LIMIT 1) SELECT 'fr-be' AS language, 'set' AS \"case\" UNION ALL SELECT l, 'majority' FROM m UNION ALL SELECT 'en', 'none'",
    "document_markers": "SELECT doc_id, lang || CASE doc_id % 3 WHEN 0 THEN '/DOCUMENT: oui/x/' WHEN 1 THEN '/DOCUMENT: maybe/' ELSE '/' END || source AS text, CASE doc_id % 3 WHEN 0 THEN false WHEN 2 THEN true END AS is_document FROM documents",
    "context_texts": "SELECT doc_id, trim(regexp_replace(rtrim((lang || '  ' || source || chr(10) || chr(10) || 'end' || doc_id)[1:30], chr(10)), '\\s+', ' ', 'g')) AS context FROM documents",
    "probe_plan": """WITH p AS (SELECT p_partkey, p_size * 3.0::DOUBLE AS s FROM part) SELECT p_partkey, array_to_string(list_transform([0.03, 0.26, 0.5, 0.74, 0.96], lambda f: round(round_even(greatest(0, s - 7.5) * f::DOUBLE, 3) * 1000)::BIGINT::VARCHAR), ',') AS offsets,
    array_to_string(list_transform([s * 1.25, (s + 2) * 1.25, s + 0.5, s], lambda x: round_even(x * 1000, 0)::BIGINT::VARCHAR), ',') AS times, CASE WHEN s * 100 >= 3600 THEN (s * 100)::BIGINT // 3600 || 'h ' || lpad(((s * 100)::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || 'm ' ELSE (s * 100)::BIGINT // 60 || 'm ' END || lpad(((s * 100)::BIGINT % 60)::VARCHAR, 2, '0') || 's' AS shown FROM p""",
    "run_settings": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.2 WHEN 1 THEN 1.5 ELSE 1.25 END::DOUBLE AS speed FROM documents",
    "reply_units": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN doc_id + 7 WHEN 3 THEN 5 ELSE 0 END AS tokens_in, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 3 THEN doc_id ELSE 0 END AS tokens_out, CASE doc_id % 6 WHEN 1 THEN 3 ELSE 0 END::BIGINT AS pages, 0::BIGINT AS audio_seconds, doc_id % 6 < 4 AS measured FROM documents",
    "versions": "SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN '1.20.' || doc_id WHEN 3 THEN '0.12.' || doc_id END AS release FROM documents",
    "reply_json": "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '{\"a\":' || doc_id || '}' END AS found FROM documents",
    "date_hints": "SELECT doc_id, concat_ws(', ', CASE WHEN doc_id % 2 = 0 THEN 'embedded 2024-03-01' END, CASE WHEN doc_id % 3 != 0 THEN 'modified 2025-01-02' END) AS hints FROM documents",
    "highlights": "WITH p AS (SELECT p_partkey, p_size AS d FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN d >= 5 THEN '5:' || least(9, d) || ':b' END, CASE WHEN d >= 20 THEN '20:20:' END, CASE WHEN d >= 30 THEN '30:30:c' WHEN d >= 8 THEN '8:' || d || ':e' END) AS moments FROM p",
    "scrub_counters": "WITH s AS (SELECT doc_id % 13 != 0 AND doc_id % 17 != 0 AS l, doc_id % 19 != 0 AND doc_id % 34 != 0 AS m FROM documents) SELECT count(*)::BIGINT AS checked, count_if(l AND m)::BIGINT AS none, count_if(l AND NOT m)::BIGINT AS copy_to_mirror, count_if(m AND NOT l)::BIGINT AS restore_from_mirror, count_if(NOT l AND NOT m)::BIGINT AS lost FROM s",
    "sidecars_kept": "SELECT doc_id, lang AS text FROM documents WHERE doc_id % 4 < 2 AND doc_id % 5 != 0",
    "log_prefilter": "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'",
    "search_expanded": _bm25({"name": "source", "content": "text", "category": "lang"}, [["pathetic"], ["moron"]], False),
    "analysis_injected": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ai-' || lang ELSE 'file-' || doc_id END AS name, 'no_provider' AS reason FROM documents UNION ALL SELECT -doc_id - 1, 'file-' || doc_id, 'no_provider' FROM documents WHERE doc_id < 5",
    "media_folders": f"WITH f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM {_F} WHERE path LIKE 'Media/%') SELECT doc_id, folder, count(*) OVER (PARTITION BY folder)::BIGINT AS n, sum(size) OVER (PARTITION BY folder)::BIGINT AS bytes FROM f",
    "filed_names": "SELECT doc_id, 'Personal/Administrative/Taxes/' || CASE WHEN doc_id % 2 = 0 THEN source || '/2024/' ELSE '' END || '2024-0' || (doc_id % 9 + 1) || '-15_00-00-00__' || source || '-letter-' || doc_id || '.pdf' AS path FROM documents",
    "trash_plan": f"SELECT doc_id, CASE WHEN doc_id % 11 != 0 AND current_path LIKE '/old/lib/%' THEN '/trash' || current_path[9:] END AS target, CASE WHEN doc_id % 11 = 0 THEN 'already_deleted' WHEN current_path NOT LIKE '/old/lib/%' THEN 'outside_library' END AS refusal FROM {_R}",
    "diagnostics": f"SELECT 'pending' AS \"check\", CASE WHEN n > 0 THEN 'WARN' ELSE 'OK' END AS state, n::VARCHAR AS detail FROM (SELECT count_if(status = 'DECISION_PENDING') AS n FROM {_R}) UNION ALL SELECT 'content', CASE WHEN n > 0 THEN 'WARN' ELSE 'OK' END, n::VARCHAR FROM (SELECT count_if(status = 'LIBRARY_STORED' AND content_json IS NULL) AS n FROM {_R}) UNION ALL SELECT 'snapshot', 'OK', count(*)::VARCHAR FROM documents",
}
