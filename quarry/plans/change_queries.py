"""Queries that change the catalogue: moves, names, decisions, trash and undo, provider chains, forecasts.

Names, states and replies are drawn from a hash of each text, so that repeats,
nulls, clashes and unparsable values come as they fall.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.exprs import day
from quarry.operators import applied as A
from quarry.operators import catalog as C
from quarry.operators import events as E
from quarry.operators import health as H
from quarry.operators import records as R
from quarry.operators.chains import through_chain
from quarry.operators.moves import repointed
from quarry.operators.names import unique_names as given_names
from quarry.operators.staged import shared_dir
from quarry.sources.contents import extraction
from quarry.sources.readers import append_events, read_events, read_prices, table
from quarry.sources.snapshots import read_large_snapshot

#: A digit of the text's hash, 0 to 15, in both dialects.
_H = "(instr('0123456789abcdef', substr(md5(coalesce(text, '') || '{0}'), 1, 1)) - 1)"
_h = _H.format


def _made(spark, d, columns):
    return table(spark, d, "documents").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _sql(columns):
    return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM documents)"


# ---- moves -----------------------------------------------------------------

_FILED = {
    "doc_id": "doc_id", "current_filename": "'f' || doc_id", "updated_at_utc": "'t'", "pending_decision": "lang",
    "current_path": f"CASE WHEN {_h('p')} = 0 THEN NULL ELSE lang || '/' || (CASE WHEN {_h('p')} < 5 THEN lang || '/' ELSE '' END) || source || '/f' || doc_id END",
}
_LANGS = "SELECT lang, row_number() OVER (ORDER BY lang) AS n FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) AS u"


def moves_applied(spark, d):
    """Folders collapsed, renamed, merged and moved below one another; a later move acts on what an earlier one left."""
    table(spark, d, "documents").select("lang").distinct().filter("lang is not null").createOrReplaceTempView("_moved_langs")
    n = "SELECT lang, row_number() OVER (ORDER BY lang) AS n FROM _moved_langs"  # a handful of languages
    moves = spark.sql(f"""SELECT n AS ord, lang || '/' || lang AS src, lang AS dst FROM ({n}) UNION ALL SELECT n + 100, lang, 'all/' || lang FROM ({n})
        UNION ALL SELECT n + 200, 'all/' || lang, CASE WHEN n % 2 = 0 THEN 'all' ELSE 'other' END FROM ({n}) UNION ALL SELECT 300, 'all', 'library/all' UNION ALL SELECT 301, 'library/all/src1', 'other/src2' UNION ALL SELECT 302, 'other', 'library/all/other'""")
    return repointed(_made(spark, d, _FILED), moves, "now")


_MOVES = f"""m AS (SELECT n AS ord, lang || '/' || lang AS src, lang AS dst FROM ({_LANGS}) UNION ALL SELECT n + 100, lang, 'all/' || lang FROM ({_LANGS})
    UNION ALL SELECT n + 200, 'all/' || lang, CASE WHEN n % 2 = 0 THEN 'all' ELSE 'other' END FROM ({_LANGS}) UNION ALL SELECT 300, 'all', 'library/all' UNION ALL SELECT 301, 'library/all/src1', 'other/src2' UNION ALL SELECT 302, 'other', 'library/all/other'),
k AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM m)"""
_MOVED = f"""WITH RECURSIVE {_MOVES}, r AS (SELECT doc_id, current_path AS p, pending_decision AS pd, 0::BIGINT AS i, false AS met FROM {_sql(_FILED)}
    UNION ALL SELECT doc_id, CASE WHEN p = src OR starts_with(p, src || '/') THEN dst || substr(p, length(src) + 1) ELSE p END, pd, k.i, met OR coalesce(p = src OR starts_with(p, src || '/'), false) FROM r JOIN k ON k.i = r.i + 1)
    SELECT doc_id, CASE WHEN met THEN list_last(string_split(p, '/')) ELSE 'f' || doc_id END AS current_filename, CASE WHEN met THEN 'now' ELSE 't' END AS updated_at_utc, CASE WHEN NOT met THEN pd END AS pending_decision, p AS current_path
    FROM r WHERE i = (SELECT max(i) FROM k)"""

# ---- names -----------------------------------------------------------------

_WANTED = {
    "doc_id": "doc_id", "family": "coalesce(source, '')",
    "path": f"source || (CASE {_h('n')} WHEN 0 THEN '__1' WHEN 1 THEN '__2' WHEN 2 THEN '__1__1' WHEN 3 THEN '__' || (doc_id % 9 + 1) ELSE '' END) || '.txt'",
}


def unique_names(spark, d):
    """Wanted names that repeat, that other documents' numbered names take, and that are there already."""
    wanted = _made(spark, d, _WANTED)
    taken = wanted.filter("family like '%3'").select(F.concat("family", F.lit("__2.txt")).alias("path")).unionByName(wanted.filter("family like '%2'").select(F.concat("family", F.lit(".txt")).alias("path")))
    return given_names(wanted.select("doc_id", "path"), taken)


_NAMED = f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY doc_id) AS i, substr(path, 1, length(path) - 4) AS stem FROM {_sql(_WANTED)}),
r AS (SELECT family, 0::BIGINT AS i, CASE WHEN family LIKE '%3' THEN [family || '__2.txt'] WHEN family LIKE '%2' THEN [family || '.txt'] ELSE []::VARCHAR[] END AS held, NULL::BIGINT AS doc_id, NULL::VARCHAR AS path FROM (SELECT DISTINCT family FROM w)
    UNION ALL SELECT family, i, CASE WHEN path IS NULL THEN held ELSE list_append(held, path) END, doc_id, path FROM (
        SELECT w.family, w.i, held, w.doc_id, CASE WHEN NOT list_contains(held, w.path) THEN w.path ELSE list_filter(list_transform(range(1, len(held) + 2), lambda k: stem || '__' || k || '.txt'), lambda x: NOT list_contains(held, x))[1] END AS path
        FROM r JOIN w ON w.family = r.family AND w.i = r.i + 1))
    SELECT doc_id, path FROM r WHERE i > 0"""

# ---- provider chains -------------------------------------------------------

_REPLIES = {"doc_id": "doc_id", "lang": "lang", "a": _h("a"), "b": _h("b"), "c": _h("c")}


def analysis_chain(spark, d):
    """Three sellers' answers, made of the texts' hashes: limits that a second attempt passes, broken replies, silence."""
    rows = _made(spark, d, _REPLIES)

    def task(column, bad, limited):
        x = F.col(column)
        error = F.when(x < bad, "INVALID_JSON_RESPONSE").when((x < limited) & (F.col("attempt") == 0), "rate_limited")
        return lambda df: df.filter(x != 15).select("doc_id", error.alias("error"), F.concat_ws("-", F.lit(column), "lang").alias("name"))

    entries = [("paid", "m1", task("a", 8, 11)), ("paid", "m2", task("b", 8, 8)), ("home", "m3", task("c", 6, 12))]
    out = through_chain(rows, entries, {"name": F.concat(F.lit("file-"), "doc_id")}, retries=1)
    return out.select("doc_id", "name", "provider", "model", "used_fallback", "reason", "calls")


_CHAIN = f"""WITH x AS (SELECT *, CASE WHEN a = 15 THEN 'no_answer' WHEN a < 8 THEN 'bad' END AS ea, CASE WHEN b = 15 THEN 'no_answer' WHEN b < 8 THEN 'bad' END AS eb, CASE WHEN c = 15 THEN 'no_answer' WHEN c < 6 THEN 'bad' END AS ec,
    CASE WHEN a >= 8 AND a < 11 OR a = 15 OR a < 8 THEN 2 ELSE 1 END AS ca, CASE WHEN b = 15 OR b < 8 THEN 2 ELSE 1 END AS cb, CASE WHEN c < 12 OR c = 15 THEN 2 ELSE 1 END AS cc FROM {_sql(_REPLIES)})
SELECT doc_id, CASE WHEN ea IS NULL THEN 'a-' || lang WHEN eb IS NULL THEN 'b-' || lang WHEN ec IS NULL THEN 'c-' || lang ELSE 'file-' || doc_id END AS name,
    CASE WHEN ea IS NULL OR eb IS NULL THEN 'paid' WHEN ec IS NULL THEN 'home' ELSE 'fallback' END AS provider, CASE WHEN ea IS NULL THEN 'm1' WHEN eb IS NULL THEN 'm2' WHEN ec IS NULL THEN 'm3' ELSE 'fallback' END AS model,
    ea IS NOT NULL AND eb IS NOT NULL AND ec IS NOT NULL AS used_fallback, CASE WHEN ea IS NOT NULL AND eb IS NOT NULL THEN CASE ec WHEN 'bad' THEN 'INVALID_JSON_RESPONSE' ELSE ec END END AS reason,
    (ca + CASE WHEN ea IS NOT NULL THEN cb ELSE 0 END + CASE WHEN ea IS NOT NULL AND eb IS NOT NULL THEN cc ELSE 0 END)::INT AS calls FROM x"""

# ---- changes applied -------------------------------------------------------

_CATALOGUE = {
    "doc_id": "doc_id", "sha256": "md5(text)", "current_filename": "source || '.txt'", "updated_at_utc": "'t0'", "last_verified_utc": "CAST(NULL AS STRING)",
    "current_path": f"CASE {_h('p')} WHEN 0 THEN NULL WHEN 1 THEN 'old/' || source || '.txt' ELSE 'lib/' || lang || doc_id || '/' || source || '.txt' END",
    "status": f"CASE WHEN {_h('s')} < 9 THEN 'LIBRARY_STORED' WHEN {_h('s')} < 14 THEN 'DECISION_PENDING' ELSE 'DELETED' END",
    "flow_state": f"CASE WHEN {_h('f')} < 4 THEN NULL WHEN {_h('f')} < 12 THEN 'LIBRARY_STORED' ELSE 'ROUTE_CONFIRMED' END",
    "pending_decision": "lang", "content_json": f"CASE WHEN {_h('c')} < 3 THEN NULL WHEN {_h('c')} < 6 THEN 'no json' ELSE '{{\"name\": \"' || lang || '\"}}' END",
}
#: Three changes a document, and those of documents that are not there.
_KIND = "CASE WHEN {0} < 5 THEN 'resolve' WHEN {0} < 9 THEN 'trash' WHEN {0} < 11 THEN 'verify' WHEN {0} < 13 THEN 'delete' ELSE 'undo' END"
_CHANGES = " UNION ALL ".join(
    f"SELECT doc_id * 10 + {k} AS seq, doc_id + CASE WHEN {_h(k)} = 7 THEN 1000000000 ELSE 0 END AS doc_id, {_KIND.format(_h(k))} AS kind, "
    f"CASE WHEN {_h(k)} >= 13 THEN 'lib/' || lang || doc_id || '/' || source || '.txt' WHEN {_h(k)} > 0 THEN 'Work/' || lang END AS target, 'at{k}' AS at FROM documents"
    for k in (1, 2, 3)
)


def _changed(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("documents")
    changes = spark.sql(_CHANGES)
    spark.catalog.dropTempView("documents")
    return A.changed(_made(spark, d, _CATALOGUE), changes, "lib", "trash")


def changes_applied(spark, d):
    """The catalogue after decisions, trash, undo, deletions and checks, each row's own in order; placed files keep their names apart."""
    return _changed(spark, d)[0].drop("sha256")


def change_counters(spark, d):
    return A.counters(_changed(spark, d)[1])


_REPLAY = f"""c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM ({_CHANGES})),
r AS (SELECT doc_id, 0::BIGINT AS i, current_filename AS fn, current_path AS p, status AS s, updated_at_utc AS u, flow_state AS f, pending_decision AS pd, content_json AS cj, last_verified_utc AS v, NULL::BIGINT AS placed, NULL::VARCHAR AS cat, true AS here, NULL::VARCHAR AS kind, NULL::VARCHAR AS o FROM {_sql(_CATALOGUE).replace('CAST(NULL AS STRING)', 'NULL::VARCHAR')}
    UNION ALL SELECT doc_id, i, CASE WHEN ok AND kind = 'delete' THEN '' ELSE fn END,
        CASE WHEN ok AND kind = 'resolve' THEN 'lib/' || target || '/' || fn WHEN ok AND kind = 'trash' THEN 'trash' || substr(p, 4) WHEN ok AND kind = 'delete' THEN '' ELSE p END,
        CASE WHEN ok AND kind = 'resolve' THEN 'LIBRARY_STORED' WHEN ok AND kind = 'trash' THEN 'LIBRARY_TRASHED' WHEN ok AND kind = 'delete' THEN 'DELETED' ELSE s END,
        CASE WHEN ok AND kind IN ('resolve', 'trash', 'delete') THEN "at" ELSE u END,
        CASE WHEN ok AND kind = 'resolve' THEN 'LIBRARY_STORED' WHEN ok AND kind = 'trash' THEN 'LIBRARY_TRASHED' WHEN ok AND kind = 'delete' THEN NULL ELSE f END,
        CASE WHEN ok AND kind IN ('resolve', 'trash', 'delete') THEN NULL ELSE pd END, CASE WHEN ok AND kind = 'delete' THEN NULL ELSE cj END, CASE WHEN ok AND kind = 'verify' THEN "at" ELSE v END,
        CASE WHEN ok AND kind IN ('resolve', 'trash') THEN seq WHEN ok AND kind = 'delete' THEN NULL ELSE placed END, CASE WHEN ok AND kind = 'resolve' THEN target WHEN ok AND kind = 'delete' THEN NULL ELSE cat END, here AND NOT (ok AND kind = 'undo'), kind, o
    FROM (SELECT *, o = 'applied' AS ok FROM (SELECT r.* EXCLUDE (i, kind, o), c.i, c.seq, c.kind, c.target, c."at", CASE WHEN NOT here THEN 'unknown_to_catalog'
        WHEN c.kind = 'resolve' THEN CASE WHEN s != 'DECISION_PENDING' THEN 'not_pending' WHEN target IS NULL THEN 'invalid_path' ELSE 'applied' END
        WHEN c.kind = 'trash' THEN CASE WHEN NOT starts_with(coalesce(p, ''), 'lib/') THEN 'outside_library' WHEN coalesce(f, 'LIBRARY_STORED') NOT IN ('LIBRARY_STORED', 'USER_CONFIRMATION_REQUIRED') THEN 'illegal_transition' ELSE 'applied' END
        WHEN c.kind = 'undo' THEN CASE WHEN p IS DISTINCT FROM target THEN 'unknown_to_catalog' ELSE 'applied' END
        WHEN c.kind = 'delete' THEN CASE WHEN s = 'DELETED' THEN 'already_deleted' ELSE 'applied' END
        ELSE CASE WHEN s != 'LIBRARY_STORED' THEN 'not_stored' ELSE 'applied' END END AS o FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1)))"""
#: Files of one name meet only below Work, and no numbered name is wanted: the i-th of them takes the i-th name.
_APPLIED = f"""WITH RECURSIVE {_REPLAY}, l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
n AS (SELECT *, CASE WHEN placed IS NOT NULL THEN row_number() OVER (PARTITION BY p, placed IS NULL ORDER BY placed) END AS k FROM l WHERE here),
m AS (SELECT *, CASE WHEN k > 1 THEN substr(p, 1, length(p) - 4) || '__' || (k - 1) || '.txt' ELSE p END AS q FROM n)
SELECT doc_id, CASE WHEN placed IS NOT NULL THEN list_last(string_split(q, '/')) ELSE fn END AS current_filename, q AS current_path, s AS status, u AS updated_at_utc, f AS flow_state, pd AS pending_decision,
    CASE WHEN cat IS NOT NULL AND cj LIKE '{{%' THEN substr(cj, 1, length(cj) - 1) || ', "category_path": "' || cat || '"}}' ELSE cj END AS content_json, v AS last_verified_utc FROM m"""
_COUNTED = f"""WITH RECURSIVE {_REPLAY} SELECT kind, o AS outcome, count(*)::BIGINT AS n FROM (SELECT kind, o FROM r WHERE i > 0 UNION ALL SELECT kind, 'unknown_to_catalog' FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents)) GROUP BY ALL"""

# ---- days ------------------------------------------------------------------

_DAYS = {"doc_id": "doc_id", "told": f"CASE {_h('d')} WHEN 0 THEN NULL WHEN 1 THEN '24-3-5' WHEN 2 THEN '12024-3-5' WHEN 3 THEN '2024-02-30' WHEN 4 THEN lang WHEN 5 THEN ' 2024-3-5' WHEN 6 THEN '2023-2-29' ELSE '20' || lpad(CAST(doc_id % 90 + 10 AS STRING), 2, '0') || '-' || ({_h('m')} % 12 + 1) || '-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') END"}


def document_days(spark, d):
    """Dates as analyses tell them, well formed or not."""
    return _made(spark, d, _DAYS).select("doc_id", F.date_format(day(F.col("told")), "yyyy-MM-dd").alias("day"))


# ---- contents and snapshots ------------------------------------------------

_READ = {"doc_id": "doc_id", "path": f"source || '/d' || doc_id || (CASE {_h('x')} WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.psd' WHEN 3 THEN '.mp3' WHEN 4 THEN '.weird' WHEN 5 THEN '' ELSE '.txt' END)", "text": f"CASE {_h('y')} WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(10) || ' ' ELSE text END"}


def text_extraction(spark, d):
    """What local reading gives of each file, and which reader the others need."""
    rows = _made(spark, d, _READ).select("doc_id", extraction(F.col("path"), F.col("text")).alias("x"))
    return rows.select("doc_id", "x.media_type", F.md5("x.text").alias("text_md5"), "x.needs_reader", "x.hint", "x.reason")


_EXTRACTED = f"""WITH k AS (SELECT doc_id, text, CASE {_h('x').replace('text', 'own')} WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image_' WHEN 3 THEN 'audio' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown' ELSE 'text' END AS k
    FROM (SELECT doc_id, text AS own, CASE {_h('y')} WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(10) || ' ' ELSE text END AS text FROM documents)), e AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) = '' AS empty FROM k)
SELECT doc_id, rtrim(k, '_') AS media_type, CASE WHEN k = 'text' THEN md5(CASE WHEN empty THEN '' ELSE text END) END AS text_md5, k IN ('pdf', 'image', 'audio') AS needs_reader, CASE k WHEN 'pdf' THEN 'ocr' WHEN 'image' THEN 'vision' WHEN 'audio' THEN 'av' END AS hint,
    CASE k WHEN 'text' THEN CASE WHEN empty THEN 'empty' ELSE 'text_extracted' END WHEN 'pdf' THEN 'pdf_needs_reader' WHEN 'image' THEN 'image_needs_vision' WHEN 'image_' THEN 'image_not_vision_readable' WHEN 'audio' THEN 'av_needs_reader' ELSE 'unsupported_local_extraction' END AS reason FROM e"""

_SNAPSHOT = "struct<doc_id:bigint,current_path:string,status:string,content:struct<name:string>>"


def snapshot_reread(spark, d):
    """The catalogue written as one JSON document and read again in byte ranges."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    R.snapshot(_made(spark, d, _CATALOGUE), "lib", "now", "catalog").select("value").write.text(path)
    return read_large_snapshot(spark, path, _SNAPSHOT).select("doc_id", "current_path", "status", F.col("content.name").alias("name"))


_REREAD = f"SELECT doc_id, current_path, status, CASE WHEN content_json LIKE '{{%' THEN pending_decision END AS name FROM {_sql(_CATALOGUE).replace('CAST(NULL AS STRING)', 'NULL::VARCHAR')}"

# ---- forecasts -------------------------------------------------------------

_CHAINED = [("IMAGE", "paid", "m0"), ("OCR", "paid", "m1"), ("TRANSCRIBE", "paid", "m2"), ("VIDEO", "home", "m3"), ("ANALYSIS", "paid", "m4"), ("NAMING", "paid", "m9")]
_MEASURED = [("ANALYSIS", 1000.7, 33.3, 0.5)]
_PRICED = [("paid", "m0", "EUR", 1.0, 3.0, None, None, None, None, None), ("paid", "m1", "EUR", None, None, 2.0, None, None, None, "2025-11-01"), ("paid", "m2", "EUR", None, None, None, 0.003, None, None, None), ("paid", "m4", "EUR", 0.5, None, 1.0, None, None, None, None)]
_TASKED = f"list_element(['IMAGE', 'OCR', 'TRANSCRIBE', 'VIDEO', 'ANALYSIS', 'NAMING', 'ORGANIZE', NULL], ({_h('t')} % 8 + 1)::INT)"


def cost_forecast(spark, d):
    """Tasks with a history, without one and without a chain, pages, audio, a withdrawn rate and a model without a price."""
    names = "element_at(array('IMAGE', 'OCR', 'TRANSCRIBE', 'VIDEO', 'ANALYSIS', 'NAMING', 'ORGANIZE', null), CAST(" + _h("t") + " % 8 + 1 AS INT))"
    calls = _made(spark, d, {"task": names, "n": "doc_id % 3 + 1"}).groupBy("task").agg(F.count(F.lit(1)).alias("calls_low"), F.sum("n").alias("calls_high"))
    chain = spark.createDataFrame(_CHAINED, "task string, provider string, model string")
    measured = spark.createDataFrame(_MEASURED, "task string, mean_in double, mean_out double, mean_pages double")
    prices = spark.createDataFrame(_PRICED, "provider string, model string, currency string, in_per_mtok double, out_per_mtok double, per_1k_pages double, per_audio_minute double, per_audio_second double, free boolean, absent_since string")
    return R.forecast(calls, chain, measured, prices, ("home",), 7325.0, 0.01)


_FORECAST = f"""WITH t AS (SELECT task, count(*) AS l, sum(doc_id % 3 + 1) AS h FROM (SELECT doc_id, {_TASKED} AS task FROM documents) WHERE task IS NOT NULL GROUP BY task), x AS (SELECT task, unnest([1, 2]) AS w, unnest([l, h]) AS n FROM t),
s AS (SELECT w, sum(CASE task WHEN 'IMAGE' THEN n * 1500 / 1e6::DOUBLE * 1.0::DOUBLE + n * 350 / 1e6::DOUBLE * 3.0::DOUBLE WHEN 'OCR' THEN n * 2 / 1e3::DOUBLE * 2 WHEN 'TRANSCRIBE' THEN 7325.0::DOUBLE / 60 * 0.003::DOUBLE
    WHEN 'ANALYSIS' THEN floor(n * 1000.7::DOUBLE) / 1e6::DOUBLE * 0.5::DOUBLE + floor(n * 0.5::DOUBLE) / 1e3::DOUBLE ELSE 0 END) AS c, sum(CASE WHEN task IN ('IMAGE', 'OCR', 'TRANSCRIBE', 'ANALYSIS') THEN n ELSE 0 END)::BIGINT AS k FROM x GROUP BY w)
SELECT round(max(c) FILTER (w = 1), 9) AS cost_low, round(max(c) FILTER (w = 2), 9) AS cost_high, max(k) FILTER (w = 1) AS calls_low, max(k) FILTER (w = 2) AS calls_high, 'EUR' AS currencies, 'm9' AS unpriced, 'ANALYSIS' AS calibrated, 'IMAGE,OCR' AS coarse, 'm1:2025-11-01' AS withdrawn, true AS is_floor, max(c) FILTER (w = 2) > 0.01 AS over_ceiling FROM s"""

# ---- batches and series ----------------------------------------------------

_STATES = "CASE {0} WHEN 0 THEN NULL WHEN 1 THEN 'ERROR_RETRYABLE' WHEN 2 THEN 'ERROR_BLOCKING' WHEN 3 THEN 'INBOX_TRASH_PENDING_MANUAL' WHEN 4 THEN 'USER_CONFIRMATION_REQUIRED' WHEN 5 THEN 'ROUTE_CONFIRMED' ELSE 'LIBRARY_STORED' END"
_RESULTS = {"doc_id": "doc_id", "flow_state": _STATES.format(_h("f")), "pending": f"CASE {_h('p')} WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN true ELSE false END", "organized": f"CASE WHEN {_h('o')} < 9 THEN true WHEN {_h('o')} < 14 THEN false END", "mirror_failed": f"{_h('m')} = 3"}
_STEPS = {"kind": f"CASE {_h('k')} WHEN 0 THEN 'regrouped' WHEN 1 THEN 'collapsed_nestings' WHEN 2 THEN 'rescan_moved' WHEN 3 THEN 'rescan_new' WHEN 4 THEN 'recovered' WHEN 5 THEN 'odd' END", "n": f"CASE WHEN {_h('n')} > 1 THEN n_chars % 9 END"}


def batch_summary(spark, d):
    """All counters of a batch; no step tells of an abort."""
    return E.batch_summary(_made(spark, d, _RESULTS), _made(spark, d, _STEPS))


_SUMMED = f"""WITH r AS (SELECT coalesce(flow_state, '') AS f, coalesce(pending, false) AS p, coalesce(organized, false) AS o, mirror_failed AS m FROM {_sql(_RESULTS)}), k AS (SELECT * FROM {_sql(_STEPS)}),
s AS (SELECT {", ".join(f"coalesce(sum(n) FILTER (kind = '{x}'), 0)::BIGINT AS {x}" for x in ("regrouped", "collapsed_nestings", "rescan_moved", "rescan_new", "recovered", "aborted"))} FROM k)
SELECT count_if(NOT p AND f = 'LIBRARY_STORED')::BIGINT AS processed, count_if(NOT p AND f = 'INBOX_TRASH_PENDING_MANUAL')::BIGINT AS duplicates, count_if(NOT p AND f = 'USER_CONFIRMATION_REQUIRED')::BIGINT AS manual_reviews, count_if(p)::BIGINT AS pending_decisions,
    count_if(NOT p AND f = 'LIBRARY_STORED' AND o)::BIGINT AS organized, count_if(NOT p AND f LIKE 'ERROR%')::BIGINT AS errors, count_if(m)::BIGINT AS mirror_failures, count(*)::BIGINT AS total, any_value(s.regrouped) AS regrouped, any_value(s.collapsed_nestings) AS collapsed_nestings,
    any_value(s.rescan_moved) AS rescan_moved, any_value(s.rescan_new) AS rescan_new, any_value(s.recovered) AS recovered, any_value(s.aborted) AS aborted FROM r, s"""

_SERIES = {"doc_id": "doc_id", "route": f"CASE WHEN {_h('r')} < 8 THEN 'Home/Bills' WHEN {_h('r')} < 11 THEN 'Home/Bills/Water' ELSE 'Work' END", "series": f"{_h('s')} < 11", "issuer": f"CASE {_h('i')} WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN upper(source) WHEN 3 THEN 'new ' || source ELSE source END"}


def series_entities(spark, d):
    """Issuers below bare bases; folders that are there in another case are used again."""
    docs = table(spark, d, "documents")
    folders = docs.select(F.concat(F.lit("Home/Bills/"), F.initcap("source")).alias("path")).unionByName(docs.select(F.concat(F.lit("Home/Bills/"), F.upper("source")).alias("path")).filter("path like '%3'"))
    bases = docs.select(F.lit("Home/Bills").alias("base")).distinct().unionByName(docs.select(F.lit("Work").alias("base")).distinct())
    return R.with_series_entity(_made(spark, d, _SERIES), bases, folders.distinct())


_ENTITIES = f"""WITH x AS (SELECT doc_id, route, CASE WHEN series AND route IN ('Home/Bills', 'Work') AND trim(issuer) != '' THEN replace(issuer, ' ', '-') END AS e FROM {_sql(_SERIES)})
SELECT doc_id, route || CASE WHEN e IS NULL THEN '' WHEN route = 'Home/Bills' AND lower(e) IN (SELECT lower(source) FROM documents) THEN '/' || CASE WHEN e LIKE '%3' THEN upper(e) ELSE upper(e[1]) || lower(e[2:]) END ELSE '/' || e END AS route FROM x"""

# ---- files written and read ------------------------------------------------

_MODELS = {"provider": "source", "model": "'m-' || lang", "low": "n_chars", "cheap": f"{_h('c')}", "named": "lang"}


def price_files(spark, d):
    """Price files of three schemas written from the documents and read again; too high and negative prices are none."""
    path = f"{shared_dir(spark)}/prices-{uuid.uuid4().hex}"
    by = _made(spark, d, _MODELS).groupBy("provider", "model").agg(F.max("low").alias("high"), F.min("low").alias("low"), F.max("cheap").alias("c"))
    spec = F.struct(F.col("high").cast("double").alias("in_per_mtok"), (F.col("low") - 100).cast("double").alias("out_per_mtok"), F.when(F.col("c") > 14, True).alias("free"), F.when(F.col("c") % 2 == 0, "").otherwise("ocr").alias("kind"), F.when(F.col("low") % 3 == 0, F.col("model")).alias("display_name"))
    models = lambda rows: F.map_from_entries(F.collect_list(rows))
    sellers = by.groupBy("provider").agg(models(F.struct("model", spec.alias("s"))).alias("models"))
    seller = F.struct(F.when(F.col("provider") != "src1", F.lit("EUR")).alias("currency"), F.lit("2026-01-01").alias("updated"), F.lit("").alias("source"), "models")
    two = sellers.agg(models(F.struct("provider", seller.alias("p"))).alias("providers")).select(F.lit(2).alias("schema_version"), "providers")
    one = by.filter("provider = 'src1'").agg(models(F.struct("model", spec.alias("s"))).alias("models"))
    for df in (two, one.select(F.lit(1).alias("schema_version"), F.lit("GBP").alias("currency"), "models"), one.select(F.lit(3).alias("schema_version"), "models")):
        df.write.mode("append").json(path)
    return read_prices(spark, path).select("provider", "model", "currency", "updated", "source", "display_name", "in_per_mtok", "out_per_mtok", "free", "kind")


_PRICE_FILES = f"""WITH b AS (SELECT provider, model, max(low) AS hi, min(low) AS lo, max(cheap) AS c FROM {_sql(_MODELS)} GROUP BY ALL),
x AS (SELECT provider, model, CASE WHEN provider != 'src1' THEN 'EUR' ELSE 'USD' END AS currency, '2026-01-01' AS updated, hi, lo, c FROM b UNION ALL SELECT '*', model, 'GBP', NULL, hi, lo, c FROM b WHERE provider = 'src1')
SELECT provider, model, currency, updated, NULL::VARCHAR AS source, model AS display_name, CASE WHEN hi <= 10000 THEN hi::DOUBLE END AS in_per_mtok, CASE WHEN lo - 100 BETWEEN 0 AND 10000 THEN (lo - 100)::DOUBLE END AS out_per_mtok, coalesce(c > 14, false) AS free, CASE WHEN c % 2 != 0 THEN 'ocr' END AS kind FROM x"""


def log_reread(spark, d):
    """Events appended to a log in two steps, with broken, blank and foreign lines between them, and read again."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("event_time_utc"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("run_id"), F.when(F.col("value") > 1, F.col("props")).alias("message"))
    append_events(e.filter("event_id % 2 = 0"), path)
    bad = table(spark, d, "events").select(F.element_at(F.array(F.lit('{"event_id": "x", '), F.lit(""), F.lit("[1, 2]"), F.lit("7"), F.lit("{}"), F.lit('"text"')), (F.col("event_id") % 6 + 1).cast("int")).alias("value"))
    bad.write.mode("append").text(path)
    append_events(e.filter("event_id % 2 = 1"), path)
    return read_events(spark, path).select("event_id", "event_time_utc", "action", "run_id", "message")


_LOG = "SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_time_utc, event_type AS action, user_id::VARCHAR AS run_id, CASE WHEN value > 1 THEN props END AS message FROM events"

# ---- diagnostics -----------------------------------------------------------

_CHAIN_ROWS = {"task": "source", "n": "doc_id", "provider": f"CASE WHEN {_h('p')} < 4 THEN 'home' WHEN {_h('p')} < 9 THEN 'paid' ELSE 'other' END", "model": f"'m' || {_h('m')}", "named": f"source != 'src1' AND {_h('e')} < 2"}
_PRICE_ROWS = {"provider": "CASE WHEN n_chars % 2 = 0 THEN 'paid' ELSE 'other' END", "model": f"'m' || {_h('m')}", "in_per_mtok": f"CASE WHEN {_h('a')} < 3 THEN 1.5 END", "free": f"CASE WHEN {_h('b')} = 0 THEN true END", "absent_since": f"CASE WHEN {_h('s')} < 12 THEN '2025-0' || (n_chars % 9 + 1) END"}


def health(spark, d):
    """Queue, chains, prices and catalogue: what is wrong with an installation, of tables made of the documents."""
    docs = table(spark, d, "documents")
    chain = _made(spark, d, _CHAIN_ROWS).filter("named").drop("named")
    keys = spark.range(3).selectExpr("element_at(array('paid', 'other', 'third'), CAST(id AS INT) + 1) AS provider", "id = 0 AS is_set")
    prices = _made(spark, d, _PRICE_ROWS).withColumn("in_per_mtok", F.col("in_per_mtok").cast("double"))
    left = docs.filter("n_chars % 50 = 7").select(F.concat(F.lit("queue/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    parts = [H.queue(left), H.queue(left.limit(0)), H.chains(docs.select(F.col("source").alias("task")), chain, keys), H.pricing(chain, prices, ("home",)), H.catalogue(_made(spark, d, _CATALOGUE)), H.catalogue(docs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def status_lines(spark, d):
    """The integrity line of orders by priority: each as a catalogue of its own."""
    o = table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).cast("timestamp").alias("last_verified"))
    out = None
    for which in ("o_orderpriority = '1-URGENT'", "o_orderpriority = '5-LOW' AND last_verified >= '1998-07-25'", "false"):
        one = H.integrity_line(C.integrity_status(o.filter(which), F.lit("1998-08-03").cast("timestamp")))
        out = one if out is None else out.unionByName(one)
    return out


_HEALTH = f"""WITH c AS (SELECT * FROM {_sql(_CHAIN_ROWS)} WHERE named), q AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS name FROM documents WHERE n_chars % 50 = 7), qn AS (SELECT count(*) AS n, array_to_string(list_sort(list(name))[1:5], ', ') AS s FROM q),
t AS (SELECT DISTINCT source AS task FROM documents), g AS (SELECT task, string_agg(provider || ':' || model, ',' ORDER BY n) AS a, arg_min(provider, n) AS p, arg_min(model, n) AS m FROM c GROUP BY task),
r AS (SELECT provider, model, CASE WHEN count(*) FILTER (absent_since IS NULL) = 0 THEN max(absent_since) END AS gone FROM {_sql(_PRICE_ROWS)} WHERE in_per_mtok IS NOT NULL OR free GROUP BY ALL)
SELECT 'Queue' AS section, 'queue_empty' AS "check", CASE WHEN n > 0 THEN 'FAIL' ELSE 'OK' END AS state, CASE WHEN n > 0 THEN n || ': ' || s || CASE WHEN n > 5 THEN ', and ' || (n - 5) || ' more' ELSE '' END ELSE 'empty' END AS detail FROM qn UNION ALL SELECT 'Queue', 'queue_empty', 'OK', 'empty'
UNION ALL SELECT 'AI', 'task_' || lower(task), CASE WHEN a IS NULL THEN 'WARN' ELSE 'OK' END, coalesce(a, 'no provider chain') FROM t LEFT JOIN g USING (task)
UNION ALL SELECT 'AI', 'key_' || k, CASE WHEN k NOT IN (SELECT provider FROM c) THEN 'SKIP' WHEN ok THEN 'OK' ELSE 'FAIL' END, CASE WHEN k NOT IN (SELECT provider FROM c) THEN 'no chain calls it' WHEN ok THEN 'set' ELSE 'unset, but a chain calls it' END FROM (VALUES ('paid', true), ('other', false), ('third', false)) v(k, ok)
UNION ALL SELECT 'Pricing', 'price_' || lower(task), CASE WHEN p = 'home' THEN 'SKIP' WHEN r.provider IS NULL OR gone IS NOT NULL THEN 'WARN' ELSE 'OK' END, CASE WHEN p = 'home' THEN 'home bills nothing' WHEN r.provider IS NULL THEN p || ':' || m || ' has no price' WHEN gone IS NOT NULL THEN p || ':' || m || ' is listed no more since ' || gone ELSE p || ':' || m END
    FROM g LEFT JOIN r ON r.provider = g.p AND r.model = g.m
UNION ALL SELECT 'Catalog', 'catalog_db', 'OK', count(*) || ' documents' FROM documents UNION ALL SELECT 'Catalog', 'catalog_schema', 'OK', 'flow_state is there' UNION ALL SELECT 'Catalog', 'catalog_db', 'OK', count(*) || ' documents' FROM documents UNION ALL SELECT 'Catalog', 'catalog_schema', 'WARN', 'flow_state is not there'"""
_STATUS = """WITH o AS (SELECT o_orderpriority AS p, CASE WHEN o_orderkey % 7 != 0 THEN o_orderdate END::TIMESTAMP AS v FROM orders), c(k) AS (VALUES (1), (2), (3)), x AS (SELECT k, CASE WHEN p IS NOT NULL THEN floor(epoch(TIMESTAMP '1998-08-03' - v) / 86400)::BIGINT END AS age, p IS NOT NULL AS there FROM c LEFT JOIN o ON k = 1 AND p = '1-URGENT' OR k = 2 AND p = '5-LOW' AND v >= TIMESTAMP '1998-07-25'),
s AS (SELECT k, count_if(there) AS n, count_if(there AND coalesce(age >= 30, true)) AS late, max(age) AS old FROM x GROUP BY k)
SELECT CASE WHEN n = 0 THEN 'no documents filed yet' WHEN late = 0 THEN 'all ' || n || ' document(s) verified within 30 days' || coalesce(', oldest ' || old || ' day(s) ago', '') ELSE n || ' document(s)' || coalesce(', oldest ' || old || ' day(s) ago', '') || '; ' || late || ' overdue' END AS line FROM s"""

QUERIES = {f.__name__: f for f in (moves_applied, unique_names, analysis_chain, changes_applied, change_counters, document_days, text_extraction, snapshot_reread, batch_summary, series_entities, price_files, log_reread, health, status_lines, cost_forecast)}
ORACLES = {
    "moves_applied": _MOVED,
    "unique_names": _NAMED,
    "analysis_chain": _CHAIN,
    "changes_applied": _APPLIED,
    "change_counters": _COUNTED,
    "document_days": f"SELECT doc_id, CASE WHEN regexp_full_match(told, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN strftime(try_strptime(told, '%Y-%m-%d'), '%Y-%m-%d') END AS day FROM {_sql(_DAYS).replace('AS STRING', 'AS VARCHAR')}",
    "text_extraction": _EXTRACTED,
    "snapshot_reread": _REREAD,
    "batch_summary": _SUMMED,
    "series_entities": _ENTITIES,
    "price_files": _PRICE_FILES,
    "log_reread": _LOG,
    "health": _HEALTH,
    "status_lines": _STATUS,
    "cost_forecast": _FORECAST,
}
