"""Search and catalogue queries over the test tables, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.exprs import tokens
from quarry.operators import catalog as C
from quarry.operators import search as S
from quarry.operators.index import SearchIndex, index_of
from quarry.operators.staged import shared_dir
from quarry.sources.readers import table

COLUMNS = {"name": "source", "content": "text", "category": "lang"}
NEAR = "disgustign"  # a misspelling; the table has only the right one


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def _source(d):
    return f"{d}/documents.parquet"


def _index(spark, d):
    return index_of("documents", _source(d), _docs(spark, d), COLUMNS)


def search_all(spark, d):
    return _index(spark, d).search("worthless clown")


def search_any(spark, d):
    return _index(spark, d).search_any("the pathetic moron")


def search_columns_weighted(spark, d):
    return _index(spark, d).search("src3 en")


def search_phrase(spark, d):
    return _index(spark, d).ranked([[["of", "the"]]])


def search_fuzzy(spark, d):
    return _index(spark, d).search(NEAR)


SIX = {"name": "name", "keywords": "keywords", "entities": "entities", "summary": "summary", "content": "body", "category": "category"}


def search_stored(spark, d):
    """Stored rows alone, by all six columns; the body is a sidecar's text where there is one."""
    docs = _docs(spark, d).withColumns({
        "status": F.when(F.col("doc_id") % 7 == 0, C.DELETED).otherwise(C.STORED), "name": F.concat_ws(" ", "source", "doc_id"), "keywords": F.when(F.col("doc_id") % 3 == 0, "tax moron"),
        "entities": F.col("source"), "summary": F.substring_index("text", "\n", 1), "body": F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("scan "), "lang")).otherwise(F.col("text")), "category": F.concat(F.lit("Home/"), "lang"),
    })
    return index_of("stored", _source(d), docs, SIX).search_any("moron scan")


SYNONYMS = {"fr": ["french", "francais"], "de": ["german", "deutsch"], "en": ["english"], "es": ["spanish"]}


def search_category_synonyms(spark, d):
    docs = _docs(spark, d).withColumn("category", S.with_synonyms(F.col("lang"), SYNONYMS))
    return index_of("synonyms", _source(d), docs, {"category": "category"}).ranked([[["deutsch"]]])


def search_after_changes(spark, d):
    """The same question to an index before and after rows came, changed and went; only what changed is tokenised."""
    docs = _docs(spark, d)
    before = docs.filter("doc_id % 5 != 0").withColumn("text", F.when(F.col("doc_id") % 7 == 1, F.concat_ws(" ", "lang", F.lit("pathetic"))).when(F.col("doc_id") % 11 != 3, F.col("text")))
    first = SearchIndex.build(before, COLUMNS, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    second = first.update(docs.filter("doc_id % 13 != 4"))
    state = lambda index, n: index.search_any("the pathetic moron").withColumn("state", F.lit(n))
    return state(first, 1).unionByName(state(second, 2))


def search_snippets(spark, d):
    """The best documents with the ten tokens that tell most of the query."""
    index = _index(spark, d)
    return index.snippets(index.search_any("the pathetic moron"), _docs(spark, d), "the pathetic moron")


def near_spellings(spark, d):
    """Candidates of the pair index for a misspelt word, of all terms; those that pass are ``search_fuzzy``'s."""
    index = _index(spark, d)
    found = index.near_candidates(NEAR).join(index.terms, "term").agg(F.count(F.lit(1)).alias("n_scored"))
    return found.join(index.terms.agg(F.count(F.lit(1)).alias("n_terms")))  # one row each


def vocabulary(spark, d):
    return S.vocabulary(_docs(spark, d), {"content": "text"})


def token_totals(spark, d):
    t = tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


def _bm25(fields: dict[str, str], phrases: list[list[str]], need_all: bool, docs: str = "SELECT * FROM documents") -> str:
    """DuckDB SQL of the ranking, from the formula."""
    toks = ", ".join(f"regexp_extract_all(lower(strip_accents(coalesce({src}, ''))), '[\\p{{L}}\\p{{N}}]+') AS t_{n}" for n, src in fields.items())
    length = " + ".join(f"len(t_{n})" for n in fields)

    def count(n, p):
        if len(p) == 1:
            return f"len(list_filter(t_{n}, lambda x: x = '{p[0]}'))"
        same = " AND ".join(f"t_{n}[i + {j}] = '{w}'" for j, w in enumerate(p))
        return f"len(list_filter(range(1, len(t_{n}) - {len(p) - 2}), lambda i: {same}))"

    tf = ", ".join("(" + " + ".join(f"{S.WEIGHTS[n]} * {count(n, p)}" for n in fields) + f") AS f{i}" for i, p in enumerate(phrases))
    some = ", ".join(f"sum((f{i} > 0)::INT) AS n{i}" for i in range(len(phrases)))
    part = " + ".join(f"CASE WHEN f{i} > 0 THEN CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / avg_length)) ELSE 0 END" for i in range(len(phrases)))
    keep = (" AND " if need_all else " OR ").join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""WITH d AS ({docs}), t AS (SELECT doc_id, {toks} FROM d), f AS (SELECT doc_id, {length} AS length, {tf} FROM t),
    s AS (SELECT count(*)::DOUBLE AS n, avg(length) AS avg_length, {some} FROM f)
    SELECT doc_id, round({part}, 6) AS score FROM f, s WHERE {keep} ORDER BY score DESC, doc_id LIMIT 20"""


_F = {"name": "source", "content": "text", "category": "lang"}
_SIX = {"name": "name", "keywords": "keywords", "entities": "entities", "summary": "summary", "content": "body", "category": "category"}
_STORED = "SELECT doc_id, source || ' ' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'tax moron' END AS keywords, source AS entities, split_part(text, chr(10), 1) AS summary, CASE WHEN doc_id % 5 = 0 THEN 'scan ' || lang ELSE text END AS body, 'Home/' || lang AS category FROM documents WHERE doc_id % 7 != 0"
_SYN = "SELECT doc_id, lang || CASE lang WHEN 'fr' THEN ' french francais' WHEN 'de' THEN ' german deutsch' WHEN 'en' THEN ' english' WHEN 'es' THEN ' spanish' ELSE '' END AS category FROM documents"


# ---- catalogue -------------------------------------------------------------


def _hashed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "source", "lang")


def majority_language(spark, d):
    return C.majority_language(_docs(spark, d), "lang")


def exact_duplicates(spark, d):
    return C.duplicates(_hashed(spark, d))


def batch_first_wins(spark, d):
    return C.first_wins(_hashed(spark, d))


def redeposit_lookup(spark, d):
    h = _hashed(spark, d)
    status = F.when(F.col("doc_id") % 11 == 0, C.DELETED).otherwise(C.STORED)
    known = h.filter("doc_id % 5 != 0").select("sha256", status.alias("status"), F.col("doc_id").alias("updated_at"))
    return C.redeposits(h.filter("doc_id % 5 = 0").select("doc_id", "sha256"), known)


def catalog_upsert(spark, d):
    docs = _docs(spark, d).select("doc_id", "source", "lang", F.col("doc_id").cast("string").alias("last_verified_utc"))
    base = docs.filter("doc_id % 2 = 0")
    new = docs.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new-"), F.col("source")).alias("source"), F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"), F.lit(None).cast("string").alias("last_verified_utc"), F.col("doc_id").alias("seq"))
    return C.upsert(base, new)


def catalog_tombstone(spark, d):
    rows = table(spark, d, "documents").withColumn("sha256", F.sha2("text", 256)).select("doc_id", "sha256", F.col("source").alias("current_filename"), F.concat_ws("/", "lang", "source").alias("current_path"), F.lit(C.STORED).alias("status"), F.lit("2026-01-01T00:00:00Z").alias("updated_at_utc"), F.col("lang").alias("flow_state"), F.col("source").alias("last_verified_utc"), F.col("text").alias("content_json"))
    return C.tombstone(rows, F.col("doc_id") % 7 == 0, F.lit("2026-02-01T00:00:00Z"))


def catalog_purge(spark, d):
    rows = _hashed(spark, d)
    return C.purge(rows, rows.filter("doc_id % 4 = 1").select("doc_id")).select("doc_id", "sha256")


def mark_verified(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("2026-01-01T00:00:00+00:00")).alias("last_verified_utc"))
    return C.mark_verified(rows, rows.filter("doc_id % 5 = 0"), "2026-03-01T00:00:00+00:00")


def _checked(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).cast("timestamp").alias("last_verified"))


def scrub_queue(spark, d):
    return C.scrub_queue(_checked(spark, d), 100).select("doc_id", F.date_format("last_verified", "yyyy-MM-dd").alias("last_verified"))


def integrity_status(spark, d):
    return C.integrity_status(_checked(spark, d), F.lit("1998-09-15").cast("timestamp"))


def scrub_matrix(spark, d):
    rows = _hashed(spark, d).select("doc_id", F.concat(F.lit("p/"), F.col("doc_id")).alias("path"), "sha256")
    library = rows.filter("doc_id % 13 != 0").withColumn("sha256", F.when(F.col("doc_id") % 17 == 0, "bad").otherwise(F.col("sha256")))
    mirror = rows.filter("doc_id % 19 != 0").withColumn("sha256", F.when(F.col("doc_id") % 34 == 0, "bad").otherwise(F.col("sha256")))
    return C.scrub_matrix(rows.select("path", "sha256"), library, mirror)


def rescan_plan(spark, d):
    h = _hashed(spark, d)
    path = F.concat(F.lit("lib/"), F.col("doc_id"))
    rows = h.filter("doc_id % 10 != 9").select("doc_id", path.alias("path"), "sha256", F.when(F.col("doc_id") % 10 == 8, C.DELETED).otherwise(C.STORED).alias("status"), F.col("doc_id").alias("ord"))
    moved = F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("moved/"), F.col("doc_id"))).otherwise(path)
    disk = h.filter("doc_id % 10 not in (2, 3)").select(moved.alias("path"), "sha256").unionByName(h.filter("doc_id % 10 = 4").select(F.concat(F.lit("copy/"), F.col("doc_id")).alias("path"), "sha256"))
    return C.rescan_plan(disk, rows, h.filter("doc_id % 10 = 3").select(path.alias("path")))


def restore_plan(spark, d):
    h = _hashed(spark, d).select("doc_id", F.concat(F.lit("p/"), F.col("doc_id")).alias("path"), "sha256")
    return C.restore_plan(h.filter("doc_id % 6 != 0"), h.filter("doc_id % 4 != 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("sha256"))))


def snapshot_diff(spark, d):
    h = _docs(spark, d).select("doc_id", F.lit("a").alias("updated_at"))
    return C.snapshot_diff(h.filter("doc_id % 8 != 0"), h.filter("doc_id % 9 != 0").withColumn("updated_at", F.when(F.col("doc_id") % 7 == 0, "b").otherwise("a")))


def body_cache_refresh(spark, d):
    h = _hashed(spark, d)
    live = h.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return S.refresh_bodies(live, h.filter("doc_id % 2 = 0").select("sha256").distinct())


_H = "SELECT doc_id, sha256(text) AS sha256, source, lang FROM documents"
QUERIES = {f.__name__: f for f in (search_all, search_any, search_columns_weighted, search_phrase, search_fuzzy, search_stored, search_category_synonyms, search_after_changes, search_snippets, near_spellings, vocabulary, token_totals, majority_language, exact_duplicates, batch_first_wins, redeposit_lookup, catalog_upsert, catalog_tombstone, catalog_purge, mark_verified, scrub_queue, integrity_status, scrub_matrix, rescan_plan, restore_plan, snapshot_diff, body_cache_refresh)}
_BEFORE = "SELECT doc_id, source, lang, CASE WHEN doc_id % 7 = 1 THEN lang || ' pathetic' WHEN doc_id % 11 != 3 THEN text END AS text FROM documents WHERE doc_id % 5 != 0"
_ANY = [["pathetic"], ["moron"]]
_SNIPPETS = f"""
WITH hits AS ({_bm25(_F, _ANY, False)}), docs AS (SELECT * FROM documents SEMI JOIN hits USING (doc_id)),
v AS (SELECT doc_id, 0 AS o, 'name' AS field, source AS x FROM docs UNION ALL SELECT doc_id, 1, 'content', text FROM docs UNION ALL SELECT doc_id, 2, 'category', lang FROM docs),
t AS (SELECT doc_id, o, field, regexp_extract_all(coalesce(x, ''), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{Mn}}]*') AS t FROM v),
w AS (SELECT *, list_transform(t, lambda y: CASE WHEN lower(strip_accents(y)) IN ('pathetic', 'moron') THEN '[' || y || ']' ELSE y END) AS s, list_transform(t, lambda y: lower(strip_accents(y))) AS l FROM t),
p AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM w),
b AS (SELECT doc_id, field, s, i, len(list_distinct(list_filter(l[i : i + 9], lambda y: y IN ('pathetic', 'moron')))) AS n, o FROM p WHERE l[i] IN ('pathetic', 'moron')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o, i) AS k FROM b)
SELECT h.doc_id, h.score, r.field, CASE WHEN i > 1 THEN '… ' ELSE '' END || array_to_string(s[i : i + 9], ' ') || CASE WHEN len(s) > i + 9 THEN ' …' ELSE '' END AS snippet
FROM hits h LEFT JOIN r ON h.doc_id = r.doc_id AND r.k = 1"""
_NEAR = f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(coalesce(source, '') || ' ' || coalesce(text, '') || ' ' || coalesce(lang, ''))), '[\\p{{L}}\\p{{N}}]+')) AS t FROM documents),
g AS (SELECT t, length(t) AS b, len(list_filter(list_transform(range(1, {len(NEAR)}), lambda i: substr('{NEAR}', i, 2)), lambda x: contains(t, x))) AS c FROM v),
u AS (SELECT *, ({len(NEAR)} + b) // 5 - (({len(NEAR)} + b) // 5 + {len(NEAR)} + b) % 2 AS u FROM g)
SELECT count_if(u >= abs({len(NEAR)} - b) AND c >= ({len(NEAR)} + b - u) // 2 - u - 1)::BIGINT AS n_scored, count(*)::BIGINT AS n_terms FROM u"""  # no pair of letters comes twice in the word
ORACLES = {
    "near_spellings": _NEAR,
    "search_after_changes": f"SELECT 1 AS state, * FROM ({_bm25(_F, _ANY, False, _BEFORE)}) UNION ALL SELECT 2, * FROM ({_bm25(_F, _ANY, False, 'SELECT * FROM documents WHERE doc_id % 13 != 4')})",
    "search_snippets": _SNIPPETS,
    "search_all": _bm25(_F, [["worthless"], ["clown"]], True),
    "search_any": _bm25(_F, [["pathetic"], ["moron"]], False),
    "search_columns_weighted": _bm25(_F, [["src3"], ["en"]], True),
    "search_phrase": _bm25(_F, [["of", "the"]], True),
    "search_fuzzy": _bm25(_F, [["disgusting"]], True),
    "search_stored": _bm25(_SIX, [["moron"], ["scan"]], False, _STORED),
    "search_category_synonyms": _bm25({"category": "category"}, [["deutsch"]], True, _SYN),
    "vocabulary": "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS term FROM documents) SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term",
    "token_totals": "SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t FROM documents)",
    "majority_language": "SELECT lower(trim(lang)) AS language, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, language LIMIT 1",
    "exact_duplicates": f"SELECT sha256, count(*)::BIGINT AS copies, min(doc_id) AS first_id FROM ({_H}) GROUP BY sha256 HAVING count(*) > 1",
    "batch_first_wins": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256) AS kept_id, doc_id != min(doc_id) OVER (PARTITION BY sha256) AS is_duplicate FROM ({_H})",
    "redeposit_lookup": f"WITH h AS ({_H}), k AS (SELECT sha256, sum((doc_id % 11 != 0)::INT) AS live, max(CASE WHEN doc_id % 11 = 0 THEN doc_id END) AS deleted_at FROM h WHERE doc_id % 5 != 0 GROUP BY 1) SELECT h.doc_id, CASE WHEN coalesce(k.live, 0) > 0 THEN 'live' WHEN k.deleted_at IS NOT NULL THEN 'deleted' ELSE 'new' END AS state, k.deleted_at FROM h LEFT JOIN k ON h.sha256 = k.sha256 WHERE h.doc_id % 5 = 0",
    "catalog_upsert": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new-' || source ELSE source END AS source, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END AS last_verified_utc FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "catalog_tombstone": f"SELECT doc_id, sha256, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS current_filename, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || '/' || source END AS current_path, CASE WHEN doc_id % 7 = 0 THEN 'DELETED' ELSE 'LIBRARY_STORED' END AS status, CASE WHEN doc_id % 7 = 0 THEN '2026-02-01T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS updated_at_utc, CASE WHEN doc_id % 7 != 0 THEN lang END AS flow_state, source AS last_verified_utc, CASE WHEN doc_id % 7 != 0 THEN text END AS content_json FROM (SELECT sha256(text) AS sha256, * FROM documents)",
    "catalog_purge": f"SELECT doc_id, sha256 FROM ({_H}) WHERE doc_id % 4 != 1",
    "mark_verified": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '2026-03-01T00:00:00+00:00' WHEN doc_id % 3 = 0 THEN '2026-01-01T00:00:00+00:00' END AS last_verified_utc FROM documents",
    "scrub_queue": "SELECT o_orderkey AS doc_id, strftime(CASE WHEN o_orderkey % 7 != 0 THEN o_orderdate END, '%Y-%m-%d') AS last_verified FROM orders ORDER BY CASE WHEN o_orderkey % 7 != 0 THEN o_orderdate END NULLS FIRST, o_orderkey LIMIT 100",
    "integrity_status": "WITH a AS (SELECT floor(epoch(TIMESTAMP '1998-09-15' - CASE WHEN o_orderkey % 7 != 0 THEN o_orderdate END) / 86400)::BIGINT AS age FROM orders) SELECT count(*)::BIGINT AS n_rows, sum(coalesce(age >= 30, true)::INT)::BIGINT AS n_overdue, max(age) AS oldest_days FROM a",
    "scrub_matrix": "WITH s AS (SELECT 'p/' || doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'corrupt' ELSE 'ok' END AS library, CASE WHEN doc_id % 19 = 0 THEN 'missing' WHEN doc_id % 34 = 0 THEN 'corrupt' ELSE 'ok' END AS mirror FROM documents) SELECT *, CASE WHEN library = 'ok' AND mirror = 'ok' THEN 'none' WHEN library = 'ok' THEN 'copy_to_mirror' WHEN mirror = 'ok' THEN 'restore_from_mirror' ELSE 'lost' END AS remedy FROM s",
    "rescan_plan": f"""WITH h AS ({_H}), r AS (SELECT doc_id, 'lib/' || doc_id AS path, sha256, doc_id % 10 = 8 AS dead FROM h WHERE doc_id % 10 != 9),
    k AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'moved/' ELSE 'lib/' END || doc_id AS path, sha256 FROM h WHERE doc_id % 10 NOT IN (2, 3) UNION ALL SELECT 'copy/' || doc_id, sha256 FROM h WHERE doc_id % 10 = 4),
    p AS (SELECT path FROM k UNION SELECT 'lib/' || doc_id FROM h WHERE doc_id % 10 = 3),
    u AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS i FROM k WHERE path NOT IN (SELECT path FROM r WHERE NOT dead)),
    g AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS i FROM r WHERE NOT dead AND path NOT IN (SELECT path FROM p)),
    x AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS i FROM r WHERE dead),
    a AS (SELECT u.path, u.sha256, u.i, g.doc_id AS gd, x.doc_id AS xd, u.sha256 IN (SELECT sha256 FROM r WHERE NOT dead AND path IN (SELECT path FROM p)) AS pres, u.sha256 IN (SELECT sha256 FROM g) AS hasg
      FROM u LEFT JOIN g ON u.sha256 = g.sha256 AND u.i = g.i LEFT JOIN x ON u.sha256 = x.sha256 AND u.i = x.i)
    SELECT path, CASE WHEN gd IS NOT NULL THEN gd WHEN pres OR hasg THEN NULL ELSE xd END AS doc_id, CASE WHEN gd IS NOT NULL THEN 'moved' WHEN pres OR hasg THEN 'duplicate' WHEN xd IS NOT NULL THEN 'readded' ELSE 'new' END AS action FROM a
    UNION ALL SELECT g.path, g.doc_id, 'deleted' FROM g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.sha256 = g.sha256 AND u.i = g.i)""",
    "restore_plan": "SELECT 'p/' || doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'restore' WHEN doc_id % 6 = 0 THEN 'library_only' WHEN doc_id % 5 = 0 THEN 'differs' ELSE 'identical' END AS state FROM documents WHERE doc_id % 6 != 0 OR doc_id % 4 != 0",
    "snapshot_diff": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing_in_db' WHEN doc_id % 8 = 0 THEN 'missing_in_snapshot' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'same' END AS state FROM documents WHERE doc_id % 8 != 0 OR doc_id % 9 != 0",
    "body_cache_refresh": f"WITH h AS ({_H}), l AS (SELECT DISTINCT sha256 FROM h WHERE doc_id IN (SELECT doc_id FROM labels)), b AS (SELECT DISTINCT sha256 FROM h WHERE doc_id % 2 = 0) SELECT sha256, 'add' AS action FROM l WHERE sha256 NOT IN (SELECT sha256 FROM b) UNION ALL SELECT sha256, 'prune' FROM b WHERE sha256 NOT IN (SELECT sha256 FROM l)",
}
