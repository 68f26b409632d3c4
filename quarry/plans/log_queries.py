"""Event-log, metering, path, name and sampling queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import exprs as E
from quarry.functions import paths as P
from quarry.operators import events as V
from quarry.operators import inventory as I
from quarry.operators import metering as M
from quarry.operators import sampling as G
from quarry.sources.readers import table


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("run_id"), F.col("event_type").alias("action"), "value", "props", F.concat_ws(":", "user_id", "event_type").alias("operation_id"))


def runs_list(spark, d):
    return V.runs(_events(spark, d), F.col("action") == "purchase", 10).select("run_id", F.date_format("first_time", "yyyy-MM-dd HH:mm:ss").alias("first_time"), "n_filed", "first_seq")


def latest_run_id(spark, d):
    return V.latest_run(_events(spark, d))


def latest_event_per_op(spark, d):
    return V.last_per(_events(spark, d), ["operation_id"], "value")


def undo_plan(spark, d):
    e = _events(spark, d).withColumn("operation_id", F.col("run_id"))
    path = F.concat_ws("/", F.col("action"), F.col("run_id"), F.col("seq") % 7)
    placed = e.filter("action in ('purchase', 'click')").withColumn("path_after", path)
    origins = e.filter("action = 'signup'").select("operation_id", "seq", F.concat(F.lit("inbox/"), F.col("seq")).alias("path_before"), (F.col("seq") % 3 != 0).alias("in_inbox"))
    known = placed.filter("seq % 2 = 0").select(F.col("path_after").alias("path"))
    return V.undo_plan(placed, origins, known)


def deleted_history(spark, d):
    return V.tail(_events(spark, d).filter("action = 'error'"), 50).select("seq", "run_id", "value")


def event_tallies(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    count = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
    return _events(spark, d).groupBy("run_id").agg(*map(count, ("view", "click", "purchase", "error", "signup")), F.sum(k).alias("sum_k"))


def queue_origins(spark, d):
    return V.last_per(_events(spark, d).filter("action = 'view'"), ["run_id"], "props")


LEGAL = [("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view"), ("error", "view")]


def flow_validate(spark, d):
    legal = spark.createDataFrame(LEGAL, "from_state string, to_state string")
    t = V.transitions(_events(spark, d), "run_id", "action", legal)
    return t.groupBy("from_state", "to_state", "is_legal").agg(F.count(F.lit(1)).alias("n"))


# ---- metering --------------------------------------------------------------


def _calls(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _events(spark, d).select(F.when(F.col("run_id") % 3 == 0, "local").otherwise("paid").alias("provider"), F.concat(F.lit("m"), F.col("run_id") % 4).alias("model"), F.col("action").alias("task"), k.alias("tokens_in"), (k % 7).alias("tokens_out"), (k % 5 - 1).alias("pages"), F.when(k % 3 == 0, k).alias("audio_seconds"), (F.col("value") >= 1).alias("measured"))


def usage_by_task(spark, d):
    return M.billed_first(M.usage(_calls(spark, d)), F.col("provider") == "paid")


def usage_totals(spark, d):
    return M.usage_totals(M.usage(_calls(spark, d)), F.col("provider") == "paid")


def calibration_profiles(spark, d):
    return M.calibration(M.usage(_calls(spark, d))).withColumns({c: F.round(c, 6) for c in ("mean_in", "mean_out", "mean_pages")})


# Our own sample prices: provider, model, in, out, free, kind, absent since, updated, source.
PRICES = [
    ("paid", "m0", 1.0, 3.0, None, None, None, "2026-01-10", "feed"),
    ("*", "m1", 0.5, None, None, "model", None, "2025-11-02", "feed"),
    ("paid", "Fam 4", 2.0, 6.0, None, None, None, "2026-01-10", "feed"),
    ("paid", "Fam 4.1", 4.0, 8.0, None, "model", None, "2026-01-10", "hand"),
    ("paid", "Fam 5", 9.0, 9.0, None, None, "2025-12-01", "2025-06-30", "hand"),
    ("paid", "Fam 6 pack", 9.0, 9.0, None, "product", None, "2026-01-10", "feed"),
    ("local", "m0", None, None, True, None, None, "2026-01-10", "feed"),
    ("other", "Fam 7", 8.0, 8.0, None, None, None, "2026-01-10", "feed"),
    ("*", "m3", None, None, None, None, None, "2026-01-10", "feed"),
]
_PRICE_DDL = "provider string, model string, in_per_mtok double, out_per_mtok double, free boolean, kind string, absent_since string, updated string, source string"


def _prices(spark):
    return spark.createDataFrame(PRICES, _PRICE_DDL).withColumn("updated", F.col("updated").cast("date"))


def _resolved(spark, d):
    families = spark.createDataFrame([("paid", "m2", "Fam")], "provider string, model string, family string")
    return M.resolve_prices(_calls(spark, d), _prices(spark), families)


def price_resolution(spark, d):
    return _resolved(spark, d)


def run_cost(spark, d):
    rows = M.usage(_calls(spark, d)).join(F.broadcast(_resolved(spark, d)), ["provider", "model"])  # one row a model
    return rows.select("provider", "model", "task", F.round(M.cost(rows.columns), 9).alias("cost"))


def forecast_range(spark, d):
    media = P.dispatch(F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ("txt", "pdf", "jpg", "mp3"))), (F.col("doc_id") % 4 + 1).cast("int"))))["media_type"]
    one = table(spark, d, "documents").agg(*[F.count_if(media == m).alias(m) for m in ("text", "pdf", "image", "audio")])
    low = F.col("text") + F.col("pdf") + 2 * F.col("image") + F.col("audio")
    mean = M.calibration(M.usage(_calls(spark, d))).agg(F.avg("mean_in").alias("i"), F.avg("mean_out").alias("o")).first()  # one row
    price = lambda n: F.round((F.floor(n * mean["i"]) * 1.0 + F.floor(n * mean["o"]) * 3.0) / 1e6, 9)
    return one.select("text", "pdf", "image", "audio", low.alias("calls_low"), (low + F.col("pdf") + F.col("image")).alias("calls_high")).select("*", price(F.col("calls_low")).alias("cost_low"), price(F.col("calls_high")).alias("cost_high"))


def price_staleness(spark, d):
    """Prices of which each has a day of its own and a seller's name for source, some without either."""
    made = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("updated"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("source"))
    return M.staleness(made, F.lit("1998-12-01").cast("date")).withColumn("as_of", F.col("as_of").cast("string"))


# ---- paths, names, sampling ------------------------------------------------

EXTENSIONS = ["txt", "PDF", "tar.gz", "weird", "jpg", "", "mp3", "docx", "v1.txt"]


def _names(spark, d):
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")).alias("name"), "p_name")


def dispatch_types(spark, d):
    return _names(spark, d).select("p_partkey", P.dispatch(F.col("name")).alias("x")).select("p_partkey", "x.media_type", "x.reason")


def ext_top6(spark, d):
    last = F.coalesce(P.suffixes(F.col("name"))[1], F.lit("none"))
    return _names(spark, d).groupBy(last.alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(6)


def stems(spark, d):
    line = F.concat(F.lit("2024-05-06 "), F.substring_index("text", "\n", 1))
    return table(spark, d, "documents").select("doc_id", E.slug(F.substring_index("text", "\n", 1)).alias("slug"), E.strip_leading_date(E.slug(line)).alias("bare"), F.length(E.truncate_stem(E.slug(F.col("text")))).cast("long").alias("cut_length"))


BASES = ["AFRICA", "AFRICA/ALGERIA", "ASIA", "EUROPE/FRANCE"]


def category_normalise(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    paths = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.concat_ws("/", "r_name", "n_name", F.lit("Some Folder"), F.lit("!!"), F.lit("x_y")).alias("path"))
    bases = spark.createDataFrame([(b,) for b in BASES], "base string")
    return P.normalise_category(paths, "path", bases, 4).select("n_nationkey", "base", "category")


def series_route(spark, d):
    o = table(spark, d, "orders")
    year = F.date_format("o_orderdate", "yyyy")
    category = F.when(F.col("o_orderkey") % 2 == 0, "Home/Bills").otherwise("Home/Bills/Water")
    return o.select("o_orderkey", P.series_route(category, F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"), year, F.lit(2)).alias("route"))


def date_ladder(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-M-d")).when(F.col("o_orderkey") % 3 == 1, "2024-02-31").otherwise("n/a")
    modified = F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate") + F.lit(1))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(E.day(text), modified, F.lit("2026-01-01").cast("date")).cast("string").alias("day"))


def nesting_collapse(spark, d):
    path = F.concat_ws("/", "lang", "lang", "source", F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("x"))
    return table(spark, d, "documents").select(path.alias("p")).select(P.collapse_nesting(F.col("p")).alias("path"), "p").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("n_origins"))


def work_sets_limited(spark, d):
    sets = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.min("doc_id").alias("ord"))
    return G.limited_sets(sets, 300).select("source", "n_files", "used")


def transcript_budget(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return G.within_budget(rows, ["conv_id"], ["turn"], F.length("text") + 1, 600).select("conv_id", "turn", E.clock(F.col("used")).alias("at"))


def sibling_hints(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", E.slug(F.substring_index("text", "\n", 1)).alias("name"))
    return G.within_budget(rows, ["source"], ["doc_id"], F.length("name"), 400, 12).select("source", "doc_id", "name")


def frame_plan(spark, d):
    passage = lambda a, b: E.midpoint((F.col("p_size") * a).cast("double"), (F.col("p_size") * a + b).cast("double"))
    plan = G.frame_plan(((F.col("p_size") - 1) * 37).cast("double"), F.array(passage(20, 7), passage(9, 0), passage(60, 1)))
    return table(spark, d, "part").select("p_partkey", plan.alias("plan")).select("p_partkey", F.size("plan").cast("long").alias("n_frames"), F.array_join(F.transform("plan", lambda x: (x * 1000).cast("long").cast("string")), ",").alias("at_ms"))


def distinct_frames(spark, d):
    # 64 cells make a hash; the frames of a film are 64 neighbours, so that no group grows with the table
    cells = F.transform(F.slice("embedding", 1, 64), lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("film"), "vec_id", E.hash_bits(cells).alias("h"))
    by = rows.groupBy("film").agg(F.array_sort(F.collect_list(F.struct("vec_id", "h"))).alias("r"))
    # by the rule's 8 bits, and by 24: hashes of vectors made at random lie some 32 bits apart, so few are nearer than 8
    hashes = F.transform("r", lambda x: x["h"])
    kept = E.let(hashes, lambda h: G.distinct_hashes(h))
    apart = E.let(hashes, lambda h: G.distinct_hashes(h, 24))
    return by.select("film", F.size("r").cast("long").alias("n_frames"), F.size(kept).cast("long").alias("n_kept"), F.size(apart).cast("long").alias("n_apart"))


ROOTS = [("inbox", "/data/in"), ("library", "/data"), ("mirror", "/backup"), ("queue", "/data/in"), ("trash", "/backups")]


#: Folders that clash: a path a document, some at one place, some a level below another document's, some null.
_ROOTS = {
    "name": "lpad(CAST(doc_id AS STRING), 9, '0')",
    "path": "CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '/r' || doc_id || '/' WHEN 4 THEN '/r' || (doc_id - 3) WHEN 2 THEN '/r' || (doc_id - 1) || '/' || source || '/x' WHEN 3 THEN ' /r' || (doc_id - 2) || '/' || source ELSE '/r' || doc_id || '/' || lang END",
}


def layout_conflicts(spark, d):
    """Roots that a settings table names, of which some lie in others."""
    made = table(spark, d, "documents").selectExpr(*[f"{e} AS {n}" for n, e in _ROOTS.items()])
    return I.layout_conflicts(made)


def media_tag_diff(spark, d):
    p = table(spark, d, "part")
    first = p.groupBy("p_brand").agg(F.min_by(F.struct("p_type", "p_size", "p_name"), "p_partkey").alias("f"))
    differs = lambda c: F.count_if(~F.col(c).eqNullSafe(F.col(f"f.{c}"))).alias(f"n_{c}")
    return p.join(first, "p_brand").groupBy("p_brand").agg(*map(differs, ("p_type", "p_size", "p_name")))


def weekly_activity(spark, d):
    """The streaming tail's windowed counts, over the stored events."""
    e = _events(spark, d).groupBy(F.window("event_time", "7 days").alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "action", "n")


def chunks_of_80(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, d, "documents").select("source", F.floor((F.row_number().over(w) - 1) / 80).alias("chunk"))
    return rows.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))


_E = "SELECT event_id AS seq, ts AS event_time, user_id AS run_id, event_type AS action, value, props, user_id || ':' || event_type AS operation_id FROM events"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_C = f"SELECT CASE WHEN run_id % 3 = 0 THEN 'local' ELSE 'paid' END AS provider, 'm' || (run_id % 4) AS model, action AS task, {_K} AS tokens_in, {_K} % 7 AS tokens_out, {_K} % 5 - 1 AS pages, CASE WHEN {_K} % 3 = 0 THEN {_K} END AS audio_seconds, value >= 1 AS measured FROM ({_E})"
_U = f"SELECT provider, model, task, count(*)::BIGINT AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, coalesce(sum(pages) FILTER (pages > 0), 0)::BIGINT AS pages, coalesce(sum(audio_seconds) FILTER (audio_seconds > 0), 0)::BIGINT AS audio_seconds, sum((NOT measured)::INT)::BIGINT AS unmeasured FROM ({_C}) GROUP BY ALL"
_CAL = f"SELECT task, sum(calls - unmeasured)::BIGINT AS measured, sum(tokens_in) / sum(calls - unmeasured) AS mean_in, sum(tokens_out) / sum(calls - unmeasured) AS mean_out, sum(pages) / sum(calls - unmeasured) AS mean_pages FROM ({_U}) GROUP BY task HAVING sum(calls - unmeasured) >= 4"
_sql = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else repr(v)
_P = "SELECT * REPLACE (in_per_mtok::DOUBLE AS in_per_mtok, out_per_mtok::DOUBLE AS out_per_mtok) FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in PRICES) + ") AS t(provider, model, in_per_mtok, out_per_mtok, free, kind, absent_since, updated, source)"
_R = f"""SELECT w.provider, w.model, min_by(p.in_per_mtok, p.o) FILTER (p.o IS NOT NULL) AS in_per_mtok, arg_min_null(p.out_per_mtok, p.o) AS out_per_mtok, arg_min_null(p.free, p.o) AS free, min(p.o)::INT AS priority
    FROM (SELECT DISTINCT provider, model FROM ({_C})) w LEFT JOIN (SELECT w2.provider AS wp, w2.model AS wm, x.*, CASE WHEN x.model = w2.model AND x.provider = w2.provider THEN 0 WHEN x.model = w2.model THEN 1 WHEN x.provider = w2.provider THEN 2 ELSE 3 END AS o
    FROM (SELECT DISTINCT provider, model FROM ({_C})) w2, ({_P}) x WHERE coalesce(x.kind, 'model') = 'model' AND x.provider IN (w2.provider, '*') AND (x.model = w2.model OR (w2.provider = 'paid' AND w2.model = 'm2' AND x.model = 'Fam 4.1'))) p ON p.wp = w.provider AND p.wm = w.model GROUP BY 1, 2"""
_R = _R.replace("min_by(p.in_per_mtok, p.o) FILTER (p.o IS NOT NULL)", "arg_min_null(p.in_per_mtok, p.o)")
_EXT = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{'.' + x if x else ''}'" for i, x in enumerate(EXTENSIONS)) + " END"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents({x}), 'ß', ''), '[^A-Za-z0-9_]+', '-', 'g'), '[-_]*_[-_]*', '_', 'g'), '^[-_]+|[-_]+$', '', 'g'), ''), 'file')"
_slug = lambda x: _SLUG.replace("{x}", x)
_TS = f"SELECT doc_id, {_slug('text')} AS s FROM documents"

QUERIES = {f.__name__: f for f in (runs_list, latest_run_id, latest_event_per_op, undo_plan, deleted_history, event_tallies, queue_origins, flow_validate, usage_by_task, usage_totals, calibration_profiles, price_resolution, run_cost, forecast_range, price_staleness, dispatch_types, ext_top6, stems, category_normalise, series_route, date_ladder, nesting_collapse, work_sets_limited, transcript_budget, sibling_hints, frame_plan, distinct_frames, layout_conflicts, media_tag_diff, weekly_activity, chunks_of_80)}
ORACLES = {
    "runs_list": f"SELECT run_id, strftime(arg_min(event_time, seq), '%Y-%m-%d %H:%M:%S') AS first_time, sum((action = 'purchase')::INT)::BIGINT AS n_filed, min(seq) AS first_seq FROM ({_E}) GROUP BY run_id ORDER BY first_seq DESC LIMIT 10",
    "latest_run_id": f"SELECT arg_max(run_id, seq) AS run_id FROM ({_E})",
    "latest_event_per_op": f"SELECT operation_id, arg_max(value, seq) AS value, max(seq) AS last_seq FROM ({_E}) GROUP BY 1",
    "undo_plan": f"""WITH e AS (SELECT seq, run_id, action, action || '/' || run_id || '/' || (seq % 7) AS path FROM ({_E})), p AS (SELECT * FROM e WHERE action IN ('purchase', 'click')),
    l AS (SELECT run_id AS operation_id, arg_max(path, seq) AS path FROM p GROUP BY 1), o AS (SELECT run_id AS operation_id, 'inbox/' || min(seq) AS origin, min(seq) % 3 != 0 AS inb FROM e WHERE action = 'signup' GROUP BY 1)
    SELECT l.operation_id, path, origin, CASE WHEN origin IS NULL THEN 'no_origin' WHEN NOT inb THEN 'origin_outside_inbox' WHEN path NOT IN (SELECT path FROM p WHERE seq % 2 = 0) THEN 'unknown_to_catalog' ELSE 'restorable' END AS state FROM l LEFT JOIN o ON l.operation_id = o.operation_id""",
    "deleted_history": f"SELECT seq, run_id, value FROM ({_E}) WHERE action = 'error' ORDER BY seq DESC LIMIT 50",
    "event_tallies": f"SELECT run_id, " + ", ".join(f"sum((action = '{a}')::INT)::BIGINT AS n_{a}" for a in ("view", "click", "purchase", "error", "signup")) + f", sum({_K})::BIGINT AS sum_k FROM ({_E}) GROUP BY run_id",
    "queue_origins": f"SELECT run_id, arg_max(props, seq) AS props, max(seq) AS last_seq FROM ({_E}) WHERE action = 'view' GROUP BY 1",
    "flow_validate": f"WITH s AS (SELECT lag(action) OVER (PARTITION BY run_id ORDER BY seq) AS from_state, action AS to_state FROM ({_E})) SELECT from_state, to_state, (from_state || '>' || to_state) IN ({', '.join(repr(a + '>' + b) for a, b in LEGAL)}) AS is_legal, count(*)::BIGINT AS n FROM s WHERE from_state IS NOT NULL GROUP BY ALL",
    "usage_by_task": _U,
    "usage_totals": f"SELECT sum(calls)::BIGINT AS calls, sum(calls) FILTER (provider = 'paid')::BIGINT AS billed_calls, sum(calls) FILTER (provider != 'paid')::BIGINT AS local_calls, sum(tokens_in) FILTER (provider = 'paid')::BIGINT AS billed_in, sum(tokens_out) FILTER (provider = 'paid')::BIGINT AS billed_out FROM ({_U})",
    "calibration_profiles": f"SELECT task, measured, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out, round(mean_pages, 6) AS mean_pages FROM ({_CAL})",
    "price_resolution": _R,
    "run_cost": f"SELECT u.provider, u.model, task, round(CASE WHEN coalesce(free, false) THEN 0.0 WHEN in_per_mtok IS NULL AND out_per_mtok IS NULL THEN NULL ELSE coalesce(tokens_in / 1e6 * in_per_mtok, 0) + coalesce(tokens_out / 1e6 * out_per_mtok, 0) END, 9)::DOUBLE AS cost FROM ({_U}) u JOIN ({_R}) r ON u.provider = r.provider AND u.model = r.model",
    "forecast_range": f"WITH c AS (SELECT sum((doc_id % 4 = 0)::INT)::BIGINT AS text, sum((doc_id % 4 = 1)::INT)::BIGINT AS pdf, sum((doc_id % 4 = 2)::INT)::BIGINT AS image, sum((doc_id % 4 = 3)::INT)::BIGINT AS audio FROM documents), r AS (SELECT *, text + pdf + 2 * image + audio AS calls_low, text + 2 * pdf + 3 * image + audio AS calls_high FROM c), m AS (SELECT avg(mean_in) AS i, avg(mean_out) AS o FROM ({_CAL})) SELECT text, pdf, image, audio, calls_low, calls_high, round((floor(calls_low * i) + floor(calls_low * o) * 3.0) / 1e6, 9) AS cost_low, round((floor(calls_high * i) + floor(calls_high * o) * 3.0) / 1e6, 9) AS cost_high FROM r, m",
    "price_staleness": "WITH p AS (SELECT CASE WHEN o_orderkey % 5 != 0 THEN o_orderdate::DATE END AS updated, CASE WHEN o_orderkey % 7 != 0 THEN o_orderpriority END AS source FROM orders) SELECT max(date_diff('day', updated, DATE '1998-12-01'))::BIGINT AS age_days, min(updated)::VARCHAR AS as_of, max(date_diff('day', updated, DATE '1998-12-01')) > 180 AS is_stale, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM p",
    "dispatch_types": "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'archive' WHEN 4 THEN 'image' WHEN 6 THEN 'audio' WHEN 7 THEN 'text' WHEN 8 THEN 'text' ELSE 'unknown' END AS media_type, CASE p_partkey % 9 WHEN 3 THEN 'unknown_extension' WHEN 5 THEN 'no_extension' ELSE 'known' END AS reason FROM part",
    "ext_top6": "SELECT CASE p_partkey % 9 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'gz' WHEN 3 THEN 'weird' WHEN 4 THEN 'jpg' WHEN 5 THEN 'none' WHEN 6 THEN 'mp3' WHEN 7 THEN 'docx' ELSE 'txt' END AS ext, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, ext LIMIT 6",
    "stems": f"""WITH t AS (SELECT doc_id, {_slug("split_part(text, chr(10), 1)")} AS slug, {_slug("'2024-05-06 ' || split_part(text, chr(10), 1)")} AS l, {_slug('text')} AS s FROM documents)
    SELECT doc_id, slug, CASE WHEN regexp_replace(l, '^\\d{{4}}-\\d{{2}}(-\\d{{2}})?[-_]+', '') = '' THEN l ELSE regexp_replace(l, '^\\d{{4}}-\\d{{2}}(-\\d{{2}})?[-_]+', '') END AS bare,
    CASE WHEN length(s) <= 180 THEN length(s) WHEN greatest(180 - CASE WHEN strpos(reverse(s[1:180]), '-') = 0 THEN 999 ELSE strpos(reverse(s[1:180]), '-') END, 180 - CASE WHEN strpos(reverse(s[1:180]), '_') = 0 THEN 999 ELSE strpos(reverse(s[1:180]), '_') END) >= 135
    THEN greatest(180 - CASE WHEN strpos(reverse(s[1:180]), '-') = 0 THEN 999 ELSE strpos(reverse(s[1:180]), '-') END, 180 - CASE WHEN strpos(reverse(s[1:180]), '_') = 0 THEN 999 ELSE strpos(reverse(s[1:180]), '_') END) ELSE 180 END::BIGINT AS cut_length FROM t""",
    "category_normalise": "WITH p AS (SELECT n_nationkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_nationkey, CASE WHEN r_name = 'AFRICA' AND n_name = 'ALGERIA' THEN 'AFRICA/ALGERIA' WHEN r_name IN ('AFRICA', 'ASIA') THEN r_name WHEN r_name = 'EUROPE' AND n_name = 'FRANCE' THEN 'EUROPE/FRANCE' END AS base, CASE WHEN r_name IN ('AFRICA', 'ASIA') OR (r_name = 'EUROPE' AND n_name = 'FRANCE') THEN r_name || '/' || replace(n_name, ' ', '-') || '/Some-Folder/file' END AS category FROM p",
    "series_route": "WITH o AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS s, o_orderkey % 2 = 0 AS bare, regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9_]+', '-', 'g'), '^-|-$', '', 'g') AS i, strftime(o_orderdate, '%Y') AS y FROM orders) SELECT o_orderkey, 'Home/Bills' || CASE WHEN bare THEN '' ELSE '/Water' END || CASE WHEN s THEN CASE WHEN bare THEN '/' || i ELSE '' END || '/' || y ELSE '' END AS route FROM o",
    "date_ladder": "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END, CASE WHEN o_orderkey % 5 != 0 THEN o_orderdate::DATE + 1 END, DATE '2026-01-01')::VARCHAR AS day FROM orders",
    "nesting_collapse": "SELECT lang || '/' || source || '/x' AS path, count(*)::BIGINT AS n, count(DISTINCT doc_id % 2)::BIGINT AS n_origins FROM documents GROUP BY 1",
    "work_sets_limited": "WITH s AS (SELECT source, count(*)::BIGINT AS n_files, min(doc_id) AS ord FROM documents GROUP BY 1), u AS (SELECT *, sum(n_files) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (ORDER BY ord) AS r FROM s) SELECT source, n_files, used FROM u WHERE r = 1 OR used <= 300",
    "transcript_budget": "WITH c AS (SELECT conv_id, turn, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) SELECT conv_id, turn, lpad((used // 60)::VARCHAR, 2, '0') || ':' || lpad((used % 60)::VARCHAR, 2, '0') AS at FROM c WHERE used <= 600",
    "sibling_hints": f"WITH n AS (SELECT doc_id, source, {_slug('split_part(text, chr(10), 1)')} AS name FROM documents), u AS (SELECT *, sum(length(name)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM n) SELECT source, doc_id, name FROM u WHERE used <= 400 AND r <= 12",
    "frame_plan": """WITH p AS (SELECT p_partkey, (p_size - 1) * 37.0::DOUBLE AS d, p_size AS s FROM part), b AS (SELECT *, CASE WHEN d <= 0 THEN 0 WHEN d < 30 THEN 3 WHEN d < 120 THEN 4 WHEN d < 300 THEN 5 WHEN d < 900 THEN 7 WHEN d < 1800 THEN 9 ELSE 12 END AS n FROM p),
    c AS (SELECT *, greatest(0.4, d / nullif(n, 0) / 2) AS gap, list_concat([[round(least(1.0, 0.05 * d), 3)]], list_transform(list_concat([round(least(greatest(d - 1.5, 0.95 * d), greatest(d - 0.05, 0.0)), 3), s * 20 + 3.5, s * 9.0, s * 60 + 0.5], list_transform(range(1, n + 1), lambda i: round_even(d * i / (n + 1), 3))), lambda x: [x])) AS w FROM b),
    t AS (SELECT p_partkey, CASE WHEN n = 0 THEN [] ELSE list_sort(list_reduce(w, lambda acc, x: CASE WHEN len(acc) < n AND x[1] BETWEEN 0 AND d AND len(list_filter(acc, lambda y: abs(y - x[1]) < gap)) = 0 THEN list_concat(acc, x) ELSE acc END)) END AS plan FROM c)
    SELECT p_partkey, len(plan)::BIGINT AS n_frames, array_to_string(list_transform(plan, lambda x: trunc(x * 1000)::BIGINT::VARCHAR), ',') AS at_ms FROM t""",
    "distinct_frames": """WITH e AS (SELECT vec_id // 64 AS film, vec_id, list_transform(embedding[1:64], lambda x: x::DOUBLE) AS c FROM embeddings), m AS (SELECT *, list_sum(c) / len(c) AS mean FROM e),
    h AS (SELECT film, vec_id, array_to_string(list_transform(c, lambda x: CASE WHEN x > mean THEN '1' ELSE '0' END), '') AS bits FROM m), g AS (SELECT film, list([bits] ORDER BY vec_id) AS w FROM h GROUP BY 1)
    SELECT film, len(w)::BIGINT AS n_frames, len(list_reduce(w, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: hamming(y, x[1]) < 8)) = 0 THEN list_concat(acc, x) ELSE acc END))::BIGINT AS n_kept, len(list_reduce(w, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: hamming(y, x[1]) < 24)) = 0 THEN list_concat(acc, x) ELSE acc END))::BIGINT AS n_apart FROM g""",
    "layout_conflicts": "WITH r AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ROOTS.items()) + " FROM documents), u AS (SELECT name, rtrim(trim(path), '/') AS path, string_split(rtrim(trim(path), '/'), '/') AS q FROM r WHERE path IS NOT NULL), a AS (SELECT name AS x, path AS own, unnest(list_transform(range(1, len(q) + 1), lambda k: array_to_string(q[1:k], '/'))) AS path FROM u) SELECT least(x, name) AS name_a, greatest(x, name) AS name_b, CASE WHEN own = a.path THEN 'equal' ELSE 'contained' END AS kind FROM a JOIN u ON a.path = u.path WHERE x != name AND (own != a.path OR x < name)",
    "media_tag_diff": "WITH f AS (SELECT p_brand, arg_min(p_type, p_partkey) AS t, arg_min(p_size, p_partkey) AS c, arg_min(p_name, p_partkey) AS m FROM part GROUP BY 1) SELECT p.p_brand, sum((p_type != t)::INT)::BIGINT AS n_p_type, sum((p_size != c)::INT)::BIGINT AS n_p_size, sum((p_name != m)::INT)::BIGINT AS n_p_name FROM part p JOIN f ON p.p_brand = f.p_brand GROUP BY 1",
    "weekly_activity": f"SELECT strftime(to_timestamp(floor(epoch(event_time) / 604800) * 604800) AT TIME ZONE 'UTC', '%Y-%m-%d') AS week, action, count(*)::BIGINT AS n FROM ({_E}) GROUP BY 1, 2",
    "chunks_of_80": "WITH r AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 80 AS chunk FROM documents) SELECT source, chunk::BIGINT AS chunk, count(*)::BIGINT AS n FROM r GROUP BY 1, 2",
}
