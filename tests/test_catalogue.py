"""Every catalogue query against its DuckDB oracle, and the operators' own scenarios."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import catalogue
from quarry.functions import exprs as E
from quarry.functions import paths as P
from quarry.operators import catalog as C
from quarry.operators import metering as M
from quarry.operators import sampling as G
from quarry.sources import readers as R

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


# disk (path, hash), rows (id, path, hash, status) -> actions
RESCAN = [
    ([("a", "h")], [(1, "a", "h", "S")], []),
    ([("b", "h")], [(1, "a", "h", "S")], ["moved"]),
    ([("x/a", "h"), ("x/b", "g")], [(1, "y/a", "h", "S"), (2, "y/b", "g", "S")], ["moved", "moved"]),
    ([("a", "z")], [], ["new"]),
    ([("a", "h"), ("b", "h")], [(1, "a", "h", "S")], ["duplicate"]),
    ([], [(1, "a", "h", "S")], ["deleted"]),
    ([("a", "h")], [(1, "", "h", "DELETED")], ["readded"]),
    ([("b", "h"), ("c", "h")], [(1, "a", "h", "S")], ["duplicate", "moved"]),
]


@pytest.mark.parametrize("disk,known,expected", RESCAN)
def test_rescan(spark, disk, known, expected):
    d = spark.createDataFrame(disk, "path string, sha256 string")
    k = spark.createDataFrame([(i, p, h, "DELETED" if s == "DELETED" else C.STORED, i) for i, p, h, s in known], "doc_id bigint, path string, sha256 string, status string, ord bigint")
    none = spark.createDataFrame([], "path string")
    assert sorted(r.action for r in C.rescan_plan(d, k, none).collect()) == expected


def test_preserved_row_is_not_deleted(spark):
    k = spark.createDataFrame([(1, "keep/a", "h", C.STORED, 1)], "doc_id bigint, path string, sha256 string, status string, ord bigint")
    plan = C.rescan_plan(spark.createDataFrame([], "path string, sha256 string"), k, spark.createDataFrame([("keep/a",)], "path string"))
    assert plan.count() == 0


def test_distinct_hashes(spark):
    cases = [([5, 5, 5, 5], [0]), ([0, (1 << 20) - 1, 0], [0, 1]), ([0, 7, (1 << 20) - 1], [0, 2]), ([0, None, 0], [0, 1]), ([], [])]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h array<bigint>").orderBy("i")
    assert [r[0] for r in df.select(G.distinct_hashes(df.h)).collect()] == [k for _, k in cases]


def test_frame_plan(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (100.0,)], "d double")
    got = [r[0] for r in df.select(G.frame_plan(df.d, None if False else E.F.lit(None).cast("array<double>"))).collect()]
    assert got[0] == [] and len(got[1]) <= 3 and got[2] == sorted(got[2]) and got[2][0] == 1.0


def test_names(spark):
    words = ["Étude  du_plan!", "2024-05-06 bill", "---", "œuvre", "2024-05"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(E.slug(df.w)).collect()] == ["Etude-du_plan", "2024-05-06-bill", "file", "uvre", "2024-05"]
    assert [r[0] for r in df.select(E.safe_stem(df.w)).collect()][1] == "bill"


def test_units_and_costs(spark):
    bodies = [json.dumps({"usage": {"prompt_tokens": 5, "input_tokens": 2, "completion_tokens": 3}, "prompt_eval_count": 1}), json.dumps({"usage_info": {"pages_processed": 4}}), "{}", "broken", None]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [r[0] for r in df.select(M.extract_units(df.b)).collect()]
    assert [(g.tokens_in, g.tokens_out, g.pages, g.measured) for g in got] == [(8, 3, 0, True), (0, 0, 4, True), (0, 0, 0, False), (0, 0, 0, False), (0, 0, 0, False)]


def test_noisy_json(spark):
    df = spark.createDataFrame([(t,) for t in ('{"a":1}', 'so:\n```json\n{"a":2}\n```', 'x {"a":3} y', "none")], "t string")
    assert [r[0] for r in df.select(E.json_object(df.t)).collect()] == ['{"a":1}', '{"a":2}', '{"a":3}', None]


def test_sources(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"event_id":"1","action":"a","run_id":"r"}\n\n[1]\n{"event_id": "2", broken\n{"event_id":"3"}\n')
    assert sorted(r.event_id for r in R.read_events(spark, str(log)).collect()) == ["1", "3"]
    (tmp_path / "p.json").write_text(json.dumps({"schema_version": 1, "currency": "EUR", "updated": "2026-01-01", "source": "s", "models": {"m": {"in_per_mtok": 1.5}}}))
    assert [(r.provider, r.model, r.in_per_mtok) for r in R.read_prices(spark, str(tmp_path / "p.json")).collect()] == [("*", "m", 1.5)]
    root = tmp_path / "lib"
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "x").write_text("1")
    (root / "_a.txt").write_text("22")
    assert sorted((r.path, r.size, r.is_hidden) for r in R.inventory(spark, str(root)).collect()) == [(".git/x", 1, True), ("_a.txt", 2, False)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]


def test_values_of_the_exact_rules(spark):
    one = lambda **c: spark.range(1).select(*[x.alias(n) for n, x in c.items()]).first()
    lit = F.lit
    r = one(
        slug=E.slug(lit("Œuvre ﬁn ő ž ł č ş straße™")), fold=E.fold(lit("ŐŽČ é é")), date=E.strip_leading_date(lit("2024-05 x")), cut=E.truncate_stem(lit("-" * 181)),
        a=E.release(lit("1.2")), b=E.release(lit("0.12.0.dev4+g1a")), c=E.release(lit("v1.2.3")), budget=E.frame_budget(lit(0.0)),
        json=E.json_object(lit('x {"a":1} y {"b":2}')), vision=P.vision_readable(lit(".JPG")), kind=P.dispatch(lit("a.docx"))["media_type"], csv=P.dispatch(lit("a.csv"))["media_type"],
    )
    assert r["slug"] == "uvre-fin-o-z-c-s-straeTM" and r["fold"] == "ozc e e" and r["date"] == "2024-05 x" and r["cut"] == "file"
    assert r["a"] is None and list(r["b"]) == [0, 12, 0] and r["c"] is None and r["budget"] == 0 and r["json"] == '{"a":1}'
    assert r["vision"] and r["kind"] == "text" and r["csv"] == "office"
    plan = spark.createDataFrame([(100.0, [33.33333])], "d double, h array<double>").select(G.frame_plan(F.col("d"), F.col("h")).alias("p")).first()["p"]
    assert 33.333 in plan and all(round(x, 3) == x for x in plan)


def test_walks_with_hard_cases(spark):
    from quarry.operators import inventory as I

    files = spark.createDataFrame(
        [("a.txt", 1, 5.0, False), ("x/.git", 1, 5.0, False), ("x/y/b.txt", 1, 5.0, False), ("xx/c.txt", 1, 5.0, False), ("Media/m.txt", 1, 5.0, False), ("Media2/m.txt", 3_000_000, 5.0, False), ("z/.h/q", 1, 5.0, False), ("l", 1, 5.0, True)],
        "path string, size bigint, mtime double, is_symlink boolean",
    )
    assert [r.path for r in I.library_files(files).collect()] == ["Media2/m.txt", "a.txt", "xx/c.txt"]
    assert [r.path for r in I.indexable_files(files).collect()] == ["Media/m.txt", "x/y/b.txt"]
    assert [r.root for r in I.repository_roots(files).collect()] == ["x"]
    none = files.limit(0)
    assert I.library_files(none).count() == I.work_sets(none).count() == I.category_paths(none).count() == 0
    worktree = files.union(spark.createDataFrame([(".git", 1, 5.0, False)], files.schema))
    assert [r.root for r in I.repository_roots(worktree).collect()] == ["", "x"] and I.library_files(worktree).count() == 0


def test_records_with_hard_cases(spark):
    from quarry.operators import records as R

    lines = R.snapshot(spark.createDataFrame([(1, "p", "t1", '{"name": "n"}', None, None), (2, None, "t2", "bad", "x", "y")], "doc_id bigint, current_path string, updated_at_utc string, content_json string, pending_decision string, last_verified_utc string"), "/r", "now", "db")
    whole = json.loads("".join(r.value for r in lines.collect()))
    assert [d["doc_id"] for d in whole["documents"]] == [2, 1] and whole["documents"][1]["content"] == {"name": "n"} and whole["meta"]["documents_count"] == 2
    empty = json.loads("".join(r.value for r in R.snapshot(lines.select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("").alias("updated_at_utc"), F.lit("").alias("content_json")).limit(0), "/r", "now", "db").collect()))
    assert empty["documents"] == []
    rows = spark.createDataFrame([("a", "live", None), ("a", "live", None)], "sha256 string, status string, x string")
    files = spark.createDataFrame([(1, "d/f.txt", "a"), (2, "g.weird", "b"), (3, "h.pdf", "c"), (4, "h.pdf", "c"), (5, "", "d")], "ord int, path string, sha256 string")
    assert tuple(R.dry_run(files, rows).first()) == (5, 2, 2, 1)


def test_prices_are_of_the_sellers_own_family(spark):
    prices = spark.createDataFrame([("a", "Fam 4", None, None), ("b", "Fam 5", None, None)], "provider string, model string, kind string, absent_since string")
    families = spark.createDataFrame([("a", "m", "Fam"), ("c", "m", "Fam")], "provider string, model string, family string")
    assert [tuple(r) for r in M.newest_of_family(prices, families).collect()] == [("a", "m", "Fam 4")]
    units = spark.createDataFrame([(1_000_000, 0, 2000, 90, 1.0, 2.0, 3.0, 4.0, False)], "tokens_in bigint, tokens_out bigint, pages bigint, audio_seconds bigint, in_per_mtok double, out_per_mtok double, per_1k_pages double, per_audio_minute double, free boolean")
    assert units.select(M.cost(units.columns).alias("c")).first()["c"] == 1.0 + 6.0 + 6.0


def test_entry_tells_what_is_missing():
    import __spark_entry__ as entry

    assert entry._optional("quarry.no_such_part") is None and entry._optional("no_such.part") is None
    assert entry._optional("json") is json
