"""Plans applied and provider chains against sequential replays."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import applied as A
from quarry.operators.chains import through_chain
from quarry.operators.staged import Table

from .test_moves import loop

SCHEMA = "doc_id bigint, sha256 string, current_filename string, current_path string, status string, updated_at_utc string, flow_state string, pending_decision string, content_json string, last_verified_utc string"


def replay(rows, changes):
    """(rows, counters) one change after the other; placing comes last, in order of the last placing change."""
    live, count, placed, category = {r[0]: dict(zip(A.ROW, r)) for r in rows}, Counter(), {}, {}
    for seq, doc_id, kind, target, at in sorted(changes):
        r = live.get(doc_id)

        def refused():
            if r is None:
                return "unknown_to_catalog"
            if kind == "resolve":
                return "not_pending" if r["status"] != "DECISION_PENDING" else "invalid_path" if target is None else None
            if kind == "trash":
                if not (r["current_path"] or "").startswith("lib/"):
                    return "outside_library"
                return None if (r["flow_state"] or "LIBRARY_STORED") in ("LIBRARY_STORED", "USER_CONFIRMATION_REQUIRED") else "illegal_transition"
            if kind == "undo":
                return None if r["current_path"] == target else "unknown_to_catalog"
            if kind == "delete":
                return "already_deleted" if r["status"] == "DELETED" else None
            return ("not_stored" if r["status"] != "LIBRARY_STORED" else None) if kind == "verify" else "unknown_kind"

        why = refused()
        count[kind, why or "applied"] += 1
        if why:
            continue
        if kind == "undo":
            del live[doc_id]
            placed.pop(doc_id, None)
        elif kind == "verify":
            r["last_verified_utc"] = at
        else:
            r["updated_at_utc"], r["pending_decision"] = at, None
            if kind == "delete":
                r.update(current_filename="", current_path="", status="DELETED", flow_state=None, content_json=None)
                placed.pop(doc_id, None), category.pop(doc_id, None)
            else:
                placed[doc_id] = seq
                state = "LIBRARY_STORED" if kind == "resolve" else "LIBRARY_TRASHED"
                r.update(status=state, flow_state=state)
                r["current_path"] = f"lib/{target}/{r['current_filename']}" if kind == "resolve" else "trash" + r["current_path"][3:]
                if kind == "resolve":
                    category[doc_id] = target
    names = loop([(s, live[i]["current_path"]) for i, s in placed.items()], [r["current_path"] for i, r in live.items() if i not in placed and r["current_path"]])
    for i, s in placed.items():
        live[i]["current_path"], live[i]["current_filename"] = names[s], names[s].split("/")[-1]
    for i, c in category.items():
        if i in live and live[i]["content_json"] is not None:
            try:
                fiche = json.loads(live[i]["content_json"])
            except ValueError:
                continue
            if isinstance(fiche, dict):
                live[i]["content_json"] = json.dumps(fiche | {"category_path": c})
    return {i: tuple(r.values()) for i, r in live.items()}, count


def test_changes_are_a_replay(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        name = rng.choice(["a.txt", "b.txt", "b__1.txt"])
        status = rng.choice(["LIBRARY_STORED", "DECISION_PENDING", "DELETED", "LIBRARY_TRASHED"])
        path = rng.choice([f"lib/x/{name}", f"lib/y/{name}", f"old/{name}", "" if status == "DELETED" else f"lib/z{i}/{name}", None])
        rows.append((i, f"h{i % 7}" if i % 11 else None, name, path, status, "t", rng.choice([None, "LIBRARY_STORED", "ROUTE_CONFIRMED", status]), rng.choice([None, "{}"]), rng.choice([None, '{"name": "é", "k": [1, {"z": null}]}', "no json", "[1]"]), None))
    kinds = ["resolve", "trash", "undo", "delete", "verify", "odd"]
    changes = []
    for s in range(400):
        i = rng.randrange(130)
        kind = rng.choice(kinds)
        path = rows[i][3] if i < 120 and rng.random() < 0.5 else "lib/x/a.txt"
        changes.append((s, i, kind, path if kind == "undo" else rng.choice([None, "Work/A", "x", "y"]), f"at{s}"))
    table = Table(spark, f"file://{tmp_path}/catalogue")
    assert table.read() is None
    table.write(spark.createDataFrame(rows, SCHEMA))
    new, outcomes = A.changed(table.read(), spark.createDataFrame(changes, "seq bigint, doc_id bigint, kind string, target string, at string").repartition(5), "lib", "trash")
    table.write(new)
    want, count = replay(rows, changes)
    assert {r.doc_id: tuple(r) for r in table.read().collect()} == want
    assert {(r.kind, r.outcome): r.n for r in A.counters(outcomes).collect()} == count and len(count) > 9
    assert table.manifests.last()["version"] == 2


def test_chain(spark, tmp_path):
    """Three tasks that each fail on some rows, with the calls that each row costs."""
    rows = spark.range(60).selectExpr("id AS doc_id", "CAST(id AS STRING) AS x")
    told = lambda df, ok, name: df.select("doc_id", F.when(~ok, F.concat(F.lit(f"{name}:"), "attempt")).alias("error"), F.concat(F.lit(name), "x").alias("name"))
    first = lambda df: told(df, (F.col("doc_id") % 3 == 0) & (F.col("attempt") >= F.col("doc_id") % 2), "a").filter("doc_id % 10 != 0")
    second = lambda df: told(df, F.col("doc_id") % 4 == 0, "b")
    third = lambda df: told(df, (F.col("doc_id") % 5 == 0) & (F.col("attempt") == 1), "c")
    fallback = {"name": F.concat(F.lit("file"), "x")}
    got = {r.doc_id: r for r in through_chain(rows, [("p", "m1", first), ("p", "m2", second), ("q", "m3", third)], fallback, 1).collect()}
    assert len(got) == 60
    for i, r in got.items():
        if i % 3 == 0 and i % 10:
            want = (f"a{i}", "p", "m1", False, None, 1 + i % 2)
        elif i % 4 == 0:
            want = (f"b{i}", "p", "m2", False, None, 3)
        elif i % 5 == 0:
            want = (f"c{i}", "q", "m3", False, None, 6)
        else:
            want = (f"file{i}", "fallback", "fallback", True, "c:1", 6)
        assert (r.name, r.provider, r.model, r.used_fallback, r.reason, r.calls) == want
    none = through_chain(rows, [], fallback).first()
    assert (none.name, none.reason, none.calls, none.used_fallback) == (f"file{none.doc_id}", "no_provider", 0, True)
    silent = through_chain(rows.limit(2), [("p", "m", lambda df: first(df).filter("false"))], fallback, 0).first()
    assert (silent.reason, silent.calls) == ("no_answer", 1)
    assert through_chain(rows.limit(0), [("p", "m", first)], fallback).count() == 0


@pytest.mark.parametrize("text,ok", [("2024-3-5", True), ("24-3-5", False), ("12024-3-5", False), ("2024-03-05", True), ("2024-13-05", False), ("x", False)])
def test_day_has_four_digits(spark, text, ok):
    from quarry.functions.exprs import day

    assert (spark.range(1).select(day(F.lit(text)).alias("d")).first()["d"] is not None) == ok
