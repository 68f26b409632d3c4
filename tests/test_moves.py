"""Composed moves, names that stay unique, and running sums against plain loops."""

import random

from quarry.operators import moves as V
from quarry.operators.staged import running_sum


def one_by_one(path, moves):
    for src, dst in moves:
        if path is not None and (path == src or path.startswith(src + "/")):
            path = dst + path[len(src) :]
    return path


def test_moves(spark):
    rng = random.Random(1)
    parts = ["a", "b", "ab", "a"]
    folder = lambda n: "/".join(rng.choice(parts) for _ in range(rng.randrange(1, n)))
    for trial in range(3):
        moves = [(folder(4), folder(4)) for _ in range((1, 6, 11)[trial])]
        if trial == 2:
            moves[:4] = [("a", "b"), ("b", "a/b"), ("a/b/a", "ab"), ("ab", "a")]  # chained and nested
        rows = [(i, folder(6) if i % 9 else None, "n", "t", "p") for i in range(250)]
        df = spark.createDataFrame(rows, "doc_id int, current_path string, current_filename string, updated_at_utc string, pending_decision string")
        order = spark.createDataFrame([(7 + i, *m) for i, m in enumerate(moves)], "ord int, src string, dst string")
        got = {r.doc_id: r for r in V.repointed(df, order, "now").collect()}
        assert len(got) == len(rows)
        for i, path, *_ in rows:
            want = one_by_one(path, moves)
            met = path is not None and any(p == s or p.startswith(s + "/") for k, (s, _) in enumerate(moves) for p in [one_by_one(path, moves[:k])])
            assert got[i].current_path == want
            assert (got[i].updated_at_utc, got[i].pending_decision, got[i].current_filename) == (("now", None, want.split("/")[-1]) if met else ("t", "p", "n"))
    none = order.limit(0)
    assert V.repointed(df, none, "now").count() == len(rows)


def test_running_sum(spark):
    rows = [("k" if i % 3 else None, i, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v bigint").repartition(7)
    got = {r.i: r.s for r in running_sum(df, ["k"], ["i"], "v", "s").collect()}
    assert got == {i: sum(v for k2, j, v in rows if k2 == k and j <= i) for k, i, _ in rows}


def loop(wanted, taken):
    held, out = set(taken), {}
    for i, path in sorted(wanted):
        if path is None:
            out[i] = None
            continue
        head, _, name = path.rpartition("/")
        dot = name.rfind(".")
        cut = len(path) - (len(name) - dot if dot > 0 else 0)
        now, k = path, 0
        while now in held:
            k += 1
            now = f"{path[:cut]}__{k}{path[cut:]}"
        held.add(now)
        out[i] = now
    return out


def test_unique_names(spark):
    from quarry.operators.names import unique_names

    rng = random.Random(3)
    cases = [([(1, "a.txt"), (2, "a.txt"), (3, "a__1.txt")], []), ([(1, "a__1.txt"), (2, "a.txt"), (3, "a.txt"), (4, "a__1__1.txt"), (5, "a__1.txt")], ["a.txt"])]
    pool = ["a.txt", "a__1.txt", "a__2.txt", "a__1__1.txt", "a__3.txt", "d/b", "d/b__1", "d/b__2__1", ".rc", ".rc__1", None]
    for n in (60, 200):
        wanted = [(i, rng.choice(pool[:3] if rng.random() < 0.6 else pool)) for i in rng.sample(range(1000), n)]
        cases.append((wanted, rng.sample(["a.txt", "a__2.txt", "a__1__2.txt", "a__7.txt", "d/b__1", "c", ".rc"], 4)))
    for wanted, taken in cases:
        got = unique_names(spark.createDataFrame(wanted, "doc_id bigint, path string"), spark.createDataFrame([(t,) for t in taken] + [(None,)], "path string"))
        assert {r.doc_id: r.path for r in got.collect()} == loop(wanted, taken)
