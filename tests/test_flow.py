"""The log's steps by a stream, cut and shuffled at will, against the batch query."""

import datetime
import random

import pytest

from quarry.operators.events import transitions
from quarry.streaming.flow import ROCKS, follow_flow

SCHEMA = "operation_id string, seq bigint, event_time timestamp, status string"
LEGAL = {("A", "B"), ("B", "C"), ("A", "A")}


@pytest.mark.parametrize("batches", [2, 5])
def test_any_cut(spark, tmp_path, batches):
    rng = random.Random(batches)
    start = datetime.datetime(2026, 1, 1)
    rows = [(f"op{rng.randrange(4)}", i, start + datetime.timedelta(minutes=i // 2), rng.choice("ABC")) for i in range(80)]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(-9, 10))  # by some minutes
    cut = [late[i * 80 // batches : (i + 1) * 80 // batches] for i in range(batches)]
    far = [("end", 1000 + i, start + datetime.timedelta(days=1 + i), "A") for i in range(2)]  # time goes on
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        query = None
        for i, part in enumerate([*cut, *([x] for x in far)]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            if query is None:
                stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
                query = follow_flow(stream, LEGAL, "30 minutes").writeStream.format("memory").queryName(f"flow{batches}").option("checkpointLocation", str(tmp_path / "c")).start()
            query.processAllAvailable()
        query.stop()
        got = sorted(tuple(r) for r in spark.table(f"flow{batches}").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    legal = spark.createDataFrame(sorted(LEGAL), "from_state string, to_state string")
    steps = transitions(spark.createDataFrame(rows, SCHEMA), "operation_id", "status", legal)
    want = sorted((r.operation_id, r.from_state, r.to_state, r.is_legal) for r in steps.collect())
    assert got == want and len(want) == 76


def test_idle_operations_are_forgotten(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    day = datetime.timedelta(days=1)
    parts = [[("a", 1, start, "A"), ("a", 2, start + day / 24, "B")], [("z", 3, start + 3 * day, "A")], [("a", 4, start + 3 * day, "C")], [("z", 5, start + 9 * day, "B")], [("y", 6, start + 20 * day, "B")]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        query = None
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            if query is None:
                stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
                query = follow_flow(stream, LEGAL, "30 minutes", 2 * 86_400_000).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).start()
            query.processAllAvailable()
        query.stop()
        got = sorted((r.operation_id, r.from_state, r.to_state) for r in spark.table("idle").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == [("a", "A", "B")]  # the later events of a and z begin anew
