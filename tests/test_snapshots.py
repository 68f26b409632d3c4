"""A snapshot in byte ranges against the reader of whole files."""

import json
import random

import pytest

from quarry.sources.readers import read_snapshot
from quarry.sources.snapshots import read_large_snapshot

DOC = "struct<doc_id:bigint,name:string,tags:array<string>,content:struct<a:string,b:struct<c:bigint>>>"


@pytest.mark.parametrize("size", [40, 97, 1000, 1 << 20])
def test_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    odd = ['}', '{"documents": [', '\\', '\\"', '"}, {"', "é日本", "]}", "\n", '\\\\"}', "x" * 300]
    docs = [{"doc_id": i, "name": "".join(rng.choice(odd) for _ in range(rng.randrange(4))), "tags": [rng.choice(odd) for _ in range(rng.randrange(3))], "content": rng.choice([None, {"a": rng.choice(odd), "b": {"c": i}}])} for i in range(60)]
    whole = {"meta": {"schema_version": 1, "documents": "no", "x": {"documents": [{"doc_id": -1}]}}, "before": [{"doc_id": -2}], "documents": docs, "after": [{"doc_id": -3}, [{"doc_id": -4}]]}
    path = tmp_path / "snapshot.json"
    path.write_text(json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + "\n")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted(map(repr, read_large_snapshot(spark, f"file://{path}", DOC).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == sorted(map(repr, read_snapshot(spark, f"file://{path}", DOC).collect())) and len(got) == 60


def test_no_documents(spark, tmp_path):
    for i, text in enumerate(["", "{}", '{"documents": []}', '{"meta": {}, "documents": [ ] }']):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert read_large_snapshot(spark, f"file://{path}", DOC).count() == 0


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_many_files(spark, tmp_path, size):
    """Files that end with a new line, without one, and in the middle of a record."""
    docs = [{"doc_id": i, "name": "}" * (i % 3), "tags": ["é}"], "content": {"a": "{", "b": {"c": i}}} for i in range(12)]
    texts = [json.dumps(x, ensure_ascii=False) for x in docs]
    files = ['{"meta": {}, "documents": [\n', texts[0] + "\n", "," + texts[1], "," + texts[2][:-1], texts[2][-1] + "," + texts[3][:-2], texts[3][-2:], "," + ",\n".join(texts[4:9]) + "\n", "," + ",".join(texts[9:]) + "\n", "]}\n"]
    for i, x in enumerate(files):
        (tmp_path / f"part-{i:05d}.txt").write_text(x)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = read_large_snapshot(spark, f"file://{tmp_path}", DOC).orderBy("doc_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert [r.asDict(True) for r in got] == docs
