"""Answers of a media probe, against a plain reading of their JSON."""

import json
import math

from quarry.operators import records as R

ANSWERS = [
    '{"format":{"duration":"12.5"},"streams":[{"codec_type":"audio"}]}', '{"format":{"duration":7},"streams":[{"codec_type":"video"},{"codec_type":"audio"}]}',
    '{"format":{"duration":" 1e2 "},"streams":[{"codec_type":"video"}]}', '{"format":{"duration":"nan"},"streams":[{"codec_type":"video"}]}', '{"format":{"duration":"-3"},"streams":[{"codec_type":"audio"}]}',
    '{"format":{"duration":"12d"},"streams":[{"codec_type":"audio"}]}', '{"format":null,"streams":[null,3,"audio",{"codec_type":"audio"}]}', '{"format":{"duration":"5"},"streams":[{"codec_type":"data"}]}',
    '{"format":{"duration":"5"}}', '{"format":{"duration":"5"},"streams":[]}', '{"format":{"duration":"5"},"streams":{"codec_type":"audio"}}', '{"streams":[{"codec_type":null},{"codec_type":"video"}]}',
    "[]", "3", "null", "", "not json", '{"streams":[{"codec_type":"audio"}]', None,
]


def plain(code, answer):
    if code is None:
        return (0.0, False, False, False, "file_missing")
    try:
        found = json.loads(answer or "") if code == 0 else 1 / 0
    except (ValueError, ZeroDivisionError):
        return (0.0, False, False, False, "unreadable_media")
    found = found if isinstance(found, dict) else {}
    kinds = {s.get("codec_type") for s in found.get("streams") or [] if isinstance(s, dict)}
    if not kinds & {"audio", "video"}:
        return (0.0, False, False, False, "no_media_stream")
    try:
        seconds = float((found.get("format") or {}).get("duration"))
    except (TypeError, ValueError):
        seconds = 0.0
    return (seconds if math.isfinite(seconds) and seconds >= 0 else 0.0, "audio" in kinds, "video" in kinds, True, None)


def test_media_probe(spark):
    cases = [(i, code, x, "kept") for i, (x, code) in enumerate((x, c) for x in ANSWERS for c in (0, 1, None))]
    df = spark.createDataFrame(cases * 2, "doc_id long, code int, probe string, extra string")
    got = R.media_probe(df)
    assert got.columns == ["doc_id", "code", "probe", "extra", "duration_seconds", "has_audio", "has_video", "ok", "reason"]
    found = [(r.doc_id, (r.duration_seconds, r.has_audio, r.has_video, r.ok, r.reason)) for r in got.collect()]
    assert sorted(found, key=lambda x: x[0]) == sorted(((i, plain(c, x)) for i, c, x, _ in cases * 2), key=lambda x: x[0])
    assert R.media_probe(df.limit(0)).count() == 0


def test_bodies_are_cut_at_the_rules_length(spark):
    from pyspark.sql import functions as F

    from quarry.operators import inventory as I

    rows = spark.createDataFrame([(1, "a/x.txt"), (2, "a/y.txt"), (3, "z.txt"), (4, "a/none.pdf")], "doc_id long, path string")
    beside = spark.createDataFrame([("a/.y.txt.txt", "from beside")], "path string, text string")
    texts = spark.createDataFrame([("a/x.txt", "é" * 150_000), ("a/y.txt", "own"), ("z.txt", "b" * 100_000)], "path string, text string")
    got = {r.doc_id: r.body for r in I.bodies(rows, beside, texts).select("doc_id", F.col("body")).collect()}
    assert got == {1: "é" * 100_000, 2: "from beside", 3: "b" * 100_000, 4: ""}


def test_an_answer_that_goes_on_after_its_value(spark):
    answers = ['3 words', '"a" b', '{"streams":[{"codec_type":"audio"}]} x', '1], [2', "1, 2", "null null", ' 3 \n', '{"streams":[{"codec_type":"audio"}]}\n']
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(answers)], "doc_id long, code int, probe string")
    found = [r.reason for r in R.media_probe(df).orderBy("doc_id").collect()]
    assert found == [*["unreadable_media"] * 6, "no_media_stream", None]
