"""Files read by tasks of equal bytes, against plain reading."""

import hashlib
import os

from pyspark.sql import functions as F

from quarry.sources import contents as T
from quarry.sources.readers import inventory

FILES = {
    "a.txt": "é日本 text".encode(), "b/bad.txt": b"ok \xff\xfe end\xe9", "b/empty.txt": b"", "b/.a.txt.hidden": b"side", "c/blank.md": b" \n\t", "c/long.txt": "é".encode() * 700_000 + b"x",
    "c/half.txt": b"cut \xe6\x97", "d/p.pdf": b"%PDF", "_meta/x": b"m", "d/v.mp4": b"0", "d/i.jpg": b"1", "d/i.psd": b"2",
}


def tree(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def test_scan(spark, tmp_path):
    tree(tmp_path, FILES)
    files = inventory(spark, str(tmp_path)).select("path", "size", F.col("path").endswith("txt").alias("wants_text"))
    gone = spark.createDataFrame([("gone.txt", 9, True), ("b", 9, True)], files.schema)
    for size in (1 << 27, 200_000):
        out = T.scanned(files.unionByName(gone), str(tmp_path), size)
        got = {r.path: r for r in out.collect()}
        assert set(got) == {*FILES, "gone.txt", "b"}
        for name, data in FILES.items():
            r = got[name]
            assert (r.n_bytes, r.sha256, r.state) == (len(data), hashlib.sha256(data).hexdigest(), "read")
            if name.endswith("txt"):
                assert r.text == data.decode(errors="replace") and r.bad_bytes == (name in ("b/bad.txt", "c/half.txt"))
            else:
                assert r.text is None and r.bad_bytes is None
        assert got["gone.txt"].state == "unreadable: FileNotFoundError" and got["b"].state == "unreadable: IsADirectoryError" and got["b"].sha256 is None
    assert T.scanned(files.limit(0), str(tmp_path)).count() == 0
    kinds = {r.path: r.x.reason for r in T.scanned(files, str(tmp_path)).select("path", T.extraction(F.col("path"), F.col("text")).alias("x")).collect()}
    assert [kinds[x] for x in ("a.txt", "b/empty.txt", "d/p.pdf", "d/v.mp4", "d/i.jpg", "d/i.psd")] == ["text_extracted", "empty", "pdf_needs_reader", "av_needs_reader", "image_needs_vision", "image_not_vision_readable"]


def test_restore_from_bytes(spark, tmp_path):
    tree(tmp_path / "mirror", FILES)
    tree(tmp_path / "library", {"a.txt": FILES["a.txt"], "b/bad.txt": b"other", "own/only.txt": b"1", "own/.hidden": b"2"})
    trees = [inventory(spark, str(tmp_path / x)).select("path", "size") for x in ("mirror", "library")]
    got = {r.path: r.state for r in T.restore_from(*trees, str(tmp_path / "mirror"), str(tmp_path / "library")).collect()}
    want = {x: "restore" for x in FILES if not x.startswith("_meta")} | {"a.txt": "identical", "b/bad.txt": "differs", "own/only.txt": "library_only"}
    assert got == want and os.path.exists(tmp_path / "mirror")
