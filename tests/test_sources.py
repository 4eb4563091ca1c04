import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspan.operators import chunking, search
from larkspan.plans import workflows
from larkspan.session import scratch_path, shared_folder
from larkspan.sources import files, sinks, tables


@pytest.fixture
def tree(tmp_path):
    keep = {
        "a.md": "# A\nalpha text", "sub/b.PY": "x = 1\n", "sub/c.json": '{"k": 1}', ".hidden": "kept", "sub/no_ext": "plain",
        "sub/empty.txt": "", "sub/__init__.py": "import os\n", "sp ace+é.txt": "name with blanks",
    }
    drop = [".git/x.txt", "node_modules/y.txt", "sub/.secret/z.txt", "sub/index/i.txt", "pic.PNG", "sub/Thumbs.db", "m.pyc"]
    for name, text in keep.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    for name in drop:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"drop")
    return tmp_path, keep


def test_scan(spark, tree):
    root, keep = tree
    found = files.read_documents(files.scan_files(spark, str(root))).collect()
    assert {r["filepath"]: r["content"] for r in found} == {str(root / n): t for n, t in keep.items()}
    assert {r["filename"]: r["extension"] for r in found}["b.PY"] == ".py"


def test_hidden_names_and_odd_roots(spark, tmp_path):
    root = tmp_path / "a [x] {y} é"
    keep = {"_f.txt": "1", "_d/g.txt": "2", "_d/_e/_h.py": "3", "_d/i/.j": "4", "k/_SUCCESS": "5", "k/%41 +.txt": "6"}
    drop = [".d/a.txt", "_d/.x/b.txt", "_d/.x/_y/c.txt", "_d/node_modules/d.txt", "k/_e.png", "k/.DS_Store", "venv/_z.txt", "venv/_q/r.txt"]
    for name in [*keep, *drop]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(keep.get(name, "drop"))
    got = {r["filepath"]: r["content"] for r in files.read_documents(files.scan_files(spark, str(root))).collect()}
    assert got == {str(root / n): t for n, t in keep.items()}
    assert {(r["filepath"], r["length"]) for r in files.list_files(spark, f"file://{root}/").collect()} == {(str(root / n), 1) for n in keep}
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "none"))


def test_tasks_list_and_open_files_in_place(spark, tree):
    """No file is copied, and no plan holds the list of files."""
    root, keep = tree
    before = set(Path(shared_folder(spark).removeprefix("file:")).glob("hidden-*"))
    listed, scanned = files.list_files(spark, str(root)), files.scan_files(spark, str(root))
    assert {(r["filepath"], r["length"]) for r in listed.collect()} == {(str(root / n), len(t.encode())) for n, t in keep.items()}
    assert scanned.count() == len(keep)
    assert set(Path(shared_folder(spark).removeprefix("file:")).glob("hidden-*")) == before
    assert not [f for df in (listed, scanned) for f in df.inputFiles() if str(root) in f]
    assert "sub/c.json" not in listed._jdf.queryExecution().toString()


def test_both_ways_through_a_tree_agree(spark, tree, monkeypatch):
    """Tasks, and Spark's own listing for stores that tasks do not reach."""
    root, keep = tree
    (root / "big.txt").write_text("x" * 200)
    (root / "_long.txt").write_text("x" * 300)
    found = {True: [], False: []}
    for reached, rows in found.items():
        monkeypatch.setattr(files, "_reached", lambda *_, r=reached: r)
        rows += [sorted(map(tuple, df.collect())) for df in (files.list_files(spark, str(root)), files.scan_files(spark, str(root), longest=100))]
    assert found[True] == found[False] and len(found[True][0]) == len(keep) + 2


def test_long_files_are_told_and_ignored_ones_not_opened(spark, tree):
    root, keep = tree
    (root / "big.txt").write_text("x" * 200)
    (root / "_big.txt").write_text("x" * 300)
    (root / "big.png").write_bytes(b"x" * 5000)
    (root / "node_modules" / "big.txt").write_text("x" * 5000)
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # a longer file that is opened fails
    try:
        rows = {r["filepath"]: r for r in files.scan_files(spark, str(root), longest=100).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)
    long = {str(root / n) for n in ("big.txt", "_big.txt")}
    assert set(rows) == {str(root / n) for n in keep} | long
    assert {p for p, r in rows.items() if r["error"]} == long and all(rows[p]["content"] is None for p in long)


def test_statistics_of_the_writing_pass(spark, tree):
    root, keep = tree
    (root / "broken.json").write_text("{no json at all")
    (root / "latin.md").write_bytes("# Caf\xe9\r\n\r\ntext\rmore".encode("latin-1"))
    out = scratch_path(spark, "idx")
    got = workflows.build_index(spark, str(root), out).first().asDict()
    assert got == {"files": 10, "files_indexed": 9, "files_failed": 1, "files_empty": 1, "files_unreadable": 0, "files_unparsed": 1, "chunks": spark.read.parquet(out).count()}
    assert {r["content"] for r in spark.read.parquet(out).filter("filename = 'latin.md'").collect()} == {"# Caf\xe9\ntext\nmore"}
    documents = files.read_documents(files.scan_files(spark, str(root), longest=10))
    got = workflows.index_documents(documents, scratch_path(spark, "idx")).first()
    assert got["files_unreadable"] == sum(len(t.encode()) > 10 for t in keep.values()) + 2 and got["files_empty"] == 1


def test_decode(spark):
    raw = [b"caf\xc3\xa9\r\nx\ry", b"\xef\xbb\xbfbom", b"caf\xe9", b""]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, content binary")
    got = [r["t"] for r in df.orderBy("i").select(files.decode_text("content").alias("t")).collect()]
    assert got == ["café\nx\ny", "﻿bom", "café", ""]


@pytest.mark.parametrize("name,want", [("a.b", ".b"), ("a..B", ".b"), ("..foo", ""), ("a.", "."), (".env", ""), ("x.tar.gz", ".gz"), ("n", "")])
def test_extension(spark, name, want):
    assert spark.range(1).select(files.extension(F.lit(name)).alias("e")).first()["e"] == want


def test_index_and_search(spark, tree, tmp_path):
    root, keep = tree
    out = scratch_path(spark, "idx")
    stats = workflows.build_index(spark, str(root), out).first()
    assert (stats["files_indexed"], stats["files_failed"], stats["chunks"]) == (7, 1, 7)
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    hits = workflows.search_index(spark, out, asked).collect()
    assert [(r["filename"], r["chunk_id"], r["preview"]) for r in hits] == [("a.md", 1, "# A\nalpha text")]
    empty = tmp_path / "nothing"
    empty.mkdir()
    (empty / "e.txt").write_text(" ")
    assert workflows.build_index(spark, str(empty), scratch_path(spark, "idx")) is None
    check = workflows.verify_embedding(spark, ["open the notes", "open my notes", "weather today"], search.DIMENSION).first()
    assert check["sizes_ok"] and check["order_ok"]


def test_csv(spark):
    rows = [(1, 'a "q", b\nline', None), (2, "", "x")]
    path = sinks.write_csv(spark.createDataFrame(rows, "id int, t string, u string"), scratch_path(spark, "csv"))
    got = {r["id"]: (r["t"], r["u"]) for r in tables.read_csv(spark, path, "id int, t string, u string").collect()}
    assert got[1] == ('a "q", b\nline', None) and got[2][1] == "x"
    with pytest.raises(Exception):
        sinks.write_csv(spark.range(1), path)


def test_large_csv_is_split(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,t\n" + "".join(f'{i},"a ""q"" {i}"\n' for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        whole = tables.read_csv(spark, str(path), "id int, t string")
        split = tables.read_csv(spark, str(path), "id int, t string", multi_line=False)
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 4
        assert whole.exceptAll(split).isEmpty() and split.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_jsonl(spark, tmp_path):
    good = tmp_path / "x.jsonl.gz"
    with gzip.open(good, "wt") as f:
        f.write('{"a": 1}\n\n   \n{"a": 2}\n')
    assert sorted(r["a"] for r in tables.read_jsonl(spark, str(good), "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_sharded(spark, tmp_path):
    for lang, name, line in (("go", "deep/go_train_1.jsonl", "b"), ("go", "deep/go_train_0.jsonl", "a"), ("go", "go_valid_0.jsonl", "c"),
                             ("php", "php_train.txt", "d"), ("zig", "zig_train.jsonl", "e"), ("php", "php_train.jsonl", "f")):
        path = tmp_path / lang / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"code": line, "language": "other"}) + "\n" + json.dumps({"code": line + "2"}) + "\n")
    out = tables.read_sharded(spark, str(tmp_path), ["go", "php"], "train")
    got = [(r["language"], r["code"]) for r in out.orderBy("shard", "block", "line").collect()]
    assert got == [("go", "a"), ("go", "a2"), ("go", "b"), ("go", "b2"), ("php", "f"), ("php", "f2")]


def test_params(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"target_mean": 1.5, "target_std": 0.5, "language_to_id": {"go": 5}, "per_language_calibration": {"go": {"a": 2.0, "b": 1.0}}}, indent=2))
    params = tables.read_params(spark, str(path))
    row = params.first()
    assert row["max_token_len"] == 512 and row["language_to_id"] == {"go": 5}
    assert [tuple(r) for r in tables.calibration_table(params).collect()] == [("go", 2.0, 1.0)]
    path.write_text('{"target_mean": 1.0}')
    assert tables.read_params(spark, str(path)).first()["per_language_calibration"] == {}


def test_payloads(spark):
    page = {"items": [{"snippet": {"resourceId": {"videoId": v}, "title": "t", "description": None, "channelTitle": "c", "publishedAt": "p"}} for v in "ab"], "playlist_id": "U", "page": 0}
    df = spark.createDataFrame([(json.dumps(page),)], "v string").select(F.from_json("v", tables.VIDEO_PAYLOAD).alias("p")).select("p.*")
    got = tables.flatten_video_payload(df).collect()
    assert [(r["video_id"], r["position"], r["description"]) for r in got] == [("a", 0, None), ("b", 1, None)]
    hit = {"search": {"items": [{"snippet": {"channelId": "C"}}]}, "channels": {"items": [{"snippet": {"title": "T"}, "contentDetails": {"relatedPlaylists": {"uploads": "U"}}}]}, "label": 1}
    miss = {"search": {"items": []}, "channels": {"items": []}, "label": 0}
    df = spark.createDataFrame([(json.dumps(x),) for x in (hit, miss)], "v string").select(F.from_json("v", tables.CHANNEL_PAYLOAD).alias("p")).select("p.*")
    assert [tuple(r) for r in tables.flatten_channel_payload(df).collect()] == [("T", "C", "U", 1)]


def test_feature_cache_and_inline(spark):
    df = tables.inline_table(spark, [([0.5, 1.0], 3, 2.0)], "embedding array<float>, language_id bigint, cyclomatic_complexity float")
    path = sinks.write_feature_cache(df, scratch_path(spark, "f"))
    assert tuple(tables.read_feature_cache(spark, path).first()) == ([0.5, 1.0], 3, 2.0)


def test_videos_pipeline(spark):
    rows = [("v1", " T ", None, "A ", "p", 1), ("v1", "later", "d", "A", "p", 1), ("v2", None, "d", "B", "p", 0), ("v3", "x", " " * 3, None, "p", 0), ("v4", "y", "z" * 300, "C", "p", 0)]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + tables.LABELLED_VIDEOS)
    got = {r["video_id"]: r for r in workflows.prepare_videos(raw, ["A"], ["C"], ["n"]).collect()}
    assert set(got) == {"v1", "v3", "v4"}
    assert got["v1"]["text"] == "[TITLE] T [CHANNEL] A [DESC] " and got["v1"]["split"] == "val"
    assert got["v3"]["split"] == "train" and got["v4"]["text"].endswith("[DESC] " + "z" * 300)
    cut = workflows.prepare_videos(raw, ["A"], ["C"], ["n"], 250).filter("video_id = 'v4'").first()
    assert cut["text"].endswith("[DESC] " + "z" * 250)
    report = {k: v.collect() for k, v in workflows.profile_videos(raw).items()}
    assert report["duplicate_ids"][0][0] == 1 and tuple(report["empty_descriptions"][0]) == (2, 40.0)


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == configured if configured else shared_folder(spark)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_repartitioning_does_not_change_chunks(spark, tree):
    docs = files.read_documents(files.scan_files(spark, str(tree[0])))
    one = sorted(map(tuple, chunking.chunk_documents(docs).collect()))
    assert one == sorted(map(tuple, chunking.chunk_documents(docs.repartition(6)).collect()))
