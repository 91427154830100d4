"""Folders as a data source: what is pruned is never listed, filters are tested on names, contents are dealt to tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

from factgraph.sources import files, folders

TREE = {"a.md": b"# A", "docs/b.TXT": b"b", "docs/deep/er/c.md": b"c", "docs/.d/x.md": b"x", ".git/e.md": b"e", "docs/build/f.md": b"f", "g": b"g", "_h/.i.md": b"i", "docs/j.md": b"\xff\xfe", "k.xlsx": b"k", "docs/l.md": b""}


def tree(root, content=TREE):
    for name, body in content.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    return f"file://{root}"


def reader(root, tasks=4, filters=()):
    out = folders.FilteringFolderReader({"path": root, "tasks": str(tasks)})
    return out, list(out.pushFilters(list(filters)))


def watched(monkeypatch):
    """The folders that are listed from now on, below the root."""
    seen, real = [], folders.FolderReader._list
    monkeypatch.setattr(folders.FolderReader, "_list", lambda self, rel: (seen.append(rel), real(self, rel))[1])
    return seen


def rows(r):
    return sorted(row for p in r.partitions() for row in r.read(p))


@pytest.mark.parametrize("tasks", [1, 2, 3, 64])
def test_pruned_folders_are_never_listed(tmp_path, monkeypatch, tasks):
    root = tree(tmp_path)
    seen = watched(monkeypatch)
    got = rows(reader(root, tasks)[0])
    assert [r[1] for r in got] == sorted(["a.md", "docs/b.TXT", "docs/deep/er/c.md", "g", "_h/.i.md", "docs/j.md", "k.xlsx", "docs/l.md"])
    assert {r[1]: (r[2], r[4]) for r in got}["docs/b.TXT"] == ("txt", 1) and got[0][0].startswith("file:///")
    assert set(seen) == {"", "docs", "docs/deep", "docs/deep/er", "_h"}


def test_filters_prune_and_are_taken_over(tmp_path, monkeypatch):
    root = tree(tmp_path)
    seen = watched(monkeypatch)
    time = GreaterThan(("modified_at",), 0)
    r, left = reader(root, 64, [StringStartsWith(("rel",), "docs/deep/"), EqualTo(("extension",), "md"), time])
    assert left == [time] and [x[1] for x in rows(r)] == ["docs/deep/er/c.md"]
    assert set(seen) == {"", "docs", "docs/deep", "docs/deep/er"}
    seen.clear()
    assert [x[1] for x in rows(reader(root, 64, [EqualTo(("rel",), "docs/l.md")])[0])] == ["docs/l.md"]
    assert set(seen) == {"", "docs"}


def test_planning_keeps_folders_only_and_deals_them(tmp_path):
    root = tree(tmp_path, {f"d{k}/e{j}/f.md": b"" for k in range(10) for j in range(3)})
    parts = reader(root, 4)[0].partitions()
    assert len(parts) == 4 and sorted(w for p in parts for w in p.work) == [("", False)] + [(f"d{k}", True) for k in range(10)]
    assert len(rows(reader(root, 4)[0])) == 30 and len(rows(reader(root, 1000)[0])) == 30


def test_links_to_folders_are_not_followed(tmp_path):
    root = tree(tmp_path, {"a/b.md": b""})
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    assert [r[1] for r in rows(reader(root)[0])] == ["a/b.md"]


@pytest.mark.parametrize("pushdown", ["true", "false"])
def test_filters_of_a_session(spark, tmp_path, pushdown):
    root = tree(tmp_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushdown)
    try:
        found = folders.listed(spark, root)
        got = found.where("extension in ('md', 'txt') and n_bytes > 0 and rel like 'docs/%' and modified_at > '2001-01-01'")
        assert sorted(r["rel"] for r in got.collect()) == ["docs/b.TXT", "docs/deep/er/c.md", "docs/j.md"]
        assert found.where("modified_at > '2999-01-01'").count() == 0
        assert found.where("extension is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_scan_quarantines_what_is_no_text(spark, tmp_path):
    got = {r["rel"]: (r["text"], r["quarantined"]) for r in files.scan(spark, tree(tmp_path)).collect()}
    assert got == {"a.md": ("# A", False), "docs/b.TXT": ("b", False), "docs/deep/er/c.md": ("c", False), "_h/.i.md": ("i", False), "docs/j.md": (None, True), "k.xlsx": (None, True), "docs/l.md": ("", False)}


def test_empty_and_missing_roots(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert files.scan(spark, f"file://{tmp_path}/empty").collect() == []
    with pytest.raises(Exception, match="none"):
        files.scan(spark, f"file://{tmp_path}/none").collect()


def test_one_folder_is_many_tasks_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "BATCH_BYTES", 10)
    root = tree(tmp_path, {f"hot/{k}.md": b"x" * (k % 7) for k in range(200)})
    got = folders.contents(folders.listed(spark, root), 8).select("rel", "content", F.spark_partition_id().alias("task")).collect()
    assert {r["rel"]: len(r["content"]) for r in got} == {f"hot/{k}.md": k % 7 for k in range(200)}
    assert len({r["task"] for r in got}) == 8


def test_files_that_are_gone_are_left_out(spark, tmp_path):
    root = tree(tmp_path / "t", {"a.md": b"a", "b.md": b"b"})
    found = folders.listed(spark, root)
    found.write.parquet(f"file://{tmp_path}/list")
    (tmp_path / "t" / "a.md").unlink()
    assert [r["rel"] for r in folders.contents(spark.read.parquet(f"file://{tmp_path}/list")).collect()] == ["b.md"]


def test_put_replaces_and_refuses(spark, tmp_path):
    def rows_of(*r):
        return spark.createDataFrame(list(r), "rel string, content binary")

    folders.put(rows_of(("a/b.md", bytearray(b"1")), ("c.md", None)), f"file://{tmp_path}/out")
    folders.put(rows_of(("a/b.md", bytearray(b"2"))), f"file://{tmp_path}/out")
    assert {r["rel"]: r["text"] for r in files.scan(spark, f"file://{tmp_path}/out").collect()} == {"a/b.md": "2", "c.md": ""}
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["b.md", "c.md"]
    for name in ("../x.md", "/x.md", " "):
        with pytest.raises(Exception, match="no file name"):
            folders.put(rows_of((name, bytearray(b""))), f"file://{tmp_path}/out")
