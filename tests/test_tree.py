"""Walks with ceilings and links, and reads that notice changes, on small real trees."""

import os

import pytest
from pyspark.errors import PySparkException

from siftline.plans import api
from siftline.sources import tree


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "repo"
    for name, content in {"a/x.md": "x", "a.ts": "t", "a/deep/er/y.md": "y" * 50, "skip/z.md": "z", ".env": "K=1", "é.md": "e"}.items():
        p = base / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "secret.md").write_text("s")
    (base / "linked").symlink_to(outside)
    (base / "file-link.md").symlink_to(base / "a.ts")
    os.mkfifo(base / "pipe")
    return base


def _paths(frame):
    return [r["path"] for r in frame.orderBy(tree.order("path")).collect()]


def test_walk(spark, root):
    w = tree.walk(spark, str(root), ["skip"])
    assert w.reasons == []
    assert _paths(w.files()) == ["a/deep/er/y.md", "a/x.md", "a.ts", "é.md"]
    counted = w.counters().first()
    assert (counted["accepted_path_count"], counted["symlink_count"]) == (4, 2)
    hidden = set(_paths(w.entries.where("excluded")))
    assert {"linked", "file-link.md", "pipe", ".env"} <= hidden and not any(p.startswith("linked/") for p in _paths(w.entries))
    assert w.entries.count() == w.entries.select("path").distinct().count()


def test_empty_and_wrong_roots(spark, tmp_path, root):
    (tmp_path / "empty").mkdir()
    w = tree.walk(spark, str(tmp_path / "empty"))
    assert w.entries.count() == 0 and w.counters().first()["accepted_path_count"] == 0
    for wrong in (root / "linked", root / "a.ts", tmp_path / "none"):
        with pytest.raises(PySparkException):
            tree.walk(spark, str(wrong))


def test_ceilings(spark, root):
    everything = _paths(tree.walk(spark, str(root)).entries)
    with pytest.raises(PySparkException):
        tree.walk(spark, str(root), max_entries=5)
    for n in (1, 5, len(everything) - 1):
        cut = tree.walk(spark, str(root), max_entries=n, truncate=True)
        assert _paths(cut.entries) == everything[:n] and cut.reasons == ["MAX_ENTRIES"]
    assert tree.walk(spark, str(root), max_entries=len(everything)).reasons == []
    with pytest.raises(PySparkException):
        tree.walk(spark, str(root), max_depth=3)
    low = tree.walk(spark, str(root), max_depth=3, truncate=True)
    assert low.reasons == ["MAX_DEPTH"] and "a/deep/er/y.md" not in _paths(low.entries) and "a/deep/er" in _paths(low.entries)
    assert tree.walk(spark, str(root), max_depth=4).reasons == []


def test_reads_notice_changes(spark, root):
    files = tree.walk(spark, str(root)).files()
    states = lambda **more: {r["path"]: (r["state"], r["content"]) for r in tree.read(files, str(root), **more).collect()}
    assert states()["a/x.md"] == ("stable", bytearray(b"x"))
    assert states(max_bytes=49)["a/deep/er/y.md"] == ("oversize", None) and states(max_bytes=50)["a/deep/er/y.md"][0] == "stable"
    assert tree.demand_stable(tree.read(files, str(root))).select("state").distinct().first()["state"] == "stable"
    (root / "a.ts").write_text("longer")
    (root / "é.md").unlink()
    (root / "skip/z.md").unlink()
    (root / "skip/z.md").symlink_to(root / "a.ts")
    os.rename(root / "a/deep", root / "moved")
    (root / "a/deep").symlink_to(root / "moved")
    got = {p: s for p, (s, _) in states().items()}
    assert got == {"a/x.md": "stable", "a.ts": "changed", "é.md": "gone", "skip/z.md": "changed", "a/deep/er/y.md": "changed"}
    with pytest.raises(PySparkException):
        tree.demand_stable(tree.read(files, str(root))).collect()


def test_violations(spark):
    accepted = spark.createDataFrame([(0, "a.md"), (1, "b.md"), (2, "b.md"), (3, "../c.md"), (4, ".env")], "position long, path string")
    counters = spark.createDataFrame([(4, 0)], "accepted_path_count long, excluded_path_count long")
    got = {(r["rule"], r["path"]) for r in tree.violations(accepted, counters).collect()}
    assert got >= {("repeated", "b.md"), ("unsafe", "../c.md"), ("blocked", ".env"), ("count", None)} and ("unsafe", "a.md") not in got
    right = spark.createDataFrame([(5, 0)], "accepted_path_count long, excluded_path_count long")
    assert "count" not in {r["rule"] for r in tree.violations(accepted, right).collect()}


def test_observation_of_a_mounted_repository(spark, tmp_path):
    base = tmp_path / "repo"
    for name, body in {"AGENTS.md": "# Rules", "docs/a.md": "# A\ntext", "src/x.ts": "export const x = 1;", "big.ts": "y" * (tree.MAX_BYTES + 1)}.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(body)
    plain, mounted = api.observe(spark, str(base)), api.observe(spark, str(base), mounted=True)
    assert plain["snapshot"] == mounted["snapshot"]
    (base / "docs/linked.md").symlink_to(base / "docs/a.md")
    assert api.observe(spark, str(base), mounted=True)["snapshot"] == mounted["snapshot"]
