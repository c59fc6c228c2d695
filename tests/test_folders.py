import os

import pytest
from pyspark.sql import functions as F

from arborq.functions import paths
from arborq.sources import folders
from arborq.workspace import Workspace

TREE = {
    "a.jl": b"x = 1", "sub/deep/er/B.JL": b"y = 2", "sub/c.md": b"# c", "sub/d.jmd": b"", "Project.toml": b'name = "P"', "sub/JuliaManifest-v1.11.toml": b"", "julialint.toml": b"", "JuliaFormat.toml": b"", "JULIATESTITEMS.TOML": b"",
    "other.toml": b"no", "f.bin": b"\x00", "noext": b"", "bad.jl": b"\xff\xfe", "zero.jl": b"a\x00b", ".git/x.jl": b"no", "sub/node_modules/y.jl": b"no", "sub/.hg/z.jl": b"no", "sp ace/é ü+%.jl": "ä".encode(),
}


@pytest.fixture()
def tree(tmp_path):
    for name, data in TREE.items():
        p = tmp_path / "w" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink(tmp_path / "w" / "sub", tmp_path / "w" / "linked")
    os.makedirs(tmp_path / "w" / "empty" / "er")
    os.symlink(tmp_path / "gone.jl", tmp_path / "w" / "broken.jl")
    return str(tmp_path / "w")


def names(df, root):
    return {r["path"].removeprefix(root + "/"): r for r in df.collect()}


READ = {"a.jl", "sub/deep/er/B.JL", "sub/c.md", "sub/d.jmd", "Project.toml", "sub/JuliaManifest-v1.11.toml", "julialint.toml", "JuliaFormat.toml", "JULIATESTITEMS.TOML", "bad.jl", "zero.jl", "sp ace/é ü+%.jl"}


@pytest.mark.parametrize("parts", [1, 64])
def test_tree(spark, tree, parts, monkeypatch):
    monkeypatch.setattr(folders, "PARTS", parts)
    got = names(folders.tree(spark, tree), tree)
    assert got.keys() == READ
    assert (got["sub/deep/er/B.JL"]["content"], got["sub/deep/er/B.JL"]["size"], got["sub/deep/er/B.JL"]["kind"]) == ("y = 2", 5, "julia")
    assert (got["bad.jl"]["content"], got["bad.jl"]["problem"]) == (None, "not UTF-8") and got["zero.jl"]["problem"] == "a zero character"
    assert paths.uri_to_path(got["sp ace/é ü+%.jl"]["uri"]) == f"{tree}/sp ace/é ü+%.jl"
    assert {got[x]["kind"] for x in ("julialint.toml", "JuliaFormat.toml", "JULIATESTITEMS.TOML", "Project.toml", "sub/JuliaManifest-v1.11.toml")} == {"lint_config", "format_config", "testitems_config", "project", "manifest"}
    assert {r["content"] for r in folders.tree(spark, tree, content=False).collect()} == {None}


def test_predicates_reach_the_listing(spark, tree):
    want = {"kind = 'julia'": {"a.jl", "sub/deep/er/B.JL", "bad.jl", "zero.jl", "sp ace/é ü+%.jl"}, "kind IN ('project', 'manifest') AND size > 0": {"Project.toml"}, "name LIKE 'B%' OR size = 2": {"sub/deep/er/B.JL", "bad.jl", "sp ace/é ü+%.jl"}, "NOT kind = 'julia' AND language_id <> 'toml'": {"sub/c.md", "sub/d.jmd"}, "content LIKE 'x%'": {"a.jl"}}
    for sql, found in want.items():
        assert names(folders.tree(spark, tree, sql), tree).keys() == found, sql
    reader = folders.TreeReader({"path": tree})
    left = list(reader.pushFilters([folders.ds.EqualTo(("kind",), "project"), folders.ds.EqualTo(("content",), "x")]))
    assert len(left) == 1 and len(reader.filters) == 1
    opened = []
    old = folders.read_text
    try:
        folders.read_text = lambda s, p: opened.append(p) or old(s, p)
        rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    finally:
        folders.read_text = old
    assert [r["name"] for r in rows] == ["Project.toml"] == [os.path.basename(p) for p in opened]


def test_links_that_lead_round(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jl").write_bytes(b"")
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    assert folders.tree(spark, str(tmp_path)).count() == 1


def test_scan_and_its_errors(spark, tree):
    assert names(folders.scan(spark, tree), tree).keys() == READ
    assert names(folders.scan(spark, f"file://{tree}"), tree).keys() == READ
    with pytest.raises(folders.TooManyFiles):
        folders.scan(spark, tree, max_julia_files=4)
    assert folders.scan(spark, tree, max_julia_files=5).count() == len(READ)
    with pytest.raises(Exception, match="UTF-8"):
        folders.scan(spark, f"{tree}", lenient=False).orderBy("path").collect()
    with pytest.raises(Exception):
        folders.scan(spark, f"{tree}/gone").collect()
    os.remove(f"{tree}/linked")  # Spark's reader follows links
    os.remove(f"{tree}/broken.jl")
    assert {r["path"].rpartition("/")[2] for r in folders._scan_by_spark(spark, tree).where("kind = 'julia' AND problem IS NULL").collect()} == {"a.jl", "B.JL", "é ü+%.jl"}


def test_read_one(spark, tree):
    assert folders.read_one(spark, f"{tree}/a.jl").head()["content"] == "x = 1"
    for name in ("bad.jl", "zero.jl", "f.bin", "other.toml"):
        with pytest.raises(ValueError):
            folders.read_one(spark, f"{tree}/{name}")
    with pytest.raises(FileNotFoundError):
        folders.read_one(spark, f"{tree}/gone.jl")


def test_kinds_as_a_column(spark):
    rows = [(f"/x/{n}",) for n in [*TREE, "Manifest-v1.x.toml", "a.jl.txt", ".jl", "myproject.toml"]] + [(None,)]
    got = spark.createDataFrame(rows, "p string").select("p", paths.kind(F.col("p")).alias("k"), paths.language(paths.kind(F.col("p"))).alias("l")).collect()
    assert all((r["k"], r["l"]) == ((k := paths.kind_of(r["p"])), paths.LANGUAGES.get(k)) for r in got if r["p"])


def test_write_tree(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("a/b.jl", "x"), ("/c.md", None), ("d/../e.jl", "no")], "path string, content string")
    with pytest.raises(Exception, match="below"):
        folders.write_tree(df, root)
    assert folders.write_tree(df.where("path NOT LIKE '%..%'"), f"file://{root}") == 2
    assert {n: r["content"] for n, r in names(folders.tree(spark, root), root).items()} == {"a/b.jl": "x", "c.md": ""}
    assert folders.write_tree(df.limit(0), root) == 0


def test_a_workspace_from_a_folder(spark, tree):
    w = Workspace.from_folders(spark, tree)
    assert w.lint_configs().count() == 1
    assert w.diagnostics().where("rule_id = 'config_errors'").count() == 0
    with open(f"{tree}/julialint.toml", "w") as f:
        f.write("rules = 3")
    assert Workspace.from_folders(spark, tree).diagnostics().where("rule_id = 'config_errors'").count() == 1


def test_updates_keep_what_they_do_not_tell(spark):
    w = Workspace(spark)
    w.add_file("untitled:1", "x = 1", "julia")
    w.update_file("untitled:1", "x = 2")
    assert [(r["content"], r["language_id"], r["revision"]) for r in w.files.collect()] == [("x = 2", "julia", 2)]
    with pytest.raises(ValueError):
        w.update_files(spark.createDataFrame([("untitled:1", "a"), ("untitled:1", "b")], "uri string, content string"))


def test_large_files_of_a_folder_are_dealt_out_by_size(tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.jl").write_text("x = 1\n" * 600_000)
    parts = folders.TreeReader({"path": str(tmp_path)}).partitions()
    assert max(len(p.files) for p in parts) == 2 and sum(len(p.files) for p in parts) == 6
