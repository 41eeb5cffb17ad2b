import json

from pyspark.sql import functions as F

from repoweave.operators import changes as D
from repoweave.plans import analyze, update
from repoweave.sources import tree
from repoweave.streaming.edits import edit_stream


def test_analyze_a_tree(spark, tmp_path):
    root = tmp_path / "r"
    for path, text in {
        "app/__init__.py": "", "app/core.py": "class Engine:\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n", "lib/a.go": "package a\n\nfunc Start() {\n}\n\ntype Box struct {\n}\n",
        "lib/b.rs": "pub struct S {}\nimpl S {\n}\npub fn go() { }\n", "web/c.ts": "export class View {}\nexport const load = (x) => x\n", "node_modules/x.js": "class No {}", "Makefile": "all:\n\ttrue\n", "bad.py": None,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"\xff\xfe\x00" if text is None else text.encode())
    out = analyze.analyze(spark, str(root))
    assert {r["relative_path"] for r in out["files"].collect()} == {"app/__init__.py", "app/core.py", "lib/a.go", "lib/b.rs", "web/c.ts", "Makefile"}
    parts = {r["id"]: (r["component_type"], r["start_line"], r["end_line"]) for r in out["components"].collect()}
    assert parts["app/core.py::Engine"][0] == "class" and parts["app/core.py::Engine.run"] == ("method", 2, 3)
    assert {"lib/a.go::Start", "lib/a.go::Box", "lib/b.rs::S", "lib/b.rs::go", "web/c.ts::View", "web/c.ts::load"} <= set(parts)
    assert ("app/core.py::Engine.run", "app/core.py::helper") in {tuple(r) for r in out["edges"].collect()}
    assert {r["module"] for r in out["modules"].collect()} >= {"app", "lib", "web"}
    assert "Makefile::Makefile" in parts and "Makefile::all" in parts
    analyze.written({"candidates": out["candidates"]}, str(tmp_path / "out"), "1")
    assert spark.read.parquet(str(tmp_path / "out/candidates")).where("snapshot = 1").count() == out["candidates"].count()


def test_references_stay_in_their_file_if_they_can(spark, tmp_path):
    for path, text in {
        "a.py": "def helper():\n    return len(1)\n\nclass A:\n    def run(self):\n        return helper() + far() + print(2) + both()\n", "b.py": "def helper():\n    pass\n\ndef far():\n    pass\n\ndef both():\n    pass\n", "c.py": "def both():\n    pass\n\ndef print():\n    pass\n",
        "package.json": '{"scripts": {"build": "x", "test": "y"}}', "d/Makefile": "all: one\n\ttrue\nMakefile:\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    out = analyze.analyze(spark, str(tmp_path), artifact_bytes=45)
    assert {tuple(r) for r in out["edges"].collect()} == {("a.py::A.run", "a.py::helper"), ("a.py::A.run", "b.py::far")}
    # in walk order: the second artifact has no bytes left
    assert {r["path"]: r["included"] for r in out["artifacts"].collect()} == {"d/Makefile": True, "package.json": False}
    assert {r["id"] for r in out["components"].where("component_type = 'artifact'").collect()} == {"d/Makefile::Makefile", "d/Makefile::all"}
    (summary,) = out["summary"].collect()
    assert (summary["supported_files"], summary["languages"], summary["total_components"]) == (3, ["python"], 10)
    assert {r["language"]: r["n"] for r in out["languages"].collect()} == {"python": 8, "Artifact": 2}


def test_page_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/start.txt").write_text("x")
    (tmp_path / "a/_B.txt").write_text("y")
    (tmp_path / "a/tie.txt").symlink_to(tmp_path / "a/start.txt")
    deep = tmp_path / "b/c/d/e/f"
    deep.mkdir(parents=True)
    (deep / "low.txt").write_text("z")
    assert sorted(tuple(r)[0::2] for r in tree.pages(spark, str(tmp_path)).collect()) == [("a:_B", False), ("a:start", True), ("a:tie", False), ("b:c:d:e:f:low", True)]
    assert {r["page"]: r["content"] for r in tree.pages(spark, str(tmp_path)).where("not link").collect()} == {"a:_B": "y", "a:start": "x", "b:c:d:e:f:low": "z"}
    assert sum(r["relative_path"].endswith(".txt") for r in tree.files(spark, str(tmp_path)).collect()) == 3


def test_update_plan(spark):
    kind = "id string, component_type string, language string, body string, signature string, tokens string, depends_on array<string>"
    text = " ".join(f"t{i}" for i in range(40))
    data = [(f"c{i}", "class", "py", f"{text} own{i}", "s", f"{text} own{i}", ["c0"]) for i in range(40)]
    old = spark.createDataFrame(data, kind)
    new = [list(r) for r in data]
    new[3][5] = "new"
    new[7][0] = "moved"  # an unchanged body under a new id
    new[8][0], new[8][3] = "other", "nothing alike"
    out = update.plan(old, spark.createDataFrame(new, kind), spark.createDataFrame([("c3", "p3"), ("moved", "p7")], "id string, page string"))
    assert sorted(tuple(r) for r in out["changes"].collect()) == [("added", "other", None), ("deleted", "c8", None), ("modified_body", "c3", None), ("renamed", "moved", "c7")]
    said = out["outcome"].first()
    assert (said["active"], said["structural"], said["outcome"], said["fallback"], said["added"], said["reclustered"]) == (3, 3, "incremental", None, 1, False)
    assert sorted(tuple(r) for r in out["write_sets"].collect()) == [("c3", "p3"), ("c3", "wiki:start"), ("moved", "p7"), ("moved", "wiki:start"), ("other", "wiki:start")]
    assert update.plan(old.limit(0), old)["outcome"].first()["outcome"] == "full_fallback"
    assert update.plan(old, old)["outcome"].first()["outcome"] == "no_change"
    few = update.plan(old, old.limit(20))["outcome"].first()
    assert (few["outcome"], few["fallback"]) == ("full_fallback", "structural-threshold")
    edges = spark.createDataFrame([("moved", "c0"), ("moved", "c1"), ("moved", "c2"), ("other", "c9")], "caller string, callee string")
    leaves = spark.createDataFrame([("c0", "q"), ("c1", "q"), ("c2", "r"), ("a", "first")], "id string, page string")
    modules = spark.createDataFrame([("q", ["top", "low"]), ("first", ["f"])], "page string, path array<string>")
    routed = update.routes(out["changes"], edges, leaves, modules)
    assert sorted(tuple(r) for r in routed["routed"].collect()) == [("moved", "q"), ("other", "first")]
    assert sorted(r["module"] for r in routed["ancestors"].collect()) == ["f", "top", "top/low"]


def test_options_are_checked():
    import pytest

    for bad in ({"tau_ren": 1.5}, {"tau_nb": float("nan")}, {"max_diff_tokens": 0}, {"rung": "4"}):
        with pytest.raises(ValueError):
            update.Options(**bad)


def test_routes_are_applied_in_order(spark):
    modules = spark.createDataFrame([(["a"],), (["a", "x"],), (["b"],)], "path array<string>")
    members = spark.createDataFrame([(["a"], "1"), (["a", "x"], "1"), (["b"], "2"), (["b"], "3")], "path array<string>, id string")
    changes = spark.createDataFrame([("deleted", "2", None), ("renamed", "n3", "3")], "kind string, id string, old_id string")
    asked = [
        (1, "4", "place", "wiki:a:x:start", None, None), (2, "5", "place", "wiki:a:start", None, None), (3, "6", "create", None, "y", "wiki:b:start"), (4, "7", "place", "wiki:b:start", None, None),
        (5, "8", "place", "wiki:b:y:start", None, None), (6, "9", "create", None, "top", ""), (7, "10", "create", None, "deep", "wiki:top:start"), (8, "11", "untracked", None, None, None),
        (9, "zz", "place", "wiki:a:x:start", None, None), (10, "12", "place", "wiki:late:start", None, None), (11, "13", "create", None, "late", None), (12, "14", "fly", None, None, None),
    ]
    decisions = spark.createDataFrame(asked, "n long, component_id string, action string, leaf string, new_leaf string, parent string")
    known = spark.createDataFrame([(str(i),) for i in range(1, 15)], "id string")
    tree, said = D.applied_routes(members, modules, changes, decisions, known)
    assert {r["n"]: r["outcome"] for r in said.collect()} == {1: "applied", 2: "no such page", 3: "applied", 4: "no such page", 5: "applied", 6: "applied", 7: "applied", 8: "untracked", 9: "unknown component", 10: "no such page", 11: "applied", 12: "no such page"}
    got = {}
    for r in tree.collect():
        got.setdefault("/".join(r["path"]), set()).add(r["id"])
    assert got == {"a": {"1", "4"}, "a/x": {"1", "4"}, "b": {"n3", "6", "8"}, "b/y": {"6", "8"}, "top": {"9", "10"}, "top/deep": {"10"}, "late": {"13"}}


def test_stale_and_final(spark):
    page = lambda *x: spark.createDataFrame([(v,) for v in x], "page string")
    links = spark.createDataFrame([("a", "b"), ("a", "gone")], "page string, target string")
    problems = D.stale(page("a", "b", "c"), page("a", "b", "x"), links, spark.createDataFrame([("b", "short")], "page string, problem string"))
    assert sorted(tuple(r) for r in problems.select("page", "problem", F.coalesce("target", F.lit("-"))).collect()) == [("a", "broken link", "gone"), ("b", "short", "-"), ("c", "missing", "-"), ("x", "extra", "-")]
    raw = spark.createDataFrame([("a", '"Patch"'), ("b", '{"verdict":" rewrite ","reason":"Moved"}'), ("c", '"no-op: same"'), ("d", '"perhaps"')], "page string, value string")
    said = D.verdicts(raw)
    assert sorted(tuple(r) for r in said.collect()) == [("a", "patch", None, "patch"), ("b", "rewrite", "Moved", "rewrite: Moved"), ("c", "no-op", "same", "no-op: same"), ("d", None, None, None)]
    plan = spark.createDataFrame([("incremental",)], "outcome string")
    at = lambda x: F.to_timestamp(F.lit(x))
    row = D.finalized(plan, said.where("page <> 'd'"), page("a", "b"), problems, at("2024-01-01 00:00:00"), at("2024-01-01 00:00:02")).first()
    assert (row["outcome"], row["wall_seconds"], row["pages_written"], row["verdicts"]["b"], row["stale"]["missing"]) == ("incremental", 2.0, 2, "rewrite: Moved", 1)


def test_contexts(spark):
    changes = spark.createDataFrame([("added", "a"), ("modified_body", "b"), ("deleted", "z")], "kind string, id string")
    parts = spark.createDataFrame([(i, f"{i}.py", "python", i * 50) for i in "abc"], "id string, relative_path string, language string, source_code string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "caller string, callee string")
    got = {r["id"]: (r["mode"], r["up"], r["referrers"], len(r["own"])) for r in D.context(changes, parts, edges, 2, 10).collect()}
    assert got == {"a": ("create", ["b", "c"], ["c"], 40), "b": ("edit", ["a", "c"], ["a"], 40)}


def test_edit_stream(spark, tmp_path):
    folder = tmp_path / "ops"
    folder.mkdir()
    ops = [{"page": "p", "seq": 1, "kind": "insert", "old": "", "new": "one", "line": 0}, {"page": "p", "seq": 2, "kind": "replace", "old": "one", "new": "two", "line": 0}]
    kind = "page string, seq long, kind string, old string, new string, line long"
    stream = spark.readStream.schema(kind).json(str(folder))
    q = edit_stream(stream).writeStream.outputMode("update").format("memory").queryName("edits").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for i, op in enumerate(ops):
            (folder / f"{i}.json").write_text(json.dumps(op))
            q.processAllAvailable()
        assert {(r["content"], r["applied"]) for r in spark.table("edits").collect()} == {("one\n", 1), ("two\n", 2)}
    finally:
        q.stop()


def test_snapshots_are_followed(spark, tmp_path):
    from repoweave.streaming.snapshots import follow

    kind = "id string, signature string, body string, depends_on array<string>"
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(([("a", "s", "x"), ("b", "s", "x")], [("a", "s", "y"), ("c", "s", "x")])):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps({"id": i, "signature": t, "body": b, "depends_on": []}) for i, t, b in rows))
        stream = spark.readStream.schema(kind).json(str(tmp_path / "in"))
        follow(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/changes=1"))
    assert sorted(tuple(r) for r in found.select("kind", "id").collect()) == [("added", "c"), ("deleted", "b"), ("modified_body", "a")]
