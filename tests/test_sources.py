import json
import random

import pytest
from pyspark.sql import functions as F

from repoweave import __main__ as cli
from repoweave.functions import paths as P
from repoweave.functions import prompts
from repoweave.operators import editions as E
from repoweave.operators import modules as M
from repoweave.sources import declarations as D
from repoweave.sources import documents as J
from repoweave.sources import tree


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nested_trees(spark):
    tree = {"a": {"path": "x", "components": ["1"], "children": {"b": {"components": ["2", "3"], "children": {"c": {"components": [], "children": {}}}}}}, "d": {"components": []}}
    df = spark.createDataFrame([(1, json.dumps(tree))], "tree long, value string")
    assert rows(J.module_rows(df).select(F.array_join("path", "/"), "depth", "parent", "is_leaf", F.size("components"))) == [("a", 1, None, False, 1), ("a/b", 2, "a", False, 2), ("a/b/c", 3, "a/b", True, 0), ("d", 1, None, True, 0)]


def test_graph_with_missing_fields(spark):
    df = spark.createDataFrame([(1, '{"x":{"name":"X","depends_on":["y"]},"y":{}}')], "graph long, value string")
    assert rows(J.graph_nodes(df).select("id", "name", "depends_on")) == [("x", "X", ["y"]), ("y", None, None)]


def test_nested_cluster_responses(spark):
    one = {"b": {"path": "src", "components": ["1", "2", 7, "9"], "children": {"in": {"components": ["1"], "modules": ["x", "y", 3]}}, "decomposition_review": {"decision": "split", "risk": "low", "reason": "r"}}, "a": {"components": ["2"]}, "no": "text", "bad": {"components": 5, "decomposition_review": {"decision": "maybe", "risk": "low"}}}
    two = {"deep": {"children": {"er": {"children": {"still": {"components": ["1"]}}}}}}
    texts = [f"so <GROUPED_COMPONENTS>```{json.dumps(one)}```</GROUPED_COMPONENTS> <DECOMPOSITION_REVIEW>{json.dumps({'decision': 'split', 'risk': 'high', 'reason': 'why'})}</DECOMPOSITION_REVIEW>", json.dumps(two), "no json", "[1]", None, '<DECOMPOSITION_REVIEW>{"decision":"retain_leaf","risk":"low"}</DECOMPOSITION_REVIEW><GROUPED_COMPONENTS>{}</GROUPED_COMPONENTS>', "<GROUPED_COMPONENTS>{}</GROUPED_COMPONENTS><DECOMPOSITION_REVIEW>{</DECOMPOSITION_REVIEW>"]
    responses = spark.createDataFrame([(i, "module" if i in (0, 5, 6) else "repo", ["top", "mid"], t) for i, t in enumerate(texts)], "response int, scope string, parent array<string>, text string").withColumn("review", J.reviews(F.col("text")))
    groups = J.cluster_modules(responses.select("response", "text"))
    got = {(r["response"], "/".join(r["path"])): (r["folder"], r["components"], r["review"] and r["review"]["decision"]) for r in groups.collect()}
    assert got == {
        (0, "b"): ("src", ["1", "2", "9"], "split"), (0, "b/in"): (None, ["1"], None), (0, "b/in/x"): (None, [], None), (0, "b/in/y"): (None, [], None), (0, "a"): (None, ["2"], None), (0, "bad"): (None, [], None),
        (1, "deep"): (None, [], None), (1, "deep/er"): (None, [], None), (1, "deep/er/still"): (None, ["1"], None),
    }
    asked = spark.createDataFrame([(i, x) for i in range(7) for x in ("1", "2", "3")] + [(3, "z")], "response int, id string")
    known = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    outcomes = M.cluster_outcomes(responses, groups, asked, known)
    assert {r["response"]: (r["error"], r["decision"], r["selected"], r["omitted"], r["groups"]) for r in outcomes.collect()} == {
        0: (None, "split", 2, 1, 2), 1: ("no groups", None, 0, 0, 0), 2: ("no groups", None, 0, 0, 0), 3: ("an unknown component was asked for", None, 0, 0, 0), 4: ("no groups", None, 0, 0, 0), 5: (None, "retain_leaf", 0, 0, 0), 6: ("the review can't be read", None, 0, 0, 0),
    }
    made = {("/".join(r["path"]), r["id"]) for r in M.clustered(responses, groups, asked, outcomes).collect()}
    assert made == {("top/mid/b", "1"), ("top/mid/a", "2"), ("top/mid/b/in", "1"), ("top", "1"), ("top", "2"), ("top/mid", "1"), ("top/mid", "2")}


def test_id_lists(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("a\r\n\n b ",), ('{"a":1}',)], "t string")
    assert [r[0] for r in df.select(J.id_list(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], None]


def test_patches(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@ f\n+a\n@@ -9,1 +11,0 @@\n-b\ndiff --git a/y b/y\n--- /dev/null\n+++ b/y\n@@ -0,0 +1 @@\n+@@ no\n"
    df = spark.createDataFrame([("p", text)], "patch string, text string")
    assert rows(J.patch_hunks(df)) == [("p", "x", 1, 3), ("p", "x", 11, 11), ("p", "y", 1, 1)]


def test_pages_are_made_once(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "page string, content string")
    old = spark.createDataFrame([("b", "1"), ("c", "2")], "page string, content string")
    assert rows(E.new_pages(new, old)) == [("a", "1", "created"), ("b", "1", "same"), ("c", "1", "conflict")]
    m = E.metadata(new)
    assert m.first() == E.metadata(new.repartition(3)).first() and m.first()["characters"] == 3


def test_a_deep_tree_is_whole(spark):
    tree = {}
    for i in range(12, 0, -1):
        tree = {f"l{i}": {"components": [str(i)], "children": tree}}
    df = spark.createDataFrame([(1, json.dumps(tree))], "tree long, value string")
    assert sorted(r["depth"] for r in J.module_rows(df).collect()) == list(range(1, 13))


SOURCES = {
    "a.py": ("python", 'import os\n\nclass Base(Root, metaclass=Meta):\n    """Says so."""\n    def run(self, x: Box, *rest, key=(1, 2)) -> Lid:\n        def inner():\n            return 1\n        from pkg.mod import thing\n        return self.helper(x) + os.path.join(x)\n\n    class Deep:\n        pass\n\ndef free(a, b=[1, 2]):\n    \'short\'\n    return Base(a)\n'),
    "b.java": ("java", "import java.util.List;\npublic class Car extends Vehicle implements Wheeled, Driven<Road> {\n    public void go(Engine e, Map<String, Part> m) {\n        new Horn(e).blow();\n    }\n}\ninterface Wheeled {\n}\n"),
    "c.ts": ("typescript", "export class View extends Panel implements Shown {\n}\nexport const load = (x: Item) => render(x)\nfunction draw(a: Shape) {\n  return new Brush(a)\n}\n"),
    "d.rs": ("rust", "pub struct Tank {\n    a: u8,\n}\npub trait Swim: Move + Float {\n}\npub fn dive(t: &Tank) -> Depth {\n    water::sink(t)\n}\n"),
    "e.cs": ("csharp", "public class Bird : Animal, IFly\n{\n    public void Sing(Song s)\n    {\n        Play(s);\n    }\n}\n"),
    "f.rb": ("ruby", "class Dog < Pets::Animal\n  def bark(loud)\n    shout(loud)\n  end\nend\n"),
    "g.go": ("go", "type Box struct {\n}\nfunc (b *Box) Open(k Key) error {\n\treturn unlock(k)\n}\n"),
}


def test_declarations_of_many_languages(spark):
    files = spark.createDataFrame([(p, lang, t) for p, (lang, t) in SOURCES.items()], "relative_path string, language string, content string")
    found = D.components(files)
    got = {r["id"]: r for r in found.collect()}
    assert set(got) == {
        "a.py::Base", "a.py::Base.run", "a.py::Base.Deep", "a.py::free", "b.java::Car", "b.java::Car.go", "b.java::Wheeled", "c.ts::View", "c.ts::load", "c.ts::draw", "d.rs::Tank", "d.rs::Swim", "d.rs::dive", "e.cs::Bird", "e.cs::Bird.Sing",
        "f.rb::Dog", "f.rb::Dog.bark", "g.go::Box", "g.go::Box.Open",
    }
    assert {k: r["base_classes"] for k, r in got.items() if r["base_classes"]} == {
        "a.py::Base": ["Root"], "b.java::Car": ["Driven", "Vehicle", "Wheeled"], "c.ts::View": ["Panel", "Shown"], "d.rs::Swim": ["Float", "Move"], "e.cs::Bird": ["Animal", "IFly"], "f.rb::Dog": ["Pets.Animal"],
    }
    params = {k: r["parameters"] for k, r in got.items() if r["parameters"]}
    assert params == {
        "a.py::Base.run": ["self", "x: Box", "*rest", "key=(1, 2)"], "a.py::free": ["a", "b=[1, 2]"], "b.java::Car.go": ["Engine e", "Map<String, Part> m"], "c.ts::load": ["x: Item"], "c.ts::draw": ["a: Shape"], "d.rs::dive": ["t: &Tank"],
        "e.cs::Bird.Sing": ["Song s"], "f.rb::Dog.bark": ["loud"], "g.go::Box.Open": ["k Key"],
    }
    assert (got["a.py::Base"]["docstring"], got["a.py::free"]["docstring"], got["a.py::Base.run"]["docstring"]) == ('"""Says so."""', "'short'", None)
    spans = {k: (r["start_line"], r["end_line"], r["component_type"]) for k, r in got.items()}
    assert spans["a.py::Base"] == (3, 12, "class") and spans["a.py::Base.run"] == (5, 9, "method") and spans["b.java::Car"] == (2, 6, "class") and spans["b.java::Car.go"] == (3, 5, "method")
    assert spans["e.cs::Bird"] == (1, 7, "class") and spans["f.rb::Dog"] == (1, 5, "class") and spans["f.rb::Dog.bark"] == (2, 4, "method") and spans["c.ts::load"] == (3, 3, "function")
    refs = {(r["owner"], r["name"], r["kind"]) for r in D.references(found).collect()}
    assert {
        ("a.py::Base.run", "self.helper", "call"), ("a.py::Base.run", "os.path.join", "call"), ("a.py::Base.run", "thing", "import"), ("a.py::Base.run", "Box", "type"), ("a.py::Base.run", "Lid", "type"), ("a.py::Base", "Root", "base"),
        ("a.py::free", "Base", "call"), ("b.java::Car.go", "Horn", "call"), ("b.java::Car", "Vehicle", "base"), ("c.ts::draw", "Shape", "type"), ("d.rs::dive", "water::sink", "call"), ("d.rs::dive", "Tank", "type"), ("e.cs::Bird.Sing", "Play", "call"),
        ("b.java::Car.go", "Engine", "type"),
    } <= refs


MATRIX = {
    "service.py": "def run(x):\n    return x\n", "Service.java": "class Service { void run() {} }\n", "app.js": "function run(x) { return x; }\n", "app.ts": "function run(x: number) { return x; }\n",
    "main.go": "package main\nfunc run(x int) int { return x }\n", "main.rs": "fn run(x: i32) -> i32 { x }\n", "main.c": "int run(int x) { return x; }\n", "main.cpp": "int run(int x) { return x; }\n",
    "Program.cs": "class Program { void Run() {} }\n", "Main.kt": "fun run(x: Int): Int = x\n", "index.php": "<?php function run($x) { return $x; }\n", "lib.rb": "def run(x)\n  x\nend\n", "Main.scala": "def run(x: Int): Int = x\n",
}


def test_every_language_has_its_function(spark):
    files = spark.createDataFrame(list(MATRIX.items()), "relative_path string, content string").withColumn("language", P.language(F.col("relative_path")))
    got = {r["id"]: r for r in D.components(files).collect()}
    assert {k.split("::")[0] for k in got} == set(MATRIX) and len({r["language"] for r in got.values()}) == 13
    for path in MATRIX:
        (name,) = {k.split("::")[1] for k in got if k.startswith(path) and k.lower().endswith("run")}
        kind = got[f"{path}::{name}"]["component_type"]
        assert kind == ("method" if "." in name else "function"), path
        if "x" in MATRIX[path].split("run", 1)[-1].split(")")[0].lower():
            assert len(got[f"{path}::{name}"]["parameters"]) == 1, path


def test_variables_and_bodiless_members(spark):
    sources = {
        "a.js": "const callback = () => 1;\nconst value = 1;\nlet late = async function (x) { go(x); };\n", "b.ts": "const callback = (value: number) => value;\nconst value: number = 1;\n",
        "c.go": "type Runner interface {\n    Run() error\n    Stop(now bool)\n}\nfunc (s *Service) Execute() error {\n    return helper()\n}\n",
        "d.rs": "pub struct Service;\n\ntrait Runner {\n    fn run(&self) -> i32;\n}\nimpl Service {\n    pub fn execute(&self) -> i32 {\n        helper()\n    }\n}\nimpl Runner for Service {\n    fn run(&self) -> i32 { helper() }\n}\nfn helper() -> i32 { 1 }\n",
        "e.kt": "class Small(val x: Int) : Base(x), Named\nclass Large {\n    val p = 1\n    fun go() = other()\n}\nfun interface One { fun only() }\n", "f.cpp": "struct P { int x; };\nint A::h(int z) { return g(z); }\nnamespace n { class A : public B { int f() const { return 1; } A() {} }; }\n",
    }
    files = spark.createDataFrame(list(sources.items()), "relative_path string, content string").withColumn("language", P.language(F.col("relative_path")))
    found = D.components(files)
    assert {r["id"]: r["component_type"] for r in found.collect()} == {
        "a.js::callback": "function", "a.js::value": "variable", "a.js::late": "function", "b.ts::callback": "function", "b.ts::value": "variable", "c.go::Runner": "interface", "c.go::Runner.Run": "method", "c.go::Runner.Stop": "method",
        "c.go::Service.Execute": "method", "d.rs::Service": "struct", "d.rs::Runner": "trait", "d.rs::Runner.run": "method", "d.rs::Service.execute": "method", "d.rs::Service.run": "method", "d.rs::helper": "function",
        "e.kt::Small": "class", "e.kt::Large": "class", "e.kt::Large.p": "property", "e.kt::Large.go": "method", "e.kt::One": "interface", "e.kt::One.only": "method",
        "f.cpp::P": "struct", "f.cpp::A.h": "method", "f.cpp::n": "namespace", "f.cpp::A": "class", "f.cpp::A.f": "method",
    }
    refs = {(r["owner"], r["name"]) for r in D.references(found).collect()}
    assert {("d.rs::Service.execute", "helper"), ("d.rs::Service.run", "helper"), ("d.rs::Service", "Runner"), ("c.go::Service.Execute", "helper"), ("e.kt::Large.go", "other"), ("e.kt::Small", "Base"), ("f.cpp::A.h", "g")} <= refs
    assert not {o for o, n in refs if n == "helper"} - {"d.rs::Service.execute", "d.rs::Service.run", "c.go::Service.Execute"}


def test_comments_and_strings_declare_and_call_nothing(spark):
    sources = {
        "a.py": 'def top():\n    """def no(): helper(1)"""\n    # class No: helper(2)\n    s = "def no2(): helper(3)" + \'}\'\n    return real("(")\n\nclass A:\n    def m(self):\n        def inner():\n            deep()\n        return top()\n',
        "b.rs": "/* outer /* fn no() {} */ fn no2() {} */\nfn yes<'a>(c: &'a str) -> char { let x = '{'; let r = r#\"fn no3() { \"#; go(x) }\nfn last() { }\n",
        "c.java": 'class K { String s = "class No {"; // class No2 {\n  char c = \'}\';\n  @Deprecated(since = "x") int f(int a) { return g(a); }\n  K() { h(); }\n}\n',
    }
    files = spark.createDataFrame(list(sources.items()), "relative_path string, content string").withColumn("language", P.language(F.col("relative_path")))
    found = D.components(files)
    spans = {r["id"]: (r["start_line"], r["end_line"]) for r in found.collect()}
    assert spans == {"a.py::top": (1, 5), "a.py::A": (7, 11), "a.py::A.m": (8, 11), "b.rs::yes": (2, 2), "b.rs::last": (3, 3), "c.java::K": (1, 5), "c.java::K.f": (3, 3)}
    refs = {(r["owner"], r["name"]) for r in D.references(found).where("kind = 'call'").collect()}
    # innermost: nothing of a method belongs to its class
    assert refs == {("a.py::top", "real"), ("a.py::A.m", "deep"), ("a.py::A.m", "top"), ("b.rs::yes", "go"), ("c.java::K.f", "g"), ("c.java::K", "h")}


def plain_split(text):
    out, start, depth = [], 0, {"(": 0, "[": 0, "<": 0}
    for i, c in enumerate(text):
        if c in depth:
            depth[c] += 1
        elif c in ")]>":
            k = "([<"[")]>".index(c)]
            depth[k] = max(0, depth[k] - 1)
        elif c == "," and not any(depth.values()):
            out.append(text[start:i])
            start = i + 1
    return [x for x in (y.strip() for y in [*out, text[start:]]) if x]


def test_parameters_split_at_any_depth(spark):
    chance = random.Random(6)
    texts = ["".join(chance.choice("ab, ()[]<>\n\u00e9") for _ in range(chance.randint(0, 40))) for _ in range(400)] + ["(" * 50 + "a,b" + ")" * 50 + ",c", "", " , ,"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", D.split_parameters(F.col("t")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: plain_split(t) for i, t in enumerate(texts)}


def test_walk_with_nested_ignore_files(spark, tmp_path):
    for path, text in {
        ".gitignore": "*.log\n!keep.log\n/only_top.py\nout/\ndocs/**/draft.py\n# note\n\\#odd.py\ntrail.py   \n", "a.py": "", "x.log": "", "keep.log": "", "only_top.py": "", "sub/only_top.py": "", "out/z.py": "", "sub/out": "", "docs/draft.py": "", "docs/a/b/draft.py": "", "docs/final.py": "",
        "#odd.py": "", "trail.py": "", "sub/.gitignore": "!*.log\nt[ae]st.py\ndeep/\n", "sub/y.log": "", "sub/test.py": "", "sub/tast.py": "", "sub/tost.py": "", "sub/deep/q.py": "", "sub/more/.ignore": "!tast.py\n", "sub/more/tast.py": "", ".hidden/h.py": "", ".dot.py": "", "sub.py": "",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    walk = lambda **o: [r["relative_path"] for r in tree.files(spark, str(tmp_path), **o).orderBy("walk").collect()]
    assert walk() == ["a.py", "docs/final.py", "keep.log", "sub/more/tast.py", "sub/only_top.py", "sub/out", "sub/tost.py", "sub/y.log", "sub.py"]
    assert "x.log" in walk(gitignore=False) and ".dot.py" not in walk(gitignore=False)


def test_outlines_and_contracts(spark):
    data = [(1, ["b"], ["x.py::B", "lone"]), (1, ["a"], []), (1, ["a", "z"], ["x.py::K.m", "x.py::A", "y.py::C"]), (1, ["a", "c"], [])]
    df = spark.createDataFrame(data, "tree long, path array<string>, ids array<string>")
    assert prompts.outline(df, "z").first()["outline"] == "a\n  Children:\n    c\n    z (current module)\n      x.py: K.m, A\n      y.py: C\nb\n  lone\n  x.py: B"
    assert prompts.outline(df, components=False).first()["outline"] == "a\n  Children:\n    c\n    z\nb"
    assert len(prompts.CONTRACTS) == 14
    prompts.checked("cluster", {"component_ids"})
    for kind, given, scope in (("cluster", {"scope"}, "repo"), ("cluster", {"component_ids"}, "module"), ("user", {"module_name", "module_tree"}, "repo"), ("routing_user", {"orphans"}, "repo"), ("stale_fix_system", {"page"}, "repo"), ("none", set(), "repo")):
        with pytest.raises(ValueError):
            prompts.checked(kind, given, scope)


def test_prompts_are_strict(spark):
    df = spark.createDataFrame([("N" * 50, "R")], "n string, r string")
    out = prompts.rendered("{name} in {region}", {"name": F.col("n"), "region": F.col("r")}, "name", 20)
    assert df.select(out).first()[0] == "N" * 15 + " in R"
    with pytest.raises(ValueError, match="missing"):
        prompts.rendered("{name} {x}", {"name": F.col("n")})
    with pytest.raises(ValueError, match="unknown"):
        prompts.rendered("{name}", {"name": F.col("n"), "y": F.col("r")})


def test_command_line(spark, tmp_path, capsys):
    root, out = tmp_path / "r", str(tmp_path / "o")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    assert cli.main(["analyze", str(root), out]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["counts"]["components"] == 2
    (root / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 2\n")
    cli.main(["analyze", str(root), out, "--snapshot", "2"])
    capsys.readouterr()
    assert cli.main(["plan", out, "1", "2"]) == 0
    said = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert said["changes"] == {"modified_body": 1} and said["outcome"] == "full_fallback"
    assert cli.main(["plan", str(tmp_path / "no"), "1", "2"]) == 1


def test_a_saved_tree_loads_as_it_was(spark):
    kept = [(1, ["a"], ["x", "y"]), (1, ["a", 'q"\\é'], []), (1, ["a", 'q"\\é', "漢/["], ["1"]), (1, ["b"], []), (2, ["a]"], ["z"]), (None, ["n"], ["m"])]
    given = [*kept[:1], kept[0], (1, ["a", 'q"\\é', "漢/["], ["1", "1"]), *kept[3:], (1, [], ["lost"]), (3, None, ["lost"])]
    saved = J.tree_documents(spark.createDataFrame(given, "tree long, path array<string>, components array<string>"))
    got = {(r["tree"], *r["path"]): r["components"] for r in J.module_rows(saved).collect()}
    assert got == {(t, *p): c for t, p, c in kept} and saved.count() == 3
    assert J.tree_documents(saved.select("tree", F.array("value").alias("path"), F.array("value").alias("components")).limit(0)).count() == 0
