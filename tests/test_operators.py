from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from repoweave.operators import changes as D
from repoweave.operators import components as C
from repoweave.operators import diagrams as DG
from repoweave.operators import folds as O
from repoweave.operators import graph as G
from repoweave.operators import modules as M
from repoweave.operators import pages as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ambiguous_names_have_no_edge(spark):
    parts = [(f"f{i}.py::helper", "helper", None, "python") for i in range(32)] + [("u.py::unique", "unique", None, "python"), ("m.py::main", "main", None, "python")]
    comps = spark.createDataFrame(parts, "id string, name string, qualified_name string, language string")
    refs = spark.createDataFrame([(1, "m.py::main", "python", "helper"), (2, "m.py::main", "python", "pkg.unique"), (3, "u.py::unique", "python", "unique"), (4, "m.py::main", "go", "unique")], "ref long, owner string, language string, name string")
    assert rows(C.resolved(refs, comps)) == [(2, "u.py::unique"), (4, "u.py::unique")]


def test_raw_names_and_their_last_parts_resolve(spark):
    parts = [("src/x.py::Foo", "Foo", None, "python"), ("src/y.py::Foo", "Foo", None, "python"), ("src/z.py::run", "run", "K.run", "python"), ("m.py::main", "main", None, "python")]
    comps = spark.createDataFrame(parts, "id string, name string, qualified_name string, language string")
    names = ["src/x.py::Foo", "a::b::c::run", "pkg.mod.cls.run", "K.run", "a::b.c::d.run", "x.Foo"]
    refs = spark.createDataFrame([(i, "m.py::main", "python", n) for i, n in enumerate(names)], "ref long, owner string, language string, name string")
    assert rows(C.resolved(refs, comps)) == [(0, "src/x.py::Foo"), (1, "src/z.py::run"), (2, "src/z.py::run"), (3, "src/z.py::run"), (4, "src/z.py::run")]


def test_two_names_resolve_to_the_other(spark):
    names = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, key string")
    refs = spark.createDataFrame([("a", "a", "x"), ("c", "c", "x")], "ref string, owner string, key string")
    assert rows(C.unique_matches(refs, names, ["key"])) == [("a", "b")]


def test_candidates_below_the_threshold_stay(spark):
    comps = spark.createDataFrame([("a", "class"), ("b", "class"), ("f", "function")], "id string, component_type string")
    edges = spark.createDataFrame([("a", "b")], "caller string, callee string")
    assert rows(C.candidates(comps, edges)) == [("a",), ("b",)]
    assert rows(C.candidates(comps, edges, reduction=2)) == [("a",)]


def test_builtin_names(spark):
    names = [("python", "a.list"), ("go", "list"), ("rust", "std::Vec"), ("java", "Int"), (None, "self"), (None, "Int"), ("c", "x.NULL"), ("ruby", "to_s")]
    df = spark.createDataFrame(names, "language string, name string")
    assert sorted(r["name"] for r in C.without_builtins(df).collect()) == ["Int", "list"]


def test_artifact_units(spark):
    data = [("package.json", "manifest", '{"scripts":{"b":"x","a":"y"}}'), ("Makefile", "build", "all: x\n\ty\nall:\nz-1 :\n"), ("Dockerfile", "container", "FROM a\nRUN x\nFROM b AS c\n"), (".github/workflows/c.yml", "ci", "jobs:\n  test:\n    x: 1\n"), ("x", "script", "")]
    assert rows(C.artifact_units(spark.createDataFrame(data, "path string, class string, content string"))) == [(".github/workflows/c.yml", "test"), ("Dockerfile", "stage_1"), ("Dockerfile", "stage_2"), ("Makefile", "all"), ("Makefile", "z-1"), ("package.json", "a"), ("package.json", "b")]


def test_names_of_a_language_go_before_all(spark):
    """The language's index has whole and simple names; without a language's match the whole name counts, never the simple one."""
    parts = [("a.py::Box", "Box", "pkg.a.Box", "python"), ("b.go::Box", "Box", "b.Box", "go"), ("c.go::Crate", "Crate", "m::Crate", "go"), ("d.rs::Only", "Only", "x:Only", "rust"), ("m.py::main", "main", None, "python")]
    comps = spark.createDataFrame(parts, "id string, name string, qualified_name string, language string")
    names = [("m.py::main", "python", "Box"), ("m.py::main", "python", "pkg.a.Box"), ("m.py::main", "python", "Crate"), ("m.py::main", "python", "m::Crate"), ("m.py::main", "ruby", "Box"), ("a.py::Box", "python", "Box"), ("m.py::main", "python", "Only"), ("m.py::main", "python", "zz.")]
    refs = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "ref long, owner string, language string, name string")
    assert rows(C.resolved(refs, comps)) == [(0, "a.py::Box"), (1, "a.py::Box"), (2, "c.go::Crate"), (3, "c.go::Crate"), (5, "b.go::Box"), (6, "d.rs::Only")]


def test_references_travel_once_for_each_key(spark):
    comps = spark.createDataFrame([("i1", "x::run", None, "go"), ("i2", "run", "a.run", "py"), ("i2", "run", "a.run", "rs"), ("i3", "stop", "b.stop", "py")], "id string, name string, qualified_name string, language string")
    names = [("o", "go", "run"), ("o", "c", "run"), ("i2", "c", "run"), ("o", "c", "q::stop"), ("o", None, "stop"), ("o", "py", None), ("o", "c", "a.b::run"), (None, "rs", "run")]
    refs = spark.createDataFrame([(i, *n) for i, n in enumerate([*names, names[0]])], "ref long, owner string, language string, name string")
    out = C.resolved(refs.union(refs), comps)
    assert rows(out) == [(0, "i1"), (1, "i2"), (2, "i1"), (3, "i3"), (4, "i3"), (6, "i2"), (7, "i2"), (8, "i1")]
    # one join with what is known of a key, for a reference once with each of its different keys
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_budget_whatever_the_batch(spark):
    import random

    chance = random.Random(8)
    data = [(chance.randint(0, 60), chance.choice(["a", "b", None]), chance.choice([chance.randint(0, 40), 500, None])) for _ in range(200)]
    files = spark.createDataFrame(data, "path long, class string, size long").coalesce(1)
    order = sorted(range(len(data)), key=lambda i: (data[i][0], i))
    left, room, want = 700, {}, []
    for i in order:
        p, c, n = data[i]
        ok = n is not None and n <= left and room.get(c, 0) < 12
        if ok:
            left, room[c] = left - n, room.get(c, 0) + 1
        want.append((p, str(c), str(n), ok))
    now = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in ("1", "3", "130"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            got = O.within_budget(files, per_class=12, most=700).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", now)
        assert sorted((r["path"], str(r["class"]), str(r["size"]), r["included"]) for r in got) == sorted(want)


def test_budget_goes_on_after_a_large_file(spark):
    files = spark.createDataFrame([(1, "a", 5), (2, "a", 90), (3, "b", 5), (4, "a", 1), (5, "a", 1)], "path long, class string, size long")
    got = {r["path"]: r["included"] for r in O.within_budget(files, per_class=2, most=11).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_budget_like_a_plain_walk(spark):
    import random

    chance = random.Random(4)
    data = [(i, chance.choice("abc"), chance.randint(0, 40)) for i in range(300)]
    left, room, want = 900, {}, {}
    for p, c, n in data:
        want[p] = n <= left and room.get(c, 0) < 15
        if want[p]:
            left, room[c] = left - n, room.get(c, 0) + 1
    got = O.within_budget(spark.createDataFrame(data, "path long, class string, size long"), per_class=15, most=900)
    assert {r["path"]: r["included"] for r in got.collect()} == want


def test_snapshot_kinds_and_fallback(spark):
    kind = "id string, signature string, body string, depends_on array<string>"
    old = spark.createDataFrame([("a", "s", "x", ["q"]), ("b", "s", "x", []), ("c", "s", "x", [])], kind)
    new = spark.createDataFrame([("a", "s", "y", ["r"]), ("b", "t", "y", []), ("d", "s", "x", [])], kind)
    changes = D.snapshot_diff(old, new)
    assert rows(changes) == [("added", "d"), ("deleted", "c"), ("edge_changes", "a"), ("modified_body", "a"), ("modified_interface", "b")]
    assert rows(D.active(changes)) == [("a",), ("b",), ("d",)]
    assert D.fallback(D.change_ratios(changes, new.select("id"))).first()["outcome"] == "full_fallback"
    same = D.snapshot_diff(old, old)
    assert D.fallback(D.change_ratios(same, old.select("id"))).first()["outcome"] == "no_change"


def test_changed_edges_are_structural(spark):
    kind = "id string, signature string, body string, depends_on array<string>"
    old = spark.createDataFrame([(f"c{i}", "s", "x", ["q"]) for i in range(20)], kind)
    new = old.withColumn("depends_on", F.when(F.substring("id", 2, 2).cast("int") < 7, F.array(F.lit("r"))).otherwise(F.col("depends_on")))
    assert D.fallback(D.change_ratios(D.snapshot_diff(old, new), new.select("id"))).first().asDict() == {"active": 7, "structural": 7, "total": 20, "active_ratio": 0.35, "structural_ratio": 0.35, "outcome": "full_fallback"}


def test_renames_are_greedy_and_one_to_one(spark):
    pairs = spark.createDataFrame([("a", "x", 0.99), ("a", "y", 1.0), ("b", "y", 0.98), ("b", "x", 0.97), ("c", "x", 0.96)], "old_id string, new_id string, similarity double")
    assert rows(D.renames(pairs)) == [("a", "y", 1.0), ("b", "x", 0.97)]


def test_rename_pairs_against_all_pairs(spark):
    import random

    chance = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    base = [[chance.choice(words) for _ in range(30)] for _ in range(6)]
    old = [(f"o{i}", "f", "en", " ".join(b)) for i, b in enumerate(base)]
    new = []
    for i in range(30):
        b = list(base[i % 6])
        for _ in range(chance.randint(0, 3)):
            b[chance.randrange(len(b))] = chance.choice(words)
        new.append((f"n{i}", "f", "en", " ".join(b)))
    import pandas as pd

    want = {(o[0], n[0]) for o in old for n in new if D.lcs_similarity(pd.Series([o[3].split()]), pd.Series([n[3].split()]))[0] >= 0.95}
    kind = "id string, component_type string, language string, body string"
    got = D.rename_pairs(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind))
    assert {(r[0], r[1]) for r in got.collect()} == want


def test_many_tied_renames_are_all_found(spark):
    pairs = [(f"o{i:03}", f"n{j:03}", 0.97) for i in range(70) for j in range(60)] + [("p1", "m1", 0.96), ("p1", "m2", 0.96), ("p2", "m1", 0.96), ("o000", "m2", 0.95)]
    used, want = set(), []
    for o, n, x in sorted(pairs, key=lambda r: (-r[2], r[0], r[1])):
        if o not in used and n not in used:
            used |= {o, n}
            want.append((o, n, x))
    assert rows(D.renames(spark.createDataFrame(pairs, "old_id string, new_id string, similarity double"))) == sorted(want)


def test_copies_are_renamed_one_to_one(spark):
    import random

    chance = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [[chance.choice(words) for _ in range(n)] for n in (1, 3, 20, 200)]
    old, new = [], []
    for side, ids in ((old, "o"), (new, "n")):
        for i in range(40):
            b = list(base[i % 4])
            if i % 3 == 0:
                b[chance.randrange(len(b))] = chance.choice(words)
            side.append((f"{ids}{i:02}", "f", None if i % 4 == 3 else "en", " ".join(b)))
        side += [(f"{ids}x{i:02}", "f", "en", " ".join(base[2])) for i in range(60)] + [(f"{ids}e", "f", "en", ""), (f"{ids}z", "f", "en", None)]
    import pandas as pd

    pairs = []
    for o in old:
        for n in new:
            x, y = (o[3] or "").split(), (n[3] or "").split()
            if x and y and o[2] == n[2]:
                alike = D.lcs_similarity(pd.Series([x]), pd.Series([y]))[0]
                pairs += [(o[0], n[0], round(alike, 6))] if alike >= 0.95 else []
    used, want = set(), []
    for o, n, x in sorted(pairs, key=lambda r: (-r[2], r[0], r[1])):
        if o not in used and n not in used:
            used |= {o, n}
            want.append((o, n, x))
    kind = "id string, component_type string, language string, body string"
    assert rows(D.renamed(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind))) == sorted(want)


def test_route_ties_and_share(spark):
    edges = spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "1"), ("d", "9"), ("d", "8"), ("e", "9")], "id string, dependency string")
    pages = spark.createDataFrame([("1", "q"), ("2", "p")], "dependency string, page string")
    assert rows(D.route(edges, pages, "top")) == [("c", "p"), ("d", "top"), ("e", "top")]


def test_hunks(spark):
    hunks = spark.createDataFrame([(1, "a", 250, 600), (2, "a", 10, 10)], "hunk long, path string, first long, last long")
    spans = spark.createDataFrame([("x", "a", 1, 10), ("y", "a", 255, 700), ("z", "b", 1, 999)], "id string, path string, start long, end long")
    assert rows(D.hunks_on(hunks, spans)) == [(1, "y"), (2, "x")]


def test_owners(spark):
    files = spark.createDataFrame([("./core/io/x.py",), ("core.py",), ("corex/y",), ("z",)], "file string")
    modules = spark.createDataFrame([("m1", "core", 1), ("m2", "/core/io/", 2), ("m3", "core/io", 2), ("m4", ".", 0)], "module string, prefix string, depth int")
    assert rows(M.boundary_owner(files, modules)) == [("./core/io/x.py", "m3"), ("core.py", "m1")]
    owned = spark.createDataFrame([("i", "b", 2, "b"), ("i", "a", 2, "a"), ("i", "t", 1, "0")], "id string, module string, depth int, path string")
    assert rows(M.deepest_owner(owned)) == [("i", "a")] and rows(M.last_owner(owned)) == [("i", "b")]


def test_post_order(spark):
    paths = [["a"], ["a", "b"], ["a", "b", "c"], ["a", "a2"], ["b"]]
    df = spark.createDataFrame([(p,) for p in paths], "path array<string>")
    assert [r["path"] for r in df.orderBy(M.post_order_key(F.col("path"))).collect()] == [["a", "a2"], ["a", "b", "c"], ["a", "b"], ["a"], ["b"]]


def test_hops_and_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "caller string, callee string")
    starts = spark.createDataFrame([("c",)], "id string")
    assert rows(G.within_hops(edges, starts, 3)) == [("c", "a", 1), ("c", "b", 2), ("c", "c", 3)]
    drawn = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("q", "a", "b"), ("q", "b", "a")], "page string, a string, b string")
    assert rows(G.simple_paths(drawn, 2)) == [("p",)]


def test_target_graphs_against_a_scan(spark):
    """Edges scanned in order, the set growing as it goes; then the walk, both in plain Python."""
    import random

    chance = random.Random(5)
    modules = [f"m{i}" for i in range(8)] + [f"m{i} / s{j}" for i in range(8) for j in range(3)]
    edges = sorted({(chance.choice(modules), chance.choice(modules)) for _ in range(30)})
    edges = [e for e in edges if e[0] != e[1]]
    want, paths = set(), {}
    for target in modules:
        chosen = {m for m in modules if m == target or m.startswith(target + " / ")}
        for a, b in edges:
            if a in chosen or b in chosen:
                chosen |= {a, b}
        want |= {(target, m) for m in chosen}
        inside = [e for e in edges if e[0] in chosen and e[1] in chosen]
        starts = sorted(chosen - {b for _, b in inside})
        path, at = [], starts[0] if starts else None
        while at is not None:
            path.append(at)
            at = next((b for a, b in inside if a == at and b not in path), None)
        if len(path) < 2:
            path = sorted((m for m in modules if m == target or m.startswith(target + " / ")), key=lambda m: m.split(" / "))[:8]
        paths[target] = path
    m = spark.createDataFrame([(x,) for x in modules], "module string")
    e = spark.createDataFrame(edges, "src string, dst string")
    found = G.target_subgraph(m, m.select(F.col("module").alias("target")), e)
    assert {tuple(r) for r in found.select("target", "module").collect()} == want
    assert {r["target"]: r["path"] for r in G.primary_paths(found, e).collect()} == paths


def test_deep_trees_are_whole(spark):
    trees = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, f"x{i}") for i in range(12)], "id string, parent string, name string")
    got = {r["id"]: (r["depth"], len(r["path"])) for r in M.flattened(trees).collect()}
    assert got == {f"n{i}": (i + 1, i + 1) for i in range(12)}


def test_clusters_go_into_the_tree(spark):
    members = spark.createDataFrame([(["a"], "1")], "path array<string>, id string")
    groups = spark.createDataFrame([(["a", "b"], "y", "2"), (["a", "b"], "x", "2"), (["a", "b"], "x", "9"), ([], "top", "3")], "parent array<string>, module string, id string")
    known = spark.createDataFrame([(["a", "b"], "2"), ([], "3")], "parent array<string>, id string")
    got = M.applied_clusters(members, groups, known, groups.select("parent").distinct())
    assert sorted(("/".join(r["path"]), r["id"]) for r in got.collect()) == [("a", "1"), ("a", "2"), ("a/b", "2"), ("a/b/x", "2"), ("top", "3")]
    flat = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "b"), ("g2", "c"), ("g3", "c"), ("g4", "zz"), ("g4", "d")], "parent string, module string")
    tops = spark.createDataFrame([(x,) for x in "abcde"], "module string")
    assert rows(M.super_groups(flat, tops)) == [("g1", "a"), ("g1", "b")]
    assert rows(M.super_groups(flat.where("parent = 'g3'"), tops)) == []


def test_reviews(spark):
    data = [("a", True, None, None, None), ("b", True, "retain_leaf", "low", " "), ("c", True, "split", "low", "x"), ("d", False, "retain_leaf", "low", "x"), ("e", True, "retain_leaf", "high", "x"), ("f", False, "split", "high", "x")]
    df = spark.createDataFrame(data, "leaf string, is_leaf boolean, decision string, risk string, reason string")
    assert rows(M.review_check(df)) == [("a", "missing"), ("b", "empty reason"), ("c", "mismatched decision"), ("d", "mismatched decision"), ("e", "high-risk leaf")]


def test_edit_log(spark):
    ops = [("p", 1, "insert", "", "one", 0), ("p", 2, "insert", "", "two", 99), ("p", 3, "replace", "one", "1", 0), ("p", 4, "undo", "", "", 0), ("p", 5, "replace", "x", "y", 0), ("q", 1, "undo", "", "", 0)]
    got = {r["page"]: tuple(r)[1:] for r in O.edit_log(spark.createDataFrame(ops, "page string, seq long, kind string, old string, new string, line long")).collect()}
    assert got == {"p": ("one\n\ntwo", 4, 2), "q": ("", 0, 0)}


def test_undo_goes_back_through_all_changes(spark):
    import random

    chance = random.Random(2)
    ops, want = [], {}
    for page in ("p", "q", None):
        text, past = "", []
        for seq in range(60):
            kind, new, line = chance.choice(["insert", "insert", "replace", "undo"]), chance.choice(["a", "b\nc", "xy", ""]), chance.randint(-1, 5)
            old = chance.choice(["a", "b", "xy", "zz"])
            ops.append((page, seq, kind, old, new, line))
            if kind == "undo":
                text = past.pop() if past else text
            elif kind == "insert":
                lines = text.split("\n")
                at = min(max(line, 0), len(lines))
                past.append(text)
                text = "\n".join([*lines[:at], new, *lines[at:]])
            elif text.count(old) == 1:
                past.append(text)
                text = text.replace(old, new)
        want[page] = (text, len(past))
    chance.shuffle(ops)
    df = spark.createDataFrame(ops, "page string, seq long, kind string, old string, new string, line long").repartition(3)
    assert {r["page"]: (r["content"], r["undoable"]) for r in O.edit_log(df).collect()} == want


def test_sessions(spark):
    now = datetime(2024, 1, 1, tzinfo=UTC)
    data = [(i, "u", now - timedelta(minutes=i)) for i in range(30)] + [(99, "v", now - timedelta(hours=3))]
    got = O.kept_sessions(spark.createDataFrame(data, "id long, owner string, ts timestamp"), now)
    assert sorted(r["id"] for r in got.collect()) == list(range(10))


def test_page_checks(spark):
    pages = spark.createDataFrame([("a", "[[b]] [[z]]"), ("b", "")], "page string, content string")
    found = W.links(pages)
    assert rows(W.broken_links(found, pages.select("page"))) == [("a", "z")]
    assert rows(W.page_differences(pages.select("page"), spark.createDataFrame([("b",), ("c",)], "page string"))) == [("a", "missing"), ("c", "extra")]
    tree = spark.createDataFrame([("b", "a"), ("c", "a"), ("a", None)], "page string, parent string")
    assert rows(W.unlinked_children(tree, found)) == [("a", "c")]


PAGE = """== Purpose ==
Plain words here_1 and [[wiki:a|a label]] ''code here'' **bold**
  * listed words
> quoted
  indented words
<code python>
hidden words
== No ==
</code> after it <sub>low</sub>
<mermaid>
graph TD
 A[Store] --> B
 B -->|x| C
 %% A --> Z
 C[Build it]; --> A
 subgraph S --> T
 D((alone))
</mermaid>
中文 mixed词 end
=== Data flow ===
==== ====
"""


def test_prose_and_diagrams_of_a_page(spark):
    pages = spark.createDataFrame([("p", PAGE, False, True), ("q", "<mermaid>\nsequenceDiagram\nparticipant U\nU->>V: hello\nV-->>U: re\n</mermaid>\n<mermaid>", True, False), ("r", "text", False, False)], "page string, content string, is_leaf boolean, is_overview boolean")
    from repoweave.functions import pages as X

    p = pages.where("page = 'p'").select(X.prose_counts(F.col("content")).alias("c"), X.headings(F.col("content")).alias("h"), X.wiki_links(F.col("content")).alias("l"), X.title(F.col("content"), F.lit("-")).alias("t")).first()
    # Plain words here_1 and a label bold | after it low | mixed end
    assert (p["c"]["words"], p["c"]["cjk"], p["h"], p["l"], p["t"]) == (12, 3, ["purpose", "no", "data flow"], ["wiki:a"], "Purpose")
    assert rows(DG.nodes(pages.where("page = 'p'"))) == [("p", "A", "Store"), ("p", "B", "B"), ("p", "C", "Build it"), ("p", "D", "alone")]
    assert rows(DG.edges(pages.where("page = 'p'"))) == [("p", "A", "B"), ("p", "B", "|x| C"), ("p", "C", "A")]
    assert rows(DG.edges(pages.where("page = 'q'"))) == [("q", "U", "V"), ("q", "V", "U")]
    labels = spark.createDataFrame([("p", "store"), ("q", "U")], "page string, label string")
    got = {r["page"]: r for r in DG.quality(pages, labels).collect()}
    assert (got["p"]["nodes"], got["p"]["edges"], got["p"]["grounded_nodes"], got["p"]["grounded_edges"], got["p"]["disconnected"], got["p"]["support"]) == (4, 3, 1, 2, 1, 1)
    assert got["p"]["issues"] == ["ungrounded diagram", "support nodes"] and got["p"]["has_path"] and got["p"]["verdict"] == "fail"
    assert (got["q"]["blocks"], got["q"]["balanced"], got["q"]["issues"], got["q"]["verdict"]) == (1, False, ["unbalanced"], "warning")
    assert got["r"]["issues"] == ["no diagram", "few nodes", "few edges", "no path"]


def test_chains_may_end_where_they_were(spark):
    drawn = lambda *lines: "<mermaid>\nflowchart LR\n" + "\n".join(lines) + "\n</mermaid>"
    data = [("ring", drawn("a --> b", "b --> c", "c --> a")), ("star", drawn("a --> b", "a --> c", "a --> d")), ("pair", drawn("a --> b")), ("loop", drawn("a --> b", "b --> a", "c --> a")), ("self", drawn("a[x] --> a"))]
    pages = spark.createDataFrame([(p, c, False, True) for p, c in data], "page string, content string, is_leaf boolean, is_overview boolean")
    got = {r["page"]: r["has_path"] for r in DG.quality(pages, spark.createDataFrame([], "page string, label string")).collect()}
    assert got == {"ring": True, "star": False, "pair": True, "loop": True, "self": True}


def test_quality_reads_pages_once_and_dense_diagrams_in_time(spark, tmp_path):
    n = 150
    dense = "\n".join(f"n{i} --> n{j}" for i in range(n) for j in range(n))
    data = [("dense", f"<mermaid>\n{dense}\n</mermaid>", False, True), ("odd", "<mermaid>\n;; --> x\nx --> y\ny --> z\n`;;`\n</mermaid>", False, True), ("null", None, False, False)]
    spark.createDataFrame(data, "page string, content string, is_leaf boolean, is_overview boolean").write.parquet(f"{tmp_path}/pages")
    out = DG.quality(spark.read.parquet(f"{tmp_path}/pages"), spark.createDataFrame([("dense", "n1")], "page string, label string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r["page"]: r for r in out.collect()}
    near = sum(str(i).startswith("1") for i in range(n))  # their texts have the label's
    assert (got["dense"]["nodes"], got["dense"]["edges"], got["dense"]["grounded_nodes"], got["dense"]["has_path"]) == (n, n * n, near, True)
    assert got["dense"]["grounded_edges"] == n * n - (n - near) ** 2
    assert (got["odd"]["nodes"], got["odd"]["edges"], got["null"]["blocks"], got["null"]["nodes"]) == (3, 3, None, 0)


def test_assessment(spark):
    words = "word " * 160
    data = [("good", True, False, f"== Purpose ==\n{words}\n== Usage ==\nsee a.py Main"), ("bad", True, False, "== Module location ==\n== Source files ==\n== Key components ==\n== Integration notes ==\nfew words"), ("cjk", True, False, "== 目的 ==\n== 架构 ==\n" + "字" * 600), ("void", False, True, "  \n")]
    pages = spark.createDataFrame(data, "page string, is_leaf boolean, is_overview boolean, content string")
    anchors = pages.where("page in ('good', 'bad')").select("page", "content", F.lit("a.py::Main").alias("id"), F.lit("Main").alias("symbol"), F.lit("a.py").alias("path"))
    required = spark.createDataFrame([("good", "x"), ("bad", "x")], "page string, target string")
    found = spark.createDataFrame([("good", "x")], "page string, target string")
    got = {r["page"]: r for r in W.assessed(pages, anchors, required, found, DG.quality(pages, spark.createDataFrame([], "page string, label string"))).collect()}
    assert got["good"]["errors"] == [] and got["good"]["valid"] and (got["good"]["grounded"], got["good"]["areas"]) == (1, 2)
    assert got["bad"]["errors"] == ["short", "ungrounded", "few areas", "template", "no link to x"] and got["bad"]["boilerplate"]
    assert (got["cjk"]["mode"], got["cjk"]["prose"], got["cjk"]["floor"], got["cjk"]["errors"]) == ("cjk", 600, 500, [])
    assert got["void"]["errors"][:3] == ["empty", "short", "few areas"] and got["void"]["role"] == "repository_overview"
    total = W.report(W.assessed(pages, anchors, required, found, DG.quality(pages, spark.createDataFrame([], "page string, label string")))).first()
    assert (total["pages"], total["valid_pages"], total["explanatory"], total["all_valid"]) == (4, 2, 2, False)


def test_claims(spark):
    groups = spark.createDataFrame([("g2", "a"), ("g1", "a"), ("g2", "b"), ("g3", "zz")], "module string, id string")
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(M.claims(groups, known)) == [("g1", "a"), ("g2", "b")]
