import fnmatch
import random
import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repoweave.functions import pages as X
from repoweave.functions import paths as P
from repoweave.operators.changes import lcs_similarity


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_globs(spark):
    patterns = ["*.py", "a/*", "?b", "[a-c]x", "[!a]x", "[!]-", "[]-$]", "a[b", "[z-a]", "[!z-a]", "*[.]c", "./a/b", "a-?", "[a-", "[^b]c", "x[a\\\\]"]
    texts = ["a.py", "a/b", "a/b.py", "ab", "bx", "ax", "]x", "[!]-", "a[b", "", "z", "x.c", "bc", "ac", "a-b", "[a-", "]", "$", "-"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        got = {r["t"] for r in rows.where(F.col("t").rlike(P.glob_regex(p))).collect()}
        assert got == {t for t in texts if fnmatch.fnmatchcase(t, p.replace("\\", "/").removeprefix("./").replace("[^", "[!"))}, p


@settings(max_examples=200, deadline=None)
@given(st.text("ab/.*?c-", max_size=8), st.text("ab/.c-", max_size=8))
def test_glob_is_shell_matching(pattern, text):
    assert bool(re.match(P.glob_regex(pattern), text)) == fnmatch.fnmatchcase(text, pattern.removeprefix("./"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 2 * table[-1][-1] / (len(a) + len(b)) if a or b else 1.0
    assert lcs_similarity(pd.Series([a]), pd.Series([b]))[0] == want


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/x.py", "a/node_modules/x.js", "b/Dockerfile", "db/schema.sql", "k.tsx", "noext", "tests/test_a.py")], "p string")
    got = {r["p"]: (r["l"], r["c"], r["s"]) for r in rows.select("p", P.language(F.col("p")).alias("l"), P.artifact_class(F.col("p")).alias("c"), P.skipped(F.col("p"), exclude=["tests"]).alias("s")).collect()}
    assert got == {
        "a/x.py": ("python", None, False), "a/node_modules/x.js": ("javascript", None, True), "b/Dockerfile": (None, "container", False), "db/schema.sql": (None, "schema", False),
        "k.tsx": ("typescript", None, False), "noext": (None, None, False), "tests/test_a.py": ("python", "test_infra", True),
    }


def test_page_ids(spark):
    assert one(spark, P.page_id("w", F.col("p")), p=["Core", "Io-1"]) == "w:core:io-1:start"
    assert one(spark, F.array(P.is_session_id(F.col("t")), P.is_change_id(F.col("t")), P.is_safe_path(F.col("t")), P.is_wiki_id(F.col("t")), P.is_module_name(F.col("t"))), t="a" * 40 + ".." + "B" * 40) == [False, True, True, False, False]
    assert one(spark, F.array(P.is_safe_path(F.lit("/x")), P.is_safe_path(F.lit("a/../b")), P.is_safe_path(F.col("t")), P.is_module_name(F.col("t")), P.is_session_id(F.col("t"))), t="a..b") == [False, False, True, False, False]
    for bad in (["_x"], ["a__b"], ["ä"], ["a b"], []):
        assert one(spark, P.page_id("w", F.col("p")), p=bad) is None


def test_pages(spark):
    text = "== One ==\nsome words here\n  code line\n* item\n<code>x y</code> 漢字 tail\n=== odd ==\n"
    assert one(spark, X.headings(F.col("t")), t=text) == ["one"]
    assert tuple(one(spark, X.prose_counts(F.col("t")), t=text)) == (3 + 1 + 1, 2)
    assert tuple(one(spark, X.prose_counts(F.col("t")), t="a <code>\nhidden\n</code> b\n<nowiki> c\nnever closed")) == (2, 0)
    assert one(spark, X.visible(F.col("t")), t="[[a|b c]] [[d]] ''e'' %%f%% **g** //h// <sub>i</sub> 1 < 2") == "b c d   g h i 1 < 2"
    assert one(spark, X.wiki_links(F.col("t")), t="[[a:b|x]] [[c#d]] <code>[[no]]</code>") == ["a:b", "c"]
    assert one(spark, X.escaped(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, X.unquoted(F.col("t")), t="a%20b+c") == "a b+c"
    long = "x" * 1000
    cut = one(spark, X.truncated(F.col("t"), 100), t=long)
    assert len(cut) == 400 and X.MARKER in cut
    assert one(spark, X.truncated(F.col("t"), 3), t=long) == "x" * 12
    assert one(spark, X.is_generic_label(F.col("t")), t=" Module!") and not one(spark, X.is_generic_label(F.col("t")), t="Parser")


def _plain_shown(text):
    """text without the union of the ranges of each kind of block, found one after the other."""
    cut = [False] * len(text)
    for kind in ("code", "file", "nowiki"):
        at = 0
        while (s := text.find(f"<{kind}", at)) >= 0:
            at = s + len(kind) + 1
            if text[at : at + 1] and text[at] not in " \t\n\f\r>":
                continue
            body = text.find(">", at)
            end = text.find(f"</{kind}>", body) if body >= 0 else -1
            at = len(text) if end < 0 else end + len(kind) + 3
            cut[s:at] = [True] * (at - s)
    return "".join(c for c, gone in zip(text, cut, strict=True) if not gone)


def test_blocks_of_several_kinds_overlap(spark):
    chance = random.Random(3)
    parts = ["<code>", "<code x>", "</code>", "<file>", "<file", "</file>", "<nowiki>", "</nowiki>", "<coder>", "a", "b c", " ", ">", "<nowiki"]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 14))) for _ in range(600)]
    texts += ["<code>a<file>b</code>c</file>d", "<file>" + "<code>x</code>" * 30000 + "</file>end", "x" * 100 + "<code> y </code>" * 20000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.shown_source(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"].replace("\x01", "") for r in got} == {i: _plain_shown(t) for i, t in enumerate(texts)}
