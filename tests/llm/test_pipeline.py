import os
import random
import re
import subprocess
import sys
import zlib

import duckdb
import pytest
from test_corpus_operators import alnum, components, plain_line_dedup, spaced

import corpus_pipeline
from repoweave.llm import oracle, queries
from repoweave.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= last
            last = docs.count()
    assert docs.select("doc_id").distinct().count() == last


def test_stages_take_no_documents_and_odd_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "x"), (1, "", "en", "s", 0, 2, "y"), (2, "some words here", "en", "s", 15, 3, None), (2, "some words here", "en", "s", 15, 3, None)], docs.schema.simpleString()[7:-1].replace(":", " ") + ", k int, label string")
    for given, rows in ((odd.limit(0), 0), (odd, None)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            assert name == "packing" or out.columns == given.columns
            assert out.count() == rows if rows is not None else out.count() <= 4


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = c.sql(oracle.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(x) for x in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key)


def test_the_whole_pipeline_against_plain_stages(spark, tmp_path):
    """run() on a small corpus against each stage in plain Python: what stays, its text, and its tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    chance = random.Random(13)
    letters = {"en": "abcdefg", "fr": "hijéklm", "de": "nopßqrs"}
    word = lambda g: "".join(chance.choice(letters[g]) for _ in range(chance.randint(3, 7)))
    line = lambda g, n: " ".join(word(g) for _ in range(n))
    passage, known = line("en", 45), [line("en", 20), line("fr", 30)]
    rows = []
    for i in range(150):
        g = ["en", "fr", "de"][i % 3]
        text = "\n".join(line(g, chance.randint(8, 40)) for _ in range(chance.randint(1, 4)))
        if i % 10 == 4:
            text = f"{line(g, 12)}\n{passage}\n{line(g, 9)}"
        elif i % 10 == 7:
            text = rows[i - 3][1]
        elif i % 10 == 8:
            w = rows[i - 6][1].split(" ")
            w[len(w) // 2] = word(g)
            text = " ".join(w)
        elif i % 15 == 11:
            text = f"{text} {known[i % 2]}"
        rows.append((i, text, g if i % 5 else None, "s", len(text)))
    rows += [(150, None, "en", "s", None), (151, "12 !", "en", "s", 4), (152, "", None, "s", 0), (153, "数字数字数字数字 数字", None, "s", 11)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", known[0]), ("b", known[1])], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    texts = {i: t for i, t, *_ in rows[:150]}  # the others have no letter, or none that a language has
    gone = plain_line_dedup(texts)
    cut = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in texts.items()}
    cut = {i: t for i, t in cut.items() if spaced(t)}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, t in cut.items() for w in [spaced(t)]}
    same = components(sets, 80, 100)
    left = {i: t for i, t in cut.items() if same[i] == i}
    windows = {tuple(w[j : j + 13]) for t in known for w in [alnum(t)] for j in range(len(w) - 12)}
    clean = {}
    for i, t in left.items():
        w = alnum(t)
        hit = {x for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for x in range(j, j + 13)}
        if not hit or 20 * len(hit) < len(w):
            clean[i] = t
    assert len(texts) > len(cut) > len(left) > len(clean)
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in clean.items():
        ids = [*encode.encode(t, add_special_tokens=False).ids, 2]
        want.add((i, 0, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)), len(ids)))
    got = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_lines_are_cut_once(spark):
    """A filter above the Python function that cuts would run it a second time, and hold a second worker for each task."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.line_dedup(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bArrowEvalPython", plan)) == 1


_LEFT = """
import random, re
import public_tokenizers
import pyarrow as pa
from repoweave.llm import packing

def taken():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

chance = random.Random(1)
words = ["".join(chance.choices("abcdefghijklmnop", k=chance.randint(3, 9))) for _ in range(60_000)]
text = pa.array([" ".join(chance.choices(words, k=500)) for _ in range(1000)])
batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(range(1000), pa.int64()), text], ["o", "k", "text"])
run = packing._pieces(public_tokenizers.path("word_bpe_49k.json"), 4096, 2)
before = taken()
most = max(taken() for _ in run(iter([batch])))
print(before, most, taken())
"""


def test_a_worker_gives_its_memory_back_between_tasks():
    """What a packing task took, mostly its tokenizer and texts, isn't kept by the worker that waits for the next one."""
    env = os.environ | {"PYTHONPATH": f"{os.path.dirname(corpus_pipeline.__file__)}:{os.environ.get('PYTHONPATH', '')}"}
    out = subprocess.run([sys.executable, "-c", _LEFT], env=env, capture_output=True, text=True, check=True, timeout=300)
    before, most, after = map(float, out.stdout.split()[-3:])
    assert most > before + 50 and after - before < 0.5 * (most - before), out.stdout
