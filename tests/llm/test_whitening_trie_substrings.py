"""Whitening, prefix trie and substring deduplication against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest

from repoweave.llm import substrings, trie, whitening
from repoweave.llm.vecwords import CHUNK_BYTES

# ---- whitening


def plain_whitening(vectors, count=16):
    width = max((len(v) for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)), default=0)
    kept = [i for i, v in enumerate(vectors) if width and v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in vectors[i]) for i in kept}
    fit = np.array(sorted(set(x.values())), np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    z = (fit - fit.min(0)).astype(float)
    z -= z.mean(0)
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    mean = (fit - fit.min(0)).astype(float).mean(0)
    far = {i: sum((n * v - s) ** 2 for v, s in zip(x[i], sums, strict=True)) for i in kept}
    white = {i: ((np.array(x[i]) - fit.min(0)) - mean) @ axes / np.sqrt(np.maximum(values, 1e-300)) for i in kept}
    return n, far, white, values / max((z**2).sum() / n, 1e-300)


def vectors_of(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n string")


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((300, 24)) * np.linspace(3, 1, 24)).astype(np.float32).tolist()
    rows += [rows[0]] * 40 + [None, [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0] * 5, []]
    n, far, white, explained = plain_whitening(rows)
    got = {r["row"]["vec_id"]: r for r in whitening.whitened(vectors_of(spark, rows)).collect()}
    assert set(got) == set(far) and got[0]["row"]["n"] == "x"
    flip = np.sign([a * b for a, b in zip(got[0]["whitened"], white[0], strict=True)])
    for i, r in got.items():
        assert r["n"] == n == 300 and r["deviation"] == Decimal(far[i])
        assert np.allclose(np.array(r["whitened"]) * flip, white[i], atol=1e-8)
        assert np.allclose(r["explained"], explained, rtol=1e-10) and r["identity_error"] < 1e-10


@pytest.mark.parametrize("rows, size", [([], 0), ([None, []], 0), ([[1.0, 2.0]], 2), ([[1.0, 2.0], [1.0, 2.0], [3.0, 2.0]], 2)])
def test_whitening_of_few_vectors(spark, rows, size):
    got = whitening.whitened(vectors_of(spark, rows)).collect()
    assert len(got) == sum(bool(r) for r in rows)
    for r in got:
        assert len(r["whitened"]) == size
        if len(rows) == 1:
            assert r["whitened"] == [None, None] and r["explained"] == [0.0, 0.0] and r["deviation"] == 0
        else:
            assert abs(abs(r["whitened"][0]) - 1) < 1e-12 and r["whitened"][1] is None and r["explained"] == pytest.approx([1.0, 0.0])


def test_deviation_is_exact_beyond_longs(spark):
    rows = [[0.0, 0.0], [3.0e7, -3.0e7], [1.0, 5.0], [2.0e7, 2.0]]
    _, far, _, _ = plain_whitening(rows)
    assert max(far.values()) > 2**63
    assert {r["row"]["vec_id"]: r["deviation"] for r in whitening.whitened(vectors_of(spark, rows)).collect()} == {i: Decimal(v) for i, v in far.items()}


@pytest.mark.parametrize("size, spectrum", [(300, "falling"), (300, "flat"), (120, "ties"), (40, "rank"), (1, "falling"), (16, "flat")])
def test_jacobi_davidson(size, spectrum):
    rng = np.random.default_rng(size)
    values = {"falling": 0.9 ** np.arange(size), "flat": 1 + rng.random(size) / 5, "ties": np.repeat([5.0, 3.0, 1.0], size // 3) if size > 2 else np.ones(size), "rank": np.r_[[4.0, 2.0, 1.0], np.zeros(max(size - 3, 0))][:size]}[spectrum]
    axes = np.linalg.qr(rng.standard_normal((size, size)))[0]
    matrix = axes * values @ axes.T
    products = []
    found, vectors = whitening.leading_pairs(lambda b: products.append(b.shape) or matrix @ b, size, 16)
    k = min(size, 16)
    assert np.allclose(found, np.sort(values)[::-1][:k], atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * values.max()
    assert all(b <= 4 * 16 + 4 for _, b in products)


def test_unsettled_residuals_are_an_error():
    rng = np.random.default_rng(1)
    with pytest.raises(RuntimeError):
        whitening.leading_pairs(lambda b: rng.standard_normal(b.shape), 30, 4)


# ---- trie


def plain_trie(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in talks.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])  # as in SQL, a remainder has the sign of c
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    words = lambda p: len([w for w in p[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if p else 0
    under = {}
    for p in sorted(members, key=len, reverse=True):
        below = [under[x] for x in children[p]]
        under[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[p]) - 1) * words(p))
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), under[p][0], under[p][1],
            hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == p))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def trie_rows(spark, rows, ranges):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, words int")
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(r[c] for c in names) for r in trie.nodes(trie.rebuilt(trie.sequences(df)), ranges).collect())


@pytest.mark.parametrize("seed, ranges", [(1, 1), (2, 3), (3, 16), (4, 40)])
def test_trie_equals_brute_force(spark, seed, ranges):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, 120):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 2, 3, 6, 12])):
            # few texts, so that prefixes, whole talks and long runs of equal talks cross the cuts
            rows.append((c, turn if turn else None, rng.choice(["user", None]) if rng.random() < 0.1 else "user", rng.choice(["a b", "a b", "a b", "c", " \t", "", None])))
    rows += [(None, 1, "user", "x"), (7000, 3, "u", "long " * 50_000)]
    assert trie_rows(spark, rows, ranges) == plain_trie(rows)


def test_trie_of_equal_and_of_no_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(400, 700) for t in range(5)]
    assert trie_rows(spark, rows, 13) == plain_trie(rows)
    assert trie_rows(spark, [], 4) == []
    turnless = [(c, 0, "u", "x") for c in range(21, 40)]  # their base is missing: those with h of 1 or more lose their only turn
    assert trie_rows(spark, turnless, 3) == plain_trie(turnless)


def test_minima_find_every_extent():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 100):
        values = rng.integers(-1, 6, n)
        table = trie.Minima(values)
        for i in range(n):
            for d in range(-1, 7):
                r = i
                while r + 1 < n and values[r + 1] >= d:
                    r += 1
                l = i
                while l and values[l] >= d:
                    l -= 1
                one = np.array([i]), np.array([d])
                assert (table.before(*one)[0], table.after(*one)[0]) == (l, r)
                assert table.least(np.array([l]), np.array([r]))[0] == values[l : r + 1].min()


# ---- substrings


def plain_substrings(rows, width=20):
    """Rows (doc_id, text) -> {(doc_id, text): (n_words, n_removed, kept)}; repeated rows count once."""
    docs = {r: (r[1] or "").encode().split() for r in rows}
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for r in order:
        w = docs[r]
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.setdefault(key, (r, i))
        out[r] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def substring_rows(spark, rows, width=20, bucket_words=substrings.BUCKET_WORDS):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ends string").repartition(3)
    got = substrings.deduplicated(df, width, bucket_words=bucket_words).collect()
    assert all(r["row"]["ends"] == "x" for r in got) and len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed, width", [(1, 20), (2, 4), (3, 2), (4, 7)])
def test_substrings_equal_brute_force(spark, seed, width):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6 if width < 10 else 40)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(5, 70))] for _ in range(8)]
    rows = []
    for i in range(90):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        rows.append((i * 3 % 91, rng.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(1000, "a " * 300), (1001, "a " * 45 + "b"), (None, "a " * 25), (1002, None), (1003, ""), (1004, " \n "), (1005, "A a " * 30), rows[5], rows[5], (1006, rows[5][1])]
    want = plain_substrings(rows, width)
    for r in substring_rows(spark, rows, width, bucket_words=50):
        key = (r["row"]["doc_id"], next(t for d, t in rows if d == r["row"]["doc_id"]))
        n, removed, kept = want[key]
        assert (r["n_words"], r["n_removed"], r["text"]) == (n, removed, kept if key[1] is not None else None), key


def test_substrings_in_long_texts_and_none(spark):
    rng = random.Random(9)
    long = " ".join(f"x{rng.randint(0, 10**6)}" for _ in range(CHUNK_BYTES // 7 + 1000))
    assert len(long) > CHUNK_BYTES
    words = long.split()
    rows = [(2, "new " + " ".join(words[-500:]) + " end"), (1, long), (3, " ".join(words[1000:1019])), (4, " ".join(words[1000:1020]))]
    want = plain_substrings(rows)
    got = {(r["row"]["doc_id"]): (r["n_words"], r["n_removed"], r["text"]) for r in substring_rows(spark, rows)}
    assert got == {k[0]: v for k, v in want.items()} and got[2][2] == "new end" and got[3][1] == 0 and got[4][2] == ""
    assert substring_rows(spark, []) == []
    with pytest.raises(ValueError):
        substrings.repeats(spark.createDataFrame([], "doc_id long, text string"), width=1)
