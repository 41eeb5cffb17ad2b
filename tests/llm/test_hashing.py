import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from repoweave.llm import decontaminate
from repoweave.llm import vecwords as V
from repoweave.llm.linedup import common_blocks, patience
from repoweave.llm.minhash import super_minhash
from repoweave.llm.packing import first_fit_decreasing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB9é \n\t-", max_size=12)), max_size=6))
def test_words_of_a_batch(texts):
    for kind, pattern in ((V.SPACED, "[^\x20\x09-\x0d]+"), (V.ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        seen = {}
        for a, b, data, offsets in V.chunks(pa.array(texts, pa.string()), 8):
            starts, ends, owner = V.spans(data, offsets, kind)
            hashes = V.hashes(data, starts, ends)
            got = [[] for _ in range(b - a)]
            for s, e, o, h in zip(starts, ends, owner, hashes, strict=True):
                word = bytes(data[s:e]).decode()
                got[o].append(word)
                assert seen.setdefault(word, h) == h
            low = {c: c + 32 for c in range(65, 91)}
            assert got == [re.findall(pattern, (t or "").translate(low)) for t in texts[a:b]]
        assert len(set(seen.values())) == len(seen)


def test_signatures_estimate_similarity():
    chance = np.random.default_rng(2)
    for share in (0.3, 0.8, 0.9):
        found = []
        for _ in range(40):
            n, both = 200, round(400 * share / (1 + share))
            x = chance.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = x[:n], x[n - both :]
            sig = super_minhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 128)
            found.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(found) - share) < 0.02
        assert np.std(found) < np.sqrt(share * (1 - share) / 128) * 1.15


def test_signatures_of_small_sets_take_every_step():
    for n in (1, 2, 5):
        x = np.arange(n, dtype=np.uint64) + np.uint64(9)
        a = super_minhash(x, np.array([0, n, n]), 64)
        assert (a[0] < np.uint64(64 << 48)).all() and (a[1] == np.uint64(2**64 - 1)).all()
        if n == 1:
            assert sorted((a[0] >> np.uint64(48)).tolist()) == list(range(64))
        assert (super_minhash(x[::-1].copy(), np.array([0, n]), 64)[0] == a[0]).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=10), st.lists(st.integers(0, 5), max_size=10))
def test_patience_blocks_are_common_and_ordered(a, b):
    last = (0, 0)
    for i, j, n in patience(a, b):
        assert a[i : i + n] == b[j : j + n] and i >= last[0] and j >= last[1]
        last = (i + n, j + n)
    if set(a) & set(b):
        assert patience(a, b)


def test_moved_and_doubled_blocks_go():
    early = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    late = np.array([4, 5, 6, 9, 1, 2, 3, 8, 4, 5, 6], np.uint64)
    counts = np.full(11, 10, np.int32)
    assert common_blocks(early, late, counts, 30) == [(0, 3), (4, 7), (8, 11)]
    assert common_blocks(early, late, counts, 31) == []


def test_a_passage_that_moved_past_short_shared_lines_goes():
    passage, footer = 1, 2
    late = np.array([footer, 8, passage], np.uint64)
    assert common_blocks(np.array([passage, footer, 7], np.uint64), late, np.array([1, 1, 60], np.int32), 30) == [(2, 3)]
    late = np.array([footer, 8, 3, 4, 5, 9, 6], np.uint64)  # the passage's lines are short, too
    assert common_blocks(np.array([3, 4, 5, footer, 7, 6], np.uint64), late, np.array([2, 3, 20, 5, 5, 1, 2], np.int32), 30) == [(2, 5)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12), st.lists(st.integers(1, 6), min_size=1, max_size=12), st.integers(1, 9))
def test_blocks_are_all_common_runs(a, b, most):
    words = [0, 1, 2, 3, 1, 5, 9]
    want = set()
    for j in range(len(b)):
        for n in range(1, len(b) - j + 1):
            if sum(words[x] for x in b[j : j + n]) >= most and any(a[i : i + n] == b[j : j + n] for i in range(len(a) - n + 1)):
                want |= set(range(j, j + n))
    got = common_blocks(np.array(a, np.uint64), np.array(b, np.uint64), np.array([words[x] for x in b], np.int32), most)
    assert {x for s, e in got for x in range(s, e)} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.one_of(st.integers(0, 300), st.integers(0, 1 << 31)), min_size=1, max_size=20), max_size=8))
def test_lists_of_places_are_decoded(lists):
    place = np.array([x for part in lists for x in sorted(part)], np.int64)
    n = np.array([len(x) for x in lists], np.int64)
    coded = decontaminate._coded(place, np.concatenate(([0], np.cumsum(n))).astype(np.int64))
    assert decontaminate._decoded(coded, n).tolist() == place.tolist()


def test_first_fit_decreasing_is_first_fit():
    chance = random.Random(3)
    for _ in range(50):
        sizes = [chance.randint(1, 50) for _ in range(chance.randint(0, 60))]
        bins, want = [], [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((k for k, free in enumerate(bins) if free >= sizes[i]), None)
            if at is None:
                at = len(bins)
                bins.append(64)
            want[i] = (at, 64 - bins[at])
            bins[at] -= sizes[i]
        assert first_fit_decreasing(sizes, 64) == want


