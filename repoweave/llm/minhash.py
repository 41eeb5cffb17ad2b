"""Near-duplicate grouping with SuperMinHash.

Each element of a set spends one random permutation of the signature's slots:
in step j it offers the value (j, random) to the j-th slot of its permutation.
The ranks within an element are thereby correlated, which lowers the variance,
and a document is ready as soon as each slot holds a value of a finished step.

Stages: signatures and an exact digest of every distinct shingle set; banding;
each bucket's sets against one representative, then what that left unlinked
against the rest of its bucket. A pair is first compared by signatures, and
confirmed on the full sets if these leave it possible. Components of the
confirmed links. Copies share a digest and enter once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, bounded_batches, keyed, lean, salted_join, stored
from .components import components
from .vecwords import SPACED, chunks, hashes, mix, shingle_sets, spans

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SPARSE_STEPS = 4


def super_minhash(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """The signatures (sets x slots) of consecutive runs of distinct elements; an empty set's is all ones."""
    n_sets = len(bounds) - 1
    sig = np.full(n_sets * slots, np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))
    live, state = np.arange(len(elements)), elements
    picks, held, dense = [], [], None
    for j in range(slots):
        if not len(live):
            break
        word = mix(state + np.uint64((j + 1) * int(_GOLD) % 2**64))
        pick = (j + (word & np.uint64(0xFFFFFF)).astype(np.int64) % (slots - j)).astype(np.int32)
        if j < _SPARSE_STEPS:  # what stands at a place: its own number, unless an earlier step put another there
            slot, own = pick.copy(), np.full(len(live), j, np.int32)
            for p, h in zip(picks, held, strict=True):
                slot = np.where(p == pick, h, slot)
                own = np.where(p == j, h, own)
            picks.append(pick)
            held.append(own)
        else:
            if dense is None:
                dense = np.tile(np.arange(slots, dtype=np.int32 if slots > 32767 else np.int16), (len(live), 1))
                rows = np.arange(len(live))
                for i, (p, h) in enumerate(zip(picks, held, strict=True)):
                    dense[rows, i], dense[rows, p] = dense[rows, p], h
            rows = np.arange(len(live))
            slot = dense[rows, pick].astype(np.int32)
            dense[rows, pick] = dense[:, j]
        np.minimum.at(sig, owner[live] * slots + slot, np.uint64(j << 48) | (word >> np.uint64(16)))
        ready = sig.reshape(n_sets, slots).max(axis=1) < np.uint64((j + 1) << 48)
        if ready.any():
            keep = ~ready[owner[live]]
            if not keep.all():
                live, state = live[keep], state[keep]
                picks, held = [p[keep] for p in picks], [h[keep] for h in held]
                dense = None if dense is None else dense[keep]
    return sig.reshape(n_sets, slots)


def _sets(texts, width: int):
    """(first row, last row, elements, bounds) for each chunk of texts."""
    for a, b, data, offsets in chunks(texts):
        starts, ends, owner = spans(data, offsets, SPACED)
        yield (a, b, *shingle_sets(hashes(data, starts, ends), owner, b - a, width))


#: Sets (and elements) that a task compares with each other at a time.
BLOCK = 256
_MOST_ELEMENTS = 1 << 20


def bands_of(slots: int, bands: int, rows: int) -> np.ndarray:
    """The slots of each band (bands x rows): cut from permutations of all slots, so that bands of one permutation share none."""
    chance, each = np.random.default_rng(17), slots // rows
    return np.concatenate([chance.permutation(slots)[: each * rows].reshape(each, rows) for _ in range(-(-bands // each))])[:bands]


def _signed(width: int, slots: int, bands: int, rows: int):
    picked = bands_of(slots, bands, rows)

    @lean
    def run(batches):
        for batch in batches:
            sizes, digests, keys, sigs = [], [], [], []
            for a, b, flat, bounds in _sets(batch.column("text"), width):
                sig = super_minhash(flat, bounds, slots)
                band = np.tile(np.arange(bands, dtype=np.uint64), (b - a, 1))
                for r in range(rows):
                    band = mix(band + sig[:, picked[:, r]] * _GOLD + np.uint64(r))
                full = np.diff(bounds) > 0
                keys += [x.astype(np.int64).tolist() if n else [] for x, n in zip(band, full.tolist(), strict=True)]
                sigs += [x.tobytes() if n else None for x, n in zip(mix(sig).astype(np.uint8), full.tolist(), strict=True)]
                sizes += np.diff(bounds).tolist()
                digests += [hashlib.blake2b(flat[s:e].tobytes(), digest_size=16).hexdigest() if e > s else None for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("o"), batch.column("k"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["o", "k", "n_shingles", "digest", "bands", "sig"],
            )

    return run


def _shingled(width: int):
    @lean
    def run(batches):
        for batch in batches:
            out = []
            for _, _, flat, bounds in _sets(batch.column("text"), width):
                out += [flat[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("places"), pa.array(out, pa.binary())], ["digest", "places", "elements"])

    return run


def least_equal(t: float, slots: int) -> int:
    """So many slots of two sets of similarity t are equal, but for a chance of some 2e-8 (5.5 standard deviations)."""
    return max(0, math.floor(slots * t - 5.5 * math.sqrt(slots * t * (1 - t))))


def _likely(slots: int, least: int):
    """Rows of two signatures -> a, b of those with enough equal slots."""

    @lean
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, slots) for c in ("sig", "other"))
            ok = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    return run


def _likely_blocks(slots: int, least: int, num: int, den: int):
    """Rows of an item (side 0 and 1: digest, label, block, size, sig), item by item -> the pairs of blocks (x, y) with a pair over the sides that can be linked and isn't."""

    def pairs(rows):
        sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
        if not all(sides):
            return set()
        sig = [np.frombuffer(b"".join(r[5] for r in x), np.uint8).reshape(-1, slots) for x in sides]
        size = [np.array([r[4] for r in x]) for x in sides]
        out = set()
        for i, r in enumerate(sides[0]):
            ok = (sig[1] == sig[0][i]).sum(axis=1) >= least
            ok &= den * np.minimum(size[1], r[4]) >= num * np.maximum(size[1], r[4])
            out |= {(min(r[3], q[3]), max(r[3], q[3])) for q in (sides[1][j] for j in np.flatnonzero(ok).tolist()) if q[2] != r[2]}
        return out

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["x", "y"])

    @lean
    def run(batches):
        item, rows = None, []
        for batch in batches:
            out = set()
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("item", "side", "digest", "label", "block", "size", "sig")), strict=True):
                if key != item:
                    out |= pairs(rows)
                    item, rows = key, []
                rows.append(row)
            yield table(sorted(out))
        yield table(sorted(pairs(rows)))

    return run


def _edges(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["a", "b"])


def _linked(sets: list[np.ndarray], split: int, num: int, den: int):
    """A spanning forest of the links den*|A&B| >= num*|A|B| between the first `split` sets and the others, or among all sets if there are no others."""
    n = len(sets)
    crossed = split < n
    sizes = np.array([len(s) for s in sets], np.int64)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    value, who = flat[order], owner[order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    run = np.cumsum(new) - 1
    out = []
    # one row of the table of common elements at a time: memory stays linear
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(value))
    at = np.empty(len(flat), np.int64)
    at[order] = run
    first = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(split):
        groups = at[first[i] : first[i + 1]]
        lengths = end[groups] - begin[groups]
        if not len(groups) or lengths.max() < 2:
            continue
        places = np.repeat(begin[groups] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(who[places], minlength=n)
        common[: split if crossed else i + 1] = 0
        for j in np.flatnonzero(den * common >= num * (sizes[i] + sizes - common)).tolist():
            a, b = root(i), root(j)
            if common[j] and a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _verified(num: int, den: int):
    def edges(rows):
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        split = sum(1 for r in rows if r[1] == 0)
        found = _linked([np.frombuffer(r[2], np.uint64) for r in rows], split, num, den) if split else []
        return [(rows[i][0], rows[j][0]) for i, j in found]

    @lean
    def run(batches):
        left, item = [], None
        for batch in batches:
            out = []
            for key, side, digest, elements in zip(*(batch.column(c).to_pylist() for c in ("item", "side", "digest", "elements")), strict=True):
                if key != item:
                    out += edges(left)
                    left, item = [], key
                left.append((digest, side, elements))
            yield _edges(out)
        yield _edges(edges(left))

    return run


def _compared(docs: DataFrame, sets: DataFrame, places: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """places (digest, item, side) -> the links (a, b) between the sides of each item, or in it if it has side 0 alone; enough of them to connect what is linked.

    Each text moves once, its elements once for each of its places.
    """
    needed = places.groupBy("digest").agg(F.collect_list(F.struct("item", "side")).alias("places"))
    needed = needed.join(sets.select("digest", "at.o", "at.k"), "digest")
    shingled = docs.join(needed, ["o", "k"]).dropDuplicates(["o", "k"]).select("digest", "places", "text").mapInArrow(_shingled(width), "digest string, places array<struct<item:string,side:int>>, elements binary")
    items = shingled.select("digest", F.explode("places").alias("p"), "elements").select("p.item", "p.side", "digest", "elements")
    return stored(items.repartition("item").sortWithinPartitions("item").mapInArrow(_verified(num, den), "a string, b string"), "links")


def _parts() -> Column:
    """So many parts keep each to BLOCK sets and _MOST_ELEMENTS elements, about."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / _MOST_ELEMENTS))


def _with_one(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places for pairs (a, b) with few b: a b's pairs are one item, or several with b in each."""
    pairs = stored(pairs, "pairs")
    parts = pairs.join(sets.select(F.col("digest").alias("a"), "size"), "a").groupBy("b").agg(_parts().alias("parts"))
    placed = salted_join(pairs, parts, ["b"], F.col("a"), salts=4).select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part"))
    item = F.concat_ws("/", "b", "part")
    places = placed.select(F.col("a").alias("digest"), item.alias("item"), F.lit(1).alias("side"))
    return places.union(parts.select(F.col("b").alias("digest"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "b").select("digest", item.alias("item"), F.lit(0).alias("side")))


def _blocks(sets: DataFrame, some: DataFrame, homes: DataFrame) -> DataFrame:
    """some (digest), homes (digest, home) -> digest, block, size, sig: sets of one home in blocks of bounded number and size."""
    some = some.join(homes, "digest").join(sets.select("digest", "size", "sig"), "digest")
    parts = some.groupBy("home").agg(_parts().alias("parts"))
    return stored(salted_join(some, parts, ["home"], F.col("digest"), salts=4).select("digest", F.concat_ws("/", "home", F.pmod(F.xxhash64("digest"), "parts")).alias("block"), "size", "sig"), "blocks")


def _with_blocks(block: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places for pairs of blocks (x, y): each pair is an item with both blocks' sets as sides, or one block's."""
    items = pairs.distinct().withColumn("item", F.concat_ws("|", "x", "y"))
    sides = items.select(F.col("x").alias("block"), "item", F.lit(0).alias("side")).union(items.where("x <> y").select("y", "item", F.lit(1)))
    return block.join(sides, "block").select("digest", "item", "side")


def near_duplicates(
    docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, slots: int = 128, bands: int = 42, rows: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs -> doc_id, n_shingles, component_id, kept, first, o, k for each row; (o, k) is its key in `keyed`.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased; a
    document's set has its distinct `width`-word shingles, or its whole
    sequence if it is shorter. Documents with den * |A&B| >= num * |A|B| are
    linked; component_id is the smallest doc_id reachable, kept says that it is
    the row's own, first that the row's key is its component's smallest. A pair
    at similarity s shares no band with chance (1 - s**rows)**bands, about: 3e-6
    at 0.8, 2e-9 at 0.85.

    Null and blank texts have no set and stay alone. Repeated rows are copies.
    A null doc_id counts only where all of a component's are null; the id is
    null then and the rows are kept. No rows give no rows. Long texts count
    whole; other columns have no part.
    """
    bounded_batches(docs.sparkSession)
    docs = keyed(docs, id_col, text_col).select("o", "k", "text")
    signed = stored(docs.mapInArrow(_signed(width, slots, bands, rows), "o long, k long, n_shingles long, digest string, bands array<long>, sig binary"), "signatures")
    whole = signed.select("o", "k", "n_shingles", "digest")
    sets = signed.where("digest is not null").groupBy("digest").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.min(F.struct("o", "k")).alias("at"), F.max("n_shingles").alias("size"))
    sets = stored(sets, "sets")
    least = least_equal(num / den, slots)
    banded = sets.select("digest", F.explode("bands").alias("key"))
    buckets = stored(banded.groupBy("key").agg(F.min("digest").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")

    # each bucket's sets against its first one
    member = salted_join(banded, buckets, ["key"], F.col("digest"), salts=2).where("digest <> b")
    member = stored(member.select("key", "digest", "b"), "members")
    star = member.select(F.col("digest").alias("a"), "b").distinct().join(sets.select(F.col("digest").alias("a"), "sig", F.col("size").alias("m")), "a")
    others = sets.join(buckets.select(F.col("b").alias("digest")).distinct(), "digest", "left_semi").select(F.col("digest").alias("b"), F.col("sig").alias("other"), F.col("size").alias("n"))
    star = salted_join(star, others, ["b"], F.col("a"), salts=8).where(den * F.least("m", "n") >= num * F.greatest("m", "n"))
    star = star.select("a", "b", "sig", "other").mapInArrow(_likely(slots, least), "a string, b string")
    links = _compared(docs, sets, _with_one(sets, star), width, num, den)

    # where a bucket's sets are in several components now: those outside its largest one against all
    labels = stored(components(links).withColumnsRenamed({"node": "digest"}), "labels")
    tagged = member.join(labels, "digest", "left").select("key", "digest", F.coalesce("label", "digest").alias("label"))
    several = tagged.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    tagged = stored(salted_join(tagged, several, ["key"], F.col("digest"), salts=2), "several")
    counts = tagged.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("top"))
    blocks = counts.select("key", "main", F.ceil(F.col("n") / BLOCK).alias("all"), F.ceil((F.col("n") - F.col("top")) / BLOCK).alias("rest"))
    sided = salted_join(tagged, blocks, ["key"], F.col("digest"), salts=2)
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("digest"), F.col(n))
    ones = sided.where("label <> main").select("digest", "label", F.explode(F.transform(spread("all"), lambda x: F.concat_ws("/", "key", own("rest"), x))).alias("item"), F.lit(0).alias("side"))
    alls = sided.select("digest", "label", F.explode(F.transform(spread("rest"), lambda x: F.concat_ws("/", "key", x, own("all")))).alias("item"), F.lit(1).alias("side"))
    homes = member.select("digest", "b").union(buckets.select("b", "b")).groupBy("digest").agg(F.min("b").alias("home"))
    block = _blocks(sets, tagged.select("digest").distinct(), homes)
    items = ones.union(alls).join(block, "digest").select("item", "side", "digest", "label", "block", "size", "sig")
    near = items.repartition("item").sortWithinPartitions("item").mapInArrow(_likely_blocks(slots, least, num, den), "x string, y string")
    links = links.union(_compared(docs, sets, _with_blocks(block, near), width, num, den))

    labels = components(links).withColumnsRenamed({"node": "digest"})
    tagged = salted_join(whole, labels, ["digest"], F.col("k"), "left").withColumn("label", F.coalesce("label", "digest"))
    tagged = stored(tagged, "tagged")
    known = F.when(F.col("o") != LOWEST, F.col("o"))
    least_of = tagged.where("label is not null").groupBy("label").agg(F.min(known).alias("component_id"), F.min(F.struct("o", "k")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = salted_join(tagged, least_of, ["label"], F.col("k"), "left")
    return own.select(
        known.alias("doc_id"),
        "n_shingles",
        F.when(F.col("least").isNull(), known).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("least").isNull() | F.coalesce(F.col("component_id") == known, F.col("component_id").isNull())).alias("kept"),
        (F.col("least").isNull() | ((F.col("least.o") == F.col("o")) & (F.col("least.k") == F.col("k")))).alias("first"),
        "o",
        "k",
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs' rows, one of each group of near duplicates (that of smallest doc_id); a row repeated whole stays once."""
    keys = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where("first").select("o", "k")
    return keyed(docs, id_col, text_col).join(keys, ["o", "k"], "left_semi").dropDuplicates(["o", "k"]).select("row.*")
