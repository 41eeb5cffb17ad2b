"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings of all the corpus's terms: a row has a term's
places in one block of documents (what one Arrow batch holds). It lies in the
shared folder, dealt and sorted by term. A search counts its terms over the
whole corpus, fetches the list of each phrase's globally rarest term, and
intersects it, moved by the terms' offsets, with the lists of the next rarest
and then of all other terms in those blocks.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import LOWEST, among, bounded_batches, keyed, lean, salted_join, stored
from .vecwords import ALNUM, chunks, hashes, spans

INDEX = "term long, block long, n int, positions binary, owners binary, keys binary, starts binary"
#: Places between the documents of a block, so that no match reaches from one into the next; a match is at most so many words long.
GAP = 64
#: A term with so many places in a block is dealt by the block, too: its rows don't fit one task.
_OFTEN = 256


def _words(texts):
    for a, b, data, offsets in chunks(texts):
        starts, ends, owner = spans(data, offsets, ALNUM)
        yield a, b, hashes(data, starts, ends), np.searchsorted(owner, np.arange(b - a + 1))


def _coded(place: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The rising places between bounds as binary values: the first place and the steps to the next, seven bits a byte, the lowest first, all bytes but a number's last with the eighth bit set."""
    step = np.diff(place, prepend=0)
    step[bounds[:-1]] = place[bounds[:-1]]
    size = np.ones(len(step), np.int64)
    for bits in (7, 14, 21, 28):
        size += step >= 1 << bits
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(ends[-1], np.uint8)
    for i in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > i)
        out[ends[live] + i] = (step[live] >> 7 * i & 127) | (size[live] > i + 1) << 7
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _decoded(lists: pa.Array, n: np.ndarray) -> np.ndarray:
    """All places of coded lists of n places each, flat."""
    data = np.frombuffer(b"".join(lists.to_pylist()), np.uint8).astype(np.int64)
    if not len(data):
        return data
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts + 1))
    total = np.cumsum(np.add.reduceat((data & 127) << shift, starts))
    first = np.cumsum(n) - n
    return total - np.repeat(np.where(first > 0, total[first - 1], 0), n)


@lean
def _indexed(batches):
    """Rows of postings, and for each block one row (of no term) with its documents' keys and first words."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        words, starts, n = [], [np.zeros(1, np.int64)], 0
        for _, _, w, bounds in _words(batch.column("text")):
            words.append(w)
            starts.append(bounds[1:] + n)
            n += len(w)
        words, starts = np.concatenate(words), np.concatenate(starts)
        place = np.arange(n) + GAP * np.repeat(np.arange(batch.num_rows), np.diff(starts))
        order = np.argsort(words, kind="stable")
        words = words[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), words[1:] != words[:-1])))
        bounds = np.append(first, n)
        # a block's number is the same when its task runs again
        block, m = part << 32 | number, len(first)
        number += 1
        nothing = pa.nulls(m, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[first].astype(np.int64)), pa.array(np.full(m, block)), pa.array(np.diff(bounds).astype(np.int32)), _coded(place[order], bounds), nothing, nothing, nothing], ["term", "block", "n", "positions", "owners", "keys", "starts"]
        )
        o, k = (batch.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("o", "k"))
        whole = [pa.nulls(1, pa.int64()), pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *(pa.array([x], pa.binary()) for x in (o, k, starts.tobytes()))]
        yield pa.RecordBatch.from_arrays(whole, ["term", "block", "n", "positions", "owners", "keys", "starts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> the stored positional index of all their terms.

    A null text has no postings but stands in its block with no words.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).select("o", "k", "text").mapInArrow(_indexed, INDEX)
    spread = F.when(F.col("term").isNull() | (F.col("n") >= _OFTEN), F.col("block"))
    return stored(rows.repartition(F.col("term"), spread).sortWithinPartitions("term", "block"), "index")


def _windows(width: int):
    @lean
    def run(batches):
        for batch in batches:
            names = batch.column("item").to_pylist()
            out = set()
            for a, _, words, starts in _words(batch.column("text")):
                words = words.astype(np.int64).tolist()
                for i, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    n = min(width, e - s)
                    out |= {(names[a + i], tuple(words[x : x + n])) for x in range(s, e - n + 1) if n}
            out = sorted(out, key=lambda x: (x[0] or "", x[1]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["item", "terms"])

    return run


def phrases(items: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """items -> item (string), terms (hashes of its windows of `width` consecutive words; all words of a shorter item)."""
    bounded_batches(items.sparkSession)
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_windows(width), "item string, terms array<long>").distinct()


_PLACES = "block long, phrase long, at long"


@lean
def _fetched(batches):
    """Each place of the rows' postings as a row."""
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        at = _decoded(batch.column("positions"), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)) for c in ("block", "phrase")] + [pa.array(at)], ["block", "phrase", "at"])


_CHECKED = "block long, phrase long, at long, mask long"


@lean
def _checked(batches):
    """Rows with a term's positions in a block and needs (phrase, at, delta, reach) -> the needs that are met.

    Without reach the term must stand at `at` + delta (mask 1). Else bit b of the
    mask says that it stands in the `reach` places from `at` - b on.
    """
    for batch in batches:
        lists = batch.column("needs")
        needs = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        phrase, at, delta, reach = (needs.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        n = batch.column("n").to_numpy(zero_copy_only=False)
        # one sorted array of all rows' places
        places = _decoded(batch.column("positions"), n) + (np.repeat(np.arange(batch.num_rows), n) << 34)
        base = (row << 34) + at
        rank = lambda x: np.searchsorted(places, x)
        mask = np.zeros(len(row), np.int64)
        exact = reach == 0
        want = base[exact] + delta[exact]
        mask[exact] = places[np.minimum(rank(want), len(places) - 1)] == want
        low, high = row << 34, ((row + 1) << 34) - 1
        for back in range(int(reach.max(initial=0))):
            ok = np.flatnonzero((back < reach) & (at >= back))
            begin = base[ok] - back
            mask[ok] |= (rank(np.minimum(begin + reach[ok], high[ok])) > rank(np.maximum(begin, low[ok]))).astype(np.int64) << back
        met = np.flatnonzero(mask)
        block = batch.column("block").to_numpy(zero_copy_only=False)[row[met]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, phrase[met], at[met], mask[met])], ["block", "phrase", "at", "mask"])


def _met(postings: DataFrame, needs: DataFrame) -> DataFrame:
    """needs (term, block, phrase, at, delta, reach) -> block, phrase, at, mask of those that the postings meet.

    The needs of a term in a block are gathered; a block bounds them. Only lists
    of needed terms move.
    """
    needs = stored(needs, "needs")
    lists = postings.where(among(needs.select(F.col("term").alias("k")), column="term"))
    asked = needs.groupBy("term", "block").agg(F.collect_list(F.struct("phrase", "at", "delta", "reach")).alias("needs"))
    return lists.join(asked, ["term", "block"]).select("block", "n", "positions", "needs").mapInArrow(_checked, _CHECKED)


def _found(slop: int):
    """Blocks with their matches (begin, length, phrase) -> a row for each document."""

    @lean
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                o, k, starts = (np.frombuffer(r[c], np.int64) for c in ("owners", "keys", "starts"))
                hits = r["hits"] or []
                begin, length, phrase = (np.array([h[c] for h in hits], np.int64) for c in ("begin", "length", "phrase"))
                first = starts[:-1] + GAP * np.arange(len(o))  # the documents' first places
                owner = np.searchsorted(first, begin + (length - 1 if slop else 0), "right") - 1
                a = np.maximum(begin - first[owner], 0)
                b = np.minimum(begin + length - first[owner], np.diff(starts)[owner])
                ranges, seen = [[] for _ in o], [[] for _ in o]
                order = np.lexsort((b, a, owner))
                for d, x, y in zip(owner[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True):
                    if ranges[d] and x <= ranges[d][-1]["b"]:
                        ranges[d][-1]["b"] = max(ranges[d][-1]["b"], y)
                    else:
                        ranges[d].append({"a": x, "b": y})
                for d, x in np.unique(np.stack((owner, phrase)), axis=1).T.tolist():
                    seen[d].append(x)
                m = len(o)
                kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, r["block"])), pa.array(np.arange(m)), pa.array(o), pa.array(k), pa.array(np.diff(starts)), pa.array(ranges, kinds[0]), pa.array(seen, kinds[1])], ["block", "row", "o", "k", "n_words", "ranges", "phrases"])

    return run


def _begins(slop: int) -> Column:
    """First places of the matches of a candidate with `at`, `offset`, `mask`."""
    if not slop:
        return F.array(F.col("at") - F.col("offset"))
    backs = F.filter(F.sequence(F.lit(0), F.lit(GAP - 1)), lambda b: F.getbit(F.col("mask"), b) == 1)
    return F.transform(backs, lambda b: F.col("at") - b)


def search(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """The stored index and phrases (item, terms) -> o, k, n_words, ranges (words hit, from 0, end excluded, apart), items, for each document.

    With slop 0 matches are exact phrases; else a match is a run of the
    phrase's length + slop words (GAP at most) inside one document that holds all
    its terms. Nothing of the phrases or the index goes through the driver.
    """
    wanted = stored(wanted.withColumn("phrase", F.xxhash64("terms")), "phrases")
    spelled = stored(wanted.dropDuplicates(["phrase"]).select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")), "spelled")
    longest = spelled.agg(F.max("length").alias("n")).first()["n"] or 0
    if longest + slop > GAP:
        raise ValueError(f"a match of {longest + slop} words is longer than {GAP}")
    postings = index.where("term is not null").select("term", "block", "n", "positions")
    counts = postings.where(among(spelled.select(F.col("term").alias("k")), column="term")).groupBy("term").agg(F.sum("n").alias("total"))
    ranks = spelled.join(counts, "term", "left").groupBy("phrase", "length").agg(F.array_sort(F.collect_list(F.struct("total", "offset", "term"))).alias("by"))
    # a phrase with a term that the corpus lacks has no match
    ranks = stored(ranks.where("forall(by, x -> x.total is not null)").withColumn("reach", (F.col("length") + slop) * int(slop > 0)), "ranks")
    first, second = F.col("by")[0], F.get("by", F.lit(1))
    rare = ranks.select("phrase", first["term"].alias("term"))
    lists = postings.where(among(rare.select(F.col("term").alias("k")), column="term"))
    at = salted_join(lists, rare, ["term"], F.col("block")).select("block", "phrase", "n", "positions").mapInArrow(_fetched, _PLACES)
    at = stored(at, "rarest")
    full = F.expr("shiftleft(1L, least(reach, 63)) - 1") if slop else F.lit(1).cast("long")
    full = F.when(F.col("reach") > 63, F.lit(-1).cast("long")).otherwise(full)

    def needed(rows: DataFrame, terms: Column) -> DataFrame:
        """The candidates' needs of some of their terms."""
        each = salted_join(rows, ranks.select("phrase", "reach", first["offset"].alias("offset"), terms.alias("x")), ["phrase"], F.xxhash64("block", "at"))
        each = each.select("block", "phrase", "at", "reach", "offset", F.explode("x").alias("x"))
        return each.select("x.term", "block", "phrase", "at", (F.col("x.offset") - F.col("offset")).cast("long").alias("delta"), "reach")

    known = salted_join(at, ranks.select("phrase", "length", "reach", first["offset"].alias("offset")), ["phrase"], F.xxhash64("block", "at"))
    alone = known.where("length = 1").select("block", "phrase", "at", full.alias("mask"))
    pairs = stored(_met(postings, needed(at, F.filter(F.array(second), lambda x: x.isNotNull()))), "pairs")
    rest = _met(postings, needed(pairs.select("block", "phrase", "at"), F.slice("by", 3, longest + 1)))
    rest = rest.groupBy("block", "phrase", "at").agg(F.count("*").alias("n"), F.bit_and("mask").alias("m"))
    both = salted_join(pairs, ranks.select("phrase", "length"), ["phrase"], F.xxhash64("block", "at")).join(rest, ["block", "phrase", "at"], "left")
    both = both.where("coalesce(n, 0) = length - 2").select("block", "phrase", "at", F.expr("mask & coalesce(m, mask)").alias("mask")).where("mask <> 0")
    found = salted_join(alone.union(both), ranks.select("phrase", "length", first["offset"].alias("offset")), ["phrase"], F.xxhash64("block", "at"))
    hits = found.select("block", "phrase", (F.col("length") + slop).cast("long").alias("length"), F.explode(_begins(slop)).alias("begin")).distinct()
    hits = hits.groupBy("block").agg(F.collect_list(F.struct("begin", "length", "phrase")).alias("hits"))
    blocks = index.where("term is null").select("block", "owners", "keys", "starts")
    docs = blocks.join(hits, "block", "left").mapInArrow(_found(slop), "block long, row long, o long, k long, n_words long, ranges array<struct<a:long,b:long>>, phrases array<long>")
    docs = stored(docs, "documents-hit")
    own = docs.select("block", "row", F.explode("phrases").alias("phrase")).join(wanted.where("item is not null").select("phrase", "item"), "phrase")
    own = own.groupBy("block", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return docs.join(own, ["block", "row"], "left").select("o", "k", "n_words", "ranges", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, part: int = 20, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, items -> o, k, doc_id, n_words, n_hit, items, ranges, contaminated for each row of docs.

    A word is hit if it stands in an occurrence of an item's window of `width`
    consecutive words (an item of fewer words is one window); a document is
    contaminated if a word is hit and part * n_hit >= n_words. Null and empty
    texts have no words and aren't; items without words hit nothing, items
    without an id hit but aren't listed. Repeated rows each get their row. No
    items: nothing is hit; no documents: no rows. Other columns have no part.
    """
    found = search(build_index(docs, id_col, text_col), phrases(items, width, item_id, item_text), slop)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select("o", "k", F.when(F.col("o") != LOWEST, F.col("o")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), "items", "ranges").withColumn("contaminated", (F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words")))


def without_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs' rows that aren't contaminated, whole."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **how).where("contaminated").select("o", "k")
    return keyed(docs, id_col, text_col).join(bad, ["o", "k"], "left_anti").select("row.*")
