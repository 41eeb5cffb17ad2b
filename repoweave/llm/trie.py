"""Conversation prefix trie by range minima over sorted LCPs.

Conversations are sorted by their turns, and neighbours' longest common prefixes
(LCPs) are taken. A prefix's members are the interval around any of them in
which no LCP is below its depth: each candidate prefix searches its left and its
right end by itself, in powers of two over a sparse table of range minima, so no
stack runs along the order. The order is cut into ranges, one task each. What
crosses a cut is found by the same search over the ranges' own minima, and its
pieces are added up by the range where it starts and its depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import salted_join, stored

_SIZE = 16  # bytes of a turn's digest


def sequences(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id long, turns array<struct<digest, words>> in the order of turn.

    A null turn is the first; equal ones go by digest. Null role or text is
    empty. Rows without conv_id belong to no conversation. Repeated rows are
    turns of their own; other columns have no effect. Of a turn 24 bytes are
    gathered, never its text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    each = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), words.alias("words")).alias("t"))
    return each.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(found: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """sequences -> the same conversations, the first h turns of each (h: crc32 of its id, modulo `most`) replaced by those of the last conversation whose id `every` divides.

    Where there is no such conversation, or it is shorter, there are as many
    turns as it has.
    """
    found = stored(found, "sequences")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.expr("cast(array() as array<struct<digest:binary,words:bigint>>)")
    heads = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    both = found.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.size("turns"))).otherwise(none)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), own).alias("turns"))


class Minima:
    """A sparse table: the minimum of every stretch whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def after(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest end for which no value after `at` up to it is below `least`."""
        at = at + 1
        for j in range(len(self.levels) - 1, -1, -1):
            level = self.levels[j]
            on = at < len(level)
            on[on] = level[at[on]] >= least[on]
            at = at + (on.astype(np.int64) << j)
        return at - 1

    def before(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest start for which no value after it up to `at` is below `least`."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            first = at - (1 << j) + 1
            on = first >= 1
            on[on] = self.levels[j][first[on]] >= least[on]
            at = at - (on.astype(np.int64) << j)
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum from first to last, both included."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        for j in np.unique(level).tolist():
            on = level == j
            out[on] = np.minimum(self.levels[j][first[on]], self.levels[j][last[on] - (1 << j) + 1])
        return out


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    low, high = 0, min(len(a), len(b)) // _SIZE
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * _SIZE] == b[: mid * _SIZE]:
            low = mid
        else:
            high = mid - 1
    return low


_SORTED = "part int, pos long, conv_id long, n long, lcp long, words array<long>, edge binary"
_SORTED_ARROW = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("lcp", pa.int64()), ("words", pa.list_(pa.int64())), ("edge", pa.binary())])


def _neighbours(batches):
    """A sorted range's rows -> each one's place and LCP with the one before; the first key, and a row (place -1) with the last one."""
    part, pos, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        if not keys:
            continue
        shared = [None if a is None else _shared(a, b) for a, b in zip([last, *keys[:-1]], keys, strict=True)]
        m = len(keys)
        columns = [[part] * m, range(pos, pos + m), batch.column("conv_id"), [len(k) // _SIZE for k in keys], shared, batch.column("words"), [*(keys[:1] if last is None else [None]), *[None] * (m - 1)]]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SORTED_ARROW, strict=True)], schema=_SORTED_ARROW)
        pos, last = pos + m, keys[-1]
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "pos": -1, "edge": last}], _SORTED_ARROW)


def _at_cuts(batches):
    for batch in batches:
        shared = [-1 if a is None else _shared(a, b) for a, b in zip(batch.column("before").to_pylist(), batch.column("edge").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(shared, pa.int64())], ["part", "lcp"])


_FOUND = "q int, pq int, part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, words long, before long, ends string"
_FOUND_ARROW = pa.schema(
    [(c, pa.int32()) for c in ("q", "pq", "part")] + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "words", "before")] + [("ends", pa.string())]
)


def _intervals(parts: list[int], entering: list[int], lows: list[int]):
    """A range's rows -> its nodes, and pieces (q: the range where it starts) of nodes that reach over a cut."""
    number = {p: i for i, p in enumerate(parts)}
    cuts = Minima(np.array(lows, np.int64))

    def starts_in(r: int, depth: np.ndarray) -> np.ndarray:
        """The range where the node of that depth starts which reaches into range r."""
        return cuts.before(np.full(len(depth), r - 1), depth)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("pos")
        r = number[table["part"][0].as_py()]
        conv, n = table["conv_id"].to_numpy(), table["n"].to_numpy()
        m, follows = len(n), entering[r + 1] if r + 1 < len(parts) else -1
        lcp = np.concatenate(([entering[r]], table["lcp"].to_numpy()[1:])).astype(np.int64)
        words = np.concatenate((np.zeros(1, np.int64), np.cumsum(table["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64))))
        offset = np.cumsum(n) - n
        until = lambda i, d: words[offset[i] + np.maximum(d, 0)] - words[offset[i]]  # noqa: E731  words of i's first d turns
        total = lambda v: np.concatenate((np.zeros(1, np.int64), np.cumsum(v)))
        common = total(until(np.arange(m), lcp))
        leaves = total(np.concatenate((lcp[1:], [follows])) < n)
        rmq, ids = Minima(lcp), Minima(conv)

        # candidates: the prefixes that a row is the first to have, and those that come in from the range before
        fresh = n - lcp
        at = np.repeat(np.arange(m), fresh)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + lcp[at] + 1
        came = np.arange(lcp[0] + 1) if r else np.zeros(0, np.int64)
        at, depth, inner = np.concatenate((np.zeros(len(came), np.int64), at)), np.concatenate((came, depth)), np.arange(len(at) + len(came)) >= len(came)
        left, right = rmq.before(at, depth), rmq.after(at, depth)
        on = (right == m - 1) & (follows >= depth)  # goes on in the next range
        q = np.where(inner, r, 0)
        q[~inner] = starts_in(r, came) if r else 0
        open_ = on | ~inner

        # a prefix's parent is one turn shorter; the row before can have it, too
        up = depth - 1
        up_left, up_right = rmq.before(at, up), rmq.after(at, up)
        up_in = (up_left == 0) & (lcp[0] >= up) & (r > 0)
        up_open = (up_in | ((up_right == m - 1) & (follows >= up))) & (up >= 0)
        pq = np.full(len(at), r)
        pq[up_in] = starts_in(r, up[up_in]) if r else 0
        parent = ids.least(up_left, up_right)

        base = int(n.max(initial=0)) + 2
        born = inner & (depth > 0)
        owners, n_children = np.unique(up_left[born] * base + up[born], return_counts=True)
        place = np.searchsorted(owners, left * base + depth)
        hit = (place < len(owners)) & (owners[np.minimum(place, len(owners) - 1)] == left * base + depth) if len(owners) else np.zeros(len(at), bool)
        children = np.where(hit, n_children[np.minimum(place, len(owners) - 1)] if len(owners) else 0, 0)

        # rows with exactly a prefix's turns stand first in its interval, by id
        same = lcp == n
        ends_at = np.concatenate((np.flatnonzero(~same), [m]))
        stop = ends_at[np.searchsorted(ends_at, np.arange(m), "right")]
        text = conv.astype(str).tolist()
        ends = [""] * len(at)
        for x in np.flatnonzero((depth == n[left]) & (inner | same[0])).tolist():
            ends[x] = ",".join(text[left[x] : stop[left[x]] if inner[x] else ends_at[0]])
        saved = common[right + 1] - np.where(inner, common[left + 1], 0)
        prior = until(left, up)
        saved = np.where(open_, saved, saved - (right - left) * prior)
        hashed = [e if o else hashlib.sha256(e.encode()).hexdigest() for e, o in zip(ends, open_.tolist(), strict=True)]
        columns = [
            pa.array(q, pa.int32(), mask=~open_),
            pa.array(pq, pa.int32(), mask=~up_open | ~inner),
            pa.array(np.full(len(at), r), pa.int32()),
            pa.array(ids.least(left, right)),
            pa.array(depth),
            pa.array(parent, mask=up_open | (up < 0) | ~inner),
            pa.array(right - left + 1),
            pa.array(children.astype(np.int64)),
            pa.array(leaves[right + 1] - leaves[left]),
            pa.array(saved),
            pa.array(prior, mask=~inner),
            pa.array(hashed, pa.string()),
        ]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return run


def _digests(batches):
    """Rows sorted by q, depth, part -> one digest of all ends of each (q, depth), fed piece by piece."""
    schema = pa.schema([("q", pa.int32()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    now, digest, out = None, None, []
    for batch in batches:
        for q, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("q", "depth", "ends")), strict=True):
            if (q, depth) != now:
                if now:
                    out.append({"q": now[0], "depth": now[1], "ends_sha256": digest.hexdigest()})
                now, digest = (q, depth), hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if now:
        yield pa.RecordBatch.from_pylist([{"q": now[0], "depth": now[1], "ends_sha256": digest.hexdigest()}], schema)


def nodes(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """conversations (conv_id, turns array<struct<digest, words>>) -> a row for each distinct prefix of turns, the empty one included.

    conv_id (the smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens (words that needn't be read again
    if members share the prefixes of the subtree), ends_sha256 (of the ids that
    end here). Each conversation is a row, however many there are of one text;
    one without turns ends at the root; no conversations give no nodes. `ranges`
    (default: the session's shuffle partitions) cuts the order into tasks.
    """
    spark = conversations.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")), F.lit(b""))
    keyed = stored(conversations.select(key.alias("key"), "conv_id", F.transform("turns", lambda t: t["words"]).alias("words")), "keys")
    order = stored(keyed.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_neighbours, _SORTED), "order")
    before = F.lag("edge").over(Window.orderBy("part", F.desc("pos")))
    cuts = order.where("edge is not null").select("part", "pos", "edge").withColumn("before", before).where("pos = 0")
    entering = {r["part"]: r["lcp"] for r in cuts.select("part", "edge", "before").mapInArrow(_at_cuts, "part int, lcp long").collect()}
    lows = {r["part"]: r["low"] for r in order.where("pos > 0").groupBy("part").agg(F.min("lcp").alias("low")).collect()}
    parts = sorted(entering)
    run = _intervals(parts, [entering[p] for p in parts], [min(entering[p], lows.get(p, entering[p])) for p in parts])
    found = stored(order.where("pos >= 0").drop("edge").groupBy("part").applyInArrow(run, _FOUND), "intervals")
    pieces = found.where("q is not null")
    ends = pieces.where("ends <> ''").select("q", "depth", "part", "ends").repartition("q", "depth").sortWithinPartitions("q", "depth", "part").mapInArrow(_digests, "q int, depth long, ends_sha256 string")
    over = pieces.groupBy("q", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("pq").alias("pq"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "words")],
        F.max("before").alias("before"),
    )
    over = stored(over.join(ends, ["q", "depth"], "left"), "over-cuts")
    names = over.select(F.col("q").alias("pq"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    out = lambda df, parent, saved, sha: df.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), sha.alias("ends_sha256"))
    inside = found.where("q is null")
    return (
        out(inside.where("pq is null"), F.col("parent_conv_id"), F.col("words"), F.col("ends"))
        .union(out(salted_join(inside.where("pq is not null"), names, ["pq", "depth"], F.col("conv_id")), F.col("above"), F.col("words"), F.col("ends")))
        .union(out(over.join(names, ["pq", "depth"], "left"), F.col("above"), F.col("words") - (F.col("n_convs") - 1) * F.col("before"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    )
