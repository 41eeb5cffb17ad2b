"""Substring deduplication by fixed-block anchors.

A window is `width` consecutive words of one document. A document's words are
cut into non-overlapping reference blocks of `width // 2` words, so that every
window holds a whole one. The blocks' hashes are the index; every rolling run of
as many words probes it. A hit that occurs twice reaches out to the windows
around it, and these are told apart by their full hashes: a window whose words
start earlier (smaller doc_id, or earlier in the same document) is a repeat, and
runs of repeats are the maximal repeats whose words go.

Documents travel in bundles (what one Arrow batch holds), compressed as a row
each; hashes are dealt to buckets as one packed row for each bundle and bucket,
with each hash once, so that a hash that all documents hold adds one entry a
bundle. The buckets answer with one bit for each entry.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import bounded_batches, keyed, stored
from .vecwords import SPACED, chunks, hashes, mix, rolling, spans

WIDTH = 20
#: Words of the corpus for each bucket of hashes: what one task holds at once.
BUCKET_WORDS = 2_000_000
_WORD_BYTES = 6  # of a text, about, for each word
_KEPT_CASE = np.arange(256, dtype=np.uint8)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _bundles(batches):
    """A row for each batch that isn't empty: its rows as they are, compressed."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bundle", "rows"])
        number += 1


class _Bundle:
    """A bundle's rows, its words' hashes, and the places of its documents' runs of words."""

    def __init__(self, row: dict):
        self.batch = pa.ipc.open_stream(row["rows"]).read_next_batch()
        self.o, self.k = (self.batch.column(c).to_numpy() for c in ("o", "k"))
        words, n = [], []
        for a, b, data, offsets in chunks(self.batch.column("text"), fold=_KEPT_CASE):
            starts, ends, owner = spans(data, offsets, SPACED)
            words.append(hashes(data, starts, ends))
            n.append(np.bincount(owner, minlength=b - a))
        self.words, n = np.concatenate(words), np.concatenate(n)
        self.ends = np.cumsum(n)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.words)) - np.repeat(self.ends - n, n)

    def starts(self, width: int) -> np.ndarray:
        """Where a run of so many words lies in one document."""
        if len(self.words) < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - width + 1] == self.doc[width - 1 :])

    def blocks(self, block: int, buckets: int):
        """Starts of the runs of a block's length; their distinct keys (bucket, 32 bits of the hash); each run's number among these."""
        at = self.starts(block)
        h = rolling(self.words, block)[at]
        key = (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32) | h >> np.uint64(32)
        return at, *np.unique(key, return_inverse=True)

    def windows(self, width: int, block: int, buckets: tuple[int, int], hot: dict[int, bytes]):
        """Windows that hold a hot run: their starts, each one's number among the distinct ones; these ones' buckets and hashes."""
        at, key, number = self.blocks(block, buckets[0])
        warm = np.zeros(len(key), bool)
        for b, a, e in _parts(key >> np.uint64(32)):
            if b in hot:
                warm[a:e] = _bits(hot[b], e - a)
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[at[warm[number]] + 1] = 1
        hits = np.cumsum(hits)
        start = self.starts(width)
        start = start[hits[start + width - block + 1] > hits[start]]
        code = rolling(self.words, width)[start]
        bucket = rolling(mix(self.words ^ _OTHER), width)[start] % np.uint64(buckets[1])
        order = np.lexsort((code, bucket))
        code, bucket = code[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return start, number, bucket[new], code[new]

    def ranks(self) -> np.ndarray:
        """The documents' order by (o, k); equal keys share a rank."""
        order = np.lexsort((self.k, self.o))
        o, k = self.o[order], self.k[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (o[1:] != o[:-1]) | (k[1:] != k[:-1]))))[: len(order)]
        return rank


def _parts(bucket: np.ndarray):
    """(bucket, first, end) of the stretches of a rising array."""
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[cut].tolist(), cut.tolist(), np.append(cut, len(bucket))[1:].tolist(), strict=True)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


_PROBES = "bucket int, bundle long, codes binary, anchors binary, again binary"


def _probes(block: int, buckets: int):
    """Bundles -> for each bucket the distinct codes of all rolling runs, and a bit for those that are reference blocks, and that occur again in the bundle."""

    def run(batches):
        for row in _rows(batches):
            own = _Bundle(row)
            at, key, number = own.blocks(block, buckets)
            anchor = np.zeros(len(key), bool)
            anchor[number[own.place[at] % block == 0]] = True
            again = np.bincount(number, minlength=len(key)) > 1
            code = key.astype("<u4")
            out = [
                {"bucket": b, "bundle": row["bundle"], "codes": code[a:e].tobytes(), "anchors": np.packbits(anchor[a:e]).tobytes(), "again": np.packbits(again[a:e]).tobytes()}
                for b, a, e in _parts(key >> np.uint64(32))
            ]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("bundle", pa.int64()), *((c, pa.binary()) for c in ("codes", "anchors", "again"))]))

    return run


_FOUND = "bundle long, hot boolean, bucket int, bits binary"
_FOUND_ARROW = pa.schema([("bundle", pa.int64()), ("hot", pa.bool_()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _answer(rows: list[dict], sizes: list[int], found: np.ndarray, hot: bool) -> pa.Table:
    """The bits of each row that has one."""
    out, at = [], 0
    for row, n in zip(rows, sizes, strict=True):
        bits = found[at : at + n]
        at += n
        if bits.any():
            out.append({"bundle": row["bundle"], "hot": hot, "bucket": row["bucket"], "bits": np.packbits(bits).tobytes()})
    return pa.Table.from_pylist(out, _FOUND_ARROW)


def _hits(table: pa.Table) -> pa.Table:
    """A bucket's probes -> which of each bundle's codes are some reference block's and occur twice."""
    rows = table.to_pylist()
    sizes = [len(r["codes"]) // 4 for r in rows]
    codes = np.frombuffer(b"".join(r["codes"] for r in rows), "<u4")
    distinct, number, count = np.unique(codes, return_inverse=True, return_counts=True)
    anchor, twice = np.zeros(len(distinct), bool), count > 1
    anchor[number[np.concatenate([_bits(r["anchors"], n) for r, n in zip(rows, sizes, strict=True)])]] = True
    twice[number[np.concatenate([_bits(r["again"], n) for r, n in zip(rows, sizes, strict=True)])]] = True
    return _answer(rows, sizes, (anchor & twice)[number], True)


_WINDOWS = "bucket int, bundle long, codes binary, docs binary, o binary, k binary"


def _reached(width: int, block: int, buckets: tuple[int, int]):
    """A bundle and its hot runs -> for each bucket the distinct windows around them, each with the first of the bundle's documents that has it."""

    def run(bundles: pa.Table, bits: pa.Table) -> pa.Table:
        out = []
        for row in bundles.to_pylist():
            own = _Bundle(row)
            start, number, bucket, code = own.windows(width, block, buckets, {r["bucket"]: r["bits"] for r in bits.to_pylist()})
            rank = own.ranks()
            least = np.full(len(code), len(rank), np.int64)
            np.minimum.at(least, number, rank[own.doc[start]])
            first = np.zeros(len(rank), np.int64)
            first[rank] = np.arange(len(rank))
            code = code.astype("<u8")
            for b, a, e in _parts(bucket):
                docs, place = np.unique(first[least[a:e]], return_inverse=True)
                out.append(
                    {"bucket": b, "bundle": row["bundle"], "codes": code[a:e].tobytes(), "docs": place.astype("<u4").tobytes(), "o": own.o[docs].astype("<i8").tobytes(), "k": own.k[docs].astype("<i8").tobytes()}
                )
        return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("bundle", pa.int64()), *((c, pa.binary()) for c in ("codes", "docs", "o", "k"))]))

    return run


def _owned(table: pa.Table) -> pa.Table:
    """A bucket's windows -> which of each bundle's an earlier document than the bundle's own has."""
    rows = table.to_pylist()
    sizes = [len(r["codes"]) // 8 for r in rows]
    codes = np.frombuffer(b"".join(r["codes"] for r in rows), "<u8")
    o, k = (np.concatenate([np.frombuffer(r[c], "<i8")[np.frombuffer(r["docs"], "<u4")] for r in rows]) for c in ("o", "k"))
    order = np.lexsort((k, o, codes))
    head = np.flatnonzero(np.concatenate(([True], codes[order][1:] != codes[order][:-1])))
    owner = np.repeat(order[head], np.diff(np.concatenate((head, [len(order)]))))
    lost = np.empty(len(order), bool)
    lost[order] = (o[order] != o[owner]) | (k[order] != k[owner])
    return _answer(rows, sizes, lost, False)


def _repeats(own: _Bundle, answers: list[dict], width: int, block: int, buckets: tuple[int, int]) -> list[list[int]]:
    """The maximal repeats that each document of a bundle loses: first, end, first, end, ... in words."""
    start, number, bucket, code = own.windows(width, block, buckets, {r["bucket"]: r["bits"] for r in answers if r["hot"]})
    lost, other = np.zeros(len(code), bool), {r["bucket"]: r["bits"] for r in answers if not r["hot"]}
    for b, a, e in _parts(bucket):
        if b in other:
            lost[a:e] = _bits(other[b], e - a)
    value = own.ranks()[own.doc[start]] * (len(own.words) + 1) + own.place[start]
    first = np.full(len(code), np.iinfo(np.int64).max)
    np.minimum.at(first, number, value)
    start = start[lost[number] | (value > first[number])]
    edge = np.zeros(len(own.words) + 1, np.int64)
    edge[start] += 1
    edge[start + width] -= 1
    gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    # a repeat that reaches the end of its document ends there, and another can start
    inner = np.unique(own.ends[(own.ends > 0) & (own.ends < len(own.words))])
    inner = inner[gone[inner] & gone[inner + 1]]
    at = np.sort(np.concatenate((np.flatnonzero(gone[1:] != gone[:-1]), inner, inner)))
    out: list[list[int]] = [[] for _ in own.ends]
    doc, shift = own.doc[at[::2]], at[::2] - own.place[at[::2]]
    for d, a, e in zip(doc.tolist(), (at[::2] - shift).tolist(), (at[1::2] - shift).tolist(), strict=True):
        out[d] += [a, e]
    return out


def _cut(text: bytes | None, ends: list[int]) -> tuple[bytes | None, int, int]:
    """The words that stay, joined by one space; the number of words, and of those that go."""
    words = (text or b"").split()  # at ASCII white space
    bounds = [0, *ends, len(words)]
    left = [w for a, b in zip(bounds[::2], bounds[1::2], strict=True) for w in words[a:b]]
    return (None if text is None else b" ".join(left)), len(words), len(words) - len(left)


def _settled(rows: DataFrame, width: int, bucket_words: int, result: Callable[[_Bundle, list[list[int]]], pa.Table], schema: str) -> DataFrame:
    """rows (o, k, text and more) -> result of each bundle and the repeats that its documents lose."""
    if width < 2:
        raise ValueError("a window has two words at least")
    spark = rows.sparkSession
    bounded_batches(spark)
    block = width // 2
    n_bytes = Observation()
    seen = rows.observe(n_bytes, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"))
    bundles = stored(seen.mapInArrow(_bundles, "bundle long, rows binary"), "bundles", compression="none")
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes.get["n"] // (_WORD_BYTES * bucket_words)))
    buckets = (most, most)
    hot = stored(bundles.mapInArrow(_probes(block, most), _PROBES).groupBy("bucket").applyInArrow(_hits, _FOUND), "hits")
    both = lambda bits: bundles.groupBy("bundle").cogroup(bits.groupBy("bundle"))
    lost = both(hot).applyInArrow(_reached(width, block, buckets), _WINDOWS).groupBy("bucket").applyInArrow(_owned, _FOUND)
    bits = stored(hot.union(lost), "bits")

    def last(found: pa.Table, answers: pa.Table) -> pa.Table:
        own, answers = [_Bundle(row) for row in found.to_pylist()], answers.to_pylist()
        return pa.concat_tables([result(x, _repeats(x, answers, width, block, buckets)) for x in own]) if own else None

    return both(bits).applyInArrow(last, schema)


def repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """docs -> o, k, ends (first, end, first, end, ... in words from 0, ends excluded) for each document that loses some.

    `width` is 2 at least. The earlier of two documents is that of smaller
    doc_id (null is the smallest; rows of one doc_id and different texts go by a
    hash). Repeated rows are one document and don't lose words to each other.
    """

    def result(own: _Bundle, gone: list[list[int]]) -> pa.Table:
        return pa.table({"o": own.o, "k": own.k, "ends": pa.array(gone, pa.list_(pa.int64()))})

    rows = keyed(docs, id_col, text_col).select("o", "k", "text")
    return _settled(rows, width, bucket_words, result, "o long, k long, ends array<long>").where("size(ends) > 0").dropDuplicates(["o", "k"])


def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """docs -> row, o, k, text (the words that stay, joined by one space), n_words, n_removed for each row.

    Words are runs of other bytes than ASCII white space, unchanged. A word goes
    if a window of `width` words that covers it also starts earlier in the
    input. A null text stays null, with no words; a blank one becomes empty; a
    text of fewer words than a window loses none. Repeated rows get the same
    result each; no rows give none; the columns beside the text stay in `row`.
    """

    def result(own: _Bundle, gone: list[list[int]]) -> pa.Table:
        texts = own.batch.column("text").cast(pa.binary()).to_pylist()
        kept, n, removed = zip(*map(_cut, texts, gone), strict=True)
        columns = [*(own.batch.column(c) for c in ("row", "o", "k")), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
        return pa.Table.from_arrays(columns, ["row", "o", "k", "text", "n_words", "n_removed"])

    rows = keyed(docs, id_col, text_col).withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != text_col]))
    row_type = rows.schema["row"].dataType.simpleString()
    return _settled(rows, width, bucket_words, result, f"row {row_type}, o long, k long, text string, n_words long, n_removed long")
