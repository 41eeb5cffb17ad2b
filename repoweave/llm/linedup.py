"""Line deduplication by pairwise alignment.

A line is known by the hash of its words. Lines of fewer than `min_words` words
repeat by chance, so a key is a shortest run of whole lines with that many words
from a line on, or up to a line. A key that several documents have pairs each of
them with the earliest one, and brings along where the run stands there and its
lines (at most `min_words`): a hot document's lines don't travel whole. The
stretches that a pair shares are aligned by patience diff, and each aligned
common block of at least `min_words` words leaves the later document. A run that
moved past another one is no part of such an alignment and is aligned alone.
The lines that go are so all those in a run of `min_words` words that any
earlier document has.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keyed, lean, salted_join, stored
from .vecwords import SPACED, chunks, hashes, mix, spans

#: Blocks of fewer words than this stay: such lines repeat by chance or are too short to be a passage.
MIN_WORDS = 30


def _lines(data, offsets):
    """Hashes, word counts and documents of the lines; a document has a line more than line feeds."""
    starts, ends, owner = spans(data, offsets, SPACED)
    words = hashes(data, starts, ends)
    feeds = np.flatnonzero(data == 10)
    line_owner = np.sort(np.concatenate((np.searchsorted(offsets, feeds, "right") - 1, np.arange(len(offsets) - 1))), kind="stable")
    line = np.searchsorted(feeds, starts) + owner  # lines before: those that a feed ended, and one for each earlier document
    n = np.bincount(line, minlength=len(line_owner))
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    value = mix(words + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    last = np.cumsum(n)
    return mix(total[last] - total[last - n] + n.astype(np.uint64)), n, line_owner


def _runs(lines: np.ndarray, counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and numbers of lines of the shortest runs of min_words words, from each line on and up to each line."""
    total = np.concatenate(([0], np.cumsum(counts)))
    to = np.searchsorted(total, total[:-1] + min_words)
    first = np.flatnonzero(to < len(total))
    end = np.flatnonzero(total >= min_words)
    start = np.searchsorted(total, total[end] - min_words, "right") - 1
    code = np.unique(np.concatenate((first * len(total) + to[first], start * len(total) + end)))
    start, span = code // len(total), code % len(total) - code // len(total)
    run_hash = np.zeros(len(start), np.uint64)
    for step in range(int(span.max(initial=0))):
        live = span > step
        run_hash[live] = mix(run_hash[live] * np.uint64(0x9E3779B97F4A7C15) + lines[start[live] + step])
    return start, run_hash, span


def _sequences(min_words: int):
    @lean
    def run(batches):
        for batch in batches:
            seqs, counts, n_keys, keys, at, spans_of, runs = [], [], [0], [], [], [], []
            for a, b, data, offsets in chunks(batch.column("text")):
                h, n, owner = _lines(data, offsets)
                bounds = np.searchsorted(owner, np.arange(b - a + 1))
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    filled = s + np.flatnonzero(n[s:e])  # blank lines have no part
                    lines = h[filled]
                    seqs.append(lines.tobytes())
                    counts.append(n[filled].astype(np.int32).tobytes())
                    start, run_hash, span = _runs(lines, n[filled], min_words)
                    key, first = np.unique(run_hash, return_index=True)
                    start, span = start[first], span[first]
                    keys.append(key.view(np.int64))
                    at.append(start)
                    spans_of.append(span)
                    runs.append(lines[np.arange(span.sum()) + np.repeat(start - np.cumsum(span) + span, span)])
                    n_keys.append(n_keys[-1] + len(key))
            ends = np.concatenate(([0], np.cumsum(np.concatenate([*spans_of, np.zeros(0, np.int64)])))).astype(np.int32) * 8
            lines = np.concatenate([*runs, np.zeros(0, np.uint64)])
            run_lines = pa.Array.from_buffers(pa.binary(), n_keys[-1], [None, pa.py_buffer(ends), pa.py_buffer(lines)])
            each = [pa.array(np.concatenate([*x, np.zeros(0, kind)]).astype(kind)) for x, kind in ((keys, np.int64), (at, np.int32))]
            held = pa.ListArray.from_arrays(pa.array(n_keys, pa.int32()), pa.StructArray.from_arrays([*each, run_lines], ["key", "at", "run"]))
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("k"), pa.array(seqs, pa.binary()), pa.array(counts, pa.binary()), held], ["o", "k", "lines", "counts", "keys"])

    return run


def patience(a: list, b: list) -> list[tuple[int, int, int]]:
    """Aligned common blocks (start in a, start in b, length) of two sequences, in order.

    Lines that are once in either part between two anchors (or, where there are
    none, the rarest that both have) anchor the alignment along their longest
    increasing run; equal lines at either end of a part extend it, and the parts
    between are aligned alike.
    """
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at_a, at_b = {}, {}
        for i in range(a0, a1):
            at_a.setdefault(a[i], []).append(i)
        for j in range(b0, b1):
            if b[j] in at_a:
                at_b.setdefault(b[j], []).append(j)
        least = min((len(at_a[x]) * len(j) for x, j in at_b.items()), default=0)  # 1 where lines are unique in both
        unique = sorted((at_a[x][0], j[0]) for x, j in at_b.items() if len(at_a[x]) * len(j) == least)
        tops, ends, back = [], [], [-1] * len(unique)
        for n, (_, j) in enumerate(unique):
            p = bisect_left(tops, j)
            back[n] = ends[p - 1] if p else -1
            tops[p : p + 1], ends[p : p + 1] = [j], [n]
        n, anchors = (ends[-1] if ends else -1), []
        while n >= 0:
            anchors.append(unique[n])
            n = back[n]
        if not anchors:
            continue
        anchors.reverse()
        pairs += anchors
        for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    blocks = []
    for i, j in sorted(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _joined(parts: list[tuple[int, list]], mark: int) -> tuple[list, list]:
    """(place, lines) in order of place -> the lines of the stretches that they cover, and their places; marks, each its own, part stretches."""
    out, places, end = [], [], 0
    for at, lines in parts:
        if out and at > end:
            out.append(mark - 2 * len(out))
            places.append(-1)
        new = lines[max(0, end - at) if out else 0 :]
        end = max(end, at + len(lines)) if out else at + len(lines)
        out += new
        places += range(end - len(new), end)
    return out, places


def common_blocks(lines: np.ndarray, counts: np.ndarray, shared: list[np.ndarray], runs: list[bytes], min_words: int) -> list[tuple[int, int]]:
    """(first, end) of the blocks of lines with at least min_words words that earlier documents have.

    shared has, for each of the document's keys, the earlier document's o and k,
    the key and where its run stands there; runs has their lines. Each pair's
    stretches are aligned first. A run that is left then has moved, or overlaps
    one from elsewhere, and is aligned alone.
    """
    gone = np.zeros(len(lines), bool)
    o, k, key, at = shared
    start, own, span = _runs(lines, counts, min_words)
    own, by_key = own.view(np.int64), np.argsort(key)
    which = by_key[np.minimum(np.searchsorted(key[by_key], own), len(key) - 1)]
    start, span, which = (x[key[which] == own] for x in (start, span, which))
    order = np.lexsort((at, k, o))
    number = np.cumsum(np.concatenate(([0], (np.diff(o[order]) != 0) | (np.diff(k[order]) != 0))))
    pair = np.empty(len(order), np.int64)
    pair[order] = number
    late = np.lexsort((start, pair[which]))
    starts = np.arange(number[-1] + 2)
    early_ends, late_ends = (np.searchsorted(x, starts).tolist() for x in (number, pair[which][late]))
    for a0, a1, b0, b1 in zip(early_ends[:-1], early_ends[1:], late_ends[:-1], late_ends[1:], strict=True):
        early, _ = _joined([(int(at[i]), np.frombuffer(runs[i], np.uint64).tolist()) for i in order[a0:a1].tolist()], -1)
        rest, places = _joined([(int(start[i]), lines[start[i] : start[i] + span[i]].tolist()) for i in late[b0:b1].tolist()], -2)
        _mark(gone, counts, [(places[j], n) for _, j, n in patience(early, rest)], min_words)
    for s, n, w in zip(start.tolist(), span.tolist(), which.tolist(), strict=True):
        if not gone[s : s + n].all():
            _mark(gone, counts, [(s + j, m) for _, j, m in patience(np.frombuffer(runs[w], np.uint64).tolist(), lines[s : s + n].tolist())], min_words)
    return _stretches(gone)


def _mark(gone: np.ndarray, counts: np.ndarray, blocks: list[tuple[int, int]], min_words: int) -> None:
    """Sets gone for the blocks (first line, lines) that have min_words words."""
    for s, n in blocks:
        if counts[s : s + n].sum() >= min_words:
            gone[s : s + n] = True


def _stretches(gone: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of True."""
    ends = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).tolist()
    return list(zip(ends[::2], ends[1::2], strict=True))


_BLOCKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _aligned(min_words: int):
    """Rows with lines, counts and what they share with earlier documents -> the blocks that go."""

    @lean
    def run(batches):
        for batch in batches:
            found, shared = [], batch.column("shared")
            ends = (np.asarray(shared.offsets) - shared.offsets[0].as_py()).tolist()
            flat = shared.flatten()
            columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("eo", "ek", "key", "at")]
            runs = flat.field("run").to_pylist()
            for s, e, d, n in zip(ends[:-1], ends[1:], batch.column("lines").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                blocks = common_blocks(np.frombuffer(d, np.uint64), np.frombuffer(n, np.int32), [x[s:e] for x in columns], runs[s:e], min_words)
                found.append([{"a": x, "b": y} for x, y in blocks])
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("k"), pa.array(found, _BLOCKS)], ["o", "k", "blocks"])

    return run


def repeated_blocks(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> o, k, blocks (a, b: lines from 0 among those that aren't blank, end excluded) for each document that loses some.

    The later of two documents is that of larger doc_id (null is the smallest;
    rows of one doc_id and different texts go by a hash). Repeated rows are one
    document and don't lose lines to each other.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).select("o", "k", "text")
    seqs = stored(rows.mapInArrow(_sequences(min_words), "o long, k long, lines binary, counts binary, keys array<struct<key:long,at:int,run:binary>>"), "lines")
    keys = seqs.select("o", "k", F.explode("keys").alias("x"))
    at = F.struct("o", "k")
    first = keys.groupBy("x.key").agg(F.min(F.struct("o", "k", "x.at", "x.run")).alias("first"), F.max(at).alias("last")).where("first.o <> last.o or first.k <> last.k").drop("last")
    held = salted_join(keys.select("o", "k", "x.key"), first, ["key"], F.col("k")).where("o <> first.o or k <> first.k")
    held = held.dropDuplicates(["o", "k", "key"])  # of repeated rows
    run = F.struct(F.col("first.o").alias("eo"), F.col("first.k").alias("ek"), "key", F.col("first.at").alias("at"), F.col("first.run").alias("run"))
    shared = held.groupBy("o", "k").agg(F.collect_list(run).alias("shared"))  # no more than a document's own keys
    whole = seqs.select("o", "k", "lines", "counts").dropDuplicates(["o", "k"])
    found = whole.join(shared, ["o", "k"]).select("o", "k", "lines", "counts", "shared").mapInArrow(_aligned(min_words), "o long, k long, blocks array<struct<a:int,b:int>>")
    return found.where("size(blocks) > 0")


_CUT = "text string, n_removed long"


def _cut(texts: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    """Texts without the lines in blocks (first, end, first, end, ... among the lines that aren't blank)."""
    out = []
    for text, ends in zip(texts, blocks, strict=True):
        if text is None:
            out.append((None, 0))
            continue
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = {filled[j] for a, b in zip(ends[::2], ends[1::2], strict=True) for j in range(a, b)}
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return pd.DataFrame(out, columns=["text", "n_removed"])


@lean
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, blocks in batches:
        yield _cut(texts, blocks)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> row, o, k, text (without the repeated lines), n_lines, n_removed for each row.

    Lines end at line feeds and are equal if their words (runs of other bytes
    than ASCII white space, A-Z lower-cased) are. A null text stays null, with
    no lines; a blank one stays as it is. A document that is a copy of an
    earlier one loses all lines and becomes empty, if it has `min_words` words.
    Repeated rows get the same result each; no rows give none; other columns
    stay in `row`.
    """
    found = repeated_blocks(docs, min_words, id_col, text_col).withColumn("ends", F.flatten(F.transform("blocks", lambda x: F.array(x["a"], x["b"]))))
    whole = keyed(docs, id_col, text_col).join(found.select("o", "k", "ends"), ["o", "k"], "left")
    once = F.pandas_udf(_cuts, _CUT).asNondeterministic()  # else a filter above runs it a second time, in a worker of its own
    cut = whole.withColumn("cut", once(F.when(F.col("ends").isNotNull(), F.col("text")), F.coalesce("ends", F.expr("cast(array() as array<int>)"))))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    return cut.select("row", "o", "k", F.coalesce("cut.text", "text").alias("text"), n_lines.alias("n_lines"), F.col("cut.n_removed").alias("n_removed"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs' rows with the repeated lines cut from their text and `length_col` (if there is one) set anew.

    Rows whose text loses all its lines go; rows that lose nothing stay whole.
    """
    cut = deduplicated(docs, min_words, id_col, text_col).where(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    row = F.col("row").withField(f"`{text_col}`", F.col("text"))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        row = row.withField(f"`{length_col}`", F.when(F.col("n_removed") == 0, F.col(f"row.`{length_col}`")).otherwise(F.length("text").cast(kind)))
    return cut.select(row.alias("row")).select("row.*")
