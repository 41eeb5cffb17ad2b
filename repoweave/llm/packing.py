"""Packing documents into training sequences.

Documents are tokenised and cut into pieces of at most a sequence each where
they are read; only thin rows (length, checksum) move. Pieces then meet in
randomised groups of bounded size, and each group is packed by first-fit
decreasing over a tournament tree of bin capacities.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import LOWEST, bounded_batches, keyed, lean, stored

SEQUENCE = 4096
END_ID = 2
#: Documents in a randomised group, on average.
GROUP_DOCS = 20_000
_SLICE_BYTES = 4 << 20
_MOST_CACHED = 200_000


def _byte_letters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    more = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(more)) for b in range(256)]


_BYTES = _byte_letters()
#: What the short way takes: visible ASCII without the apostrophe (contractions), and the Latin-1 letters, which NFC leaves alone.
_PLAIN = re.compile("[!-&(-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PARTS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


class _Encoder:
    """Token ids of many texts.

    Pieces between ASCII white space are encoded once each, as no token reaches
    across it. Where the tokenizer lower-cases and splits into letters, single
    digits and other runs (`short`), plain pieces are split here and only parts
    not seen before go to its model; all others go through it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        self.short = self._can_be_short()

    def _can_be_short(self) -> bool:
        """Whether the short way gives the tokenizer's own ids for a trial of all plain characters, alone and together."""
        plain = [chr(c) for c in range(0x21, 0x100) if _PLAIN.fullmatch(chr(c))]
        trial = plain + [a + b for a in "aZ0.\xc9\xdf-" for b in plain] + ["".join(plain[i : i + 7]) for i in range(len(plain))]
        return all(np.frombuffer(self._plain(x), np.uint32).tolist() == self.tokenizer.encode(x, add_special_tokens=False).ids for x in trial if "<|" not in x)

    def _plain(self, word: str) -> bytes:
        known, out = self.known, []
        for part in _PARTS.findall(word.lower()):
            ids = known.get(part)
            if ids is None:
                tokens = self.model.tokenize(part if part.isascii() else "".join([_BYTES[b] for b in part.encode()]))
                ids = known[part] = array("I", [t.id for t in tokens]).tobytes()
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > _MOST_CACHED:
            self.known.clear()
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if self.short and _PLAIN.fullmatch(w) and "<|" not in w:
                out[i] = self._plain(w)
            else:
                rest.append(i)
        for at in range(0, len(rest), 8192):
            group = rest[at : at + 8192]
            for i, e in zip(group, self.tokenizer.encode_batch_fast([words[i] for i in group], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and the bounds of each text's."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        own = self._words(words)
        sizes = np.array([len(x) // 4 for x in own] or [0], np.int64)
        flat = np.frombuffer(b"".join(own), np.uint32)
        begin = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        before = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(begin[codes] - before[:-1], n) + np.arange(before[-1])] if len(codes) else flat[:0]
        words_at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))))
        return ids, before[words_at]


def _slices(texts: pa.Array):
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE_BYTES, "right")))
        yield at, texts.slice(at, to - at)
        at = to


_PIECE = "o long, k long, dealt long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, sequence: int, end_id: int):
    @lean
    def run(batches):
        encode = _Encoder(path)
        context = TaskContext.get()
        chance = np.random.default_rng(context.partitionId() if context else 0)
        for batch in batches:
            o, k = batch.column("o").to_pylist(), batch.column("k").to_pylist()
            out = []
            for first, texts in _slices(batch.column("text").fill_null("")):
                ids, bounds = encode(texts)
                dealt = chance.integers(0, 1 << 62, len(texts)).tolist()
                for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(ids[s:e], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), sequence):
                        piece = own[at : at + sequence]
                        out.append((o[first + i], k[first + i], dealt[i], at, len(piece), zlib.crc32(piece.tobytes()), len(own)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["o", "k", "dealt", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; bins are tried from the first, sizes placed from the largest.

    The tree's leaves are the bins' free capacities, each node has the larger
    of its two: the first bin with room is found from the root down. A size
    over the capacity is an error.
    """
    if max(sizes, default=0) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if free[at] < size:
                at += 1
        out[i] = (at - leaves, capacity - free[at])
        free[at] -= size
        while at > 1:
            at //= 2
            top = max(free[2 * at], free[2 * at + 1])
            if free[at] == top:
                break
            free[at] = top
    return out


def _packed(sequence: int, groups: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "k", "start"], kind="stable")
        at = first_fit_decreasing(rows["length"].tolist(), sequence)
        return rows.assign(sequence_id=[b * groups + int(key[0]) for b, _ in at], offset=[x for _, x in at]).drop(columns=["dealt", "part"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.

    A document is its tokenizer's ids and end_id, cut after every `sequence`
    ids; each id is in one piece. A sequence is filled from 0 without gaps.
    Null and empty texts have just end_id. Repeated rows are packed each on its
    own; null ids stay null; no rows give none; other columns have no part.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).select("o", "k", "text")
    pieces = stored(rows.mapInArrow(_pieces(tokenizer_path, sequence, end_id), _PIECE), "pieces")
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))
    packed = pieces.withColumn("part", F.pmod("dealt", F.lit(groups))).groupBy("part").applyInPandas(
        _packed(sequence, groups), "o long, k long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return packed.select(F.when(F.col("o") != LOWEST, F.col("o")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
