"""Language identification with bit-sliced Bloom filters of n-grams.

One filter array has a bitmask of languages in each slot; the masks of an
n-gram's slots, and-ed, are all languages that contain it, however rarely. A
second bit of each language says whether the n-gram is at home there: not far
rarer than where it is most common. A text's languages get their popcounts over
its n-grams, less what the filter's fill lets through by chance; an n-gram
counts once where it is contained and once more where it is at home, and the
largest sum decides. So words of other languages in a large corpus, whose
n-grams every language contains in the end, don't blur the decision.

N-grams are four bytes of the text with A-Z lower-cased and every other ASCII
character as a space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, bounded_batches, keyed, lean, stored
from .vecwords import chunks, mix

HASHES = 3
#: An n-gram isn't at home in a language if its share there is less than this part of its largest share in a language.
FOREIGN = 1 / 32
#: Slots for each n-gram, and the most slots (8 bytes each for 63 bits, two a language); beyond that the filter fills up and more popcounts are corrected.
_SPARE, _MOST_SLOTS = 8, 1 << 23
#: A chunk has an n-gram for each byte, and these some dozen arrays.
_CHUNK_BYTES = 1 << 19
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _grams(texts):
    """(first row, rows, n-grams, their rows) for each chunk of texts; n-grams of spaces alone are none."""
    for a, b, data, offsets in chunks(texts, _CHUNK_BYTES):
        x = _LETTERS[data].astype(np.uint32)
        if len(x) < 4:
            yield a, b - a, np.zeros(0, np.uint32), np.zeros(0, np.int64)
            continue
        gram = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
        owner = np.repeat(np.arange(b - a), np.diff(offsets))
        ok = (owner[:-3] == owner[3:]) & ~((x[1:-2] == 32) & (x[2:-1] == 32)) & (gram != 0x20202020)
        yield a, b - a, gram[ok], owner[:-3][ok]


class _Counts:
    """Counts of n-grams, with pending arrays merged now and then."""

    def __init__(self):
        self.gram, self.n, self.more = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

    def add(self, gram):
        self.more.append(np.unique(gram, return_counts=True))
        if len(self.more) >= 16:
            self.merge()

    def merge(self):
        gram = np.concatenate([self.gram, *(g for g, _ in self.more)])
        n = np.concatenate([self.n, *(n for _, n in self.more)])
        self.gram, back = np.unique(gram, return_inverse=True)
        self.n, self.more = np.bincount(back, n, len(self.gram)).astype(np.int64), []


@lean
def _counted(batches):
    by = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        for a, n, gram, owner in _grams(batch.column("text")):
            own = lang[a : a + n]
            for name in sorted(set(own.tolist())):
                by.setdefault(name, _Counts()).add(gram[(own == name)[owner]])
    for name, counts in by.items():
        counts.merge()
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts.gram), pa.string()), pa.array(counts.gram.astype(np.int64)), pa.array(counts.n)], ["lang", "gram", "n"])


class Filter:
    """The bit-sliced filter: `masks` (slots x words of 63 bits), the languages, the share of slots each bit fills.

    Bit i is language i's, bit i + the number of languages says that an n-gram is at home there.
    """

    def __init__(self, languages: list[str], masks: np.ndarray, hashes: int):
        self.languages, self.masks, self.hashes = languages, masks, hashes
        self.filled = np.array([((masks[:, i // 63] >> np.uint64(i % 63)) & np.uint64(1)).mean() for i in range(2 * len(languages))])

    def popcounts(self, gram: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of each row, those that each language contains (rows x languages), and those at home there, without the expected false positives."""
        masks = None
        for slots in slots_of(gram, self.hashes, len(self.masks)):
            masks = self.masks[slots] if masks is None else masks & self.masks[slots]
        total = np.bincount(owner, minlength=n)
        hits = np.zeros((n, len(self.filled)))
        for i in range(len(self.filled)):
            bit = (masks[:, i // 63] >> np.uint64(i % 63)) & np.uint64(1)
            hits[:, i] = np.bincount(owner[bit.astype(bool)], minlength=n)
        chance = self.filled**self.hashes
        true = np.maximum(0, (hits - total[:, None] * chance) / np.maximum(1 - chance, 1e-9))
        return total, true[:, : len(self.languages)], true[:, len(self.languages) :]


def slots_of(gram: np.ndarray, hashes: int, slots: int) -> list[np.ndarray]:
    return [(mix(gram.astype(np.uint64) + np.uint64((i + 1) << 40)) % np.uint64(slots)).astype(np.int64) for i in range(hashes)]


def _slotted(hashes: int, slots: int):
    @lean
    def run(batches):
        for batch in batches:
            each = slots_of(batch.column("gram").to_numpy(zero_copy_only=False), hashes, slots)
            again = [np.tile(batch.column(c).to_numpy(zero_copy_only=False), hashes) for c in ("word", "mask")]
            yield pa.RecordBatch.from_arrays([pa.array(again[0]), pa.array(again[1]), pa.array(np.concatenate(each))], ["word", "mask", "slot"])

    return run


def train(labelled: DataFrame, foreign: float = FOREIGN, hashes: int = HASHES, text_col: str = "text", lang_col: str = "lang") -> Filter:
    """All rows of labelled with a language -> the filter. Languages are ordered from the most frequent; null texts teach nothing.

    What reaches the driver is the languages and the filter's words, at most
    _MOST_SLOTS for 31 languages.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit("")), F.lit(" ")).alias("text"))
    counts = stored(rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("total")), "languages")
    languages = [r["lang"] for r in totals.orderBy(F.desc("total"), "lang").collect()]
    if not languages:
        return Filter([], np.zeros((1, 1), np.uint64), hashes)
    numbers = labelled.sparkSession.createDataFrame(list(enumerate(languages)), "i long, lang string").join(totals, "lang")
    shares = counts.join(F.broadcast(numbers), "lang").select("gram", (F.col("n") / F.col("total")).alias("share"), "i")
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    slots = min(_MOST_SLOTS, 1 << (_SPARE * top.count()).bit_length())
    bits = F.when(F.col("share") >= foreign * F.col("top"), F.array("i", F.col("i") + len(languages))).otherwise(F.array("i"))
    own = shares.join(top, "gram").select("gram", F.explode(bits).alias("b")).select("gram", F.expr("b div 63").alias("word"), F.expr("shiftleft(1L, cast(b % 63 as int))").alias("mask"))
    own = own.groupBy("gram", "word").agg(F.bit_or("mask").alias("mask"))
    placed = own.mapInArrow(_slotted(hashes, slots), "word long, mask long, slot long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    words = placed.toArrow()
    masks = np.zeros((slots, -(-2 * len(languages) // 63)), np.uint64)
    masks[words.column("slot").to_numpy(), words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return Filter(languages, masks, hashes)


def _predicted(shared):
    @lean
    def run(batches):
        model = shared.value
        for batch in batches:
            names, scores = [], []
            letter = batch.column("letter").to_pylist()
            for a, n, gram, owner in _grams(batch.column("text")):
                if model.languages:
                    total, contained, home = model.popcounts(gram, owner, n)
                    best = (contained + home).argmax(axis=1)  # of equal ones the more frequent language
                    share = np.clip(home[np.arange(n), best] / np.maximum(total, 1), 0, 1)
                for i in range(n):
                    known = model.languages and letter[a + i]
                    names.append(model.languages[best[i]] if known else "und")
                    scores.append(float(share[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("k"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["o", "k", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> o, k, doc_id, lang_pred, score (the share of n-grams that are at home in the language) for each row.

    A text that is null or has no letter is `und` with score 0, as all are if
    nothing was learned; a text without known n-grams gets the most frequent
    language with score 0. Repeated rows each get their row; other columns have
    no part.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    rows = rows.select("o", "k", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("text"))
    found = rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), "o long, k long, lang_pred string, score double")
    return found.select("o", "k", F.when(F.col("o") != LOWEST, F.col("o")).alias("doc_id"), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """A third of all ids: those whose CRC-32, as text, leaves 1 when divided by 3. Null isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_known_language(docs: DataFrame, min_score: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs' rows whose language is recognised: not `und`, and score at least min_score. It learns from docs' own labels outside held_out."""
    model = train(docs.where(~held_out(id_col)), text_col=text_col, lang_col=lang_col)
    good = predict(docs, model, id_col, text_col).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("o", "k")
    return keyed(docs, id_col, text_col).join(good, ["o", "k"], "left_semi").select("row.*")
