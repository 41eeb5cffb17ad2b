"""Document fingerprints: a digest of the canonical text.

The canonical text is decomposed (NFD), case-folded in full (so STRASSE and
straße are one) and has each run of white space as one space. Its digest is two XXH64 sums; buckets of equal digests are
confirmed by comparing the canonical texts' bytes. DataFrame functions only.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, among, keyed, salted_join, stored

_DENSE = 0x3400
_HANGUL = 0xAC00
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Bytes of text in a range of ids, and the most ranges (a range of 100 TB has 100 MB then); ranges meet at their ends by a join.
_RANGE_BYTES, _MOST_RANGES = 4 << 20, 1 << 20
_SPLITS = 1024


@cache
def _decompositions() -> tuple[str, str, str]:
    """By the Unicode tables: the decomposition of each code point below _DENSE; JSON maps of those above and of combining classes."""
    dense = [unicodedata.normalize("NFD", chr(c)) for c in range(_DENSE)]
    above = {chr(c): d for c in range(_DENSE, 0x110000) if not 0xD800 <= c < 0xE000 and not _HANGUL <= c < _HANGUL + 11172 and (d := unicodedata.normalize("NFD", chr(c))) != chr(c)}
    classes = {chr(c): n for c in range(0x110000) if (n := unicodedata.combining(chr(c)))}
    return "￿".join("" if i == 0 else x for i, x in enumerate(dense)), json.dumps(above), json.dumps(classes)


@cache
def _mark_ranges() -> str:
    """The characters of combining classes other than 0, as ranges of a regular expression's class."""
    codes = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    starts = [c for c in codes if c - 1 not in set(codes[max(0, bisect_left(codes, c) - 1) : bisect_left(codes, c)])]
    ends = [codes[i - 1] for i in [bisect_left(codes, c) for c in starts[1:]]] + codes[-1:]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once and once in the plan, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decomposed_character(c: Column, code: Column) -> Column:
    dense, above, _ = _decompositions()
    jamo = lambda first, n: F.split(F.lit(",".join(chr(first + i) if first + i != 0x11A7 else "" for i in range(n))), ",")
    s = code - _HANGUL
    hangul = F.concat(
        F.element_at(jamo(0x1100, 19), F.floor(s / 588).cast("int") + 1), F.element_at(jamo(0x1161, 21), F.floor(s % 588 / 28).cast("int") + 1), F.element_at(jamo(0x11A7, 28), (s % 28).cast("int") + 1)
    )
    return (
        F.when(code < 0xC0, c)
        .when(code < _DENSE, F.element_at(F.split(F.lit(dense), "￿"), code + 1))
        .when((code >= _HANGUL) & (code < _HANGUL + 11172), hangul)
        .when(((code >= 0xF900) & (code < 0xFB50)) | (code >= 0x11000), F.coalesce(F.try_element_at(F.from_json(F.lit(above), "map<string,string>"), c), c))
        .otherwise(c)
    )


def nfd(text: Column) -> Column:
    """The canonical decomposition: what is beyond U+00BF goes by table, then runs of marks are put in order."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x{C0}-\x{10FFFF}]|[\x{0}-\x{BF}]+"), F.lit(0))
    apart = F.array_join(F.transform(parts, lambda c: _decomposed_character(c, F.ascii(c))), "")
    apart = F.when(text.rlike(r"[\x{C0}-\x{10FFFF}]"), apart).otherwise(text)
    _, _, classes = _decompositions()
    order = lambda c: F.coalesce(F.try_element_at(F.from_json(F.lit(classes), "map<string,int>"), c), F.lit(0))

    def ordered(run: Column) -> Column:
        marks = F.transform(F.split(run, ""), lambda c, i: F.struct(order(c).alias("n"), i.alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(marks), lambda x: x["c"]), "")

    marks = _mark_ranges()

    def put_in_order(apart: Column) -> Column:
        runs = F.regexp_extract_all(apart, F.lit(f"[{marks}]+|[^{marks}]+"), F.lit(0))
        sorted_ = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{marks}]{{2}}"), ordered(r)).otherwise(r)), "")
        return F.when(text.rlike(r"[\x{300}-\x{10FFFF}]") & apart.rlike(f"[{marks}]{{2}}"), sorted_).otherwise(apart)

    return _with(apart, put_in_order)


@cache
def _folds() -> dict[str, str]:
    """Of decomposed lower-case characters: those that full case folding takes further, and to what."""
    out = {}
    for c in map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)):
        if unicodedata.normalize("NFD", c) == c == c.lower() and (t := unicodedata.normalize("NFD", c.casefold()).lower()) != c:
            out[c] = t
    return out


def folded(text: Column) -> Column:
    """Decomposed text in full case folding; it stays decomposed, as no fold begins or ends with a mark."""
    folds = _folds()
    one = {c: t for c, t in folds.items() if len(t) == 1}

    def further(low: Column) -> Column:
        out = F.translate(low, "".join(one), "".join(one.values()))
        for c, t in folds.items():
            if c not in one:
                out = F.replace(out, F.lit(c), F.lit(t))
        return F.when(low.rlike(f"[{''.join(folds)}]"), out).otherwise(low)

    return _with(F.lower(text), further)


def canonical(text: Column) -> Column:
    """The canonical text; null becomes empty."""
    return F.trim(F.regexp_replace(folded(nfd(F.coalesce(text, F.lit("")))), _SPACE, " "))


def fingerprint(text: Column) -> Column:
    """128 bits, as hex, of the canonical text: XXH64 under two seeds."""
    return _with(canonical(text), lambda t: F.concat(*[F.lower(F.lpad(F.hex(h), 16, "0")) for h in (F.xxhash64(t), F.xxhash64(F.lit("wide"), t))]))


def _ranged(docs: DataFrame) -> DataFrame:
    """docs with `range`, a struct that grows with (o, k), over ranges of about _RANGE_BYTES of text each.

    An o with more text than a range is cut further by k, a hash. What reaches
    the driver are _SPLITS quantiles; finer ones stay in a small table.
    """
    shares = lambda n: F.from_json(F.lit(json.dumps([i / n for i in range(1, n)])), "array<double>")
    size, splits = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.percentile_approx("o", shares(_SPLITS), 20 * _SPLITS)).first()
    n = min(_MOST_RANGES, max(1, -(-size // _RANGE_BYTES)))
    if n == 1 or splits is None:
        return docs.withColumn("range", F.struct(F.lit(0).alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("part")))
    if n < _SPLITS:
        splits = [splits[i * _SPLITS // n - 1] for i in range(1, n)]
    splits = sorted(set(splits))
    groups = [splits[i : i + 32] for i in range(0, len(splits), 32)]  # two steps of at most 32 comparisons
    upper = F.size(F.filter(F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>"), lambda s: s <= F.col("o")))
    inner = F.element_at(F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>"), F.greatest(upper, F.lit(1)))
    at = F.greatest(upper - 1, F.lit(0)) * 32 + F.size(F.filter(inner, lambda s: s <= F.col("o")))
    share = max(_RANGE_BYTES, size // n)
    hot = stored(docs.groupBy("o").agg(F.sum(F.octet_length("text") + 64).alias("bytes")).where(F.col("bytes") > share).select("o", F.ceil(F.col("bytes") / share).cast("double").alias("parts")), "hot-ids")  # fewer than ranges
    rows, hot = docs.withColumn("at", at), hot.withColumn("at", at)
    if n > _SPLITS:
        each = -(-n // _SPLITS)
        fine = stored(rows.groupBy("at").agg(F.percentile_approx("o", shares(each), 20 * each).alias("fine")), "splits")
        rows, hot = (df.join(F.broadcast(fine), "at").withColumn("at", F.col("at") * each + F.size(F.filter("fine", lambda s: s <= F.col("o")))).drop("fine") for df in (rows, hot))
    hot = hot.groupBy("at").agg(F.collect_list(F.struct("o", "parts")).alias("hot"))
    rows = rows.join(F.broadcast(hot), "at", "left").withColumn("hot", F.coalesce("hot", F.expr("cast(array() as array<struct<o:bigint,parts:double>>)")))
    own = F.filter("hot", lambda h: h["o"] == F.col("o"))
    turn = 2 * F.size(F.filter("hot", lambda h: h["o"] < F.col("o"))) + F.size(own)
    part = F.floor((F.col("k").cast("double") / 2.0**64 + 0.5) * F.coalesce(F.get(own, 0)["parts"], F.lit(0.0)))
    return rows.withColumn("range", F.struct(F.col("at"), turn.alias("turn"), part.cast("int").alias("part"))).drop("at", "hot")


def with_next(docs: DataFrame, more: dict[str, Column]) -> DataFrame:
    """docs (o, k, text) and more columns -> with next, the row of the next smaller (o, k) as a struct; of the smallest, the largest's.

    One shuffle of the rows by ranges of (o, k). Only the first row of each range
    is fetched for the range above it: its key is broadcast, one for each of at
    most _MOST_RANGES ranges and as many cuts of hot ids.
    """
    rows = _ranged(docs)
    tops = stored(rows.groupBy("range").agg(F.max(F.struct("o", "k")).alias("top")), "tops")
    down = Window.orderBy(F.desc("range"))  # one row for each range
    wrap = F.first("top").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    keys = stored(tops.select(F.col("range").alias("above"), F.coalesce(F.lead("top").over(down), wrap).alias("t")).select("above", "t.o", "t.k"), "heads")
    # the first row of the range below stands behind a range's own rows, so that nothing is joined to them
    head = docs.join(F.broadcast(keys), ["o", "k"]).select(F.col("above").alias("range"), F.lit(1).alias("extra"), "o", "k", "text")
    both = rows.select("range", F.lit(0).alias("extra"), "o", "k", "text").union(head).repartition("range").withColumns(more)  # dealt before the columns are made, or either side would make its own
    order = Window.partitionBy("range").orderBy("extra", F.desc("o"), F.desc("k"))
    fields = F.struct("o", "k", "text", *more)
    return both.withColumn("next", F.lead(fields).over(order)).where("extra = 0").drop("range", "extra")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> o, k, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next for each row.

    The edited text's last floor(n_chars / 2) code points are the first as many
    (or all) of the next document by descending doc_id (null is the smallest;
    rows of one id go by a hash; a repeated row's next may be its copy; the
    smallest's is the largest's). Null texts are empty. A digest is like another
    (1) or not (0). No rows give none; other columns have no part.
    """
    rows = keyed(docs, id_col, text_col).select("o", "k", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, {"fingerprint": fingerprint(F.col("text"))}).select("o", "k", F.length("text").alias("n"), "text", "fingerprint", F.col("next.fingerprint").alias("next"), F.col("next.text").alias("head"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.expr("n div 2").cast("int")), F.substring("head", F.lit(1), F.expr("n div 2").cast("int"))))
    rows = rows.select("o", "k", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next")
    like = lambda a: (F.col("fingerprint") == F.col(a)).cast("double")
    return rows.select("o", "k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next").alias("near_next"))


def groups(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and their prints (o, k, fingerprint, more) -> prints with group_id (its least doc_id) and group_size.

    Rows are of one group if their canonical texts are equal byte by byte: in
    each bucket of several rows the smallest and the largest text are compared,
    and a bucket where they differ is split by a longer digest. A group whose
    ids are all null has a null id.
    """
    shared = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    member = salted_join(prints.select("o", "k", "fingerprint"), shared, ["fingerprint"], F.col("k"), salts=4).dropDuplicates(["o", "k"])
    member = stored(member, "shared")
    texts = keyed(docs, id_col, text_col).select("o", "k", "text").where(among(member)).join(member, ["o", "k"]).select("o", "k", "fingerprint", canonical(F.col("text")).alias("text"))
    bad = stored(texts.groupBy("fingerprint").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("fingerprint"), "collisions")
    out = prints.withColumn("own", F.col("fingerprint"))
    if not bad.isEmpty():
        longer = texts.join(bad, "fingerprint", "left_semi").select("o", "k", F.sha2("text", 512).alias("longer")).dropDuplicates(["o", "k"])
        out = out.join(longer, ["o", "k"], "left").withColumn("own", F.concat("fingerprint", F.coalesce("longer", F.lit("")))).drop("longer")
    sizes = out.groupBy("own").agg(F.count("*").alias("group_size"), F.min(F.when(F.col("o") != LOWEST, F.col("o"))).alias("group_id")).where("group_size > 1")
    out = salted_join(out, sizes, ["own"], F.col("k"), "left", 4).drop("own")
    return out.withColumn("group_id", F.when(F.col("group_size").isNull(), F.when(F.col("o") != LOWEST, F.col("o"))).otherwise(F.col("group_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
