"""URL filtering with the ratio of two character language models.

Rules label the URLs that they fit. Two smoothed variable-order Markov models,
of the accepted and of the rejected ones, judge the rest: the difference of
their log-likelihoods, by length, against a threshold. A character's context is
as long as it was seen often enough, three characters at most. The models learn
from four fifths (13 of 16) of the labelled URLs, the threshold is calibrated on
the others. DataFrame functions only; log-probabilities are rounded to
millionths so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_az, stored

#: (verdict, host, path): a rule fits its host, all subdomains, and paths that start with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters as the models see them: digits are 0, all others that aren't here are _, and ^ stands before the first and after the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_^"
_EDGE = len(ALPHABET) - 1
#: Weight of the shorter context's estimate, as if it had been seen so often.
PRIOR = 4.0
#: A context counts from so many sightings among the accepted and rejected URLs together; below, the shorter one stands for it.
SEEN = 8
#: Scores are calibrated in steps of a hundredth, from -10 to 10.
_STEP, _MOST = 10_000, 1_000


def host_of(url: Column | str) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return lower_az(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column | str) -> Column:
    """What follows the host up to ? # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path, of equal ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _codes(url: Column) -> Column:
    """The numbers of a URL's characters, and that of ^ at its end."""
    plain = F.regexp_replace(F.translate(lower_az(url), "123456789", "000000000"), r"(?s)[^a-z0/.-]", "_")
    codes = F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.concat(F.when(plain == "", F.expr("cast(array() as array<int>)")).otherwise(codes), F.array(F.lit(_EDGE)))


def _counts(seen: DataFrame, code: Column, size: int) -> Column:
    """A scalar: for each code below size, the cells' sightings (a: allowed, b: blocked) summed."""
    sums = seen.groupBy(code.cast("long").alias("id")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    full = seen.sparkSession.range(size).join(sums, "id", "left").fillna(0, ["a", "b"])
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "a", "b"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("x")).scalar()


def train(labelled: DataFrame) -> DataFrame:
    """labelled (codes, verdict: allow or block) -> one row: `model`, the log-ratios of all characters after three others, and `both`.

    An estimate from a context leans on that from the context without its first
    character, down to equal chances, and a context of fewer than SEEN sightings
    is left to the shorter one. Every labelled row counts. The row's size is
    fixed by the alphabet: 32**4 longs. both says that either verdict was there.
    """
    n = len(ALPHABET)
    edge = F.lit(_EDGE)
    fours = F.arrays_zip(F.concat(F.array(edge, edge, edge), "codes").alias("o"), F.concat(F.array(edge, edge), "codes").alias("p"), F.concat(F.array(edge), "codes").alias("q"), F.col("codes").alias("c"))
    cells = F.transform(F.slice(fours, 1, F.size("codes")), lambda x: ((x["o"] * n + x["p"]) * n + x["q"]) * n + x["c"]).cast("array<long>")
    seen = labelled.select("verdict", F.explode(cells).alias("cell")).groupBy("cell").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    seen = stored(seen, "url-cells")
    spark, cell = labelled.sparkSession, F.col("cell")
    full = spark.range(n**4).select(F.col("id").alias("cell")).join(seen.withColumnsRenamed({"a": "a3", "b": "b3"}), "cell", "left").fillna(0, ["a3", "b3"])
    whole = seen.agg(F.struct(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))).scalar()
    full = full.withColumn("all", whole)
    for order in range(3):  # sightings of the last order + 1 characters
        size = n ** (order + 1)
        full = full.withColumn(f"n{order}", F.element_at(_counts(seen, F.pmod(cell, F.lit(size)), size), F.pmod(cell, F.lit(size)).cast("int") + 1))
    for order in range(1, 4):  # sightings of the `order` characters before the last
        size = n**order
        context = F.pmod(F.expr(f"cell div {n}"), F.lit(size))
        full = full.withColumn(f"s{order}", F.element_at(_counts(seen, context, size), context.cast("int") + 1))
    for x in ("a", "b"):
        p = (F.col(f"n0.{x}") + PRIOR / n) / (F.col(f"all.{x}") + PRIOR)
        for order in range(1, 4):
            own = F.col(f"{x}3") if order == 3 else F.col(f"n{order}.{x}")
            often = F.col(f"s{order}.a") + F.col(f"s{order}.b") >= SEEN
            full = full.withColumn(f"p{x}{order}", F.when(often, (own + PRIOR * p) / (F.col(f"s{order}.{x}") + PRIOR)).otherwise(p))
            p = F.col(f"p{x}{order}")
    ratio = F.round((F.log("pa3") - F.log("pb3")) * 1_000_000).cast("long")
    one = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", ratio.alias("r")))), lambda x: x["r"]).alias("model"))
    return one.withColumn("both", (whole["a"] > 0) & (whole["b"] > 0))


def score(codes: str, model: str) -> Column:
    """The mean log-ratio of a URL's characters in millionths, rounded down."""
    n = len(ALPHABET)
    first = (_EDGE * n + _EDGE) * n + _EDGE
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(first).alias("context"))
    step = lambda a, c: F.struct((a["s"] + F.element_at(F.col(model), a["context"] * n + c + 1)).alias("s"), F.pmod(a["context"] * n + c, F.lit(n**3)).alias("context"))
    return F.floor(F.aggregate(codes, start, step)["s"] / F.size(codes))


def calibrated(scored: DataFrame) -> DataFrame:
    """scored (step, verdict) of labelled URLs that the models don't know -> one row: `least`, the step from which on URLs are allowed.

    It is the one with the best balanced accuracy; of equal ones the nearest to
    0, then the smaller. It is null unless both verdicts occur.
    """
    steps = scored.groupBy("step").agg(F.count_if(F.col("verdict") == "allow").cast("decimal(38,0)").alias("a"), F.count_if(F.col("verdict") == "block").cast("decimal(38,0)").alias("b"))
    upto = Window.orderBy("step")  # at most 2001 rows
    everything = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    all_a, all_b = F.sum("a").over(everything), F.sum("b").over(everything)
    right = ((all_a - F.coalesce(F.sum("a").over(before), F.lit(0))) * all_b + F.coalesce(F.sum("b").over(before), F.lit(0)) * all_a).cast("decimal(38,0)")
    good = steps.select("step", right.alias("good"), all_a.alias("all_a"), all_b.alias("all_b")).where("all_a > 0 and all_b > 0")
    return good.agg(F.min_by("step", F.struct(-F.col("good"), F.abs("step"), F.col("step"))).alias("least"))


def held_out(url: Column) -> Column:
    """Three sixteenths of all URLs, by their digest: those that calibrate and don't train. A null URL counts as an empty text."""
    return F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 1).isin("0", "1", "2")


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages -> page_id, host, path, rule, verdict, score (millionths) for each row.

    A rule decides where one fits (rule names it). Elsewhere the models do:
    allowed if the score's step is at least the calibrated one, or 0 where the
    held-out URLs don't have both verdicts. Null URLs and those without :// have
    an empty host and path and are judged by the models (a null one as an empty
    text); all are allowed if either verdict has no URL to learn from. Repeated
    rows each get their row; no rows give none; other columns have no part.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), _codes(F.col(url_col)).alias("codes"), held_out(F.col(url_col)).alias("held_out"))
    rule, verdict = ruled(rules)
    rows = rows.withColumns({"rule": rule, "ruling": verdict})
    labelled = rows.where("ruling is not null").select("codes", F.col("ruling").alias("verdict"), "held_out")
    model = stored(train(labelled.where("not held_out")), "urlmodel")
    step = F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(F.col("score") / _STEP)))
    scored = lambda df: df.withColumn("model", model.select("model").scalar()).withColumn("score", score("codes", "model")).withColumn("step", step).drop("model")
    least = stored(calibrated(scored(labelled.where("held_out"))), "urlthreshold")
    out = scored(rows).withColumns({"least": least.scalar(), "both": model.select("both").scalar()})
    learned = F.when(~F.col("both") | (F.col("step") >= F.coalesce("least", F.lit(0))), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", learned).alias("verdict"), "score")
