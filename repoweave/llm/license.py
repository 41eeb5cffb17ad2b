"""License scan with ordered signature rules.

A text becomes its words with one space between them. Each rule's keyword is
looked for first, and only rules with a keyword in the text run their
expression. A detection that lies within another of higher priority (of equal
priority: a longer one, or one of an earlier rule) is suppressed. DataFrame
functions only, and no shuffle: a row's result comes from the row.
"""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_rules
from .common import LOWEST, collected, lower_az, order_key

#: A rule's confidence by its priority.
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 1.0}
_FOUND = "struct<s:int,e:int,priority:int,number:int,label:string,base:boolean>"
_RULE = "struct<number:int,base:boolean,label:string,priority:int,expression:string>"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def _detections(text: Column, rule: Column) -> Column:
    """The leftmost matches of a rule that don't overlap: start and end in words, and the rule's columns."""
    marked = F.split(F.regexp_replace(text, F.concat(F.lit("(?<= )(?:"), rule["expression"], F.lit(")(?= )")), F.lit("\x01$0\x02")), "\x01")
    # the state is the number of spaces so far, or -1 before the first piece, which holds no match
    after = lambda n, piece: F.greatest(n, F.lit(0)) + _spaces(piece)

    def item(n, piece):
        own = F.substring_index(piece, "\x02", 1)
        return F.when(n >= 0, F.struct((n - 1).alias("s"), (n + _spaces(own)).alias("e"), *[rule[c].alias(c) for c in ("priority", "number", "label", "base")]))

    return F.array_compact(collected(marked, F.lit(-1), _FOUND, item, after))


def scan(docs: DataFrame, rules: list[dict] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, n_words, base (all detections of base rules), kept (those not suppressed), score, for each row.

    A detection has s and e (words from 0, end excluded), priority, number and
    label. score is the largest confidence of a kept detection, 0 without one.
    Null and empty texts have no words and no detections. Repeated rows each get
    their row; no rows give none; other columns have no part.
    """
    rules = license_rules.rules() if rules is None else rules
    fields = ("number", "base", "label", "priority", "expression")
    by = [{"keyword": k, "rules": [{f: r[f] for f in fields} for r in g]} for k, g in groupby(sorted(rules, key=lambda r: r["keyword"]), key=lambda r: r["keyword"])]
    table = F.from_json(F.lit(json.dumps(by)), f"array<struct<keyword:string,rules:array<{_RULE}>>>")
    words = F.concat(F.lit(" "), F.regexp_replace(lower_az(F.col(text_col)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    rows = docs.select(order_key(id_col).alias("o"), F.regexp_replace(words, "^  +| +$", " ").alias("words"))
    found = F.flatten(F.transform(F.filter(table, lambda g: F.contains(F.col("words"), g["keyword"])), lambda g: F.flatten(F.transform(g["rules"], lambda r: _detections(F.col("words"), r)))))
    order = F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), (-x["priority"]).alias("rank"), x["number"].alias("number"), x.alias("own")))
    rows = rows.select("o", F.greatest(_spaces(F.col("words")) - 1, F.lit(0)).cast("long").alias("n_words"), F.transform(F.array_sort(order), lambda x: x["own"]).alias("found"))
    # what contains a detection stands before it in this order, so it is enough to know how far those of no lower priority reach
    levels = sorted({r["priority"] for r in rules}) or [0]
    reach = lambda a, x: F.coalesce(*[F.when(x["priority"] == p, a[f"p{p}"]) for p in levels], F.lit(0))
    further = lambda a, x: F.struct(*[F.when(x["priority"] >= p, F.greatest(a[f"p{p}"], x["e"])).otherwise(a[f"p{p}"]).alias(f"p{p}") for p in levels])
    kept = F.array_compact(collected(F.col("found"), F.struct(*[F.lit(0).alias(f"p{p}") for p in levels]), _FOUND, lambda a, x: F.when(reach(a, x) < x["e"], x), further))
    rows = rows.select("o", "n_words", F.filter("found", lambda x: x["base"]).alias("base"), kept.alias("kept"), F.size("found").alias("n_found"))
    confidence = F.lit(0.0)
    for priority, value in CONFIDENCE.items():
        confidence = F.when(F.exists("kept", lambda x: x["priority"] >= priority), value).otherwise(confidence)
    return rows.select(F.when(F.col("o") != LOWEST, F.col("o")).alias("doc_id"), "n_words", "base", "kept", confidence.alias("score"))


def digest(found: DataFrame) -> DataFrame:
    """scan's rows -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["s"])).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.concat("base", "kept")).alias("labels"),
        "score",
    )
