"""Diagrams of pages as rows of nodes and edges, and what their quality is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as X

#: Arrows, the first of which that a line has ties its ends.
ARROWS = ("-->>", "-.->", "==>", "-->", "->>", "->")


def _bodies(pages: DataFrame) -> DataFrame:
    """pages (page, content, or what pages.facts gives) -> with bodies and balanced, without the text."""
    if "bodies" in pages.columns:
        return pages
    shown = pages.withColumn("shown", X.shown_source(F.col("content")))
    return shown.withColumns({"bodies": X.mermaid_blocks(F.col("shown")), "balanced": X.mermaid_balanced(F.col("shown"))})


def _node(raw: Column) -> Column:
    """id and label of a diagram's text for a node, like `a[Label]`; without a label it is the id. The id is null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "^;+|;+$", ""), "^`+|`+$", "")
    id_ = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^([^\[({<|]*)", 1)), r'^"+|"+$', "")
    label = lambda x: F.trim(F.substring_index(F.regexp_replace(F.regexp_extract(x, r"(?s)^[^\[({<|]*(.*)$", 1), r'^[\[\](){}"`]+|[\[\](){}"`]+$', ""), "|", 1))
    parts = X.bound(bare, lambda x: F.struct(id_(x).alias("id"), label(x).alias("label")))
    node = X.bound(parts, lambda x: F.struct(F.nullif(x["id"], F.lit("")).alias("id"), F.when(x["label"] == "", x["id"]).otherwise(x["label"]).alias("label")))
    # the two common forms without expressions for the others
    boxed = F.struct(F.substring_index(raw, "[", 1).alias("id"), F.trim(F.substring(raw, F.instr(raw, F.lit("[")) + 1, F.length(raw) - F.instr(raw, F.lit("[")) - 1)).alias("label"))
    return F.when(raw.rlike(r"^[A-Za-z0-9_]+\z"), F.struct(raw.alias("id"), raw.alias("label"))).when(raw.rlike(r'^[A-Za-z0-9_]+\[[A-Za-z0-9][^\[\](){}"`|]*\]\z'), boxed).otherwise(node)


def _mentions(pages: DataFrame, *others: str) -> DataFrame:
    """pages (as for _bodies) -> a row for each time that a diagram names a node, from one pass over its lines.

    page, others, at (where: i is 0 and 1 at the ends of an edge), block, own (the
    id, or the text if it has none), label (null if there is no id), to (of an
    edge's beginning: its end's own), back (of an edge's end: its beginning's own
    and whether that is an id). A row of each page has null as own.
    """
    null, nothing = F.lit(None).cast("string"), F.lit(None).cast("struct<own:string,id:boolean>")
    blocks = pages.select("page", *others, F.posexplode(F.concat(F.array(null), F.coalesce("bodies", F.array().cast("array<string>")))).alias("block", "body"))
    blocks = blocks.withColumn("sequence", F.col("body").rlike(r"(?im)^\s*sequencediagram\s*$"))
    lines = blocks.select("page", *others, "block", "sequence", F.posexplode_outer(F.split("body", "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    lines = lines.where("line is null or line <> '' and not startswith(line, '%%')").withColumn("other", F.col("line").rlike("(?i)^(?:subgraph|style) "))
    lines = lines.withColumn("arrow", F.when(~F.col("other"), F.coalesce(*[F.when(F.contains("line", F.lit(a)), a) for a in ARROWS]))).withColumn("begins", F.instr(F.col("line"), F.col("arrow")))
    after = F.substring(F.col("line"), F.col("begins") + F.length("arrow"), F.length("line"))
    lines = lines.withColumns({"left": F.trim(F.substring(F.col("line"), F.lit(1), F.col("begins") - 1)), "right": F.trim(F.substring_index(after, ":", 1))})
    lines = lines.withColumns({"a": F.when(F.col("left").isNotNull(), _node(F.col("left"))), "b": F.when(F.col("right").isNotNull(), _node(F.col("right")))})
    # a word that is one of the arrow's sides names what the line has named before
    new = lambda x: x.rlike(r"[\[({]") & ~F.coalesce((x == F.col("left")) | (x == F.col("right")), F.lit(False))
    words = F.transform(F.split("line", r"\s+"), lambda x, i: F.struct((i + 2).alias("i"), x.alias("raw")))
    sides = F.coalesce((F.col("line") == F.concat_ws(" ", "left", "arrow", "right")) & ~F.col("left").rlike(r"\s") & ~F.col("right").rlike(r"\s"), F.lit(False))
    words = F.when(~F.col("other") & ~F.col("sequence") & ~sides & F.col("line").rlike(r"[\[({]"), F.filter(words, lambda x: new(x["raw"])))
    spoken = F.when(F.col("line").rlike("(?i)^participant "), F.array(F.struct(F.lit(-1).alias("i"), F.coalesce(F.get(F.split("line", r"\s+"), 1), F.lit("")).alias("raw"))))
    named = lambda i, node, raw, to, back: F.struct(i.alias("i"), F.coalesce(node["id"], raw).alias("own"), F.when(node["id"].isNotNull(), node["label"]).alias("label"), to.alias("to"), back.alias("back"))
    lines = lines.withColumns({"a_own": F.coalesce("a.id", "left"), "b_own": F.coalesce("b.id", "right")})
    kind = "array<struct<i:int,own:string,label:string,to:string,back:struct<own:string,id:boolean>>>"
    begin = F.struct(F.col("a_own").alias("own"), F.col("a.id").isNotNull().alias("id"))
    ends = F.when(F.col("arrow").isNotNull(), F.array(named(F.lit(0), F.col("a"), F.col("left"), F.col("b_own"), nothing), named(F.lit(1), F.col("b"), F.col("right"), null, begin)))
    more = [F.transform(x, lambda x: X.bound(_node(x["raw"]), lambda node: named(x["i"], node, null, null, nothing))) for x in (words, spoken)]
    page = F.when(F.col("line").isNull(), F.array(F.struct(F.lit(-2).alias("i"), *[null.alias(x) for x in ("own", "label", "to")], nothing.alias("back"))))
    found = lines.select("page", *others, "block", "n", F.explode(F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (page, ends, *more)])).alias("x"))
    found = found.select("page", *others, "block", F.struct("n", "x.i").alias("at"), "x.own", "x.label", "x.to", "x.back")
    return found.where("own is not null or at.i = -2")


def edges(pages: DataFrame) -> DataFrame:
    """pages (page, content) -> page, a, b for each line of a diagram that ties two nodes, by their ids (a text without an id stands for itself)."""
    return _mentions(_bodies(pages)).where("at.i = 0").select("page", F.col("own").alias("a"), F.col("to").alias("b"))


def _first_label() -> Column:
    """Of rows of _mentions: a node's first label in a diagram, of the last diagram that has one. Null if there is none."""
    return F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("block")).alias("block"), "at", "label")))["label"]


def nodes(pages: DataFrame) -> DataFrame:
    """pages (page, content) -> page, id, label. In a diagram a node's first label counts, of a page's diagrams the last."""
    found = _mentions(_bodies(pages)).where("label is not null")
    return found.groupBy("page", F.col("own").alias("id")).agg(_first_label().alias("label"))


def _counted(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """quality's pages (with bodies and balanced), labels -> their marks, and what is counted of nodes, edges and chains.

    An edge is grounded at its beginning, at its end or at both; only grounded
    nodes tell the ends of their edges, so that the last are counted once. A chain
    of three edges has a middle one whose beginning another node leads to and
    whose end leads on: nodes that lead on tell those that lead to them. Of many
    nodes on either side two are enough.
    """
    allowed = labels.select("page", X.diagram_text(F.col("label")).alias("x")).where("x <> ''").groupBy("page").agg(F.collect_set("x").alias("allowed"))
    near = lambda v: F.coalesce(F.exists("allowed", lambda x: F.contains(v, x) | F.contains(x, v)), F.lit(False))
    text, own, null = X.diagram_text, F.col("own"), F.lit(None).cast("string")
    mark = F.struct("is_leaf", "is_overview", F.size("bodies").cast("long").alias("blocks"), "balanced", F.coalesce(~F.col("is_leaf") & F.col("is_overview"), F.lit(False)).alias("long"))
    rows = _mentions(pages.withColumn("mark", mark), "mark").where("page is not null or own is null")
    tie = F.when(own.isNull() | F.col("to").isNotNull() | F.col("back").isNotNull(), F.struct(F.when(own.isNull(), F.col("mark")).alias("mark"), "to", "back", F.col("label").isNotNull().alias("id")))
    node = rows.groupBy("page", "own").agg(F.max("mark.long").alias("long"), _first_label().alias("label"), F.collect_list(tie).alias("ties"))
    node = node.join(allowed, "page", "left").withColumns({"drawn": F.col("label").isNotNull(), "id_text": text(own), "known": F.col("allowed").isNotNull()})
    node = node.withColumns({"text": F.when(F.col("label") == own, F.col("id_text")).otherwise(text(F.coalesce("label", own))), "outs": F.filter("ties", lambda x: x["to"].isNotNull()), "ins": F.filter("ties", lambda x: x["back"].isNotNull())})
    node = node.withColumns({"near": near(F.col("text")), "n_outs": F.size("outs").cast("long"), "n_ins": F.size("ins").cast("long")})
    node = node.withColumn("firsts", F.when(F.col("long"), F.transform(F.filter("ins", lambda x: x["back"]["id"] & (x["back"]["own"] != own)), lambda x: x["back"]["own"])))
    like = lambda is_: is_(F.col("id_text")) | ((F.col("id_text") != F.col("text")) & is_(F.col("text")))
    one = lambda x: (F.col("drawn") & x).cast("long")
    counts = {
        "nodes": one(F.lit(True)), "grounded_nodes": one(F.col("near")), "generic": one(like(lambda x: x.isin(*X.GENERIC_LABELS))), "support": one(like(lambda x: x.rlike("|".join(X.SUPPORT_TERMS)))),
        "disconnected": one(F.col("n_outs") + F.col("n_ins") == 0), "edges": F.col("n_outs"), "grounded_edges": F.when(F.col("near"), F.col("n_outs") + F.col("n_ins")).otherwise(0), "starts": one(F.col("n_outs") > 0),
    }
    node = node.withColumns({k: F.coalesce(v, F.lit(0)).cast("long") for k, v in counts.items()})
    kind = "array<struct<key:string,self:boolean,near:boolean,first:string,last:string>>"
    said = lambda key, **x: F.struct(key.alias("key"), *[x.get(k, F.lit(None).cast(t)).alias(k) for k, t in (("self", "boolean"), ("near", "boolean"), ("first", "string"), ("last", "string"))])
    # to itself; to the ends of a grounded node's edges; to those that a chain can pass before; where a text without an id is also an id, to its ends
    told = (
        F.array(said(own, self=F.lit(True))),
        F.when(F.col("near"), F.transform("outs", lambda x: said(x["to"], near=F.lit(True)))),
        F.when(F.col("long") & (F.col("n_outs") > 0), F.transform(F.filter("ins", lambda x: x["back"]["own"] != own), lambda x: said(x["back"]["own"], last=own))),
        F.when(F.col("long") & F.col("drawn"), F.transform(F.filter("outs", lambda x: ~x["id"] & (x["to"] != own)), lambda x: said(x["to"], first=own))),
    )
    told = F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in told])
    own_only = lambda x: F.when(F.col("x.self"), x)
    marks = F.transform(F.filter("ties", lambda x: x["mark"].isNotNull()), lambda x: x["mark"])
    state = F.struct(F.when(own.isNull(), marks).alias("marks"), "known", "near", F.array_min("firsts").alias("low"), F.array_max("firsts").alias("high"), *counts)
    told = node.select("page", state.alias("state"), F.explode(told).alias("x")).select("page", "x.key", F.col("x.near").alias("told"), "x.first", "x.last", own_only(F.col("state")).alias("state"))
    met = told.groupBy("page", "key").agg(F.first("state", ignorenulls=True).alias("state"), F.count_if("told").alias("both"), *[f(x).alias(f"{f.__name__}_{x}") for x in ("first", "last") for f in (F.min, F.max)])
    low, high = F.least("min_first", "state.low"), F.greatest("max_first", "state.high")
    chain = low.isNotNull() & F.col("min_last").isNotNull() & ~((low == high) & (F.col("min_last") == F.col("max_last")) & (low == F.col("min_last")))
    sums = {k: F.sum(F.col(f"state.{k}")) for k in counts} | {"grounded_edges": F.sum(F.col("state.grounded_edges") - F.when(F.col("state.near"), F.col("both")).otherwise(0))}
    page = met.groupBy("page").agg(F.max("state.known").alias("known"), F.flatten(F.collect_list("state.marks")).alias("marks"), *[v.alias(k) for k, v in sums.items()], F.max(chain).alias("chain"))
    return page.withColumn("mark", F.explode("marks")).select("page", "mark.*", "known", *counts, "chain")


def quality(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages (page, content or what pages.facts gives, is_leaf, is_overview), labels (page, label: what a diagram can be about) -> the report on each page's diagrams.

    page, blocks, balanced, nodes, edges, grounded_nodes, grounded_edges, generic,
    support, disconnected, has_path, issues (an array), verdict: pass, warning
    (leaves) or fail. A node or edge is grounded if a label has its text or is in
    it. Leaves need no diagram; an overview of more than two nodes needs a path of
    three edges and no part that is about building.
    """
    out = _counted(_bodies(pages), labels)
    strict, count = ~F.col("is_leaf"), F.col("nodes")
    far = F.when(strict & F.col("is_overview") & (count > 2), F.col("chain")).otherwise((count <= 1) | (F.col("starts") > 0))
    has_path = (count > 0) & (F.col("edges") > 0) & far
    enough = F.when(count <= 2, 1).otherwise(F.greatest(F.floor(count / 2), F.lit(2)))
    issues = F.array_compact(
        F.array(
            F.when(~F.col("balanced"), "unbalanced"),
            F.when(strict & (F.col("blocks") == 0), "no diagram"),
            F.when(strict & (count < 2), "few nodes"),
            F.when(strict & (F.col("edges") < 1), "few edges"),
            F.when(strict & ~has_path, "no path"),
            F.when(strict & (F.col("generic") * 2 > F.greatest(count, F.lit(1))), "generic"),
            F.when(strict & F.col("known") & (F.col("grounded_nodes") < enough), "ungrounded diagram"),
            F.when(F.col("is_overview") & (F.col("support") > 0), "support nodes"),
        )
    )
    out = out.withColumns({"has_path": has_path, "issues": issues})
    verdict = F.when(F.size("issues") == 0, "pass").when(strict, "fail").otherwise("warning")
    return out.select("page", "blocks", "balanced", "nodes", "edges", "grounded_nodes", "grounded_edges", "generic", "support", "disconnected", "has_path", "issues", verdict.alias("verdict"))
