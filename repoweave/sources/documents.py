"""JSON graphs, trees and id lists, cluster responses, and patches as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

NODE = "struct<name:string,component_type:string,relative_path:string,language:string,source_code:string,depends_on:array<string>,parameters:array<string>,base_classes:array<string>>"
MODULE = "map<string,struct<path:string,components:array<string>,children:string>>"


def graph_nodes(graphs: DataFrame) -> DataFrame:
    """graphs (graph, value: a JSON object of id -> node) -> graph, id and the node's fields; missing ones are null."""
    nodes = F.from_json("value", f"map<string,{NODE}>")
    return graphs.select("graph", F.explode(nodes).alias("id", "node")).select("graph", "id", "node.*")


def module_rows(trees: DataFrame) -> DataFrame:
    """trees (tree, value: a JSON object of name -> path, components, children) -> tree, path, depth, parent, is_leaf, components.

    Children are read as text and taken apart a level at a time, until none is left.
    """
    level = trees.select("tree", F.array().cast("array<string>").alias("up"), F.col("value").alias("json"))
    out, depth = None, 0
    while depth == 0 or not level.isEmpty():
        depth += 1
        here = level.select("tree", "up", F.explode(F.from_json("json", MODULE)).alias("name", "m"))
        inner = F.coalesce(F.col("m.children"), F.lit("{}"))
        rows = here.select(
            "tree", F.concat("up", F.array("name")).alias("path"), F.lit(depth).cast("long").alias("depth"), F.when(F.size("up") > 0, F.array_join("up", "/")).alias("parent"),
            inner.rlike(r"^\s*\{\s*\}\s*$").alias("is_leaf"), F.coalesce("m.components", F.array().cast("array<string>")).alias("components"),
        )
        out = rows if out is None else out.union(rows)
        level = checkpointed(here.where(~inner.rlike(r"^\s*\{\s*\}\s*$")).select("tree", F.concat("up", F.array("name")).alias("up"), inner.alias("json")))
    return out


def tree_documents(modules: DataFrame) -> DataFrame:
    """modules (tree, path, components) -> tree, value: a JSON object for each tree, which module_rows takes apart again.

    Objects are put together from the deepest level up. Modules stand in order
    of name, components sorted and each once; rows of one path are one module,
    and modules above one that has no row are made without components. Rows with
    a null or empty path are passed over; a null tree is one, too.
    """
    none = F.array().cast("array<string>")
    own = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("components", none)))))
    rows = checkpointed(modules.where(F.size("path") > 0).groupBy("tree", "path").agg(own.alias("components")))
    text = F.lit(None).cast("string")
    below = None
    for depth in range(rows.agg(F.max(F.size("path"))).first()[0] or 0, 0, -1):
        here = rows.where(F.size("path") == depth).withColumn("children", text)
        here = here if below is None else here.unionByName(below.withColumn("components", F.lit(None).cast("array<string>")))
        here = here.groupBy("tree", "path").agg(F.first("components", True).alias("components"), F.first("children", True).alias("children"))
        name = F.element_at("path", -1)
        quoted = F.regexp_replace(F.to_json(F.array(name)), r"^\[|\]$", "")
        module = F.concat(quoted, F.lit(':{"components":'), F.to_json(F.coalesce("components", none)), F.lit(',"children":'), F.coalesce("children", F.lit("{}")), F.lit("}"))
        each = F.array_sort(F.collect_list(F.struct(name.alias("name"), module.alias("module"))))
        children = F.concat(F.lit("{"), F.array_join(F.transform(each, lambda x: x["module"]), ","), F.lit("}"))
        below = here.groupBy("tree", F.slice("path", 1, depth - 1).alias("path")).agg(children.alias("children"))
    return rows.select("tree", text.alias("value")).limit(0) if below is None else below.select("tree", F.col("children").alias("value"))


def id_list(text: Column) -> Column:
    """Ids of a JSON array, or of lines; blank ones are left out, an object gives null."""
    array = F.from_json(text, "array<string>")
    plain = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.rlike(r"^\s*\["), array).when(text.rlike(r"^\s*\{"), F.lit(None)).otherwise(plain)


def cluster_groups(responses: DataFrame, tag: str = "GROUPED_COMPONENTS") -> DataFrame:
    """responses (response, text with a tagged JSON object of group -> path, components) -> response, module, id."""
    body = F.regexp_extract("text", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    groups = F.from_json(F.when(body != "", body).otherwise(F.col("text")), "map<string,struct<path:string,components:array<string>>>")
    return responses.select("response", F.explode(groups).alias("module", "g")).select("response", "module", F.explode("g.components").alias("id")).distinct()


_OBJECT = "coalesce(schema_of_variant({0}) like 'OBJECT%', false)"
_STRINGS = "transform(filter(coalesce(try_variant_get({0}, '$', 'array<variant>'), array()), x -> schema_of_variant(x) = 'STRING'), x -> cast(x as string))"
#: What a review can decide, and the risks that it can name.
DECISIONS, RISKS = ("split", "retain_leaf"), ("low", "medium", "high")


def tagged(text: Column, tag: str) -> Column:
    """What stands between a tag and its end, or else the whole text, without a code fence."""
    start, end = F.instr(text, F.lit(f"<{tag}>")), F.instr(text, F.lit(f"</{tag}>"))
    body = F.when((start > 0) & (end > start), F.substring(text, start + len(tag) + 2, end - start - len(tag) - 2)).otherwise(text)
    return F.regexp_replace(body, r"^\s*(?:```)*(?:json\b)?\s*|\s*(?:```)*\s*$", "")


def reviews(text: Column, tag: str = "DECOMPOSITION_REVIEW") -> Column:
    """The review of a response as a struct (decision, risk, reason); null without the tag; one that can't be read has a null decision."""
    parsed = F.from_json(tagged(text, tag), "decision string, risk string, reason string")
    known = parsed["decision"].isin(*DECISIONS) & parsed["risk"].isin(*RISKS)
    none = F.lit(None).cast("string")
    review = F.struct(*[F.when(known, parsed[c]).otherwise(none).alias(c) for c in ("decision", "risk", "reason")])
    return F.when(F.contains(text, F.lit(f"<{tag}>")), review)


def cluster_modules(responses: DataFrame, tag: str = "GROUPED_COMPONENTS") -> DataFrame:
    """responses (response, text with a tagged JSON object of nested groups) -> response, path (names from the top group down), folder, components, review.

    A group is an object with path, components and children (or modules: an
    object of groups, or a list of names of empty ones). What has another kind is
    passed over: groups that aren't objects, components that aren't strings,
    reviews that name other decisions or risks. JSON is read once as VARIANT and
    taken apart a level at a time.
    """
    spark = responses.sparkSession
    level = responses.select("response", F.array().cast("array<string>").alias("up"), F.try_parse_json(tagged(F.col("text"), tag)).alias("v"))
    out = None
    while out is None or not level.isEmpty():
        level = level.where(F.expr(_OBJECT.format("v")))
        each = spark.sql("select l.response, concat(l.up, array(e.key)) as path, e.value as v from {level} l, lateral variant_explode(l.v) e", level=level)
        each = each.where(F.expr(_OBJECT.format("v")))
        review = F.expr("struct(try_variant_get(v, '$.decomposition_review.decision', 'string') as decision, try_variant_get(v, '$.decomposition_review.risk', 'string') as risk, try_variant_get(v, '$.decomposition_review.reason', 'string') as reason)")
        here = each.select(
            "response", "path", F.expr("case when schema_of_variant(try_variant_get(v, '$.path', 'variant')) = 'STRING' then try_variant_get(v, '$.path', 'string') end").alias("folder"),
            F.expr(_STRINGS.format("try_variant_get(v, '$.components', 'variant')")).alias("components"), review.alias("review"), F.expr("coalesce(try_variant_get(v, '$.children', 'variant'), try_variant_get(v, '$.modules', 'variant'))").alias("v"),
        )
        here = here.withColumn("review", F.when(F.col("review.decision").isin(*DECISIONS) & F.col("review.risk").isin(*RISKS), F.col("review")))
        here = checkpointed(here)
        bare = here.select("response", F.explode(F.transform(F.expr(_STRINGS.format("v")), lambda n: F.concat("path", F.array(n)))).alias("path")).distinct()
        rows = here.drop("v").unionByName(bare, allowMissingColumns=True).withColumn("components", F.coalesce("components", F.array().cast("array<string>")))
        out = rows if out is None else out.union(rows)
        level = here.where(F.expr(_OBJECT.format("v"))).select("response", F.col("path").alias("up"), "v")
    return out


def patch_hunks(patches: DataFrame) -> DataFrame:
    """patches (patch, text: unified diff) -> patch, path, first, last: the new lines of each hunk; a pure deletion is the line before it.

    A hunk belongs to the last +++ line before it, in the same text.
    """
    files = F.slice(F.split("text", r"(?m)^diff --git "), 2, 1_000_000)
    each = patches.select("patch", F.explode(files).alias("part"))
    path = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?(\S+)", 1)
    heads = F.regexp_extract_all("part", F.lit(r"(?m)^@@ -[0-9,]+ \+([0-9]+(?:,[0-9]+)?) @@"), F.lit(1))
    hunks = each.select("patch", path.alias("path"), F.explode(heads).alias("h"))
    first = F.split("h", ",")[0].cast("long")
    n = F.coalesce(F.get(F.split("h", ","), 1).cast("long"), F.lit(1))
    return hunks.select("patch", "path", first.alias("first"), (first + F.greatest(n - 1, F.lit(0))).alias("last"))
