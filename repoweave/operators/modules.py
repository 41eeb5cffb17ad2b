"""Module trees as rows (path: names from the root), ownership and edges between modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

EVIDENCE = 4


def module_edges(edges: DataFrame, owner: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """edges (caller, callee), owner (id, module) -> src, dst, weight, evidence for each pair of different modules.

    Evidence is the first few edges by (caller, callee). A pair's edges are
    ranked, never gathered whole.
    """
    a = owner.select(F.col("id").alias("caller"), F.col("module").alias("src"))
    b = owner.select(F.col("id").alias("callee"), F.col("module").alias("dst"))
    both = edges.select("caller", "callee").distinct().join(a, "caller").join(b, "callee").where("src <> dst")
    weight = both.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return weight.join(_first(both, ["src", "dst"], evidence), ["src", "dst"])


def _first(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n edges of each group as text, joined: within salted parts of a group, then among the parts' first."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64("caller", "callee"), F.lit(32)))
    order = [F.col("caller"), F.col("callee")]
    top = part.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_n") <= n)
    top = top.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)
    text = F.transform(F.array_sort(F.collect_list(F.struct("caller", "callee"))), lambda x: F.concat_ws(" -> ", x["caller"], x["callee"]))
    return top.groupBy(*by).agg(F.array_join(text, "; ").alias("evidence"))


def flattened(trees: DataFrame) -> DataFrame:
    """trees (parent, name, id) -> id, path, depth, parent id for each node; roots have no parent, and what no root leads to is left out.

    One join a level, until a level is empty.
    """
    level = trees.where("parent is null").select("id", F.array("name").alias("path"), F.lit(1).alias("depth"), F.lit(None).cast(trees.schema["parent"].dataType).alias("parent"))
    out, depth = level, 1
    while True:
        depth += 1
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("up"))
        level = checkpointed(trees.where("parent is not null").join(up, "parent").select("id", F.concat("up", F.array("name")).alias("path"), F.lit(depth).alias("depth"), "parent"))
        if level.isEmpty():
            return out
        out = out.union(level)


def post_order_key(path: Column) -> Column:
    """A sort key: siblings by name, a parent after what is below it."""
    return F.concat(F.array_join(path, "\x01"), F.lit("\x01￿"))


def ancestors(modules: DataFrame) -> DataFrame:
    """modules (id, path) -> id, ancestor (path), above: each module with itself and all above it."""
    each = modules.select("id", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"), "path")
    return each.select("id", F.slice("path", 1, F.col("n")).alias("ancestor"), (F.size("path") - F.col("n")).alias("above"))


def deepest_owner(owned: DataFrame) -> DataFrame:
    """owned (id, module, depth, path as text) -> id, module: the deepest, of equal ones the first by path."""
    return owned.groupBy("id").agg(F.min_by("module", F.struct(-F.col("depth"), F.col("path"))).alias("module"))


def last_owner(owned: DataFrame) -> DataFrame:
    """owned (id, module, path) -> id, module: the last by path."""
    return owned.groupBy("id").agg(F.max_by("module", F.struct("path", "module")).alias("module"))


def boundary_owner(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files (file), modules (module, prefix, depth) -> file, module: the longest prefix that ends at the file's end, a / or a dot.

    Each file offers its own prefixes, so that the join is on equal keys. Of
    equal prefixes the deepest, then the last by name.
    """
    bare = F.regexp_replace("file", r"^(?:\./)+", "")
    cuts = F.filter(F.sequence(F.lit(1), F.length(bare)), lambda i: (i == F.length(bare)) | F.substring(bare, i + 1, F.lit(1)).isin("/", "."))
    offered = files.select("file", F.explode(F.transform(cuts, lambda i: F.substring(bare, F.lit(1), i))).alias("prefix"))
    known = modules.select("module", "depth", F.regexp_replace("prefix", "^/+|/+$", "").alias("prefix")).where("prefix not in ('', '.')")
    hit = offered.join(known, "prefix")
    return hit.groupBy("file").agg(F.max_by("module", F.struct(F.length("prefix"), F.col("depth"), F.col("module"))).alias("module"))


def initial_modules(components: DataFrame) -> DataFrame:
    """components (id, relative_path) -> module, path, n: groups by the path's first part, with the folder of the first file."""
    first = F.regexp_replace(F.split("relative_path", "/")[0], "[^A-Za-z0-9_-]", "_")
    folder = F.when(F.col("low").contains("/"), F.regexp_replace("low", "/[^/]*$", "")).otherwise("")
    return components.groupBy(first.alias("module")).agg(F.min("relative_path").alias("low"), F.count("*").alias("n")).select("module", folder.alias("path"), "n")


def claims(groups: DataFrame, known: DataFrame) -> DataFrame:
    """groups (module, id), known (id) -> module, id: known ids, each in the first module by name that claims it."""
    return groups.join(known, "id", "left_semi").groupBy("id").agg(F.min("module").alias("module")).select("module", "id")


def claim_problems(groups: DataFrame, known: DataFrame) -> DataFrame:
    """groups (module, id), known (id) -> module, id, problem: ids outside the input, ids that an earlier module claims; id null: a module that keeps none."""
    outside = groups.join(known, "id", "left_anti").select("module", "id", F.lit("outside its input").alias("problem"))
    first = claims(groups, known)
    later = groups.join(known, "id", "left_semi").join(first, ["module", "id"], "left_anti").select("module", "id", F.lit("claimed before").alias("problem"))
    dropped = groups.select("module").distinct().join(first, "module", "left_anti").select("module", F.lit(None).cast(groups.schema["id"].dataType).alias("id"), F.lit("keeps no component").alias("problem"))
    return outside.union(later).union(dropped).distinct()


def applied_clusters(members: DataFrame, groups: DataFrame, known: DataFrame, parents: DataFrame) -> DataFrame:
    """members (path, id), groups (parent, module, id), known (parent, id), parents (parent: path) -> path, id: the tree with the groups as children.

    Of each parent (an empty path: the repository) the known ids go to the first
    group that claims them, and also to the parent and all modules above it.
    Paths are arrays of names; what is there already stays once.
    """
    asked = groups.join(parents, "parent", "left_semi").join(known, ["parent", "id"], "left_semi")
    first = asked.groupBy("parent", "id").agg(F.min("module").alias("module"))
    own = first.select(F.concat("parent", F.array("module")).alias("path"), "id")
    above = first.where(F.size("parent") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parent")), lambda n: F.slice("parent", F.lit(1), n))).alias("path"), "id")
    return members.select("path", "id").union(own).union(above).distinct()


def cluster_outcomes(responses: DataFrame, groups: DataFrame, requested: DataFrame, known: DataFrame) -> DataFrame:
    """responses (response, scope, parent, review), groups (response, path, components: nested), requested (response, id), known (id) -> response, error, decision, selected, omitted, groups.

    Of the top groups' components those count that were requested, each for the
    first group by name. A response of scope `repo` needs a group that keeps one;
    of scope `module` (under `parent`) it needs a review that retains the leaf if
    there is none, and if there are groups a review, where given, that splits.
    """
    asked = requested.groupBy("response").agg(F.count_distinct("id").alias("asked"))
    unknown = requested.join(known.select("id"), "id", "left_anti").select("response").distinct().withColumn("unknown", F.lit(True))
    kept = _claimed(groups, requested).groupBy("response").agg(F.count("*").alias("selected"), F.count_distinct("module").alias("groups"))
    rows = responses.join(asked, "response", "left").join(unknown, "response", "left").join(kept, "response", "left").fillna(0, ["selected", "groups", "asked"])
    module, none, decision = F.col("scope") == "module", F.col("groups") == 0, F.col("review.decision")
    error = (
        F.when(~F.col("scope").isin("repo", "module"), "scope is repo or module")
        .when(module & (F.coalesce(F.size("parent"), F.lit(0)) == 0), "a module has a path")
        .when(F.col("asked") == 0, "no component was asked for")
        .when(F.col("unknown"), "an unknown component was asked for")
        .when(module & F.col("review").isNotNull() & decision.isNull(), "the review can't be read")
        .when(module & none & F.col("review").isNull(), "no groups and no review")
        .when(module & none & (decision != "retain_leaf"), "no groups, but the leaf isn't retained")
        .when(none & ~module, "no groups")
        .when(module & ~none & (decision != "split"), "groups, but the decision isn't split")
    )
    fine = F.when(error.isNull(), 1).otherwise(0)
    omitted = F.when(none, 0).otherwise(F.col("asked") - F.col("selected"))
    return rows.select("response", error.alias("error"), F.when(error.isNull() & module, decision).alias("decision"), (fine * F.col("selected")).alias("selected"), (fine * omitted).alias("omitted"), (fine * F.col("groups")).alias("groups"))


def _claimed(groups: DataFrame, requested: DataFrame) -> DataFrame:
    """response, module, id: requested components of the top groups, each of the first by name."""
    top = groups.where(F.size("path") == 1).select("response", F.col("path")[0].alias("module"), F.explode("components").alias("id"))
    return top.join(requested.select("response", "id").distinct(), ["response", "id"], "left_semi").groupBy("response", "id").agg(F.min("module").alias("module")).select("response", "module", "id")


def clustered(responses: DataFrame, groups: DataFrame, requested: DataFrame, outcomes: DataFrame) -> DataFrame:
    """As cluster_outcomes, and its outcomes -> response, path, id: what the responses without an error add to the tree.

    A group's claimed components, what its nested groups hold as they are, and
    all that is claimed for the parent and the modules above it. Groups that keep
    no component go with all below them.
    """
    good = outcomes.where("error is null").select("response").join(responses.select("response", "scope", F.coalesce("parent", F.array().cast("array<string>")).alias("parent")), "response")
    first = checkpointed(_claimed(groups, requested).join(good, "response"))
    base = F.when(F.col("scope") == "module", F.col("parent")).otherwise(F.array().cast("array<string>"))
    own = first.select("response", F.concat(base, F.array("module")).alias("path"), "id")
    nested = groups.where(F.size("path") > 1).withColumn("module", F.col("path")[0]).join(first.select("response", "module", "scope", "parent").distinct(), ["response", "module"])
    nested = nested.select("response", F.concat(base, F.col("path")).alias("path"), F.explode("components").alias("id"))
    above = first.where("scope = 'module'").select("response", F.explode(F.transform(F.sequence(F.lit(1), F.size("parent")), lambda n: F.slice("parent", F.lit(1), n))).alias("path"), "id")
    return own.union(nested).union(above).distinct()


def super_groups(members: DataFrame, modules: DataFrame) -> DataFrame:
    """members (parent, module), modules (module: all of the top level) -> parent, module: the groups that are made.

    A group that names one module alone is passed over; a known module goes to
    the first other group by name, and a group needs two that it got. Nothing is
    made unless the top level shrinks.
    """
    named = members.distinct()
    several = named.groupBy("parent").agg(F.count("*").alias("n")).where("n >= 2").select("parent")
    first = claims(named.join(several, "parent", "left_semi").select(F.col("parent").alias("module"), F.col("module").alias("id")), modules.select(F.col("module").alias("id")))
    big = first.groupBy("module").agg(F.count("*").alias("n")).where("n >= 2").select("module")
    made = first.join(big, "module", "left_semi").select(F.col("module").alias("parent"), F.col("id").alias("module"))
    claimed = first.select(F.col("id").alias("module"))
    left = modules.select("module").join(claimed, "module", "left_anti").select("module").union(big).distinct()
    shrinks = left.agg(F.count("*").alias("n")).scalar() < modules.select("module").distinct().agg(F.count("*").alias("n")).scalar()
    return made.withColumn("_shrinks", shrinks).where("_shrinks").drop("_shrinks")


def tree_quality(owned: DataFrame, tokens: DataFrame, limit: int, deepest: int = 4) -> DataFrame:
    """owned (id, leaf, depth), tokens (id, tokens) -> leaf, depth, components, tokens, shared, verdict for each leaf.

    A leaf over the limit is an error if it has several components, else a
    warning; one that is too deep is an error; shared counts its components that
    other leaves have too.
    """
    shared = owned.groupBy("id").agg(F.count_distinct("leaf").alias("leaves"))
    whole = owned.join(shared, "id").join(tokens, "id", "left")
    out = whole.groupBy("leaf").agg(F.max("depth").cast("long").alias("depth"), F.count("*").alias("components"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("leaves") > 1).alias("shared"))
    over = F.col("tokens") > limit
    return out.withColumn("verdict", F.when((F.col("depth") > deepest) | (over & (F.col("components") > 1)), "error").when(over, "warning").otherwise("ok"))


def review_check(reviews: DataFrame) -> DataFrame:
    """reviews (leaf, is_leaf, decision, risk, reason) -> leaf, problem for those with one.

    A module of several components needs a review with a reason whose decision
    agrees with its shape: leaves are retained, others split.
    """
    expected = F.when(F.col("is_leaf"), "retain_leaf").otherwise("split")
    problem = (
        F.when(F.col("decision").isNull(), "missing")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "empty reason")
        .when(F.col("decision") != expected, "mismatched decision")
        .when(F.col("is_leaf") & (F.col("risk") == "high"), "high-risk leaf")
    )
    return reviews.select("leaf", problem.alias("problem")).where("problem is not null")


def at_path(modules: DataFrame, path: Column | list[str]) -> DataFrame:
    """modules (path array, ...) -> the rows of one path."""
    return modules.where(F.col("path") == (F.array(*[F.lit(x) for x in path]) if isinstance(path, list) else path))


def tree_ids(members: DataFrame) -> DataFrame:
    """members (path, id) -> id: the distinct components of the whole tree."""
    return members.select("id").distinct()
