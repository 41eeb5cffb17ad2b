"""Prompts with strict variables, rendered for each row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rendered prompt has no more characters than this; beyond, the listing it is told to shorten is cut.
MOST_CHARACTERS = 900_000


#: The variables of each type of prompt, those it needs and those it takes.
CONTRACTS = {
    "cluster": ((), ("potential_core_components", "component_ids", "scope", "module_name", "module_tree", "current_depth", "remaining_depth", "custom_instructions")),
    "super_group": (("formatted_modules",), ()),
    "filter_folders": (("project_name", "files"), ()),
    "system_complex": (("module_name", "doc_path"), ("custom_instructions", "few_shot_examples")),
    "system_leaf": (("module_name", "doc_path"), ("custom_instructions", "few_shot_examples")),
    "user": (("module_name", "module_tree"), ("formatted_core_component_codes", "component_ids", "artifact_index", "few_shot_examples", "architecture_context")),
    "overview_module": (("module_name", "repo_structure"), ("few_shot_examples", "architecture_context", "custom_instructions")),
    "overview_repo": (("repo_name", "repo_structure"), ("artifact_index", "few_shot_examples", "architecture_context", "custom_instructions")),
    "update_leaf_system": (("leaf_name",), ("custom_instructions", "few_shot_examples")),
    "update_leaf_user": (("leaf_name", "mode", "mode_note", "write_set", "report", "module_tree", "leaf_components", "leaf_page"), ()),
    "routing_system": ((), ()),
    "routing_user": (("module_tree", "orphans"), ()),
    "stale_fix_system": ((), ()),
    "stale_fix_user": (("page", "items"), ()),
}
#: Of these variables one is needed.
ONE_OF = {"cluster": ("potential_core_components", "component_ids"), "user": ("formatted_core_component_codes", "component_ids")}
#: What a module's clustering needs besides.
MODULE_SCOPE = ("module_name", "module_tree", "current_depth", "remaining_depth")


def checked(kind: str, given: set[str], scope: str = "repo") -> None:
    """An error unless the variables given are those that a type of prompt needs and takes."""
    if kind not in CONTRACTS:
        raise ValueError(f"unknown prompt {kind}")
    needed, taken = CONTRACTS[kind]
    if scope not in ("repo", "module"):
        raise ValueError(f"unknown scope {scope}")
    lost = set(needed) | (set(MODULE_SCOPE) if kind == "cluster" and scope == "module" else set())
    if given - set(needed) - set(taken):
        raise ValueError(f"{kind} takes no {sorted(given - set(needed) - set(taken))}")
    if lost - given:
        raise ValueError(f"{kind} needs {sorted(lost - given)}")
    if kind in ONE_OF and not given & set(ONE_OF[kind]):
        raise ValueError(f"{kind} needs one of {ONE_OF[kind]}")


def typed(kind: str, template: str, values: dict[str, Column], scope: str = "repo", shorten: str | None = None) -> Column:
    """A prompt of a type: its variables are checked, then the template is rendered; a variable that the template doesn't show isn't rendered."""
    checked(kind, set(values), scope)
    return rendered(template, {k: v for k, v in values.items() if k in variables(template)}, shorten)


def outline(modules: DataFrame, current: str | None = None, components: bool = True) -> DataFrame:
    """modules (tree, path array, ids array) -> tree, outline: each tree as indented lines.

    A module's line marks the current one; below it stand its components by file
    (an id's part before ::), then `Children:` and its children by name. Lines
    are sorted by path, so only a tree's own lines are gathered.
    """
    name, depth = F.element_at("path", -1), F.size("path") - 1
    indent = lambda n: F.repeat(F.lit("  "), n.cast("int"))
    head = F.concat(indent(2 * depth), name, F.when(name == F.lit(current), " (current module)").otherwise("")) if current is not None else F.concat(indent(2 * depth), name)
    rows = modules.select("tree", F.struct(F.col("path").alias("path"), F.lit(0).alias("kind"), F.lit("").alias("file")).alias("at"), head.alias("line"))
    if components:
        ids = modules.select("tree", "path", F.posexplode("ids").alias("n", "id"))
        ids = ids.withColumn("file", F.when(F.contains("id", F.lit("::")), F.substring_index("id", "::", 1)).otherwise("")).withColumn("own", F.when(F.contains("id", F.lit("::")), F.substring(F.col("id"), F.instr(F.col("id"), "::") + 2, F.length("id"))).otherwise(F.col("id")))
        by = ids.groupBy("tree", "path", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "own"))), lambda x: x["own"]), ", ").alias("names"))
        text = F.concat(indent(2 * depth + 1), F.when(F.col("file") == "", "").otherwise(F.concat("file", F.lit(": "))), "names")
        rows = rows.union(by.select("tree", F.struct(F.col("path").alias("path"), F.lit(1).alias("kind"), F.col("file").alias("file")).alias("at"), text.alias("line")))
    parents = modules.where(F.size("path") > 1).select("tree", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
    rows = rows.union(parents.select("tree", F.struct(F.col("path").alias("path"), F.lit(2).alias("kind"), F.lit("").alias("file")).alias("at"), F.concat(indent(2 * depth + 1), F.lit("Children:")).alias("line")))
    # a path sorts before those that go on from it, so a module's own lines stand before those of what is below it
    return rows.groupBy("tree").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("outline"))


def variables(template: str) -> set[str]:
    return set(re.findall(r"\{([a-z_]+)\}", template))


def rendered(template: str, values: dict[str, Column], shorten: str | None = None, most: int = MOST_CHARACTERS) -> Column:
    """The template with each {variable} replaced. A variable that is missing or unknown is an error.

    If the whole is too long, the value named by `shorten` keeps as many
    characters as fit.
    """
    wanted = variables(template)
    if wanted != set(values):
        raise ValueError(f"missing: {sorted(wanted - set(values))}, unknown: {sorted(set(values) - wanted)}")
    pieces = re.split(r"\{([a-z_]+)\}", template)
    full = lambda v: F.concat(*[v[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
    out = full(values)
    if shorten:
        over = F.length(out) - most
        n = pieces[1::2].count(shorten)
        keep = F.greatest(F.length(values[shorten]) - F.ceil(over / n), F.lit(0)).cast("int")
        out = F.when(over > 0, full(values | {shorten: F.substring(values[shorten], F.lit(1), keep)})).otherwise(out)
    return out


def code_block(code: Column, language: Column) -> Column:
    """Code between fences that name its language."""
    return F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), code, F.lit("\n```"))
