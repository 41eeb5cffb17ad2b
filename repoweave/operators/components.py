"""Names, dependency edges and documentation candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import token_estimate

#: Component types that are declarations of types or scopes.
OOP_TYPES = ("class", "record", "interface", "struct", "enum", "trait", "union", "module", "object", "namespace", "type")
#: From so many candidates on, those that others depend on are left out; so many types, or such a share of them, make functions no candidates.
REDUCTION, ENOUGH_TYPES, TYPE_SHARE = 400, 20, 0.2


#: Names that are no component's in any language, and in single ones.
BUILTINS = (
    "if", "else", "for", "while", "switch", "catch", "return", "throw", "try", "finally", "new", "self", "this", "super", "true", "false", "null", "nil", "None", "Some", "Ok", "Err", "Option", "Result", "String",
    "Integer", "Boolean", "Object", "Exception", "println", "print", "len", "make", "append", "require", "include", "raise", "to_s",
)
_JVM = ("int", "long", "float", "double", "char", "void", "Int", "Long", "Float", "Double", "Char", "Boolean", "Unit", "Any", "Nothing", "String")
BUILTINS_OF = {
    "python": ("list", "dict", "set", "tuple", "int", "str"),
    "go": ("byte", "rune", "error", "complex64", "complex128"),
    "rust": ("Vec", "Box", "Arc", "Rc", "Result"),
    "c": ("size_t", "NULL"),
    "cpp": ("size_t", "NULL"),
    "java": _JVM,
    "csharp": _JVM,
    "kotlin": _JVM,
}


def is_builtin(language: Column, name: Column) -> Column:
    """Whether a name's last part is one of the language or of any."""
    last = F.element_at(F.split(name, "[.:]"), -1)
    out = last.isin(*BUILTINS)
    for lang, names in BUILTINS_OF.items():
        out = out | ((language == lang) & last.isin(*names))
    return F.coalesce(out, F.lit(False))


def _other(ids: Column, own: Column) -> Column:
    """ids (n, low, high: how many there are, the least and the greatest) -> the only one that isn't own, if there is one."""
    n, low, high = ids["n"], ids["low"], ids["high"]
    return F.when(n == 1, F.when(own.isNull() | (low != own), low)).when(n == 2, F.when(low == own, high).when(high == own, low))


def unique_matches(references: DataFrame, names: DataFrame, keys: list[str], ref: str = "ref", own: str = "owner") -> DataFrame:
    """references (ref, owner, keys), names (id, keys) -> ref, target: the only other id under the reference's keys.

    Ids equal to the reference's owner are left out before uniqueness counts;
    several ids give no target. Counts are combined before the shuffle.
    """
    by = names.select(*keys, "id").distinct()
    # a name's ids need not be gathered: with at most one to leave out, the two least ones decide
    least = by.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    hit = references.join(least, keys)
    return hit.withColumn("target", _other(F.struct("n", "low", "high"), F.col(own))).where("target is not null").select(ref, "target")


def name_index(components: DataFrame) -> DataFrame:
    """components (id, name, qualified_name, language) -> id, language, key, simple: each id's names, and the last part of each."""
    keys = F.filter(F.array("id", "name", "qualified_name"), lambda x: x.isNotNull() & (x != ""))
    return components.select("id", "language", F.explode(F.array_distinct(keys)).alias("key")).withColumn("simple", F.element_at(F.split("key", "[.:]"), -1)).distinct()


def _by_key(index: DataFrame) -> DataFrame:
    """name_index's rows -> key, exact, simple (n, low, high of the ids that have it as a name, and as a name's last part), spoken (the same for either, of each language)."""
    entries = index.select("id", "language", F.explode(F.array(F.struct("key", F.lit(True).alias("whole")), F.struct(F.col("simple").alias("key"), F.lit(False).alias("whole")))).alias("x"))
    entries = entries.select("id", "language", "x.*").where("key <> ''")
    ids = entries.groupBy("key", "id").agg(F.max("whole").alias("whole"), F.max(~F.col("whole")).alias("part"), F.collect_set("language").alias("languages"))
    ids = ids.withColumn("language", F.explode(F.concat(F.array(F.lit(None).cast("string")), "languages")))
    among = lambda c: F.struct(F.count_if(c).alias("n"), F.min(F.when(c, F.col("id"))).alias("low"), F.max(F.when(c, F.col("id"))).alias("high"))
    each = ids.groupBy("key", "language").agg(among(F.lit(True)).alias("any"), among(F.col("whole") & F.col("language").isNull()).alias("exact"), among(F.col("part") & F.col("language").isNull()).alias("simple"))
    all_ = F.col("language").isNull()
    return each.groupBy("key").agg(*[F.max(F.when(all_, F.col(x))).alias(x) for x in ("exact", "simple")], F.collect_list(F.when(~all_, F.struct("language", "any.*"))).alias("spoken"))


def resolved(references: DataFrame, components: DataFrame) -> DataFrame:
    """references (ref, owner, language, name) -> ref, target by ordered fallbacks.

    Of the name as it is: the unique id in the language (by a whole or simple
    name), the unique exact name. Then of what follows its last `::`, and of what
    follows its last `.`: the unique id in the language, the unique simple name,
    the unique exact name. The first of these with a target decides; an ambiguous
    name has no edge.
    """
    known = _by_key(name_index(components))
    cuts = [F.col("name"), F.substring_index("name", "::", -1), F.substring_index("name", ".", -1)]
    rows = references.select("ref", "owner", "language", *[x.alias(f"key{i}") for i, x in enumerate(cuts)])
    # equal keys are looked up once: by the first cut that gives one, and for what isn't tried of the whole name (its simple ids) by the next one
    later = F.when(F.col("key1") == F.col("key0"), 1).when(F.col("key2") == F.col("key0"), 2)
    one = lambda i, new, again=None: F.when(new, F.struct(F.col(f"key{i}").alias("key"), F.lit(i).alias("cut"), (F.lit(None) if again is None else again).cast("int").alias("again")))
    tries = F.array_compact(F.array(one(0, F.col("key0").isNotNull(), later), one(1, F.col("key1") != F.col("key0")), one(2, (F.col("key2") != F.col("key0")) & (F.col("key2") != F.col("key1")))))
    hit = rows.select("ref", "owner", "language", F.explode(tries).alias("x")).select("ref", "owner", "language", "x.*").join(known, "key")
    said = F.get(F.filter("spoken", lambda x: x["language"] == F.col("language")), 0)
    hit = hit.select("ref", "cut", "again", *[_other(x, F.col("owner")).alias(k) for k, x in (("spoken", said), ("simple", F.col("simple")), ("exact", F.col("exact")))])
    at = lambda cut, rank: F.struct(cut.alias("cut"), F.lit(rank).alias("rank"))
    whole, first, simple = F.col("cut") == 0, F.col("spoken").isNotNull(), F.col("simple").isNotNull()
    best = F.when(first, F.struct(at(F.col("cut"), 0).alias("at"), F.col("spoken").alias("target"))).when(~whole & simple, F.struct(at(F.col("cut"), 1).alias("at"), F.col("simple").alias("target")))
    best = best.when(F.col("exact").isNotNull(), F.struct(at(F.col("cut"), 2).alias("at"), F.col("exact").alias("target"))).when(F.col("again").isNotNull() & simple, F.struct(at(F.col("again"), 1).alias("at"), F.col("simple").alias("target")))
    return hit.select("ref", best.alias("x")).where("x is not null").groupBy("ref").agg(F.min_by("x.target", "x.at").alias("target"))


def local_matches(references: DataFrame, components: DataFrame) -> DataFrame:
    """references (ref, owner, relative_path, name), components (id, name, qualified_name, relative_path) -> ref, target: the only other component of the same file under the name or its last part."""
    names = components.select("relative_path", "id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key")).where("key <> ''")
    tries = references.select("ref", "owner", "relative_path", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", "[.:]"), -1)))).alias("key"))
    both = tries.join(names, ["relative_path", "key"]).where("id <> owner")
    # one target by either key: the least and the greatest are the same
    return both.groupBy("ref").agg(F.min("id").alias("target"), F.max("id").alias("most")).where("target = most").select("ref", "target")


def artifact_components(files: DataFrame) -> DataFrame:
    """files (relative_path, class, content) -> the artifact component of each file, and of each of its units but one named as the file."""
    units = artifact_units(files.select(F.col("relative_path").alias("path"), "class", "content")).select(F.col("path").alias("relative_path"), "unit")
    file_name = F.element_at(F.split("relative_path", "/"), -1)
    rows = files.select("relative_path", F.col("class").alias("artifact_class"), file_name.alias("name"), F.col("content").alias("source_code"), F.lit("artifact_file").alias("node_type"))
    more = files.select("relative_path", F.col("class").alias("artifact_class"), file_name.alias("own")).join(units, "relative_path").where("unit <> own")
    rows = rows.unionByName(more.select("relative_path", "artifact_class", F.col("unit").alias("name"), F.lit("artifact_unit").alias("node_type")), allowMissingColumns=True)
    id_ = F.concat_ws("::", "relative_path", "name")
    return rows.withColumns({"id": id_, "qualified_name": id_, "component_type": F.lit("artifact"), "language": F.lit("Artifact")})


def dependencies(edges: DataFrame, components: DataFrame) -> DataFrame:
    """edges (caller, callee) -> id, depends_on: the sorted distinct other components that a known caller uses."""
    ids = components.select(F.col("id").alias("caller"))
    kept = edges.where("caller <> callee").join(ids, "caller", "left_semi").distinct()
    return kept.groupBy(F.col("caller").alias("id")).agg(F.array_sort(F.collect_set("callee")).alias("depends_on"))


def first_references(calls: DataFrame) -> DataFrame:
    """calls (caller, callee, line) -> one edge for each pair, with its first line."""
    return calls.where("caller <> callee").groupBy("caller", "callee").agg(F.min("line").alias("line"))


def candidate_policy(components: DataFrame) -> DataFrame:
    """components (component_type) -> one row: oop, functions, include_functions."""
    counts = components.agg(F.count_if(F.col("component_type").isin(*OOP_TYPES)).alias("oop"), F.count_if(F.col("component_type") == "function").alias("functions"))
    few = (F.col("oop") < ENOUGH_TYPES) & (F.col("functions") > F.col("oop"))
    thin = (F.col("functions") > 0) & (F.col("oop") / (F.col("oop") + F.col("functions")) < TYPE_SHARE)
    return counts.withColumn("include_functions", (F.col("oop") == 0) | few | F.coalesce(thin, F.lit(False)))


def candidates(components: DataFrame, edges: DataFrame, reduction: int = REDUCTION) -> DataFrame:
    """components (id, component_type), edges (caller, callee) -> id of documentation candidates.

    From `reduction` candidates on, those that a component other than an
    artifact depends on are left out.
    """
    functions = candidate_policy(components).select("include_functions").scalar()
    kinds = F.col("component_type").isin("artifact", *OOP_TYPES) | ((F.col("component_type") == "function") & functions)
    wanted = components.where(kinds).select("id")
    code = components.where("component_type <> 'artifact'").select(F.col("id").alias("caller"))
    used = edges.join(code, "caller", "left_semi").select(F.col("callee").alias("id")).distinct()
    many = wanted.agg((F.count("*") >= reduction).alias("many"))
    marked = wanted.join(used.withColumn("used", F.lit(True)), "id", "left").withColumn("many", many.scalar())
    return marked.where("used is null or not many").select("id")


def without_builtins(references: DataFrame) -> DataFrame:
    """references (language, name) without those to built-in names."""
    return references.where(~is_builtin(F.col("language"), F.col("name")))


def referrers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges (caller, callee), ids (id) -> id, referrer: who depends on each."""
    return edges.join(ids.select(F.col("id").alias("callee")), "callee", "left_semi").select(F.col("callee").alias("id"), F.col("caller").alias("referrer")).distinct()


def id_differences(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted, known (id) -> id, problem: unknown (wanted, but not there) or omitted (there, but not wanted)."""
    unknown = wanted.select("id").distinct().join(known, "id", "left_anti").select("id", F.lit("unknown").alias("problem"))
    return unknown.union(known.select("id").distinct().join(wanted, "id", "left_anti").select("id", F.lit("omitted").alias("problem")))


def language_counts(components: DataFrame) -> DataFrame:
    """components (language, source_code) -> language, n, tokens (estimated, of all sources)."""
    return components.groupBy("language").agg(F.count("*").alias("n"), F.sum(token_estimate(F.col("source_code"))).alias("tokens"))


def by_file(components: DataFrame) -> DataFrame:
    """components (id, relative_path) -> relative_path, n, ids (sorted, joined by commas): the listing of a prompt, a line a file."""
    return components.groupBy("relative_path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


def artifact_units(artifacts: DataFrame, most: int = 25) -> DataFrame:
    """artifacts (path, class, content) -> path, unit: scripts of packages, targets, stages and jobs, sorted, the first 25."""
    name = F.element_at(F.split("path", "/"), -1)
    low = F.lower(name)
    stages = F.regexp_extract_all("content", F.lit(r"(?im)^\s*FROM\s+[^\n]+$"), F.lit(0))
    units = (
        F.when(name == "package.json", F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")), F.array().cast("array<string>")))
        .when(low.isin("makefile", "gnumakefile") | name.endswith(".mk"), F.regexp_extract_all("content", F.lit(r"(?m)^([A-Za-z0-9_.-]+)\s*:"), F.lit(1)))
        .when((F.col("class") == "container") & low.startswith("dockerfile"), F.transform(stages, lambda x, i: F.concat(F.lit("stage_"), (i + 1).cast("string"))))
        .when(F.col("class") == "ci", F.regexp_extract_all("content", F.lit(r"(?m)^\s{2}([A-Za-z0-9_.-]+):\s*$"), F.lit(1)))
    )
    return artifacts.select("path", F.explode(F.slice(F.array_sort(F.array_distinct(units)), 1, most)).alias("unit"))
