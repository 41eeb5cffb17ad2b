"""Each operator over the shared tables. orders, parts, lines and events stand for components, edges and pages."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pages as X
from .functions import paths as P
from .functions import prompts as Q
from .operators import changes as D
from .operators import components as C
from .operators import diagrams as G2
from .operators import editions as E
from .operators import folds as O
from .operators import graph as G
from .operators import modules as M
from .operators import pages as W
from .plans import update as U
from .session import checkpointed
from .session import table as T
from .sources import declarations as S
from .sources import documents as J

_L = "long"


def _url_path():
    return F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)?", 1)


# components and edges


def _parts(s: SparkSession, d: str) -> DataFrame:
    """Parts as components: every fifth is a class, the others functions; brands are languages."""
    kind = F.when(F.col("p_partkey") % 5 == 0, "class").when(F.col("p_partkey") % 17 == 0, "artifact").otherwise("function")
    return T(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.col("p_brand").alias("language"), kind.alias("component_type"))


def _part_id():
    return F.concat(F.lit("p"), F.col("p_partkey").cast("string"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    """The first and any other line of an order tie their parts."""
    line = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"))
    first = line.where("l_linenumber = 1").select("l_orderkey", F.col("p").alias("caller"))
    return first.join(line.where("l_linenumber > 1").select("l_orderkey", F.col("p").alias("callee"), F.col("l_linenumber").cast(_L).alias("line")), "l_orderkey").select("caller", "callee", "line")


def module_edges(s, d):
    """2.6: weighted edges between modules with evidence; nations are modules, customers and suppliers components."""
    lines, orders = T(s, d, "lineitem").select("l_orderkey", "l_suppkey"), T(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    nation = T(s, d, "nation").select("n_nationkey", F.col("n_name").alias("module"))
    edges = lines.join(orders, "l_orderkey").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("caller"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("callee"))
    c = T(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    u = T(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("n_nationkey"))
    return M.module_edges(edges, c.union(u).join(nation, "n_nationkey").select("id", "module"))


def first_references(s, d):
    """2.4: one edge for each pair of components, with its first line."""
    return C.first_references(_calls(s, d))


def unique_name_resolution(s, d):
    """2.5: names that exactly one other component has."""
    parts = _parts(s, d).withColumn("key", F.split("name", " ")[0])
    refs = parts.select(F.col("id").alias("ref"), F.col("id").alias("owner"), "language", "key")
    return C.unique_matches(refs, parts, ["language", "key"])


def resolved_references(s, d):
    """2.5: names resolved by ordered fallbacks; types of parts are qualified names that some share, brands are languages, and references use every form of a name."""
    word = lambda i: F.split("p_name", " ")[i]
    pieces = ("p_type", word(1), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")))
    qualified = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("::", *pieces)).otherwise(F.concat_ws(".", *pieces))
    parts = T(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), _part_id().alias("id"), F.concat(word(0), (F.col("p_partkey") % 300).cast("string")).alias("name"), qualified.alias("qualified_name"), F.col("p_brand").alias("language"))
    # keys travel as numbers, without names; equal rows become one where the first join has put them, equal references when they are resolved
    made = T(s, d, "lineitem").select("l_suppkey", "l_partkey", F.pmod("l_orderkey", F.lit(6)).cast("byte").alias("form"))
    spoken = T(s, d, "part").select(F.col("p_partkey").alias("l_suppkey"), F.col("p_brand").alias("language"))
    whole = made.join(spoken, "l_suppkey").distinct().withColumn("owner", F.concat(F.lit("p"), F.col("l_suppkey").cast("string"))).drop("l_suppkey")
    whole = whole.join(parts.drop("language"), "l_partkey")
    form = F.when(F.col("form") == 0, F.col("id")).when(F.col("form") == 1, F.col("name")).when(F.col("form") == 2, F.col("qualified_name")).when(F.col("form") == 3, F.concat(F.lit("a.b.c.d."), "name")).when(F.col("form") == 4, F.concat(F.lit("x::y::"), "name")).otherwise(F.concat(F.lit("q::"), "qualified_name"))
    refs = whole.select("owner", "language", form.alias("name")).withColumn("ref", F.concat_ws("|", "owner", "name"))
    return C.resolved(refs, parts.drop("l_partkey"))


def depends_on(s, d):
    """2.5: each component's sorted distinct dependencies."""
    out = C.dependencies(_calls(s, d), _parts(s, d))
    return out.select("id", F.size("depends_on").cast(_L).alias("n"), F.array_join("depends_on", ",").alias("depends_on"))


def candidate_policy(s, d):
    """2.6: whether functions are candidates."""
    return C.candidate_policy(_parts(s, d))


def leaf_demotion(s, d):
    """2.5: candidates, without those that others depend on from 400 on; the parts of customers' keys use those of their orders' keys."""
    used = T(s, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("caller"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("callee"))
    return C.candidates(_parts(s, d), used)


def builtin_filter(s, d):
    """2.3: references whose last name isn't built in; parts refer to names of all kinds in all languages."""
    names = ("len", "list", "Vec", "rune", "size_t", "Int", "run", "Box", "to_s", "error", "Boolean", "main")
    languages = ("python", "go", "rust", "c", "java", "ruby", "kotlin")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))
    line = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.when(F.col("l_suppkey") % 2 == 0, "pkg.").otherwise("m::"), pick(names, F.col("l_partkey"))).alias("name"), pick(languages, F.col("l_suppkey")).alias("language"))
    return C.without_builtins(line).select("l_orderkey", "l_linenumber", "language", "name")


def referrers(s, d):
    """2.5: who depends on the artifacts."""
    ids = _parts(s, d).where("component_type = 'artifact'").select("id")
    return C.referrers(_calls(s, d), ids)


def artifact_units(s, d):
    """2.4: targets of make files; conversations are files whose user turns are targets."""
    talk = T(s, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/Makefile")).alias("path"), F.concat(F.col("role"), F.lit("_"), F.col("turn").cast("string"), F.lit(":  all\n\techo")).alias("content"), F.lit("build").alias("class"))
    return C.artifact_units(talk)


def _sources(s: SparkSession, d: str) -> DataFrame:
    """Documents as Python (even ids) and Java files: a class with a method for each line, which quotes the line in a comment and a string and calls by its first word."""
    quoted = lambda x: F.translate(line(x), "\\\"", "/'")
    line = lambda x: F.translate(x, "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "         ")
    word = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, "([A-Za-z]+)", 1), F.lit("")), F.lit("none"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    python = lambda x, i: F.concat(F.lit("    def m"), i.cast("string"), F.lit("(self, a=(1, 2), *b):\n        # def no(): if {\n        x = \""), quoted(x), F.lit(" class No: def no(\"\n        return f_"), word(x), F.lit("(x)\n"))
    java = lambda x, i: F.concat(F.lit("  int m"), i.cast("string"), F.lit("(Map<K, V> a, int b) { // "), line(x), F.lit("\n    String x = \""), quoted(x), F.lit(" } class No { \"; return f_"), word(x), F.lit("(x); }\n"))
    even = F.col("doc_id") % 2 == 0
    body = F.array_join(F.when(even, F.transform(lines, python)).otherwise(F.transform(lines, java)), "")
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    content = F.when(even, F.concat(F.lit("class "), name, F.lit("(Base):\n"), body)).otherwise(F.concat(F.lit("class "), name, F.lit(" extends Base<A, B> {\n"), body, F.lit("}\n")))
    return T(s, d, "documents").select("doc_id", F.concat(name, F.when(even, ".py").otherwise(".java")).alias("relative_path"), F.when(even, "python").otherwise("java").alias("language"), content.alias("content"))


def source_components(s, d):
    """2.4: components of all documents as files: how many, their parameters, bases and last lines."""
    found = S.components(_sources(s, d))
    return found.groupBy("relative_path").agg(
        F.count("*").alias("n"), F.count_if(F.col("component_type") == "method").alias("methods"), F.sum(F.size("parameters")).alias("parameters"), F.max(F.array_join("base_classes", ",")).alias("bases"), F.sum("end_line").alias("end_lines")
    )


def source_references(s, d):
    """2.4: what the documents' components call, by the innermost one; built-in names and keywords are out."""
    found = S.references(S.components(_sources(s, d))).where("kind = 'call'")
    return found.groupBy("name").agg(F.count("*").alias("callers"), F.count_if(F.col("owner").contains(".m")).alias("methods"), F.sum("line").alias("lines"))


# files and paths


def path_glob_filter(s, d):
    """2.3: the skip chain over URL paths."""
    p = _url_path()
    rows = T(s, d, "pages").select("page_id", p.alias("path"))
    return rows.where(~P.skipped(F.col("path"), include=["/en/*", "*/fr/[1-5]*"], exclude=["*.html", "*/?7*"], focus=["/"])).where("path <> ''")


def artifact_classes(s, d):
    """2.3: classes of files by ordered rules; URLs with parts' names are paths, and every part is in four forms."""
    forms = ("{t}/{n}", "src/{t}/Dockerfile.{k}", "{b}/.github/workflows/{n}.yml", "db/{t}/migrations/{k}.txt")
    ends = [".py", ".sql", ".sh", ".rs", "/package.json", "/Makefile", ".env.example", "/scripts/a", "/test/b.go", "/yarn.lock", "/CONFIG.json", ".kts", ".h++", ""]
    values = {"t": F.regexp_replace("p_type", " ", "/"), "n": F.regexp_replace("p_name", " ", "-"), "b": F.col("p_brand"), "k": F.col("p_partkey").cast("string")}
    path = F.transform(F.array(*[X.rendered(f, values) for f in forms]), lambda x: F.concat(x, F.element_at(F.array(*[F.lit(e) for e in ends]), (F.pmod(F.col("p_partkey"), F.lit(len(ends))) + 1).cast("int"))))
    rows = T(s, d, "part").select("p_partkey", F.explode(path).alias("path"))
    return rows.withColumns({"class": P.artifact_class(F.col("path")), "language": P.language(F.col("path"))})


def language_counts(s, d):
    """2.6: documents of each language, with their tokens."""
    return C.language_counts(T(s, d, "documents").select(F.col("lang").alias("language"), F.col("text").alias("source_code")))


def id_differences(s, d):
    """2.5: ids that are asked for but unknown, and known ones that are omitted; suppliers' keys against parts'."""
    return C.id_differences(T(s, d, "lineitem").select(F.col("l_suppkey").alias("id")), T(s, d, "part").select(F.col("p_partkey").alias("id")))


def component_listing(s, d):
    """2.6: components by file; customers by nation."""
    return C.by_file(T(s, d, "customer").select(F.col("c_name").alias("id"), F.col("c_nationkey").alias("relative_path")))


def class_cap_and_budget(s, d):
    """2.7: 40 files of a class, within a budget of bytes; sources are classes."""
    files = T(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("class"), F.col("n_chars").alias("size"))
    return O.within_budget(files, most=1_000_000)


def safe_ids(s, d):
    """2.11: names made safe for files, pages and editions."""
    c = F.col("url")
    change = F.concat(F.sha1("url"), F.lit(".."), F.sha1("html"))
    return T(s, d, "pages").select("page_id", P.safe_name(c).alias("safe_name"), P.safe_id(c).alias("safe_id"), P.source_file_name(c).alias("source_file"), P.edition_id(change).alias("edition"), P.is_page_segment(F.regexp_extract("url", "/([a-z]+)/", 1)).alias("segment"))


def id_checks(s, d):
    """2.3: whether texts can be modules, wikis, sessions, changes and safe paths; URLs, their parts and hashes of pages are tried."""
    p = T(s, d, "pages").select("page_id", "url", F.sha1("url").alias("a"), F.sha1("html").alias("b"), F.sha2("url", 256).alias("c"))
    tried = F.array("url", F.concat_ws("..", "a", "b"), F.concat_ws("..", "a", "c"), F.regexp_extract("url", "^[^:]+://([^/]*)", 1), F.regexp_replace("url", "^[^:]+://", ""), F.substring("a", 1, 7), F.concat(F.lit("_"), "a"), "c", F.concat("c", F.lit("-x")), F.concat_ws(":", F.lit("wiki"), F.substring("a", 1, 3)), F.concat(F.lit("x/../"), "a"))
    rows = p.select("page_id", F.posexplode(tried).alias("i", "value")).select("page_id", F.col("i").cast(_L).alias("i"), "value")
    v = F.col("value")
    return rows.withColumns({"module": P.is_module_name(v), "wiki": P.is_wiki_id(v), "session": P.is_session_id(v), "change": P.is_change_id(v), "path": P.is_safe_path(v)})


def page_ids(s, d):
    """2.9: page ids of modules; a path with a name that can't be one has none."""
    return _tree_rows(s, d).select("id", P.page_id("wiki", F.col("path")).alias("page")).withColumn("file", P.page_file(F.col("page")))


def role_labels(s, d):
    """2.9: what a module does by its name; documents' first words name modules."""
    names = F.concat_ws("_", F.lit("m"), F.substring_index("text", " ", 3), F.when(F.pmod("doc_id", F.lit(7)) == 0, "Runtime").when(F.pmod("doc_id", F.lit(5)) == 0, "HttpClient").when(F.pmod("doc_id", F.lit(11)) == 0, "Database"))
    return T(s, d, "documents").select("doc_id", P.role(names).alias("role"))


# modules


def _tree(s, d):
    region = T(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = T(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"))
    customer = T(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_name").alias("name"))
    return region.union(nation).union(customer)


def _tree_rows(s, d):
    """_tree with its paths, a join a level."""
    return M.flattened(_tree(s, d))


def tree_paths(s, d):
    """2.9: the paths of a tree of regions, nations and customers."""
    return _tree_rows(s, d).select("id", F.array_join("path", "/").alias("path"), F.col("depth").cast(_L).alias("depth"), "parent")


def post_order(s, d):
    """2.7: modules with the key of their place in post-order, in which children come first."""
    return _tree_rows(s, d).select("id", M.post_order_key(F.col("path")).alias("position"))


def ancestors(s, d):
    """2.9: how many modules stand below each ancestor, and how deep."""
    up = M.ancestors(_tree_rows(s, d))
    return up.groupBy(F.array_join("ancestor", "/").alias("ancestor")).agg(F.count("*").alias("n"), F.max("above").cast(_L).alias("deepest"))


def deepest_owner(s, d):
    """2.5: parts belong to the suppliers' nations and regions; the deepest owns, of equal ones the first by path."""
    lines = T(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    place = T(s, d, "supplier").join(T(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(F.struct(F.lit(1).alias("depth"), F.col("r_name").alias("path")), F.struct(F.lit(2).alias("depth"), F.concat_ws("/", "r_name", "n_name").alias("path")))).alias("m"))
    owned = lines.join(place, "l_suppkey").select(F.col("l_partkey").alias("id"), F.col("m.path").alias("module"), "m.depth", "m.path").distinct()
    return M.deepest_owner(owned).join(M.last_owner(owned).withColumnRenamed("module", "last_module"), "id")


def boundary_owner(s, d):
    """2.5: URLs belong to the module whose path is their longest prefix."""
    files = T(s, d, "pages").withColumn("path", _url_path()).select(F.expr("substring(path, 2)").alias("file")).where("file <> ''").distinct()
    base = T(s, d, "pages").select(F.regexp_extract("url", r"^[^:]+://[^/]+/([a-z]+)", 1).alias("a"), F.regexp_extract("url", r"^[^:]+://[^/]+/([a-z]+/[0-9]+)", 1).alias("b"), "page_id")
    modules = base.select(F.col("a").alias("prefix"), F.lit(1).alias("depth")).union(base.select("b", F.lit(2))).distinct().where("prefix <> ''")
    return M.boundary_owner(files, modules.withColumn("module", F.concat(F.lit("m:"), "prefix")))


def initial_modules(s, d):
    """2.9: candidates by the first part of their path."""
    comps = T(s, d, "pages").withColumn("path", _url_path()).select("page_id", F.expr("substring(path, 2)").alias("relative_path")).where("relative_path <> ''")
    return M.initial_modules(comps.withColumnRenamed("page_id", "id"))


def claims(s, d):
    """2.9: suppliers claim parts; each goes to the first claimant."""
    groups = T(s, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("module"), F.col("l_partkey").alias("id"))
    return M.claims(groups, T(s, d, "part").select(F.col("p_partkey").alias("id")))


def claim_problems(s, d):
    """2.9: ids outside the input (parts of which no customer has the key), those claimed before, suppliers that keep none."""
    groups = T(s, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("module"), F.col("l_partkey").alias("id")).distinct()
    return M.claim_problems(groups, T(s, d, "customer").select(F.col("c_custkey").alias("id")))


def applied_clusters(s, d):
    """2.9: a tree after responses: in each nation the segments claim its customers by their lines' suppliers."""
    nation = T(s, d, "nation").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("r_name", "n_name").alias("parent"))
    customer = T(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    members = customer.select(F.slice("parent", 1, 1).alias("path"), F.col("c_custkey").alias("id"))
    groups = T(s, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("parent", F.col("o_orderpriority").alias("module"), F.col("c_custkey").alias("id"))
    tree = M.applied_clusters(members, groups, customer.select("parent", F.col("c_custkey").alias("id")), nation.select("parent"))
    return tree.select(F.array_join("path", "/").alias("path"), "id")


def super_groups(s, d):
    """2.9: order priorities group brands; a group needs two, and the top level must shrink."""
    lines = T(s, d, "lineitem").join(T(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    members = lines.select(F.concat_ws("/", "o_orderpriority", "l_linestatus", F.pmod("o_custkey", F.lit(9)).cast("string")).alias("parent"), F.col("p_brand").alias("module"))
    return M.super_groups(members, T(s, d, "part").select(F.col("p_brand").alias("module")).distinct())


def tree_quality(s, d):
    """2.6: leaves over their tokens; suppliers by fifty are leaves, parts' names their text."""
    line = T(s, d, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("leaf"), F.pmod("l_suppkey", F.lit(50)).cast("string")).alias("leaf"), (F.col("l_suppkey") % 5 + 1).alias("depth")).distinct()
    tokens = T(s, d, "part").select(F.col("p_partkey").alias("id"), X.token_estimate(F.col("p_name")).alias("tokens"))
    return M.tree_quality(line.withColumn("depth", F.col("depth").cast("int")), tokens, limit=100)


def review_check(s, d):
    """2.6: reviews that are missing, empty or of high risk."""
    k = F.col("o_orderkey")
    reviews = T(s, d, "orders").select(k.alias("leaf"), (F.col("o_custkey") % 3 > 0).alias("is_leaf"), F.when(k % 9 != 0, F.when(k % 2 == 0, "split").otherwise("retain_leaf")).alias("decision"), F.when(k % 5 == 0, "high").otherwise("low").alias("risk"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("reason"))
    return M.review_check(reviews)


# graph


def _nation_edges(s, d):
    """A customers' nation leads, by order priority, to that of the supplier of its dearest line."""
    lines = T(s, d, "lineitem").join(T(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(T(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    best = lines.groupBy("c_nationkey", "o_orderpriority").agg(F.max_by("s_nationkey", F.struct("l_extendedprice", "s_nationkey")).alias("callee"))
    return best.select(F.col("c_nationkey").cast(_L).alias("caller"), F.col("callee").cast(_L).alias("callee")).distinct()


def khop_upstream(s, d):
    """2.9: what each part depends on within two steps; orders tie the parts of their lines."""
    out = G.within_hops(_calls(s, d).select("caller", "callee"), _parts(s, d).where("component_type = 'artifact'").select("id"), 2)
    return out.withColumn("hop", F.col("hop").cast(_L))


def diagram_paths(s, d):
    """2.9: diagrams with a path of three edges; an order's diagram ties its lines' suppliers in turn."""
    line = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"))
    edges = line.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("a"), "b")
    return G.simple_paths(edges, 3)


def _module_graph(s, d):
    """Regions and nations as modules, and the edges between nations."""
    rows = T(s, d, "nation").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast(_L).alias("n"), F.col("r_name").alias("region"), F.concat_ws(" / ", "r_name", "n_name").alias("module"))
    edges = _nation_edges(s, d).join(rows.select(F.col("n").alias("caller"), F.col("module").alias("src")), "caller").join(rows.select(F.col("n").alias("callee"), F.col("module").alias("dst")), "callee").select("src", "dst")
    return rows.select(F.col("region").alias("module")).union(rows.select("module")).distinct(), edges


def target_subtree(s, d):
    """2.9: for each module, what its diagram shows: what is below it, and what the edges bring in their order."""
    modules, edges = _module_graph(s, d)
    return G.target_subgraph(modules, modules.select(F.col("module").alias("target")), edges)


def primary_paths(s, d):
    """2.9: the primary path of each module's diagram."""
    modules, edges = _module_graph(s, d)
    targets = modules.select(F.col("module").alias("target"))
    return G.primary_paths(G.target_subgraph(modules, targets, edges), edges).select("target", F.array_join("path", " > ").alias("path"))


# snapshots


def _snapshots(s, d):
    k = F.col("o_orderkey")
    o = T(s, d, "orders")
    old = o.where(k % 10 != 0).select(k.alias("id"), F.col("o_orderstatus").alias("signature"), F.col("o_orderpriority").alias("body"), F.array(F.col("o_custkey").cast("string")).alias("depends_on"))
    new = o.where(k % 10 != 1).select(
        k.alias("id"),
        F.when(k % 7 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("signature"),
        F.when(k % 11 == 0, F.concat("o_orderpriority", F.lit("+"))).otherwise(F.col("o_orderpriority")).alias("body"),
        F.array(F.when(k % 13 == 0, (F.col("o_custkey") + 1).cast("string")).otherwise(F.col("o_custkey").cast("string"))).alias("depends_on"),
    )
    return old, new


def snapshot_diff(s, d):
    """2.10: added, deleted and changed components."""
    return D.snapshot_diff(*_snapshots(s, d))


def change_ratios(s, d):
    """2.10: ratios of active and structural changes, and the outcome with its reason."""
    old, new = _snapshots(s, d)
    changes = D.snapshot_diff(old, new)
    return D.outcome(D.change_ratios(changes, new.select("id")), changes, old)


def update_plan(s, d):
    """2.10: changes of a snapshot with renames taken out of added and deleted components; documents are components, those of odd ids get new ones or changes."""
    k = F.col("doc_id")
    docs = T(s, d, "documents").select(k, "lang", "text")
    rows = lambda id_, text: docs.select(id_.alias("id"), F.lit("text").alias("name"), F.lit("file").alias("component_type"), F.col("lang").alias("language"), text.alias("source_code"))
    old = rows(k, F.col("text"))
    new = rows(F.when(k % 4 == 1, k + 10_000_000).otherwise(k), F.when(k % 4 == 3, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return U.plan(U.prepared(old), U.prepared(new))["changes"]


def active_set(s, d):
    """2.6: the distinct components that changed and are still there."""
    return D.active(D.snapshot_diff(*_snapshots(s, d)))


def rename_pairs(s, d):
    """2.10: documents of odd ids as deleted, of even ids as added; greedy one-to-one renames by LCS."""
    docs = T(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("file").alias("component_type"), F.col("lang").alias("language"), F.col("text").alias("body"))
    return D.renamed(docs.where(F.col("id") % 2 == 1), docs.where(F.col("id") % 2 == 0))


def neighbour_majority(s, d):
    """2.6: parts go to the nation of most of their suppliers."""
    edges = T(s, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("dependency")).distinct()
    pages = T(s, d, "supplier").join(T(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("dependency"), F.col("n_name").alias("page"))
    return D.route(edges, pages, "overview", 0.25)


def write_sets(s, d):
    """2.10: the pages that each changed component writes; parts belong to the deepest module of their suppliers."""
    owners = deepest_owner(s, d).select("id", F.col("module").alias("page"))
    active = T(s, d, "lineitem").select(F.col("l_partkey").alias("id")).union(T(s, d, "customer").select(F.col("c_custkey").alias("id"))).distinct()
    return D.write_sets(active, owners, "overview")


def ancestor_sets(s, d):
    """2.9: modules of the customers' pages and all above them."""
    rows = T(s, d, "nation").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("page"), F.array("r_name", "n_name").alias("path"))
    return D.ancestor_sets(T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("page")), rows)


def applied_routes(s, d):
    """2.9: a tree after routing decisions; orders place their customers in nations and create leaves by priority."""
    name = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    nation = T(s, d, "nation").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", name(F.col("r_name")).alias("r"), name(F.col("n_name")).alias("n"))
    modules = nation.select(F.array("r").alias("path")).union(nation.select(F.array("r", "n"))).distinct()
    members = T(s, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.array("r", "n").alias("path"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    changes = T(s, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "deleted").otherwise("renamed").alias("kind"), F.concat(F.when(F.col("s_suppkey") % 3 == 0, "s").otherwise("t"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("old_id"))
    asked = T(s, d, "orders").join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    page = F.concat_ws(":", F.lit("wiki"), "r", "n", F.lit("start"))
    k = F.col("o_orderkey")
    asked = asked.select(
        k.alias("n"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("component_id"), F.when(k % 7 == 0, "untracked").when(k % 5 == 0, "create").otherwise("place").alias("action"), page.alias("leaf"),
        F.when(k % 2 == 0, name(F.col("o_orderpriority"))).alias("new_leaf"), F.when(k % 3 == 0, page).alias("parent"),
    )
    tree, _ = D.applied_routes(members, modules, changes, asked, asked.where("n % 11 > 0").select(F.col("component_id").alias("id")))
    return tree.select(F.array_join("path", "/").alias("path"), "id")


def verdicts(s, d):
    """2.10: verdicts in either JSON form, with reasons; events' types stand for them."""
    e = T(s, d, "events")
    names = F.create_map(*[F.lit(x) for pair in (("click", " Patch "), ("view", "no-op"), ("purchase", "REWRITE"), ("signup", "create: new"), ("logout", "perhaps")) for x in pair])
    said = F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type"))
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), said, F.lit('"'))).otherwise(F.concat(F.lit('{"verdict":"'), said, F.lit('","reason":"'), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("user_id").cast("string"))), F.lit('"}')))
    return D.verdicts(e.select(F.col("event_id").alias("page"), value.alias("value")))


def stale_scan(s, d):
    """2.10: missing and extra pages and broken links of the web pages; a page is expected by its path, and there if a page links it."""
    pages = T(s, d, "pages")
    expected = pages.select(_url_path().alias("page")).where("page <> ''").distinct()
    links = pages.select(_url_path().alias("page"), F.explode(X.html_links(F.col("html"))).alias("target")).where("page <> ''")
    present = links.select(F.col("target").alias("page")).distinct()
    return D.stale(expected, present, links.select("page", F.concat(F.col("target"), F.lit("x")).alias("target")).union(links.select("page", "target")))


def report_contexts(s, d):
    """2.10: what a report on each changed part shows."""
    parts = T(s, d, "part").select(_part_id().alias("id"), F.col("p_type").alias("relative_path"), F.col("p_brand").alias("language"), F.repeat(F.col("p_name"), F.lit(4)).alias("source_code"))
    changes = parts.select(F.when(F.length("source_code") % 3 == 0, "added").when(F.length("source_code") % 3 == 1, "modified_body").otherwise("deleted").alias("kind"), "id")
    out = D.context(changes, parts, _calls(s, d).where("caller <> callee").select("caller", "callee"), 1, 20)
    return out.select("id", "mode", "own", F.array_join("up", ",").alias("up"), F.array_join("referrers", ",").alias("referrers"))


def hunk_overlap(s, d):
    """2.5: changed lines meet components of a file; users are files."""
    e = T(s, d, "events").select("event_id", "user_id", (F.col("event_id") % 5000).alias("at"))
    hunks = e.where("event_id % 3 = 0").select(F.col("event_id").alias("hunk"), F.col("user_id").alias("path"), F.col("at").alias("first"), (F.col("at") + F.col("event_id") % 400).alias("last"))
    spans = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), F.col("at").alias("start"), (F.col("at") + F.col("event_id") % 700).alias("end"))
    return D.hunks_on(hunks, spans)


def edge_set_operations(s, d):
    """2.8: dependencies that only one, or both, of two halves of the orders have."""
    line = T(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"))
    a, b = (line.where(f"l_orderkey % 2 = {i}").select("id").distinct() for i in (0, 1))
    out = a.intersect(b).withColumn("side", F.lit("kept"))
    return out.union(a.subtract(b).withColumn("side", F.lit("deleted"))).union(b.subtract(a).withColumn("side", F.lit("added")))


# pages


def _wiki(text="text"):
    """A document as a page: by its length a line becomes a heading, a list, a quote, code, a diagram, CJK text or an indented one, and words get markup."""
    line = lambda x, k: (F.when(x == "", x).when(k == 0, F.concat(F.lit("== "), x, F.lit(" =="))).when(k == 1, F.concat(F.lit("  * "), x)).when(k == 2, F.concat(F.lit("> "), x))
        .when(k == 3, F.concat(F.lit("<code>\n"), x, F.lit("\n</code>"))).when(k == 4, F.concat(F.lit("   "), x)).when(k == 5, F.concat(F.lit("so **bold** [[a:b|"), x, F.lit("]] <sub>is</sub> ''gone'' 中文字")))
        .when(k == 6, F.concat(F.lit("<mermaid>\n"), x, F.lit("\n</mermaid> after"))).when(k == 7, F.concat(F.lit("| "), x)).otherwise(x))
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N} \n]", " ")
    trimmed = F.transform(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: F.struct(x.alias("x"), (F.length(x) % 11).alias("k")))
    return F.array_join(F.transform(trimmed, lambda y: line(y["x"], y["k"])), "\n")


def prose_counts(s, d):
    """2.11: words and CJK characters of pages' running text."""
    return T(s, d, "documents").select("doc_id", X.prose_counts(_wiki()).alias("p")).select("doc_id", "p.words", "p.cjk")


def opaque_blocks(s, d):
    """2.11: what documents show without code, file and nowiki blocks that overlap: words with some initials open or close one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for initial, tag in (("a", "<code>"), ("d", "</code>"), ("e", "<file>"), ("i", "</file>"), ("n", "<nowiki>"), ("s", "</nowiki>")):
        text = F.replace(text, F.lit(f" {initial}"), F.lit(f" {tag}{initial}"))
    shown = F.regexp_replace(X.shown_source(text), "[\x01\n]", "")
    return T(s, d, "documents").select("doc_id", shown.alias("t")).select("doc_id", F.length("t").cast(_L).alias("n_shown"), F.md5("t").alias("shown_md5"))


def headings(s, d):
    """2.11: heading lines of the documents as pages, and their titles."""
    return T(s, d, "documents").select("doc_id", F.array_join(X.headings(_wiki()), "|").alias("headings"), X.title(_wiki(), F.lit("-")).alias("title"))


def truncation(s, d):
    """2.10: texts cut to their head and tail."""
    cut = X.truncated(F.col("text"), 100)
    return T(s, d, "documents").select("doc_id", F.length(cut).cast(_L).alias("n"), F.sha2(cut, 256).alias("sha"))


def token_estimate_oversized(s, d):
    """2.6: documents of more tokens than a leaf takes."""
    n = X.token_estimate(F.col("text"))
    return T(s, d, "documents").select("doc_id", n.alias("tokens")).where(F.col("tokens") > 1000)


def link_extract(s, d):
    """2.11: link targets of the pages, with counts."""
    links = T(s, d, "pages").select(F.explode(X.html_links(F.col("html"))).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n"))


def _expected(s, d):
    return T(s, d, "pages").select(F.concat(F.lit("/"), F.regexp_extract("html", r"<a href=\"/([^\"]*)\"", 1)).alias("page")).distinct()


def broken_links(s, d):
    """2.5: links to targets that no page has as its first."""
    found = T(s, d, "pages").select(F.col("page_id").alias("page"), F.explode(X.html_links(F.col("html"))).alias("target"))
    return W.broken_links(found, _expected(s, d))


def page_differences(s, d):
    """2.5: pages that are missing or not expected."""
    present = T(s, d, "pages").select(F.explode(X.html_links(F.col("html"))).alias("page")).where("page like '/%e%'").distinct()
    return W.page_differences(_expected(s, d), present)


def unlinked_children(s, d):
    """2.5: nations that their region's page doesn't link; customers' nations are links."""
    rows = T(s, d, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_regionkey").alias("parent"))
    found = T(s, d, "supplier").where("s_acctbal > 5000").join(T(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("target"))
    return W.unlinked_children(rows, found)


def page_id_collisions(s, d):
    """2.3: paths that lead to one page id."""
    rows = T(s, d, "part").select(P.safe_id(F.lower("p_name")).alias("page"), F.col("p_partkey").alias("path"))
    return W.collisions(rows)


def grounding(s, d):
    """2.5: whether a text names its component, or symbol and path in one paragraph."""
    word = F.split("text", r"[\s]+")
    rows = T(s, d, "documents").select(F.col("doc_id").alias("page"), F.regexp_replace("text", r"\.\n", ".\n\n").alias("content"), F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("id"), word[0].alias("symbol"), F.coalesce(F.get(word, 40), F.lit("none")).alias("path"))
    return W.grounding(rows)


def _assessed(s, d):
    docs = T(s, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), _wiki().alias("wiki"))
    k = F.col("doc_id")
    head = F.when(k % 3 == 0, "=== Purpose and scope ===\n").when(k % 3 == 1, "== Design ==\n==== Error handling ====\n").otherwise("")
    tail = F.when(k % 4 == 0, F.concat(F.lit("\nsee "), F.col("source"), F.lit("/a.py and Main\n<mermaid>\ngraph TD\n A[Store"), k.cast("string"), F.lit("] --> B\n B --> C(Build it)\n</mermaid>"))).otherwise("")
    pages = checkpointed(W.facts(docs.select(k.alias("page"), (k % 2 == 0).alias("is_leaf"), (k % 10 == 1).alias("is_overview"), F.concat(head, "wiki", tail).alias("content"), "source")))
    anchors = pages.select("page", "content", F.explode(F.array(F.struct(F.concat("source", F.lit("/a.py::Main")).alias("id"), F.lit("Main").alias("symbol"), F.concat("source", F.lit("/a.py")).alias("path")), F.struct(F.lit("design").alias("id"), F.lit("zz").alias("symbol"), F.lit("zz").alias("path")))).alias("x")).select("page", "content", "x.*")
    labels = pages.select("page", F.concat(F.lit("Store "), F.col("page").cast("string")).alias("label"))
    required = pages.where("page % 6 = 0").select("page", F.lit("b").alias("target"))
    return W.assessed(pages, anchors, required, W.links(pages).withColumn("target", F.regexp_extract("target", ":(.*)", 1)), G2.quality(pages, labels))


def page_scores(s, d):
    """2.11: what documents as pages are worth: prose, areas, anchors, diagrams, links."""
    return _assessed(s, d).withColumn("errors", F.array_join("errors", ","))


def report_rollup(s, d):
    """2.6: counts over all pages' scores."""
    return W.report(_assessed(s, d))


def diagram_quality(s, d):
    """2.11: the quality of diagrams; an order's diagram ties its lines' suppliers in turn, labelled by their parts' brands."""
    line = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_partkey").join(T(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("to"))
    label = F.when(F.pmod("l_partkey", F.lit(9)) == 0, "Module").when(F.pmod("l_partkey", F.lit(9)) == 1, "Release it").otherwise(F.col("p_brand"))
    text = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("["), label, F.lit("] "), F.when(F.col("l_returnflag") == "R", "==>").otherwise("-->"), F.lit(" s"), F.col("to").cast("string"))
    text = line.join(after, ["l_orderkey", "l_linenumber"]).select("l_orderkey", F.struct("l_linenumber", text.alias("t")).alias("x"))
    body = text.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("b"))
    pages = body.select("page", (F.col("page") % 3 == 0).alias("is_leaf"), (F.col("page") % 3 == 1).alias("is_overview"), F.concat(F.lit("<mermaid>\nflowchart LR\n"), "b", F.lit("\n</mermaid>")).alias("content"))
    labels = line.where("l_linenumber = 1").select(F.col("l_orderkey").alias("page"), F.col("p_brand").alias("label"))
    return G2.quality(pages, labels).withColumn("issues", F.array_join("issues", ","))


def scoped_search(s, d):
    """2.3: documents of a language that have two words."""
    rows = T(s, d, "documents").select(F.col("doc_id").alias("page"), F.col("lang").alias("namespace"), F.col("text").alias("content"))
    return W.search(rows, ["the", "with"], "en")


def search_index(s, d):
    """2.2: the inverted index of the documents, by term."""
    rows = T(s, d, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("namespace"), F.col("text").alias("content"))
    return W.search_index(rows).groupBy("term").agg(F.count("*").alias("pages"), F.sum("n").alias("n"))


def html_export(s, d):
    """2.2: navigation and sections of the export."""
    rows = T(s, d, "pages").select(F.concat(F.lit("wiki:p"), F.col("page_id").cast("string")).alias("page"), F.array(F.lit("wiki"), F.col("url")).alias("path"), F.concat(F.lit("=== "), F.regexp_extract("html", "<title>([^<\n]*)", 1), F.lit(" ===\n[[a|b & c]] <x>\n"), F.trim(F.regexp_replace("html", r"[^\p{L}\p{N} ]+", " "))).alias("content"))
    return W.html_sections(rows)


def prompt_render(s, d):
    """2.11: prompts of a type with their variables replaced; customers are modules."""
    rows = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = Q.typed("system_leaf", "Document {module_name} in {doc_path}. {module_name} is a leaf.", {"module_name": F.col("c_name"), "doc_path": F.concat_ws("/", "n_name", "c_mktsegment")})
    return rows.select("c_custkey", text.alias("prompt"), F.sha2(text, 256).alias("sha"), F.length(text).cast(_L).alias("chars"))


def tree_outline(s, d):
    """2.11: outlines of trees for prompts; each region is a tree of its nations with their customers by segment."""
    c = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    leaf = c.groupBy(F.col("n_regionkey").alias("tree"), F.array(F.lit("top"), F.col("n_name")).alias("path")).agg(F.array_sort(F.collect_list(F.concat_ws("::", "c_mktsegment", "c_name"))).alias("ids"))
    top = leaf.select("tree", F.array(F.lit("top")).alias("path"), F.array().cast("array<string>").alias("ids")).distinct()
    return Q.outline(top.union(leaf), "top")


# state


def session_prune(s, d):
    """2.7: sessions younger than the limit, ten of a user."""
    rows = T(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), "ts")
    return O.kept_sessions(rows, datetime(2024, 1, 31, tzinfo=UTC), ttl_seconds=20 * 86400)


def orphan_locks(s, d):
    """2.12: locks without a session; suppliers' keys against customers' of the first segments."""
    return O.orphan_locks(T(s, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct(), T(s, d, "orders").select(F.col("o_custkey").alias("id")))


def edit_log_fold(s, d):
    """2.12: pages after their logs; a conversation's turns are operations."""
    t = T(s, d, "conversations")
    kind = F.when(F.col("turn") % 5 == 4, "undo").when(F.col("turn") % 3 == 2, "replace").otherwise("insert")
    ops = t.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("page"), F.col("turn").alias("seq"), kind.alias("kind"), F.col("role").alias("old"), F.concat_ws(" ", "role", "text").alias("new"), F.lit(0).cast(_L).alias("line"))
    return O.edit_log(ops)


# documents and editions


def graph_load(s, d):
    """2.1: a graph's JSON as nodes; nations are graphs of their suppliers."""
    node = F.concat(F.lit('"s'), F.col("s_suppkey").cast("string"), F.lit('":{"name":"'), "s_name", F.lit('","depends_on":["n'), F.col("s_nationkey").cast("string"), F.lit('"]}'))
    graphs = T(s, d, "supplier").groupBy(F.col("s_nationkey").alias("graph")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(node), ","), F.lit("}")).alias("value"))
    return J.graph_nodes(graphs).select("graph", "id", "name", F.array_join("depends_on", ",").alias("depends_on"))


def tree_load(s, d):
    """2.1: a nested JSON tree as rows; each region is a tree of its nations, their segments and customers."""
    c = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    object_ = lambda ids, children: F.concat(F.lit('{"components":['), ids, F.lit('],"children":{'), children, F.lit("}}"))
    named = lambda name, value: F.concat(F.lit('"'), F.col(name), F.lit('":'), value)
    joined = lambda x: F.array_join(F.collect_list(x), ",")
    leaf = c.groupBy("r_regionkey", "r_name", "n_name", "c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("c_name"), F.lit('"')))), ",").alias("ids"))
    nation = leaf.groupBy("r_regionkey", "r_name", "n_name").agg(joined(named("c_mktsegment", object_(F.col("ids"), F.lit("")))).alias("below"))
    trees = nation.groupBy("r_regionkey", "r_name").agg(joined(named("n_name", object_(F.lit(""), F.col("below")))).alias("below")).select(F.col("r_regionkey").alias("tree"), F.concat(F.lit("{"), named("r_name", object_(F.lit(""), F.col("below"))), F.lit("}")).alias("value"))
    return J.module_rows(trees).select("tree", F.array_join("path", "/").alias("path"), "depth", "parent", "is_leaf", F.array_join("components", ",").alias("components"))


def tree_save(s, d):
    """2.15: rows of modules as nested JSON trees; each region is a tree, nations have suppliers, their segments customers."""
    nation = T(s, d, "nation").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    segments = T(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_regionkey").alias("tree"), F.array("r_name", "n_name", "c_mktsegment").alias("path"), F.array("c_name").alias("components"))
    nations = T(s, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_regionkey").alias("tree"), F.array("r_name", "n_name").alias("path"), F.array("s_name").alias("components"))
    return J.tree_documents(segments.union(nations))


def cluster_groups(s, d):
    """2.9: the groups of a tagged response; each order's response groups its customer and priority."""
    body = F.concat(F.lit('words <GROUPED_COMPONENTS>{"'), "o_orderpriority", F.lit('":{"path":"x","components":["c'), F.col("o_custkey").cast("string"), F.lit('","o'), F.col("o_orderkey").cast("string"), F.lit('"]}}</GROUPED_COMPONENTS> more'))
    return J.cluster_groups(T(s, d, "orders").select(F.col("o_orderkey").alias("response"), body.alias("text")))


def cluster_responses(s, d):
    """2.9: nested responses of all orders: lines' flags group their parts, with a group inside for each status; outcome and rows of the tree."""
    line = T(s, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"))
    inner = line.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.collect_list("id").alias("ids"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, F.col("id"))).alias("even"))
    outer = inner.groupBy("l_orderkey", "l_returnflag").agg(F.flatten(F.collect_list("ids")).alias("components"), F.map_from_entries(F.collect_list(F.struct("l_linestatus", F.struct(F.col("even").alias("components"))))).alias("children"))
    body = outer.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct("components", "children"))))).alias("body"))
    review = F.when(F.col("o_orderstatus") == "F", "split").when(F.col("o_orderstatus") == "O", "retain_leaf")
    note = F.coalesce(F.concat(F.lit('<DECOMPOSITION_REVIEW>```{"decision":"'), review, F.lit('","risk":"low","reason":"r"}```</DECOMPOSITION_REVIEW>')), F.lit(""))
    text = F.concat(F.lit("so <GROUPED_COMPONENTS>\n"), F.coalesce("body", F.lit("{}")), F.lit("\n</GROUPED_COMPONENTS> "), note)
    orders = T(s, d, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("response"), "o_custkey", F.when(F.col("o_custkey") % 2 == 0, "repo").otherwise("module").alias("scope"), F.array("o_orderpriority", F.lit("x")).alias("parent"), text.alias("text"))
    orders = checkpointed(orders)
    responses = orders.withColumn("review", J.reviews(F.col("text")))
    asked = line.where("l_quantity > 25").select(F.col("l_orderkey").alias("response"), "id").union(orders.where("o_custkey % 5 <> 0").select("response", F.concat(F.lit("o"), F.col("response").cast("string"))))
    known = line.select("id").distinct().union(orders.where("response % 7 <> 0").select(F.concat(F.lit("o"), F.col("response").cast("string"))))
    groups = J.cluster_modules(orders.select("response", "text"))
    outcomes = checkpointed(M.cluster_outcomes(responses, groups, asked, known))
    rows = M.clustered(responses, groups, asked, outcomes).groupBy("response").agg(F.count("*").alias("members"), F.max(F.size("path")).cast(_L).alias("deepest"))
    return outcomes.join(rows, "response", "left")


def patch_hunks(s, d):
    """2.1: hunks of patches; each order's patch changes a file by its lines."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/f"), (k % 7).cast("string"), F.lit(".py\n@@ -1,2 +"), n.cast("string"), F.lit(","), (k % 4).cast("string"), F.lit(" @@ def\n+y\n@@ -9 +"), k.cast("string"), F.lit(" @@\n-z\ndiff --git a/q b/q\n+++ b/q.go\n@@ -3 +4,2 @@\n"))
    return J.patch_hunks(T(s, d, "orders").select(k.alias("patch"), text.alias("text")))


def id_lists(s, d):
    """2.1: ids of JSON arrays or lines, by the events' properties."""
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit('["a","'), "event_type", F.lit('"]'))).when(e % 3 == 1, F.concat("event_type", F.lit("\n\n b \n"))).otherwise(F.col("props"))
    return T(s, d, "events").select("event_id", F.array_join(J.id_list(text), ",").alias("ids"))


def page_creation(s, d):
    """2.2: pages that are new, there already or in conflict."""
    pages = T(s, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("content"))
    present = T(s, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise(F.col("o_orderstatus")).alias("content"))
    return E.new_pages(pages, present)


def edition_merge(s, d):
    """2.2: what each edition shows; customers' segments are editions over the nations' pages."""
    base = T(s, d, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_name").alias("content"))
    changes = T(s, d, "customer").groupBy(F.col("c_mktsegment").alias("edition"), F.col("c_nationkey").alias("page")).agg(F.max("c_name").alias("m"))
    return E.merged(base, changes.select("edition", "page", F.when(F.col("page") % 2 == 0, F.col("m")).alias("content")))


def edition_catalog(s, d):
    """2.1: an entry for each edition; sources are editions."""
    return E.catalog(T(s, d, "documents").select(F.col("source").alias("edition"), F.col("doc_id").alias("page"), F.col("text").alias("title")))


def metadata(s, d):
    """2.2: counts and a digest of all documents as pages."""
    return E.metadata(T(s, d, "documents").select(F.col("doc_id").alias("page"), F.col("text").alias("content")))


def history_scan(s, d):
    """2.1: the last edit snapshot of each path; users are paths."""
    return E.latest(T(s, d, "events").select(F.col("user_id").alias("path"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("mtime"), F.col("event_id").alias("file")))


def overview_context(s, d):
    """2.9: the tree as an overview shows it, with the pages of the target's children."""
    rows = _tree_rows(s, d)
    return E.overview(rows.withColumn("page", P.page_id("wiki", F.transform("path", lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("-")), F.lit("#"), F.lit("-"))))), "ASIA/CHINA")


_NAMES = """graph_load tree_load tree_save cluster_groups cluster_responses patch_hunks id_lists page_creation edition_merge edition_catalog history_scan overview_context primary_paths module_edges first_references unique_name_resolution resolved_references depends_on candidate_policy leaf_demotion builtin_filter referrers artifact_units
source_components source_references path_glob_filter artifact_classes language_counts class_cap_and_budget safe_ids page_ids role_labels tree_paths post_order ancestors deepest_owner boundary_owner initial_modules
claims super_groups tree_quality review_check khop_upstream diagram_paths target_subtree snapshot_diff change_ratios active_set rename_pairs neighbour_majority write_sets verdicts
hunk_overlap edge_set_operations prose_counts opaque_blocks headings truncation token_estimate_oversized link_extract broken_links page_differences unlinked_children page_id_collisions grounding
page_scores report_rollup diagram_quality scoped_search search_index html_export prompt_render session_prune orphan_locks edit_log_fold
id_differences component_listing id_checks claim_problems applied_clusters update_plan ancestor_sets applied_routes stale_scan report_contexts tree_outline metadata"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES.split()}
