"""Differences between two snapshots, and what they route to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.pages import source_tokens, truncated
from ..session import checkpointed
from .graph import within_hops


def signature() -> Column:
    return F.concat_ws("|", F.coalesce("name", F.lit("")), F.array_join("parameters", ","), F.array_join("base_classes", ","))


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """previous, current (id, signature, body: tokens, depends_on) -> kind, id: added, deleted, modified_interface, modified_body, edge_changes.

    A component can have several kinds of change; only digests of bodies and
    edges are joined.
    """
    thin = lambda df, x: df.select("id", F.col("signature").alias(f"s{x}"), F.xxhash64("body").alias(f"b{x}"), F.xxhash64(F.array_sort("depends_on")).alias(f"e{x}"), F.lit(True).alias(f"in{x}"))
    both = thin(previous, 0).join(thin(current, 1), "id", "full_outer")
    there = F.col("in0").isNotNull() & F.col("in1").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(F.col("in0").isNull(), "added"),
            F.when(F.col("in1").isNull(), "deleted"),
            F.when(there & (F.col("s0") != F.col("s1")), "modified_interface"),
            F.when(there & (F.col("b0") != F.col("b1")) & (F.col("s0") == F.col("s1")), "modified_body"),
            F.when(there & (F.col("e0") != F.col("e1")), "edge_changes"),
        )
    )
    return both.select(F.explode(kinds).alias("kind"), "id")


def with_renames(changes: DataFrame, previous: DataFrame, current: DataFrame, tau: float = 0.95) -> DataFrame:
    """snapshot_diff's changes, previous, current (id, component_type, language, body) -> kind, id, old_id: paired additions and deletions as one rename each."""
    changes = checkpointed(changes)
    side = lambda df, kind: df.join(changes.where(F.col("kind") == kind), "id", "left_semi").select("id", "component_type", "language", "body")
    pairs = checkpointed(renamed(side(previous, "deleted"), side(current, "added"), tau).select("old_id", F.col("new_id").alias("id")))
    gone = pairs.select(F.lit("deleted").alias("kind"), F.col("old_id").alias("id")).union(pairs.select(F.lit("added"), "id"))
    rest = changes.join(gone, ["kind", "id"], "left_anti").select("kind", "id", F.lit(None).cast(changes.schema["id"].dataType).alias("old_id"))
    return rest.union(pairs.select(F.lit("renamed"), "id", "old_id"))


def active(changes: DataFrame) -> DataFrame:
    """changes (kind, id) -> id: whatever changed but wasn't just deleted. A renamed id counts by its new name."""
    return changes.where("kind <> 'deleted'").select("id").distinct()


#: Kinds of change that count as structural.
STRUCTURAL = ("added", "deleted", "renamed", "edge_changes")


def change_ratios(changes: DataFrame, total: DataFrame, structural: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """changes, total (id) -> one row: active, structural, total (one at least), the ratios of both to it, rounded, and full_fallback."""
    counts = changes.agg(F.count_distinct(F.when(F.col("kind") != "deleted", F.col("id"))).alias("active"), F.count_distinct(F.when(F.col("kind").isin(*structural), F.struct("kind", "id"))).alias("structural"))
    n = total.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    out = counts.withColumn("total", n.scalar())
    out = out.withColumns({"active_ratio": F.round(F.col("active") / F.col("total"), 6), "structural_ratio": F.round(F.col("structural") / F.col("total"), 6)})
    return out


def fallback(ratios: DataFrame, tau_full: float = 0.5, tau_tree: float = 0.3) -> DataFrame:
    """ratios -> with outcome: no_change, full_fallback (either ratio reaches its limit) or incremental."""
    full = (F.col("active_ratio") >= tau_full) | (F.col("structural_ratio") >= tau_tree)
    return ratios.withColumn("outcome", F.when((F.col("active") == 0) & (F.col("structural") == 0), "no_change").when(full, "full_fallback").otherwise("incremental"))


def outcome(ratios: DataFrame, changes: DataFrame, previous: DataFrame, tau_full: float = 0.5, tau_tree: float = 0.3, tau_grow: float = 0.33) -> DataFrame:
    """change_ratios' row, changes, previous -> the row with added, growth_ratio, fallback (its reason or null), reclustered, outcome.

    An empty previous snapshot is a full fallback. The structural reason goes
    before the active one. Enough growth, or a fallback, clusters anew.
    """
    out = ratios.withColumns({"added": changes.agg(F.count_if(F.col("kind") == "added").alias("n")).scalar(), "empty": previous.agg((F.count("*") == 0).alias("n")).scalar(), "changes": changes.agg(F.count("*").alias("n")).scalar()})
    reason = F.when(F.col("structural_ratio") >= tau_tree, "structural-threshold").when(F.col("active_ratio") >= tau_full, "active-leaf-threshold")
    out = out.withColumns({"growth_ratio": F.round(F.col("added") / F.col("total"), 6), "fallback": reason})
    grown = (F.col("added") > 0) & (F.col("growth_ratio") >= tau_grow)
    said = F.when(F.col("empty") | F.col("fallback").isNotNull(), "full_fallback").when(F.col("changes") == 0, "no_change").otherwise("incremental")
    return out.withColumns({"reclustered": F.col("fallback").isNotNull() | grown, "outcome": said}).drop("empty", "changes")


def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (m + n) of two arrays of tokens, one row of the table at a time; 1 for two empty ones.

    The bits of one number hold a row of the table (Hyyrö's method).
    """
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x), list(y)
        if not x and not y:
            out.append(1.0)
            continue
        at = {}
        for i, t in enumerate(y):
            at[t] = at.get(t, 0) | 1 << i
        full = (1 << len(y)) - 1
        row = full
        for t in x:
            hit = row & at.get(t, 0)
            row = ((row + hit) | (row - hit)) & full
        out.append(2.0 * (len(y) - row.bit_count()) / (len(x) + len(y)))
    return pd.Series(out, dtype="float64")


#: Counters of the sketch that tells common pairs of tokens from rare ones.
_SLOTS = 1 << 16
#: Bins of a body's tokens; their numbers tell most unlike bodies apart.
_BINS = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _elements(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the tokens (width 1), or of the pairs that follow each other with both ends (2), each with the number of its occurrence; 0: without it."""
    x = tokens.astype(np.int64).view(np.uint64)
    if width == 2:
        x = np.concatenate(([np.uint64(1)], x, [np.uint64(2)]))
        x = _mixed(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:])
    if not width:
        return _mixed(x)
    x = np.sort(x)
    nth = np.arange(len(x)) - np.searchsorted(x, x)
    return _mixed(x + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _counted(width: int):
    def run(batches):
        n = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for tokens in batch["tokens"]:
                n += np.bincount((_elements(tokens, width) % np.uint64(_SLOTS)).astype(np.int64), minlength=_SLOTS)
        slot = np.flatnonzero(n)
        yield pd.DataFrame({"slot": slot, "n": n[slot]})

    return run


def _prefixes(width: int, tau: float, counts):
    """The rarest elements of each body, so many that two bodies of similarity tau share one.

    Of m and n tokens, tau * (m + n) / 2 or more are common, so n >= m * tau /
    (2 - tau). A token that is left out takes two pairs from its own sequence
    and at most one from the other.
    """

    def run(batches):
        common = counts.value
        for batch in batches:
            out = []
            for tokens in batch["tokens"]:
                x, m = _elements(tokens, width), len(tokens)
                both = 2 * m / (2 - tau)
                least = both * tau / 2 if width == 1 else 1 + both * (1.5 * tau - 1)
                n = len(x) - max(1, int(np.ceil(least - 1e-6))) + 1
                out.append(x[np.lexsort((x, common[(x % np.uint64(_SLOTS)).astype(np.int64)]))[:n]].view(np.int64))
            yield pd.DataFrame({"g": batch["g"], "kind": batch["kind"], "m": [len(t) for t in batch["tokens"]], "elements": out, "words": [np.bincount((_elements(t, 0) % np.uint64(_BINS)).astype(np.int64), minlength=_BINS).astype(np.int32) for t in batch["tokens"]]})

    return run


def _bodies(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """old, id, body, tokens, kind and g (equal for equal tokens of one kind) of all bodies that have tokens."""
    side = lambda df, old: df.select(F.lit(old).alias("old"), "id", "body", F.xxhash64(F.to_json(F.struct("component_type", "language"))).alias("kind"), source_tokens(F.col("body")).alias("tokens"))
    return side(deleted, True).union(side(added, False)).where("size(tokens) > 0").withColumn("g", F.xxhash64("kind", "tokens"))


def _alike(bodies: DataFrame, members: DataFrame, tau: float) -> DataFrame:
    """bodies, members (g, old, id: those to compare) -> old_id, new_id, similarity of at least tau."""
    ratio, width = 0.9 * tau, 2 if tau > 0.7 else 1
    hashed = bodies.select("g", "kind", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    counts = np.zeros(_SLOTS, np.int64)
    for slot, n in hashed.select("tokens").mapInPandas(_counted(width), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n
    counts = bodies.sparkSession.sparkContext.broadcast(counts)
    prefixes = hashed.mapInPandas(_prefixes(width, tau, counts), "g long, kind long, m int, elements array<long>, words array<int>").groupBy("g").agg(F.any_value("kind").alias("kind"), F.any_value("m").alias("m"), F.any_value("elements").alias("elements"), F.any_value("words").alias("words"))
    groups = members.groupBy("g").agg(F.min(F.when(F.col("old"), F.col("id"))).alias("old"), F.min(F.when(~F.col("old"), F.col("id"))).alias("new"))
    keys = checkpointed(prefixes.join(groups, "g"))
    own = lambda x: keys.where(F.col(x).isNotNull()).select("kind", F.explode("elements").alias("e"), "g", "m").select(F.xxhash64("kind", "e").alias("e"), F.col("g").alias(f"{x}_g"), F.col("m").alias(f"{x}_m"))
    near = own("old").join(own("new"), "e").where(F.least("old_m", "new_m") >= ratio * F.greatest("old_m", "new_m"))
    near = near.where(F.least("old_m", "new_m") * (2 - tau) >= tau * F.greatest("old_m", "new_m") - 1e-6).select("old_g", "new_g", "old_m", "new_m").distinct()
    words = lambda x: keys.select(F.col("g").alias(f"{x}_g"), F.col("words").alias(f"{x}_words"))
    # tokens that a bin has more of on one side are in no common subsequence
    apart = F.aggregate(F.zip_with("old_words", "new_words", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b)
    near = near.join(words("old"), "old_g").join(words("new"), "new_g").where(apart <= (1 - tau) * (F.col("old_m") + F.col("new_m")) + 1e-6)
    near = checkpointed(near.select("old_g", "new_g"))
    hashes = lambda x: F.transform(source_tokens(F.col(x)), lambda t: F.xxhash64(t))

    def body(x):
        first = groups.select("g", F.col(x).alias("id")).join(near.select(F.col(f"{x}_g").alias("g")).distinct(), "g", "left_semi")
        return bodies.where(F.col("old") == (x == "old")).select("id", F.col("body").alias(f"{x}_body")).join(first, "id").select(F.col("g").alias(f"{x}_g"), f"{x}_body")

    both = near.join(body("old"), "old_g").join(body("new"), "new_g")
    scored = both.select("old_g", "new_g", F.pandas_udf(lcs_similarity, "double")(hashes("old_body"), hashes("new_body")).alias("similarity")).where(F.col("similarity") >= tau)
    ids = lambda x: members.where(F.col("old") == (x == "old")).select(F.col("g").alias(f"{x}_g"), F.col("id").alias(f"{x}_id"))
    return scored.join(ids("old"), "old_g").join(ids("new"), "new_g").select("old_id", "new_id", F.round("similarity", 6).alias("similarity"))


def rename_pairs(deleted: DataFrame, added: DataFrame, tau: float = 0.95) -> DataFrame:
    """deleted, added (id, component_type, language, body) -> old_id, new_id, similarity of possible renames.

    Pairs are of one type and language, of lengths within 0.9 * tau, and at
    least tau similar; bodies without tokens have no pair. Equal bodies are
    compared once. Bodies meet on the rarest of their pairs of tokens, so many
    of them that no pair of that similarity is missed.
    """
    bodies = _bodies(deleted, added)
    return _alike(bodies, checkpointed(bodies.select("g", "old", "id")), tau)


def renamed(deleted: DataFrame, added: DataFrame, tau: float = 0.95) -> DataFrame:
    """deleted, added as for rename_pairs -> old_id, new_id, similarity: the greedy one-to-one choice among its pairs.

    Equal bodies come first: the first old id goes with the first new one, the
    second with the second. Only what is left is compared.
    """
    bodies = _bodies(deleted, added)
    nth = F.row_number().over(Window.partitionBy("g", "old").orderBy("id"))
    ids = checkpointed(bodies.select("g", "old", "id").withColumn("nth", nth))
    side = lambda x: ids.where(F.col("old") == (x == "old")).select("g", "nth", F.col("id").alias(f"{x}_id"))
    same = side("old").join(side("new"), ["g", "nth"]).select("old_id", "new_id", F.lit(1.0).alias("similarity"))
    both = ids.groupBy("g").agg(F.least(F.count_if("old"), F.count_if(~F.col("old"))).alias("taken"))
    rest = checkpointed(ids.join(both, "g").where("nth > taken").select("g", "old", "id"))
    return same.union(renames(_alike(bodies, rest, tau)))


def renames(pairs: DataFrame) -> DataFrame:
    """pairs (old_id, new_id, similarity) -> the greedy one-to-one choice: by similarity, then old and new id.

    Each round takes the pairs that are the best of both their ends, and drops
    what shares an end with them; that gives the same choice as going through
    the pairs one by one. Where ids have equal best partners and are all of
    those partners' best, as copies are, a round takes them all, in order.
    Rounds go on until no pair is left; each takes the best pair at least.
    """
    rest, out = checkpointed(pairs), None
    while not rest.isEmpty():
        top = rest
        for x in ("old_id", "new_id"):
            top = top.join(rest.groupBy(x).agg(F.max("similarity").alias("similarity")), [x, "similarity"])
        for x, y in (("old_id", "new_id"), ("new_id", "old_id")):
            # of the ends whose best pairs are `top`: what set of partners they have
            best = rest.join(rest.groupBy(x).agg(F.max("similarity").alias("similarity")), [x, "similarity"])
            partners = best.groupBy(x).agg(F.count("*").alias(f"{x}_n"), F.sum(F.xxhash64(y).cast("decimal(20,0)")).alias(f"{x}_of"), F.bit_xor(F.xxhash64(y, F.lit(1))).alias(f"{x}_xor"), F.min(y).alias(f"{x}_first"))
            top = top.join(partners, x)
        # a block: all ends have the same partners, and each is its partners' best
        block = ["similarity", "old_id_n", "old_id_of", "old_id_xor", "new_id_n", "new_id_of", "new_id_xor"]
        top = checkpointed(top)
        olds, news = (top.select(x, *block).distinct() for x in ("old_id", "new_id"))
        whole = top.groupBy(*block).agg(F.count_distinct("old_id").alias("a"), F.count_distinct("new_id").alias("b")).where("a = new_id_n and b = old_id_n").select(*block)
        ranked = lambda df, x: df.join(whole, block).withColumn("nth", F.row_number().over(Window.partitionBy(*block).orderBy(x)))
        closed = ranked(olds, "old_id").join(ranked(news, "new_id"), [*block, "nth"]).select("old_id", "new_id", "similarity")
        single = top.where("old_id_first = new_id and new_id_first = old_id").select("old_id", "new_id", "similarity")
        best = checkpointed(closed.union(single).distinct())
        out = best if out is None else out.union(best)
        rest = checkpointed(rest.join(best.select("old_id"), "old_id", "left_anti").join(best.select("new_id"), "new_id", "left_anti"))
    return pairs.limit(0) if out is None else out


def route(edges: DataFrame, pages: DataFrame, fallback_page: str, tau: float = 0.5) -> DataFrame:
    """edges (id, dependency) to known components, pages (dependency, page) -> id, page: that of most dependencies.

    Of equal counts the smaller page; it must have the share tau of the known
    dependencies, else the fallback page is it.
    """
    counts = edges.join(pages, "dependency", "left").groupBy("id", "page").agg(F.count("*").alias("n"))
    total = counts.groupBy("id").agg(F.sum("n").alias("total"), F.min_by(F.struct("page", "n"), F.when(F.col("page").isNotNull(), F.struct(-F.col("n"), F.col("page")))).alias("best"))
    return total.select("id", F.when(F.col("best.n") / F.col("total") >= tau, F.col("best.page")).otherwise(fallback_page).alias("page"))


def fallback_page(leaves: DataFrame, overview: str) -> Column:
    """leaves (id, page) -> a scalar: the page of the first component that has one, else the overview."""
    return F.coalesce(leaves.agg(F.min_by("page", "id").alias("page")).scalar(), F.lit(overview))


def write_sets(active_ids: DataFrame, owners: DataFrame, overview: str) -> DataFrame:
    """active_ids (id), owners (id, page: of each component's deepest module) -> id, page: what each change writes, its own page and the overview."""
    own = active_ids.join(owners, "id").select("id", "page")
    return own.union(active_ids.select("id", F.lit(overview).alias("page"))).distinct()


def ancestor_sets(routed: DataFrame, modules: DataFrame) -> DataFrame:
    """routed (id, page), modules (page, path) -> module: the routed pages' modules and all above them, as paths."""
    hit = modules.join(routed.select("page").distinct(), "page", "left_semi")
    return hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.array_join(F.slice("path", F.lit(1), n), "/"))).alias("module")).distinct()


def applied_routes(members: DataFrame, modules: DataFrame, changes: DataFrame, decisions: DataFrame, known: DataFrame, wiki: str = "wiki") -> tuple[DataFrame, DataFrame]:
    """A tree after routing decisions -> (members: path, id; decisions: n, component_id, action, outcome).

    members (path, id) and modules (path) are the tree; of changes (kind, id,
    old_id) the deleted ids leave it and renamed ones go by their new id.
    decisions (n, component_id, action, leaf, new_leaf, parent) count in order of
    n: place puts a known component into a leaf's page, create into a new (or
    present) child of the parent's page or of the top; either adds it to all
    modules above, too. A page that a decision makes is there for later ones, and
    what gets a child is no leaf for them. Others are rejected; untracked ones
    are just that. Rounds of creation go on until no page is new.
    """
    gone = changes.where("kind = 'deleted'").select("id")
    new = changes.where("kind = 'renamed'").select(F.col("old_id").alias("id"), F.col("id").alias("new_id"))
    kept = members.select("path", "id").join(gone, "id", "left_anti").join(new, "id", "left").select("path", F.coalesce("new_id", "id").alias("id"))
    asked = checkpointed(decisions.join(known.select(F.col("id").alias("component_id")).distinct().withColumn("known", F.lit(True)), "component_id", "left"))
    page = lambda path: P.page_id(wiki, path)
    # pages with the decision that makes them; -1: they were there
    there = checkpointed(modules.select("path", page(F.col("path")).alias("page"), F.lit(-1).cast("long").alias("since")).where("page is not null").distinct())
    wanted = asked.where("known and action = 'create' and coalesce(new_leaf, '') <> ''").select("n", "component_id", "new_leaf", F.when(F.col("parent") != "", F.col("parent")).alias("parent"))
    top = wanted.where("parent is null").select("n", "component_id", F.array("new_leaf").alias("path"))
    made = top
    while True:
        pages = there.union(made.select("path", page(F.col("path")).alias("page"), F.col("n").alias("since")).where("page is not null")).groupBy("path", "page").agg(F.min("since").alias("since"))
        below = wanted.where("parent is not null").join(pages.select(F.col("page").alias("parent"), F.col("path").alias("up"), "since"), "parent").where("since < n")
        found = checkpointed(top.union(below.select("n", "component_id", F.concat("up", F.array("new_leaf")))).distinct())
        if found.join(made, ["n", "path"], "left_anti").isEmpty():
            break
        made = found
    made = made.where(page(F.col("path")).isNotNull())
    pages = checkpointed(there.union(made.select("path", page(F.col("path")), "n")).groupBy("path", "page").agg(F.min("since").alias("since")))
    # when a page gets its first child
    parents = pages.where(F.size("path") > 1).groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.min("since").alias("filled"))
    leaves = pages.join(parents, "path", "left").withColumn("filled", F.coalesce("filled", F.lit((1 << 63) - 1)))
    placed = asked.where("known and action = 'place'").join(leaves.select(F.col("page").alias("leaf"), "path", "since", "filled"), "leaf").where("since < n and filled > n").select("n", "component_id", "path")
    done = checkpointed(placed.union(made))
    above = done.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("path"), F.col("component_id").alias("id"))
    said = asked.join(done.select("n").distinct().withColumn("done", F.lit(True)), "n", "left")
    result = F.when(F.col("known").isNull(), "unknown component").when(F.col("action") == "untracked", "untracked").when(F.col("done"), "applied").otherwise("no such page")
    return kept.union(above).distinct(), said.select("n", "component_id", "action", result.alias("outcome"))


#: What a page's verdict can be.
VERDICTS = ("no-op", "patch", "rewrite", "create", "delete")


def verdicts(raw: DataFrame, allowed: tuple[str, ...] = VERDICTS) -> DataFrame:
    """raw (page, value: a JSON string or object) -> page, verdict, reason, record; a verdict that isn't allowed is null.

    Verdicts are trimmed and lower-cased, a text can hold its reason after a
    colon. record is the verdict with its reason, as it is kept.
    """
    text = F.when(F.col("value").rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))
    said = F.lower(F.trim(F.coalesce(F.get_json_object("value", "$.verdict"), text)))
    name, own = F.trim(F.substring_index(said, ":", 1)), F.get_json_object("value", "$.reason")
    reason = F.coalesce(F.when(own != "", own), F.when(text.isNotNull() & said.contains(":"), F.trim(F.substring(said, F.instr(said, ":") + 1, F.length(said)))))
    record = F.when(own != "", F.concat_ws(": ", said, own)).otherwise(said)
    good = name.isin(*allowed)
    return raw.select("page", F.when(good, name).alias("verdict"), reason.alias("reason"), F.when(good, record).alias("record"))


def stale(expected: DataFrame, present: DataFrame, links: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """expected, present (page), links (page, target), carried (page, problem) -> page, problem, target: what a scan before the end of an update finds.

    Missing and extra pages, links to pages that aren't there, and the problems
    that an earlier check left.
    """
    none = F.lit(None).cast("string").alias("target")
    lost = expected.join(present, "page", "left_anti").select("page", F.lit("missing").alias("problem"), none)
    extra = present.join(expected, "page", "left_anti").select("page", F.lit("extra").alias("problem"), none)
    broken = links.join(present.select(F.col("page").alias("target")), "target", "left_anti").select("page", F.lit("broken link").alias("problem"), F.col("target").cast("string"))
    out = lost.union(extra).union(broken)
    return (out if carried is None else out.union(carried.select("page", "problem", none))).distinct()


def finalized(plan: DataFrame, said: DataFrame, present: DataFrame, problems: DataFrame, started: Column, finished: Column) -> DataFrame:
    """outcome's row, verdicts (page, record), pages present, stale's rows -> the one row that an update leaves behind.

    It has the plan's columns, wall_seconds (0 at least), pages_written, the
    verdicts as a map and the counts of stale problems as a map. A verdict that
    isn't allowed makes an error.
    """
    entries = said.select("page", F.coalesce("record", F.raise_error(F.concat(F.lit("no verdict for "), F.col("page").cast("string")))).alias("record"))
    kept = entries.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page").cast("string").alias("page"), "record")))).alias("m"))
    counts = problems.groupBy("problem").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("problem", "n")))).alias("m"))
    pages = present.select("page").distinct().agg(F.count("*").alias("n"))
    wall = F.greatest(F.unix_millis(finished) - F.unix_millis(started), F.lit(0)) / 1000
    return plan.withColumns({"wall_seconds": wall, "pages_written": pages.scalar(), "verdicts": kept.scalar(), "stale": counts.scalar()})


def hunks_on(hunks: DataFrame, spans: DataFrame, width: int = 256) -> DataFrame:
    """hunks (hunk, path, first, last), spans (id, path, start, end) -> hunk, id of those that overlap in one file.

    Both are cut into stretches of `width` lines and meet on equal ones; a pair
    counts in the stretch where its overlap begins.
    """
    cut = lambda df, a, b: df.withColumn("_at", F.explode(F.sequence(F.expr(f"{a} div {width}"), F.expr(f"{b} div {width}"))))
    both = cut(hunks, "first", "last").join(cut(spans, "start", "end"), ["path", "_at"])
    begin = F.greatest("first", "start")
    return both.where((F.col("first") <= F.col("end")) & (F.col("start") <= F.col("last")) & (F.col("_at") == F.floor(begin / width))).select("hunk", "id")


def context(changes: DataFrame, components: DataFrame, edges: DataFrame, hops: int = 1, tokens: int = 8000) -> DataFrame:
    """changes (kind, id), components (id, relative_path, language, source_code), edges (caller, callee) -> a report's row for each active component.

    id, mode (create for added ones, else edit), own (its source, cut), up (what
    it depends on within hops), referrers (who depends on it), relative_path,
    language; lists are sorted.
    """
    ids = active(changes)
    made = changes.where("kind = 'added'").select("id").distinct().withColumn("made", F.lit(True))
    used = edges.join(ids.select(F.col("id").alias("callee")), "callee", "left_semi").groupBy(F.col("callee").alias("id")).agg(F.array_sort(F.collect_set("caller")).alias("referrers"))
    up = within_hops(edges, ids, hops).groupBy(F.col("start").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("up"))
    none = F.array().cast("array<string>")
    rows = components.join(ids, "id", "left_semi").join(made, "id", "left").join(used, "id", "left").join(up, "id", "left")
    return rows.select("id", F.when(F.col("made"), "create").otherwise("edit").alias("mode"), truncated(F.col("source_code"), tokens).alias("own"), F.coalesce("up", none).alias("up"), F.coalesce("referrers", none).alias("referrers"), "relative_path", "language")


def orphans(routed: DataFrame, components: DataFrame) -> DataFrame:
    """routed (id, page), components (id, relative_path, name) -> id, relative_path, name, suggested_leaf: what a routing prompt shows."""
    return components.join(routed.select("id", F.col("page").alias("suggested_leaf")), "id").select("id", "relative_path", "name", "suggested_leaf")
