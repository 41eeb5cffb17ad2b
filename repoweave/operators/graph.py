"""Walks over dependency edges and module graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """edges (caller, callee), starts (id) -> start, id, hop: what each start depends on within so many steps, with the fewest steps.

    A start is listed only if it depends on itself in the end. Each hop is one
    join of the newly reached with the edges; it ends when nothing is new.
    """
    step = edges.select(F.col("caller").alias("at"), F.col("callee").alias("next")).distinct()
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct()
    seen = None
    for hop in range(1, hops + 1):
        found = front.join(step, "at").select("start", F.col("next").alias("id")).distinct()
        fresh = found if seen is None else found.join(seen, ["start", "id"], "left_anti")
        fresh = fresh.withColumn("hop", F.lit(hop))
        seen = fresh if seen is None else seen.union(fresh)
        front = fresh.select("start", F.col("id").alias("at"))
    return seen


def simple_paths(edges: DataFrame, length: int) -> DataFrame:
    """edges (page, a, b) -> page: those whose diagram has a path of `length` edges that visits no node twice.

    A page's diagram is a few edges; paths of each page stay on its key.
    """
    paths = edges.select("page", F.array("a", "b").alias("path")).where("a <> b").distinct()
    step = edges.select("page", F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    for _ in range(length - 1):
        last = F.element_at("path", -1)
        paths = paths.withColumn("_a", last).join(step, ["page", "_a"]).where(~F.array_contains("path", F.col("_b"))).select("page", F.concat("path", F.array("_b")).alias("path"))
    return paths.select("page").distinct()


def target_subgraph(modules: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """modules (module: path as text, parts tied by ` / `), targets (target), edges (src, dst) -> target, module: what a target's diagram shows.

    It begins with the target and all below it. Edges then count in order of
    (src, dst): an edge with an end that is in takes its other end in, so what an
    edge brings reaches later edges only. A module's entry is the least edge that
    brings it; entries are lowered, a join a round, until none gets lower.
    """
    first = F.struct(F.lit("").alias("src"), F.lit("").alias("dst"))
    tied = edges.where("src <> dst").select("src", "dst").distinct()
    both = checkpointed(tied.select(F.col("src").alias("module"), F.col("dst").alias("other"), F.struct("src", "dst").alias("edge")).union(tied.select("dst", "src", F.struct("src", "dst"))))
    # a module offers itself and all above it, so that this is a join on equal keys
    names = F.split("module", " / ")
    up = modules.select("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), " / "))).alias("target"))
    entry = checkpointed(up.join(targets.select("target").distinct(), "target").select("target", "module", first.alias("entry")).distinct())
    while True:
        brought = entry.join(both, "module").where("edge > entry").select("target", F.col("other").alias("module"), F.col("edge").alias("entry"))
        lower = checkpointed(entry.union(brought).groupBy("target", "module").agg(F.min("entry").alias("entry")))
        if lower.join(entry, ["target", "module", "entry"], "left_anti").isEmpty():
            return lower.select("target", "module")
        entry = lower


#: Fixed value: so many modules stand for a path where the graph has none.
FALLBACK_MODULES = 8


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """From the first module without an incoming edge on to the smallest one not seen yet."""
    after: dict[str, list[str]] = {}
    for src, dst in rows.dropna(subset=["dst"]).sort_values(["src", "dst"])[["src", "dst"]].itertuples(index=False):
        after.setdefault(src, []).append(dst)
    entered = {x for targets in after.values() for x in targets}
    at = min((x for x in rows["src"] if x not in entered), default=None)
    path: dict[str, None] = {}
    while at is not None:
        path[at] = None
        at = next((x for x in after.get(at, ()) if x not in path), None)
    return pd.DataFrame({"target": [key[0]], "path": [list(path)]})


def primary_paths(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """selected (target, module), edges (src, dst) -> target, path (an array): the chain of modules that tells each target's story.

    It leads from the target's first module without an incoming edge always on
    to the smallest module that isn't in it yet. Where it has fewer than two,
    the first FALLBACK_MODULES modules at and below the target stand for it. A
    group is the edges of one target's diagram.
    """
    inside = edges.where("src <> dst").join(selected.select("target", F.col("module").alias("src")), "src").join(selected.select("target", F.col("module").alias("dst")), ["target", "dst"])
    rows = inside.select("target", "src", "dst").union(selected.select("target", F.col("module").alias("src"), F.lit(None).cast("string").alias("dst")))
    walked = rows.groupBy("target").applyInPandas(_walk, "target string, path array<string>")
    own = selected.where((F.col("module") == F.col("target")) | F.col("module").startswith(F.concat("target", F.lit(" / "))))
    nth = F.row_number().over(Window.partitionBy("target").orderBy(F.split("module", " / ")))
    listed = own.withColumn("n", nth).where(F.col("n") <= FALLBACK_MODULES).groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "module"))), lambda x: x["module"]).alias("listed"))
    return walked.join(listed, "target", "left").select("target", F.when(F.size("path") >= 2, F.col("path")).otherwise(F.coalesce("listed", "path")).alias("path"))
