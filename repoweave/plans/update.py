"""From two snapshots to changes, outcome, routes and write sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import source_tokens
from ..operators import changes as D
from ..operators import graph as G
from ..session import checkpointed


@dataclass(frozen=True)
class Options:
    """Limits of an update: renames' similarity, a report's tokens, neighbours' share, growth, hops, active and structural ratios."""

    tau_ren: float = 0.95
    max_diff_tokens: int = 8000
    tau_nb: float = 0.5
    tau_grow: float = 0.33
    k_hop: int = 1
    tau_full: float = 0.5
    tau_tree: float = 0.3
    rung: str = "3"

    def __post_init__(self):
        for name in ("tau_ren", "tau_nb", "tau_grow", "tau_full", "tau_tree"):
            if not 0 <= getattr(self, name) <= 1:  # NaN isn't, either
                raise ValueError(f"{name} is not between 0 and 1")
        if self.max_diff_tokens < 1:
            raise ValueError("max_diff_tokens is not positive")
        if self.rung not in ("0", "1", "2", "3", "3b"):
            raise ValueError(f"unknown rung {self.rung}")


def prepared(components: DataFrame) -> DataFrame:
    """components as they are stored -> id, component_type, language, body, signature, depends_on for a plan.

    Bodies are compared by their tokens, so that white space is no change.
    """
    none = F.array().cast("array<string>")
    for name in ("parameters", "base_classes", "depends_on"):
        components = components.withColumn(name, F.coalesce(name, none) if name in components.columns else none)
    body = F.coalesce("source_code", F.lit(""))
    return components.select("id", "component_type", "language", body.alias("body"), D.signature().alias("signature"), F.array_join(source_tokens(body), " ").alias("tokens"), "depends_on")


def plan(previous: DataFrame, current: DataFrame, owners: DataFrame | None = None, options: Options = Options(), overview: str = "wiki:start") -> dict[str, DataFrame]:  # noqa: B008
    """previous, current (as prepared gives them), owners (id, page) -> changes, active, outcome (one row), write_sets."""
    thin = lambda df: df.select("id", "signature", F.col("tokens").alias("body"), "depends_on")
    changes = checkpointed(D.with_renames(D.snapshot_diff(thin(previous), thin(current)), previous, current, options.tau_ren))
    active = D.active(changes)
    ratios = D.change_ratios(changes, current.select("id"))
    out = {"changes": changes, "active": active, "outcome": D.outcome(ratios, changes, previous, options.tau_full, options.tau_tree, options.tau_grow)}
    return out if owners is None else out | {"write_sets": D.write_sets(active, owners, overview)}


def routes(changes: DataFrame, edges: DataFrame, leaves: DataFrame, modules: DataFrame, overview: str = "wiki:start", options: Options = Options()) -> dict[str, DataFrame]:  # noqa: B008
    """changes, edges (caller, callee: known components), leaves (id, page), modules (page, path) -> routed (id, page of each added or renamed one), ancestors, upstream."""
    new = changes.where("kind in ('added', 'renamed')").select("id").distinct()
    own = edges.join(new.select(F.col("id").alias("caller")), "caller", "left_semi").select(F.col("caller").alias("id"), F.col("callee").alias("dependency"))
    fallback = D.fallback_page(leaves, overview)
    routed = D.route(own, leaves.select(F.col("id").alias("dependency"), "page"), None, options.tau_nb)
    routed = new.join(routed, "id", "left").withColumn("page", F.coalesce("page", fallback))
    return {"routed": routed, "ancestors": D.ancestor_sets(routed, modules), "upstream": G.within_hops(edges, D.active(changes), options.k_hop)}
