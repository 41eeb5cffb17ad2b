"""Files to components, edges, candidates and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import folds as O
from ..operators import modules as M
from ..session import checkpointed
from ..sources import declarations, tree


def analyze(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), focus: list[str] = (), gitignore: bool = True, artifact_bytes: int = O.MOST_BYTES) -> dict[str, DataFrame]:
    """The tables of a source tree: files, components, edges (caller, callee), candidates, modules, artifacts, summary.

    Artifacts are taken in walk order while their class and `artifact_bytes` have
    room; those that are taken are components, each with its units. A reference
    goes to the only match in its own file, or else in the whole tree; names that
    are built in go nowhere.
    """
    files = checkpointed(tree.files(spark, root, include, exclude, focus, gitignore))
    code = declarations.components(files)
    artifacts = O.within_budget(files.where("class is not null").select(F.col("relative_path").alias("path"), "class", "size", "walk"), most=artifact_bytes, order="walk").drop("walk")
    taken = files.join(artifacts.where("included").select(F.col("path").alias("relative_path")), "relative_path", "left_semi")
    components = checkpointed(code.drop("refs").unionByName(C.artifact_components(taken), allowMissingColumns=True))
    references = checkpointed(declarations.references(code))
    near = C.local_matches(references, code)
    far = C.resolved(references.join(near, "ref", "left_anti"), components)
    found = near.union(far).join(references.select("ref", "owner"), "ref").select(F.col("owner").alias("caller"), F.col("target").alias("callee"))
    edges = checkpointed(found.where("caller <> callee").distinct())
    chosen = checkpointed(C.candidates(components, edges))
    spoken = files.where("language is not null").agg(F.count("*").alias("supported_files"), F.array_sort(F.collect_set("language")).alias("languages"))
    return {
        "files": files.drop("walk"),
        "components": components,
        "edges": edges,
        "candidates": chosen,
        "modules": M.initial_modules(components.join(chosen, "id", "left_semi")),
        "artifacts": artifacts,
        "languages": C.language_counts(components),
        "summary": spoken.withColumns({"total_components": components.agg(F.count("*")).scalar(), "leaf_nodes": chosen.agg(F.count("*")).scalar()}),
    }


def written(tables: dict[str, DataFrame], folder: str, snapshot: str) -> None:
    """Write the tables under folder, a partition for each snapshot: earlier snapshots stay, this one is replaced if it is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/snapshot={snapshot}")
