"""Editions of a documentation: creation of pages, catalogs, merged views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_pages(pages: DataFrame, present: DataFrame) -> DataFrame:
    """pages, present (page, content) -> page, content, outcome: created, same (its content is there already) or conflict."""
    there = present.select("page", F.col("content").alias("_old"))
    both = pages.join(there, "page", "left")
    outcome = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("content"), "same").otherwise("conflict")
    return both.select("page", "content", outcome.alias("outcome"))


def merged(repository: DataFrame, changes: DataFrame) -> DataFrame:
    """repository (page, content), changes (edition, page, content) -> edition, page, content: what each edition shows.

    A change edition shows its own pages and, of those it doesn't have, the
    repository's that it lists with null content; the repository edition shows
    its own.
    """
    own = changes.where("content is not null").select("edition", "page", "content")
    listed = changes.where("content is null").select("edition", "page").join(repository.select("page", "content"), "page").select("edition", "page", "content")
    return own.union(listed).union(repository.select(F.lit("repository").alias("edition"), "page", "content"))


def catalog(pages: DataFrame) -> DataFrame:
    """pages (edition, page, title) -> edition, pages, first_page, title: one entry for each edition, titled by its first page."""
    return pages.groupBy("edition").agg(F.count("*").alias("pages"), F.min("page").alias("first_page"), F.min_by("title", "page").alias("title"))


def latest(history: DataFrame) -> DataFrame:
    """history (path, ts, mtime, file) -> the last snapshot of each path by time, file time and name."""
    return history.groupBy("path").agg(F.max(F.struct("ts", "mtime", "file")).alias("_l")).select("path", "_l.*")


def overview(modules: DataFrame, target: str) -> DataFrame:
    """modules (path array, page) -> module, depth, is_target, child_page: what an overview's prompt shows, without components."""
    name = F.array_join("path", "/")
    return modules.select(name.alias("module"), F.size("path").cast("long").alias("depth"), (name == target).alias("is_target"), F.when((F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), "/") == target), F.col("page")).alias("child_page"))


def metadata(pages: DataFrame) -> DataFrame:
    """pages (page, content) -> one row: pages, characters, and a digest over the pages' own digests, whatever their order."""
    digest = F.conv(F.substring(F.md5(F.concat(F.col("page").cast("string"), F.lit("\x01"), F.coalesce("content", F.lit("")))), 1, 15), 16, 10).cast("decimal(38,0)")
    each = pages.select(F.length("content").cast("long").alias("n"), digest.alias("h"))
    return each.agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"), F.sum("h").cast("string").alias("digest"))
