"""Operators that go through rows in order: budgets, retention, edit logs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Files of a class, and bytes of all, that an artifact index takes.
PER_CLASS, MOST_BYTES = 40, 8 << 20


def _first_fits(per_class: int):
    """Sorted rows (class, size) -> those that fewer than per_class rows of the class, no larger, precede."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict = {}  # of each class the smallest sizes so far, as a heap of their negatives
        for batch in batches:
            keep = []
            for name, size in zip(batch["class"].astype(object).where(batch["class"].notna(), None), batch["size"].tolist(), strict=True):
                heap = least.setdefault(name, [])
                fits = len(heap) < per_class or size < -heap[0]
                if fits:
                    (heapq.heappush if len(heap) < per_class else heapq.heappushpop)(heap, -size)
                keep.append(fits)
            yield batch[keep]

    return run


def _taken(per_class: int, most: int):
    """Rows in order -> the _row of those that are taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, room = most, {}
        for batch in batches:
            out = []
            for row, name, size in zip(batch["_row"].tolist(), batch["class"].astype(object).where(batch["class"].notna(), None), batch["size"].tolist(), strict=True):
                if size <= left and room.setdefault(name, per_class):
                    room[name] -= 1
                    left -= size
                    out.append(row)
            yield pd.DataFrame({"_row": out}, dtype="int64")

    return run


def within_budget(files: DataFrame, per_class: int = PER_CLASS, most: int = MOST_BYTES, order: str = "path") -> DataFrame:
    """files (path, class, size) -> with included: in `order` a file is taken if its class has room and the bytes still fit.

    A file that doesn't fit is passed over and later ones may. What earlier files
    of its class, no larger, fill the class's room with is never taken: if the
    file fitted, they did. So each range of the order first offers what is left,
    then ranges of these offers do, and the rest, which grows with the logarithm
    of the files (with their number only where sizes fall all along), is decided
    in order by one task. Equal places have an order of their own (the row's);
    null is a class like others, a null or too large size fits nowhere.
    """
    rows = checkpointed(files.withColumn("_row", F.monotonically_increasing_id()))
    offers = rows.where(F.col("size") <= most).select(F.col(order).alias("_at"), "_row", "class", F.col("size").cast("long").alias("size"))
    ranges = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        offers = offers.repartitionByRange(ranges, "_at", "_row").sortWithinPartitions("_at", "_row").mapInPandas(_first_fits(per_class), offers.schema)
        if ranges == 1:
            break
        ranges = max(1, ranges // 64)
    chosen = offers.mapInPandas(_taken(per_class, most), "_row long").withColumn("included", F.lit(True))
    return rows.join(chosen, "_row", "left").withColumn("included", F.coalesce("included", F.lit(False))).drop("_row")


def kept_sessions(sessions: DataFrame, now, ttl_seconds: int = 7200, newest: int = 10, by: str = "owner") -> DataFrame:
    """sessions (id, owner, ts) -> those younger than the limit, the newest few of each owner; of equal times the larger id.

    An owner's sessions are first ranked in salted parts, so that a hot owner's
    don't meet before each part has dropped all but its newest.
    """
    live = sessions.where(F.col("ts") > F.lit(now) - F.expr(f"interval {ttl_seconds} seconds"))
    order = [F.desc("ts"), F.desc("id")]
    part = live.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(32)))
    for keys in ([by, "_part"], [by]):
        part = part.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= newest)
    return part.drop("_n", "_part")


def orphan_locks(locks: DataFrame, sessions: DataFrame) -> DataFrame:
    return locks.join(sessions.select("id"), "id", "left_anti")


def edited(text: str, history: list[list], op: dict) -> tuple[str, list[list], str]:
    """One operation on a page: (text, history, outcome); the history is changed in place.

    replace: `old` must be there exactly once; insert: `new` before line `line`,
    clamped; undo: the text before the last change. The history has what takes
    each change back, not the texts: place, old and new text, or the lines that
    came in.
    """
    if op["kind"] == "undo":
        if not history:
            return text, history, "nothing to undo"
        last = history.pop()
        if last[0] == "insert":
            lines = text.split("\n")
            return "\n".join([*lines[: last[1]], *lines[last[1] + last[2] :]]), history, "undone"
        return text[: last[1]] + last[2] + text[last[1] + last[3] :], history, "undone"
    if op["kind"] == "insert":
        lines, new = text.split("\n"), op["new"] or ""
        at = min(max(int(op["line"] or 0), 0), len(lines))
        history.append(["insert", at, new.count("\n") + 1])
        return "\n".join([*lines[:at], new, *lines[at:]]), history, "inserted"
    n = text.count(op["old"]) if op["old"] else 0
    if n != 1:
        return text, history, "not found" if n == 0 else "not unique"
    at, new = text.index(op["old"]), op["new"] or ""
    history.append(["replace", at, op["old"], len(new)])
    return text[:at] + new + text[at + len(op["old"]) :], history, "replaced"


_PAGE = "page string, content string, applied long, undoable long"


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Operations in order, page by page -> a row for each page; a batch's rows are held, not a page's log."""
    page, text, history, done = None, None, [], 0
    row = lambda: pd.DataFrame({"page": [page], "content": [text], "applied": [done], "undoable": [len(history)]})
    for batch in batches:
        for op in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            if text is None or op["page"] != page:
                if text is not None:
                    yield row()
                page, text, history, done = op["page"], "", [], 0
            text, history, outcome = edited(text, history, op)
            done += outcome in ("replaced", "inserted", "undone")
    if text is not None:
        yield row()


def edit_log(operations: DataFrame) -> DataFrame:
    """operations (page, seq, kind, old, new, line) -> page, content, applied, undoable: each page's text after its log.

    Equal numbers go by the operations' other columns; a null page is one, too.
    """
    ordered = operations.select(F.col("page").cast("string"), "seq", "kind", "old", "new", "line").repartition("page").sortWithinPartitions("page", "seq", "kind", "old", "new", "line")
    return ordered.mapInPandas(_folded, _PAGE)
