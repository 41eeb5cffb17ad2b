"""The edit log as a stream: each page's text and undo history are its state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import edited

_OUT = "page string, content string, applied long, undoable long"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, history, done = (state.get[0], json.loads(state.get[1]), state.get[2]) if state.exists else ("", [], 0)
    rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
    for op in rows.to_dict("records"):
        text, history, outcome = edited(text, history, op)
        done += outcome in ("replaced", "inserted", "undone")
    state.update((text, json.dumps(history), done))
    yield pd.DataFrame({"page": [key[0]], "content": [text], "applied": [done], "undoable": [len(history)]})


def edit_stream(operations: DataFrame) -> DataFrame:
    """A stream of operations (page, seq, kind, old, new, line) -> each changed page's text after every batch, in update mode."""
    return operations.groupBy("page").applyInPandasWithState(_step, _OUT, "content string, history string, applied long", "update", GroupStateTimeout.NoTimeout)
