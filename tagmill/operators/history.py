"""Undo and redo over a log of events, and the values of a tree as of any event.

events: doc_id, seq, kind (edit, undo, redo, apply, revert). A state is named by the edit
that made it, 0 at first; an edit keeps the state before it for undo, at most LEVELS of
them, and cuts what could be redone; apply makes the state the original and forgets both,
if anything was done since; revert goes back to the original. A document's events stream through a task in their
order, which holds the states that can be undone or redone and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators import closure

#: Fixed value: states that are kept for undo.
LEVELS = 50


def states(events: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, seq, kind, state (after the event), before, done (whether the event did anything), undos and redos that are left."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, state, original, modified = None, 0, 0, False
        undo: list[int] = []
        redo: list[int] = []
        for f in frames:
            out = []
            for doc_id, seq, kind in zip(f["doc_id"].tolist(), f["seq"].tolist(), f["kind"].tolist(), strict=True):
                if doc_id != doc:
                    doc, state, original, modified, undo, redo = doc_id, 0, 0, False, [], []
                before, done = state, True
                if kind == "edit":
                    undo.append(state)
                    del undo[: max(0, len(undo) - levels)]
                    redo.clear()
                    state = seq
                elif kind == "undo" and undo:
                    redo.append(state)
                    state = undo.pop()
                elif kind == "redo" and redo:
                    undo.append(state)
                    state = redo.pop()
                elif kind == "apply" and modified:
                    original = state
                    undo.clear()
                    redo.clear()
                elif kind == "revert":
                    state = original
                    undo.clear()
                    redo.clear()
                else:
                    done = False
                modified = kind not in ("apply", "revert") if done else modified
                out.append((doc_id, seq, kind, state, before, done, len(undo), len(redo)))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "kind", "state", "before", "done", "undos", "redos"])

    whole = events.select("doc_id", F.col("seq").cast("long").alias("seq"), "kind").repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return whole.mapInPandas(run, f"doc_id {events.schema['doc_id'].dataType.simpleString()}, seq long, kind string, state long, before long, done boolean, undos long, redos long")


def values_after(edits: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, seq, node_id, column, value: what holds after each of wanted (doc_id, seq).

    edits: doc_id, seq, node_id, column, value; known: states(). The edits of a state are
    those on the line from it back to the original, and the latest of a value counts.
    """
    line = known.where("kind = 'edit'").select("doc_id", F.col("seq").alias("node_id"), F.when(F.col("before") > 0, F.col("before")).alias("parent_id"))
    applied = closure.ancestors(line).select("doc_id", F.col("node_id").alias("state"), F.col("above").alias("made"))
    asked = wanted.join(known.select("doc_id", "seq", "state"), ["doc_id", "seq"])
    values = edits.select("doc_id", F.col("seq").alias("made"), "node_id", "column", "value")
    found = asked.join(applied, ["doc_id", "state"]).join(values, ["doc_id", "made"])
    last = F.row_number().over(Window.partitionBy("doc_id", "seq", "node_id", "column").orderBy(F.desc("made")))
    return found.withColumn("k", last).where("k = 1").select("doc_id", "seq", "node_id", "column", "value")
