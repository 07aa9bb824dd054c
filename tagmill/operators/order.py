"""Reading order by columns: the order itself, columns that interleave in the tree, and the fewest moves from one order to another."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators import layout

PAGE = ["doc_id", "page"]


def numbered_columns(bounds: DataFrame) -> DataFrame:
    """bounds (doc_id, page, low, high) with column, from 0 at the left."""
    return bounds.withColumn("column", F.row_number().over(Window.partitionBy(*PAGE).orderBy("low", "high")).cast("long") - 1)


def line_columns(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """doc_id, page, line, column: the column that most boxes of a line lie in; if none lies in any, the one whose middle is nearest to theirs.

    A box lies in the first column that holds it, and in those before that hold more than
    half of its width; the first column wins a tie. lines: boxes with line.
    """
    c = F.col
    wide = c("x1") - c("x0")
    both = lines.join(numbered_columns(bounds), PAGE)
    held = (c("x0") >= c("low")) & (c("x1") <= c("high"))
    overlap = F.greatest(F.least("x1", "high") - F.greatest("x0", "low"), F.lit(0.0))
    first = F.min(F.when(held, c("column"))).over(Window.partitionBy(*PAGE, "elem_id"))
    counted = both.withColumn("held", held).withColumn("until", first).withColumn("counts", (c("until").isNull() | (c("column") <= c("until"))) & (c("held") | ((overlap > 0) & (overlap / wide > 0.5))))
    away = F.abs(F.avg((c("x0") + c("x1")) / 2) - F.first((c("low") + c("high")) / 2))
    sums = counted.groupBy(*PAGE, "line", "column").agg(F.count_if("counts").alias("n"), away.alias("away"))
    best = F.max("n").over(Window.partitionBy(*PAGE, "line"))
    key = F.when(best > 0, -c("n")).otherwise(c("away"))
    return sums.withColumn("key", key).withColumn("k", F.row_number().over(Window.partitionBy(*PAGE, "line").orderBy("key", "column"))).where("k = 1").select(*PAGE, "line", "column")


def column_order(boxes: DataFrame, bounds: DataFrame, tolerance: float | Column = 3.0) -> DataFrame:
    """boxes with line, column and visual: column by column, each from the top, each line from the left."""
    lined = layout.lines(boxes, tolerance)
    placed = lined.join(line_columns(lined, bounds), [*PAGE, "line"])
    top = F.min("y0").over(Window.partitionBy(*PAGE, "line"))
    return placed.withColumn("top", top).withColumn("visual", F.row_number().over(Window.partitionBy(*PAGE).orderBy("column", "top", "line", "x0", "elem_id"))).drop("top")


def interleaved(placed: DataFrame) -> DataFrame:
    """placed (doc_id, page, parent_id, elem_id, place, column) -> elements that come before siblings of the column before theirs.

    One row for each, with how many siblings it precedes and the place after the last of
    them; counted by one window, not pair by pair.
    """
    c = F.col
    own = [*PAGE, "parent_id"]
    views = F.explode(F.array(F.struct((c("column") + 1).alias("meets"), F.lit(True).alias("earlier")), F.struct(c("column").alias("meets"), F.lit(False).alias("earlier")))).alias("v")
    both = placed.select(*own, "elem_id", "place", "column", views).select(*own, "elem_id", "place", "column", "v.*")
    after = Window.partitionBy(*own, "meets").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    seen = both.withColumns({"passed": F.count_if("earlier").over(after), "last": F.max(F.when(c("earlier"), c("place"))).over(after)})
    return seen.where("not earlier and passed > 0").select(*own, "elem_id", "column", c("place").alias("current"), (c("last") + 1).alias("expected"), "passed")


def staying(order: list[int]) -> set[int]:
    """The places of a longest rising run of order, whose members need not be moved."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, x in enumerate(order):
        k = bisect_left(tails, x)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1] = [x]
        ends[k : k + 1] = [i]
    out, i = set(), ends[-1] if ends else -1
    while i >= 0:
        out.add(i)
        i = before[i]
    return out


def moves(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, elem_id, current, wanted) -> by, elem_id, after_id, step: the fewest moves that turn the current order into the wanted one.

    Done in order of step, each element goes right behind after_id (null: to the front).
    Siblings stream through a task in their order; it holds one parent's at a time.
    """
    schema = {n: rows.schema[n].dataType.simpleString() for n in [*by, "elem_id"]}

    def done(key: tuple, ids: list, wanted: list[int]) -> Iterator[tuple]:
        stay, last, step = staying(wanted), None, 0
        for i in sorted(range(len(ids)), key=wanted.__getitem__):
            if i not in stay:
                yield *key, ids[i], last, step
                step += 1
            last = ids[i]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, wanted = None, [], []
        table = lambda out: pd.DataFrame(out, columns=[*schema, "after_id", "step"], dtype=object)
        for f in frames:
            out: list[tuple] = []
            keys = zip(*[[None if x != x else x for x in f[n].tolist()] for n in by], strict=True)
            for k, e, w in zip(keys, f["elem_id"].tolist(), f["wanted"].tolist(), strict=True):
                if k != key:
                    out += done(key, ids, wanted) if ids else []
                    key, ids, wanted = k, [], []
                ids.append(e)
                wanted.append(w)
            yield table(out)
        yield table(list(done(key, ids, wanted)) if ids else [])

    whole = rows.select(*by, "elem_id", "current", "wanted").repartition(*by).sortWithinPartitions(*by, "current", "elem_id")
    return whole.mapInPandas(run, ", ".join(f"{n} {k}" for n, k in schema.items()) + f", after_id {schema['elem_id']}, step long")


def move_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, elements, moved: how many elements a group has and how many of them must move."""
    moved = moves(rows, by).groupBy(*by).agg(F.count("*").alias("moved"))
    return rows.groupBy(*by).agg(F.count("*").alias("elements")).join(moved, by, "left").fillna(0, ["moved"])


def detected_order(boxes: DataFrame) -> DataFrame:
    """boxes (with kind) with line, column and visual: lines by the tolerance of their page, columns by the left margins found on it."""
    near = boxes.join(layout.line_tolerance(boxes), PAGE)
    bounds = layout.detected_columns(boxes).withColumn("low", F.round("low", 6))
    return column_order(near, bounds, F.col("tolerance")).drop("tolerance")
