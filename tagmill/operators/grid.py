"""The two-dimensional grid of tables with spans, and the headers of every cell.

cells: as in tables. Rows are numbered in order; a cell takes the first column of its row
that nothing from the row or from above covers, and covers as many columns and rows as its
spans say (one if they say nothing usable). A band is a run of rows into which no span
from above reaches, so bands are placed apart from each other and a long table is split
among tasks; bands without a span of rows are running sums. Only a band whose rows are
tied by spans goes through a Python fold, a row at a time, which holds the columns that
are still covered and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators import tables
from tagmill.operators.tree import _cut

#: Where a cell lies.
PLACE = ["row", "column"]


def _spanned(cells: DataFrame) -> DataFrame:
    """cells with row (from 0), high and wide."""
    size = lambda name: F.greatest(tables.span(F.trim(F.col(name))), F.lit(1))
    row = F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_id")) - 1
    return cells.withColumns({"row": row.cast("long"), "high": size("rowspan").cast("long"), "wide": size("colspan").cast("long")})


def _bands(cells: DataFrame) -> DataFrame:
    """table_id, row, band, tied: runs of rows that no span from above reaches into; tied if a span ties rows within."""
    rows = cells.groupBy("table_id", "row").agg(F.max(F.col("row") + F.col("high")).alias("reach"), F.max("high").alias("tall"))
    w = Window.partitionBy("table_id").orderBy("row")
    above = F.max("reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumn("begins", F.when(F.coalesce(above, F.lit(0)) <= F.col("row"), 1).otherwise(0))
    banded = cut.withColumn("band", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return banded.withColumn("tied", F.max("tall").over(Window.partitionBy("table_id", "band")) > 1).select("table_id", "row", "band", "tied")


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of bands in order -> their columns; covered maps a column to the row after the last that is covered."""
    at, covered, free = None, {}, 0
    for f in frames:
        columns = []
        for band, row, high, wide in zip(zip(f["table_id"], f["band"], strict=True), f["row"], f["high"], f["wide"], strict=True):
            if at is None or at[0] != band:
                covered, free = {}, 0
            elif at[1] != row:
                covered, free = {c: end for c, end in covered.items() if end > row}, 0
            at = band, row
            while covered.get(free, 0) > row:
                free += 1
            columns.append(free)
            for c in range(free, free + wide):
                covered[c] = max(covered.get(c, 0), row + high)
        yield f[["table_id", "row_id", "col"]].assign(column=pd.Series(columns, index=f.index, dtype="int64"))


def placed(cells: DataFrame) -> DataFrame:
    """cells with row, column (both from 0), high and wide."""
    one = _cut(_spanned(cells))
    banded = _cut(one.join(_bands(one), ["table_id", "row"]))
    before = Window.partitionBy("table_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    flat = banded.where("not tied").withColumn("column", F.coalesce(F.sum("wide").over(before), F.lit(0)))
    key = {n: cells.schema[n].dataType.simpleString() for n in ("table_id", "row_id", "col")}
    tied = banded.where("tied").select(*key, "band", "row", "high", "wide").repartition("table_id", "band").sortWithinPartitions("table_id", "band", "row", "col")
    folded = tied.mapInPandas(_fold, ", ".join(f"{n} {kind}" for n, kind in key.items()) + ", column long")
    woven = banded.where("tied").join(folded, list(key))
    names = [*cells.columns, "row", "column", "high", "wide"]
    return flat.select(*names).unionByName(woven.select(*names))


def relations(cells: DataFrame) -> DataFrame:
    """table_id, row_id, col, attribute, value: the ids of header cells and the headers of data cells, as patches, for tables that need them.

    These are tables with header rows and header columns, with spans or with rows of
    unequal length. A data cell outside header rows is named by the header cells to its
    left in its rows, then by those above in its columns that lie in header rows; a
    header row has more than half header cells, a header column likewise.
    """
    c = F.col
    grid = _cut(placed(cells))
    rows = grid.groupBy("table_id", "row").agg(F.count("*").alias("n"), F.count_if(c("kind") == "TH").alias("heads"), F.max((c("high") > 1) | (c("wide") > 1)).alias("spans"))
    head_rows = rows.where("heads > 0.5 * n").select("table_id", "row")
    covers = F.sequence("column", c("column") + c("wide") - 1)
    columns = grid.select("table_id", "kind", F.explode(covers).alias("x")).groupBy("table_id", "x").agg((F.count_if(c("kind") == "TH") > 0.5 * F.count("*")).alias("head"))
    by_rows = rows.groupBy("table_id").agg(F.bool_or(c("heads") > 0.5 * c("n")).alias("head_row"), F.bool_or("spans").alias("spans"), (F.max("n") != F.min("n")).alias("uneven"))
    need = by_rows.join(columns.groupBy("table_id").agg(F.bool_or("head").alias("head_column")), "table_id").where("head_row and head_column or spans or uneven").select("table_id")
    tied = grid.join(need, "table_id", "left_semi")
    given = F.trim(F.coalesce("cell_id", F.lit("")))
    named = tied.withColumn("name", F.when(given != "", given).otherwise(F.format_string("th_r%d_c%d", "row", "column")))
    ids = named.where(c("kind") == "TH").where(given == "").select("table_id", "row_id", "col", F.lit("id").alias("attribute"), c("name").alias("value"))
    marked = _cut(named.join(head_rows.withColumn("in_head", F.lit(True)), ["table_id", "row"], "left").withColumn("in_head", F.coalesce("in_head", F.lit(False))))
    data = marked.where("kind = 'TD' and not in_head").select("table_id", "row_id", "col", "row", "column", "high", "wide")
    heads = marked.where("kind = 'TH'").select("table_id", "name", c("row").alias("hr"), c("column").alias("hc"), c("high").alias("hh"), c("wide").alias("hw"), "in_head")
    # met through the rows and the columns that both cover, so no cell is compared with all heads
    left = data.withColumn("y", F.explode(F.sequence("row", c("row") + c("high") - 1))).join(heads.withColumn("y", F.explode(F.sequence("hr", c("hr") + c("hh") - 1))), ["table_id", "y"]).where("hc < column").select("table_id", "row_id", "col", F.lit(0).alias("side"), c("hc").alias("first"), c("hr").alias("second"), "name")
    above = data.withColumn("x", F.explode(F.sequence("column", c("column") + c("wide") - 1))).join(heads.where("in_head").withColumn("x", F.explode(F.sequence("hc", c("hc") + c("hw") - 1))), ["table_id", "x"]).where("hr < row").select("table_id", "row_id", "col", F.lit(1).alias("side"), c("hr").alias("first"), c("hc").alias("second"), "name")
    refs = left.unionByName(above).groupBy("table_id", "row_id", "col").agg(F.sort_array(F.collect_set(F.struct("side", "first", "second", "name"))).alias("x"))
    headers = refs.select("table_id", "row_id", "col", F.lit("headers").alias("attribute"), F.array_join(F.array_distinct(F.transform("x", lambda x: x["name"])), " ").alias("value"))
    return ids.unionByName(headers)


def missing_cells(cells: DataFrame) -> DataFrame:
    """table_id, row_id, column, type: the empty cells to add at the end of rows that have less cells than the longest of the table."""
    rows = tables.rows_of(cells)
    most = F.max("cells").over(Window.partitionBy("table_id"))
    return rows.withColumn("most", most).where("cells < most").select("table_id", "row_id", F.explode(F.sequence("cells", F.col("most") - 1)).alias("column"), F.lit("TD").alias("type"))


def header_repairs(cells: DataFrame) -> DataFrame:
    """table_id, row_id, col, old, new: data cells in header rows, and those in header columns of other rows, as header cells."""
    grid = _cut(placed(cells))
    rows = tables.rows_of(cells).where("heads > 0.5 * cells").select("table_id", "row_id", F.lit(True).alias("in_row"))
    columns = grid.select("table_id", "kind", F.explode(F.sequence("column", F.col("column") + F.col("wide") - 1)).alias("column")).groupBy("table_id", "column").agg(F.count_if(F.col("kind") == "TH").alias("heads"), F.count("*").alias("n")).where("heads > 0.5 * n").select("table_id", "column", F.lit(True).alias("in_column"))
    bad = grid.where("kind = 'TD'").join(rows, ["table_id", "row_id"], "left").join(columns, ["table_id", "column"], "left").where("in_row or in_column")
    return bad.select("table_id", "row_id", "col", F.lit("TD").alias("old"), F.lit("TH").alias("new"))
