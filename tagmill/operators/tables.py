"""Rules over tables. cells: table_id, row_id, col (order in the row), kind TH or TD, colspan and rowspan as text, scope, cell_id, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators import closure
from tagmill.operators.tree import _cut


def rows_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id", "row_id").agg(F.count("*").alias("cells"), F.count_if(F.col("kind") == "TH").alias("heads"))


def shape(cells: DataFrame) -> DataFrame:
    """Rows, columns, header rows (more than half TH), cells with a span, and whether the table is complex."""
    spans = F.count_if(_given("colspan") | _given("rowspan"))
    rows = cells.groupBy("table_id", "row_id").agg(F.count("*").alias("cells"), F.count_if(F.col("kind") == "TH").alias("heads"), spans.alias("spans"))
    out = rows.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.max("cells").alias("max_cols"), F.min("cells").alias("min_cols"), F.count_if(F.col("heads") > 0.5 * F.col("cells")).alias("header_rows"), F.sum("spans").alias("spans"))
    return out.withColumn("complex", _complex())


def _complex() -> Column:
    return ((F.col("n_rows") > 3) & (F.col("max_cols") > 3)) | (F.col("header_rows") > 1) | (F.col("spans") > 0)


def _given(name: str) -> Column:
    """Whether an attribute is there and not empty."""
    return F.coalesce(F.col(name), F.lit("")) != ""


def ragged(cells: DataFrame) -> DataFrame:
    return shape(cells).where("max_cols - min_cols > 1")


def row_outliers(cells: DataFrame) -> DataFrame:
    """Rows whose number of cells isn't the table's most common one; the one seen first wins a tie."""
    rows = rows_of(cells)
    sizes = rows.groupBy("table_id", "cells").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    best = sizes.withColumn("k", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("n"), "first"))).where("k = 1")
    return rows.join(best.select("table_id", F.col("cells").alias("mode")), "table_id").where("cells <> mode").select("table_id", "row_id", "cells", "mode")


def span(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(1))


def occupied(cells: DataFrame) -> DataFrame:
    """One row for each column that a cell covers, columns counted with the spans before it."""
    before = Window.partitionBy("table_id", "row_id").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    width = F.greatest(span(F.col("colspan")), F.lit(1))
    start = F.coalesce(F.sum(width).over(before), F.lit(0))
    return cells.withColumn("start", start).withColumn("column", F.explode(F.sequence(F.col("start"), F.col("start") + width - 1)))


def header_columns(cells: DataFrame) -> DataFrame:
    by = occupied(cells).groupBy("table_id", "column").agg(F.count("*").alias("cells"), F.count_if(F.col("kind") == "TH").alias("heads"))
    return by.where("heads > 0.5 * cells")


def dangling_headers(cells: DataFrame) -> DataFrame:
    """References of headers to ids that the table doesn't hold."""
    refs = cells.select("table_id", "cell_id", F.explode(F.filter(F.split("headers", r"\s+"), lambda x: x != "")).alias("ref"))
    ids = cells.where("cell_id <> ''").select("table_id", F.col("cell_id").alias("ref"))
    return refs.join(ids, ["table_id", "ref"], "left_anti")


def span_problem(value: Column, most: Column) -> Column:
    n = F.trim(value).try_cast("int")
    return F.when(n.isNull(), "not a number").when(n <= 0, "not positive").when(n > most, "too wide")


def bad_spans(cells: DataFrame) -> DataFrame:
    """Spans that are given but aren't whole numbers from 1 to the table's columns or rows: one row for each, with the attribute's name."""
    size = shape(cells).select("table_id", "n_rows", "max_cols")
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("span"), F.col(name).alias("value"), F.col(most).alias("most")) for name, most in (("colspan", "max_cols"), ("rowspan", "n_rows"))])).alias("x")
    problem = span_problem(F.col("value"), F.col("most"))
    given = cells.where(_given("colspan") | _given("rowspan"))
    return given.join(size, "table_id").select("*", one).select("*", "x.*").drop("x").where(_given("value")).withColumn("problem", problem).where("problem is not null")


#: Legal scopes.
SCOPES = ["Row", "Col", "Column", "Both", "Rowgroup", "Colgroup"]


def uses_ids(cells: DataFrame) -> DataFrame:
    """table_id and whether its cells are tied by headers and ids."""
    return cells.groupBy("table_id").agg(F.bool_or(_given("headers") | _given("cell_id")).alias("by_id"))


def in_tables(cells: DataFrame) -> DataFrame:
    """cells with what shape() and uses_ids() say of their tables, and heads, full and at (1 for one cell of each table); they are shuffled once, and no table is a row."""
    c = F.col
    row, table = Window.partitionBy("table_id", "row_id"), Window.partitionBy("table_id")
    head = c("kind") == "TH"
    rows = cells.where("table_id is not null").repartition("table_id").withColumns({"_cells": F.count("*").over(row), "_heads": F.count_if(head).over(row), "_nth": F.row_number().over(row.orderBy("row_id"))})
    first = c("_nth") == 1
    sums = {
        "n_rows": F.count_if(first),
        "max_cols": F.max("_cells"),
        "min_cols": F.min("_cells"),
        "header_rows": F.count_if(first & (c("_heads") > 0.5 * c("_cells"))),
        "spans": F.count_if(_given("colspan") | _given("rowspan")),
        "by_id": F.bool_or(_given("headers") | _given("cell_id")),
        "heads": F.count_if(head),
        "full": F.count_if("filled"),
    }
    out = rows.withColumns({k: f.over(table) for k, f in sums.items()} | {"at": F.row_number().over(table.orderBy("row_id"))})
    return out.drop("_cells", "_heads", "_nth").withColumn("complex", _complex())


def bad_scopes(cells: DataFrame) -> DataFrame:
    """Header cells without a legal scope, of tables without headers and ids; suggested is Col in tables with more rows than columns, else Row."""
    tall = shape(cells).select("table_id", F.when(F.col("n_rows") > F.col("max_cols"), "Col").otherwise("Row").alias("suggested"))
    scope = F.trim(F.coalesce("scope", F.lit("")))
    bad = cells.where("kind = 'TH'").withColumn("problem", F.when(scope == "", "missing").when(~scope.isin(SCOPES), "unknown")).where("problem is not null")
    return bad.join(uses_ids(cells).where("not by_id"), "table_id", "left_semi").join(tall, "table_id")


def repaired_scopes(cells: DataFrame) -> DataFrame:
    """The scope to write to header cells without one, of tables without headers: Column in the first row and in header rows, Row in header columns, else Both."""
    first = F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_id"))
    rows = rows_of(cells).select("table_id", "row_id", (first == 1).alias("first_row"), (F.col("heads") > 0.5 * F.col("cells")).alias("header_row"))
    columns = header_columns(cells).select("table_id", (F.col("column") + 1).alias("col"), F.lit(True).alias("header_column"))
    tied = cells.groupBy("table_id").agg(F.bool_or(_given("headers")).alias("tied")).where("not tied")
    th = cells.where("kind = 'TH'").where(~_given("scope")).join(tied, "table_id", "left_semi")
    value = F.when(F.col("first_row") | F.col("header_row"), "Column").when(F.coalesce("header_column", F.lit(False)), "Row").otherwise("Both")
    return th.join(rows, ["table_id", "row_id"]).join(columns, ["table_id", "col"], "left").withColumn("suggested", value)


#: Places of the sections; rows outside of them count as body.
SECTION_RANK = {"THead": 0, "TBody": 1, "TFoot": 2}


def row_order(rows: DataFrame) -> DataFrame:
    """Rows (table_id, row_id, pre_order, section, y0, y1) whose place in the tree differs from that by section and height, both from 0.

    Rows without a position have a place in the tree, but none is expected of them.
    """
    rank = F.lit(1)
    for section, place in SECTION_RANK.items():
        rank = F.when(F.col("section") == section, place).otherwise(rank)
    centre = (F.col("y0") + F.col("y1")) / 2
    current = F.row_number().over(Window.partitionBy("table_id").orderBy("pre_order", "row_id")) - 1
    placed = rows.withColumn("current", current).withColumn("_centre", centre).where("_centre is not null")
    expected = F.row_number().over(Window.partitionBy("table_id").orderBy(rank, "_centre", "current")) - 1
    return placed.withColumn("expected", expected).where("current <> expected").drop("_centre")


#: What may stand right below a table.
TABLE_CHILDREN = ["TR", "THead", "TBody", "TFoot", "Caption"]


def child_patches(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, node_id, parent_id, type) -> doc_id, node_id, action: what isn't allowed right below a table but holds something becomes a cell; a table without anything gets a row with one."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    parents = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    bad = nodes.where(~F.col("type").isin(TABLE_CHILDREN)).join(up, ["doc_id", "parent_id"]).where("parent_type = 'Table'").join(parents, ["doc_id", "node_id"], "left_semi")
    bare = nodes.where("type = 'Table'").join(parents, ["doc_id", "node_id"], "left_anti")
    return bad.select("doc_id", "node_id", F.lit("set type TD").alias("action")).unionByName(bare.select("doc_id", "node_id", F.lit("add TR > TD").alias("action")))


def repeated_heads(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, node_id, parent_id, type, page) -> doc_id, table_id, node_id, page: heads of tables over several pages that stand on a page after the first, so repeat those before.

    A head is a THead, or a row with more header cells than others.
    """
    c = F.col
    nodes = _cut(nodes.select("doc_id", "node_id", "parent_id", "type", "page"))
    lines = closure.ancestors(nodes)
    of_tables = nodes.where("type = 'Table'").select("doc_id", c("node_id").alias("above"))
    below = _cut(lines.join(of_tables, ["doc_id", "above"]).select("doc_id", c("above").alias("table_id"), "node_id"))
    pages = below.join(nodes.where("page is not null").select("doc_id", "node_id", "page"), ["doc_id", "node_id"]).groupBy("doc_id", "table_id").agg(F.min("page").alias("first"), F.count_distinct("page").alias("n")).where("n > 1")
    cells = nodes.where("type in ('TH', 'TD')").groupBy("doc_id", c("parent_id").alias("node_id")).agg((F.count_if(c("type") == "TH") > 0.5 * F.count("*")).alias("head"))
    heads = nodes.join(cells, ["doc_id", "node_id"], "left").where("page is not null and (type = 'THead' or (type = 'TR' and head))").select("doc_id", "node_id", "page")
    return heads.join(below, ["doc_id", "node_id"]).join(pages, ["doc_id", "table_id"]).where("page <> first").select("doc_id", "table_id", "node_id", "page")
