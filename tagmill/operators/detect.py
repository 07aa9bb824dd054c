"""Tables of untagged pages: from ruled lines and from texts that are aligned. doc_id, page and, within a page, tables numbered from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import geometry as g
from tagmill.operators import layout
from tagmill.operators.tree import _cut

PAGE = ["doc_id", "page"]
TABLE = ["doc_id", "page", "source", "number", "x0", "y0", "x1", "y1", "n_rows", "n_cols"]
CELL = ["doc_id", "page", "source", "number", "row", "col", "x0", "y0", "x1", "y1"]


def rules(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_id, x0, y0, x1, y1) that may rule a table, with across and down: of pages with four lines, those longer than three tenths of the page's mean."""
    c = F.col
    one = lines.withColumn("length", F.greatest(F.abs(c("x0") - c("x1")), F.abs(c("y0") - c("y1"))))
    whole = Window.partitionBy(*PAGE)
    kept = one.withColumn("n", F.count("*").over(whole)).withColumn("mean", F.avg("length").over(whole)).where("n >= 4 and length > 0.3 * mean")
    return kept.withColumn("across", F.abs(c("y0") - c("y1")) < 2).withColumn("down", F.abs(c("x0") - c("x1")) < 2).drop("n", "mean", "length")


def _nearest(points: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """points with the number of the mark (number, mean) nearest to value, the first of equals.

    Marks are sorted, so the nearest is one of the two around a value: those are looked
    up by a window over both, and points aren't joined with all marks of their page.
    """
    both = points.select("*", F.col(value).alias("at"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("double").alias("mean"), F.lit(1).alias("turn"))
    stops = marks.select(*PAGE, *[F.lit(None).cast(points.schema[k].dataType).alias(k) for k in points.columns if k not in PAGE], F.col("mean").alias("at"), "number", "mean", F.lit(0).alias("turn"))
    w = Window.partitionBy(*PAGE).orderBy("at", "turn")
    low, high = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("turn") == 0, F.struct("number", "mean"))
    found = both.unionByName(stops).withColumn("below", F.last(mark, True).over(low)).withColumn("above", F.first(mark, True).over(high)).where("turn = 1")
    at, a, b = F.col("at"), F.col("below"), F.col("above")
    number = F.when(b.isNull() | (at - a["mean"] <= b["mean"] - at), a["number"]).otherwise(b["number"])
    return found.withColumn("near", number).drop("at", "number", "mean", "turn", "below", "above")


def grids(lines: DataFrame, tolerance: float = 5.0, least: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lattice of each page that has one: (doc_id, page, density), its rows and its columns (doc_id, page, number, mean).

    Crossings fold into rows and columns; a page has a lattice if two of each came out and
    half of the places where they meet have a crossing.
    """
    ruled = _cut(rules(lines))
    sides = ruled.groupBy(*PAGE).agg(F.count_if("across").alias("h"), F.count_if("down").alias("v")).where("h >= 2 and v >= 2").select(*PAGE)
    c = F.col
    h = ruled.where("across").join(sides, PAGE, "left_semi").select(*PAGE, c("line_id").alias("h_id"), F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"), c("y0").alias("y"))
    v = ruled.where("down").join(sides, PAGE, "left_semi").select(*PAGE, c("line_id").alias("v_id"), F.least("y0", "y1").alias("y0"), F.greatest("y0", "y1").alias("y1"), c("x0").alias("x"))
    met = layout.crossings(h, v).select(*PAGE, c("x").alias("px"), c("y").alias("py"))
    met = _cut(met)
    many = met.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n >= 4").select(*PAGE)
    points = met.join(many, PAGE, "left_semi")
    marks = lambda value: _cut(layout.anchored_clusters(points, PAGE, value, tolerance).select(*PAGE, c("cluster").cast("long").alias("number"), "mean"))
    rows, columns = marks("py"), marks("px")
    near = _nearest(_nearest(points, rows, "py").withColumnRenamed("near", "row"), columns, "px").withColumnRenamed("near", "col")
    size = lambda m, name: m.groupBy(*PAGE).agg(F.count("*").alias(name))
    full = near.groupBy(*PAGE).agg(F.count_distinct("row", "col").alias("filled")).join(size(rows, "n_rows"), PAGE).join(size(columns, "n_cols"), PAGE)
    found = full.where("n_rows >= 2 and n_cols >= 2").withColumn("density", c("filled") / (c("n_rows") * c("n_cols"))).where(F.col("density") >= least)
    return _cut(found.select(*PAGE, "density")), rows, columns


def ruled_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and their cells between the rows and columns of lattices."""
    found, rows, columns = grids(lines)
    c = F.col
    ends = lambda m, low, high, n: m.groupBy(*PAGE).agg((F.min("mean") - 1).alias(low), (F.max("mean") + 1).alias(high), F.count("*").alias(n))
    tables = found.join(ends(rows, "y0", "y1", "n_rows"), PAGE).join(ends(columns, "x0", "x1", "n_cols"), PAGE).withColumn("source", F.lit("lines")).withColumn("number", F.lit(0).cast("long"))

    def steps(m: DataFrame, at: str, low: str, high: str) -> DataFrame:
        w = Window.partitionBy(*PAGE).orderBy("number")
        return m.join(found, PAGE, "left_semi").select(*PAGE, c("number").alias(at), c("mean").alias(low), F.lead("mean").over(w).alias(high)).where(F.col(high).isNotNull())

    cells = steps(rows, "row", "y0", "y1").join(steps(columns, "col", "x0", "x1"), PAGE).withColumn("source", F.lit("lines")).withColumn("number", F.lit(0).cast("long"))
    return tables.select(*TABLE), cells.select(*CELL)


def aligned_tables(spans: DataFrame, gap: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Tables of texts: spans (doc_id, page, line_id, span_id, x0, y0, x1, y1, text) of lines that follow closely and begin at two columns or more.

    A line belongs to the group of the one before by height if the space between is less
    than one and a half of their mean height; a group has two lines at least.
    """
    c = F.col
    said = F.bool_or(F.trim("text") != "")
    lines = spans.groupBy(*PAGE, "line_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), said.alias("said")).where("said")
    w = Window.partitionBy(*PAGE).orderBy("y0", "line_id")
    height = c("y1") - c("y0")
    close = (c("y0") - F.lag("y1").over(w)) < (height + F.lag(height).over(w)) / 2 * 1.5
    grouped = lines.withColumn("new", F.when(close, 0).otherwise(1)).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = [*PAGE, "block"]
    sized = grouped.withColumn("n", F.count("*").over(Window.partitionBy(*own))).where("n >= 2").withColumn("row", F.row_number().over(Window.partitionBy(*own).orderBy("y0", "line_id")) - 1)
    sized = _cut(sized)
    starts = spans.select(*PAGE, "line_id", c("x0").alias("start")).join(sized.select(*own, "line_id"), [*PAGE, "line_id"])
    marks = layout.anchored_clusters(starts, own, "start", gap).select(*own, "cluster", "mean")
    columns = marks.groupBy(*own).agg(F.count("*").alias("n_cols"), F.transform(F.sort_array(F.collect_list(F.struct("cluster", "mean"))), lambda x: x["mean"]).alias("means")).where("n_cols >= 2")
    boxes = sized.groupBy(*own).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_rows"))
    found = _cut(boxes.join(columns, own)).withColumn("source", F.lit("text")).withColumn("number", F.row_number().over(Window.partitionBy(*PAGE).orderBy("block")).cast("long") - 1)
    edges = F.concat(F.array("x0"), F.col("means"), F.array("x1"))
    pairs = F.arrays_zip(F.slice(edges, F.lit(1), F.col("n_cols") + 1).alias("a"), F.slice(edges, F.lit(2), F.col("n_cols") + 1).alias("b"))
    bounds = found.select(*own, "source", "number", F.posexplode(pairs).alias("col", "p"))
    cells = sized.select(*own, F.col("row").cast("long").alias("row"), c("y0").alias("top"), c("y1").alias("bottom")).join(bounds, own)
    cells = cells.select(*PAGE, "source", "number", "row", F.col("col").cast("long").alias("col"), c("p.a").alias("x0"), c("top").alias("y0"), c("p.b").alias("x1"), c("bottom").alias("y1"))
    return found.select(*TABLE), cells.select(*CELL)


def _covers(least: float) -> Column:
    ratio = g.overlap_area(g.rect("a_"), g.rect("b_")) / F.least(g.area(g.rect("a_")), g.area(g.rect("b_")))
    return (g.area(g.rect("a_")) > 0) & (g.area(g.rect("b_")) > 0) & (ratio > least)


def tables(lines: DataFrame, spans: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Ruled tables, and aligned ones that none of them covers by more than a share of the smaller of the two."""
    ruled, ruled_cells = ruled_tables(lines)
    text, text_cells = aligned_tables(spans)
    side = lambda frame, p, *more: frame.select(*PAGE, *more, *[F.col(x).alias(f"{p}{x}") for x in ("x0", "y0", "x1", "y1")])
    twice = layout.meeting(side(text, "a_", "number"), side(ruled, "b_")).where(_covers(least)).select(*PAGE, "number").distinct()
    fresh, fresh_cells = (x.join(twice, [*PAGE, "number"], "left_anti") for x in (text, text_cells))
    return ruled.unionByName(fresh.select(*TABLE)), ruled_cells.unionByName(fresh_cells.select(*CELL))


def bordered_tables(lines: DataFrame, spans: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, page, kind, x0, y0, x1, y1, n_rows, n_cols, cells, confidence: tables by their borders as drawn, and grids of texts without.

    A page has a bordered table if its lines cross four times and texts within fill half of
    the cells between the distinct heights and sides of its lines. A grid has three rows of
    texts or more (by centres, to the nearest five), of at most three different numbers of
    texts; one that a bordered table covers for more than a share is left out.
    """
    c = F.col
    across = F.abs(c("y1") - c("y0")) < 2
    named = lines.withColumn("across", across).withColumn("down", ~across & (F.abs(c("x1") - c("x0")) < 2))
    h = named.where("across").select(*PAGE, c("line_id").alias("h_id"), F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"), c("y0").alias("y"), c("y1").alias("low"))
    v = named.where("down").select(*PAGE, c("line_id").alias("v_id"), F.least("y0", "y1").alias("y0"), F.greatest("y0", "y1").alias("y1"), c("x0").alias("x"), c("x1").alias("right"))
    met = layout.crossings(h.drop("low"), v.drop("right"), 0.0).groupBy(*PAGE).agg(F.count("*").alias("n")).where("n >= 4").select(*PAGE)
    heights = h.groupBy(*PAGE).agg(F.array_sort(F.collect_set("y")).alias("ys"), F.min("y").alias("ty0"), F.max("low").alias("ty1"))
    sides = v.groupBy(*PAGE).agg(F.array_sort(F.collect_set("x")).alias("xs"), F.min("x").alias("tx0"), F.max("right").alias("tx1"))
    frames = _cut(heights.join(sides, PAGE).join(met, PAGE, "left_semi").where("size(ys) > 1 and size(xs) > 1"))
    table = (c("tx0"), c("ty0"), c("tx1"), c("ty1"))
    cx, cy = g.centre(g.rect())
    inside = spans.join(frames, PAGE).where(g.contained(g.rect(), table, 0.8)).where(cy.between(F.element_at("ys", 1), F.element_at("ys", -1)) & cx.between(F.element_at("xs", 1), F.element_at("xs", -1)))
    filled = inside.groupBy(*PAGE).agg(F.count("*").alias("cells"))
    rows, cols = (F.size("ys") - 1).cast("long"), (F.size("xs") - 1).cast("long")
    bordered = _cut(frames.join(filled, PAGE).where(c("cells") >= rows * cols / 2).select(*PAGE, F.lit("bordered").alias("kind"), *[s.alias(n) for s, n in zip(table, ("x0", "y0", "x1", "y1"), strict=True)], rows.alias("n_rows"), cols.alias("n_cols"), "cells", F.lit(0.8).alias("confidence")))
    line = spans.groupBy(*PAGE, (F.bround(cy / 5) * 5).alias("at")).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    grid = line.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_rows"), F.max("n").alias("n_cols"), F.sum("n").alias("cells"), F.count_distinct("n").alias("kinds")).where("n_rows >= 3 and kinds <= 3 and n_cols >= 2")
    side = lambda frame, p: frame.select(*PAGE, *[c(x).alias(f"{p}{x}") for x in ("x0", "y0", "x1", "y1")])
    twice = side(grid, "a_").join(side(bordered, "b_"), PAGE).where(_covers(least)).select(*PAGE)  # one of each on a page
    bare = grid.join(twice, PAGE, "left_anti").select(*PAGE, F.lit("grid").alias("kind"), "x0", "y0", "x1", "y1", "n_rows", "n_cols", "cells", F.lit(0.6).alias("confidence"))
    return bordered.unionByName(bare)
