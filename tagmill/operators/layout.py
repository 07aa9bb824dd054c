"""Reading order, clustering and spatial joins. boxes: doc_id, page, elem_id, x0, y0, x1, y1. Every join carries doc_id and page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import geometry as g
from tagmill.operators.tree import _cut, dropped, written

PAGE = ["doc_id", "page"]


def paired(boxes: DataFrame) -> DataFrame:
    """Pairs of a page's boxes, each once, with columns a_* and b_*."""
    return _sided(boxes, "a_").join(_sided(boxes, "b_"), PAGE).where("a_elem_id < b_elem_id")


#: Side of the finest cells; a box lies in cells of the first doubling that is no shorter than its longer side.
CELL = 64.0


def _levelled(boxes: DataFrame, p: str) -> DataFrame:
    """Boxes without nulls, with the level of their cells."""
    x0, y0, x1, y1 = g.rect(p)
    side = F.greatest(x1 - x0, y1 - y0, F.lit(CELL))
    return boxes.dropna(subset=[f"{p}{c}" for c in ("x0", "y0", "x1", "y1")]).withColumn(f"{p}level", F.least(F.ceil(F.log2(side / CELL)), F.lit(1100)).cast("int"))


def _celled(boxes: DataFrame, p: str, level: str) -> DataFrame:
    """Each box once for every cell of a level that it touches: four at most, unless it is wider than they are."""
    x0, y0, x1, y1 = g.rect(p)
    s = CELL * F.pow(F.lit(2.0), F.col(level))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / s), F.floor(F.greatest(a, b) / s)))
    return boxes.withColumn("_level", F.col(level)).withColumn("_cx", span(x0, x1)).withColumn("_cy", span(y0, y1))


def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes a_* and b_* of a page that share a point, edges included, each once.

    Cells of doubling sizes stand over each page. The smaller box of a pair is looked up in
    the cells of the larger one's size, so only near boxes meet, and a pair counts in the
    cell that holds the first corner of what both cover. Boxes with a null side meet none.
    """
    a, b = _levelled(a, "a_"), _levelled(b, "b_")
    where = [*PAGE, "_level", "_cx", "_cy"]
    s = CELL * F.pow(F.lit(2.0), F.col("_level"))
    first = (F.floor(F.greatest("a_x0", "b_x0") / s) == F.col("_cx")) & (F.floor(F.greatest("a_y0", "b_y0") / s) == F.col("_cy"))

    def looked_up(small: DataFrame, p: str, large: DataFrame, q: str, fits: Column) -> DataFrame:
        levels = large.select(*PAGE, F.col(f"{q}level").alias("_up")).distinct()
        asked = _celled(small.join(levels, PAGE).where(fits), p, "_up").drop("_up")
        return asked.join(_celled(large, q, f"{q}level"), where).where(first & g.touching(g.rect("a_"), g.rect("b_")))

    up, down = looked_up(a, "a_", b, "b_", F.col("a_level") <= F.col("_up")), looked_up(b, "b_", a, "a_", F.col("b_level") < F.col("_up"))
    return up.unionByName(down).drop("_level", "_cx", "_cy", "a_level", "b_level")


def _sided(boxes: DataFrame, p: str) -> DataFrame:
    return boxes.select(*PAGE, *[F.col(c).alias(f"{p}{c}") for c in ("elem_id", "x0", "y0", "x1", "y1")])


def overlaps(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of a page's boxes, each once, whose overlap is at least a share, above 0, of the smaller one's area."""
    if least <= 0:
        raise ValueError("every pair of a page overlaps by 0 or more; see paired")
    solid = boxes.where("x1 > x0 and y1 > y0")
    ratio = g.overlap_ratio(g.rect("a_"), g.rect("b_"))
    return meeting(_sided(solid, "a_"), _sided(solid, "b_")).where("a_elem_id < b_elem_id").withColumn("ratio", ratio).where(F.col("ratio") >= least)


def lines(boxes: DataFrame, tolerance: float | Column) -> DataFrame:
    """Numbered lines: a box begins one if it starts below all before it by more than tolerance."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "elem_id")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("y0") > reach + tolerance), 1).otherwise(0)
    return boxes.withColumn("_new", new).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def reading_order(boxes: DataFrame, tolerance: float = 3.0) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("line", "x0", "elem_id")
    return lines(boxes, tolerance).withColumn("visual", F.row_number().over(w))


def displaced(boxes: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Boxes (with pre_order) whose place in the tree is off their place on the page: by more than 1 a warning, by more than 3 an error."""
    tree = F.row_number().over(Window.partitionBy(*PAGE).orderBy("pre_order", "elem_id"))
    out = reading_order(boxes, tolerance).withColumn("current", tree).withColumn("off", F.abs(F.col("current") - F.col("visual")))
    return out.where("off > 1").withColumn("severity", F.when(F.col("off") > 3, "error").otherwise("warning"))


def chained_clusters(values: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """A value joins the cluster of the one before it if it lies less than gap above."""
    w = Window.partitionBy(*by).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) < gap, 0).otherwise(1)
    return values.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).groupBy(*by, "cluster").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("members"))


def _opened(first: Column) -> Column:
    """The state of a fold into runs: those done, and the open one, which alone is copied when it grows."""
    return F.struct(F.slice(F.array(first), F.lit(1), F.lit(0)).alias("done"), first.alias("last"))


def _folded(state: Column, joins: Column, grown: Column, new: Column) -> Column:
    done = F.when(joins, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"])))
    return F.struct(done.alias("done"), F.when(joins, grown).otherwise(new).alias("last"))


def _closed(state: Column) -> Column:
    return F.concat(state["done"], F.array(state["last"]))


def anchored_clusters(values: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """A value joins the cluster whose first value lies less than gap below; the centre is the mean.

    The anchor of a cluster depends on all before it, so the sorted values of a group
    fold into (anchor, sum, count) runs; the open one is kept apart from those done.
    """
    ordered = values.groupBy(*by).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("v"))
    run = lambda x: F.struct(x.alias("anchor"), x.alias("total"), F.lit(1).alias("n"))

    def fold(state, x):
        last = state["last"]
        grown = F.struct(last["anchor"].alias("anchor"), (last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))
        return _folded(state, x - last["anchor"] < gap, grown, run(x))

    runs = F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), _opened(run(F.element_at("v", 1))), fold, _closed)
    return ordered.select(*by, F.posexplode(runs).alias("cluster", "r")).select(*by, "cluster", F.col("r.anchor").alias("anchor"), (F.col("r.total") / F.col("r.n")).alias("mean"), F.col("r.n").alias("members"))


def mean_lines(boxes: DataFrame, factor: float = 1.2) -> DataFrame:
    """Lines folded from the top: a box joins while its centre lies within factor mean heights of the page of the mean centre so far."""
    box = F.struct("y0", "elem_id", ((F.col("y0") + F.col("y1")) / 2).alias("centre"))
    pages = boxes.groupBy(*PAGE).agg(F.transform(F.sort_array(F.collect_list(box)), lambda x: x["centre"]).alias("v"), (F.avg(F.col("y1") - F.col("y0")) * factor).alias("reach"))
    line = lambda total, n: F.struct(total.alias("total"), n.alias("n"))

    def fold(state, x):
        last = state["last"]
        return _folded(state, F.abs(x - last["total"] / last["n"]) <= F.col("reach"), line(last["total"] + x, last["n"] + 1), line(x, F.lit(1)))

    found = F.aggregate(F.slice("v", F.lit(2), F.size("v")), _opened(line(F.element_at("v", 1), F.lit(1))), fold, _closed)
    return pages.select(*PAGE, F.posexplode(found).alias("line", "r")).select(*PAGE, "line", (F.col("r.total") / F.col("r.n")).alias("mean"), F.col("r.n").alias("members"))


def _leaders(x: pa.Array, y: pa.Array, reach: float) -> pa.Array:
    """For points in their order, a list for each page, the place of the first leader less than reach away, else their own, as such points lead.

    Each round takes the first point of every page that has no leader yet; what is near to
    it has none before it.
    """
    sizes = np.asarray(pc.list_value_length(x))
    starts = np.cumsum(sizes) - sizes
    px, py = (pc.cast(v.flatten(), "double").to_numpy(zero_copy_only=False) for v in (x, y))
    page, out = np.repeat(np.arange(len(sizes)), sizes), np.empty(len(px), dtype=np.int32)
    left = np.arange(len(px))
    while len(left):
        first = np.r_[True, page[left][1:] != page[left][:-1]]
        lead = left[first][np.cumsum(first) - 1]
        dx, dy = px[lead] - px[left], py[lead] - py[left]
        near = (lead == left) | (dx * dx + dy * dy < reach * reach)
        out[left[near]] = lead[near] - starts[page[lead[near]]]
        left = left[~near]
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(px)], pa.int32()), pa.array(out))


def color_legends(elements: DataFrame, reach: float = 100.0, near: float = 30.0, least: int = 3) -> DataFrame:
    """Groups of coloured boxes that may be a legend without words.

    elements are boxes with kind and color. In order of elem_id a box joins the first
    leader with a centre less than reach away, or leads a group of its own. A group
    counts if it has least boxes and colours and no text's centre lies less than near
    from any of theirs. A page's boxes, shuffled once, find their leaders by rounds over
    many pages at a time. Only centres of groups that are large enough look for texts.
    """
    c = F.col
    placed = elements.select(*PAGE, "elem_id", "kind", "color", "x0", "y0", "x1", "y1", ((c("x0") + c("x1")) / 2).alias("x"), ((c("y0") + c("y1")) / 2).alias("y"))
    boxes = placed.where("kind <> 'text' and color is not null")
    square = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])
    pages = boxes.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("elem_id", "x", "y", "color", "x0", "y0", "x1", "y1"))).alias("v"))

    def leaders(x: pa.Array, y: pa.Array) -> pa.Array:
        return _leaders(x, y, reach)

    places = F.arrow_udf(leaders, "array<int>")(*[F.transform("v", lambda p: p[name].cast("double")) for name in ("x", "y")])  # noqa: B023 - used at once
    legends = pages.withColumn("at", places).select(*PAGE, "v", F.transform("at", lambda k: F.get("v", k)["elem_id"]).alias("legend"))
    led = legends.select(*PAGE, F.explode(F.arrays_zip("v", "legend")).alias("z")).select(*PAGE, c("z.v").alias("p"), c("z.legend").alias("legend"))
    groups = led.groupBy(*PAGE, "legend").agg(F.count("*").alias("members"), F.size(F.collect_set("p.color")).cast("long").alias("colours"), *[f(f"p.{k}").alias(k) for f, k in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.collect_list(F.struct("p.x", "p.y")).alias("centres"))
    groups = _cut(groups.where((c("members") >= least) & (c("colours") >= least)))
    cell = lambda v: F.floor(v / (2 * near))
    both = lambda name: F.explode(F.array_distinct(F.array(cell(c("q")[name] - near), cell(c("q")[name] + near))))
    texts = placed.where("kind = 'text'").select(*PAGE, F.struct("x", "y").alias("q")).withColumn("cx", both("x")).withColumn("cy", both("y"))
    asked = groups.select(*PAGE, "legend", F.explode("centres").alias("p")).withColumn("cx", cell(c("p")["x"])).withColumn("cy", cell(c("p")["y"]))
    told = asked.join(texts, [*PAGE, "cx", "cy"]).where(square(c("p"), c("q")) < near * near).select(*PAGE, "legend").distinct()
    return groups.drop("centres").join(told, [*PAGE, "legend"], "left_anti")


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """For each box of points the nearest of targets on its page, but not itself; the smaller id wins a tie.

    Rings that double: each box looks for targets within a reach, at first the mean space
    between a page's targets, through the cells of meeting(); what is found within the reach
    is nearest, and boxes that found nothing so near look twice as far. So a page is never
    compared with itself, and a round is one join of near boxes.
    """
    b = _cut(_sided(targets, "b_").dropna(subset=["b_x0", "b_y0", "b_x1", "b_y1"]))
    c = F.col
    pages = b.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sqrt((F.max("b_x1") - F.min("b_x0")) * (F.max("b_y1") - F.min("b_y0")) / F.count("*")).alias("space"))
    own = b.select(*PAGE, c("b_elem_id").alias("elem_id"), F.lit(1).alias("self"))
    left = points.select(*PAGE, "elem_id", *[c(k).alias(f"p_{k}") for k in ("x0", "y0", "x1", "y1")]).dropna(subset=["p_x0", "p_y0", "p_x1", "p_y1"])
    left = left.join(pages, PAGE).join(own, [*PAGE, "elem_id"], "left").where(c("n") > F.coalesce("self", F.lit(0)))
    left, path = written(left.withColumn("reach", F.greatest("space", F.lit(1.0))).drop("n", "space", "self"))
    out = None
    while out is None or not left.isEmpty():
        sides = {"a_x0": c("p_x0") - c("reach"), "a_y0": c("p_y0") - c("reach"), "a_x1": c("p_x1") + c("reach"), "a_y1": c("p_y1") + c("reach")}
        met = meeting(left.withColumns(sides), b).where("elem_id <> b_elem_id")
        pick = F.min(F.struct(g.distance(g.rect("p_"), g.rect("b_")).alias("distance"), c("b_elem_id").alias("near_id"))).alias("best")
        found = _cut(met.groupBy(*PAGE, "elem_id", "reach").agg(pick).where("best.distance <= reach").select(*PAGE, "elem_id", "best.near_id", "best.distance"))
        out = found if out is None else out.unionByName(found)
        done = path
        left, path = written(left.join(found, [*PAGE, "elem_id"], "left_anti").withColumn("reach", c("reach") * 2))
        dropped(points.sparkSession, done)
    return out


def near_content(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, page, elem_id, text, near_id, distance: what texts (boxes with text) an annotation covers, in their order; where it covers none, the nearest text."""
    a, b = _sided(annotations, "a_"), _sided(texts, "b_")
    words = texts.select(*PAGE, F.col("elem_id").alias("b_elem_id"), "text")
    said = meeting(a, b).join(words, [*PAGE, "b_elem_id"]).groupBy(*PAGE, F.col("a_elem_id").alias("elem_id")).agg(F.sort_array(F.collect_list(F.struct("b_elem_id", "text"))).alias("x"))
    covered = _cut(said.select(*PAGE, "elem_id", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"), F.col("x")[0]["b_elem_id"].alias("near_id"), F.lit(0.0).alias("distance")))
    alone = annotations.join(covered, [*PAGE, "elem_id"], "left_anti")
    # texts and annotations may share ids, but no annotation is its own nearest text
    near = nearest(alone.withColumn("elem_id", -F.col("elem_id") - 1), texts).withColumn("elem_id", -F.col("elem_id") - 1)
    return covered.unionByName(near.join(texts.select(*PAGE, F.col("elem_id").alias("near_id"), "text"), [*PAGE, "near_id"]).select(*covered.columns))


def hit(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """For points (doc_id, page, point_id, x, y) the smallest box that holds them."""
    at = points.select(*PAGE, "point_id", *[F.col(c[0]).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = meeting(at, _sided(boxes, "b_"))
    pick = F.min(F.struct(g.area(g.rect("b_")).alias("area"), F.col("b_elem_id").alias("elem_id"))).alias("best")
    return inside.groupBy(*PAGE, "point_id").agg(pick).select(*PAGE, "point_id", "best.elem_id", "best.area")


def columns_of(boxes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Boxes with the column (doc_id, page, column, low, high) that holds their centre, both ends included."""
    centre = (F.col("x0") + F.col("x1")) / 2
    return boxes.withColumn("cx", centre).join(bounds, PAGE).where("cx between low and high")


def crossings(across: DataFrame, down: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Where horizontal lines (h_id, x0, x1, y) meet vertical ones (v_id, y0, y1, x)."""
    x, y = F.col("x"), F.col("y")
    a = across.select("*", (F.col("x0") - tolerance).alias("a_x0"), y.alias("a_y0"), (F.col("x1") + tolerance).alias("a_x1"), y.alias("a_y1")).where("a_x0 <= a_x1")
    b = down.select("*", x.alias("b_x0"), (F.col("y0") - tolerance).alias("b_y0"), x.alias("b_x1"), (F.col("y1") + tolerance).alias("b_y1")).where("b_y0 <= b_y1")
    return meeting(a, b).drop(*[f"{p}_{c}" for p in "ab" for c in ("x0", "y0", "x1", "y1")])


def grown_blocks(boxes: DataFrame, gap: float) -> DataFrame:
    """Boxes with the block that they belong to: boxes nearer than gap, and what is near to those; a block is named by its first box."""

    def page_blocks(v: np.ndarray) -> list[int]:
        label = list(range(len(v)))

        def top(i: int) -> int:
            while label[i] != i:
                i = label[i]
            return i

        for i in range(1, len(v)):
            dx = np.maximum(v[:i, 0] - v[i, 2], 0) + np.maximum(v[i, 0] - v[:i, 2], 0)
            dy = np.maximum(v[:i, 1] - v[i, 3], 0) + np.maximum(v[i, 1] - v[:i, 3], 0)
            for j in np.flatnonzero((dx <= gap) & (dy <= gap)).tolist():
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
        return [top(i) for i in range(len(v))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of the last page so far, which the next batch may go on with
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            keys = frame[PAGE].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            held = frame.iloc[starts[-1] :]
            yield done(frame, starts)
        if held is not None and len(held):
            yield done(held.reset_index(drop=True), np.array([0, len(held)]))

    def done(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v, ids = frame[["x0", "y0", "x1", "y1"]].to_numpy(), frame["elem_id"].to_numpy()
        block = [ids[a + k] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for k in page_blocks(v[a:b])]
        return frame.iloc[: starts[-1]][[*PAGE, "elem_id"]].assign(block=np.array(block, np.int64))

    whole = boxes.repartition(*PAGE).sortWithinPartitions(*PAGE, "y0", "x0", "elem_id")
    return whole.select(*PAGE, "elem_id", "x0", "y0", "x1", "y1").mapInPandas(run, "doc_id long, page long, elem_id long, block long")


def line_tolerance(boxes: DataFrame) -> DataFrame:
    """doc_id, page, tolerance: two thirds of the mean height of the texts (boxes with kind), 3 at least, 10 without any."""
    height = F.when((F.col("kind") == "text") & (F.col("y1") > F.col("y0")), F.col("y1") - F.col("y0"))
    return boxes.groupBy(*PAGE).agg(F.coalesce(F.greatest(F.lit(3.0), F.avg(height) * 0.67), F.lit(10.0)).alias("tolerance"))


def detected_columns(boxes: DataFrame, gap: float = 20.0) -> DataFrame:
    """doc_id, page, low, high of the columns of texts: left margins fold into groups, a column runs to the widest box that begins near its mean.

    With one group, or no column wider than gap, the texts' whole width is the one column.
    """
    marks = anchored_clusters(boxes, PAGE, "x0", gap).select(*PAGE, "cluster", F.col("mean").alias("low"))
    near = boxes.join(marks, PAGE).where(F.abs(F.col("x0") - F.col("low")) < gap).groupBy(*PAGE, "cluster", "low").agg(F.max("x1").alias("high")).where(F.col("high") - F.col("low") > gap)
    many = marks.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n > 1")
    found = near.join(many, PAGE, "left_semi").select(*PAGE, "low", "high")
    whole = boxes.groupBy(*PAGE).agg(F.min("x0").alias("low"), F.max("x1").alias("high")).join(found, PAGE, "left_anti")
    return found.unionByName(whole)
