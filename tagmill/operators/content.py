"""The text of elements, from the leaves up.

nodes: doc_id, node_id, parent_id, place (among its parent's content), type, page, actual,
alt, expansion. items: the content that is no element, as doc_id, node_id, place, text or
mcid. spans: doc_id, page, mcid, seq, text, what is drawn with each mark.

An element says its replacement text; a figure else its description; else its expansion;
else what its content says, in order: strings, the marked text of its own page, and its
child elements by the same rule, marks looked up on the page of the element that is asked.
So each piece of content climbs to every element above it, up to below the first that says
something of its own, which then climbs in its stead. One text is as long as what stands
below its element; nothing larger meets in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.operators import closure
from tagmill.operators.tree import _cut, dropped, written

#: Types whose text becomes a leaf of its own if they hold no element.
LEAFY = ["P", "Span", "H1", "H2", "H3", "H4", "H5", "H6", "TH", "TD", "LI"]


def marked_texts(spans: DataFrame) -> DataFrame:
    """doc_id, page, mcid, text: the spans of a mark in their order, with a blank between."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return spans.where("mcid >= 0").groupBy("doc_id", "page", "mcid").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def _said() -> Column:
    """What an element says of its own, null if nothing."""
    given = lambda name: F.when(t.stripped(F.coalesce(F.col(name), F.lit(""))) != "", F.col(name))
    return F.coalesce(given("actual"), F.when(F.col("type") == "Figure", given("alt")), given("expansion"))


def pages_of(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, page: the own page, else that of the nearest element above with one, else the first."""
    found = closure.inherited(lines, nodes, "page")
    return nodes.select("doc_id", "node_id").join(found, ["doc_id", "node_id"], "left").fillna(0, ["page"])


def element_texts(nodes: DataFrame, items: DataFrame, spans: DataFrame, lines: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """doc_id, node_id, page, text of every element; white space is folded, and what says nothing is empty. nodes are read often; lines are their ancestors() and paths their places(), if they are known."""
    if lines is None:
        nodes = _cut(nodes)
        lines = closure.ancestors(nodes)
    own = nodes.select("doc_id", "node_id", _said().alias("said")).where("said is not null")
    paths_at = []
    if paths is None:
        paths, at = written(closure.places(lines, nodes))
        paths_at = [at]
    pages = _cut(pages_of(lines, nodes))
    climbs, climbs_at = written(closure.below_stops(lines, own).select("doc_id", "node_id", "above"))
    loose = items.join(own, ["doc_id", "node_id"], "left_anti")
    pieces = (
        loose.join(paths, ["doc_id", "node_id"])
        .select("doc_id", "node_id", F.concat("path", F.array(F.col("place").cast("long"))).alias("path"), "text", "mcid")
        .unionByName(own.join(paths, ["doc_id", "node_id"]).select("doc_id", "node_id", "path", F.col("said").alias("text"), F.lit(None).cast("long").alias("mcid")))
    )
    pieces, pieces_at = written(pieces)
    dropped(nodes.sparkSession, *paths_at)
    risen = lambda some: some.join(climbs, ["doc_id", "node_id"]).drop("node_id").withColumnRenamed("above", "node_id")
    marks = marked_texts(spans).withColumnRenamed("text", "marked")
    told = risen(pieces.where("mcid is null and text <> ''").drop("mcid")).select("doc_id", "node_id", "path", "text")
    marked, marked_at = written(risen(pieces.where("mcid is not null").drop("text")).join(pages, ["doc_id", "node_id"]))
    drawn = marked.join(marks, ["doc_id", "page", "mcid"]).select("doc_id", "node_id", "path", F.col("marked").alias("text"))
    words = _cut(told.unionByName(drawn.where("text <> ''")))
    dropped(nodes.sparkSession, climbs_at, pieces_at, marked_at)
    joined = words.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), " ").alias("text"))
    return pages.join(joined, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "page", t.normalised(F.col("text")).alias("text"))


def shown_texts(nodes: DataFrame, texts: DataFrame, lines: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """doc_id, node_id, text, leaf: an element without text shows that of the nearest elements below that have some, in order; leaf, if its text is shown as a leaf of its own. nodes are read often; lines are their ancestors() and paths their places(), if they are known."""
    if lines is None:
        nodes = _cut(nodes)
        lines = closure.ancestors(nodes)
    some = _cut(texts.where("text <> ''").select("doc_id", "node_id", "text"))
    climbs = _cut(closure.below_stops(lines, some.select("doc_id", "node_id")).select("doc_id", "node_id", "above"))
    risen = some.join(_cut(closure.places(lines, nodes)) if paths is None else paths, ["doc_id", "node_id"]).join(climbs, ["doc_id", "node_id"])
    below = risen.groupBy("doc_id", F.col("above").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), " ").alias("text"))
    parents = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("holds", F.lit(True))
    out = nodes.select("doc_id", "node_id", "type").join(below, ["doc_id", "node_id"], "left").join(parents, ["doc_id", "node_id"], "left")
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "node_id", text.alias("text"), ((text != "") & F.col("holds").isNull() & F.col("type").isin(LEAFY)).alias("leaf"))
