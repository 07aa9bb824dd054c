"""Whether a structure tree is one: parents that don't exist, second parents, cycles, what can't be reached, pages out of range, elements over several pages.

nodes: doc_id, node_id, parent_id (null at a root), and page and place where they matter.
Pointers double until each node points as far up as its document has nodes, so neither
depth nor a cycle costs more than the logarithm of a document's size in rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators import closure
from tagmill.operators.tree import _cut, dropped, written


def tops(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, top: the node at the end of the line of parents (the least one counts), or one of the cycle that the line runs into, with on_cycle and below_cycle."""
    first = _cut(nodes.groupBy("doc_id", "node_id").agg(F.min("parent_id").alias("parent_id")))
    real = first.select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("real"))
    up = first.join(real, ["doc_id", "parent_id"], "left")
    ptr = _cut(up.select("doc_id", "node_id", F.when(F.col("real"), F.col("parent_id")).otherwise(F.col("node_id")).alias("to"), F.coalesce("real", F.lit(False)).alias("goes")))
    ends = ptr.where("not goes").select("doc_id", F.col("node_id").alias("to"), F.lit(True).alias("ends"))
    most, size = first.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0, 1
    walk, path = ptr.select("doc_id", "node_id", "to"), None
    while size < most:
        far = walk.select("doc_id", F.col("node_id").alias("to"), F.col("to").alias("next"))
        done = path
        walk, path = written(walk.join(far, ["doc_id", "to"]).select("doc_id", "node_id", F.col("next").alias("to")))
        if done:
            dropped(nodes.sparkSession, done)
        size *= 2
    out = _cut(walk.join(ends, ["doc_id", "to"], "left").select("doc_id", "node_id", F.col("to").alias("top"), F.col("ends").isNull().alias("lost")))
    # as many steps as a document has nodes end on the cycle, and every node of a cycle is the end of one of its nodes
    on = out.where("lost").select("doc_id", F.col("top").alias("node_id")).distinct().withColumn("on_cycle", F.lit(True))
    return out.join(on, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "top", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), (F.col("lost") & F.col("on_cycle").isNull()).alias("below_cycle"))


def faults(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, node_id, fault: orphan, second parent, cycle, below a cycle, below an orphan, page out of range (of pages: doc_id, page_count), second root."""
    nodes = _cut(nodes)
    found = tops(nodes)
    real = nodes.select("doc_id", F.col("node_id").alias("parent_id")).distinct()
    say = lambda frame, fault: frame.select("doc_id", "node_id", F.lit(fault).alias("fault")).distinct()
    least = nodes.groupBy("doc_id", "node_id").agg(F.min("parent_id").alias("parent_id"), F.count_distinct("parent_id").alias("parents"))
    orphans = least.where("parent_id is not null").join(real, ["doc_id", "parent_id"], "left_anti")
    below = found.join(orphans.select("doc_id", F.col("node_id").alias("top")), ["doc_id", "top"]).where("node_id <> top")
    roots = least.where("parent_id is null").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))).where("k > 1")
    astray = nodes.where("page is not null").join(pages, "doc_id").where("page < 0 or page >= page_count")
    parts = [say(orphans, "orphan"), say(least.where("parents > 1"), "second parent"), say(found.where("on_cycle"), "cycle"), say(found.where("below_cycle"), "below a cycle"), say(below, "below an orphan"), say(roots, "second root"), say(astray, "page out of range")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_runs(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, run, low, high: the runs of neighbouring pages that an element with all below it stands on, of elements on more than one page."""
    nodes = _cut(nodes.select("doc_id", "node_id", "parent_id", "page"))
    own = nodes.where("page is not null").select("doc_id", "node_id", "page")
    pages = closure.ancestors(nodes).join(own, ["doc_id", "node_id"]).select("doc_id", F.col("above").alias("node_id"), "page").distinct()
    w = Window.partitionBy("doc_id", "node_id")
    stepped = pages.withColumn("n", F.count("*").over(w)).where("n > 1").withColumn("new", F.when(F.col("page") - F.lag("page").over(w.orderBy("page")) == 1, 0).otherwise(1))
    return stepped.withColumn("run", F.sum("new").over(w.orderBy("page"))).groupBy("doc_id", "node_id", "run").agg(F.min("page").alias("low"), F.max("page").alias("high"))


def page_disorder(nodes: DataFrame) -> DataFrame:
    """doc_id, parent_id, node_id, page, after: siblings whose first page, of all below them, comes before that of one that stands before them; after is the latest such page."""
    nodes = _cut(nodes.select("doc_id", "node_id", "parent_id", "place", "page"))
    own = nodes.where("page is not null").select("doc_id", "node_id", "page")
    first = closure.ancestors(nodes).join(own, ["doc_id", "node_id"]).groupBy("doc_id", F.col("above").alias("node_id")).agg(F.min("page").alias("first"))
    before = Window.partitionBy("doc_id", "parent_id").orderBy("place", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.where("parent_id is not null").select("doc_id", "parent_id", "node_id", "place").join(first, ["doc_id", "node_id"])
    return rows.withColumn("after", F.max("first").over(before)).where("first < after").select("doc_id", "parent_id", "node_id", F.col("first").alias("page"), "after")
