"""What stands above a node: all pairs of a node and its ancestors, by pointers that double.

nodes: doc_id, node_id, parent_id (null at a root). A round doubles the distance that is
covered, so a tree of five thousand levels takes thirteen rounds; each is a join within
documents, whose new pairs alone are written to the shared folder, and the pointers of the
round before are removed. There are as many pairs as nodes and levels make, which every
answer of this kind has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators.tree import _cut, dropped, written

#: Rounds after which the parents must form a cycle: no tree has 2 ** 40 levels.
ROUNDS = 40


def ancestors(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, above, up: every node with itself (up 0) and all nodes above it; a parent that isn't among the nodes ends the line."""
    known = _cut(nodes.select("doc_id", "node_id", "parent_id"))
    real = known.select("doc_id", F.col("node_id").alias("to"))
    hop, path = written(known.select("doc_id", "node_id", F.col("parent_id").alias("to")).where("to is not null").join(real, ["doc_id", "to"], "left_semi"))
    reach = known.select("doc_id", "node_id", F.col("node_id").alias("above"), F.lit(0).cast("long").alias("up"))
    size, rounds = 1, 0
    while not hop.isEmpty():
        rounds += 1
        if rounds > ROUNDS or (rounds % 8 == 0 and size > known.groupBy("doc_id").count().agg(F.max("count")).first()[0]):
            raise ValueError("the parents form a cycle")
        ahead = reach.select("doc_id", F.col("node_id").alias("to"), "above", (F.col("up") + size).alias("up"))
        reach = reach.unionByName(_cut(hop.join(ahead, ["doc_id", "to"]).select("doc_id", "node_id", "above", "up")))
        far = hop.select("doc_id", F.col("node_id").alias("to"), F.col("to").alias("next"))
        done = path
        hop, path = written(hop.join(far, ["doc_id", "to"]).select("doc_id", "node_id", F.col("next").alias("to")))
        dropped(nodes.sparkSession, done)
        size *= 2
    return reach


def below_stops(lines: DataFrame, stops: DataFrame) -> DataFrame:
    """The pairs of ancestors() that no node of stops (doc_id, node_id) lies between or ends: a node's line goes up to below the first stop above it."""
    above = lines.where("up > 0").join(stops.select("doc_id", F.col("node_id").alias("above")), ["doc_id", "above"])
    first = above.groupBy("doc_id", "node_id").agg(F.min("up").alias("stop"))
    return lines.join(first, ["doc_id", "node_id"], "left").where("stop is null or up < stop").drop("stop")


def inherited(lines: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """doc_id, node_id and the value (doc_id, node_id, value) of the nearest node at or above that has one."""
    own = values.where(F.col(value).isNotNull()).select("doc_id", F.col("node_id").alias("above"), value)
    return lines.join(own, ["doc_id", "above"]).groupBy("doc_id", "node_id").agg(F.min_by(value, "up").alias(value))


def places(lines: DataFrame, nodes: DataFrame, place: str = "place") -> DataFrame:
    """doc_id, node_id, path: the places from the root down, whose order is that of reading."""
    own = nodes.select("doc_id", F.col("node_id").alias("above"), F.col(place).cast("long").alias("place"))
    step = F.struct((-F.col("up")).alias("depth"), "place")
    return lines.join(own, ["doc_id", "above"]).groupBy("doc_id", "node_id").agg(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["place"]).alias("path"))


def ranked(paths: DataFrame) -> DataFrame:
    """doc_id, node_id, rank: the place in the reading order of the document, from 1."""
    return paths.select("doc_id", "node_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "node_id")).alias("rank"))
