"""Edits of structure trees, as rows: places for moves and additions, versions of values, and elements that say nothing.

nodes: doc_id, node_id, parent_id, sib, type, text, alt. Nothing is changed in place, so
taking back and repeating edits is a matter of the version that is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import text as t

#: Types that stay even if nothing is in them.
IMPORTANT = ["Figure", "Table", "L", "H1", "H2", "H3", "H4", "H5", "H6"]


def places(nodes: DataFrame) -> DataFrame:
    """doc_id, parent_id, node_id, place (from 0 among its siblings), up and down: the siblings that it would change places with, null at the ends."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("sib", "node_id")
    one = nodes.where("parent_id is not null")
    return one.select("doc_id", "parent_id", "node_id", (F.row_number().over(w) - 1).alias("place"), F.lag("node_id").over(w).alias("up"), F.lead("node_id").over(w).alias("down"))


def additions(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, parent_id, type, position) with place: the position, or the end if it is negative or beyond the children."""
    kids = nodes.where("parent_id is not null").groupBy("doc_id", "parent_id").agg(F.count("*").alias("kids"))
    known = nodes.select("doc_id", F.col("node_id").alias("parent_id"))
    out = wanted.join(known, ["doc_id", "parent_id"], "left_semi").join(kids, ["doc_id", "parent_id"], "left")
    many = F.coalesce("kids", F.lit(0))
    return out.withColumn("place", F.when((F.col("position") < 0) | (F.col("position") >= many), many).otherwise(F.col("position")).cast("long")).drop("kids")


def values_at(edits: DataFrame, version: int | None = None) -> DataFrame:
    """edits (doc_id, node_id, column, version, value) -> the values that hold at a version, with those before them.

    Taking back an edit is to read the version before; an empty value takes an attribute away.
    """
    w = Window.partitionBy("doc_id", "node_id", "column").orderBy("version")
    kept = edits if version is None else edits.where(F.col("version") <= version)
    last = F.max("version").over(Window.partitionBy("doc_id", "node_id", "column"))
    out = kept.withColumn("before", F.lag("value").over(w)).withColumn("last", last).where("version = last")
    return out.select("doc_id", "node_id", "column", "version", "before", F.nullif("value", F.lit("")).alias("value"))


def meaningless(nodes: DataFrame) -> DataFrame:
    """Nodes without text, description or children, of types that don't stand for themselves."""
    parents = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    blank = lambda c: t.stripped(F.coalesce(F.col(c), F.lit(""))) == ""
    bare = nodes.where(blank("text") & blank("alt") & ~F.col("type").isin(IMPORTANT) & F.col("parent_id").isNotNull())
    return bare.join(parents, ["doc_id", "node_id"], "left_anti")


def applied(nodes: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """nodes with the last new value of each of columns that patches (doc_id, node_id, column, new, and seq if some are later than others) set; nothing else changes."""
    seq = F.col("seq") if "seq" in patches.columns else F.lit(0)
    known = patches.where(F.col("column").isin(columns)).withColumn("seq", seq)
    last = known.groupBy("doc_id", "node_id", "column").agg(F.max_by("new", F.struct("seq", "new")).alias("new"))
    wide = last.groupBy("doc_id", "node_id").pivot("column", columns).agg(F.struct(F.first("new").alias("new")))
    wide = wide.select("doc_id", "node_id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = nodes.join(wide, ["doc_id", "node_id"], "left")
    return out.withColumns({c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.new").cast(nodes.schema[c].dataType)).otherwise(F.col(c)) for c in columns}).select(*nodes.columns)
