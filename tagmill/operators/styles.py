"""What texts are by their looks: headings, items and paragraphs by size, weight and place.

spans: doc_id, page, block, line, span, text, size, font, flags, y0. Sizes are measured
against the mean of all spans of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import text as t

BLOCK = ["doc_id", "page", "block"]
#: Signs of list items, and how much larger than the mean the sizes of headings are.
ITEMS = [r"[•⦿⦾○●◦▪▫]", r"\p{Nd}+\.", r"\(\p{Nd}+\)", r"[a-z]\)", r"[ivxlcdm]+\.", r"[IVXLCDM]+\."]
STEPS = [(1, 1.6), (2, 1.4), (3, 1.2)]


def looked(spans: DataFrame) -> DataFrame:
    """doc_id, page, block, y0, text, size, bold, mean, kind (heading, item or paragraph) and level of each block that says something.

    A heading is larger than the mean by a step, or bold and short (level 4), or the first
    block of its page (level 1).
    """
    c = F.col
    parts = F.sort_array(F.collect_list(F.struct("line", "span", "text")))
    bold = F.lower("font").contains("bold") | (F.coalesce("flags", F.lit(0)).bitwiseAND(2) != 0)
    blocks = spans.groupBy(*BLOCK).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.max("size").alias("size"), F.bool_or(bold).alias("bold"), F.min("y0").alias("y0"))
    mean = spans.groupBy("doc_id").agg(F.avg("size").alias("mean"))
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block")) == 1
    one = blocks.withColumn("first", first).withColumn("text", t.stripped(c("text"))).where("text <> ''").join(mean, "doc_id")
    level = F.lit(None).cast("int")
    for k, step in reversed(STEPS):
        level = F.when(c("size") > c("mean") * step, k).otherwise(level)
    level = F.coalesce(level, F.when(c("bold") & (F.length("text") < 100), 4), F.when(c("first"), 1))
    item = c("text").rlike(f"^{t.WS}*(?:{'|'.join(ITEMS)}){t.WS}")
    return one.withColumn("level", level).withColumn("kind", F.when(c("level").isNotNull(), "heading").when(item, "item").otherwise("paragraph")).select(*BLOCK, "y0", "text", "size", "bold", "mean", "kind", "level")


def ladder(blocks: DataFrame) -> DataFrame:
    """doc_id, page, size, blocks, rung: the sizes of a page, counted, the largest on the first rung."""
    sizes = blocks.groupBy("doc_id", "page", F.round("size", 1).alias("size")).agg(F.count("*").alias("blocks"))
    return sizes.withColumn("rung", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("size"))))


def heading_warnings(blocks: DataFrame) -> DataFrame:
    """doc_id, page, block, level, previous, warning: the first heading of a page that isn't of level 1, and those that skip a level, from the top of the page down."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "block")
    one = blocks.where("kind = 'heading'").withColumn("previous", F.lag("level").over(w))
    warning = F.when(F.col("previous").isNull() & (F.col("level") > 1), "not the first level").when(F.col("level") > F.col("previous") + 1, "skips a level")
    return one.withColumn("warning", warning).where("warning is not null").select(*BLOCK, "level", "previous", "warning")
