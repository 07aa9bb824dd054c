"""What is no content: running heads and feet, page numbers, decoration, invisible text. Boxes: doc_id, page, elem_id, x0, y0, x1, y1; pages: doc_id, page, width, height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import geometry as g
from tagmill.functions import text as t

PAGE = ["doc_id", "page"]
#: What page numbers look like, and signs in short texts that say so.
PAGE_NUMBERS = [r"\p{Nd}+", r"Page\s+\p{Nd}+", r"\p{Nd}+\s+of\s+\p{Nd}+", r"Page\s+\p{Nd}+\s+of\s+\p{Nd}+", r"-\s*\p{Nd}+\s*-", r"\[\s*\p{Nd}+\s*\]", r"Página\s+\p{Nd}+", r"\p{Nd}+\s+de\s+\p{Nd}+"]
PAGE_SIGNS = ["Pág.", "Page", "Página", "-", "/"]


def _zones(top: float = 0.1) -> tuple[g.Rect, g.Rect]:
    """The bands at the head and at the foot of a page of width and height."""
    w, h, none = F.col("width").cast("double"), F.col("height").cast("double"), F.lit(0.0)
    return (none, none, w, h * top), (none, h * (1 - top), w, h)


def _edge() -> Column:
    w, h = F.col("width"), F.col("height")
    return (F.col("x0") < w * 0.05) | (F.col("y0") < h * 0.05) | (F.col("x1") > w * 0.95) | (F.col("y1") > h * 0.95)


def _share(box: g.Rect, zone: g.Rect) -> Column:
    """The part of a box within a zone."""
    return F.when(g.area(box) > 0, g.overlap_area(box, zone) / g.area(box)).otherwise(0.0)


def zone_texts(spans: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, page, elem_id, kind, confidence of spans (boxes with text and tagged) in the head or foot that aren't tagged: pagination, header or footer."""
    head, foot = _zones()
    text = t.stripped(F.col("text"))
    number = text.rlike(r"^\p{Nd}+$") | ((F.length(text) <= 10) & text.rlike("|".join(s.replace(".", "[.]") for s in PAGE_SIGNS)))
    found = spans.where("not tagged").join(pages, PAGE)
    found = found.withColumns({"top": g.overlap_ratio(g.rect(), head) >= least, "bottom": g.overlap_ratio(g.rect(), foot) >= least}).where("top or bottom")
    kind = F.when(number, "pagination").when(F.col("top"), "header").otherwise("footer")
    return found.select(*PAGE, "elem_id", kind.alias("kind"), F.when(number, 0.9).otherwise(0.7).alias("confidence"))


def edge_shapes(shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, elem_id, kind, confidence of shapes (boxes with kind path or image, and stroke) near an edge: thin paths are borders, images of less than a hundredth of the page decoration."""
    found = shapes.join(pages, PAGE).where(_edge())
    border = (F.col("kind") == "path") & (F.coalesce("stroke", F.lit(2.0)) < 2)
    small = (F.col("kind") == "image") & (g.area(g.rect()) < F.col("width") * F.col("height") * 0.01)
    return found.withColumn("found", F.when(border, "border").when(small, "decoration")).where("found is not null").select(*PAGE, "elem_id", F.col("found").alias("kind"), F.when(border, 0.6).otherwise(0.5).alias("confidence"))


def decorative_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images that lie for more than half in the head, the foot or a margin, or are a page's ground or a large mark in its middle; reason says which."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    head, foot = _zones()
    none, box = F.lit(0.0), g.rect()
    margins = [("left margin", (none, none, w * 0.05, h)), ("right margin", (w * 0.95, none, w, h))]
    reason = F.lit(None).cast("string")
    for name, zone in reversed([("header", head), ("footer", foot), *margins]):
        reason = F.when(_share(box, zone) > 0.5, name).otherwise(reason)
    reason = F.coalesce(reason, F.when(g.is_background(box, w, h), "background"))
    return images.join(pages, PAGE).withColumn("reason", reason).where("reason is not null").select(*PAGE, "elem_id", "reason")


def looks_running(text: Column, y0: Column, y1: Column, flags: Column) -> Column:
    """Whether a text by itself is no content: invisible, or at the top or bottom with a page number, a date or short capitals."""
    bare = t.stripped(text)
    number, date = bare.rlike(r"(?i)\b(?:page|página)\s*\p{Nd}+\b"), bare.rlike(r"\p{Nd}{1,2}[/.-]\p{Nd}{1,2}[/.-]\p{Nd}{2,4}")
    capitals = (F.length(bare) < 100) & (bare == F.upper(bare)) & (bare != F.lower(bare))
    return (flags.bitwiseAND(16) != 0) | (((y0 < 50) | (y1 > 750)) & (number | capitals | date))


def numbered(texts: DataFrame) -> DataFrame:
    """texts (doc_id, page, elem_id, text), pages from 0, that look like a page number and hold one near their page's."""
    bare = t.stripped(F.col("text"))
    near = F.exists(F.regexp_extract_all("text", F.lit(r"(\p{Nd}+)"), F.lit(1)), lambda n: (F.abs(n.try_cast("long") - (F.col("page") + 1)) <= 2) | (n.try_cast("long") == F.col("page")))
    return texts.where(bare.rlike(f"^(?:{'|'.join(PAGE_NUMBERS)})$")).where(near).select(*PAGE, "elem_id")


def running_texts(texts: DataFrame, pages: DataFrame, alike: float = 0.7, others: int = 2) -> DataFrame:
    """doc_id, page, elem_id of texts in the head or foot for which as many other pages have an alike text at the same place.

    A place is told by the corners, rounded to a grid whose neighbouring cells count too;
    equal texts of a place are one row with their pages, so what is compared is the
    distinct texts of a place, not its pages.
    """
    grid = 20.0
    head, foot = _zones()
    c = F.col
    box = g.rect()
    here = texts.join(pages, PAGE).where((_share(box, head) > 0.5) | (_share(box, foot) > 0.5))
    words = F.array_sort(F.array_distinct(t.words_of(F.lower("text"))))
    here = here.select(*PAGE, "elem_id", words.alias("words"), F.floor(c("x0") / grid).alias("cx"), F.floor(c("y0") / grid).alias("cy")).where("size(words) > 0")
    one = here.groupBy("doc_id", "cx", "cy", "words").agg(F.collect_set("page").alias("on"))
    near = one.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).select("doc_id", (c("cx") + c("dx")).alias("cx"), (c("cy") + c("dy")).alias("cy"), c("words").alias("theirs"), c("on").alias("pages"))
    met = one.drop("on").join(near, ["doc_id", "cx", "cy"]).where(F.size(F.array_intersect("words", "theirs")) > alike * F.size(F.array_union("words", "theirs")))
    seen = met.groupBy("doc_id", "cx", "cy", "words").agg(F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("n")).where(f"n > {others}")
    return here.join(seen, ["doc_id", "cx", "cy", "words"]).select(*PAGE, "elem_id")
