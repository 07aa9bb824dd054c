"""Repairs of figures, as patches: descriptions of images, figures without one, figures within links and notes, diagrams that say too little, images without a tag.

images: doc_id, page (from 0), image_id, kind (jpeg, png, ..), width, height, has_text,
content (its text), decorative. figures: doc_id, node_id, alt, actual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import text as t

#: What kinds of images are called.
KINDS = {"jpeg": "fotografía", "png": "gráfico", "tiff": "imagen escaneada", "gif": "imagen animada", "svg+xml": "gráfico vectorial"}
NAMED = ["imagen", "figura", "gráfico", "foto", "image", "picture"]
COMPLEX = ["gráfico", "diagrama", "esquema"]
MORE = " [Para obtener una descripción más detallada, contacte con el autor o administrador del documento]"


def _kind() -> Column:
    called = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(called[F.col("kind")], F.lit("imagen"))


def _capital(words: Column) -> Column:
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.expr("substring(kind_name, 2)")))


def _page() -> Column:
    return (F.col("page") + 1).cast("string")


def described(images: DataFrame) -> DataFrame:
    """images (with alt, null or empty if there is none) with made: the description to use.

    The text of an image comes first; then its own description, told more if it says
    nothing; then kind, shape and page.
    """
    named = images.withColumn("kind_name", _kind())
    kind, alt = _capital(F.col("kind_name")), F.coalesce("alt", F.lit(""))
    wide, high = F.col("width") > F.col("height") * 1.5, F.col("height") > F.col("width") * 1.5
    basic = F.concat(kind, F.lit(" "), F.when(wide, "horizontal").when(high, "vertical").otherwise("cuadrada"), F.lit(" en página "), _page())
    low = F.lower(alt)
    typed = F.when(low.rlike("|".join(NAMED)), alt).otherwise(F.concat(kind, F.lit(": "), alt))
    more = F.when(low.rlike("página|page"), typed).otherwise(F.concat(typed, F.lit(" (página "), _page(), F.lit(")")))
    told = F.coalesce("has_text", F.lit(False)) & (F.coalesce("content", F.lit("")) != "")
    made = F.when(told, F.concat(F.lit("Imagen con texto: "), "content")).when(alt != "", F.when(t.generic_alt(alt), more).otherwise(alt)).otherwise(basic)
    return named.withColumn("made", made).drop("kind_name")


def paired_patches(pairs: DataFrame) -> DataFrame:
    """pairs (an image with its figure's node_id, alt, actual) -> doc_id, node_id, attribute, value.

    A missing description is made; text that an image holds is set if it isn't; else a
    description that says nothing is told more.
    """
    one = described(pairs)
    alt, actual = F.coalesce("alt", F.lit("")), F.coalesce("actual", F.lit(""))
    set_text = F.coalesce("has_text", F.lit(False)) & (actual == "")
    first = F.when(alt == "", F.struct(F.lit("Alt").alias("attribute"), F.col("made").alias("value")))
    second = F.when(set_text, F.struct(F.lit("ActualText").alias("attribute"), F.coalesce("content", F.lit("")).alias("value"))).when((alt != "") & t.generic_alt(alt) & (F.col("made") != alt), F.struct(F.lit("Alt").alias("attribute"), F.col("made").alias("value")))
    return one.select("doc_id", "node_id", F.explode(F.array_compact(F.array(first, second))).alias("x")).select("doc_id", "node_id", "x.*")


def untagged_images(images: DataFrame) -> DataFrame:
    """doc_id, image_id, action (artifact or figure), alt, actual: what becomes of images without a figure."""
    one = described(images.withColumn("alt", F.lit(None).cast("string")))
    plain = F.coalesce("decorative", F.lit(False))
    return one.select("doc_id", "image_id", F.when(plain, "artifact").otherwise("figure").alias("action"), F.when(~plain, F.col("made")).alias("alt"), F.when(~plain & F.coalesce("has_text", F.lit(False)), F.col("content")).alias("actual"))


def figure_patches(nodes: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """nodes (doc_id, node_id, parent_id, type, alt) -> doc_id, node_id, reason, value: descriptions of figures.

    Within a note, link or form they say so; without an image (not among paired: doc_id,
    node_id) they say that; of diagrams that say too little it is said where there is more.
    """
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    figures = nodes.where("type = 'Figure'").join(up, ["doc_id", "parent_id"], "left")
    alt, low = F.coalesce("alt", F.lit("")), F.lower(F.coalesce("alt", F.lit("")))
    say = lambda frame, reason, value: frame.select("doc_id", "node_id", F.lit(reason).alias("reason"), value.alias("value"))
    within = say(figures.where(F.col("parent_type").isin("Annot", "Link", "Form")).where(alt == ""), "context", F.concat(F.lit("Imagen en "), F.lower("parent_type")))
    short = say(figures.where(low.rlike("|".join(COMPLEX)) & (F.length(alt) < 100)), "complex", F.concat(alt, F.lit(MORE)))
    if paired is None:
        return within.unionByName(short)
    orphans = figures.join(paired.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti").where(alt == "")
    return within.unionByName(short).unionByName(say(orphans, "orphan", F.lit("Elemento gráfico (no hay imagen detectable)")))
