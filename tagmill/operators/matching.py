"""Matching of what is seen with what is tagged: images, links, annotations, form fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.operators import closure, layout
from tagmill.operators.tree import _cut


def image_figures(images: DataFrame, figures: DataFrame) -> DataFrame:
    """One-to-one by page: the last image with the last figure and so on; what is left over has no partner."""
    place = lambda c: F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc(c)))
    a = images.select("doc_id", "page", "image_id", place("image_id").alias("k"))
    b = figures.select("doc_id", "page", "figure_id", place("figure_id").alias("k"))
    return a.join(b, ["doc_id", "page", "k"], "full").select("doc_id", "page", "image_id", "figure_id")


def ambiguous_links(links: DataFrame) -> DataFrame:
    """links (doc_id, text, dest): texts that lead to more than one destination within a document."""
    return links.where(t.stripped(F.col("text")) != "").groupBy("doc_id", t.stripped(F.col("text")).alias("text")).agg(F.countDistinct("dest").alias("destinations"), F.count("*").alias("links")).where("destinations > 1")


def unmatched(annotations: DataFrame, elements: DataFrame, key: list[str]) -> DataFrame:
    return annotations.join(elements.select(*key), key, "left_anti")


def described_fields(fields: DataFrame) -> DataFrame:
    """fields (field_id, name, type, flags): a description from the name, else from the type."""
    kind = F.when(F.col("type") == "Btn", F.when(F.col("flags").bitwiseAND(65536) != 0, "push button").when(F.col("flags").bitwiseAND(32768) != 0, "radio button").otherwise("check box")).when(F.col("type") == "Ch", "choice").when(F.col("type") == "Sig", "signature").otherwise("text field")
    return fields.withColumn("kind", kind).withColumn("description", F.coalesce(F.nullif(t.readable_field_name(F.col("name")), F.lit("")), F.col("kind"))).withColumn("multiline_flags", F.when(F.col("type") == "Tx", F.col("flags").bitwiseOR(4096)).otherwise(F.col("flags")))


def alt_texts(images: DataFrame, least: float = 0.6) -> DataFrame:
    """images (text that was recognised, file_name, text_image): the description to use, its attribute, and where it comes from.

    Recognised text counts if it is valid with a confidence of least, and stands for an
    image that is mostly text; then the file's name, then a phrase that says nothing.
    """
    told = images.withColumn("q", t.recognition(F.col("text")))
    good, name = F.col("q.valid") & (F.col("q.confidence") >= least), F.coalesce("file_name", F.lit(""))
    words = t.capitalised(t.words_of(F.translate(F.regexp_replace(name, r"[.][^.]*$", ""), "-_", "  ")))
    source = F.when(good, "ocr").when(name != "", "filename").otherwise("default")
    attribute = F.when(good & F.coalesce("text_image", F.lit(False)), "ActualText").otherwise("Alt")
    return told.withColumn("source", source).withColumn("attribute", attribute).withColumn("chosen", F.when(good, F.col("text")).when(name != "", words).otherwise("Imagen sin descripción disponible")).drop("q")


#: What fields are called that have no name.
FIELD_LABELS = {"Tx": "Campo de texto", "checkbox": "Casilla de verificación", "radio": "Botón de opción", "pushbutton": "Botón", "Ch": "Lista de selección", "Sig": "Campo de firma"}
#: What kinds of annotations are called.
ANNOTATION_LABELS = {"Text": "Nota de texto", "FreeText": "Texto libre", "Line": "Línea", "Square": "Rectángulo", "Circle": "Círculo", "Polygon": "Polígono", "PolyLine": "Línea poligonal", "Highlight": "Texto resaltado", "Underline": "Texto subrayado", "Squiggly": "Texto con subrayado ondulado", "StrikeOut": "Texto tachado", "Stamp": "Sello", "Caret": "Marca de inserción", "Ink": "Dibujo a mano", "FileAttachment": "Archivo adjunto", "Sound": "Sonido", "Movie": "Vídeo", "Screen": "Pantalla", "3D": "Objeto 3D", "Redact": "Redacción", "Popup": "Ventana emergente", "RichMedia": "Contenido multimedia"}


def tooltips(fields: DataFrame) -> DataFrame:
    """fields (field_id, name, type, flags, tu) with the tooltip to set: its own, if it has one that isn't the name, else the readable name, else the kind's."""
    button = F.when(F.col("flags").bitwiseAND(65536) != 0, "pushbutton").when(F.col("flags").bitwiseAND(32768) != 0, "radio").otherwise("checkbox")
    label = F.create_map(*[F.lit(x) for kv in FIELD_LABELS.items() for x in kv])[F.when(F.col("type") == "Btn", button).otherwise(F.col("type"))]
    own, name = F.coalesce("tu", F.lit("")), F.coalesce("name", F.lit(""))
    made = F.when(name != "", t.readable_field_name(name)).otherwise(F.coalesce(label, F.lit("Campo de formulario")))
    return fields.withColumn("tooltip", F.when((own != "") & (own != name), own).otherwise(made))


def link_problems(annotations: DataFrame, elements: DataFrame) -> DataFrame:
    """annotations (doc_id, annot_id, contents) of links against elements (doc_id, annot_id, has_objr, alt): doc_id, annot_id, problem."""
    one = annotations.join(elements.withColumn("found", F.lit(True)), ["doc_id", "annot_id"], "left")
    there = F.col("found").isNotNull()
    empty = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    found = F.array(F.when(~there, "missing structure"), F.when(there & ~F.coalesce("has_objr", F.lit(False)), "missing object reference"), F.when(there & empty("alt"), "missing description"), F.when(empty("contents"), "missing contents"))
    return one.select("doc_id", "annot_id", F.explode(F.array_compact(found)).alias("problem"))


def undescribed(annotations: DataFrame) -> DataFrame:
    """annotations (doc_id, annot_id, subtype, contents, alt, destination) other than widgets without contents and description, with one to set."""
    bare = annotations.where("subtype <> 'Widget' and coalesce(contents, '') = '' and coalesce(alt, '') = ''")
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in ANNOTATION_LABELS.items() for x in kv])[F.col("subtype")], F.concat(F.lit("Anotación de tipo "), "subtype"))
    linked = (F.col("subtype") == "Link") & (F.coalesce("destination", F.lit("")) != "")
    return bare.select("doc_id", "annot_id", F.when(linked, F.concat(F.lit("Enlace a "), "destination")).otherwise(label).alias("description"))


#: Elements that may hold the widgets of their page.
HOMES = ["P", "Div", "TD", "Sect", "Art", "NonStruct"]


def widget_homes(widgets: DataFrame, nodes: DataFrame) -> DataFrame:
    """widgets (doc_id, page, widget_id, name) that aren't in the tree -> doc_id, widget_id, parent_id, type, text: the form element to add, in the last element of their page that may hold them.

    nodes: doc_id, node_id, parent_id, place, type, page; an element without a page is on
    that of the nearest one above. Widgets of pages without such an element get none.
    """
    nodes = _cut(nodes.select("doc_id", "node_id", "parent_id", "place", "type", "page"))
    lines = closure.ancestors(nodes)
    where = closure.inherited(lines, nodes, "page").join(closure.places(lines, nodes), ["doc_id", "node_id"])
    homes = nodes.where(F.col("type").isin(HOMES)).select("doc_id", "node_id").join(where, ["doc_id", "node_id"])
    last = homes.groupBy("doc_id", "page").agg(F.max_by("node_id", F.struct("path", "node_id")).alias("parent_id"))
    return widgets.join(last, ["doc_id", "page"]).select("doc_id", "widget_id", "parent_id", F.lit("Form").alias("type"), t.readable_field_name(F.coalesce("name", F.lit(""))).alias("text"))


def clearer_links(links: DataFrame) -> DataFrame:
    """links (doc_id, link_id, text, alt, dest) whose text leads to more than one destination in their document -> doc_id, link_id, value: a description that names theirs."""
    bare = t.stripped(F.coalesce("text", F.lit("")))
    twice = ambiguous_links(links).select("doc_id", F.col("text").alias("said"))
    some = links.withColumn("said", bare).join(twice, ["doc_id", "said"], "left_semi").where(F.coalesce("dest", F.lit("")) != "")
    name = F.when(F.coalesce("alt", F.lit("")) != "", F.col("alt")).otherwise(F.coalesce("text", F.lit("Enlace")))
    return some.select("doc_id", "link_id", F.concat(name, F.lit(" (destino: "), "dest", F.lit(")")).alias("value"))


def missing_links(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """annotations (boxes with destination) without a link in the tree -> doc_id, page, elem_id, parent_id, type, text, alt: the links to add, each in the element of the text that it covers or that is nearest.

    texts: boxes with text and node_id. The description is the text with the destination,
    unless the text holds it.
    """
    near = layout.near_content(annotations, texts).join(texts.select("doc_id", "page", F.col("elem_id").alias("near_id"), F.col("node_id").alias("parent_id")), ["doc_id", "page", "near_id"])
    one = near.join(annotations.select("doc_id", "page", "elem_id", "destination"), ["doc_id", "page", "elem_id"])
    text, dest = F.coalesce("text", F.lit("")), F.coalesce("destination", F.lit(""))
    more = F.when(text == "", F.concat(F.lit("Enlace a "), dest)).otherwise(F.concat(text, F.lit(" (destino: "), dest, F.lit(")")))
    alt = F.when((dest == "") | F.contains(text, dest), text).otherwise(more)
    return one.select("doc_id", "page", "elem_id", "parent_id", F.lit("Link").alias("type"), "text", alt.alias("alt"))
