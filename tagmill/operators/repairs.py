"""What a node should be instead: how it looks, the type that fits below its parent, the attributes that it lacks.

nodes: doc_id, node_id, parent_id, sib, type, text, alt, scope. One join with the parent and
one aggregate of the children; captions are looked up below and beside; the rest are
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.operators.tree import TERMINAL

#: Types often used by mistake, and what they stand for.
CORRECTIONS = {"Title": "H1", "Heading": "H1", "Header": "H1", "Text": "P", "Paragraph": "P", "Image": "Figure", "Picture": "Figure", "Row": "TR", "Cell": "TD", "HeaderCell": "TH", "ListItem": "LI", "List": "L", "Page": "P"}
#: Words of captions of figures.
FIGURE_WORDS = ["fig", "figure", "imagen", "image", "ilustración", "illustration", "foto", "photo", "gráfico", "graph", "chart", "diagrama", "diagram"]
#: Children that each parent may hold, for the repairs.
CHILDREN = {
    "Document": ["Part", "Art", "Sect", "Div", "P", "H1", "L", "Table", "Figure", "Formula", "Form", "TOC", "Index"],
    "Part": ["Part", "Art", "Sect", "Div", "P", "H1", "L", "Table", "Figure", "Formula", "Form"],
    "Art": ["Part", "Sect", "Div", "P", "H1", "L", "Table", "Figure", "Formula", "Form"],
    "Sect": ["Part", "Sect", "Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure", "Formula", "Form"],
    "Div": ["P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure", "Formula", "Form", "Div"],
    "BlockQuote": ["P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure", "Formula", "Form", "Div"],
    "Caption": ["P", "Span", "Quote", "Code"],
    "TOC": ["Caption", "TOCI"],
    "TOCI": ["P", "Reference", "Link", "Lbl", "Span"],
    "Index": ["P", "Reference", "Link", "Lbl", "Span", "L"],
    "L": ["Caption", "LI"],
    "LI": ["Lbl", "LBody"],
    "LBody": ["P", "Span", "L", "Table", "Figure", "Formula", "Form", "Div"],
    "Table": ["Caption", "TR", "THead", "TBody", "TFoot"],
    "THead": ["TR"],
    "TBody": ["TR"],
    "TFoot": ["TR"],
    "TR": ["TH", "TD"],
    "TH": ["P", "Span", "L", "Figure", "Formula", "Form", "Div"],
    "TD": ["P", "Span", "L", "Table", "Figure", "Formula", "Form", "Div"],
    "Link": ["Link-OBJR", "Span"],
    "Reference": ["Lbl", "Span", "Link"],
    "Note": ["Lbl", "P", "Span", "L", "Table", "Figure", "Formula", "Form", "Div"],
    "NonStruct": TERMINAL,
    "Private": TERMINAL,
}
#: Signs before list items.
SIGNS = "•*○●■□▪▫◦»~+-"


def _label(end: str) -> str:
    return rf"^{t.WS}*(?:[{SIGNS}]|\p{{Nd}}+[.)]|[a-zA-Z][.)]){end}"


def looks_like_item(text: Column) -> Column:
    """A sign, number or letter as of a list, with white space and more after it; a sign needs no dot."""
    return text.rlike(_label(f"{t.WS}+"))


def looks_like_label(text: Column) -> Column:
    return text.rlike(_label("$"))


def looks_like_figure(text: Column) -> Column:
    """Less than ten words that name a figure; nothing in an empty text."""
    low = F.lower(text)
    named = F.lit(False)
    for word in FIGURE_WORDS:
        named = named | F.contains(low, F.lit(word))
    return (text != "") & (F.size(t.words_of(text)) < 10) & named


def looks_like_heading(text: Column, kids: Column) -> Column:
    """Less than 100 characters with a colon at the end or a number in front; or less than 50 without a full stop and one child at most."""
    bare = t.stripped(text)
    numbered = bare.rlike(rf"^\p{{Nd}}+(\.\p{{Nd}}+)*\.?{t.WS}+")
    return (text != "") & (F.length(bare) < 100) & (bare.endswith(":") | numbered | ((kids <= 1) & (F.length(bare) < 50) & ~bare.endswith(".")))


def looks(nodes: DataFrame) -> DataFrame:
    """nodes with parent_type, kids and like_heading, like_figure, like_item, like_label, like_row, like_table, like_list.

    A row has cells for half of its children at least, a table rows or what looks like
    them, a list items or what looks like them.
    """
    c, text = F.col, F.coalesce("text", F.lit(""))
    share = lambda test: F.count_if(test) >= 0.5 * F.count("*")
    cells = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"), share(c("type").isin("TH", "TD")).alias("like_row"), share((c("type") == "LI") | looks_like_item(text)).alias("like_list"))
    one = nodes.join(cells, ["doc_id", "node_id"], "left")
    rows = one.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(share((c("type") == "TR") | F.coalesce("like_row", F.lit(False))).alias("like_table"))
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    out = one.join(rows, ["doc_id", "node_id"], "left").join(up, ["doc_id", "parent_id"], "left").fillna(0, ["kids"]).fillna(False, ["like_row", "like_list", "like_table"])
    return out.withColumns({"like_heading": looks_like_heading(text, c("kids")), "like_figure": looks_like_figure(text), "like_item": looks_like_item(text), "like_label": looks_like_label(text)})


def _fitting() -> Column:
    """The type that a node of looks() should have by its name, its looks and its parent."""
    c, parent = F.col, F.coalesce("parent_type", F.lit(""))
    named = F.create_map(*[F.lit(x) for kv in CORRECTIONS.items() for x in kv])[c("type")]
    below = F.when(parent == "Table", "TR").when(parent == "TR", "TD").when(parent == "L", "LI").when(parent == "LI", F.when(c("like_label"), "Lbl").otherwise("LBody")).otherwise("P")
    heading = F.when(parent.isin("Document", "Part", "Art"), "H1").when(parent == "Sect", "H2").otherwise("H3")
    by_looks = F.when(c("like_heading"), heading).when(c("like_figure"), "Figure").when(c("like_table"), "Table").when(c("like_list"), "L").when(c("like_item"), "LI").otherwise(below)
    return F.coalesce(named, F.when((F.coalesce("text", F.lit("")) == "") & (c("kids") == 0), "Div").otherwise(by_looks))


def fitting_types(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, type, fitting (by looks and parent) and child_type: its type if the parent may hold it, else the fitting one if it may, else the first of P, Span and Div that it may hold, else its first."""
    may = F.create_map(*[F.lit(x) for p, ks in CHILDREN.items() for x in (p, ks)])[F.col("parent_type")]
    out = looks(nodes).withColumn("fitting", _fitting()).withColumn("may", may)
    safe = F.get(F.array_intersect(F.lit(["P", "Span", "Div"]), F.col("may")), F.lit(0))
    valid = F.when(F.col("may").isNull() | F.array_contains("may", F.col("type")), F.col("type")).when(F.array_contains("may", F.col("fitting")), F.col("fitting")).otherwise(F.coalesce(safe, F.get("may", F.lit(0))))
    return out.select("doc_id", "node_id", "type", "fitting", valid.alias("child_type"))


def captions(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, parent_id, sib, caption: what each caption says, its own text, else the first of its children's."""
    said = lambda name: F.nullif(t.stripped(F.coalesce(F.col(name), F.lit(""))), F.lit(""))
    kid = F.struct("sib", "node_id", said("text").alias("text"))
    first = nodes.where("parent_id is not null").where(said("text").isNotNull()).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min(kid)["text"].alias("first"))
    return nodes.where("type = 'Caption'").join(first, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "parent_id", "sib", F.coalesce(said("text"), "first").alias("caption")).where("caption is not null")


def _captioned(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, caption: of a caption below, the first; else of one right before, else right after."""
    told = captions(nodes)
    below = told.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min(F.struct("sib", "node_id", "caption"))["caption"].alias("below"))
    w = Window.partitionBy("doc_id", "parent_id").orderBy("sib", "node_id")
    beside = nodes.where("parent_id is not null").join(told.select("doc_id", "node_id", "caption"), ["doc_id", "node_id"], "left")
    beside = beside.withColumns({"before": F.lag("caption").over(w), "after": F.lead("caption").over(w)}).select("doc_id", "node_id", F.coalesce("before", "after").alias("beside")).where("beside is not null")
    return below.join(beside, ["doc_id", "node_id"], "full").select("doc_id", "node_id", F.coalesce("below", "beside").alias("caption"))


def required_attributes(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, attribute and value for figures and formulas without description, header cells without scope and notes, which have no id.

    A description is that of a caption within or beside the element; else it is made from
    its text, else from its children's, cut to 100.
    """
    kid = F.struct("sib", "node_id", t.stripped(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(kid)).alias("below"))
    need = nodes.where("type in ('Figure', 'Formula', 'TH', 'Note')").join(kids, ["doc_id", "node_id"], "left").join(_captioned(nodes), ["doc_id", "node_id"], "left")
    own = t.stripped(F.coalesce(F.col("text"), F.lit("")))
    said = F.array_join(F.filter(F.transform("below", lambda x: x["text"]), lambda x: x != ""), " ")
    said = F.when(F.length(said) > 100, F.concat(F.substring(said, 1, 97), F.lit("..."))).otherwise(said)
    prefix = F.when(F.col("type") == "Figure", "Imagen").otherwise("Fórmula matemática")
    described = F.when(F.col("caption").isNotNull(), F.col("caption")).when(own != "", F.concat(prefix, F.lit(": "), own)).when(F.coalesce(said, F.lit("")) != "", F.concat(prefix, F.lit(": "), said)).otherwise(F.concat(prefix, F.lit(" (ID: "), F.col("node_id"), F.lit(")")))
    lacks = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    found = F.when(F.col("type").isin("Figure", "Formula") & lacks("alt"), F.struct(F.lit("alt").alias("attribute"), described.alias("value"))).when((F.col("type") == "TH") & lacks("scope"), F.struct(F.lit("scope").alias("attribute"), F.lit("Column").alias("value"))).when(F.col("type") == "Note", F.struct(F.lit("id").alias("attribute"), F.concat(F.lit("Note_"), F.col("node_id")).alias("value")))
    return need.select("doc_id", "node_id", found.alias("x")).where("x is not null").select("doc_id", "node_id", "x.*")
