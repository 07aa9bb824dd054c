"""The bag of issues: what every rule finds, one row for each finding.

Rows are doc_id, checkpoint, severity, description, fixable, page (null: the whole
document) and element_id (null: none). Two rules that find the same thing give two
rows. Frames join and group by document and node; nothing is collected.

nodes: doc_id, node_id, parent_id, sib (place among its siblings), type, text, lang, page,
alt, scope, and actual and expansion where they are known. cells: as in tables, with
filled. meta: as in metadata.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import colour
from tagmill.functions import text as t
from tagmill.operators import closure, layout, metadata, tables, tree

COLUMNS = ["doc_id", "checkpoint", "severity", "description", "fixable", "page", "element_id"]
#: Types that are real content, and types whose text needs a language.
CONTENT = ["P", "H1", "H2", "H3", "H4", "H5", "H6", "Figure", "Table", "L"]
SPOKEN = ["P", "Span", "H1", "H2", "H3", "H4", "H5", "H6"]
#: Levels of a tree beyond which it is nested too deep.
DEEP = 10


def _when(condition: Column, checkpoint: str, severity: str, description: str | Column, fixable: bool = True) -> Column:
    words = description if isinstance(description, Column) else F.lit(description)
    return F.when(condition, F.struct(F.lit(checkpoint).alias("checkpoint"), F.lit(severity).alias("severity"), words.alias("description"), F.lit(fixable).alias("fixable")))


def _rows(frame: DataFrame, found: list[Column], page: Column | None = None, element: Column | None = None) -> DataFrame:
    page = (F.lit(None) if page is None else page).cast("long").alias("page")
    element = (F.lit(None) if element is None else element).cast("string").alias("element_id")
    return frame.select("doc_id", page, element, F.explode(F.array_compact(F.array(*found))).alias("i")).select("doc_id", "i.*", "page", "element_id").select(*COLUMNS)


def union(*bags: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, bags)


def _blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(t.SOLID)


def of_nodes(nodes: DataFrame) -> DataFrame:
    """What a node, its parent's type and its children's types show."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    kid = F.col("type")
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
        F.count("*").alias("kids"),
        F.count_if(kid == "LI").alias("items"),
        F.count_if(kid.isin("Lbl", "LBody")).alias("parts"),
        F.count_if(kid.isin("TR", "THead", "TBody", "TFoot")).alias("row_like"),
        F.count_if(kid.isin("TH", "TD")).alias("cell_like"),
    )
    one = nodes.join(up, ["doc_id", "parent_id"], "left").join(kids, ["doc_id", "node_id"], "left").fillna(0, ["kids", "items", "parts", "row_like", "cell_like"])
    c, kind = F.col, F.col("type")
    may = F.create_map(*[F.lit(x) for p, ks in tree.CHILDREN.items() for x in (p, ks)])[c("parent_type")]
    blank = _blank(c("text"))
    found = [
        _when(~kind.isin(*tree.STANDARD, "StructTreeRoot"), "01-006", "warning", "type not standard"),
        _when(c("parent_type").isin(list(tree.CHILDREN)) & ~kind.isin(tree.EXEMPT) & ~F.array_contains(may, kind), "09-002", "warning", "nested where it may not be"),
        _when((kind == "L") & (c("items") == 0), "09-002", "error", "list without items"),
        _when((kind == "L") & (c("kids") > c("items")), "09-002", "warning", "list with what is no item"),
        _when((kind == "LI") & (c("parts") == 0) & blank, "09-002", "warning", "item without parts or text"),
        _when((kind == "Table") & (c("row_like") == 0), "09-002", "error", "table without rows"),
        _when((kind == "TR") & (c("cell_like") == 0), "09-002", "error", "row without cells"),
        _when((kind == "TH") & (F.coalesce("scope", F.lit("")) == ""), "15-003", "error", "header cell without scope"),
        _when(kind.isin("TH", "TD") & blank & (c("kids") == 0), "01-006", "info", "empty cell"),
        _when((kind == "Figure") & (F.coalesce("alt", F.lit("")) == ""), "13-004", "error", "figure without alternative text"),
        _when((kind == "Link") & blank & (c("kids") == 0), "01-006", "warning", "link without text"),
    ]
    return _rows(one, found, c("page"), c("node_id"))


def of_trees(nodes: DataFrame, documents: DataFrame | None = None, walked: DataFrame | None = None) -> DataFrame:
    """What a document's tree as a whole shows; documents (doc_id) adds those without one. walked: tree.walked(nodes), if it is known."""
    c, kind = F.col, F.col("type")
    placed = nodes.join(tree.depths(nodes), ["doc_id", "node_id"]) if walked is None else walked
    whole = placed.groupBy("doc_id").agg(
        F.max("depth").alias("deepest"),
        F.count_if(kind.isin(CONTENT) | ~_blank(c("text"))).alias("real"),
        F.count_if(kind.isin("P", "Figure", "Table")).alias("content"),
        F.count_if(kind == "Div").alias("divs"),
    )
    found = [
        _when(c("real") == 0, "01-005", "error", "no real content tagged"),
        _when(c("deepest") > DEEP, "09-002", "warning", "nested too deep"),
        _when(c("content") == 0, "01-005", "warning", "no paragraphs, figures or tables"),
        _when(c("divs") > 2 * c("content"), "01-006", "info", "too many divisions"),
    ]
    out = _rows(whole, found)
    if documents is None:
        return out
    bare = documents.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    return out.unionByName(_rows(bare, [_when(F.lit(True), "01-005", "error", "no structure")]))


def heading_rules(headings: DataFrame, order: list[str]) -> Iterator[DataFrame]:
    """headings (doc_id, page, level, text, element_id and order): levels skipped, no text, jumps on a page, one after another."""
    c = F.col
    yield _rows(tree.heading_skips(headings, "doc_id", order), [_when(F.lit(True), "14-003", "error", F.format_string("level %d where %d may follow", c("level").cast("long"), c("expected").cast("long")))], c("page"), c("element_id"))
    yield _rows(headings, [_when(_blank(c("text")), "01-006", "warning", "heading without text")], c("page"), c("element_id"))
    jumps = tree.page_jumps(headings.where("page is not null"), "doc_id", "page", order)
    yield _rows(jumps, [_when(F.lit(True), "09-001", "warning", F.format_string("level %d after %d", c("level").cast("long"), c("previous").cast("long")))], c("page"))


def of_headings(headings: DataFrame, order: list[str]) -> DataFrame:
    return union(*heading_rules(headings, order))


def headings_of(nodes: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """The headings of a tree with their path of places, which puts them in order. walked: tree.walked(nodes), if it is known."""
    level = F.regexp_extract("type", "^H([0-9]+)$", 1)
    heads = "type rlike '^H[0-9]+$'"
    placed = nodes.where(heads).join(tree.paths(nodes), ["doc_id", "node_id"]) if walked is None else walked.where(heads)
    return placed.select("doc_id", "page", level.cast("int").alias("level"), "text", F.col("node_id").alias("element_id"), "path")


def of_structure(nodes: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    return union(of_nodes(nodes), of_trees(nodes, documents), of_headings(headings_of(nodes), ["path"]))


def of_languages(nodes: DataFrame, meta: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """Texts and descriptions without a language, own or of an ancestor or of the document, and codes that aren't valid. walked: tree.walked(nodes), if it is known."""
    c = F.col
    declared = meta.select("doc_id", F.coalesce("language", F.lit("")).alias("declared"))
    placed = nodes.join(tree.effective_languages(nodes), ["doc_id", "node_id"]) if walked is None else walked
    one = placed.join(declared, "doc_id", "left")
    lost = F.coalesce("eff_lang", "declared", F.lit("")) == ""
    found = [
        _when(c("type").isin(SPOKEN) & ~_blank(c("text")) & lost, "11-001", "error", "text without language"),
        _when(reduce(Column.__or__, [F.coalesce(name, F.lit("")) != "" for name in ("alt", "actual", "expansion") if name in nodes.columns]) & lost, "11-002", "error", "description without language"),
        _when((F.coalesce("lang", F.lit("")) != "") & ~t.valid_language(c("lang")), "11-007", "warning", "language of an element not appropriate"),
    ]
    own = [_when(~F.coalesce("has_lang", F.lit(False)), "11-006", "error", "language cannot be told"), _when(F.coalesce("has_lang", F.lit(False)) & ~t.valid_language(c("language")), "11-007", "warning", "language not appropriate")]
    return union(_rows(one, found, c("page"), c("node_id")), _rows(meta, own))


def of_annotations(annotations: DataFrame, outlines: DataFrame, meta: DataFrame) -> DataFrame:
    """Without a declared language: outlines (doc_id), contents and tooltips of annotations (doc_id, page, subtype, contents, tu)."""
    mute = meta.where(F.coalesce("language", F.lit("")) == "").select("doc_id")
    some = lambda name: F.coalesce(name, F.lit("")) != ""
    notes = _rows(annotations.join(mute, "doc_id", "left_semi"), [_when(some("contents"), "11-004", "warning", "annotation without language"), _when((F.col("subtype") == "Widget") & some("tu"), "11-005", "warning", "tooltip without language")], F.col("page"))
    return notes.unionByName(_rows(outlines.select("doc_id").distinct().join(mute, "doc_id", "left_semi"), [_when(F.lit(True), "11-003", "warning", "outline without language")]))


def of_metadata(meta: DataFrame) -> DataFrame:
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return metadata.issues(meta).select("doc_id", "checkpoint", "severity", "description", F.lit(True).alias("fixable"), nothing("long", "page"), nothing("string", "element_id"))


def of_untagged(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) that say something, of documents (doc_id) without a tree: one finding for each page."""
    said = pages.where(~_blank(F.col("text"))).select("doc_id", "page").distinct().join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return _rows(said, [_when(F.lit(True), "11-001", "error", "untagged text without language")], F.col("page"))


def of_contrast(texts: DataFrame) -> DataFrame:
    """texts (doc_id, page, element_id, text, r, g, b, br, bg, bb, size, bold, flags) that are seen and stand out too little from their ground."""
    c = F.col
    seen = texts.where(~_blank(c("text"))).where(F.coalesce("flags", F.lit(0)).bitwiseAND(16) == 0)
    ratio = colour.contrast_ratio((c("r"), c("g"), c("b")), (c("br"), c("bg"), c("bb")))
    short = colour.let(t.stripped(c("text")), lambda x: F.when(F.length(x) > 30, F.concat(F.substring(x, 1, 30), F.lit("..."))).otherwise(x))
    low = seen.where(ratio < colour.required_ratio(c("size"), c("bold")))
    return _rows(low, [_when(F.lit(True), "04-001", "warning", F.concat(F.lit("low contrast: "), short))], c("page"), c("element_id"))


def colour_rules(elements: DataFrame, tags: DataFrame | None = None) -> Iterator[DataFrame]:
    """elements (boxes with kind, color, font, size): legends without words, and texts of one look in three colours or more, one after another.

    tags (doc_id, page, elem_id, type) say what texts are tagged as; colours that share
    no type, two of them at least, are explained by the tags.
    """
    elements = tree._cut(elements)
    say = lambda frame, words: _rows(frame, [_when(F.lit(True), "04-001", "warning", words)], F.col("page"))
    legends = layout.color_legends(elements.select("doc_id", "page", "elem_id", "kind", "color", "x0", "y0", "x1", "y1"))
    yield say(legends, "colour alone: legend without words")
    own = ["doc_id", "page", "font", "size"]
    texts = elements.where("kind = 'text'")
    many = texts.groupBy(*own).agg(F.count("*").alias("items"), F.count_distinct("color").alias("colours")).where("items >= 3 and colours >= 3")
    if tags is not None:
        typed = texts.where("color is not null").join(tags, ["doc_id", "page", "elem_id"]).select(*own, "color", "type").distinct()
        shared = typed.groupBy(*own, "type").agg(F.count("*").alias("n")).groupBy(*own).agg((F.max("n") == 1).alias("apart"))
        told = typed.groupBy(*own).agg(F.count_distinct("color").alias("n")).where("n >= 2").join(shared.where("apart"), own)
        many = many.join(told, own, "left_anti")
    yield say(many, "colour alone: texts of one look")


def of_colours(elements: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    return union(*colour_rules(elements, tags))


def of_characters(spans: DataFrame) -> DataFrame:
    """spans (doc_id, page, text) with characters that say that a font has no mapping: controls but for white space, and those from U+FFFD."""
    return _rows(spans.where(F.col("text").rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}-\\x{10FFFF}]")), [_when(F.lit(True), "10-001", "info", "characters without a mapping", False)], F.col("page"))


def of_errors(errors: DataFrame) -> DataFrame:
    """errors (doc_id, error): documents that could not be read as a whole."""
    return _rows(errors, [_when(F.lit(True), "general", "error", F.concat(F.lit("error: "), "error"), False)])


def table_rules(cells: DataFrame, captioned: DataFrame | None = None, frames: DataFrame | None = None) -> Iterator[DataFrame]:
    """What cells show of their tables, named by doc_id = table_id, one kind of finding after another; captioned (table_id) are tables with a caption.

    frames (table_id, row_id), the rows of all tables, null for a table without any, adds
    tables without rows and rows without cells.
    """
    c = F.col
    one = tables.in_tables(cells.select("table_id", "row_id", "kind", "colspan", "rowspan", "scope", "cell_id", "headers", "filled"))
    one = one.withColumn("captioned", F.lit(False)) if captioned is None else one.join(captioned.select("table_id").distinct().withColumn("captioned", F.lit(True)), "table_id", "left").fillna(False, ["captioned"])
    of_table = c("at") == 1
    table = [
        _when(of_table & (c("max_cols") - c("min_cols") > 1), "table-structure", "warning", "uneven rows"),
        _when(of_table & ((c("n_rows") > 3) | (c("max_cols") > 3)) & ~c("captioned"), "table-accessibility", "info", "large table without caption"),
        _when(of_table & (c("heads") == 0) & ((c("n_rows") > 1) | (c("max_cols") > 1)), "table-headers", "warning", "table without header cells"),
        _when(of_table & (c("full") == 0), "table-content", "error", "empty table"),
    ]
    scope = F.trim(F.coalesce("scope", F.lit("")))
    head, lacks = c("kind") == "TH", lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    cell = [
        _when(head & ~c("by_id") & (scope == ""), "15-003", "error", "header cell without scope"),
        _when(head & ~c("by_id") & (scope != "") & ~scope.isin(tables.SCOPES), "15-003", "error", "unknown scope"),
        _when(head & ~c("filled"), "table-headers", "warning", "empty header cell"),
        _when(head & c("by_id") & lacks("cell_id"), "15-005", "error", "header cell without id"),
        _when((c("kind") == "TD") & c("complex") & c("by_id") & lacks("headers"), "15-005", "warning", "cell without headers"),
    ]
    spans = []
    for name, most in (("colspan", "max_cols"), ("rowspan", "n_rows")):
        problem = F.when(F.coalesce(name, F.lit("")) != "", tables.span_problem(c(name), c(most)))
        spans.append(_when(problem.isNotNull(), "table-spanning", "error", F.concat(F.lit(f"{name} "), problem)))
    named = lambda frame, found: _rows(frame.withColumn("doc_id", c("table_id").cast("long")), found)
    yield named(one, table + cell + spans)
    yield named(tables.dangling_headers(cells), [_when(F.lit(True), "15-005", "error", F.concat(F.lit("no cell "), "ref"))])
    if frames is None:
        return
    filled = frames.where("row_id is not null").join(cells.select("table_id", "row_id").distinct().withColumn("has", F.lit(True)), ["table_id", "row_id"], "left")
    bare = filled.where("has is null").groupBy("table_id").agg(F.count("*").alias("n"))
    none = frames.groupBy("table_id").agg(F.count("row_id").alias("n")).where("n = 0")
    yield named(bare, [_when(F.lit(True), "table-structure", "warning", F.concat(c("n").cast("string"), F.lit(" rows without cells")))])
    yield named(none, [_when(F.lit(True), "table-structure", "error", "table without any row")])


def of_tables(cells: DataFrame, captioned: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    return union(*table_rules(cells, captioned, frames))


def of_order(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, kind: headings that skip a level after the one before them in reading order, lists with what is no item, tables without a row right below.

    nodes: doc_id, node_id, parent_id, place, type.
    """
    c = F.col
    lines = closure.ancestors(nodes)
    ranks = closure.ranked(closure.places(lines, nodes))
    level = F.regexp_extract("type", r"^H(\p{Nd}+)$", 1).try_cast("int")
    heads = nodes.withColumn("level", level).where("level is not null").join(ranks, ["doc_id", "node_id"])
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("rank"))
    skips = heads.withColumn("before", before).where("level > before + 1")
    kids = nodes.where("parent_id is not null").groupBy("doc_id", c("parent_id").alias("node_id")).agg(F.count_if(c("type") != "LI").alias("others"), F.count_if(c("type") == "TR").alias("rows"))
    held = nodes.join(kids, ["doc_id", "node_id"], "left").fillna(0, ["others", "rows"])
    say = lambda frame, kind: frame.select("doc_id", "node_id", F.lit(kind).alias("kind"))
    return say(skips, "heading_level_skip").unionByName(say(held.where("type = 'L' and others > 0"), "invalid_list_content")).unionByName(say(held.where("type = 'Table' and rows = 0"), "empty_table"))
