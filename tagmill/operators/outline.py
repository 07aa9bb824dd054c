"""Trees from flat order: lists and tables of a page's blocks, sections by headings, lists by indents.

Rows become nodes doc_id, page, node_id, parent_id, place, type, text, attribute; ids say
what they are made of, as L12 for the list that begins at 12. Everything is windows within a page,
or within a document where sections and lists run over pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import text as t

PAGE = ["doc_id", "page"]
NODE = ["doc_id", "page", "node_id", "parent_id", "place", "type", "text", "attribute"]


def _node(rows: DataFrame, node: Column, parent: Column, place: Column, kind: Column, text: Column, attribute: Column | None = None) -> DataFrame:
    given = F.lit(None).cast("string") if attribute is None else attribute
    return rows.select("doc_id", "page", node.alias("node_id"), parent.alias("parent_id"), place.cast("long").alias("place"), kind.alias("type"), text.alias("text"), given.alias("attribute"))


def _id(sign: str, *parts: str) -> Column:
    return F.concat(F.lit(sign), F.concat_ws(".", *[F.col(p).cast("string") for p in parts]))


def built(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, seq, kind, text) -> the nodes of each page.

    Neighbouring list blocks make a list, which the next other block ends; that block
    stands for itself, whatever its kind. Other table blocks are rows of one table until
    a block that is neither comes. A list or table stands where the block comes that ends
    it; a table that is still open when its page ends with a list is left out, as the
    rules prescribe.
    """
    w = Window.partitionBy(*PAGE).orderBy("seq")
    after_list = F.coalesce(F.lag("kind").over(w) == "L", F.lit(False))
    flow = blocks.withColumn("after", after_list).withColumns({
        "row": (F.col("kind") == "Table") & ~F.col("after"),
        "ends": ~F.col("kind").isin("L", "Table") & ~F.col("after"),
    })
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    flow = flow.withColumns({
        "table": F.coalesce(F.count_if("ends").over(before), F.lit(0)),
        "run": F.sum(F.when((F.col("kind") == "L") & ~F.col("after"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "last_kind": F.last("kind").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    lists = flow.where("kind = 'L'").withColumn("list", F.min("seq").over(Window.partitionBy(*PAGE, "run")))
    rows = flow.where("row").withColumn("first", F.min("seq").over(Window.partitionBy(*PAGE, "table")))
    closing = flow.where("ends").select(*PAGE, "table", F.col("seq").alias("closed"))
    open_ = rows.join(closing, [*PAGE, "table"], "left")
    whole = open_.where("closed is not null or last_kind <> 'L'")
    # what stands directly on a page: blocks by their seq, a list or table just before the block that ends it
    numbering = F.min(F.when(t.first_numbering(F.col("text")).isNotNull(), F.struct("seq", t.first_numbering(F.col("text")).alias("kind"))))["kind"]
    ordered = F.bool_or(F.col("text").rlike(rf"^{t.WS}*\p{{Nd}}+[.)\]]{t.WS}+"))
    top = lambda rows, node, kind, at, turn, text="''", attribute="null": rows.select(*PAGE, node.alias("node_id"), F.expr(kind).alias("type"), F.expr(at).alias("at"), F.lit(turn).alias("turn"), F.expr(text).alias("text"), F.expr(attribute).cast("string").alias("attribute"))
    plain = top(flow.where("kind <> 'L' and not row"), _id("B", "seq"), "kind", "seq", 2, "text")
    heads = lists.groupBy(*PAGE, "list").agg(F.max("seq").alias("at"), ordered.alias("ordered"), F.coalesce(numbering, F.lit("None")).alias("numbering"))
    listed = top(heads, _id("L", "list"), "'L'", "at", 2, attribute="case when ordered then concat('ListNumbering=', numbering) end")
    tabled = top(whole.groupBy(*PAGE, "first").agg(F.first(F.coalesce("closed", F.lit(2**62))).alias("at")), _id("T", "first"), "'Table'", "at", 1)
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("at", "turn")) - 1
    tops = plain.unionByName(listed).unionByName(tabled).withColumn("parent_id", F.lit(None).cast("string")).withColumn("place", place.cast("long")).select(*NODE)
    at = F.row_number().over(Window.partitionBy(*PAGE, "list").orderBy("seq")) - 1
    return tops.unionByName(_items(lists, _id("L", "list"), at)).unionByName(_cells(whole))


def _items(items: DataFrame, parent: Column, place: Column) -> DataFrame:
    """An item, its label and its body for each row (seq, text)."""
    one = items.withColumn("x", t.item_parts(F.col("text"))).withColumn("parent", parent).withColumn("at", place)
    li, label = _node(one, _id("I", "seq"), F.col("parent"), F.col("at"), F.lit("LI"), F.lit("")), _node(one, _id("Lbl", "seq"), _id("I", "seq"), F.lit(0), F.lit("Lbl"), F.col("x.label"))
    return li.unionByName(label).unionByName(_node(one, _id("Body", "seq"), _id("I", "seq"), F.lit(1), F.lit("LBody"), F.col("x.body")))


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of tables and their cells; those of the first row are headers."""
    words = F.filter(F.transform(F.split("text", rf"{t.WS}{{2,}}|\t|\|"), t.stripped), lambda x: x != "")
    one = rows.withColumn("at", F.row_number().over(Window.partitionBy(*PAGE, "table").orderBy("seq")) - 1)
    tr = _node(one, _id("R", "seq"), _id("T", "first"), F.col("at"), F.lit("TR"), F.lit(""))
    cell = one.select(*PAGE, "seq", "at", F.posexplode(words).alias("k", "cell"))
    head = F.col("at") == 0
    return tr.unionByName(_node(cell, _id("C", "seq", "k"), _id("R", "seq"), F.col("k"), F.when(head, "TH").otherwise("TD"), F.col("cell"), F.when(head, "Scope=Column")))


def enclosing(rows: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """rows with up: the order of the nearest row before with a smaller level, null if there is none.

    levels are whole numbers from 1, null for rows that hold nothing; a null row's up is
    the nearest row before that has a level. One running maximum for each level that
    occurs, all of one window.
    """
    deepest = rows.agg(F.max(level)).first()[0] or 0
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = {k: F.max(F.when(F.col(level) <= k, F.col(order))).over(before) for k in range(1, deepest + 1)}
    named = rows.withColumns({f"_up{k}": c for k, c in seen.items()})
    up = F.lit(None).cast(rows.schema[order].dataType)
    for k in range(2, deepest + 1):
        up = F.when(F.col(level) == k, F.col(f"_up{k - 1}")).otherwise(up)
    if deepest:
        up = F.when(F.col(level).isNull(), F.col(f"_up{deepest}")).otherwise(up)
    return named.withColumn("up", up).drop(*[f"_up{k}" for k in seen])


def sections(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, seq, kind, text), seq rising through the document -> sections within sections by heading level, each with its heading first."""
    level = F.regexp_extract("kind", "^H([1-6])$", 1).try_cast("int")
    one = enclosing(blocks.withColumn("level", level), ["doc_id"], "seq", "level").where("kind is not null")
    within = F.when(F.col("up").isNotNull(), _id("S", "up"))
    heads = one.where("level is not null")
    inner = one.select("doc_id", "page", "seq", _id("B", "seq").alias("node_id"), F.when(F.col("level").isNotNull(), _id("S", "seq")).otherwise(within).alias("parent_id"), F.col("kind").alias("type"), "text")
    outer = heads.select("doc_id", "page", "seq", _id("S", "seq").alias("node_id"), within.alias("parent_id"), F.lit("Sect").alias("type"), F.lit("").alias("text"))
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("seq")) - 1
    return inner.unionByName(outer).withColumn("place", place.cast("long")).withColumn("attribute", F.lit(None).cast("string")).select(*NODE)


def indented_lists(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, seq, text) -> lists within the items of lists, by indent, for runs of neighbouring lines that look like items.

    A list is all items of a run with the same item above; it stands in that item's body.
    """
    mark = t.looks_like_item(F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("seq")
    breaks = F.sum(F.when(mark, 0).otherwise(1)).over(w)
    indent = F.length(F.regexp_extract("text", rf"^({t.WS}*)", 1))
    items = lines.withColumn("run", breaks).where(mark).withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id", "run").orderBy(indent)))
    one = enclosing(items, ["doc_id", "run"], "seq", "level")
    siblings = Window.partitionBy("doc_id", "run", "up")
    one = one.withColumn("list", F.min("seq").over(siblings)).withColumn("at", F.row_number().over(siblings.orderBy("seq")) - 1)
    heads = one.where("seq = list")
    lists = _node(heads, _id("L", "list"), F.when(F.col("up").isNotNull(), _id("Body", "up")), F.lit(0), F.lit("L"), F.lit(""))
    return lists.unionByName(_items(one, _id("L", "list"), F.col("at")))
