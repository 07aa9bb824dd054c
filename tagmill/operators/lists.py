"""Lists and page artefacts from lines of text: doc_id, page, seq, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.operators import layout


def runs(lines: DataFrame, least: int = 2) -> DataFrame:
    """Runs of consecutive lines with one marker type, of at least so many lines; only decimal ones carry a numbering."""
    one = lines.withColumn("type", t.marker_type(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy("seq")
    new = F.when(F.col("type").eqNullSafe(F.lag("type").over(w)), 0).otherwise(1)
    numbered = one.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("type is not null").groupBy("doc_id", "run").agg(F.first("type").alias("type"), F.min("seq").alias("first"), F.count("*").alias("items")).where(f"items >= {least}").select("doc_id", "type", "first", "items", F.when(F.col("type") == "numbered-decimal", "Decimal").alias("numbering"))


def numbering_styles(labels_of: DataFrame) -> DataFrame:
    """labels_of (doc_id, label) -> the most common numbering; a label may count for several, ties go in the order named, None if nothing is numbered."""
    label = t.stripped(F.col("label"))
    signs = {"Decimal": r"\p{Nd}+", "LowerAlpha": "[a-z]", "UpperAlpha": "[A-Z]", "LowerRoman": "[ivxlcdm]+", "UpperRoman": "[IVXLCDM]+"}
    out = labels_of.groupBy("doc_id").agg(*[F.count_if(label.rlike(f"^{x}[.)]")).alias(n) for n, x in signs.items()])
    top = F.greatest(*signs)
    style = F.when(top == 0, "None")
    for n in signs:
        style = style.when(F.col(n) == top, n)
    return out.select("doc_id", style.alias("style"), top.alias("items"))


def first_numberings(lines: DataFrame) -> DataFrame:
    """Per document the numbering of the first of its lines that says one, else None."""
    kind = t.first_numbering(F.col("text"))
    return lines.groupBy("doc_id").agg(F.coalesce(F.min_by(kind, F.when(kind.isNotNull(), F.col("seq"))), F.lit("None")).alias("numbering"))


def labels(lines: DataFrame) -> DataFrame:
    return lines.withColumn("x", t.item_parts(F.col("text"))).select("*", "x.label", "x.body").drop("x")


def split_tables(lines: DataFrame) -> DataFrame:
    """Lines that bars, tabs or wide gaps cut into cells."""
    cells = F.filter(F.transform(F.split("text", rf"{t.WS}{{2,}}|\t|\|"), t.stripped), lambda x: x != "")
    return lines.withColumn("cells", F.size(cells)).where("cells >= 2")


def classified(blocks: DataFrame) -> DataFrame:
    """blocks with size, bold and text as H1, H2, H3, L, Table or P."""
    kind = F.when(F.col("size") > 16, "H1").when((F.col("size") > 14) & F.col("bold"), "H2").when((F.col("size") > 12) & F.col("bold"), "H3").when(t.looks_like_item(F.col("text")), "L").when(t.looks_like_table(F.col("text")), "Table").otherwise("P")
    return blocks.withColumn("block", kind)


def number_sequences(numbers: DataFrame, gap: int = 3) -> DataFrame:
    """(doc_id, n): whether the distinct numbers of a document rise by gap at most."""
    w = Window.partitionBy("doc_id").orderBy("n")
    steps = numbers.select("doc_id", "n").distinct().withColumn("step", F.col("n") - F.lag("n").over(w))
    return steps.groupBy("doc_id").agg(F.count("*").alias("numbers"), (F.coalesce(F.max("step"), F.lit(0)) <= gap).alias("sequence"))


def similar_texts(texts: DataFrame, least: float) -> DataFrame:
    """(doc_id, page, text): pairs of pages of a document with alike word sets; least is above 0.

    Sets as like as that share one of their first words in any one order, so only those are
    joined, rarest first; pairs are then compared as a whole.
    """
    if least <= 0:
        raise ValueError("pages without a common word are alike by 0")
    own = ["doc_id", "page", "tag"]
    one = texts.select("doc_id", "page", F.xxhash64("text").alias("tag"), F.array_distinct(t.words_of(F.lower("text"))).alias("words")).where("size(words) > 0").distinct()
    word = one.select(*own, F.size("words").alias("n"), F.explode("words").alias("word"))
    known = word.withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "word")))
    place = F.row_number().over(Window.partitionBy(*own).orderBy("df", "word"))
    early = known.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).where("df > 1")
    a, b = (early.select("doc_id", "word", F.col("page").alias(p)) for p in "ab")
    pairs = a.join(b, ["doc_id", "word"]).where("a < b").select("doc_id", "a", "b").distinct()
    x, y = (texts.select("doc_id", F.col("page").alias(p), F.col("text").alias(q)) for p, q in ("ax", "by"))
    return pairs.join(x, ["doc_id", "a"]).join(y, ["doc_id", "b"]).withColumn("similarity", t.jaccard(F.col("x"), F.col("y"))).where(F.col("similarity") >= least).select("doc_id", "a", "b", "similarity")


def repeated(texts: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, page, first, text) of texts that run through a document: two or more, on half its pages at least, alike.

    In order of page a text joins the first leader that is alike, or leads a group of its
    own, so each document folds to its leaders only; its texts find theirs row by row.
    """
    one = texts.select("doc_id", "page", "text", F.array_distinct(t.words_of(F.lower("text"))).alias("words"))
    point = F.struct("page", "words")
    docs = one.groupBy("doc_id").agg(F.sort_array(F.collect_list(point)).alias("v"), (F.max("page") + 1).alias("pages"))
    alike = lambda a, b: (F.size(a["words"]) > 0) & (F.size(F.array_intersect(a["words"], b["words"])) >= least * F.size(F.array_union(a["words"], b["words"])))
    leaders = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.array(F.element_at("v", 1)), lambda found, p: F.when(F.exists(found, lambda x: alike(x, p)), found).otherwise(F.concat(found, F.array(p))))
    led = one.withColumn("p", point).join(docs.select("doc_id", "pages", leaders.alias("found")), "doc_id")
    led = led.withColumn("first", F.coalesce(F.get(F.filter("found", lambda x: alike(x, F.col("p"))), F.lit(0))["page"], F.col("page")))
    n = F.count("*").over(Window.partitionBy("doc_id", "first"))
    return led.withColumn("n", n).where("n >= greatest(2, 0.5 * pages)").select("doc_id", "page", "first", "text")


#: How items of lists begin on a page.
PRINTED = [("bullet", r"[•⦿⦾○●◦▪▫]"), ("numbered", r"(?:\p{Nd}+\.|\(\p{Nd}+\)|[a-z]\)|[ivxlcdm]+\.|[IVXLCDM]+\.)")]


def printed_lists(lines: DataFrame, gap: float = 5.0) -> DataFrame:
    """lines (doc_id, page, line_id, x0, y0, x1, y1, text) -> doc_id, page, list, kind, items and box of the lists of two items or more that are seen.

    Items from the top of a page go on a list while they are of its kind and begin less
    than gap from its first one; other lines don't end a list. A page's items fold to
    their lists, the open one apart.
    """
    kind = F.lit(None).cast("string")
    for name, sign in reversed(PRINTED):
        kind = F.when(t.stripped(F.col("text")).rlike(f"^{sign}{t.WS}"), name).otherwise(kind)
    items = lines.withColumn("kind", kind).where("kind is not null")
    item = F.struct("y0", "line_id", "x0", "x1", "y1", "kind")
    pages = items.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("v"))
    run = lambda x, n=1: F.struct(x["kind"].alias("kind"), x["x0"].alias("indent"), F.lit(n).alias("items"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"))

    def fold(state, x):
        last = state["last"]
        grown = F.struct(last["kind"].alias("kind"), last["indent"].alias("indent"), (last["items"] + 1).alias("items"), F.least(last["x0"], x["x0"]).alias("x0"), F.least(last["y0"], x["y0"]).alias("y0"), F.greatest(last["x1"], x["x1"]).alias("x1"), F.greatest(last["y1"], x["y1"]).alias("y1"))
        return layout._folded(state, (x["kind"] == last["kind"]) & (F.abs(x["x0"] - last["indent"]) < gap), grown, run(x))

    runs = F.aggregate(F.slice("v", F.lit(2), F.size("v")), layout._opened(run(F.element_at("v", 1))), fold, layout._closed)
    many = F.filter(runs, lambda r: r["items"] >= 2)
    return pages.select("doc_id", "page", F.posexplode(many).alias("list", "r")).select("doc_id", "page", "list", "r.kind", "r.items", "r.x0", "r.y0", "r.x1", "r.y1")


def structure_patches(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, node_id, parent_id, sib, type, text) -> patches of lists: doc_id, node_id, action, value.

    What is in a list but no item is wrapped in one (a caption may come first); an item
    without label gets the one that its first child's text begins with, which goes from
    there; an item without body gets one around its children that are no labels.
    """
    c = F.col
    up = nodes.select("doc_id", c("node_id").alias("parent_id"), c("type").alias("parent_type"))
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("sib", "node_id"))
    kids = nodes.where("parent_id is not null").withColumn("place", place).join(up, ["doc_id", "parent_id"])
    say = lambda frame, node, action, value: frame.select("doc_id", node.alias("node_id"), F.lit(action).alias("action"), value.cast("string").alias("value"))
    loose = kids.where("parent_type = 'L' and type <> 'LI' and not (place = 1 and type = 'Caption')")
    has = lambda kind: F.max(c("type") == kind).over(Window.partitionBy("doc_id", "parent_id"))
    items = kids.where("parent_type = 'LI'").withColumns({"labelled": has("Lbl"), "bodied": has("LBody")})
    text = F.coalesce("text", F.lit(""))
    mark = t.marker(text)
    bare = items.where("place = 1 and not labelled").withColumn("mark", mark).where("mark <> ''")
    rest = F.regexp_replace(F.expr("substring(text, length(mark) + 1)"), rf"^{t.WS}+", "")
    body = items.where("not bodied and type <> 'Lbl'")
    return say(loose, c("node_id"), "wrap in LI", F.lit(None)).unionByName(say(bare, c("parent_id"), "add Lbl", c("mark"))).unionByName(say(bare, c("node_id"), "set text", rest)).unionByName(say(body, c("node_id"), "wrap in LBody", F.lit(None)))


def numbering_patches(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, value: the numbering to write to lists most of whose first three items have a label that counts; the style is the most common of all their labels."""
    c = F.col
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("sib", "node_id"))
    lists = nodes.where("type = 'L'").select("doc_id", c("node_id").alias("list"))
    items = nodes.where("type = 'LI'").withColumn("list", c("parent_id")).join(lists, ["doc_id", "list"]).withColumn("nth", place("doc_id", "list")).select("doc_id", "list", c("node_id").alias("parent_id"), "nth")
    label = nodes.where("type = 'Lbl'").withColumn("k", place("doc_id", "parent_id")).where("k = 1").select("doc_id", "parent_id", F.coalesce("text", F.lit("")).alias("label"))
    all_ = items.join(label, ["doc_id", "parent_id"], "left")
    counts = c("label").rlike(rf"^{t.WS}*(?:\p{{Nd}}+|[a-zA-Z]|[ivxlcdmIVXLCDM]+)[.)]")
    told = all_.where("nth <= 3").groupBy("doc_id", "list").agg(F.count_if(counts).alias("n"), F.count("*").alias("of")).where("n > of / 2")
    keyed = all_.where("label is not null").withColumn("key", F.struct("doc_id", "list"))
    style = numbering_styles(keyed.select(c("key").alias("doc_id"), "label")).select(c("doc_id.doc_id").alias("doc_id"), c("doc_id.list").alias("list"), "style")
    return told.join(style, ["doc_id", "list"]).select("doc_id", c("list").alias("node_id"), c("style").alias("value"))


def item_order(items: DataFrame) -> DataFrame:
    """items (doc_id, list, node_id, place, y0, y1) that don't stand where their height puts them among those with a position: current and expected, from 0."""
    centre = (F.col("y0") + F.col("y1")) / 2
    current = F.row_number().over(Window.partitionBy("doc_id", "list").orderBy("place", "node_id")) - 1
    placed = items.withColumn("current", current).withColumn("centre", centre).where("centre is not null")
    expected = F.row_number().over(Window.partitionBy("doc_id", "list").orderBy("centre", "current")) - 1
    return placed.withColumn("expected", expected).where("current <> expected").select("doc_id", "list", "node_id", "current", "expected")
