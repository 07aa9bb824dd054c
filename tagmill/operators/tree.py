"""Rules over flattened structure trees.

nodes: doc_id, node_id, parent_id, sib_idx, pre_order, type, page, text, lang.
Everything stays within a document, so windows and joins carry doc_id and nothing
larger than one document's siblings meets in a frame.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Children that each parent may hold, for the validating grammar.
CHILDREN = {
    "Document": ["Part", "Art", "Sect", "Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure", "BlockQuote", "TOC", "Index"],
    "Part": ["Art", "Sect", "Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure"],
    "Art": ["Sect", "Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure"],
    "Sect": ["Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure"],
    "Div": ["P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure", "Div"],
    "L": ["LI"],
    "LI": ["Lbl", "LBody"],
    "LBody": ["P", "L", "Table", "Figure"],
    "Table": ["TR", "THead", "TBody", "TFoot", "Caption"],
    "THead": ["TR"],
    "TBody": ["TR"],
    "TFoot": ["TR"],
    "TR": ["TH", "TD"],
    "TH": ["P", "Span", "Link"],
    "TD": ["P", "Span", "Link", "L", "Figure"],
    "P": ["Span", "Link", "Note", "Reference"],
    "BlockQuote": ["P", "L"],
    "Caption": ["P", "Span"],
    "TOC": ["TOCI"],
    "TOCI": ["P", "Span", "Link"],
}
#: Types that the validation takes for standard.
STANDARD = ["Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot", "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Figure", "Formula", "Form"]
#: Types at which a role map may end, for the repairs.
TERMINAL = ["Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot", "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Ruby", "Warichu", "RB", "RT", "RP", "WT", "WP", "Figure", "Formula", "Form", "TextNode"]
#: Beginnings of names in lower case and the type that they suggest; the first that fits counts.
NAME_PATTERNS = [("h[0-9]", "H1"), ("head", "H1"), ("title", "H1"), ("heading", "H1"), ("subtitle", "H2"), ("chap", "H1"), ("sect", "Sect"), ("paragraph", "P"), ("para", "P"), ("text", "P"), ("img", "Figure"), ("pic", "Figure"), ("fig", "Figure"), ("table", "Table"), ("row", "TR"), ("cell", "TD"), (r"header\w*cell", "TH"), ("th", "TH"), ("td", "TD"), ("list", "L"), ("item", "LI"), ("(bullet|numbered)list", "L"), ("caption", "Caption"), ("link", "Link"), ("note", "Note"), ("quote", "Quote"), ("formula", "Formula"), ("div", "Div"), ("span", "Span"), ("annotation", "Annot"), ("form", "Form"), ("reference", "Reference")]
#: Types that the grammar lets stand anywhere.
EXEMPT = ["TextContent", "MCID", "StructTreeRoot"]


def heading_skips(headings: DataFrame, doc: str, order: list[str], level: str = "level") -> DataFrame:
    """Headings more than one deeper than the deepest before them in the document; before the first that is 0."""
    before = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return headings.withColumn("expected", F.coalesce(F.max(level).over(before), F.lit(0)) + 1).where(F.col(level) > F.col("expected"))


def repaired_levels(headings: DataFrame, parent: str, order: list[str], level: str = "level") -> DataFrame:
    """Each sibling's level as at most one below its repaired predecessor: i + running minimum of level - i."""
    w = Window.partitionBy(parent).orderBy(*order)
    one = headings.withColumn("_i", F.row_number().over(w))
    return one.withColumn("fixed", F.col("_i") + F.min(F.col(level) - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i")


def page_jumps(headings: DataFrame, doc: str, page: str, order: list[str], level: str = "level") -> DataFrame:
    """Headings more than two deeper than the one before on the page."""
    before = F.lag(level).over(Window.partitionBy(doc, page).orderBy(*order))
    return headings.withColumn("previous", before).where(F.col(level) > F.col("previous") + 2)


def grammar(spark) -> DataFrame:
    return spark.createDataFrame([(p, c) for p, cs in CHILDREN.items() for c in cs], "parent_type string, type string")


def illegal_nesting(nodes: DataFrame) -> DataFrame:
    """Edges that the grammar doesn't list, of parents that it does."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    edges = nodes.select("doc_id", "node_id", "parent_id", "type").join(up, ["doc_id", "parent_id"])
    legal = F.broadcast(grammar(nodes.sparkSession))  # a fixed table of some 80 rows
    return edges.where(F.col("parent_type").isin(list(CHILDREN)) & ~F.col("type").isin(EXEMPT)).join(legal, ["parent_type", "type"], "left_anti")


def list_rules(nodes: DataFrame) -> DataFrame:
    """Lists: how many items they hold and what else."""
    kids = nodes.select("doc_id", F.col("parent_id").alias("node_id"), F.col("type").alias("kid"))
    lists = nodes.where("type = 'L'").select("doc_id", "node_id")
    return lists.join(kids, ["doc_id", "node_id"], "left").groupBy("doc_id", "node_id").agg(F.count_if(F.col("kid") == "LI").alias("items"), F.count_if(F.col("kid") != "LI").alias("others"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that all executors see; on one machine it may be set here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context.getCheckpointDir()


#: Setting by which Spark removes a query's shuffle files as soon as it is done.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Settings of the most bytes of a table that goes whole to the driver and every executor: by its files, and by what a shuffle really held.
BY_FILES, BY_ROWS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: The most bytes of files: written tables are compressed, and rows in memory may take a hundred times as much.
SMALL = 256 * 1024


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files behind, and broadcast no table that is only small in its files."""
    before = {TIDY: spark.conf.get(TIDY), BY_FILES: spark.conf.get(BY_FILES), BY_ROWS: spark.conf.get(BY_ROWS, None)}
    most = before[BY_FILES]  # below 0: none is
    spark.conf.set(TIDY, "true")
    spark.conf.set(BY_FILES, most if most.startswith("-") else str(min(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most), SMALL)))
    spark.conf.set(BY_ROWS, before[BY_ROWS] or most)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def new_table(spark: SparkSession) -> str:
    """The path of a table to write, in the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(frame: DataFrame) -> tuple[DataFrame, str]:
    """frame, computed and written as a compressed table, and its path; the shuffles that it took are gone."""
    spark = frame.sparkSession
    path = new_table(spark)
    with tidied(spark):
        frame.write.option("compression", "zstd").parquet(path)
    if (noted := getattr(_NOTED, "paths", None)) is not None:
        noted.append(path)
    return spark.read.schema(frame.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Per thread the paths of tables written within the innermost scratch.
_NOTED = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within go at its end; what reads them must be done by then."""
    outer, _NOTED.paths = getattr(_NOTED, "paths", None), []
    try:
        yield
    finally:
        paths, _NOTED.paths = _NOTED.paths, outer
        dropped(spark, *paths)


def _cut(frame: DataFrame) -> DataFrame:
    """frame, computed and written to the shared folder."""
    return written(frame)[0]


def _walk(nodes: DataFrame, first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of first and of every step from there, level by level: a recursive query without its limits of rows and levels."""
    level = out = _cut(first)
    count, most = 0, None
    while not level.isEmpty():
        count += 1
        if count % 100 == 0:  # no path without a cycle is longer than its document has nodes
            most = most or nodes.groupBy("doc_id").count().agg(F.max("count")).first()[0]
            if count > most:
                raise ValueError("the parents form a cycle")
            out = _cut(out)
        level = _cut(step(level))
        out = out.unionByName(level)
    return out


def depths(nodes: DataFrame) -> DataFrame:
    """Depth of every node, 0 at a root."""
    edges = _cut(nodes.select("doc_id", "node_id", "parent_id"))
    first = edges.where("parent_id is null").select("doc_id", "node_id", F.lit(0).alias("depth"))
    return _walk(edges, first, lambda t: edges.join(t.withColumnRenamed("node_id", "parent_id"), ["doc_id", "parent_id"]).select("doc_id", "node_id", (F.col("depth") + 1).alias("depth")))


def paths(nodes: DataFrame) -> DataFrame:
    """path of every node: the places (sib) from its root down, whose order is that of reading."""
    edges = _cut(nodes.select("doc_id", "node_id", "parent_id", "sib"))
    first = edges.where("parent_id is null").select("doc_id", "node_id", F.array("sib").alias("path"))
    return _walk(edges, first, lambda t: edges.join(t.withColumnRenamed("node_id", "parent_id"), ["doc_id", "parent_id"]).select("doc_id", "node_id", F.concat("path", F.array("sib")).alias("path")))


def effective_languages(nodes: DataFrame) -> DataFrame:
    """Own language, else that of the nearest ancestor that has one."""
    edges = _cut(nodes.select("doc_id", "node_id", "parent_id", F.expr("nullif(lang, '')").alias("own")))
    first = edges.where("parent_id is null").select("doc_id", "node_id", F.col("own").alias("eff_lang"))
    return _walk(edges, first, lambda t: edges.join(t.withColumnRenamed("node_id", "parent_id"), ["doc_id", "parent_id"]).select("doc_id", "node_id", F.coalesce("own", "eff_lang").alias("eff_lang")))


def walked(nodes: DataFrame) -> DataFrame:
    """nodes that a root is above, with depth, path and eff_lang as in depths(), paths() and effective_languages(), by one walk."""
    edges = _cut(nodes.select("doc_id", "node_id", "parent_id", "sib", F.expr("nullif(lang, '')").alias("own")))
    first = edges.where("parent_id is null").select("doc_id", "node_id", F.lit(0).alias("depth"), F.array("sib").alias("path"), F.col("own").alias("eff_lang"))
    below = lambda t: edges.join(t.withColumnRenamed("node_id", "parent_id"), ["doc_id", "parent_id"]).select("doc_id", "node_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("sib")).alias("path"), F.coalesce("own", "eff_lang").alias("eff_lang"))
    return nodes.join(_walk(edges, first, below), ["doc_id", "node_id"])


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root, node_id) of all nodes at or below roots (doc_id, node_id)."""
    edges = _cut(nodes.select("doc_id", "node_id", "parent_id"))
    first = edges.join(roots, ["doc_id", "node_id"]).select("doc_id", F.col("node_id").alias("root"), "node_id")
    return _walk(edges, first, lambda t: edges.join(t.withColumnRenamed("node_id", "parent_id"), ["doc_id", "parent_id"]).select("doc_id", "root", "node_id"))


def without_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(subtree(nodes, roots).select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti")


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(doc_id, start, node_id, up) of all nodes at or above start (doc_id, node_id)."""
    edges = _cut(nodes.select("doc_id", "node_id", "parent_id"))
    first = edges.join(start, ["doc_id", "node_id"]).select("doc_id", F.col("node_id").alias("start"), "node_id", "parent_id", F.lit(0).alias("up"))

    def step(t: DataFrame) -> DataFrame:
        above = t.select("doc_id", "start", F.col("parent_id").alias("node_id"), (F.col("up") + 1).alias("up"))
        return edges.join(above, ["doc_id", "node_id"]).select("doc_id", "start", "node_id", "parent_id", "up")

    return _walk(edges, first, step).select("doc_id", "start", "node_id", "up")


def common_ancestors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (doc_id, a, b) the deepest node above both."""
    a = ancestors(nodes, pairs.select("doc_id", F.col("a").alias("node_id")).distinct()).select("doc_id", F.col("start").alias("a"), "node_id", F.col("up").alias("up_a"))
    b = ancestors(nodes, pairs.select("doc_id", F.col("b").alias("node_id")).distinct()).select("doc_id", F.col("start").alias("b"), "node_id")
    return pairs.join(a, ["doc_id", "a"]).join(b, ["doc_id", "b", "node_id"]).groupBy("doc_id", "a", "b").agg(F.min_by("node_id", "up_a").alias("common"))


def next_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_id, a, b): each node and the next one of its document by node_id, whatever their places in the tree."""
    after = F.lead("node_id").over(Window.partitionBy("doc_id").orderBy("node_id"))
    return nodes.select("doc_id", F.col("node_id").alias("a"), after.alias("b")).where("b is not null")


def _followed(role_map: DataFrame, stops: list[str]) -> DataFrame:
    """doc_id, custom, at, seen: where following the map from each name ends or comes to a name again.

    Level by level: each round takes the names that still lead on one step further.
    """
    bare = lambda c: F.regexp_replace(c, "^/", "")
    edges = _cut(role_map.select("doc_id", bare("custom").alias("custom"), bare("mapped").alias("mapped")))
    live = edges.select("doc_id", "custom", F.col("mapped").alias("at"), F.array("custom").alias("seen"))
    out, done = None, False
    while not done:
        again = F.array_contains("seen", F.col("at"))
        ahead = edges.select("doc_id", F.col("custom").alias("at"), F.col("mapped").alias("next"))
        step = _cut(live.join(ahead, ["doc_id", "at"], "left").withColumn("on", F.col("next").isNotNull() & ~again & ~F.col("at").isin(stops)))
        ended = step.where("not on").select("doc_id", "custom", "at", "seen")
        out = ended if out is None else out.unionByName(ended)
        live = step.where("on").select("doc_id", "custom", F.col("next").alias("at"), F.concat("seen", F.array("at")).alias("seen"))
        done = live.isEmpty()
    return out


def terminal_types(role_map: DataFrame) -> DataFrame:
    """role_map (doc_id, custom, mapped) -> doc_id, custom, terminal: where following the map ends, CYCLE if it never does."""
    return _followed(role_map, TERMINAL).select("doc_id", "custom", F.when(F.array_contains("seen", F.col("at")), "CYCLE").otherwise(F.col("at")).alias("terminal"))


def map_cycles(role_map: DataFrame) -> DataFrame:
    """doc_id, custom, length: the names from which following the map comes back to them, and in how many steps."""
    return _followed(role_map, []).where("at = custom").select("doc_id", "custom", F.size("seen").alias("length"))


def type_by_name(name: Column) -> Column:
    """A standard type for a custom name by its beginning; P if nothing fits."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("P")
    for pattern, kind in reversed(NAME_PATTERNS):
        out = F.when(low.rlike(f"^{pattern}"), kind).otherwise(out)
    return out


def statistics(nodes: DataFrame) -> DataFrame:
    """Per document: nodes, deepest level, nodes with text, distinct types."""
    return nodes.join(depths(nodes), ["doc_id", "node_id"]).groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"), F.count_if(F.trim("text") != "").alias("with_text"), F.countDistinct("type").alias("types"))
