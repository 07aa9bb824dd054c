"""Sinks: nodes and issues as JSON, CSV, XML lines and text, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators import conformance

ISSUE = "doc_id long, checkpoint string, severity string, description string, fixable boolean, page long"


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def from_json(lines: DataFrame, schema: str = ISSUE) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def write_issues(issues: DataFrame, path: str, form: str) -> None:
    """form json, csv (with a header) or text; any path that Spark can write to."""
    if form == "text":
        issues.select(F.concat_ws(" ", F.concat(F.lit("["), "checkpoint", F.lit("]")), "severity", "description").alias("value")).write.text(path)
    elif form == "csv":
        issues.write.option("header", True).csv(path)
    else:
        issues.write.json(path)


#: What XML doesn't hold as it is, and what stands for it.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&apos;", '"': "&quot;"}


def _escaped(text: Column) -> Column:
    for sign, entity in ENTITIES.items():
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def xml_lines(nodes: DataFrame, escape: bool = False) -> DataFrame:
    """doc_id, at, line: the lines of structure_xml, sorted by at within a document; for sinks that write documents of any size."""
    return _xml_lines(nodes, escape).select("doc_id", "x.*")


def structure_xml(nodes: DataFrame, escape: bool = False) -> DataFrame:
    """One row per document: its tree as indented lines, as elements with their attributes and text, in reading order.

    nodes: doc_id, path (the places from the root down), type, text, alt, scope, lang. A
    document is one string, so it must fit a row; xml_lines has no such bound. Texts and
    values are written as they are, or so that any XML reader takes them, if escape is set.
    """
    return _xml_lines(nodes, escape).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("xml"))


def _xml_lines(nodes: DataFrame, escape: bool) -> DataFrame:
    safe = _escaped if escape else (lambda text: text)
    pad = F.repeat(F.lit("  "), F.size("path") - 1)
    line = lambda order, words: F.struct(order.alias("at"), words.alias("line"))
    inner = lambda k: F.concat("path", F.array(F.lit(k).cast("long")))
    attribute = lambda k, name: F.when(F.coalesce(F.col(name), F.lit("")) != "", line(inner(k), F.concat(pad, F.lit(f"  <attr name='{name}' value='"), safe(F.col(name)), F.lit("' />"))))
    text = F.trim(F.coalesce("text", F.lit("")))
    own = F.array(
        line(F.col("path"), F.concat(pad, F.lit("<"), "type", F.lit(">"))),
        *[attribute(-4 + k, name) for k, name in enumerate(("alt", "scope", "lang"))],
        F.when(text != "", line(inner(-1), F.concat(pad, F.lit("  <text>"), safe(text), F.lit("</text>")))),
        line(inner(2**62), F.concat(pad, F.lit("</"), "type", F.lit(">"))),
    )
    return nodes.select("doc_id", F.explode(F.array_compact(own)).alias("x"))


def patches(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """What changed, as key, column, old and new; repairs are written as these rows, never in place."""
    a = before.select(*key, *[F.col(c).cast("string").alias(f"o_{c}") for c in columns])
    b = after.select(*key, *[F.col(c).cast("string").alias(f"n_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new")) for c in columns])
    return a.join(b, key).select(*key, F.explode(pairs).alias("x")).select(*key, "x.*").where("not (old <=> new)")


def versions_kept(history: DataFrame, most: int = 50) -> DataFrame:
    """history (doc_id, version, ..): the latest versions of each document."""
    return history.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("version")))).where(f"k <= {most}").drop("k")


def report_lines(issues: DataFrame, examples: int = 3) -> DataFrame:
    """doc_id, at, line: a text report of each document as its lines, in the order of at.

    What it sums up, its conformance and counts, then every category and checkpoint that
    failed with a few examples. A report has as many lines as checkpoints failed, whatever
    the number of issues; write them sorted by doc_id and at.
    """
    c, say = F.col, F.concat
    s = lambda name: c(name).cast("string")
    sums = issues.groupBy("doc_id").agg(*conformance.severity_counts(), F.count_if("fixable").alias("fixable"))
    whole = sums.join(conformance.status(issues), "doc_id").join(conformance.maturity(issues), "doc_id")
    head = [
        F.lit("RESULTADO DE CONFORMIDAD"), F.lit("-" * 30), say(F.lit("Nivel: "), F.when(c("conformant"), "Conforme").otherwise("No conforme")), say(F.lit("Nivel de madurez: "), s("maturity"), F.lit("%")), say(F.lit("Problemas bloqueantes: "), s("blocking")), F.lit(""),
        F.lit("ESTADÍSTICAS"), F.lit("-" * 30), say(F.lit("Total problemas: "), s("total")), say(F.lit("Errores: "), s("errors")), say(F.lit("Advertencias: "), s("warnings")), say(F.lit("Informativo: "), s("infos")), say(F.lit("Corregibles automáticamente: "), s("fixable"), F.lit(" ("), F.floor(100 * c("fixable") / F.greatest("total", F.lit(1))).cast("string"), F.lit("%)")), F.lit(""),
        F.lit("PROBLEMAS POR CATEGORÍA"), F.lit("-" * 30),
    ]
    at = lambda *parts: F.concat_ws("|", *parts)
    top = whole.select("doc_id", F.posexplode(F.array(*head)).alias("k", "line")).select("doc_id", at(F.lit("0"), F.format_string("%02d", "k")).alias("at"), "line")
    one = issues.withColumn("category", conformance.category(c("checkpoint")))
    groups = one.groupBy("doc_id", "category").agg(*conformance.severity_counts()).join(conformance.groups(issues.sparkSession), "category", "left")
    title = say(c("category"), F.lit(": "), F.coalesce("name", F.lit("other")), F.lit(" - "), s("total"), F.lit(" problemas"))
    detail = say(F.lit("  Errores: "), s("errors"), F.lit(", Advertencias: "), s("warnings"), F.lit(", Info: "), s("infos"))
    grouped = groups.select("doc_id", "category", F.posexplode(F.array(title, detail)).alias("k", "line")).select("doc_id", at(F.lit("1"), "category", F.lit(" "), s("k")).alias("at"), "line")
    points = one.groupBy("doc_id", "category", "checkpoint").agg(F.count("*").alias("n"))
    pointed = points.select("doc_id", at(F.lit("1"), "category", "checkpoint", F.lit("0")).alias("at"), say(F.lit("  "), "checkpoint", F.lit(" - "), s("n"), F.lit(" problemas")).alias("line"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "checkpoint").orderBy(F.asc_nulls_first("page"), "description"))
    place = F.when(c("page").isNull(), "todo el documento").otherwise(say(F.lit("página "), s("page")))
    some = one.withColumn("nth", nth).where(c("nth") <= examples).select("doc_id", at(F.lit("1"), "category", "checkpoint", F.format_string("1.%03d", "nth")).alias("at"), say(F.lit("    - "), "description", F.lit(" ("), place, F.lit(")")).alias("line"))
    more = points.where(c("n") > examples).select("doc_id", at(F.lit("1"), "category", "checkpoint", F.lit("2")).alias("at"), say(F.lit("    - ... y "), (c("n") - examples).cast("string"), F.lit(" problemas más")).alias("line"))
    out = top
    for part in (grouped, pointed, some, more):
        out = out.unionByName(part)
    return out
