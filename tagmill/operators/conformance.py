"""Roll-ups of the issues bag: doc_id, checkpoint, severity, description, fixable, page. Duplicates stay; nothing here is distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators import closure

#: The 31 groups of checkpoints of the Matterhorn Protocol.
GROUPS = ["Real content tagged", "Role mapping", "Flickering", "Color and contrast", "Sound", "Metadata", "Dictionary", "OCR validation", "Appropriate tags", "Character mappings", "Declared natural language", "Stretchable characters", "Graphics", "Headings", "Tables", "Lists", "Mathematical expressions", "Page headers and footers", "Notes and references", "Optional content", "Embedded files", "Article threads", "Digital signatures", "Non-interactive forms", "XFA", "Security", "Navigation", "Annotations", "Actions", "XObjects", "Fonts"]
#: Groups whose failures are recommended for repair, in order.
CRITICAL = ["06", "07", "11", "13", "15", "09", "01"]
#: Advice in general, for documents with less than three recommendations.
GENERAL = ["semantic tags", "table headers", "alternative texts", "language", "reading order", "running heads", "contrast"]


#: Checkpoints with their title, section of the standard, and whether a machine can check them.
CHECKPOINTS = [
    ("01-001", "Artifact is tagged as real content", "UA1:7.1-1", False),
    ("01-002", "Real content is marked as artifact", "UA1:7.1-1", False),
    ("01-003", "Content marked as Artifact is present inside tagged content", "UA1:7.1-1", True),
    ("01-004", "Tagged content is present inside content marked as Artifact", "UA1:7.1-1", True),
    ("01-005", "Content is neither marked as Artifact nor tagged as real content", "UA1:7.1-2", True),
    ("01-006", "The structure type and attributes of a structure element are not semantically appropriate", "UA1:7.1-2", False),
    ("01-007", "Suspects entry has a value of true", "UA1:7.1-11", True),
    ("02-001", "Non-standard tag's mapping does not terminate with a standard type", "UA1:7.1-3", True),
    ("02-002", "Mapping of non-standard type is semantically inappropriate", "UA1:7.1-3", False),
    ("02-003", "A circular mapping exists", "UA1:7.1-3", True),
    ("02-004", "Standard types are remapped", "UA1:7.1-4", True),
    ("28-001", "Tab order not set to Structure in a page with annotations", "UA1:7.18.1-1", True),
    ("04-001", "Information conveyed by contrast, color, format or layout not reflected in structure", "UA1:7.1-6", False),
    ("06-001", "Document does not contain an XMP metadata stream", "UA1:7.1-8", True),
    ("06-002", "The XMP metadata stream does not include the PDF/UA identifier", "UA1:5", True),
    ("06-003", "XMP metadata stream does not contain dc:title", "UA1:7.1-8", True),
    ("06-004", "dc:title does not clearly identify the document", "UA1:7.1-8", False),
    ("07-001", "ViewerPreferences dictionary does not contain a DisplayDocTitle entry", "UA1:7.1-9", True),
    ("07-002", "ViewerPreferences dictionary contains a DisplayDocTitle entry with value of false", "UA1:7.1-9", True),
    ("09-001", "Tags are not in logical reading order", "UA1:7.2-1", False),
    ("09-002", "Structure elements are nested in a semantically inappropriate manner", "UA1:7.2-1", False),
    ("11-001", "Natural language for text in page content cannot be determined", "UA1:7.2-3", True),
    ("11-002", "Natural language for text in Alt, ActualText and E attributes cannot be determined", "UA1:7.2-3", True),
    ("11-006", "Natural language for document metadata cannot be determined", "UA1:7.2-3", True),
    ("11-007", "Natural language is not appropriate", "UA1:7.2-3", False),
    ("13-004", "<Figure> tag alternative or replacement text missing", "UA1:7.3-3", True),
    ("13-008", "ActualText not present when a <Figure> is intended to be consumed primarily as text", "UA1:7.3-4", False),
    ("14-003", "Numbered heading levels in descending sequence are skipped", "UA1:7.4-1", True),
    ("15-003", "In a table not organized with Headers attributes and IDs, a <TH> cell does not contain a Scope attribute", "UA1:7.5-2", True),
    ("15-005", "A given cell's header cannot be unambiguously determined", "UA1:7.5-2", False),
    ("16-001", "List is an ordered list, but no value for the ListNumbering attribute is present", "UA1:7.6-1", False),
    ("28-002", "An annotation, other than of subtype Widget, Link and PrinterMark, is not a direct child of an <Annot> structure element", "UA1:7.18.1-2", True),
    ("28-004", "An annotation, other than of subtype Widget, does not have a Contents entry and does not have an alternative description", "UA1:7.18.1-4", True),
    ("28-011", "A link annotation is not nested within a <Link> tag", "UA1:7.18.5-1", True),
]
#: Checkpoints whose failure is an error or a warning whatever finds it; others are information.
ERRORS = ["01-005", "06-001", "06-002", "06-003", "07-001", "07-002", "13-004", "14-003", "15-003", "28-002", "28-004", "28-011"]
WARNINGS = ["01-006", "02-002", "04-001", "06-004", "11-007", "13-008", "16-001"]
#: What a checkpoint's condition is about, where it isn't one object.
ABOUT = {"DOC": ["06-001", "06-002", "06-003", "06-004", "07-001", "07-002", "11-006"], "PAGE": ["03-001", "08-001", "08-002"], "JS": ["03-003", "05-003", "29-001"], "ALL": ["11-007"]}

#: What to do about a checkpoint, and about any other.
ADVICE = {
    "01-001": "Marcar el elemento como artefacto en lugar de etiquetarlo como contenido real",
    "01-002": "Etiquetar el contenido real con la etiqueta semántica apropiada",
    "01-005": "Marcar el contenido como artefacto o etiquetarlo como contenido real",
    "01-006": "Cambiar el tipo de estructura a uno semánticamente apropiado para el contenido",
    "06-001": "Añadir metadatos XMP al documento",
    "06-002": "Añadir identificador PDF/UA (pdfuaid:part=1) a los metadatos XMP",
    "06-003": "Añadir título al documento en los metadatos XMP",
    "06-004": "Establecer un título descriptivo para el documento",
    "07-001": "Añadir entrada DisplayDocTitle al diccionario ViewerPreferences",
    "07-002": "Establecer DisplayDocTitle=true en el diccionario ViewerPreferences",
    "11-006": "Establecer el atributo Lang en el diccionario Catalog",
    "11-007": "Establecer un código de idioma válido (p. ej., 'es-ES', 'en-US')",
    "13-004": "Añadir texto alternativo (Alt) a la figura",
    "13-008": "Añadir ActualText a la figura que contiene texto",
    "14-003": "Corregir la jerarquía de encabezados para evitar saltos de nivel",
    "15-003": "Añadir atributo Scope a la celda de cabecera (Row o Column)",
}
OTHER_ADVICE = "Corregir según las especificaciones de PDF/UA"


def checkpoints(spark) -> DataFrame:
    return spark.createDataFrame(CHECKPOINTS, "checkpoint string, title string, section string, machine boolean")


def explained(rows: DataFrame) -> DataFrame:
    """rows with a checkpoint, and what it is: known, title, section, group, checkable, severity, about, how (M or H)."""
    c = F.col("checkpoint")
    about = F.lit("Object")
    for kind, ids in ABOUT.items():
        about = F.when(c.isin(ids), kind).otherwise(about)
    out = rows.join(F.broadcast(checkpoints(rows.sparkSession)), "checkpoint", "left")  # 34 rows
    return out.select(
        *rows.columns,
        F.col("machine").isNotNull().alias("known"),
        F.coalesce("title", F.concat(F.lit("unknown checkpoint "), c)).alias("title"),
        F.coalesce("section", F.lit("unknown")).alias("section"),
        category(c).alias("group"),
        F.coalesce("machine", F.lit(False)).alias("checkable"),
        F.when(c.isin(ERRORS), "error").when(c.isin(WARNINGS), "warning").otherwise("info").alias("severity"),
        about.alias("about"),
        F.when(F.coalesce("machine", F.lit(False)), "M").otherwise("H").alias("how"),
    )


def groups(spark) -> DataFrame:
    return spark.createDataFrame([(f"{k:02d}", name) for k, name in enumerate(GROUPS, 1)], "category string, name string")


def category(checkpoint: Column) -> Column:
    return F.when(F.instr(checkpoint, "-") > 0, F.split_part(checkpoint, F.lit("-"), F.lit(1))).otherwise("00")


def severity_counts() -> list[Column]:
    s = F.col("severity")
    return [F.count("*").alias("total"), F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(~s.isin("error", "warning")).alias("infos")]


def matching(issues: DataFrame, severity: str | None = None, checkpoint: str | None = None, fixable: bool | None = None, text: str = "") -> DataFrame:
    out = issues
    if severity:
        out = out.where(F.col("severity") == severity)
    if checkpoint:
        out = out.where(F.col("checkpoint") == checkpoint)
    if fixable is not None:
        out = out.where(F.col("fixable") == fixable)
    return out.where(F.contains(F.lower("description"), F.lit(text.lower()))) if text else out


def by_checkpoint(issues: DataFrame) -> DataFrame:
    out = issues.groupBy("checkpoint").agg(*severity_counts())
    return out.withColumn("overall", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("info"))


def status(issues: DataFrame) -> DataFrame:
    """Per document: conformant if it has no error, and the checkpoints that block it."""
    return issues.groupBy("doc_id").agg((F.count_if(F.col("severity") == "error") == 0).alias("conformant"), F.countDistinct(F.when(F.col("severity") == "error", F.col("checkpoint"))).alias("blocking"), F.count("*").alias("issues_count"))


def rollup(issues: DataFrame) -> DataFrame:
    """All 31 categories, and others that occur, with their counts; zero where there is nothing."""
    found = issues.groupBy(category(F.col("checkpoint")).alias("category")).agg(*severity_counts())
    dim = groups(issues.sparkSession)
    return found.join(dim, "category", "full").select("category", F.coalesce("name", F.lit("other")).alias("name"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "errors", "warnings", "infos")])


def maturity(issues: DataFrame) -> DataFrame:
    """Per document the whole part of 100 (1 - failing categories / 31), 0 at least."""
    failing = F.countDistinct(F.when(F.col("severity") == "error", category(F.col("checkpoint"))))
    return issues.groupBy("doc_id").agg(failing.alias("failing")).withColumn("maturity", F.greatest(F.floor(100 * (1 - F.col("failing") / len(GROUPS))), F.lit(0)).cast("long"))


def two_levels(issues: DataFrame) -> DataFrame:
    """Counts by category and checkpoint with subtotals; null stands for all."""
    one = issues.select(category(F.col("checkpoint")).alias("category"), "checkpoint", "severity")
    return one.rollup("category", "checkpoint").agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "error").alias("errors"))


def top_categories(issues: DataFrame, k: int = 10) -> DataFrame:
    return rollup(issues).where("total > 0").orderBy(F.desc("total"), "category").limit(k)


def examples(issues: DataFrame, k: int = 3) -> DataFrame:
    """The first k issues of each checkpoint by document and description."""
    w = Window.partitionBy("checkpoint").orderBy("doc_id", "description")
    return issues.withColumn("n", F.row_number().over(w)).where(f"n <= {k}").select("checkpoint", "n", "doc_id", "description")


def recommendations(issues: DataFrame, structured: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, place, advice): what to mend first, for each document of structured (doc_id, has_structure).

    First structure, if there is none, then the failing critical groups in their order,
    and general advice up to most if that makes less than three.
    """
    failing = issues.where("severity = 'error'").groupBy("doc_id").agg(F.collect_set(category(F.col("checkpoint"))).alias("bad"))
    one = structured.join(failing, "doc_id", "left")
    bad = F.coalesce("bad", F.array().cast("array<string>"))
    own = F.array_compact(F.array(F.when(~F.col("has_structure"), "structure"), *[F.when(F.array_contains(bad, c), c) for c in CRITICAL]))
    first = F.slice(own, 1, most)
    advice = F.when(F.size(first) < 3, F.slice(F.concat(first, F.lit(GENERAL)), 1, most)).otherwise(first)
    return one.select("doc_id", F.posexplode(advice).alias("at", "advice")).select("doc_id", (F.col("at") + 1).alias("place"), "advice")


def detailed(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """issues with fix_description, and for those of an element its element_type and path, as /0:Document/2:P from the root down.

    nodes: doc_id, node_id, parent_id, sib, type.
    """
    lines = closure.ancestors(nodes)
    at = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("sib", "node_id")) - 1
    steps = nodes.select("doc_id", F.col("node_id").alias("above"), F.concat(F.lit("/"), at.cast("string"), F.lit(":"), "type").alias("step"))
    wanted = issues.where("element_id is not null").select("doc_id", F.col("element_id").alias("node_id")).distinct()
    paths = lines.join(wanted, ["doc_id", "node_id"], "left_semi").join(steps, ["doc_id", "above"]).groupBy("doc_id", F.col("node_id").alias("element_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("up"), "step"))), lambda x: x["step"]), "").alias("path"))
    types = nodes.select("doc_id", F.col("node_id").alias("element_id"), F.col("type").alias("element_type"))
    advice = F.coalesce(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])[F.col("checkpoint")], F.lit(OTHER_ADVICE))
    return issues.join(types, ["doc_id", "element_id"], "left").join(paths, ["doc_id", "element_id"], "left").withColumn("fix_description", advice)


def overview(issues: DataFrame) -> DataFrame:
    return issues.agg(*severity_counts(), F.count_if("fixable").alias("fixable"), F.bround(100.0 * F.count_if("fixable") / F.greatest(F.count("*"), F.lit(1)), 2).alias("fixable_percent"))
