"""Rules over metadata rows.

doc_id, filename, has_xmp, pdf_ua_flag, title, info_title, xmp_title, author, subject,
keywords, has_lang, language, has_viewer_preferences, display_title. Strings may be null,
which counts as empty; a null flag counts as false, but for display_title, where it says
that there is no entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import text as t

#: Contents of fields that say nothing.
SUSPICIOUS = [r"^\s*$", "^untitled", r"^document\p{Nd}*$", "^test"]
FIELDS = ("title", "author", "subject", "keywords")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def title_faults(title: Column, filename: Column) -> Column:
    """Array of what is wrong with a title; a blank one has no other fault."""
    bare, name = t.stripped(F.coalesce(title, F.lit(""))), F.coalesce(filename, F.lit(""))
    found = F.array(
        F.when((name != "") & (F.lower(bare) == F.lower(name)), "file name"),
        F.when(F.lower(bare).isin(t.GENERIC_TITLES), "generic"),
        F.when(F.length(bare) < 3, "short").when(F.length(bare) > 200, "long"),
        F.when(bare.rlike(r'[<>:"\\|?*\x00-\x1f]'), "characters"),
    )
    return F.when(bare == "", F.array(F.lit("blank"))).otherwise(F.array_compact(found))


def title_problems(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode(title_faults(F.col("title"), F.col("filename"))).alias("problem"))


def issues(rows: DataFrame) -> DataFrame:
    """doc_id, checkpoint, severity, description of all that the metadata lack; one row for each finding."""
    say = lambda checkpoint, severity, words: F.struct(F.lit(checkpoint).alias("checkpoint"), F.lit(severity).alias("severity"), (words if isinstance(words, Column) else F.lit(words)).alias("description"))
    one = lambda when, *what: F.array(F.when(when, say(*what)))
    best = F.when(_text("xmp_title") != "", F.col("xmp_title")).otherwise(_text("info_title"))
    titled = F.when(best == "", F.array(say("06-003", "error", "no title"))).otherwise(F.transform(title_faults(best, F.col("filename")), lambda f: say("06-004", "warning", F.concat(F.lit("title: "), f))))
    xmp = F.when(~_flag("has_xmp"), F.array(say("06-001", "error", "no XMP metadata"))).otherwise(F.concat(one(~_flag("pdf_ua_flag"), "06-002", "error", "no conformance identifier"), titled))
    shown = F.when(~_flag("has_viewer_preferences"), say("07-001", "error", "no viewer preferences")).when(F.col("display_title").isNull(), say("07-001", "error", "no entry for the title's display")).when(~F.col("display_title"), say("07-002", "error", "title not displayed"))
    wrong = t.language_problem(F.col("language"))
    lang = F.when(~_flag("has_lang"), say("11-006", "error", "no language")).when(_text("language") == "", say("11-006", "error", "empty language")).when(wrong == "unknown", say("11-007", "warning", "language: unknown")).when(wrong.isNotNull(), say("11-007", "error", F.concat(F.lit("language: "), wrong)))
    lacking = [one(t.stripped(_text(f)) == "", "metadata-quality", "info", f"no {f}") for f in ("author", "subject", "keywords")]
    differ = one((_text("info_title") != "") & (_text("xmp_title") != "") & (F.col("info_title") != F.col("xmp_title")), "metadata-consistency", "warning", "titles differ")
    odd = [one((_text(f) != "") & F.lower(_text(f)).rlike("|".join(SUSPICIOUS)), "metadata-quality", "info", f"generic {f}") for f in ("title", "author", "subject")]
    found = F.concat(xmp, F.array(shown, lang), *lacking, differ, *odd)
    return rows.select("doc_id", F.explode(F.array_compact(found)).alias("i")).select("doc_id", "i.*")


def completeness(rows: DataFrame) -> DataFrame:
    """Percent of title, author, subject, language, conformance flag and display of the title that are there."""
    filled = [_text(f) != "" for f in ("title", "author", "subject", "language")] + [_flag("pdf_ua_flag"), _flag("display_title")]
    return rows.select("doc_id", (sum((F.when(f, 1).otherwise(0) for f in filled), F.lit(0)) / 6 * 100).alias("completeness"))


def ready(rows: DataFrame) -> DataFrame:
    """Whether XMP, conformance flag, title, its display and a language are all there."""
    return rows.select("doc_id", (_flag("has_xmp") & _flag("pdf_ua_flag") & (_text("title") != "") & _flag("display_title") & _flag("has_lang")).alias("ready"))


def recommendations(rows: DataFrame) -> DataFrame:
    texts = {"title": "add a title", "author": "name the author", "subject": "describe the content", "keywords": "add keywords"}
    flags = {"pdf_ua_flag": "add the conformance identifier", "display_title": "display the title", "has_lang": "declare a language"}
    found = F.array(*[F.when(_text(f) == "", words) for f, words in texts.items()], *[F.when(~_flag(f), words) for f, words in flags.items()])
    return rows.select("doc_id", F.array_join(F.array_compact(found), "; ").alias("advice"))


def report(rows: DataFrame) -> DataFrame:
    """One row per document: counts of its issues, whether it complies, how complete and ready it is, and what to do."""
    by = issues(rows).groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))])
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "errors", "warnings", "infos")]
    out = rows.select("doc_id").join(by, "doc_id", "left").select("doc_id", *counts).withColumn("compliant", F.col("errors") == 0)
    return out.join(completeness(rows), "doc_id").join(ready(rows), "doc_id").join(recommendations(rows), "doc_id")


def suggestions(rows: DataFrame) -> DataFrame:
    """Codes to offer for a language that isn't valid."""
    return rows.where(~t.valid_language(F.col("language"))).select("doc_id", F.array_join(t.language_suggestions(F.col("language")), ",").alias("codes"))


def repaired(rows: DataFrame) -> DataFrame:
    """The metadata that a repair would write: title, language, flags.

    A title scoring below 0.5 gives way to one made from the file's name; a language that
    isn't valid to the nearest known one; the flags are set.
    """
    title = F.when(t.title_score(_text("title")) < 0.5, t.title_of_filename(F.col("filename"))).otherwise(F.col("title"))
    lang = F.when(t.valid_language(F.col("language")), F.col("language")).otherwise(t.repaired_language(F.col("language")))
    return rows.select("doc_id", title.alias("title"), lang.alias("language"), F.lit(True).alias("pdf_ua_flag"), F.lit(True).alias("display_title"))


#: What names a maker that isn't given, a title that isn't, and the namespace of the identifier.
MAKERS = {"producer": "PDF/UA Editor v1.0", "creator": "PDF/UA Editor"}
UNTITLED, NAMESPACE = "Documento PDF", "http://www.aiim.org/pdfua/ns/id/"


def patches(rows: DataFrame) -> DataFrame:
    """doc_id, column, old, new: what repaired() changes, as patches."""
    after = repaired(rows)
    names = ["title", "language", "pdf_ua_flag", "display_title"]
    both = rows.select("doc_id", *[F.col(n).cast("string").alias(f"o_{n}") for n in names]).join(after.select("doc_id", *[F.col(n).cast("string").alias(f"n_{n}") for n in names]), "doc_id")
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"o_{n}").alias("old"), F.col(f"n_{n}").alias("new")) for n in names])
    return both.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*").where("not (old <=> new)")


def conforming(rows: DataFrame) -> DataFrame:
    """doc_id, title, language, creator, producer, xmp: metadata that conform, whatever is missing, and the XML that says so."""
    title = F.when(_text("title") == "", UNTITLED).otherwise(F.col("title"))
    lang = F.when(t.valid_language(F.col("language")), F.col("language")).otherwise("es-ES")
    xml = F.lit(f'<rdf:Description rdf:about="" xmlns:pdfuaid="{NAMESPACE}"><pdfuaid:part>1</pdfuaid:part></rdf:Description>')
    return rows.select("doc_id", title.alias("title"), lang.alias("language"), F.lit(MAKERS["creator"]).alias("creator"), F.lit(MAKERS["producer"]).alias("producer"), xml.alias("xmp"))
