"""Text expressions: cleaning, language, titles, list markers, quality of recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of words (each with the space after it) and phrases of language detection, in the order that breaks ties.
LANGUAGE_PATTERNS = {
    "es": ["de la", "el ", "la ", "que ", "en ", "y ", "por ", "con ", "para ", "es "],
    "en": ["the ", "and ", "of ", "to ", "in ", "is ", "that ", "for ", "it ", "with "],
    "fr": ["le ", "la ", "les ", "de ", "et ", "en ", "que ", "une ", "pour ", "dans "],
    "de": ["der ", "die ", "und ", "den ", "in ", "von ", "zu ", "das ", "mit ", "dem "],
    "it": ["il ", "la ", "di ", "e ", "che ", "in ", "per ", "un ", "del ", "con "],
}
#: The code that each detected language is declared with.
DECLARED = {"es": "es-ES", "en": "en-US", "fr": "fr-FR", "de": "de-DE", "it": "it-IT"}
#: Patterns of the language of recognised text, in the order that breaks ties.
RECOGNISED_PATTERNS = {
    "spa": ["de la", "el ", "la ", "que ", "en ", "y ", "por ", "con ", "para ", "es ", "ñ", "á", "é", "í", "ó", "ú", "ü"],
    "eng": ["the ", "and ", "of ", "to ", "in ", "is ", "that ", "for ", "it ", "with ", "th", "wh"],
    "fra": ["le ", "la ", "les ", "de ", "et ", "en ", "que ", "une ", "pour ", "dans ", "ç", "à", "è", "ê", "ë", "î", "ï", "ô", "ù", "û", "ÿ"],
    "deu": ["der ", "die ", "und ", "den ", "in ", "von ", "zu ", "das ", "mit ", "dem ", "ä", "ö", "ü", "ß"],
    "ita": ["il ", "la ", "di ", "e ", "che ", "in ", "per ", "un ", "del ", "con ", "è", "à", "ò", "ù"],
}
#: Language codes that metadata may declare, compared without regard to case.
METADATA_CODES = ["es", "es-ES", "es-MX", "es-AR", "es-CO", "es-CL", "es-PE", "es-VE", "en", "en-US", "en-GB", "en-CA", "en-AU", "fr", "fr-FR", "fr-CA", "de", "de-DE", "de-AT", "de-CH", "it", "it-IT", "pt", "pt-PT", "pt-BR", "ru", "ru-RU", "zh", "zh-CN", "zh-TW", "ja", "ja-JP", "ko", "ko-KR", "ar", "ar-SA", "ca", "ca-ES", "eu", "eu-ES", "gl", "gl-ES"]
#: Languages with suggestions, and the regions offered for some of them.
COMMON_LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "ru", "zh", "ja", "ko", "ar", "hi"]
REGIONS = {"en": ["en-US", "en-GB"], "es": ["es-ES", "es-MX"], "fr": ["fr-FR", "fr-CA"], "pt": ["pt-BR", "pt-PT"], "zh": ["zh-CN", "zh-TW"]}
ANY_LANGUAGE = ["en-US", "es-ES", "fr-FR", "de-DE"]
#: The code that a repair declares for a language, in the order in which they are tried.
REPAIRED_LANGUAGES = {"es": "es-ES", "en": "en-US", "fr": "fr-FR", "de": "de-DE", "it": "it-IT", "pt": "pt-PT", "ru": "ru-RU", "zh": "zh-CN", "ja": "ja-JP", "ar": "ar-SA", "ca": "ca-ES"}
#: Languages by the direction of their lines.
RIGHT_TO_LEFT = ["ar", "he", "fa", "ur", "yi", "dv", "ha", "ps", "ug"]
VERTICAL = ["zh", "ja", "ko"]
#: Titles that say nothing, for the check and for the repair.
GENERIC_TITLES = ["documento", "document", "untitled", "sin título", "nuevo documento", "pdf", "archivo", "file", "temp", "temporal"]
REPLACED_TITLES = ["untitled", "sin título", "document", "documento", "pdf document", "pdf", "new document", "documento nuevo", "documento pdf", "archivo pdf", "pdf file", "sin nombre", "doc", "noname", "no name", "unnamed"]
#: Alternative texts that say nothing.
GENERIC_ALTS = ["^imagen$", "^figura$", "^gráfico$", "^foto$", r"^imagen \p{Nd}+$", r"^figura \p{Nd}+$", r"^img_\p{Nd}+$", "^photo$", "^image$", "^picture$"]
#: Prefixes of field names that give way to what follows in upper case.
FIELD_PREFIXES = ["txt", "chk", "rad", "cmb", "btn"]
#: Signs of list items.
BULLETS = "•⦿⦾⚫◦◆◊▪▫►▻▶▷◉○⚬●■□"
ITEM_BULLETS = "•*+◦▪■○□➢➤➥➨-"

#: White space as Unicode has it.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: What stripped() leaves.
SOLID = r"[^\s\x1c-\x1f\x85\p{Z}]"


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{WS}+|{WS}+$", "")


def words_of(t: Column) -> Column:
    return F.filter(F.split(t, f"{WS}+"), lambda w: w != "")


def normalised(t: Column) -> Column:
    """Without control characters, runs of white space as one space, trimmed; null is empty."""
    bare = F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.array_join(words_of(bare), " ")


def occurrences(t: Column, pattern: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return ((F.length(t) - F.length(F.replace(t, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")


def language_scores(t: Column) -> dict[str, Column]:
    """Occurrences of each language's patterns; endings that no other one ends with are counted by one pass for them all."""
    low, out = F.lower(t), {}
    for lang, patterns in LANGUAGE_PATTERNS.items():
        ends = [p[:-1] for p in patterns if p.endswith(" ")]
        inner = [a for a in ends if any(a != b and b.endswith(a) for b in ends)]
        passes = [rf" (?<=(?:{'|'.join(x for x in ends if x not in inner)}) )", *[f" (?<={x} )" for x in inner], *[p for p in patterns if not p.endswith(" ")]]
        out[lang] = sum((F.regexp_count(low, F.lit(p)).cast("long") for p in passes), F.lit(0).cast("long"))
    return out


def _leading(scores: dict[str, Column]) -> Column:
    """The name of the highest score, the first of equals; each score is worked out once, which keeps generated code small."""
    ranked = F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("name")) for k, (name, s) in enumerate(scores.items())])
    return F.array_max(ranked)["name"]


def detected_language(t: Column) -> Column:
    """The code to declare for the language whose patterns occur most."""
    lang = _leading(language_scores(F.coalesce(t, F.lit(""))))
    return F.create_map(*[F.lit(x) for kv in DECLARED.items() for x in kv])[lang]


def recognised_language(t: Column) -> Column:
    """The language whose patterns cover most characters on average; English for texts of less than 20 characters and for null."""
    low = F.lower(t)
    covered = {lang: sum((occurrences(low, p) * len(p) for p in patterns), F.lit(0).cast("long")) / len(patterns) for lang, patterns in RECOGNISED_PATTERNS.items()}
    return F.when(t.isNull() | (F.length(t) < 20), "eng").otherwise(_leading(covered))


def valid_language(code: Column) -> Column:
    """Whether a code has the form of a language with or without a region; every code known by name has it."""
    return F.coalesce(code.rlike("^[a-z]{2,3}(-[A-Z]{2,3})?$"), F.lit(False))


def language_problem(code: Column) -> Column:
    """What is wrong with a declared code, as checkpoint 11-007 has it: blank, format, unknown; null if nothing is."""
    bare = stripped(F.coalesce(code, F.lit("")))
    return F.when(bare == "", "blank").when(~bare.rlike("^[a-zA-Z]{2}(-[a-zA-Z]{2})?$"), "format").when(~F.lower(bare).isin([x.lower() for x in METADATA_CODES]), "unknown")


def language_suggestions(code: Column) -> Column:
    """Codes to offer for a bad one: its language, that twice, its common regions; else four common ones."""
    base = F.split_part(F.coalesce(code, F.lit("")), F.lit("-"), F.lit(1))
    regions = F.lit([]).cast("array<string>")
    for lang, codes in REGIONS.items():
        regions = F.when(base == lang, F.lit(codes)).otherwise(regions)
    own = F.concat(F.array(base, F.concat(base, F.lit("-"), F.upper(base))), regions)
    return F.when(base.isin(COMMON_LANGUAGES), own).otherwise(F.lit(ANY_LANGUAGE))


def repaired_language(code: Column) -> Column:
    """The code to declare instead: that of the language named, else of the first that the code holds, else Spanish."""
    low = F.lower(F.coalesce(code, F.lit("")))
    exact, held = F.lit(None).cast("string"), F.lit("es-ES")
    for base, full in reversed(REPAIRED_LANGUAGES.items()):
        exact = F.when(low == base, full).otherwise(exact)
        held = F.when(F.contains(low, F.lit(base)), full).otherwise(held)
    return F.when(low == "", "es-ES").otherwise(F.coalesce(exact, held))


def reading_mode(code: Column) -> Column:
    base = F.lower(F.split_part(code, F.lit("-"), F.lit(1)))
    return F.when(base.isin(RIGHT_TO_LEFT), "rl-tb").when(base.isin(VERTICAL), F.when(F.lower(code).isin("ja-jp", "ko-kr"), "tb-lr").otherwise("tb-rl")).otherwise("lr-tb")


def marker(t: Column) -> Column:
    """The list marker at the start of a line, with the white space around it; empty if there is none."""
    return F.regexp_extract(t, rf"^(?:{WS}*[{BULLETS}]+{WS}|{WS}*[-–—]{WS}|{WS}*[*]{WS}|{WS}*\p{{Nd}}+[.)]{WS}|{WS}*[a-zA-Z][.)]{WS}|{WS}*[ivxlcdmIVXLCDM]+[.)]{WS})", 0)


def marker_type(t: Column) -> Column:
    """Type of a list marker at the start, null if there is none; single letters i, v and x count as letters."""
    m = marker(t)
    own = lambda signs: m.rlike(rf"^{WS}*{signs}[.)]{WS}")
    numbered = F.when(own(r"\p{Nd}+"), "decimal").when(own("[a-z]"), "lower-alpha").when(own("[A-Z]"), "upper-alpha").when(own("[ivxlcdm]+"), "lower-roman").when(own("[IVXLCDM]+"), "upper-roman").otherwise("other")
    return F.when(m == "", None).when(m.rlike(r"[.)]"), F.concat(F.lit("numbered-"), numbered)).otherwise("bullet")


def item_parts(t: Column) -> Column:
    """struct(label, body) of a list item of one line; without a label the body is the text."""
    m = rf"^{WS}*([{ITEM_BULLETS}]|\p{{Nd}}+[.)\]]|[IVXLCDMivxlcdm]+[.)\]]|[A-Za-z][.)\]]){WS}+(.*)$"
    label = F.regexp_extract(t, m, 1)
    return F.struct(label.alias("label"), F.when(label == "", t).otherwise(F.regexp_extract(t, m, 2)).alias("body"))


def looks_like_item(t: Column) -> Column:
    return t.rlike(rf"^{WS}*(?:[{ITEM_BULLETS}]|\p{{Nd}}+[.)\]]|[IVXLCDMivxlcdm]+[.)\]]|[A-Za-z][.)\]]){WS}+")


def first_numbering(t: Column) -> Column:
    """The numbering that an item's label says, null if it says none; letters of Roman numerals count as such."""
    own = lambda signs: t.rlike(rf"^{WS}*{signs}[.)\]]")
    return F.when(own(r"\p{Nd}+"), "Decimal").when(own("[IVXLCDM]+"), "UpperRoman").when(own("[ivxlcdm]+"), "LowerRoman").when(own("[A-Z]"), "UpperAlpha").when(own("[a-z]"), "LowerAlpha")


def looks_like_table(t: Column) -> Column:
    return t.contains("|") | t.contains("\t") | (occurrences(t, "  ") > 3)


def capitalised(words: Column) -> Column:
    """Words with the first letter in upper case and the rest in lower case, joined by a space."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def title_score(t: Column) -> Column:
    """From 0 to 1: 0.4 for length, 0.4 for up to five distinct words, 0.2 for case; 0.1 for a title to be replaced."""
    n, words = F.length(t), words_of(t)
    length = F.when(n < 3, 0.1).when(n < 10, 0.4).when(n < 100, F.least(n / 50, F.lit(1.0))).otherwise(0.7)
    diversity = F.least(F.size(F.array_distinct(F.transform(words, F.lower))) / 5, F.lit(1.0))
    upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    form = F.when(upper(t), 0.4).when((t == F.lower(t)) & (t != F.upper(t)), 0.5).when(upper(F.substring(t, 1, 1)), 1.0).otherwise(0.7)
    return F.when(F.coalesce(t, F.lit("")) == "", 0.0).when(F.lower(t).isin(REPLACED_TITLES), 0.1).otherwise(0.4 * length + 0.4 * diversity + 0.2 * form)


def title_of_filename(name: Column) -> Column:
    """Without extension, dashes and underscores as spaces, words capitalised, short names lengthened."""
    whole = r"^((?:.*/)?\.*[^./][^/]*)\.[^./]*$"
    stem = F.when(name.rlike(whole), F.regexp_extract(name, whole, 1)).otherwise(name)
    title = capitalised(words_of(F.translate(stem, "-_", "  ")))
    return F.when(F.coalesce(name, F.lit("")) == "", "Documento PDF").when(F.length(title) < 3, F.concat(title, F.lit(" - Documento PDF"))).otherwise(title)


def generic_alt(t: Column) -> Column:
    """Whether an alternative text is one of the generic ones, shorter than 10 characters, or missing."""
    bare = stripped(F.coalesce(t, F.lit("")))
    return (F.length(bare) < 10) | stripped(F.lower(bare)).rlike("|".join(GENERIC_ALTS))


def text_problems(t: Column) -> Column:
    """Problems of extracted text, joined by commas; blank text has none."""
    special = F.length(F.regexp_replace(t, r"[\p{L}\p{N} \t\n\r.,;:!?\-()\[\]{}]", ""))
    found = F.array(F.when(t.contains("  "), "double space"), F.when(F.length(t) > 1000, "long"), F.when(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control"), F.when(special / F.length(t) > 0.3, "special"))
    return F.when(stripped(F.coalesce(t, F.lit(""))) == "", "").otherwise(F.array_join(F.array_compact(found), ","))


def recognition(t: Column) -> Column:
    """struct(valid, confidence, errors) of recognised text.

    The confidence is the mean of the shares of usual characters, lines not repeated and
    words that can be words, times 0.8 below 50 characters, and 0 below 10. A word of
    three or more characters can't be one if it repeats one character or holds no letter
    of the Spanish alphabet. More than 0.3 of odd characters or such words, or 0.2 of
    repeated lines, are errors.
    """
    t = F.coalesce(t, F.lit(""))
    n = F.length(t)
    odd = F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{Nd}}\s\x1c-\x1f\x85\p{{Z}}.,\-:;?!()\[\]{{}}\"'/]", "")) / n
    lines = F.split(t, "\n")
    again = (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines)
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    strange = F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^(?:(.)\1*|[^a-záéíóúüñ]*)$"))
    bad = F.when(F.size(words) == 0, 0.0).otherwise(F.size(strange) / F.size(words))
    confidence = ((1 - odd) + (1 - again) + (1 - bad)) / 3 * F.when(n < 50, 0.8).otherwise(1.0)
    errors = F.when(odd > 0.3, 1).otherwise(0) + F.when(again > 0.2, 1).otherwise(0) + F.when(bad > 0.3, 1).otherwise(0)
    short = n < 10
    return F.struct(F.when(short, False).otherwise((confidence > 0.6) & (errors < 2)).alias("valid"), F.when(short, 0.0).otherwise(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0))).alias("confidence"), F.when(short, 1).otherwise(errors).alias("errors"))


def readable_field_name(name: Column) -> Column:
    """Without a type prefix before a capital, camel case and underscores as spaces, words capitalised."""
    bare = F.regexp_replace(name, rf"^(?i:{'|'.join(FIELD_PREFIXES)})(?=\p{{Lu}})", "")
    spaced = F.translate(F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    return capitalised(words_of(spaced))


def jaccard(a: Column, b: Column) -> Column:
    """Of the lower-case word sets; 0 if either is empty."""
    x, y = (F.array_distinct(words_of(F.lower(c))) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def shortened(t: Column, most: int) -> Column:
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


#: How types are called where they are shown, and how much of their text is.
SHOWN = {"P": ("Paragraph", 60, "empty"), "LI": ("List Item", 40, "empty"), "Link": ("Link", 30, "no text"), "TextContent": ("Text", 50, "empty")}


def display_text(kind: Column, text: Column, kids: Column, given: dict[str, Column]) -> Column:
    """What stands for an element in a list of elements: its kind with the beginning of its text, or what else it has; given are its alt, scope, headers, lang, listnumbering and mcid."""
    bare, has = stripped(F.coalesce(text, F.lit(""))), {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in given.items()}
    say = lambda name, most: F.concat(name, F.lit(": "), shortened(bare, most))
    some, n = bare != "", kids.cast("string")
    heading = F.when(some, say(kind, 50)).otherwise(F.concat(kind, F.lit(" (empty)")))
    figure = F.when(has["alt"] != "", F.concat(F.lit("Figure: "), shortened(has["alt"], 40))).when(some, say(F.lit("Figure"), 40)).otherwise("Figure (no alt text)")
    cell = F.when(some, say(kind, 30)).when(has["scope"] != "", F.concat(kind, F.lit(" (scope: "), has["scope"], F.lit(")"))).when(has["headers"] != "", F.concat(kind, F.lit(" (headers: "), F.substring(has["headers"], 1, 20), F.lit("...)"))).otherwise(F.concat(kind, F.lit(" (empty)")))
    items = F.when(has["listnumbering"] != "", F.concat(F.lit("List ("), has["listnumbering"], F.lit(", "), n, F.lit(" items)"))).otherwise(F.concat(F.lit("List ("), n, F.lit(" items)")))
    mark = F.concat(F.lit("MCID "), F.when(has["mcid"] == "", "?").otherwise(has["mcid"]))
    span = F.when(some, say(F.lit("Span"), 40)).when(has["lang"] != "", F.concat(F.lit("Span (lang: "), has["lang"], F.lit(")"))).otherwise("Span (empty)")
    told = F.concat_ws(", ", *[F.when(has[k] != "", F.concat(F.lit(f"{k}: "), F.substring(has[k], 1, 15), F.lit("..."))) for k in ("alt", "lang", "scope", "headers")])
    other = F.when(some, say(kind, 40)).when(kids > 0, F.concat(kind, F.lit(" ("), n, F.lit(" children)"))).when(told != "", F.concat(kind, F.lit(" ("), told, F.lit(")"))).otherwise(kind)
    out = F.when(kind == "StructTreeRoot", F.concat(F.lit("Document Root ("), n, F.lit(" children)"))).when(kind.rlike("^H[1-6]$"), heading).when(kind == "Figure", figure).when(kind == "Table", F.concat(F.lit("Table ("), n, F.lit(" rows)"))).when(kind.isin("TH", "TD"), cell).when(kind == "L", items)
    for name, (shown, most, none) in SHOWN.items():
        out = out.when(kind == name, F.when(some, say(F.lit(shown), most)).otherwise(f"{shown} ({none})"))
    return out.when(kind == "MCID", F.when(some, say(mark, 40)).otherwise(F.concat(mark, F.lit(" (no text)")))).when(kind == "Span", span).otherwise(other)
