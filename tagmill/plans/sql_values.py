"""Values that the SQL of the catalogue states on its own, written out apart from the operators so that a slip in one shows against the other.

Fixed values throughout: each list is what the rules prescribe.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Parent types and the children that each may hold.
MAY_HOLD = {
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
STANDARD = ["Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot", "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Figure", "Formula", "Form"]
TERMINAL = [*STANDARD, "Ruby", "Warichu", "RB", "RT", "RP", "WT", "WP", "TextNode"]
SPEECH = {
    "es": ["de la", "el ", "la ", "que ", "en ", "y ", "por ", "con ", "para ", "es "],
    "en": ["the ", "and ", "of ", "to ", "in ", "is ", "that ", "for ", "it ", "with "],
    "fr": ["le ", "la ", "les ", "de ", "et ", "en ", "que ", "une ", "pour ", "dans "],
    "de": ["der ", "die ", "und ", "den ", "in ", "von ", "zu ", "das ", "mit ", "dem "],
    "it": ["il ", "la ", "di ", "e ", "che ", "in ", "per ", "un ", "del ", "con "],
}
RECOGNISED = {
    "spa": ["de la", "el ", "la ", "que ", "en ", "y ", "por ", "con ", "para ", "es ", "ñ", "á", "é", "í", "ó", "ú", "ü"],
    "eng": ["the ", "and ", "of ", "to ", "in ", "is ", "that ", "for ", "it ", "with ", "th", "wh"],
    "fra": ["le ", "la ", "les ", "de ", "et ", "en ", "que ", "une ", "pour ", "dans ", "ç", "à", "è", "ê", "ë", "î", "ï", "ô", "ù", "û", "ÿ"],
    "deu": ["der ", "die ", "und ", "den ", "in ", "von ", "zu ", "das ", "mit ", "dem ", "ä", "ö", "ü", "ß"],
    "ita": ["il ", "la ", "di ", "e ", "che ", "in ", "per ", "un ", "del ", "con ", "è", "à", "ò", "ù"],
}
CODES = ["es", "es-ES", "es-MX", "es-AR", "es-CO", "es-CL", "es-PE", "es-VE", "en", "en-US", "en-GB", "en-CA", "en-AU", "fr", "fr-FR", "fr-CA", "de", "de-DE", "de-AT", "de-CH", "it", "it-IT", "pt", "pt-PT", "pt-BR", "ru", "ru-RU", "zh", "zh-CN", "zh-TW", "ja", "ja-JP", "ko", "ko-KR", "ar", "ar-SA", "ca", "ca-ES", "eu", "eu-ES", "gl", "gl-ES"]
CATEGORIES = ["Real content tagged", "Role mapping", "Flickering", "Color and contrast", "Sound", "Metadata", "Dictionary", "OCR validation", "Appropriate tags", "Character mappings", "Declared natural language", "Stretchable characters", "Graphics", "Headings", "Tables", "Lists", "Mathematical expressions", "Page headers and footers", "Notes and references", "Optional content", "Embedded files", "Article threads", "Digital signatures", "Non-interactive forms", "XFA", "Security", "Navigation", "Annotations", "Actions", "XObjects", "Fonts"]
#: Checkpoints that a machine can check, and those of the other kind.
CHECKABLE = ["01-003", "01-004", "01-005", "01-007", "02-001", "02-003", "02-004", "28-001", "06-001", "06-002", "06-003", "07-001", "07-002", "11-001", "11-002", "11-006", "13-004", "14-003", "15-003", "28-002", "28-004", "28-011"]
JUDGED = ["01-001", "01-002", "01-006", "02-002", "04-001", "06-004", "09-001", "09-002", "11-007", "13-008", "15-005", "16-001"]
ERRORS = ["01-005", "06-001", "06-002", "06-003", "07-001", "07-002", "13-004", "14-003", "15-003", "28-002", "28-004", "28-011"]
WARNINGS = ["01-006", "02-002", "04-001", "06-004", "11-007", "13-008", "16-001"]


def quoted(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


EDGES = ", ".join(f"('{p}', '{k}')" for p, ks in MAY_HOLD.items() for k in ks)
PARENTS = quoted(MAY_HOLD)
_HOLDS = f"exists (select 1 from (values {EDGES}) v(p, k) where v.p = u.type and v.k = n.type)"
_NONE = "cast(null as bigint) as page, cast(null as varchar) as element_id"


def _say(checkpoint: str, severity: str, words: str, fixable: str = "true") -> str:
    return f"'{checkpoint}' as checkpoint, '{severity}' as severity, {words} as description, {fixable} as fixable"


def node_issues(nodes: str) -> str:
    rules = [
        (f"n.type not in ({quoted(STANDARD)}, 'StructTreeRoot')", _say("01-006", "warning", "'type not standard'")),
        (f"u.type in ({PARENTS}) and n.type not in ('TextContent', 'MCID', 'StructTreeRoot') and not {_HOLDS}", _say("09-002", "warning", "'nested where it may not be'")),
        ("n.type = 'L' and items = 0", _say("09-002", "error", "'list without items'")),
        ("n.type = 'L' and kids > items", _say("09-002", "warning", "'list with what is no item'")),
        ("n.type = 'LI' and parts = 0 and trim(n.text) = ''", _say("09-002", "warning", "'item without parts or text'")),
        ("n.type = 'Table' and row_like = 0", _say("09-002", "error", "'table without rows'")),
        ("n.type = 'TR' and cell_like = 0", _say("09-002", "error", "'row without cells'")),
        ("n.type = 'TH' and n.scope = ''", _say("15-003", "error", "'header cell without scope'")),
        ("n.type in ('TH', 'TD') and trim(n.text) = '' and kids = 0", _say("01-006", "info", "'empty cell'")),
        ("n.type = 'Figure' and n.alt = ''", _say("13-004", "error", "'figure without alternative text'")),
        ("n.type = 'Link' and trim(n.text) = '' and kids = 0", _say("01-006", "warning", "'link without text'")),
    ]
    counts = "select doc_id, parent_id as node_id, count(*) as kids, count(*) filter (where type = 'LI') as items, count(*) filter (where type in ('Lbl', 'LBody')) as parts, count(*) filter (where type in ('TR', 'THead', 'TBody', 'TFoot')) as row_like, count(*) filter (where type in ('TH', 'TD')) as cell_like from nn where parent_id is not null group by all"
    one = f"nn as (select * from ({nodes}) q), kk as ({counts}), u0 as (select n.doc_id, n.node_id, n.parent_id, n.type, n.text, n.page, n.alt, n.scope, u.type as up, coalesce(kids, 0) as kids, coalesce(items, 0) as items, coalesce(parts, 0) as parts, coalesce(row_like, 0) as row_like, coalesce(cell_like, 0) as cell_like from nn n left join nn u on u.doc_id = n.doc_id and u.node_id = n.parent_id left join kk on kk.doc_id = n.doc_id and kk.node_id = n.node_id)"
    parts = [f"select n.doc_id, {say}, n.page, n.node_id as element_id from u0 n where {test.replace('u.type', 'n.up')}" for test, say in rules]
    return f"with {one} {' union all '.join(parts)}"


def tree_issues(nodes: str) -> str:
    walk = f"nn as (select * from ({nodes}) q), t as (select doc_id, node_id, 0 as depth from nn where parent_id is null union all select n.doc_id, n.node_id, t.depth + 1 from nn n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id)"
    sums = "w as (select n.doc_id, max(depth) as deepest, count(*) filter (where type in ('P', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6', 'Figure', 'Table', 'L') or trim(text) <> '') as real_ones, count(*) filter (where type in ('P', 'Figure', 'Table')) as content, count(*) filter (where type = 'Div') as divs from nn n join t on t.doc_id = n.doc_id and t.node_id = n.node_id group by n.doc_id)"
    rules = [
        ("real_ones = 0", _say("01-005", "error", "'no real content tagged'")),
        ("deepest > 10", _say("09-002", "warning", "'nested too deep'")),
        ("content = 0", _say("01-005", "warning", "'no paragraphs, figures or tables'")),
        ("divs > 2 * content", _say("01-006", "info", "'too many divisions'")),
    ]
    return f"with recursive {walk}, {sums} " + " union all ".join(f"select doc_id, {say}, {_NONE} from w where {test}" for test, say in rules)


def heading_issues(headings: str, order: str) -> str:
    """headings with doc_id, page, level, text, element_id and the columns of order."""
    s = f"hh as (select *, coalesce(max(level) over (partition by doc_id order by {order} rows between unbounded preceding and 1 preceding), 0) as seen from ({headings}) q), jj as (select *, lag(level) over (partition by doc_id, page order by {order}) as prev from ({headings}) q where page is not null)"
    skip, jump = "concat('level ', level, ' where ', seen + 1, ' may follow')", "concat('level ', level, ' after ', prev)"
    return f"with {s} select doc_id, {_say('14-003', 'error', skip)}, page, element_id from hh where level > seen + 1 union all select doc_id, {_say('01-006', 'warning', repr('heading without text'))}, page, element_id from hh where trim(text) = '' union all select doc_id, {_say('09-001', 'warning', jump)}, page, cast(null as varchar) from jj where level > prev + 2"


def headings_of(nodes: str) -> str:
    walk = f"with recursive nn as (select * from ({nodes}) q), t as (select doc_id, node_id, [sib] as path from nn where parent_id is null union all select n.doc_id, n.node_id, list_append(t.path, n.sib) from nn n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id)"
    return f"{walk} select n.doc_id, n.page, cast(substring(n.type, 2) as integer) as level, n.text, n.node_id as element_id, t.path from nn n join t on t.doc_id = n.doc_id and t.node_id = n.node_id where regexp_full_match(n.type, 'H[0-9]+')"


VALID = "coalesce(regexp_full_match({}, '[a-z]{{2,3}}(-[A-Z]{{2,3}})?'), false)"


def language_issues(nodes: str, meta: str) -> str:
    walk = f"nn as (select * from ({nodes}) q), mm as (select * from ({meta}) q), t as (select doc_id, node_id, nullif(lang, '') as eff from nn where parent_id is null union all select n.doc_id, n.node_id, coalesce(nullif(n.lang, ''), t.eff) from nn n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id), x as (select n.*, coalesce(t.eff, m.language, '') = '' as lost from nn n join t on t.doc_id = n.doc_id and t.node_id = n.node_id left join mm m on m.doc_id = n.doc_id)"
    rules = [
        ("type in ('P', 'Span', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6') and trim(text) <> '' and lost", _say("11-001", "error", "'text without language'")),
        ("(alt <> '' or actual <> '' or expansion <> '') and lost", _say("11-002", "error", "'description without language'")),
        (f"lang <> '' and not {VALID.format('lang')}", _say("11-007", "warning", "'language of an element not appropriate'")),
    ]
    own = [("not has_lang", _say("11-006", "error", "'language cannot be told'")), (f"has_lang and not {VALID.format('language')}", _say("11-007", "warning", "'language not appropriate'"))]
    return f"with recursive {walk} " + " union all ".join([*[f"select doc_id, {say}, page, node_id as element_id from x where {test}" for test, say in rules], *[f"select doc_id, {say}, {_NONE} from mm where {test}" for test, say in own]])


def annotation_issues(annotations: str, outlines: str, meta: str) -> str:
    mute = f"(select doc_id from ({meta}) q where coalesce(language, '') = '')"
    return f"select doc_id, {_say('11-004', 'warning', repr('annotation without language'))}, page, cast(null as varchar) as element_id from ({annotations}) a where contents <> '' and doc_id in {mute} union all select doc_id, {_say('11-005', 'warning', repr('tooltip without language'))}, page, null from ({annotations}) a where subtype = 'Widget' and tu <> '' and doc_id in {mute} union all select distinct doc_id, {_say('11-003', 'warning', repr('outline without language'))}, {_NONE} from ({outlines}) o where doc_id in {mute}"


#: What is wrong with a title z, best first trimmed, and a file name.
_TITLE = [("z = ''", "blank"), ("z <> '' and lower(z) = lower(filename)", "file name"), ("lower(z) in ('documento', 'document', 'untitled', 'sin título', 'nuevo documento', 'pdf', 'archivo', 'file', 'temp', 'temporal')", "generic"), ("z <> '' and length(z) < 3", "short"), ("length(z) > 200", "long"), (r"regexp_matches(z, '[<>:\"\\|?*\x00-\x1f]')", "characters")]
TRIMMED = r"regexp_replace(coalesce({}, ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


def title_faults(meta: str, title: str) -> str:
    return f"select doc_id, problem from (select doc_id, unnest(list_filter([{', '.join(f'case when {test} then {chr(39)}{name}{chr(39)} end' for test, name in _TITLE)}], lambda v: v is not null)) as problem from (select *, {TRIMMED.format(title)} as z from ({meta}) q) w) v"


def metadata_issues(meta: str) -> str:
    best = "case when coalesce(xmp_title, '') <> '' then xmp_title else coalesce(info_title, '') end"
    odd = r"regexp_matches(lower({}), '^\s*$|^untitled|^document[0-9]*$|^test')"
    bare = TRIMMED.format("language")
    rules = [
        ("not has_xmp", _say("06-001", "error", "'no XMP metadata'")),
        ("has_xmp and not pdf_ua_flag", _say("06-002", "error", "'no conformance identifier'")),
        (f"has_xmp and {best} = ''", _say("06-003", "error", "'no title'")),
        ("not has_viewer_preferences", _say("07-001", "error", "'no viewer preferences'")),
        ("has_viewer_preferences and display_title is null", _say("07-001", "error", "'no entry for the title''s display'")),
        ("has_viewer_preferences and not display_title", _say("07-002", "error", "'title not displayed'")),
        ("not has_lang", _say("11-006", "error", "'no language'")),
        ("has_lang and language = ''", _say("11-006", "error", "'empty language'")),
        (f"has_lang and language <> '' and not regexp_full_match({bare}, '[a-zA-Z]{{2}}(-[a-zA-Z]{{2}})?')", _say("11-007", "error", "'language: format'")),
        (f"has_lang and regexp_full_match({bare}, '[a-zA-Z]{{2}}(-[a-zA-Z]{{2}})?') and lower({bare}) not in ({quoted(c.lower() for c in CODES)})", _say("11-007", "warning", "'language: unknown'")),
        *[(f"{TRIMMED.format(f)} = ''", _say("metadata-quality", "info", f"'no {f}'")) for f in ("author", "subject", "keywords")],
        ("info_title <> '' and xmp_title <> '' and info_title <> xmp_title", _say("metadata-consistency", "warning", "'titles differ'")),
        *[(f"{f} <> '' and {odd.format(f)}", _say("metadata-quality", "info", f"'generic {f}'")) for f in ("title", "author", "subject")],
    ]
    told = title_faults(f"select * from mm where has_xmp and {best} <> ''", best)
    titled = f"select doc_id, {_say('06-004', 'warning', 'concat(' + repr('title: ') + ', problem)')}, {_NONE} from ({told}) f"
    return f"with mm as (select * from ({meta}) q) " + " union all ".join([*[f"select doc_id, {say}, {_NONE} from mm where {test}" for test, say in rules], titled])


SHAPE = "rr as (select table_id, row_id, count(*) as cells, count(*) filter (where kind = 'TH') as heads, count(*) filter (where colspan <> '' or rowspan <> '') as spans from ss group by table_id, row_id), sh as (select table_id, count(*) as n_rows, max(cells) as max_cols, min(cells) as min_cols, count(*) filter (where heads > 0.5 * cells) as header_rows, cast(sum(spans) as bigint) as spans from rr group by table_id), sx as (select *, (n_rows > 3 and max_cols > 3) or header_rows > 1 or spans > 0 as complex from sh)"
DANGLING = "dd as (select table_id, cell_id, unnest(list_filter(regexp_split_to_array(headers, '\\s+'), lambda v: v <> '')) as ref from ss), dx as (select * from dd where not exists (select 1 from ss where ss.table_id = dd.table_id and ss.cell_id = dd.ref))"
SPANS = "pp as (select ss.table_id, row_id, col, span, value, case when try_cast(value as integer) is null then 'not a number' when try_cast(value as integer) <= 0 then 'not positive' when try_cast(value as integer) > most then 'too wide' end as problem from (select ss.table_id, row_id, col, 'colspan' as span, colspan as value, max_cols as most from ss join sx using (table_id) union all select ss.table_id, row_id, col, 'rowspan', rowspan, n_rows from ss join sx using (table_id)) ss where value <> '')"
BY_ID = "bb as (select table_id, bool_or(headers <> '' or cell_id <> '') as by_id from ss group by table_id)"


def table_issues(cells: str) -> str:
    table = [
        ("max_cols - min_cols > 1", _say("table-structure", "warning", "'uneven rows'")),
        ("n_rows > 3 or max_cols > 3", _say("table-accessibility", "info", "'large table without caption'")),
        ("n_heads = 0 and (n_rows > 1 or max_cols > 1)", _say("table-headers", "warning", "'table without header cells'")),
        ("n_full = 0", _say("table-content", "error", "'empty table'")),
    ]
    cell = [
        ("kind = 'TH' and not by_id and scope = ''", _say("15-003", "error", "'header cell without scope'")),
        ("kind = 'TH' and not by_id and scope not in ('', 'Row', 'Col', 'Column', 'Both', 'Rowgroup', 'Colgroup')", _say("15-003", "error", "'unknown scope'")),
        ("kind = 'TH' and not filled", _say("table-headers", "warning", "'empty header cell'")),
        ("kind = 'TH' and by_id and cell_id = ''", _say("15-005", "error", "'header cell without id'")),
        ("kind = 'TD' and complex and by_id and headers = ''", _say("15-005", "warning", "'cell without headers'")),
    ]
    sums = "ww as (select table_id, count(*) filter (where kind = 'TH') as n_heads, count(*) filter (where filled) as n_full from ss group by table_id)"
    parts = [
        *[f"select table_id as doc_id, {say}, {_NONE} from sx join ww using (table_id) where {test}" for test, say in table],
        *[f"select table_id as doc_id, {say}, {_NONE} from ss join sx using (table_id) join bb using (table_id) where {test}" for test, say in cell],
        f"select table_id as doc_id, {_say('15-005', 'error', 'concat(' + repr('no cell ') + ', ref)')}, {_NONE} from dx",
        f"select table_id as doc_id, {_say('table-spanning', 'error', 'concat(span, ' + repr(' ') + ', problem)')}, {_NONE} from pp where problem is not null",
    ]
    return f"with ss as (select * from ({cells}) q), {SHAPE}, {DANGLING}, {SPANS}, {BY_ID}, {sums} {' union all '.join(parts)}"


#: Beginnings of names and the types that they suggest.
NAMES = [("h[0-9]", "H1"), ("head", "H1"), ("title", "H1"), ("heading", "H1"), ("subtitle", "H2"), ("chap", "H1"), ("sect", "Sect"), ("paragraph", "P"), ("para", "P"), ("text", "P"), ("img", "Figure"), ("pic", "Figure"), ("fig", "Figure"), ("table", "Table"), ("row", "TR"), ("cell", "TD"), ("header[a-z0-9_]*cell", "TH"), ("th", "TH"), ("td", "TD"), ("list", "L"), ("item", "LI"), ("(bullet|numbered)list", "L"), ("caption", "Caption"), ("link", "Link"), ("note", "Note"), ("quote", "Quote"), ("formula", "Formula"), ("div", "Div"), ("span", "Span"), ("annotation", "Annot"), ("form", "Form"), ("reference", "Reference")]
BY_NAME = f"case {' '.join(f'when regexp_matches(lower(name), {chr(39)}^{p}{chr(39)}) then {chr(39)}{k}{chr(39)}' for p, k in NAMES)} else 'P' end"


def frame_issues(frames: str, cells: str) -> str:
    """Rows without cells and tables without rows."""
    return f"with ff as (select * from ({frames}) q), cc as (select distinct table_id, row_id from ({cells}) q) select table_id as doc_id, {_say('table-structure', 'warning', 'concat(count(*), ' + repr(' rows without cells') + ')')}, {_NONE} from ff where row_id is not null and (table_id, row_id) not in (select (table_id, row_id) from cc) group by table_id union all select table_id, {_say('table-structure', 'error', repr('table without any row'))}, {_NONE} from ff group by table_id having count(row_id) = 0"


def untagged_issues(pages: str, documents: str) -> str:
    return f"select distinct doc_id, {_say('11-001', 'error', repr('untagged text without language'))}, page, cast(null as varchar) as element_id from ({pages}) q where trim(text) <> '' and doc_id in (select doc_id from ({documents}) d)"


def bare_issues(documents: str, nodes: str) -> str:
    return f"select doc_id, {_say('01-005', 'error', repr('no structure'))}, {_NONE} from ({documents}) d where doc_id not in (select doc_id from ({nodes}) n)"


def contrast_issues(texts: str, ratio: str, need: str) -> str:
    short = "case when length(trim(text)) > 30 then concat(left(trim(text), 30), '...') else trim(text) end"
    return f"select doc_id, {_say('04-001', 'warning', 'concat(' + repr('low contrast: ') + ', ' + short + ')')}, page, element_id from ({texts}) q where trim(text) <> '' and flags & 16 = 0 and {ratio} < {need}"


def colour_issues(elements: str, tags: str, legends: str) -> str:
    """legends: the SQL of legends without words over elements."""
    own = "doc_id, page, font, size"
    many = f"with ee as (select *, row_number() over (order by {own}) as z from ({elements}) q where kind = 'text'), mm as (select {own} from ee group by {own} having count(*) >= 3 and count(distinct color) >= 3), ty as (select distinct e.doc_id, e.page, e.font, e.size, e.color, t.type from ee e join ({tags}) t on t.doc_id = e.doc_id and t.page = e.page and t.elem_id = e.elem_id where color is not null), ok as (select {own} from ty a group by {own} having count(distinct color) >= 2 and count(distinct type) = count(*))"
    return f"select * from ({many} select doc_id, {_say('04-001', 'warning', repr('colour alone: texts of one look'))}, page, cast(null as varchar) as element_id from mm where ({own}) not in (select ({own}) from ok)) c1 union all select doc_id, {_say('04-001', 'warning', repr('colour alone: legend without words'))}, page, cast(null as varchar) as element_id from ({legends}) c2"


def character_issues(spans: str) -> str:
    return f"select doc_id, {_say('10-001', 'info', repr('characters without a mapping'), 'false')}, page, cast(null as varchar) as element_id from ({spans}) q where regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFD}}-\\x{{10FFFF}}]')"


def count_of(pattern: str, column: str = "lo") -> str:
    return f"cast((length({column}) - length(replace({column}, '{pattern}', ''))) / {len(pattern)} as bigint)"


TITLE_SCORE = r"""case when coalesce(title, '') = '' then 0.0 when lower(title) in ('untitled', 'sin título', 'document', 'documento', 'pdf document', 'pdf', 'new document', 'documento nuevo', 'documento pdf', 'archivo pdf', 'pdf file', 'sin nombre', 'doc', 'noname', 'no name', 'unnamed') then 0.1
  else 0.4 * case when length(title) < 3 then 0.1 when length(title) < 10 then 0.4 when length(title) < 100 then least(length(title) / 50, 1.0) else 0.7 end + 0.4 * least(len(list_distinct(list_filter(regexp_split_to_array(lower(title), '[\s\x0b]+'), lambda v: v <> ''))) / 5, 1.0)
  + 0.2 * case when title = upper(title) and title <> lower(title) then 0.4 when title = lower(title) and title <> upper(title) then 0.5 when left(title, 1) = upper(left(title, 1)) and left(title, 1) <> lower(left(title, 1)) then 1.0 else 0.7 end end"""
CAPITALS = "array_to_string(list_transform(list_filter(regexp_split_to_array({}, '\\s+'), lambda v: v <> ''), lambda v: concat(upper(substring(v, 1, 1)), lower(substring(v, 2)))), ' ')"
FILE_TITLE = CAPITALS.format("translate(regexp_replace(filename, '([^/.][^/]*)[.][^./]*$', '\\1'), '-_', '  ')")
READABLE = CAPITALS.format("replace(regexp_replace(regexp_replace(name, '^(?:[tT][xX][tT]|[cC][hH][kK]|[rR][aA][dD]|[cC][mM][bB]|[bB][tT][nN])([A-Z])', '\\1'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')")
GENERIC_ALT = "length(trim(alt)) < 10 or regexp_full_match(lower(trim(alt)), 'imagen|figura|gráfico|foto|imagen [0-9]+|figura [0-9]+|img_[0-9]+|photo|image|picture')"
_SIGN = "•⦿⦾⚫◦◆◊▪▫►▻▶▷◉○⚬●■□"
KIND = rf"case when regexp_matches(text, '^\s*([{_SIGN}]+|[-–—]|[*])\s') then 'bullet' when regexp_matches(text, '^\s*[0-9]+[.)]\s') then 'numbered-decimal' when regexp_matches(text, '^\s*[a-z][.)]\s') then 'numbered-lower-alpha' when regexp_matches(text, '^\s*[A-Z][.)]\s') then 'numbered-upper-alpha' when regexp_matches(text, '^\s*[ivxlcdm]+[.)]\s') then 'numbered-lower-roman' when regexp_matches(text, '^\s*[IVXLCDM]+[.)]\s') then 'numbered-upper-roman' when regexp_matches(text, '^\s*[ivxlcdmIVXLCDM]+[.)]\s') then 'numbered-other' end"
ITEM = r"^\s*([•*+◦▪■○□➢➤➥➨-]|[0-9]+[.)\]]|[IVXLCDMivxlcdm]+[.)\]]|[A-Za-z][.)\]])\s+"
FIRST_NUMBERING = r"case when regexp_matches(text, '^\s*[0-9]+[.)\]]') then 'Decimal' when regexp_matches(text, '^\s*[IVXLCDM]+[.)\]]') then 'UpperRoman' when regexp_matches(text, '^\s*[ivxlcdm]+[.)\]]') then 'LowerRoman' when regexp_matches(text, '^\s*[A-Z][.)\]]') then 'UpperAlpha' when regexp_matches(text, '^\s*[a-z][.)\]]') then 'LowerAlpha' end"
OCR = r"""select doc_id, case when n < 10 then 0.0 else round(conf, 6) end as confidence, n >= 10 and conf > 0.6 and errors < 2 as valid, case when n < 10 then 1 else errors end as errors from (select doc_id, n, ((1 - odd) + (1 - again) + (1 - bad)) / 3 * case when n < 50 then 0.8 else 1.0 end as conf,
  case when odd > 0.3 then 1 else 0 end + case when again > 0.2 then 1 else 0 end + case when bad > 0.3 then 1 else 0 end as errors from (select doc_id, n, length(regexp_replace(t, '[\pL\p{Nd}\s.,\-:;?!()\[\]{}\x22''/]', '', 'g')) / n as odd, (len(ls) - len(list_distinct(ls))) / len(ls) as again,
  case when len(ws) = 0 then 0.0 else len(list_filter(ws, lambda v: length(v) > 2 and (replace(v, left(v, 1), '') = '' or regexp_full_match(v, '[^a-záéíóúüñ]+')))) / len(ws) end as bad from (select doc_id, t, length(t) as n, string_split(t, chr(10)) as ls, regexp_extract_all(lower(t), '[\pL\pN_]+') as ws from (select doc_id, coalesce(text, '') as t from documents) a) b) c) d"""

#: Nodes with how they look: f.
LOOKS = r"""with n as (select * from {s} x),
 h as (select n.*, u.type as parent_type, trim(n.text) as bare, regexp_matches(n.text, '^\s*([•*○●■□▪▫◦»~+-]|[0-9]+[.)]|[a-zA-Z][.)])\s+') as like_item, regexp_matches(n.text, '^\s*([•*○●■□▪▫◦»~+-]|[0-9]+[.)]|[a-zA-Z][.)])$') as like_label from n left join n u on u.doc_id = n.doc_id and u.node_id = n.parent_id),
 k1 as (select doc_id, parent_id, count(*) as kids, count(*) filter (where type in ('TH', 'TD')) >= 0.5 * count(*) as like_row, count(*) filter (where type = 'LI' or like_item) >= 0.5 * count(*) as like_list from h where parent_id is not null group by all),
 h1 as (select h.*, coalesce(kids, 0) as kids, coalesce(like_row, false) as like_row, coalesce(like_list, false) as like_list from h left join k1 on k1.doc_id = h.doc_id and k1.parent_id = h.node_id),
 k2 as (select doc_id, parent_id, count(*) filter (where type = 'TR' or like_row) >= 0.5 * count(*) as like_table from h1 where parent_id is not null group by all),
 f as (select h1.*, coalesce(like_table, false) as like_table, text <> '' and length(bare) < 100 and (right(bare, 1) = ':' or regexp_matches(bare, '^[0-9]+(\.[0-9]+)*\.?\s+') or (kids <= 1 and length(bare) < 50 and right(bare, 1) <> '.')) as like_heading,
   text <> '' and len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 10 and regexp_matches(lower(text), 'fig|figure|imagen|image|ilustración|illustration|foto|photo|gráfico|graph|chart|diagrama|diagram') as like_figure from h1 left join k2 on k2.doc_id = h1.doc_id and k2.parent_id = h1.node_id)"""
#: What the repairs let the parents of the sample hold.
REPAIR_EDGES = {
    "Document": ["Part", "Art", "Sect", "Div", "P", "H1", "L", "Table", "Figure", "Formula", "Form", "TOC", "Index"],
    "Sect": ["Part", "Sect", "Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure", "Formula", "Form"],
    "Div": ["P", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure", "Formula", "Form", "Div"],
    "L": ["Caption", "LI"],
    "LI": ["Lbl", "LBody"],
    "Table": ["Caption", "TR", "THead", "TBody", "TFoot"],
    "TR": ["TH", "TD"],
}
_MAY = "case parent_type " + " ".join(f"when '{p}' then [{quoted(ks)}]" for p, ks in REPAIR_EDGES.items()) + " end"
FITTING = rf"""g0 as (select *, {_MAY} as may, case when text = '' and kids = 0 then 'Div' when like_heading then case when parent_type in ('Document', 'Part', 'Art') then 'H1' when parent_type = 'Sect' then 'H2' else 'H3' end when like_figure then 'Figure' when like_table then 'Table' when like_list then 'L' when like_item then 'LI' when parent_type = 'Table' then 'TR' when parent_type = 'TR' then 'TD' when parent_type = 'L' then 'LI' when parent_type = 'LI' then case when like_label then 'Lbl' else 'LBody' end else 'P' end as fitting from f),
 g as (select *, case when may is null or list_contains(may, type) then type when list_contains(may, fitting) then fitting when list_contains(may, 'P') then 'P' when list_contains(may, 'Span') then 'Span' when list_contains(may, 'Div') then 'Div' else may[1] end as child_type from g0)"""
