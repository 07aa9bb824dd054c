"""The registered queries and the SQL that says what each returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.functions import colour as c
from tagmill.functions import geometry as g
from tagmill.functions import text as t
from tagmill.operators import conformance, editing, export, issues, layout, lists, matching, metadata, repairs, tables, tree
from tagmill.plans import documents, marks  # noqa: F401 - they register their queries
from tagmill.plans import fixtures as fx
from tagmill.plans import ordering
from tagmill.plans import sql_values as v
from tagmill.plans.fixtures import frame
from tagmill.plans.registry import ORACLES, QUERIES, of_many, over, table
from tagmill.sources import pages as pg

K = ", ".join(fx.ORDER)

# ---- trees ---------------------------------------------------------------------------

over(fx.HEADINGS, "heading_skip", f"select doc_id, {K}, level, expected from (select *, coalesce(max(level) over (partition by doc_id order by {K} rows between unbounded preceding and 1 preceding), 0) + 1 as expected from {{s}} h) t where level > expected")(lambda h: tree.heading_skips(h, "doc_id", fx.ORDER).select("doc_id", *fx.ORDER, "level", "expected"))
over(fx.HEADINGS, "heading_repair", f"select doc_id, {K}, level, i + min(level - i) over (partition by doc_id order by {K} rows between unbounded preceding and current row) as fixed from (select *, row_number() over (partition by doc_id order by {K}) as i from {{s}} h) t")(lambda h: tree.repaired_levels(h, "doc_id", fx.ORDER).select("doc_id", *fx.ORDER, "level", "fixed"))
over(fx.HEADINGS, "page_heading_jump", f"select doc_id, page, {K}, level, previous from (select *, lag(level) over (partition by doc_id, page order by {K}) as previous from {{s}} h) t where level > previous + 2")(lambda h: tree.page_jumps(h, "doc_id", "page", fx.ORDER).select("doc_id", "page", *fx.ORDER, "level", "previous"))

over(fx.NODES, "illegal_nesting", f"with n as (select * from {{s}} x), g(p, k) as (values {v.EDGES}) select k.doc_id, k.node_id, k.parent_id, k.type, u.type as parent_type from n k join n u on u.doc_id = k.doc_id and u.node_id = k.parent_id where u.type in ({v.PARENTS}) and k.type not in ('TextContent', 'MCID', 'StructTreeRoot') and not exists (select 1 from g where g.p = u.type and g.k = k.type)")(lambda n: tree.illegal_nesting(n).select("doc_id", "node_id", "parent_id", "type", "parent_type"))
over(fx.NODES, "list_rules", "with n as (select * from {s} x) select l.doc_id, l.node_id, count(*) filter (where k.type = 'LI') as items, count(*) filter (where k.type <> 'LI') as others from n l left join n k on k.doc_id = l.doc_id and k.parent_id = l.node_id where l.type = 'L' group by l.doc_id, l.node_id")(tree.list_rules)
over(fx.NODES, "max_depth", "with recursive n as (select * from {s} x), t as (select doc_id, node_id, 0 as depth from n where parent_id is null union all select n.doc_id, n.node_id, t.depth + 1 from n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id) select doc_id, max(depth) as max_depth from t group by doc_id")(lambda n: tree.depths(n).groupBy("doc_id").agg(F.max("depth").alias("max_depth")))
over(fx.NODES, "tree_stats", "with recursive n as (select * from {s} x), t as (select doc_id, node_id, 0 as depth from n where parent_id is null union all select n.doc_id, n.node_id, t.depth + 1 from n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id) select doc_id, count(*) as nodes, max(depth) as max_depth, count(*) filter (where trim(text) <> '') as with_text, count(distinct type) as types from n join t using (doc_id, node_id) group by doc_id")(tree.statistics)
over(fx.NODES, "lang_inheritance", "with recursive n as (select * from {s} x), t as (select doc_id, node_id, nullif(lang, '') as eff_lang from n where parent_id is null union all select n.doc_id, n.node_id, coalesce(nullif(n.lang, ''), t.eff_lang) from n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id) select * from t")(tree.effective_languages)
over(fx.NODES, "subtree_delete", "with recursive n as (select * from {s} x), t as (select doc_id, node_id from n where type = 'L' union all select n.doc_id, n.node_id from n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id) select doc_id, node_id, type from n where (doc_id, node_id) not in (select doc_id, node_id from t)")(lambda n: tree.without_subtrees(n, n.where("type = 'L'").select("doc_id", "node_id")).select("doc_id", "node_id", "type"))
over(fx.NODES, "ancestor_search", "with recursive n as (select * from {s} x), t as (select doc_id, node_id, parent_id from n where lower(text) like '%urgent%' union select n.doc_id, n.node_id, n.parent_id from n join t on n.doc_id = t.doc_id and n.node_id = t.parent_id) select distinct doc_id, node_id from t")(lambda n: tree.ancestors(n, n.where(F.contains(F.lower("text"), F.lit("urgent"))).select("doc_id", "node_id")).select("doc_id", "node_id").distinct())
over(fx.NODES, "common_ancestor", "with recursive n as (select * from {s} x), w as (select doc_id, node_id, lead(node_id) over (partition by doc_id order by node_id) as b from n), a as (select doc_id, node_id as start, node_id, parent_id, 0 as up from n union all select n.doc_id, a.start, n.node_id, n.parent_id, a.up + 1 from n join a on n.doc_id = a.doc_id and n.node_id = a.parent_id) select w.doc_id, w.node_id as a, w.b, min_by(p.node_id, p.up) as common from w join a p on p.doc_id = w.doc_id and p.start = w.node_id join a q on q.doc_id = w.doc_id and q.start = w.b and q.node_id = p.node_id where w.b is not null group by all")(lambda n: tree.common_ancestors(n, tree.next_pairs(n)))
over(fx.ROLES, "role_map_terminal", f"with recursive m as (select * from {{s}} x), t as (select doc_id, custom, mapped as hop, [custom] as seen, 1 as steps from m union all select t.doc_id, t.custom, m.mapped, list_append(t.seen, t.hop), t.steps + 1 from t join m on m.doc_id = t.doc_id and m.custom = t.hop where not list_contains(t.seen, t.hop) and t.hop not in ({v.quoted(v.TERMINAL)})) select doc_id, custom, max_by(case when list_contains(seen, hop) then 'CYCLE' else hop end, steps) as terminal from t group by doc_id, custom")(tree.terminal_types)
over(fx.ROLES, "role_map_cycles", "with recursive m as (select * from {s} x), t as (select doc_id, custom, mapped as hop, [custom] as seen, 1 as steps from m union all select t.doc_id, t.custom, m.mapped, list_append(t.seen, t.hop), t.steps + 1 from t join m on m.doc_id = t.doc_id and m.custom = t.hop where not list_contains(t.seen, t.hop)) select doc_id, custom, steps as length from t where hop = custom")(tree.map_cycles)
over(fx.NAMES, "type_by_name_pattern", f"select id, {v.BY_NAME} as type from {{s}} x")(lambda p: p.select("id", tree.type_by_name(F.col("name")).alias("type")))
over("select page_id, html from pages", "tag_inventory", "select tag, count(*) as n, count(distinct page_id) as pages from (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<([a-z][a-z0-9]*)', 1)) as tag from {s} x) t group by tag")(lambda p: pg.tags(p).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages")))
over("select page_id, html from pages", "page_nodes")(lambda p: pg.nodes(p).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("text_chars")))

# ---- tables --------------------------------------------------------------------------

_SHAPE = f"with ss as (select * from {{s}} x), {v.SHAPE}"
over(fx.CELLS, "table_shape", f"{_SHAPE} select * from sx")(tables.shape)
over(fx.CELLS, "ragged_tables", f"{_SHAPE} select * from sx where max_cols - min_cols > 1")(tables.ragged)
over(fx.CELLS, "complex_tables", f"{_SHAPE} select table_id, n_rows, max_cols from sx where complex")(lambda s: tables.shape(s).where("complex").select("table_id", "n_rows", "max_cols"))
over(fx.CELLS, "row_mode_outliers", f"{_SHAPE}, z as (select table_id, cells, count(*) as n, min(row_id) as first from rr group by table_id, cells), m as (select *, row_number() over (partition by table_id order by n desc, first) as k from z) select rr.table_id, rr.row_id, rr.cells, m.cells as mode from rr join m on rr.table_id = m.table_id and m.k = 1 where rr.cells <> m.cells")(tables.row_outliers)
over(fx.CELLS, "header_columns", "with s as (select *, greatest(coalesce(try_cast(colspan as integer), 1), 1) as w from {s} x), a as (select *, coalesce(sum(w) over (partition by table_id, row_id order by col rows between unbounded preceding and 1 preceding), 0) as st from s), o as (select table_id, kind, unnest(range(cast(st as bigint), cast(st + w as bigint))) as col_at from a), b as (select table_id, col_at, count(*) as cells, count(*) filter (where kind = 'TH') as heads from o group by table_id, col_at) select table_id, col_at as \"column\", cells, heads from b where heads > 0.5 * cells")(tables.header_columns)
over(fx.CELLS, "header_ref_integrity", "with s as (select * from {s} x), r as (select table_id, cell_id, unnest(list_filter(string_split(headers, ' '), lambda x: x <> '')) as ref from s) select table_id, ref, cell_id from r where not exists (select 1 from s where s.table_id = r.table_id and s.cell_id = r.ref)")(tables.dangling_headers)
over(fx.CELLS, "span_validity", f"{_SHAPE}, {v.SPANS} select * from pp where problem is not null")(lambda s: tables.bad_spans(s).select("table_id", "row_id", "col", "span", "value", "problem"))
over(fx.CELLS, "scope_suggestion", f"{_SHAPE}, {v.BY_ID} select table_id, row_id, col, case when scope = '' then 'missing' else 'unknown' end as problem, case when n_rows > max_cols then 'Col' else 'Row' end as suggested from ss join sx using (table_id) join bb using (table_id) where kind = 'TH' and not by_id and scope not in ('Row', 'Col', 'Column', 'Both', 'Rowgroup', 'Colgroup')")(lambda s: tables.bad_scopes(s).select("table_id", "row_id", "col", "problem", "suggested"))
over(fx.CELLS, "scope_repair", f"{_SHAPE}, w as (select *, greatest(coalesce(try_cast(colspan as integer), 1), 1) as w from ss), a as (select *, coalesce(sum(w) over (partition by table_id, row_id order by col rows between unbounded preceding and 1 preceding), 0) as st from w), o as (select table_id, kind, unnest(range(cast(st as bigint), cast(st + w as bigint))) as at_col from a), hc as (select table_id, at_col + 1 as col from o group by table_id, at_col having count(*) filter (where kind = 'TH') > 0.5 * count(*)), f as (select table_id, min(row_id) as first_row from ss group by table_id), t as (select table_id from ss group by table_id having not bool_or(headers <> '')) select ss.table_id, ss.row_id, ss.col, case when ss.row_id = first_row or rr.heads > 0.5 * rr.cells then 'Column' when hc.col is not null then 'Row' else 'Both' end as suggested from ss join t using (table_id) join f using (table_id) join rr on rr.table_id = ss.table_id and rr.row_id = ss.row_id left join hc on hc.table_id = ss.table_id and hc.col = ss.col where kind = 'TH' and scope = ''")(lambda s: tables.repaired_scopes(s).select("table_id", "row_id", "col", "suggested"))

# ---- language, metadata, text --------------------------------------------------------




_COVERED = ", ".join(f"({' + '.join(f'{v.count_of(p)} * {len(p)}' for p in ps)}) / {len(ps)} as {k}" for k, ps in v.RECOGNISED.items())
over("select doc_id, text from documents", "ocr_language", f"select doc_id, case when text is null or length(text) < 20 then 'eng' else case greatest({', '.join(v.RECOGNISED)}) {' '.join(f"when {k} then '{k}'" for k in v.RECOGNISED)} end end as detected from (select doc_id, text, {_COVERED} from (select doc_id, text, lower(text) as lo from {{s}} x) a) b")(lambda d: d.select("doc_id", t.recognised_language(F.col("text")).alias("detected")))
_SCORES = ", ".join(f"{' + '.join(v.count_of(p) for p in ps)} as {k}" for k, ps in v.SPEECH.items())
over("select doc_id, text from documents", "doc_language", f"select doc_id, case greatest(es, en, fr, de, it) when es then 'es-ES' when en then 'en-US' when fr then 'fr-FR' when de then 'de-DE' else 'it-IT' end as detected from (select doc_id, {_SCORES} from (select doc_id, lower(coalesce(text, '')) as lo from {{s}} x) a) b")(lambda d: d.select("doc_id", t.detected_language(F.col("text")).alias("detected")))
over(fx.META, "lang_code_check", f"select doc_id, language, {v.VALID.format('language')} as valid from {{s}} x")(lambda m: m.select("doc_id", "language", t.valid_language(F.col("language")).alias("valid")))
over(fx.META, "lang_code_rules", f"select doc_id, case when z = '' then 'blank' when not regexp_full_match(z, '[a-zA-Z]{{2}}(-[a-zA-Z]{{2}})?') then 'format' when lower(z) not in ({v.quoted(c.lower() for c in v.CODES)}) then 'unknown' end as problem from (select doc_id, trim(language) as z from {{s}} x) y".replace("{{2}}", "{2}"))(lambda m: m.select("doc_id", t.language_problem(F.col("language")).alias("problem")))
over(fx.CODES, "lang_suggestions", f"select doc_id, case when base in ('en', 'es', 'fr', 'de', 'it', 'pt', 'ru', 'zh', 'ja', 'ko', 'ar', 'hi') then concat(base, ',', base, '-', upper(base), case base when 'en' then ',en-US,en-GB' when 'es' then ',es-ES,es-MX' when 'fr' then ',fr-FR,fr-CA' when 'pt' then ',pt-BR,pt-PT' when 'zh' then ',zh-CN,zh-TW' else '' end) else 'en-US,es-ES,fr-FR,de-DE' end as codes from (select *, split_part(language, '-', 1) as base from {{s}} x) y where not {v.VALID.format('language')}")(metadata.suggestions)
_REPAIR = [("es", "es-ES"), ("en", "en-US"), ("fr", "fr-FR"), ("de", "de-DE"), ("it", "it-IT"), ("pt", "pt-PT"), ("ru", "ru-RU"), ("zh", "zh-CN"), ("ja", "ja-JP"), ("ar", "ar-SA"), ("ca", "ca-ES")]
over(fx.CODES, "lang_repair", f"select doc_id, case {' '.join(f"when lower(language) = '{a}' then '{b}'" for a, b in _REPAIR)} {' '.join(f"when contains(lower(language), '{a}') then '{b}'" for a, b in _REPAIR)} else 'es-ES' end as code from {{s}} x")(lambda m: m.select("doc_id", t.repaired_language(F.col("language")).alias("code")))
over(fx.CODES, "reading_mode", "select doc_id, case when split_part(lower(language), '-', 1) in ('ar', 'he', 'fa', 'ur', 'yi', 'dv', 'ha', 'ps', 'ug') then 'rl-tb' when lower(language) in ('ja-jp', 'ko-kr') then 'tb-lr' when split_part(lower(language), '-', 1) in ('zh', 'ja', 'ko') then 'tb-rl' else 'lr-tb' end as mode from {s} x")(lambda m: m.select("doc_id", t.reading_mode(F.col("language")).alias("mode")))
over(fx.META, "title_rules", v.title_faults("select * from {s} x", "title"))(metadata.title_problems)
over(fx.META, "title_score", f"select doc_id, round({v.TITLE_SCORE}, 6) as score from {{s}} x")(lambda m: m.select("doc_id", F.round(t.title_score(F.col("title")), 6).alias("score")))
over(fx.META, "filename_title", f"select doc_id, {v.FILE_TITLE} as title from {{s}} x")(lambda m: m.select("doc_id", t.title_of_filename(F.col("filename")).alias("title")))
_FULL = "round((case when title <> '' then 1 else 0 end + case when author <> '' then 1 else 0 end + case when subject <> '' then 1 else 0 end + case when language <> '' then 1 else 0 end + case when pdf_ua_flag then 1 else 0 end + case when display_title then 1 else 0 end) / 6 * 100, 6)"
_READY = "has_xmp and pdf_ua_flag and title <> '' and coalesce(display_title, false) and has_lang"
_ADVICE = "concat_ws('; ', case when title = '' then 'add a title' end, case when author = '' then 'name the author' end, case when subject = '' then 'describe the content' end, case when coalesce(keywords, '') = '' then 'add keywords' end, case when not pdf_ua_flag then 'add the conformance identifier' end, case when not coalesce(display_title, false) then 'display the title' end, case when not has_lang then 'declare a language' end)"
over(fx.META, "metadata_completeness", f"select doc_id, {_FULL} as completeness from {{s}} x")(lambda m: metadata.completeness(m).select("doc_id", F.round("completeness", 6).alias("completeness")))
over(fx.META, "metadata_ready", f"select doc_id, {_READY} as ready from {{s}} x")(metadata.ready)
over(fx.META, "metadata_report", f"with c as (select doc_id, count(*) as total, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity = 'info') as infos from ({v.metadata_issues('select * from {s} y')}) i group by doc_id) select doc_id, coalesce(total, 0) as total, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos, coalesce(errors, 0) = 0 as compliant, {_FULL} as completeness, {_READY} as ready, {_ADVICE} as advice from {{s}} x left join c using (doc_id)")(lambda m: metadata.report(m).withColumn("completeness", F.round("completeness", 6)))
over(fx.META, "metadata_repair", f"select doc_id, case when {v.TITLE_SCORE} < 0.5 then {v.FILE_TITLE} else title end as title, case when {v.VALID.format('language')} then language else case when lower(language) in ('') then 'es-ES' {' '.join(f"when lower(language) = '{a}' then '{b}'" for a, b in _REPAIR)} {' '.join(f"when contains(lower(language), '{a}') then '{b}'" for a, b in _REPAIR)} else 'es-ES' end end as language, true as pdf_ua_flag, true as display_title from {{s}} x")(metadata.repaired)
over(fx.META, "metadata_patches", f"with r as ({ORACLES['metadata_repair']}), m as (select * from {{s}} x), u as (select m.doc_id, 'title' as column_name, m.title as old, r.title as new from m join r using (doc_id) union all select m.doc_id, 'language', m.language, r.language from m join r using (doc_id) union all select m.doc_id, 'pdf_ua_flag', cast(m.pdf_ua_flag as varchar), 'true' from m union all select m.doc_id, 'display_title', cast(m.display_title as varchar), 'true' from m) select * from u where old is distinct from new")(lambda m: metadata.patches(m).withColumnRenamed("column", "column_name"))
over(fx.META, "metadata_issues", v.metadata_issues("select * from {s} y"))(issues.of_metadata)
over(fx.META, "metadata_recommendations", f"select doc_id, {_ADVICE} as advice from {{s}} x")(metadata.recommendations)
over("select doc_id, text from documents", "normalize_text", r"select doc_id, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) as digest from {s} x")(lambda d: d.select("doc_id", F.md5(t.normalised(F.col("text"))).alias("digest")))
over("select doc_id, text from documents", "text_quality", r"select doc_id, case when trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' then '' else concat_ws(',', case when contains(text, '  ') then 'double space' end, case when length(text) > 1000 then 'long' end, case when length(regexp_replace(text, '[\pL\pN \t\n\r.,;:!?\-()\[\]{}]', '', 'g')) / length(text) > 0.3 then 'special' end) end as problems from {s} x")(lambda d: d.select("doc_id", t.text_problems(F.col("text")).alias("problems")))
over("select doc_id, text from documents", "ocr_quality", v.OCR)(lambda d: d.withColumn("q", t.recognition(F.col("text"))).select("doc_id", F.round("q.confidence", 6).alias("confidence"), "q.valid", "q.errors"))
over("select item_id, case item_id % 6 when 0 then 'imagen 12' when 1 then ' Foto ' when 2 then 'IMG_1234567' when 3 then 'figura 1234567' when 4 then 'figura 1234567 b' else text end as alt from benchmark", "generic_alt", f"select item_id, {v.GENERIC_ALT} as generic from {{s}} x")(lambda b: b.select("item_id", t.generic_alt(F.col("alt")).alias("generic")))
over("select doc_id as image_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then '##!@#~~' else substring(text, 1, 40) end as text, case when doc_id % 5 = 0 then '' else concat('img-', lang, '_', cast(doc_id as string), '.tar.png') end as file_name, doc_id % 2 = 0 as text_image from documents", "alt_text", f"select image_id, case when valid and confidence >= 0.6 then 'ocr' when file_name <> '' then 'filename' else 'default' end as source, case when valid and confidence >= 0.6 and text_image then 'ActualText' else 'Alt' end as attribute, md5(case when valid and confidence >= 0.6 then text when file_name <> '' then {v.CAPITALS.format("translate(regexp_replace(file_name, '[.][^.]*$', ''), '-_', '  ')")} else 'Imagen sin descripción disponible' end) as digest from ({v.OCR.replace('from documents', 'from {s} i').replace('doc_id', 'image_id').replace('round(conf, 6)', 'conf')}) o join {{s}} x using (image_id)")(lambda i: matching.alt_texts(i).select("image_id", "source", "attribute", F.md5("chosen").alias("digest")))

# ---- colour --------------------------------------------------------------------------


def _lin(x: str) -> str:
    return f"case when {x} / 255 <= 0.03928 then {x} / 255 / 12.92 else pow(({x} / 255 + 0.055) / 1.055, 2.4) end"


def _lum(r: str, gr: str, b: str) -> str:
    return f"(0.2126 * {_lin(r)} + 0.7152 * {_lin(gr)} + 0.0722 * {_lin(b)})"


def _ratio(a: tuple, b: tuple) -> str:
    return f"((greatest({_lum(*a)}, {_lum(*b)}) + 0.05) / (least({_lum(*a)}, {_lum(*b)}) + 0.05))"




def _rgb(*names: str) -> tuple:
    return tuple(F.col(n) for n in names)


_R = _ratio(("r", "g", "b"), ("br", "bg", "bb"))
_NEED = "case when size >= 18 or (bold and size >= 14) then 3.0 else 4.5 end"
over(fx.COLOURS, "contrast_ratio", f"select doc_id, {K}, round({_R}, 6) as ratio, case when {_R} >= 7 then 'AAA' when {_R} >= 4.5 then 'AA' when {_R} >= 3 then 'AA large' else 'insufficient' end as level from {{s}} x")(lambda x: x.withColumn("q", c.contrast_ratio(_rgb("r", "g", "b"), _rgb("br", "bg", "bb"))).select("doc_id", *fx.ORDER, F.round("q", 6).alias("ratio"), c.level_description(F.col("q")).alias("level")))
over(fx.COLOURS, "contrast_issues", f"select doc_id, {K}, round({_R}, 6) as ratio, {_NEED} as need from {{s}} x where {_R} < {_NEED}")(lambda x: x.withColumn("q", c.contrast_ratio(_rgb("r", "g", "b"), _rgb("br", "bg", "bb"))).withColumn("need", c.required_ratio(F.col("size"), F.col("bold"))).where("q < need").select("doc_id", *fx.ORDER, F.round("q", 6).alias("ratio"), "need"))
_HEX = "concat('#', lower(lpad(printf('%x', {}), 2, '0')), lower(lpad(printf('%x', {}), 2, '0')), lower(lpad(printf('%x', {}), 2, '0')))"
over(fx.COLOURS, "rgb_hex_visibility", f"select doc_id, {K}, {_HEX.format('r', 'g', 'b')} as hex, case when (0.299 * r + 0.587 * g + 0.114 * b) / 255 > 0.5 then 'light' else 'dark' end as visibility from {{s}} x".replace("{{s}}", "{s}"))(lambda x: x.select("doc_id", *fx.ORDER, c.hex_of(*_rgb("r", "g", "b")).alias("hex"), c.visibility(*_rgb("r", "g", "b")).alias("visibility")))
over("select p_partkey, case p_partkey % 7 when 0 then 'Red' when 1 then '#0aF' when 2 then concat('#00ff', lpad(cast(p_size as string), 2, '0')) when 3 then concat('rgb(', cast(p_size as string), ', 2,3)') when 4 then 'rgba(1,2,3,0.5)' when 5 then 'navy' else 'none' end as txt from part", "color_parse", "select p_partkey, case p_partkey % 7 when 0 then 255 when 1 then 0 when 2 then 0 when 3 then p when 4 then 1 when 5 then 0 end as r, case p_partkey % 7 when 0 then 0 when 1 then 170 when 2 then 255 when 3 then 2 when 4 then 2 when 5 then 0 end as g from (select p_partkey, p_size as p from part) y")(lambda x: x.withColumn("v", c.parsed(F.col("txt"))).select("p_partkey", "v.r", "v.g"))
_MAX, _MIN = "greatest(r, g, b)", "least(r, g, b)"
over(fx.COLOURS, "rgb_hsl", f"select doc_id, {K}, cast(round_even(hh * 60, 0) as integer) as h, cast(round_even(ss * 100, 0) as integer) as s, cast(round_even(l * 100, 0) as integer) as l from (select *, (hi + lo) / 2 as l, case when hi = lo then 0 when (hi + lo) / 2 > 0.5 then (hi - lo) / (2 - hi - lo) else (hi - lo) / (hi + lo) end as ss, case when hi = lo then 0 when hi = x then (y - z) / (hi - lo) + case when y < z then 6 else 0 end when hi = y then (z - x) / (hi - lo) + 2 else (x - y) / (hi - lo) + 4 end as hh from (select *, r / 255 as x, g / 255 as y, b / 255 as z, greatest(r, g, b) / 255 as hi, least(r, g, b) / 255 as lo from {{s}} q) a) c")(lambda x: x.withColumn("v", c.to_hsl(*_rgb("r", "g", "b"))).select("doc_id", *fx.ORDER, "v.h", "v.s", "v.l"))
_DARK = tuple(f"floor({x} * cast(0.7 as double))" for x in "rgb")
_LIGHT = tuple(f"floor({x} + (255 - {x}) * cast(0.7 as double))" for x in ("br", "bg", "bb"))
_BG = ("br", "bg", "bb")
over(fx.COLOURS, "color_suggestions", f"select doc_id, {K}, case when {_ratio(_DARK, _BG)} >= {_NEED} then 'darken text' when {_ratio(('r', 'g', 'b'), _LIGHT)} >= {_NEED} then 'lighten background' when {_ratio(_DARK, _LIGHT)} >= {_NEED} then 'both' when {_ratio(('0', '0', '0'), _BG)} >= {_ratio(('255', '255', '255'), _BG)} then 'black text' else 'white text' end as suggestion from {{s}} x where {_R} < {_NEED}")(lambda x: x.withColumn("need", c.required_ratio(F.col("size"), F.col("bold"))).where(c.contrast_ratio(_rgb("r", "g", "b"), _rgb("br", "bg", "bb")) < F.col("need")).select("doc_id", *fx.ORDER, c.suggestion(_rgb("r", "g", "b"), _rgb("br", "bg", "bb"), F.col("need")).alias("suggestion")))
over(fx.BOXES, "page_background", "select doc_id, page, min_by(color, elem_id) as color from {s} x where (x1 - x0) * (y1 - y0) > 500 group by doc_id, page")(lambda b: b.where(g.area(g.rect()) > 500).groupBy("doc_id", "page").agg(F.min_by("color", "elem_id").alias("color")))
over(fx.BOXES, "colored_text_groups", "select page, font, size, count(*) as items, count(distinct color) as colors from {s} x group by page, font, size having count(*) >= 3 and count(distinct color) >= 3")(lambda b: b.groupBy("page", "font", "size").agg(F.count("*").alias("items"), F.countDistinct("color").alias("colors")).where("items >= 3 and colors >= 3"))

# ---- geometry ------------------------------------------------------------------------

_PAIR = "with s as (select * from {s} x), p as (select a.doc_id, a.elem_id as a_elem_id, b.elem_id as b_elem_id, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as o, (a.x1 - a.x0) * (a.y1 - a.y0) as aa, (b.x1 - b.x0) * (b.y1 - b.y0) as ba from s a join s b on a.doc_id = b.doc_id and a.page = b.page)"
over(fx.BOXES, "overlap_pairs", f"{_PAIR} select doc_id, a_elem_id, b_elem_id, round(o / least(aa, ba), 6) as ratio from p where a_elem_id < b_elem_id and o / least(aa, ba) >= 0.5")(lambda b: layout.overlaps(b).select("doc_id", "a_elem_id", "b_elem_id", F.round("ratio", 6).alias("ratio")))
over(fx.BOXES, "bbox_ops", f"{_PAIR} select doc_id, a_elem_id, b_elem_id, o as overlap, o >= 0.9 * aa as a_in_b, ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1 as touching, case when abs((bx0 + bx1) / 2 - (ax0 + ax1) / 2) > abs((by0 + by1) / 2 - (ay0 + ay1) / 2) then case when (bx0 + bx1) / 2 > (ax0 + ax1) / 2 then 'LR' else 'RL' end else case when (by0 + by1) / 2 > (ay0 + ay1) / 2 then 'TB' else 'BT' end end as direction from p where a_elem_id < b_elem_id")(
    lambda b: layout.paired(b).select("doc_id", "a_elem_id", "b_elem_id", g.overlap_area(g.rect("a_"), g.rect("b_")).alias("overlap"), g.contained(g.rect("a_"), g.rect("b_")).alias("a_in_b"), g.touching(g.rect("a_"), g.rect("b_")).alias("touching"), g.direction(g.rect("a_"), g.rect("b_")).alias("direction"))
)
over(fx.BOXES, "combined_bbox", "select doc_id, page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from {s} x group by doc_id, page")(lambda b: b.groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")))
_LINE = "with s as (select * from {s} x), m as (select *, max(y1) over (partition by doc_id, page order by y0, x0, elem_id rows between unbounded preceding and 1 preceding) as reach from s), l as (select *, sum(case when reach is null or y0 > reach + 3 then 1 else 0 end) over (partition by doc_id, page order by y0, x0, elem_id rows between unbounded preceding and current row) as line from m)"
over(fx.BOXES, "line_islands", f"{_LINE} select doc_id, elem_id, cast(line as bigint) as line from l")(lambda b: layout.lines(b, 3.0).select("doc_id", "elem_id", "line"))
over(fx.BOXES, "visual_order_displacement", f"{_LINE}, v as (select *, row_number() over (partition by doc_id, page order by line, x0, elem_id) as visual, row_number() over (partition by doc_id, page order by pre_order, elem_id) as cur from l) select doc_id, elem_id, cur as current, visual, abs(cur - visual) as off, case when abs(cur - visual) > 3 then 'error' else 'warning' end as severity from v where abs(cur - visual) > 1")(lambda b: layout.displaced(b).select("doc_id", "elem_id", "current", "visual", "off", "severity"))
over(fx.SWATCHES, "color_legends", """with recursive e as (select *, (x0 + x1) / 2 as x, (y0 + y1) / 2 as y from {s} x), b as (select *, row_number() over (partition by doc_id, page order by elem_id) as i from e where kind <> 'text' and color is not null),
  t as (select doc_id, page, i, [{'id': elem_id, 'x': x, 'y': y}] as found, elem_id as legend from b where i = 1
    union all select b.doc_id, b.page, b.i, case when len(list_filter(t.found, lambda f: (f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y) < 10000)) > 0 then t.found else list_append(t.found, {'id': b.elem_id, 'x': b.x, 'y': b.y}) end,
      coalesce(list_filter(t.found, lambda f: (f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y) < 10000)[1].id, b.elem_id) from b join t on b.doc_id = t.doc_id and b.page = t.page and b.i = t.i + 1),
  m as (select b.*, t.legend from b join t on b.doc_id = t.doc_id and b.page = t.page and b.i = t.i)
  select doc_id, page, legend, count(*) as members, count(distinct color) as colours, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from m group by doc_id, page, legend having count(*) >= 3 and count(distinct color) >= 3
  and not bool_or(exists (select 1 from e q where q.kind = 'text' and q.doc_id = m.doc_id and q.page = m.page and (q.x - m.x) * (q.x - m.x) + (q.y - m.y) * (q.y - m.y) < 900))""")(layout.color_legends)
over(fx.ROWS, "table_row_order", "with c as (select *, row_number() over (partition by table_id order by pre_order, row_id) - 1 as current from {s} x), e as (select *, row_number() over (partition by table_id order by case section when 'THead' then 0 when 'TFoot' then 2 else 1 end, (y0 + y1) / 2, current) - 1 as expected from c where y0 + y1 is not null) select table_id, row_id, current, expected from e where current <> expected")(lambda r: tables.row_order(r).select("table_id", "row_id", "current", "expected"))
over(fx.BOXES, "chained_clusters", "with s as (select distinct doc_id, page, x0, count(*) over (partition by doc_id, page, x0) as n from {s} x), g as (select *, case when x0 - lag(x0) over (partition by doc_id, page order by x0) < 10 then 0 else 1 end as nw from s), k as (select *, sum(nw) over (partition by doc_id, page order by x0) as cluster from g) select doc_id, cast(cluster as bigint) as cluster, min(x0) as low, max(x0) as high, cast(sum(n) as bigint) as members from k group by doc_id, page, cluster")(lambda b: layout.chained_clusters(b, ["doc_id", "page"], "x0", 10.0).select("doc_id", "cluster", "low", "high", "members"))
over(fx.BOXES, "anchored_clusters", "with recursive v as (select doc_id, page, x0, row_number() over (partition by doc_id, page order by x0, elem_id) as i from {s} x), t as (select doc_id, page, x0, i, x0 as anchor, 0 as cluster from v where i = 1 union all select v.doc_id, v.page, v.x0, v.i, case when v.x0 - t.anchor < 10 then t.anchor else v.x0 end, case when v.x0 - t.anchor < 10 then t.cluster else t.cluster + 1 end from t join v on v.doc_id = t.doc_id and v.page = t.page and v.i = t.i + 1) select doc_id, cluster, anchor, round(avg(x0), 6) as mean, cast(count(*) as integer) as members from t group by doc_id, page, cluster, anchor")(lambda b: layout.anchored_clusters(b, ["doc_id", "page"], "x0", 10.0).select("doc_id", "cluster", "anchor", F.round("mean", 6).alias("mean"), "members"))
over(fx.BOXES, "line_groups_by_mean", "with recursive s as (select *, (y0 + y1) / 2 as c, 1.2 * avg(y1 - y0) over (partition by doc_id, page) as reach, row_number() over (partition by doc_id, page order by y0, elem_id) as i from {s} x), t as (select doc_id, page, i, 0 as line, c as total, 1 as n from s where i = 1 union all select s.doc_id, s.page, s.i, case when abs(s.c - t.total / t.n) <= s.reach then t.line else t.line + 1 end, case when abs(s.c - t.total / t.n) <= s.reach then t.total + s.c else s.c end, case when abs(s.c - t.total / t.n) <= s.reach then t.n + 1 else 1 end from t join s on s.doc_id = t.doc_id and s.page = t.page and s.i = t.i + 1) select doc_id, line, round(max_by(total, i) / max(n), 6) as mean, cast(max(n) as integer) as members from t group by doc_id, page, line")(lambda b: layout.mean_lines(b).select("doc_id", "line", F.round("mean", 6).alias("mean"), "members"))
over(fx.BOXES, "nearest_element", f"{_PAIR}, d as (select doc_id, a_elem_id as elem_id, b_elem_id, sqrt(pow(greatest(ax0 - bx1, bx0 - ax1, 0), 2) + pow(greatest(ay0 - by1, by0 - ay1, 0), 2)) as dist from p where a_elem_id <> b_elem_id), k as (select *, row_number() over (partition by doc_id, elem_id order by dist, b_elem_id) as n from d) select doc_id, elem_id, b_elem_id as near_id, round(dist, 6) as distance from k where n = 1")(lambda b: layout.nearest(b, b).select("doc_id", "elem_id", "near_id", F.round("distance", 6).alias("distance")))
over(fx.BOXES, "hit_test", "with s as (select * from {s} x), h as (select a.doc_id, a.elem_id as point_id, b.elem_id, (b.x1 - b.x0) * (b.y1 - b.y0) as area, row_number() over (partition by a.doc_id, a.elem_id order by (b.x1 - b.x0) * (b.y1 - b.y0), b.elem_id) as n from s a join s b on a.doc_id = b.doc_id and a.page = b.page and a.x0 + 8 between b.x0 and b.x1 and a.y0 + 5 between b.y0 and b.y1) select doc_id, point_id, elem_id, area from h where n = 1")(lambda b: layout.hit(b.select("doc_id", "page", F.col("elem_id").alias("point_id"), (F.col("x0") + 8).alias("x"), (F.col("y0") + 5).alias("y")), b).select("doc_id", "point_id", "elem_id", "area"))
over(fx.BOXES, "column_assign", "select doc_id, elem_id, k as column_no from (select *, unnest([0, 1, 2, 3, 4]) as k from {s} x) y where (x0 + x1) / 2 between k * 25 and k * 25 + 25")(lambda b: layout.columns_of(b, b.select("doc_id", "page").distinct().withColumn("column_no", F.explode(F.array(*[F.lit(i) for i in range(5)]))).withColumn("low", F.col("column_no") * 25).withColumn("high", F.col("low") + 25)).select("doc_id", "elem_id", "column_no"))
over(fx.BOXES, "line_crossings", "with s as (select * from {s} x) select h.doc_id, h.elem_id as h_id, v.elem_id as v_id from s h join s v on h.doc_id = v.doc_id and h.page = v.page where h.elem_id % 2 = 0 and v.elem_id % 2 = 1 and v.x0 between h.x0 - 2 and h.x1 + 2 and h.y0 between v.y0 - 2 and v.y1 + 2")(lambda b: layout.crossings(b.where("elem_id % 2 = 0").select("doc_id", "page", F.col("elem_id").alias("h_id"), "x0", "x1", F.col("y0").alias("y")), b.where("elem_id % 2 = 1").select("doc_id", "page", F.col("elem_id").alias("v_id"), "y0", "y1", F.col("x0").alias("x"))).select("doc_id", "h_id", "v_id"))
over(fx.BOXES, "font_consistency", "select font, count(*) as spans, count(distinct size) as sizes, count(distinct doc_id) as documents from {s} x group by font")(lambda b: b.groupBy("font").agg(F.count("*").alias("spans"), F.countDistinct("size").alias("sizes"), F.countDistinct("doc_id").alias("documents")))
over(fx.BOXES, "content_blocks")(lambda b: layout.grown_blocks(b, 5.0))

# ---- lists and artefacts -------------------------------------------------------------

over(fx.LINES_SPARK, "list_marker_type", f"select doc_id, seq, {v.KIND} as type from {{s}} x where {v.KIND} is not null")(lambda x: x.select("doc_id", "seq", t.marker_type(F.col("text")).alias("type")).where("type is not null"))
over(fx.LINES_SPARK, "list_runs", f"with s as (select *, {v.KIND} as type from {{s}} x), g as (select *, case when type is not distinct from lag(type) over (partition by doc_id order by seq) and row_number() over (partition by doc_id order by seq) > 1 then 0 else 1 end as nw from s), r as (select *, sum(nw) over (partition by doc_id order by seq rows between unbounded preceding and current row) as run from g) select doc_id, type, min(seq) as first, count(*) as items, case when type = 'numbered-decimal' then 'Decimal' end as numbering from r where type is not null group by doc_id, run, type having count(*) >= 2")(lists.runs)
_LBL = r"regexp_extract(text, '^\s*(\S+)\s', 1)"
_NUM = ", ".join(f"count(*) filter (where regexp_matches(label, '^{x}[.)]')) as {k}" for k, x in (("d", "[0-9]+"), ("a", "[a-z]"), ("b", "[A-Z]"), ("e", "[ivxlcdm]+"), ("f", "[IVXLCDM]+")))
over(fx.LINES_SPARK, "numbering_style", f"select doc_id, case when greatest(d, a, b, e, f) = 0 then 'None' when d = greatest(d, a, b, e, f) then 'Decimal' when a = greatest(d, a, b, e, f) then 'LowerAlpha' when b = greatest(d, a, b, e, f) then 'UpperAlpha' when e = greatest(d, a, b, e, f) then 'LowerRoman' else 'UpperRoman' end as style, greatest(d, a, b, e, f) as items from (select doc_id, {_NUM} from (select doc_id, {_LBL} as label from {{s}} x) y group by doc_id) z")(lambda x: lists.numbering_styles(x.withColumn("label", F.regexp_extract("text", r"^\s*(\S+)\s", 1))))
over(fx.LINES_SPARK, "list_numbering_first", f"select doc_id, coalesce(min_by(k, seq) filter (where k is not null), 'None') as numbering from (select doc_id, seq, {v.FIRST_NUMBERING} as k from {{s}} x) y group by doc_id")(lists.first_numberings)
over(fx.LINES_SPARK, "label_split", f"select doc_id, seq, label, md5(case when label = '' then text else regexp_extract(text, '{v.ITEM}(.*)$', 2) end) as body from (select *, regexp_extract(text, '{v.ITEM}.*$', 1) as label from {{s}} x) y")(lambda x: lists.labels(x).select("doc_id", "seq", "label", F.md5("body").alias("body")))
over(fx.LINES_SPARK, "text_table_split", r"select doc_id, seq, cast(n as integer) as cells from (select *, len(list_filter(list_transform(regexp_split_to_array(text, '\s{2,}|\t|\|'), lambda v: trim(v)), lambda v: v <> '')) as n from {s} x) y where n >= 2")(lambda x: lists.split_tables(x).select("doc_id", "seq", "cells"))
over(fx.LINES_SPARK, "block_classify", f"select doc_id, seq, case when 8 + seq % 10 > 16 then 'H1' when 8 + seq % 10 > 14 and doc_id % 2 = 0 then 'H2' when 8 + seq % 10 > 12 and doc_id % 2 = 0 then 'H3' when regexp_matches(text, '{v.ITEM}') then 'L' when contains(text, '|') or contains(text, chr(9)) or {v.count_of('  ', 'text')} > 3 then 'Table' else 'P' end as block from {{s}} x")(lambda x: lists.classified(x.withColumn("size", 8 + F.col("seq") % 10).withColumn("bold", F.col("doc_id") % 2 == 0)).select("doc_id", "seq", "block"))
over("select l_orderkey as doc_id, cast(floor(l_quantity) as bigint) as n from lineitem", "page_number_sequence", "with d as (select distinct doc_id, n from {s} x), s as (select *, n - lag(n) over (partition by doc_id order by n) as step from d) select doc_id, count(*) as numbers, coalesce(max(step), 0) <= 3 as sequence from s group by doc_id")(lists.number_sequences)
_TURNS = "select conv_id as doc_id, turn as page, text from conversations"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \t\n\r]+'), lambda v: v <> ''))"
over(_TURNS, "jaccard_pairs", f"with s as (select doc_id, page, {_WORDS.format('text')} as w from {{s}} x), p as (select a.doc_id, a.page as a, b.page as b, case when len(a.w) = 0 or len(b.w) = 0 then 0.0 else len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) end as similarity from s a join s b on a.doc_id = b.doc_id and a.page < b.page) select doc_id, a, b, round(similarity, 6) as similarity from p where similarity >= 0.1")(lambda x: lists.similar_texts(x, 0.1).select("doc_id", "a", "b", F.round("similarity", 6).alias("similarity")))
_ALIKE = "len(list_intersect({a}, {b})) > 0 and len(list_intersect({a}, {b})) >= 0.8 * (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
over(fx.HEADERS, "repeated_headers", f"""with recursive e as (select *, {_WORDS.format('text')} as w, row_number() over (partition by doc_id order by page) as i from {{s}} x),
  t as (select doc_id, page, i, [{{'page': page, 'w': w}}] as found, page as first from e where i = 1
    union all select e.doc_id, e.page, e.i, case when len(list_filter(t.found, lambda f: {_ALIKE.format(a='f.w', b='e.w')})) > 0 then t.found else list_append(t.found, {{'page': e.page, 'w': e.w}}) end, coalesce(list_filter(t.found, lambda f: {_ALIKE.format(a='f.w', b='e.w')})[1].page, e.page) from e join t on e.doc_id = t.doc_id and e.i = t.i + 1),
  c as (select t.doc_id, t.page, t.first, e.text, count(*) over (partition by t.doc_id, t.first) as n, max(t.page) over (partition by t.doc_id) + 1 as pages from t join e on e.doc_id = t.doc_id and e.i = t.i)
  select doc_id, page, first, text from c where n >= greatest(2, 0.5 * pages)""")(lists.repeated)

# ---- matching ------------------------------------------------------------------------

QUERIES["image_figure_match"] = lambda s, d: matching.image_figures(frame(s, d, fx.IMAGES), frame(s, d, fx.FIGURES))
ORACLES["image_figure_match"] = f"with a as (select *, row_number() over (partition by doc_id, page order by image_id desc) as k from ({fx.IMAGES}) x), b as (select *, row_number() over (partition by doc_id, page order by figure_id desc) as k from ({fx.FIGURES}) y) select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.page, b.page) as page, image_id, figure_id from a full join b on a.doc_id = b.doc_id and a.page = b.page and a.k = b.k"
_WHOLE = "case when regexp_like(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href else concat(regexp_extract(url, '^(https?://[^/]+)', 1), href) end"
_LINKS = f"""select page_id as doc_id, text, {_WHOLE.replace('regexp_like', 'regexp_matches')} as dest from (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as text from pages) l"""
QUERIES["ambiguous_links"] = lambda s, d: matching.ambiguous_links(pg.links(table(s, d, "pages")).select(F.col("page_id").alias("doc_id"), "text", F.expr(_WHOLE).alias("dest")))
ORACLES["ambiguous_links"] = f"select doc_id, trim(text) as text, count(distinct dest) as destinations, count(*) as links from ({_LINKS}) x where trim(text) <> '' group by doc_id, trim(text) having count(distinct dest) > 1"
over(fx.ADDRESSES, "ambiguous_addresses", "select doc_id, trim(text) as text, count(distinct dest) as destinations, count(*) as links from {s} x where trim(text) <> '' group by doc_id, trim(text) having count(distinct dest) > 1")(matching.ambiguous_links)
QUERIES["unmatched_annotations"] = lambda s, d: matching.unmatched(frame(s, d, fx.IMAGES), frame(s, d, fx.FIGURES), ["doc_id", "page"])
ORACLES["unmatched_annotations"] = f"select * from ({fx.IMAGES}) a where not exists (select 1 from ({fx.FIGURES}) f where f.doc_id = a.doc_id and f.page = a.page)"
QUERIES["unstructured_widgets"] = lambda s, d: matching.unmatched(frame(s, d, fx.FIELDS), frame(s, d, "select distinct l_partkey as field_id from lineitem where l_quantity > 49"), ["field_id"]).select("field_id", "name", "type")
ORACLES["unstructured_widgets"] = f"select field_id, name, type from ({fx.FIELDS}) f where field_id not in (select l_partkey from lineitem where l_quantity > 49)"
over(fx.FIELDS, "readable_field_name", f"select field_id, {v.READABLE} as readable from {{s}} x")(lambda f: f.select("field_id", t.readable_field_name(F.col("name")).alias("readable")))
over(fx.FIELDS, "field_flags", "select field_id, case when type = 'Btn' then case when flags & 65536 <> 0 then 'push button' when flags & 32768 <> 0 then 'radio button' else 'check box' end when type = 'Ch' then 'choice' when type = 'Sig' then 'signature' else 'text field' end as kind, case when type = 'Tx' then flags | 4096 else flags end as multiline_flags from {s} x")(lambda f: matching.described_fields(f).select("field_id", "kind", "multiline_flags"))

# ---- editing and repairs -------------------------------------------------------------

over(fx.NODES, "sibling_moves", "select doc_id, parent_id, node_id, cast(row_number() over w - 1 as integer) as place, lag(node_id) over w as up, lead(node_id) over w as down from {s} x where parent_id is not null window w as (partition by doc_id, parent_id order by sib, node_id)")(editing.places)
over(fx.NODES, "element_additions", "with n as (select * from {s} x), k as (select doc_id, parent_id, count(*) as kids from n where parent_id is not null group by all) select n.doc_id, n.node_id as parent_id, 'P' as type, n.sib % 6 - 1 as position, case when n.sib % 6 - 1 < 0 or n.sib % 6 - 1 >= coalesce(kids, 0) then coalesce(kids, 0) else n.sib % 6 - 1 end as place from n left join k on k.doc_id = n.doc_id and k.parent_id = n.node_id")(lambda n: editing.additions(n, n.select("doc_id", F.col("node_id").alias("parent_id"), F.lit("P").alias("type"), (F.col("sib") % 6 - 1).alias("position"))))
over(fx.EDITS, "edit_versions", "with e as (select * from {s} x where version <= 3), l as (select *, lag(value) over w as before, max(version) over (partition by doc_id, node_id, column_name) as last from e window w as (partition by doc_id, node_id, column_name order by version)) select doc_id, node_id, column_name as \"column\", version, before, nullif(value, '') as value from l where version = last")(lambda e: editing.values_at(e.withColumnRenamed("column_name", "column"), 3))
over(fx.NODES, "empty_elements", "with n as (select * from {s} x) select doc_id, node_id, type from n where trim(text) = '' and trim(alt) = '' and parent_id is not null and type not in ('Figure', 'Table', 'L', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6') and not exists (select 1 from n k where k.doc_id = n.doc_id and k.parent_id = n.node_id)")(lambda n: editing.meaningless(n).select("doc_id", "node_id", "type"))
over(fx.LOOKS, "tag_looks", f"{v.LOOKS} select doc_id, node_id, like_heading, like_figure, like_item, like_label, like_row, like_list, like_table from f")(lambda n: repairs.looks(n).select("doc_id", "node_id", "like_heading", "like_figure", "like_item", "like_label", "like_row", "like_list", "like_table"))
over(fx.LOOKS, "tag_repair", f"{v.LOOKS}, {v.FITTING} select doc_id, node_id, type, fitting, child_type from g")(repairs.fitting_types)
_SAID = "(select string_agg(trim(k.text), ' ' order by k.sib, k.node_id) from n k where k.doc_id = n.doc_id and k.parent_id = n.node_id and trim(k.text) <> '')"
_CAPTION = """ct as (select doc_id, parent_id, min_by(trim(text), (sib, node_id)) as first from n where trim(text) <> '' and parent_id is not null group by all),
 ca as (select n.doc_id, n.node_id, n.parent_id, n.sib, case when trim(n.text) <> '' then trim(n.text) else ct.first end as caption from n left join ct on ct.doc_id = n.doc_id and ct.parent_id = n.node_id where n.type = 'Caption'),
 cb as (select doc_id, parent_id as node_id, min_by(caption, (sib, node_id)) as below from ca where caption is not null group by all),
 cs as (select doc_id, node_id, coalesce(lag(caption) over w, lead(caption) over w) as beside from (select n.doc_id, n.node_id, n.parent_id, n.sib, ca.caption from n left join ca on ca.doc_id = n.doc_id and ca.node_id = n.node_id where n.parent_id is not null) y window w as (partition by doc_id, parent_id order by sib, node_id))"""
over(fx.CAPTIONED, "required_attributes", f"with n as (select * from {{s}} x), {_CAPTION}, m as (select n.doc_id, n.node_id, trim(n.text) as own, {_SAID} as said, coalesce(cb.below, cs.beside) as caption from n left join cb on cb.doc_id = n.doc_id and cb.node_id = n.node_id left join cs on cs.doc_id = n.doc_id and cs.node_id = n.node_id where n.type = 'Figure' and n.alt = '') select doc_id, node_id, 'alt' as attribute, case when caption is not null then caption when own <> '' then concat('Imagen: ', own) when said <> '' then concat('Imagen: ', case when length(said) > 100 then concat(left(said, 97), '...') else said end) else concat('Imagen (ID: ', node_id, ')') end as value from m union all select doc_id, node_id, 'scope', 'Column' from n where type = 'TH' and scope = ''")(repairs.required_attributes)
_BESIDE = "with s as (select *, lead(elem_id) over w as b_id, lead(x0) over w as bx0, lead(y0) over w as by0, lead(x1) over w as bx1, lead(y1) over w as by1 from {s} x window w as (partition by doc_id, page order by elem_id)) select doc_id, elem_id, b_id, abs((y0 + y1) / 2 - (by0 + by1) / 2) <= 3 as beside, abs((x0 + x1) / 2 - (bx0 + bx1) / 2) <= 3 as below, case when greatest(x0, bx0) >= least(x1, bx1) or greatest(y0, by0) >= least(y1, by1) then 0 else greatest(x0, bx0) end as left_side, case when greatest(x0, bx0) >= least(x1, bx1) or greatest(y0, by0) >= least(y1, by1) then 0 else least(y1, by1) end as bottom from s where b_id is not null"


def _beside(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy("elem_id")
    one = b.withColumns({f"b_{n}": F.lead(n).over(w) for n in ("elem_id", "x0", "y0", "x1", "y1")}).where("b_elem_id is not null")
    both = g.rect(), g.rect("b_")
    return one.select("doc_id", "elem_id", F.col("b_elem_id").alias("b_id"), g.aligned(*both, 1).alias("beside"), g.aligned(*both, 0).alias("below"), g.intersection(*both)[0].alias("left_side"), g.intersection(*both)[3].alias("bottom"))


over(fx.BOXES, "bbox_alignment", _BESIDE)(_beside)
over(fx.BOXES, "bbox_normalised", "select doc_id, elem_id, round(x0 / 120, 9) as x0, round(y0 / 60, 9) as y0, round(x1 / 120, 9) as x1, round(y1 / 60, 9) as y1, (x1 - x0) * (y1 - y0) / 7200 > 0.8 or ((x1 - x0) * (y1 - y0) / 7200 > 0.1 and abs((x0 + x1) / 2 - 60) < 24 and abs((y0 + y1) / 2 - 30) < 12) as background from {s} x")(lambda b: b.select("doc_id", "elem_id", *[F.round(x, 9).alias(n) for x, n in zip(g.normalised(g.rect(), F.lit(120.0), F.lit(60.0)), ("x0", "y0", "x1", "y1"), strict=True)], g.is_background(g.rect(), F.lit(120.0), F.lit(60.0)).alias("background")))
over(fx.SWATCHES, "line_tolerance", "select doc_id, page, round(coalesce(greatest(3, avg(y1 - y0) filter (where kind = 'text' and y1 > y0) * 0.67), 10), 6) as tolerance from {s} x group by doc_id, page")(lambda b: layout.line_tolerance(b).withColumn("tolerance", F.round("tolerance", 6)))
over(fx.BOXES, "detected_columns", "with recursive s as (select * from {s} x), v as (select doc_id, page, x0, row_number() over (partition by doc_id, page order by x0, elem_id) as i from s), t as (select doc_id, page, x0, i, x0 as anchor, 0 as cluster from v where i = 1 union all select v.doc_id, v.page, v.x0, v.i, case when v.x0 - t.anchor < 20 then t.anchor else v.x0 end, case when v.x0 - t.anchor < 20 then t.cluster else t.cluster + 1 end from t join v on v.doc_id = t.doc_id and v.page = t.page and v.i = t.i + 1), m as (select doc_id, page, cluster, avg(x0) as low, count(*) over (partition by doc_id, page) as n from t group by doc_id, page, cluster), f as (select m.doc_id, m.page, m.cluster, m.low, max(s.x1) as high from m join s on s.doc_id = m.doc_id and s.page = m.page and abs(s.x0 - m.low) < 20 where n > 1 group by all having max(s.x1) - m.low > 20) select doc_id, page, round(low, 6) as low, high from f union all select doc_id, page, round(min(x0), 6), max(x1) from s where (doc_id, page) not in (select (doc_id, page) from f) group by doc_id, page")(lambda b: layout.detected_columns(b).withColumn("low", F.round("low", 6)))
ordering.columned(ORACLES["detected_columns"], _LINE)
QUERIES["link_issues"] = lambda s, d: matching.link_problems(frame(s, d, fx.ANNOTATIONS).where("subtype = 'Link'").drop("alt"), frame(s, d, fx.LINKS))
ORACLES["link_issues"] = f"with j as (select a.doc_id, a.annot_id, a.contents, e.annot_id is not null as found, has_objr, e.alt from ({fx.ANNOTATIONS}) a left join ({fx.LINKS}) e on e.doc_id = a.doc_id and e.annot_id = a.annot_id where a.subtype = 'Link') select doc_id, annot_id, 'missing structure' as problem from j where not found union all select doc_id, annot_id, 'missing object reference' from j where found and not has_objr union all select doc_id, annot_id, 'missing description' from j where found and alt = '' union all select doc_id, annot_id, 'missing contents' from j where contents = ''"
over(fx.ANNOTATIONS, "annotation_descriptions", "select doc_id, annot_id, case when subtype = 'Link' and tu <> '' then concat('Enlace a ', tu) when subtype = 'Text' then 'Nota de texto' else concat('Anotación de tipo ', subtype) end as description from {s} x where subtype <> 'Widget' and contents = '' and alt = ''")(lambda a: matching.undescribed(a.withColumnRenamed("tu", "destination")))
_TIPS = f"select field_id, case when field_id % 3 = 0 then '' else name end as name, type, flags, case field_id % 4 when 0 then 'A tip' when 1 then name else '' end as tu from ({fx.FIELDS}) f"
over(_TIPS, "field_tooltips", f"select field_id, case when tu <> '' and tu <> name then tu when name <> '' then {v.READABLE} else case type when 'Tx' then 'Campo de texto' when 'Ch' then 'Lista de selección' when 'Sig' then 'Campo de firma' else case when flags & 65536 <> 0 then 'Botón' when flags & 32768 <> 0 then 'Botón de opción' else 'Casilla de verificación' end end end as tooltip from ({_TIPS}) x")(lambda f: matching.tooltips(f).select("field_id", "tooltip"))
over(fx.COLOURS, "contrast_aaa", f"select doc_id, {K}, {_R} >= case when size >= 18 or (bold and size >= 14) then 4.5 else 7.0 end as enough from {{s}} x")(lambda x: x.select("doc_id", *fx.ORDER, (c.contrast_ratio(_rgb("r", "g", "b"), _rgb("br", "bg", "bb")) >= c.required_ratio(F.col("size"), F.col("bold"), "AAA")).alias("enough")))
over(fx.COLOURS, "accessible_colors")(lambda x: x.withColumn("need", c.required_ratio(F.col("size"), F.col("bold"))).where(c.contrast_ratio(_rgb("r", "g", "b"), _rgb("br", "bg", "bb")) < F.col("need")).select("doc_id", *fx.ORDER, *"r g b br bg bb need".split(), F.get(c.accessible_pairs(_rgb("r", "g", "b"), _rgb("br", "bg", "bb"), F.col("need")), F.lit(0)).alias("x")).select("doc_id", *fx.ORDER, *"r g b br bg bb need".split(), "x.text", "x.ground", F.round("x.ratio", 6).alias("ratio")))

# ---- issues --------------------------------------------------------------------------


_BAGS: dict[tuple, str] = {}


def _stamps(spark: SparkSession, d: str) -> tuple:
    """Name, size and time of all files below a folder: what is kept of it holds as long as these."""
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _bag(spark: SparkSession, d: str) -> DataFrame:
    """The bag as a written table: the rules run once in a session for the files of a folder as they are, and every report reads what they found."""
    key = spark.sparkContext.applicationId, d, _stamps(spark, d)
    if key not in _BAGS:
        path = tree.new_table(spark)
        with tree.tidied(spark):
            for found in _found(spark, d):  # a rule's shuffles are gone before the next one begins
                found.write.mode("append").option("compression", "zstd").parquet(path)
        _BAGS[key] = path
    return spark.read.parquet(_BAGS[key])


#: Bytes of a folder's files for each slice of its documents.
SLICE = 256_000_000


def _slices(spark: SparkSession, d: str) -> int:
    return max(1, -(-sum(size for _, size, _ in _stamps(spark, d)) // SLICE))


def _cells(spark: SparkSession, d: str, lines: DataFrame) -> DataFrame:
    """The cells of whole tables, whose lines are given."""
    return frame(spark, d, fx.CELLS, lineitem=lines)


def _found(spark: SparkSession, d: str) -> Iterator[DataFrame]:
    """What the rules find in all logical inputs, rule by rule; inputs that are read often are written once.

    Rules that shuffle whole inputs take one slice of the documents after another, so that
    what lies on disk at a time grows with a slice. The slices together are all documents.
    """
    of = lambda sql: frame(spark, d, sql)
    meta = of(fx.META)
    with tree.scratch(spark):
        nodes = tree.written(of(fx.TALKING))[0]
        yield issues.of_nodes(nodes)
        walked = tree.written(tree.walked(nodes))[0]
        yield issues.of_trees(nodes, meta.select("doc_id"), walked)
        yield from issues.heading_rules(issues.headings_of(nodes, walked), ["path"])
        yield issues.of_languages(nodes, meta, walked)
    yield issues.of_annotations(of(fx.ANNOTATIONS), of(fx.OUTLINES), meta)
    yield issues.of_untagged(of(fx.UNTAGGED), of(fx.WITHOUT_TREE))
    yield issues.of_contrast(of(fx.SEEN))
    yield issues.of_characters(of(fx.GLYPHS))
    yield issues.of_errors(pg.load_errors(table(spark, d, "pages")))
    yield issues.of_metadata(meta)
    n = _slices(spark, d)
    for k in range(n):
        sliced = lambda rows, key: rows.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)) == k)  # noqa: B023, E731 - used in this round only
        part = lambda sql, key: sliced(of(sql), key)  # noqa: B023, E731
        # a filter doesn't move below a window over an expression, so the lines of cells are sliced before it
        lines = sliced(table(spark, d, "lineitem"), "l_orderkey")
        yield from issues.heading_rules(part(fx.HEADINGS, "doc_id").withColumn("text", F.lit("x")).withColumn("element_id", F.lit(None).cast("string")), fx.ORDER)
        with tree.scratch(spark):
            yield from issues.table_rules(tree.written(_cells(spark, d, lines))[0], frames=tree.written(part(fx.FRAMES, "table_id"))[0])
        with tree.scratch(spark):
            yield from issues.colour_rules(part(fx.STYLED, "doc_id"), tree.written(part(fx.TAGGED, "doc_id"))[0])


_STRUCTURE = [v.node_issues(fx.NODES), v.tree_issues(fx.NODES), v.heading_issues(v.headings_of(fx.NODES), "path")]
_HEADINGS = v.heading_issues(f"select *, 'x' as text, cast(null as varchar) as element_id from ({fx.HEADINGS}) q", K)
_LEGENDS = ORACLES["color_legends"].replace(f"({fx.SWATCHES})", f"({fx.STYLED})")
_CONTRAST = v.contrast_issues(fx.SEEN, _R, _NEED)
_COLOURS = v.colour_issues(fx.STYLED, fx.TAGGED, _LEGENDS)
_FRAMES = v.frame_issues(fx.FRAMES, fx.CELLS)
_UNTAGGED = v.untagged_issues(fx.UNTAGGED, fx.WITHOUT_TREE)
_BAG = " union all ".join(
    f"select * from ({x}) q"
    for x in [*_STRUCTURE, v.bare_issues("select doc_id from documents", fx.NODES), v.language_issues(fx.TALKING, fx.META), v.annotation_issues(fx.ANNOTATIONS, fx.OUTLINES, fx.META), _UNTAGGED, _HEADINGS, v.table_issues(fx.CELLS), _FRAMES, _CONTRAST, _COLOURS, v.character_issues(fx.GLYPHS), v.metadata_issues(fx.META)]
)


def of_bag(name: str, oracle: str | None = None):
    """Registers a query of the bag; the oracle's {s} stands for it."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, d: f(_bag(spark, d))
        if oracle:
            ORACLES[name] = oracle.replace("{s}", f"({_BAG})")
        return f

    return add


over(fx.NODES, "structure_issues", " union all ".join(f"select * from ({x}) q" for x in _STRUCTURE))(issues.of_structure)
QUERIES["language_issues"] = lambda s, d: issues.of_languages(frame(s, d, fx.TALKING), frame(s, d, fx.META))
ORACLES["language_issues"] = v.language_issues(fx.TALKING, fx.META)
QUERIES["annotation_language_issues"] = lambda s, d: issues.of_annotations(frame(s, d, fx.ANNOTATIONS), frame(s, d, fx.OUTLINES), frame(s, d, fx.META))
ORACLES["annotation_language_issues"] = v.annotation_issues(fx.ANNOTATIONS, fx.OUTLINES, fx.META)
over(fx.CELLS, "table_issues", v.table_issues(fx.CELLS))(issues.of_tables)
of_many({"cells": fx.CELLS, "frames": fx.FRAMES}, "table_frame_issues", f"select * from ({v.table_issues(fx.CELLS)}) a union all select * from ({_FRAMES}) b")(lambda cells, frames: issues.of_tables(cells, frames=frames))
over(fx.SEEN, "contrast_warnings", _CONTRAST)(issues.of_contrast)
of_many({"elements": fx.STYLED, "tags": fx.TAGGED}, "colour_meaning", _COLOURS)(issues.of_colours)
over(fx.GLYPHS, "character_issues", v.character_issues(fx.GLYPHS))(issues.of_characters)
of_many({"pages": fx.UNTAGGED, "documents": fx.WITHOUT_TREE}, "untagged_texts", _UNTAGGED)(issues.of_untagged)
over(fx.HEADINGS, "heading_issues", _HEADINGS)(lambda h: issues.of_headings(h.withColumn("text", F.lit("x")).withColumn("element_id", F.lit(None).cast("string")), fx.ORDER))
QUERIES["unstructured_documents"] = lambda s, d: issues.of_trees(frame(s, d, fx.NODES), frame(s, d, fx.META).select("doc_id")).where("description = 'no structure'").select("doc_id", "checkpoint", "severity")
ORACLES["unstructured_documents"] = f"select doc_id, '01-005' as checkpoint, 'error' as severity from documents where doc_id not in (select doc_id from ({fx.NODES}) n)"

_STEPS = f"with recursive n as (select *, row_number() over (partition by doc_id, parent_id order by sib, node_id) - 1 as k from ({fx.NODES}) q), t as (select doc_id, node_id, type, concat('/', k, ':', type) as path from n where parent_id is null union all select n.doc_id, n.node_id, n.type, concat(t.path, '/', n.k, ':', n.type) from n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id), adv(c, a) as (values {', '.join(f"('{k}', '{a.replace(chr(39), chr(39) * 2)}')" for k, a in conformance.ADVICE.items())})"
over(fx.NODES, "issue_details", f"{_STEPS} select i.*, t.type as element_type, t.path, coalesce(a, 'Corregir según las especificaciones de PDF/UA') as fix_description from ({' union all '.join(f'select * from ({x}) q' for x in _STRUCTURE)}) i left join t on t.doc_id = i.doc_id and t.node_id = i.element_id left join adv on adv.c = i.checkpoint")(lambda n: conformance.detailed(issues.of_structure(n), n))

# ---- conformance ---------------------------------------------------------------------

_CAT = "case when contains(checkpoint, '-') then split_part(checkpoint, '-', 1) else '00' end"
_CNT = "count(*) as total, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity not in ('error', 'warning')) as infos"
_DIM = ", ".join(f"('{k:02d}', '{n}')" for k, n in enumerate(v.CATEGORIES, 1))
_ROLL = f"with f as (select {_CAT} as category, {_CNT} from {{s}} x group by 1), d(category, name) as (values {_DIM}), z as (select coalesce(f.category, d.category) as category, coalesce(name, 'other') as name, coalesce(total, 0) as total, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos from f full join d on f.category = d.category)"
of_bag("issue_filter", "select doc_id, checkpoint, description from {s} x where severity = 'error' and fixable and contains(lower(description), 'without scope')")(lambda i: conformance.matching(i, severity="error", fixable=True, text="Without Scope").select("doc_id", "checkpoint", "description"))
of_bag("checkpoint_categories", f"select *, case when errors > 0 then 'error' when warnings > 0 then 'warning' else 'info' end as overall from (select checkpoint, {_CNT} from {{s}} x group by checkpoint) y")(conformance.by_checkpoint)
of_bag("conformance_status", "select doc_id, count(*) filter (where severity = 'error') = 0 as conformant, count(distinct case when severity = 'error' then checkpoint end) as blocking, count(*) as issues_count from {s} x group by doc_id")(conformance.status)
of_bag("conformance_rollup", f"{_ROLL} select * from z")(conformance.rollup)
of_bag("maturity", f"select doc_id, failing, cast(greatest(floor(100 * (1 - failing / 31)), 0) as bigint) as maturity from (select doc_id, count(distinct case when severity = 'error' then {_CAT} end) as failing from {{s}} x group by doc_id) y")(conformance.maturity)
of_bag("two_level_counts", f"select category, checkpoint, count(*) as total, count(*) filter (where severity = 'error') as errors from (select {_CAT} as category, checkpoint, severity from {{s}} x) y group by rollup(category, checkpoint)")(conformance.two_levels)
of_bag("top_categories", f"{_ROLL} select * from z where total > 0 order by total desc, category limit 10")(conformance.top_categories)
of_bag("issue_examples", "select checkpoint, n, description from (select *, row_number() over (partition by checkpoint order by doc_id, description) as n from {s} x) y where n <= 3")(lambda i: conformance.examples(i).select("checkpoint", "n", "description"))
_FIRST = ["06", "07", "11", "13", "15", "09", "01"]
_GENERAL = "['semantic tags', 'table headers', 'alternative texts', 'language', 'reading order', 'running heads', 'contrast']"
QUERIES["recommendations"] = lambda s, d: conformance.recommendations(_bag(s, d), frame(s, d, fx.STRUCTURED))
ORACLES["recommendations"] = f"with f as (select doc_id, list(distinct {_CAT}) as bad from ({_BAG}) x where severity = 'error' group by doc_id), o as (select s.doc_id, list_filter([case when not has_structure then 'structure' end, {', '.join(f"case when list_contains(bad, '{c}') then '{c}' end" for c in _FIRST)}], lambda z: z is not null)[1:5] as own from ({fx.STRUCTURED}) s left join f on f.doc_id = s.doc_id), a as (select doc_id, case when len(own) < 3 then list_concat(own, {_GENERAL})[1:5] else own end as advice from o) select doc_id, cast(unnest(range(1, len(advice) + 1)) as integer) as place, unnest(advice) as advice from a"
of_bag("issue_stats", f"select {_CNT}, count(*) filter (where fixable) as fixable, round_even(100.0 * count(*) filter (where fixable) / greatest(count(*), 1), 2) as fixable_percent from {{s}} x")(conformance.overview)
of_bag("checkpoint_info", f"select checkpoint, count(*) as total, checkpoint in ({v.quoted(v.CHECKABLE + v.JUDGED)}) as known, checkpoint in ({v.quoted(v.CHECKABLE)}) as checkable, case when checkpoint in ({v.quoted(v.ERRORS)}) then 'error' when checkpoint in ({v.quoted(v.WARNINGS)}) then 'warning' else 'info' end as severity from {{s}} x group by checkpoint")(lambda i: conformance.explained(i.groupBy("checkpoint").agg(F.count("*").alias("total"))).select("checkpoint", "total", "known", "checkable", "severity"))


# ---- files ---------------------------------------------------------------------------

of_bag("json_roundtrip", "select doc_id, checkpoint, severity, description, fixable, page from {s} x")(lambda i: export.from_json(export.to_json(i)))
of_bag("report_lines", f"""with b as (select *, {_CAT} as category from {{s}} x), s as (select doc_id, {_CNT}, count(*) filter (where fixable) as fixable, count(distinct case when severity = 'error' then category end) as failing, count(distinct case when severity = 'error' then checkpoint end) as blocking from b group by doc_id), d(category, name) as (values {_DIM}),
h as (select doc_id, ['RESULTADO DE CONFORMIDAD', repeat('-', 30), concat('Nivel: ', case when errors = 0 then 'Conforme' else 'No conforme' end), concat('Nivel de madurez: ', greatest(cast(floor(100 * (1 - failing / 31)) as bigint), 0), '%'), concat('Problemas bloqueantes: ', blocking), '', 'ESTADÍSTICAS', repeat('-', 30), concat('Total problemas: ', total), concat('Errores: ', errors), concat('Advertencias: ', warnings), concat('Informativo: ', infos), concat('Corregibles automáticamente: ', fixable, ' (', cast(floor(100 * fixable / total) as bigint), '%)'), '', 'PROBLEMAS POR CATEGORÍA', repeat('-', 30)] as ls from s),
g as (select doc_id, category, {_CNT} from b group by all), c as (select doc_id, category, checkpoint, count(*) as n from b group by all), e as (select *, row_number() over (partition by doc_id, checkpoint order by page nulls first, description) as k from b)
select doc_id, concat('0|', lpad(cast(unnest(range(0, 16)) as varchar), 2, '0')) as at_line, unnest(ls) as line from h
union all select doc_id, concat('1|', category, '| |0'), concat(category, ': ', coalesce(name, 'other'), ' - ', total, ' problemas') from g left join d using (category) union all select doc_id, concat('1|', category, '| |1'), concat('  Errores: ', errors, ', Advertencias: ', warnings, ', Info: ', infos) from g
union all select doc_id, concat('1|', category, '|', checkpoint, '|0'), concat('  ', checkpoint, ' - ', n, ' problemas') from c union all select doc_id, concat('1|', category, '|', checkpoint, '|1.', lpad(cast(k as varchar), 3, '0')), concat('    - ', description, ' (', case when page is null then 'todo el documento' else concat('página ', page) end, ')') from e where k <= 3
union all select doc_id, concat('1|', category, '|', checkpoint, '|2'), concat('    - ... y ', n - 3, ' problemas más') from c where n > 3""")(lambda i: export.report_lines(i).withColumnRenamed("at", "at_line"))
_TREE = "recursive n as (select * from {s} x), t as (select doc_id, node_id, [sib] as path from n where parent_id is null union all select n.doc_id, n.node_id, list_append(t.path, n.sib) from n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id), p as (select n.*, t.path, repeat('  ', len(t.path) - 1) as pad from n join t on t.doc_id = n.doc_id and t.node_id = n.node_id)"
_ATTRS = " union all ".join(f"select doc_id, list_append(path, cast({-4 + k} as bigint)), concat(pad, '  <attr name=', chr(39), '{a}', chr(39), ' value=', chr(39), {a}, chr(39), ' />') from p where {a} <> ''" for k, a in enumerate(("alt", "scope", "lang")))
over(fx.NODES, "structure_xml", f"with {_TREE}, l as (select doc_id, path as at_path, concat(pad, '<', type, '>') as line from p union all {_ATTRS} union all select doc_id, list_append(path, cast(-1 as bigint)), concat(pad, '  <text>', trim(text), '</text>') from p where trim(text) <> '' union all select doc_id, list_append(path, 4611686018427387904), concat(pad, '</', type, '>') from p) select doc_id, string_agg(line, chr(10) order by at_path, line) as xml from l group by doc_id")(lambda n: export.structure_xml(n.join(tree.paths(n), ["doc_id", "node_id"])))
over(fx.HEADINGS, "repair_patches", f"select doc_id, {K}, 'level' as \"column\", cast(level as string) as old, cast(fixed as string) as new from (select *, i + min(level - i) over (partition by doc_id order by {K} rows between unbounded preceding and current row) as fixed from (select *, row_number() over (partition by doc_id order by {K}) as i from {{s}} h) t) u where level <> fixed")(
    lambda h: export.patches(h, tree.repaired_levels(h, "doc_id", fx.ORDER).drop("level").withColumnRenamed("fixed", "level"), ["doc_id", *fx.ORDER], ["level"])
)
