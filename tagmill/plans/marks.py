"""Queries of what is no content, and of repairs: lists as they are printed and should be tagged, homes of widgets, figures, links, metadata; what stands for elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.operators import artifacts, detect, editing, figures, issues, lists, matching, metadata, repairs, tables
from tagmill.plans import fixtures as fx
from tagmill.plans import sql_values as v
from tagmill.plans.registry import of_many, over

# ---- artifacts -----------------------------------------------------------------------

_ON = "from {spans} s join {pages} p on p.doc_id = s.doc_id and p.page = s.page"
_AREA = "((x1 - x0) * (y1 - y0))"
_HEAD = "(greatest(least(x1, width) - greatest(x0, 0), 0) * greatest(least(y1, height * 0.1) - greatest(y0, 0), 0))"
_FOOT = "(greatest(least(x1, width) - greatest(x0, 0), 0) * greatest(least(y1, height) - greatest(y0, height * 0.9), 0))"
_EDGED = {"spans": fx.EDGED, "pages": fx.SHEETS}
_RATIO = lambda o, zone: f"({o} / least({_AREA}, {zone}) >= 0.5)"
_TOP, _BOTTOM = _RATIO(_HEAD, "(width * height * 0.1)"), _RATIO(_FOOT, "(width * (height - height * 0.9))")
_NUMBER = "(regexp_full_match(trim(text), '[0-9]+') or (length(trim(text)) <= 10 and regexp_matches(trim(text), 'Pág[.]|Page|Página|-|/')))"
of_many(_EDGED, "zone_texts", f"select s.doc_id, s.page, s.elem_id, case when {_NUMBER} then 'pagination' when {_TOP} then 'header' else 'footer' end as kind, case when {_NUMBER} then 0.9 else 0.7 end as confidence {_ON} where not tagged and ({_TOP} or {_BOTTOM})")(artifacts.zone_texts)
_NEAR = "(x0 < width * 0.05 or y0 < height * 0.05 or x1 > width * 0.95 or y1 > height * 0.95)"
of_many({"shapes": fx.EDGED, "pages": fx.SHEETS}, "edge_shapes", f"select s.doc_id, s.page, s.elem_id, case when kind = 'path' then 'border' else 'decoration' end as kind, case when kind = 'path' then 0.6 else 0.5 end as confidence from {{shapes}} s join {{pages}} p on p.doc_id = s.doc_id and p.page = s.page where {_NEAR} and ((kind = 'path' and coalesce(stroke, 2) < 2) or (kind = 'image' and {_AREA} < width * height * 0.01))")(artifacts.edge_shapes)
_SIDE = "(greatest(least(x1, {b}) - greatest(x0, {a}), 0) * greatest(least(y1, height) - greatest(y0, 0), 0))"
_GROUND = f"({_AREA} / (width * height) > 0.8 or ({_AREA} / (width * height) > 0.1 and abs((x0 + x1) / 2 - width / 2) < width * 0.2 and abs((y0 + y1) / 2 - height / 2) < height * 0.2))"
of_many({"images": fx.EDGED, "pages": fx.SHEETS}, "decorative_images", f"select doc_id, page, elem_id, reason from (select s.doc_id, s.page, s.elem_id, case when {_HEAD} / {_AREA} > 0.5 then 'header' when {_FOOT} / {_AREA} > 0.5 then 'footer' when {_SIDE.format(a='0', b='width * 0.05')} / {_AREA} > 0.5 then 'left margin' when {_SIDE.format(a='width * 0.95', b='width')} / {_AREA} > 0.5 then 'right margin' when {_GROUND} then 'background' end as reason from {{images}} s join {{pages}} p on p.doc_id = s.doc_id and p.page = s.page) y where reason is not null")(artifacts.decorative_images)
over(fx.EDGED, "running_looks", r"select doc_id, elem_id, (flags & 16 <> 0) or ((y0 < 50 or y1 > 750) and (regexp_matches(trim(text), '(?i)\b(page|página)\s*[0-9]+\b') or regexp_matches(trim(text), '[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}') or (length(trim(text)) < 100 and trim(text) = upper(trim(text)) and trim(text) <> lower(trim(text))))) as running from {s} x")(lambda e: e.select("doc_id", "elem_id", artifacts.looks_running(F.col("text"), F.col("y0"), F.col("y1"), F.col("flags")).alias("running")))
over(fx.RUNNING, "page_numbers", r"select doc_id, page, elem_id from {s} x where regexp_full_match(trim(text), '[0-9]+|Page\s+[0-9]+|[0-9]+\s+of\s+[0-9]+|Page\s+[0-9]+\s+of\s+[0-9]+|-\s*[0-9]+\s*-|\[\s*[0-9]+\s*\]|Página\s+[0-9]+|[0-9]+\s+de\s+[0-9]+') and len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda n: abs(cast(n as bigint) - page - 1) <= 2 or cast(n as bigint) = page)) > 0")(artifacts.numbered)
of_many({"texts": fx.RUNNING, "pages": fx.RUN_PAGES}, "running_texts", rf"""with h as (select s.doc_id, s.page, s.elem_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda w: w <> '')) as w, floor(x0 / 20) as cx, floor(y0 / 20) as cy from {{texts}} s join {{pages}} p on p.doc_id = s.doc_id and p.page = s.page where {_HEAD} / {_AREA} > 0.5 or {_FOOT} / {_AREA} > 0.5)
select a.doc_id, a.page, a.elem_id from h a join h b on b.doc_id = a.doc_id and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 where len(list_intersect(a.w, b.w)) > 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) group by a.doc_id, a.page, a.elem_id having count(distinct b.page) > 2""")(artifacts.running_texts)

# ---- lists ---------------------------------------------------------------------------

_KIND = r"case when regexp_matches(trim(text), '^[•⦿⦾○●◦▪▫]\s') then 'bullet' when regexp_matches(trim(text), '^([0-9]+\.|\([0-9]+\)|[a-z]\)|[ivxlcdm]+\.|[IVXLCDM]+\.)\s') then 'numbered' end"
over(fx.PRINTED_ITEMS, "printed_lists", f"""with recursive i as (select *, row_number() over (partition by doc_id, page order by y0, line_id) as i from (select *, {_KIND} as kind from {{s}} x) y where kind is not null),
t as (select doc_id, page, i, kind, x0 as indent, 0 as run, x0, y0, x1, y1 from i where i = 1 union all select i.doc_id, i.page, i.i, i.kind, case when i.kind = t.kind and abs(i.x0 - t.indent) < 5 then t.indent else i.x0 end, case when i.kind = t.kind and abs(i.x0 - t.indent) < 5 then t.run else t.run + 1 end, i.x0, i.y0, i.x1, i.y1 from t join i on i.doc_id = t.doc_id and i.page = t.page and i.i = t.i + 1),
g as (select doc_id, page, run, kind, count(*) as items, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from t group by all having count(*) >= 2)
select doc_id, page, cast(row_number() over (partition by doc_id, page order by run) - 1 as integer) as list, kind, cast(items as integer) as items, x0, y0, x1, y1 from g""")(lists.printed_lists)
_MARK = r"regexp_extract(text, '^(\s*[•⦿⦾⚫◦◆◊▪▫►▻▶▷◉○⚬●■□]+\s|\s*[-–—]\s|\s*[*]\s|\s*[0-9]+[.)]\s|\s*[a-zA-Z][.)]\s|\s*[ivxlcdmIVXLCDM]+[.)]\s)')"
over(fx.LIST_NODES, "list_patches", rf"""with n as (select * from {{s}} x), k as (select n.*, u.type as up, row_number() over (partition by n.doc_id, n.parent_id order by n.sib, n.node_id) as nth from n join n u on u.doc_id = n.doc_id and u.node_id = n.parent_id),
i as (select *, bool_or(type = 'Lbl') over (partition by doc_id, parent_id) as labelled, bool_or(type = 'LBody') over (partition by doc_id, parent_id) as bodied, {_MARK} as mark from k where up = 'LI')
select doc_id, node_id, 'wrap in LI' as action, null as value from k where up = 'L' and type <> 'LI' and not (nth = 1 and type = 'Caption')
union all select doc_id, parent_id, 'add Lbl', mark from i where nth = 1 and not labelled and mark <> '' union all select doc_id, node_id, 'set text', regexp_replace(substring(text, length(mark) + 1), '^\s+', '') from i where nth = 1 and not labelled and mark <> ''
union all select doc_id, node_id, 'wrap in LBody', null from i where not bodied and type <> 'Lbl'""")(lists.structure_patches)
over(fx.LIST_NODES, "numbering_patches", r"""with n as (select * from {s} x), i as (select c.doc_id, c.parent_id as list, c.node_id, row_number() over (partition by c.doc_id, c.parent_id order by c.sib, c.node_id) as nth from n c join n l on l.doc_id = c.doc_id and l.node_id = c.parent_id and l.type = 'L' where c.type = 'LI'),
b as (select i.*, l.text as label from i left join (select * from (select *, row_number() over (partition by doc_id, parent_id order by sib, node_id) as k from n where type = 'Lbl') y where k = 1) l on l.doc_id = i.doc_id and l.parent_id = i.node_id),
t as (select doc_id, list from b where nth <= 3 group by all having count(*) filter (where regexp_matches(label, '^\s*([0-9]+|[a-zA-Z]|[ivxlcdmIVXLCDM]+)[.)]')) > count(*) / 2),
c as (select doc_id, list, """ + ", ".join(f"count(*) filter (where regexp_matches(trim(label), '^{x}[.)]')) as {k}" for k, x in (("d", "[0-9]+"), ("a", "[a-z]"), ("b", "[A-Z]"), ("e", "[ivxlcdm]+"), ("f", "[IVXLCDM]+"))) + """ from b where label is not null group by all)
select t.doc_id, t.list as node_id, case when greatest(d, a, b, e, f) = 0 then 'None' when d = greatest(d, a, b, e, f) then 'Decimal' when a = greatest(d, a, b, e, f) then 'LowerAlpha' when b = greatest(d, a, b, e, f) then 'UpperAlpha' when e = greatest(d, a, b, e, f) then 'LowerRoman' else 'UpperRoman' end as value from t join c on c.doc_id = t.doc_id and c.list = t.list""")(lists.numbering_patches)
over(fx.LIST_ITEMS, "list_item_order", "with c as (select *, row_number() over (partition by doc_id, list_id order by place, node_id) - 1 as current_place from {s} x), e as (select *, row_number() over (partition by doc_id, list_id order by (y0 + y1) / 2, current_place) - 1 as expected from c where y0 + y1 is not null) select doc_id, list_id, node_id, current_place, expected from e where current_place <> expected")(lambda i: lists.item_order(i.withColumnRenamed("list_id", "list")).withColumnsRenamed({"list": "list_id", "current": "current_place"}))

# ---- forms ---------------------------------------------------------------------------

of_many({"widgets": fx.WIDGETS, "nodes": fx.TREES}, "widget_additions", f"""with recursive n as (select * from {{nodes}} x), t as (select doc_id, node_id, type, page, [place] as path from n where parent_id is null union all select n.doc_id, n.node_id, n.type, coalesce(n.page, t.page), list_append(t.path, n.place) from n join t on n.doc_id = t.doc_id and n.parent_id = t.node_id),
h as (select doc_id, page, node_id, row_number() over (partition by doc_id, page order by path desc, node_id desc) as k from t where type in ('P', 'Div', 'TD', 'Sect', 'Art', 'NonStruct') and page is not null)
select w.doc_id, w.widget_id, h.node_id as parent_id, 'Form' as type, {v.READABLE} as text from {{widgets}} w join h on h.doc_id = w.doc_id and h.page = w.page and h.k = 1""")(matching.widget_homes)

# ---- figures and links ---------------------------------------------------------------

_NAME = "case kind when 'jpeg' then 'fotografía' when 'png' then 'gráfico' when 'tiff' then 'imagen escaneada' when 'gif' then 'imagen animada' when 'svg+xml' then 'gráfico vectorial' else 'imagen' end"
_BIG = f"concat(upper(left({_NAME}, 1)), lower(substring({_NAME}, 2)))"
_TYPED = f"case when regexp_matches(lower(alt), 'imagen|figura|gráfico|foto|image|picture') then alt else concat({_BIG}, ': ', alt) end"
_MADE = f"case when has_text and content <> '' then concat('Imagen con texto: ', content) when alt <> '' then case when {v.GENERIC_ALT} then case when regexp_matches(lower(alt), 'página|page') then {_TYPED} else concat({_TYPED}, ' (página ', page + 1, ')') end else alt end else concat({_BIG}, ' ', case when width > height * 1.5 then 'horizontal' when height > width * 1.5 then 'vertical' else 'cuadrada' end, ' en página ', page + 1) end"
over(fx.PICTURES, "figure_descriptions", f"with p as (select *, {_MADE} as made, {v.GENERIC_ALT} as generic from {{s}} x) select doc_id, node_id, 'Alt' as attribute, made as value from p where alt = '' union all select doc_id, node_id, 'ActualText', content from p where has_text and actual = '' union all select doc_id, node_id, 'Alt', made from p where not (has_text and actual = '') and alt <> '' and generic and made <> alt")(figures.paired_patches)
over(fx.PICTURES, "untagged_images", f"select doc_id, image_id, case when decorative then 'artifact' else 'figure' end as action, case when not decorative then {_MADE.replace('alt', chr(39) * 2)} end as alt, case when not decorative and has_text then content end as actual from {{s}} x")(lambda p: figures.untagged_images(p.drop("alt", "actual")))
of_many({"nodes": fx.DRAWINGS, "paired": f"select doc_id, node_id from ({fx.DRAWINGS}) q where node_id like '%6'"}, "figure_patches", "with f as (select n.*, u.type as up from {nodes} n left join {nodes} u on u.doc_id = n.doc_id and u.node_id = n.parent_id where n.type = 'Figure') select doc_id, node_id, 'context' as reason, concat('Imagen en ', lower(up)) as value from f where up in ('Annot', 'Link', 'Form') and alt = '' union all select doc_id, node_id, 'complex', concat(alt, ' [Para obtener una descripción más detallada, contacte con el autor o administrador del documento]') from f where regexp_matches(lower(alt), 'gráfico|diagrama|esquema') and length(alt) < 100 union all select doc_id, node_id, 'orphan', 'Elemento gráfico (no hay imagen detectable)' from f where alt = '' and (doc_id, node_id) not in (select (doc_id, node_id) from {paired} p)")(figures.figure_patches)
over(fx.NAMED_LINKS, "clearer_links", "with l as (select *, trim(text) as said from {s} x), m as (select doc_id, said from l where said <> '' group by all having count(distinct dest) > 1) select l.doc_id, link_id, concat(case when alt <> '' then alt else text end, ' (destino: ', dest, ')') as value from l join m on m.doc_id = l.doc_id and m.said = l.said where dest <> ''")(matching.clearer_links)
_CUT = "case when length({t}) > {n} then concat(left({t}, {n}), '...') else {t} end"
_SAY = lambda name, n, t="trim(text)": f"concat({name}, ': ', {_CUT.format(t=t, n=n)})"
_REST = "concat_ws(', ', case when alt <> '' then concat('alt: ', left(alt, 15), '...') end, case when lang <> '' then concat('lang: ', left(lang, 15), '...') end, case when scope <> '' then concat('scope: ', left(scope, 15), '...') end, case when headers <> '' then concat('headers: ', left(headers, 15), '...') end)"
over(fx.SHOWN, "display_texts", f"""select doc_id, node_id, case when regexp_full_match(type, 'H[1-6]') then case when trim(text) <> '' then {_SAY('type', 50)} else concat(type, ' (empty)') end
 when type = 'P' then case when trim(text) <> '' then {_SAY("'Paragraph'", 60)} else 'Paragraph (empty)' end when type = 'Figure' then case when alt <> '' then {_SAY("'Figure'", 40, 'alt')} when trim(text) <> '' then {_SAY("'Figure'", 40)} else 'Figure (no alt text)' end
 when type = 'Table' then concat('Table (', kids, ' rows)') when type in ('TH', 'TD') then case when trim(text) <> '' then {_SAY('type', 30)} when scope <> '' then concat(type, ' (scope: ', scope, ')') when headers <> '' then concat(type, ' (headers: ', left(headers, 20), '...)') else concat(type, ' (empty)') end
 when type = 'L' then case when listnumbering <> '' then concat('List (', listnumbering, ', ', kids, ' items)') else concat('List (', kids, ' items)') end when type = 'LI' then case when trim(text) <> '' then {_SAY("'List Item'", 40)} else 'List Item (empty)' end
 when type = 'Link' then case when trim(text) <> '' then {_SAY("'Link'", 30)} else 'Link (no text)' end when type = 'TextContent' then case when trim(text) <> '' then {_SAY("'Text'", 50)} else 'Text (empty)' end
 when type = 'MCID' then case when trim(text) <> '' then {_SAY("concat('MCID ', coalesce(cast(mcid as varchar), '?'))", 40)} else concat('MCID ', coalesce(cast(mcid as varchar), '?'), ' (no text)') end
 when type = 'Span' then case when trim(text) <> '' then {_SAY("'Span'", 40)} when lang <> '' then concat('Span (lang: ', lang, ')') else 'Span (empty)' end
 when trim(text) <> '' then {_SAY('type', 40)} when kids > 0 then concat(type, ' (', kids, ' children)') when {_REST} <> '' then concat(type, ' (', {_REST}, ')') else type end as shown from {{s}} x""")(lambda n: n.select("doc_id", "node_id", t.display_text(F.col("type"), F.col("text"), F.col("kids"), {k: F.col(k) for k in ("alt", "scope", "headers", "lang", "listnumbering", "mcid")}).alias("shown")))
over(fx.ORDERED, "order_issues", "with recursive n as (select * from {s} x), w as (select doc_id, node_id, type, [place] as path from n where parent_id is null union all select n.doc_id, n.node_id, n.type, list_append(w.path, n.place) from n join w on n.doc_id = w.doc_id and n.parent_id = w.node_id), h as (select *, cast(substring(type, 2) as integer) as level, lag(cast(substring(type, 2) as integer)) over (partition by doc_id order by path, node_id) as before from w where regexp_full_match(type, 'H[0-9]+')) select doc_id, node_id, 'heading_level_skip' as kind from h where level > before + 1 union all select distinct l.doc_id, l.node_id, 'invalid_list_content' from n l join n k on k.doc_id = l.doc_id and k.parent_id = l.node_id where l.type = 'L' and k.type <> 'LI' union all select doc_id, node_id, 'empty_table' from n where type = 'Table' and not exists (select 1 from n k where k.doc_id = n.doc_id and k.parent_id = n.node_id and k.type = 'TR')")(issues.of_order)

# ---- metadata ------------------------------------------------------------------------

over(fx.META, "conforming_metadata", f"select doc_id, case when coalesce(title, '') = '' then 'Documento PDF' else title end as title, case when {v.VALID.format('language')} then language else 'es-ES' end as language, 'PDF/UA Editor' as creator, 'PDF/UA Editor v1.0' as producer, '<rdf:Description rdf:about=\"\" xmlns:pdfuaid=\"http://www.aiim.org/pdfua/ns/id/\"><pdfuaid:part>1</pdfuaid:part></rdf:Description>' as xmp from {{s}} x")(metadata.conforming)

# ---- tables, links and patches -------------------------------------------------------

over(fx.TABLE_TREES, "repeated_table_heads", "with recursive n as (select * from {s} x), b as (select doc_id, node_id as table_id, node_id from n where type = 'Table' union all select b.doc_id, b.table_id, n.node_id from b join n on n.doc_id = b.doc_id and n.parent_id = b.node_id), p as (select b.doc_id, b.table_id, min(page) as first from b join n on n.doc_id = b.doc_id and n.node_id = b.node_id where page is not null group by all having count(distinct page) > 1), k as (select doc_id, parent_id from n where type in ('TH', 'TD') group by all having count(*) filter (where type = 'TH') > 0.5 * count(*)) select b.doc_id, b.table_id, n.node_id, n.page from b join p on p.doc_id = b.doc_id and p.table_id = b.table_id join n on n.doc_id = b.doc_id and n.node_id = b.node_id where n.page <> p.first and (n.type = 'THead' or (n.type = 'TR' and (n.doc_id, n.node_id) in (select (doc_id, parent_id) from k)))")(tables.repeated_heads)
over(fx.NODES, "table_child_patches", "with n as (select * from {s} x) select n.doc_id, n.node_id, 'set type TD' as action from n join n u on u.doc_id = n.doc_id and u.node_id = n.parent_id and u.type = 'Table' where n.type not in ('TR', 'THead', 'TBody', 'TFoot', 'Caption') and exists (select 1 from n k where k.doc_id = n.doc_id and k.parent_id = n.node_id) union all select doc_id, node_id, 'add TR > TD' from n where type = 'Table' and not exists (select 1 from n k where k.doc_id = n.doc_id and k.parent_id = n.node_id)")(tables.child_patches)
of_many({"annotations": fx.LINKED, "texts": fx.HELD}, "missing_links", """with p as (select a.doc_id, a.page, a.elem_id, a.destination, t.elem_id as near_id, t.text, t.node_id, a.x0 <= t.x1 and t.x0 <= a.x1 and a.y0 <= t.y1 and t.y0 <= a.y1 as over, sqrt(pow(greatest(a.x0 - t.x1, t.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - t.y1, t.y0 - a.y1, 0), 2)) as away from {annotations} a join {texts} t on t.doc_id = a.doc_id and t.page = a.page),
c as (select doc_id, page, elem_id, destination, string_agg(text, ' ' order by near_id) as text, min_by(node_id, near_id) as node_id from p where over group by all),
n as (select doc_id, page, elem_id, destination, text, node_id from (select *, row_number() over (partition by doc_id, page, elem_id order by away, near_id) as k from p where (doc_id, page, elem_id) not in (select (doc_id, page, elem_id) from c)) y where k = 1)
select doc_id, page, elem_id, node_id as parent_id, 'Link' as type, text, case when destination = '' or contains(text, destination) then text else concat(text, ' (destino: ', destination, ')') end as alt from (select * from c union all select * from n) u""")(matching.missing_links)


def _retyped(nodes):
    patches = repairs.fitting_types(nodes).where("child_type <> type").select("doc_id", "node_id", F.lit("type").alias("column"), F.col("child_type").alias("new"))
    return editing.applied(nodes, patches, ["type"]).select("doc_id", "node_id", "parent_id", "type", "text")


over(fx.LOOKS, "patched_nodes", f"{v.LOOKS}, {v.FITTING} select doc_id, node_id, parent_id, child_type as type, text from g")(_retyped)
of_many({"drawn": fx.DRAWN, "printed": fx.PRINTED}, "bordered_tables", """with h as (select doc_id, page, least(x0, x1) as a, y0 as y, greatest(x0, x1) as b, y1 as low from {drawn} d where abs(y1 - y0) < 2), v as (select doc_id, page, x0 as x, least(y0, y1) as a, x1 as r, greatest(y0, y1) as b from {drawn} d where abs(y1 - y0) >= 2 and abs(x1 - x0) < 2),
m as (select h.doc_id, h.page from h join v on v.doc_id = h.doc_id and v.page = h.page and v.x between h.a and h.b and h.y between v.a and v.b group by all having count(*) >= 4),
f as (select m.doc_id, m.page, ys, xs, x0, y0, x1, y1 from m join (select doc_id, page, list_sort(list_distinct(list(y))) as ys, min(y) as y0, max(low) as y1 from h group by all) hh on hh.doc_id = m.doc_id and hh.page = m.page join (select doc_id, page, list_sort(list_distinct(list(x))) as xs, min(x) as x0, max(r) as x1 from v group by all) vv on vv.doc_id = m.doc_id and vv.page = m.page where len(ys) > 1 and len(xs) > 1),
i as (select f.doc_id, f.page, count(*) as cells from f join {printed} s on s.doc_id = f.doc_id and s.page = f.page where greatest(least(s.x1, f.x1) - greatest(s.x0, f.x0), 0) * greatest(least(s.y1, f.y1) - greatest(s.y0, f.y0), 0) >= 0.8 * ((s.x1 - s.x0) * (s.y1 - s.y0)) and (s.y0 + s.y1) / 2 between ys[1] and ys[-1] and (s.x0 + s.x1) / 2 between xs[1] and xs[-1] group by all),
t as (select f.doc_id, f.page, 'bordered' as kind, x0, y0, x1, y1, len(ys) - 1 as n_rows, len(xs) - 1 as n_cols, cells, cast(0.8 as double) as confidence from f join i on i.doc_id = f.doc_id and i.page = f.page where cells >= (len(ys) - 1) * (len(xs) - 1) / 2),
l as (select doc_id, page, round_even((y0 + y1) / 2 / 5, 0) * 5 as spot, count(*) as n, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from {printed} s group by all),
g as (select doc_id, page, 'grid' as kind, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n_rows, max(n) as n_cols, cast(sum(n) as bigint) as cells, cast(0.6 as double) as confidence from l group by doc_id, page having count(*) >= 3 and count(distinct n) <= 3 and max(n) >= 2)
select * from t union all select * from g where not exists (select 1 from t where t.doc_id = g.doc_id and t.page = g.page and (t.x1 - t.x0) * (t.y1 - t.y0) > 0 and (g.x1 - g.x0) * (g.y1 - g.y0) > 0 and greatest(least(t.x1, g.x1) - greatest(t.x0, g.x0), 0) * greatest(least(t.y1, g.y1) - greatest(t.y0, g.y0), 0) / least((t.x1 - t.x0) * (t.y1 - t.y0), (g.x1 - g.x0) * (g.y1 - g.y0)) > 0.7)""")(lambda drawn, printed: detect.bordered_tables(drawn, printed))
