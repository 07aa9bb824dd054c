"""Queries of what documents say and how they are built: texts of elements, trees from flat order, grids of tables, tables of untagged pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tagmill.operators import closure, content, detect, grid, outline
from tagmill.operators.tree import _cut
from tagmill.plans import fixtures as fx
from tagmill.plans import sql_values as v
from tagmill.plans.registry import of_many, over

# ---- texts of elements ---------------------------------------------------------------

_TREE = {"nodes": fx.TREES, "items": fx.ITEMS, "spans": fx.MARKS}
#: Nodes with what they say, their paths and pages; texts of marks; pieces that climb; e, the text of each element.
_TEXTS = r"""n as (select *, case when trim(actual) <> '' then actual when type = 'Figure' and trim(alt) <> '' then alt when trim(expansion) <> '' then expansion end as said from {nodes} q), i as (select * from {items} q), s as (select * from {spans} q),
p as (select doc_id, node_id, [place] as path, coalesce(page, 0) as page from n where parent_id is null union all select n.doc_id, n.node_id, list_append(p.path, n.place), coalesce(n.page, p.page) from n join p on n.doc_id = p.doc_id and n.parent_id = p.node_id),
m as (select doc_id, page, mcid, string_agg(text, ' ' order by seq) as marked from s where mcid >= 0 group by all),
c as (select i.doc_id, i.node_id, list_append(p.path, i.place) as path, i.text, i.mcid from i join n on n.doc_id = i.doc_id and n.node_id = i.node_id and n.said is null join p on p.doc_id = i.doc_id and p.node_id = i.node_id
  union all select n.doc_id, n.node_id, p.path, n.said, null from n join p on p.doc_id = n.doc_id and p.node_id = n.node_id where n.said is not null),
r as (select * from c union all select r.doc_id, u.node_id, r.path, r.text, r.mcid from r join n on n.doc_id = r.doc_id and n.node_id = r.node_id join n u on u.doc_id = n.doc_id and u.node_id = n.parent_id and u.said is null),
w as (select r.doc_id, r.node_id, r.path, case when r.mcid is null then r.text else m.marked end as text from r join p on p.doc_id = r.doc_id and p.node_id = r.node_id left join m on m.doc_id = r.doc_id and m.page = p.page and m.mcid = r.mcid),
j as (select doc_id, node_id, string_agg(text, ' ' order by path, text) as text from w where text <> '' group by all),
e as (select p.doc_id, p.node_id, p.page, trim(regexp_replace(coalesce(j.text, ''), '[ \t\n\r]+', ' ', 'g')) as text from p left join j on j.doc_id = p.doc_id and j.node_id = p.node_id)"""
over(fx.MARKS, "mcid_text", "select doc_id, page, mcid, string_agg(text, ' ' order by seq) as text from {s} x where mcid >= 0 group by all")(content.marked_texts)
of_many(_TREE, "element_text", f"with recursive {_TEXTS} select * from e")(content.element_texts)


def _shown(nodes: DataFrame, items: DataFrame, spans: DataFrame) -> DataFrame:
    nodes = _cut(nodes)
    lines = closure.ancestors(nodes)
    paths = _cut(closure.places(lines, nodes))
    return content.shown_texts(nodes, content.element_texts(nodes, items, spans, lines, paths), lines, paths)


of_many(_TREE, "shown_text", f"with recursive {_TEXTS}, t as (select e.doc_id, e.node_id, p.path, e.text from e join p on p.doc_id = e.doc_id and p.node_id = e.node_id where e.text <> ''), k as (select * from t union all select k.doc_id, u.node_id, k.path, k.text from k join n on n.doc_id = k.doc_id and n.node_id = k.node_id join e u on u.doc_id = n.doc_id and u.node_id = n.parent_id and u.text = ''), g as (select doc_id, node_id, string_agg(text, ' ' order by path, text) as text from k group by all) select n.doc_id, n.node_id, coalesce(g.text, '') as text, coalesce(g.text, '') <> '' and n.type in ('P', 'Span', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6', 'TH', 'TD', 'LI') and not exists (select 1 from n x where x.doc_id = n.doc_id and x.parent_id = n.node_id) as leaf from n left join g on g.doc_id = n.doc_id and g.node_id = n.node_id")(_shown)


def _paged(nodes: DataFrame) -> DataFrame:
    nodes = _cut(nodes.select("doc_id", "node_id", "parent_id", "page"))
    return content.pages_of(closure.ancestors(nodes), nodes)


over(fx.TREES, "page_inheritance", "with recursive n as (select * from {s} x), p as (select doc_id, node_id, coalesce(page, 0) as page from n where parent_id is null union all select n.doc_id, n.node_id, coalesce(n.page, p.page) from n join p on n.doc_id = p.doc_id and n.parent_id = p.node_id) select * from p")(_paged)

# ---- trees from flat order -----------------------------------------------------------

_LABEL = f"regexp_extract(text, '{v.ITEM}.*$', 1)"
_PARTS = f"select doc_id, page, concat('I', seq) as node_id, {{parent}} as parent_id, {{at}} as place, 'LI' as type, '' as text, null as attribute from {{rows}} union all select doc_id, page, concat('Lbl', seq), concat('I', seq), 0, 'Lbl', {_LABEL}, null from {{rows}} union all select doc_id, page, concat('Body', seq), concat('I', seq), 1, 'LBody', case when {_LABEL} = '' then text else regexp_extract(text, '{v.ITEM}(.*)$', 2) end, null from {{rows}}"
over(fx.BLOCKS, "built_structure", rf"""with recursive b as (select *, row_number() over (partition by doc_id, page order by seq) as i, count(*) over (partition by doc_id, page) as n from {{s}} x),
t as (select doc_id, page, seq, kind, text, i, n, kind = 'L' as in_list, case when kind = 'Table' then seq end as open, case kind when 'L' then 'item' when 'Table' then 'row' else 'plain' end as role, case when kind = 'L' then seq end as list, cast(null as bigint) as closed from b where i = 1
  union all select b.doc_id, b.page, b.seq, b.kind, b.text, b.i, b.n, b.kind = 'L', case when b.kind = 'L' or t.in_list then t.open when b.kind = 'Table' then coalesce(t.open, b.seq) end, case when b.kind = 'L' then 'item' when t.in_list then 'plain' when b.kind = 'Table' then 'row' else 'plain' end,
    case when b.kind = 'L' then case when t.in_list then t.list else b.seq end end, case when not t.in_list and b.kind not in ('L', 'Table') then t.open end from t join b on b.doc_id = t.doc_id and b.page = t.page and b.i = t.i + 1),
z as (select doc_id, page, closed as open, seq as spot from t where closed is not null), q as (select distinct doc_id, page from t where i = n and role = 'item'),
rw as (select t.*, coalesce(z.spot, 4611686018427387904) as spot, row_number() over (partition by t.doc_id, t.page, t.open order by seq) - 1 as k from t left join z on z.doc_id = t.doc_id and z.page = t.page and z.open = t.open where role = 'row' and (z.spot is not null or (t.doc_id, t.page) not in (select (doc_id, page) from q))),
li as (select *, row_number() over (partition by doc_id, page, list order by seq) - 1 as k from t where role = 'item'),
num as (select doc_id, page, list, bool_or(regexp_matches(text, '^\s*[0-9]+[.)\]]\s+')) as ordered, coalesce(min_by(f, seq) filter (where f is not null), 'None') as f from (select *, {v.FIRST_NUMBERING} as f from li) y group by all),
tops as (select doc_id, page, concat('B', seq) as node_id, kind as type, text, seq as spot, 2 as turn, null as attribute from t where role = 'plain'
  union all select li.doc_id, li.page, concat('L', li.list), 'L', '', max(seq), 2, max(case when ordered then concat('ListNumbering=', num.f) end) from li join num on num.doc_id = li.doc_id and num.page = li.page and num.list = li.list group by li.doc_id, li.page, li.list
  union all select doc_id, page, concat('T', open), 'Table', '', max(spot), 1, null from rw group by doc_id, page, open),
cl as (select doc_id, page, seq, k, unnest(cs) as cell, unnest(range(0, len(cs))) as c from (select *, list_filter(list_transform(regexp_split_to_array(text, '\s{{2,}}|\t|\|'), lambda v: trim(v)), lambda v: v <> '') as cs from rw) y)
select doc_id, page, node_id, null as parent_id, row_number() over (partition by doc_id, page order by spot, turn) - 1 as place, type, text, attribute from tops
union all {_PARTS.format(rows='li', parent="concat('L', list)", at='k')}
union all select doc_id, page, concat('R', seq), concat('T', open), k, 'TR', '', null from rw
union all select doc_id, page, concat('C', seq, '.', c), concat('R', seq), c, case when k = 0 then 'TH' else 'TD' end, cell, case when k = 0 then 'Scope=Column' end from cl""".replace("{{2,}}", "{2,}"))(outline.built)
over(fx.BLOCKS, "heading_sections", "with b as (select *, try_cast(regexp_extract(kind, '^H([1-6])$', 1) as integer) as level from {s} x), u as (select b.*, (select max(a.seq) from b a where a.doc_id = b.doc_id and a.seq < b.seq and a.level < coalesce(b.level, 9)) as up from b), o as (select doc_id, page, seq, concat('B', seq) as node_id, case when level is not null then concat('S', seq) when up is not null then concat('S', up) end as parent_id, kind as type, text from u union all select doc_id, page, seq, concat('S', seq), case when up is not null then concat('S', up) end, 'Sect', '' from u where level is not null) select doc_id, page, node_id, parent_id, row_number() over (partition by doc_id, parent_id order by seq) - 1 as place, type, text, cast(null as varchar) as attribute from o")(outline.sections)
over(fx.INDENTED, "indented_lists", f"""with s as (select *, regexp_matches(text, '{v.ITEM}') as item, length(regexp_extract(text, '^(\\s*)', 1)) as indent from {{s}} x), r as (select *, sum(case when item then 0 else 1 end) over (partition by doc_id order by seq) as run from s), o as (select * from r where item),
u as (select o.*, (select max(a.seq) from o a where a.doc_id = o.doc_id and a.run = o.run and a.seq < o.seq and a.indent < o.indent) as up from o), l as (select *, min(seq) over (partition by doc_id, run, up) as list, row_number() over (partition by doc_id, run, up order by seq) - 1 as k from u)
select doc_id, page, concat('L', list) as node_id, case when up is not null then concat('Body', up) end as parent_id, 0 as place, 'L' as type, '' as text, null as attribute from l where seq = list union all {_PARTS.format(rows='l', parent="concat('L', list)", at='k')}""")(outline.indented_lists)

# ---- grids of tables -----------------------------------------------------------------

#: g, cells with their places: each takes the first column of its row that no cell before it covers.
_GRID = """s as (select *, dense_rank() over (partition by table_id order by row_id) - 1 as r, greatest(coalesce(try_cast(trim(rowspan) as integer), 1), 1) as h, greatest(coalesce(try_cast(trim(colspan) as integer), 1), 1) as w from {s} x),
o as (select *, row_number() over (partition by table_id order by r, col) as i from s),
t as (select table_id, i, 0 as c, [{'a': 0, 'b': 0 + w, 'e': r + h}] as held from o where i = 1
  union all select o.table_id, o.i, f.c, list_append(t.held, {'a': f.c, 'b': f.c + o.w, 'e': o.r + o.h}) from t join o on o.table_id = t.table_id and o.i = t.i + 1,
    lateral (select cast(list_filter(range(0, 400), lambda x: len(list_filter(t.held, lambda y: y.a <= x and x < y.b and y.e > o.r)) = 0)[1] as integer) as c) f),
g as (select o.*, t.c from o join t on t.table_id = o.table_id and t.i = o.i)"""
over(fx.CELLS, "cell_grid", f"with recursive {_GRID} select table_id, row_id, col, r as \"row\", c as \"column\", h as high, w as wide from g")(lambda c: grid.placed(c).select("table_id", "row_id", "col", "row", "column", "high", "wide"))
over(fx.CELLS, "header_relations", f"""with recursive {_GRID},
rr as (select table_id, r, count(*) as n, count(*) filter (where kind = 'TH') as heads, bool_or(h > 1 or w > 1) as spans from g group by all), hr as (select table_id, r from rr where heads > 0.5 * n),
xx as (select table_id, kind, unnest(range(c, c + w)) as x from g), hc as (select table_id, x from xx group by table_id, x having count(*) filter (where kind = 'TH') > 0.5 * count(*)),
need as (select table_id from rr group by table_id having (bool_or(heads > 0.5 * n) and table_id in (select table_id from hc)) or bool_or(spans) or max(n) <> min(n)),
k as (select g.*, case when trim(cell_id) <> '' then trim(cell_id) else concat('th_r', r, '_c', c) end as name, (g.table_id, r) in (select (table_id, r) from hr) as in_head from g where table_id in (select table_id from need)),
q as (select d.table_id, d.row_id, d.col, 0 as side, a.c as f1, a.r as f2, a.name from k d join k a on a.table_id = d.table_id and a.kind = 'TH' and a.c < d.c and a.r < d.r + d.h and d.r < a.r + a.h where d.kind = 'TD' and not d.in_head
  union all select d.table_id, d.row_id, d.col, 1, a.r, a.c, a.name from k d join k a on a.table_id = d.table_id and a.kind = 'TH' and a.in_head and a.r < d.r and a.c < d.c + d.w and d.c < a.c + a.w where d.kind = 'TD' and not d.in_head),
e as (select *, row_number() over (partition by table_id, row_id, col, name order by side, f1, f2) as nth from q)
select table_id, row_id, col, 'id' as attribute, name as value from k where kind = 'TH' and trim(cell_id) = ''
union all select table_id, row_id, col, 'headers', string_agg(name, ' ' order by side, f1, f2, name) from e where nth = 1 group by table_id, row_id, col""")(grid.relations)
over(fx.CELLS, "missing_cells", "with r as (select table_id, row_id, count(*) as n from {s} x group by all), m as (select *, max(n) over (partition by table_id) as most from r) select table_id, row_id, unnest(range(n, most)) as \"column\", 'TD' as type from m where n < most")(grid.missing_cells)
over(fx.CELLS, "header_cell_repairs", f"with recursive {_GRID}, hr as (select table_id, r from g group by all having count(*) filter (where kind = 'TH') > 0.5 * count(*)), hc as (select table_id, x from (select table_id, kind, unnest(range(c, c + w)) as x from g) y group by all having count(*) filter (where kind = 'TH') > 0.5 * count(*)) select table_id, row_id, col, 'TD' as old, 'TH' as new from g where kind = 'TD' and ((table_id, r) in (select (table_id, r) from hr) or (table_id, cast(c as bigint)) in (select (table_id, x) from hc))")(grid.header_repairs)

# ---- tables of untagged pages --------------------------------------------------------


def _folds(points: str, by: str, value: str, gap: int, to: str) -> str:
    """Recursive parts that fold sorted values into groups anchored at their first: to has by, k and mean."""
    on = " and ".join(f"v.{k} = t.{k}" for k in by.split(", "))
    own = ", ".join(f"v.{k}" for k in by.split(", "))
    return f"{to}_v as (select {by}, {value} as val, row_number() over (partition by {by} order by {value}) as i from {points}), {to}_t as (select {by}, val, i, val as anchor, 0 as k from {to}_v where i = 1 union all select {own}, v.val, v.i, case when v.val - t.anchor < {gap} then t.anchor else v.val end, case when v.val - t.anchor < {gap} then t.k else t.k + 1 end from {to}_t t join {to}_v v on {on} and v.i = t.i + 1), {to} as (select {by}, k, avg(val) as mean from {to}_t group by {by}, k)"


_RULED = f"""d as (select *, greatest(abs(x0 - x1), abs(y0 - y1)) as len from {{drawn}} x), f as (select * from (select *, count(*) over w as n, avg(len) over w as m from d window w as (partition by doc_id, page)) y where n >= 4 and len > 0.3 * m),
sd as (select doc_id, page from f group by all having count(*) filter (where abs(y0 - y1) < 2) >= 2 and count(*) filter (where abs(x0 - x1) < 2) >= 2),
pt as (select doc_id, page, px, py from (select h.doc_id, h.page, v.x0 as px, h.y0 as py, count(*) over (partition by h.doc_id, h.page) as n from f h join f v on v.doc_id = h.doc_id and v.page = h.page and abs(h.y0 - h.y1) < 2 and abs(v.x0 - v.x1) < 2 and v.x0 between least(h.x0, h.x1) - 2 and greatest(h.x0, h.x1) + 2 and h.y0 between least(v.y0, v.y1) - 2 and greatest(v.y0, v.y1) + 2 where (h.doc_id, h.page) in (select (doc_id, page) from sd)) y where n >= 4),
{_folds("pt", "doc_id, page", "py", 5, "ry")}, {_folds("pt", "doc_id, page", "px", 5, "cx")},
nr as (select p.doc_id, p.page, p.px, p.py, min_by(ry.k, abs(ry.mean - p.py) + ry.k * 1e-9) as a from (select distinct * from pt) p join ry on ry.doc_id = p.doc_id and ry.page = p.page group by all),
nc as (select nr.doc_id, nr.page, nr.a, min_by(cx.k, abs(cx.mean - nr.px) + cx.k * 1e-9) as b from nr join cx on cx.doc_id = nr.doc_id and cx.page = nr.page group by nr.doc_id, nr.page, nr.a, nr.px, nr.py),
sz as (select doc_id, page, (select count(*) from ry where ry.doc_id = q.doc_id and ry.page = q.page) as rn, (select count(*) from cx where cx.doc_id = q.doc_id and cx.page = q.page) as cn, count(distinct (a, b)) as full_ones from nc q group by doc_id, page),
gr as (select * from sz where rn >= 2 and cn >= 2 and full_ones / (rn * cn) >= 0.5),
rt as (select g.doc_id, g.page, 'lines' as source, 0 as number, (select min(mean) - 1 from cx where cx.doc_id = g.doc_id and cx.page = g.page) as x0, (select min(mean) - 1 from ry where ry.doc_id = g.doc_id and ry.page = g.page) as y0, (select max(mean) + 1 from cx where cx.doc_id = g.doc_id and cx.page = g.page) as x1, (select max(mean) + 1 from ry where ry.doc_id = g.doc_id and ry.page = g.page) as y1, rn as n_rows, cn as n_cols from gr g)"""
_ALIGNED = f"""ln as (select doc_id, page, line_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from {{printed}} x group by all having bool_or(trim(text) <> '')),
gp as (select *, sum(nw) over (partition by doc_id, page order by y0, line_id) as block from (select *, case when y0 - lag(y1) over w < (y1 - y0 + lag(y1 - y0) over w) / 2 * 1.5 then 0 else 1 end as nw from ln window w as (partition by doc_id, page order by y0, line_id)) y),
sl as (select *, row_number() over (partition by doc_id, page, block order by y0, line_id) - 1 as r from (select *, count(*) over (partition by doc_id, page, block) as n from gp) y where n >= 2),
st as (select sl.doc_id, sl.page, sl.block, p.x0 as sx from {{printed}} p join sl on sl.doc_id = p.doc_id and sl.page = p.page and sl.line_id = p.line_id),
{_folds("st", "doc_id, page, block", "sx", 10, "tc")},
cs as (select doc_id, page, block, count(*) as n_cols, list(mean order by k) as means from tc group by all having count(*) >= 2),
tt as (select b.*, n_cols, means, row_number() over (partition by b.doc_id, b.page order by b.block) - 1 as number from (select doc_id, page, block, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n_rows from sl group by all) b join cs on cs.doc_id = b.doc_id and cs.page = b.page and cs.block = b.block),
tw as (select distinct t.doc_id, t.page, t.number from tt t join rt o on o.doc_id = t.doc_id and o.page = t.page where (t.x1 - t.x0) * (t.y1 - t.y0) > 0 and (o.x1 - o.x0) * (o.y1 - o.y0) > 0 and greatest(least(t.x1, o.x1) - greatest(t.x0, o.x0), 0) * greatest(least(t.y1, o.y1) - greatest(t.y0, o.y0), 0) / least((t.x1 - t.x0) * (t.y1 - t.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) > 0.7)"""
_PAGES = {"drawn": fx.DRAWN, "printed": fx.PRINTED}
_SIX = "round(x0, 6) as x0", "round(y0, 6) as y0", "round(x1, 6) as x1", "round(y1, 6) as y1"
_six = ", ".join(_SIX)
of_many(_PAGES, "detected_tables", f"with recursive {_RULED}, {_ALIGNED} select doc_id, page, source, number, {_six}, n_rows, n_cols from (select doc_id, page, source, number, x0, y0, x1, y1, n_rows, n_cols from rt union all select doc_id, page, 'text', number, x0, y0, x1, y1, n_rows, n_cols from tt where (doc_id, page, number) not in (select (doc_id, page, number) from tw)) u")(lambda drawn, printed: detect.tables(drawn, printed)[0].selectExpr(*detect.TABLE[:4], *_SIX, "n_rows", "n_cols"))
of_many(_PAGES, "detected_cells", f"""with recursive {_RULED}, {_ALIGNED},
ce as (select a.doc_id, a.page, 'lines' as source, 0 as number, a.k as r, b.k as c, b.mean as x0, a.mean as y0, (select mean from cx n where n.doc_id = b.doc_id and n.page = b.page and n.k = b.k + 1) as x1, (select mean from ry n where n.doc_id = a.doc_id and n.page = a.page and n.k = a.k + 1) as y1 from ry a join cx b on b.doc_id = a.doc_id and b.page = a.page where (a.doc_id, a.page) in (select (doc_id, page) from gr)),
te as (select doc_id, page, block, number, unnest(range(0, n_cols + 1)) as c, unnest(list_concat([x0], means)) as x0, unnest(list_append(means, x1)) as x1 from tt where (doc_id, page, number) not in (select (doc_id, page, number) from tw))
select doc_id, page, source, number, r as "row", c as col, {_six} from (select * from ce where x1 is not null and y1 is not null union all select te.doc_id, te.page, 'text', te.number, sl.r, te.c, te.x0, sl.y0, te.x1, sl.y1 from te join sl on sl.doc_id = te.doc_id and sl.page = te.page and sl.block = te.block) u""")(lambda drawn, printed: detect.tables(drawn, printed)[1].selectExpr(*detect.CELL[:6], *_SIX))
