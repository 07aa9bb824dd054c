"""Queries of reading order, histories of edits, the soundness of trees, and looks of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.operators import closure, history, integrity, layout, order, styles
from tagmill.plans import fixtures as fx
from tagmill.plans.registry import of_many, over


def columned(detected: str, lines: str) -> None:
    """The query of reading order by columns; detected: the SQL of the columns of fx.BOXES, lines: that of their lines."""
    sql = f"""{lines.replace("{s}", f"({fx.BOXES})")}, cb as (select doc_id, page, low, high, row_number() over (partition by doc_id, page order by low, high) - 1 as k from ({detected}) d),
    e as (select l.doc_id, l.page, l.elem_id, l.line, l.x0, l.x1, k, low, high, l.x0 >= low and l.x1 <= high as held, greatest(least(l.x1, high) - greatest(l.x0, low), 0) as ov from l join cb on cb.doc_id = l.doc_id and cb.page = l.page),
    f as (select *, min(case when held then k end) over (partition by doc_id, page, elem_id) as until from e),
    n as (select doc_id, page, line, k, count(*) filter (where (until is null or k <= until) and (held or (ov > 0 and ov / (x1 - x0) > 0.5))) as n, abs(avg((x0 + x1) / 2) - any_value((low + high) / 2)) as away from f group by doc_id, page, line, k),
    h as (select *, row_number() over (partition by doc_id, page, line order by case when best > 0 then -n else away end, k) as z from (select *, max(n) over (partition by doc_id, page, line) as best from n) y),
    p as (select l.doc_id, l.page, l.elem_id, l.line, h.k, l.x0, min(l.y0) over (partition by l.doc_id, l.page, l.line) as top from l join h on h.doc_id = l.doc_id and h.page = l.page and h.line = l.line and h.z = 1)
    select doc_id, elem_id, k as column_no, row_number() over (partition by doc_id, page order by k, top, line, x0, elem_id) as visual from p"""

    def run(b):
        bounds = layout.detected_columns(b).withColumn("low", F.round("low", 6))
        return order.column_order(b, bounds).select("doc_id", "elem_id", F.col("column").alias("column_no"), "visual")

    over(fx.BOXES, "column_reading_order", sql)(run)
    own = sql
    for old, new in ((f"({fx.BOXES})", f"({fx.SHAPED})"), ("select *, max(y1) over", "select *, (select greatest(coalesce(avg(b.y1 - b.y0) filter (where b.kind = 'text' and b.y1 > b.y0) * 0.67, 10), 3) from s b where b.doc_id = s.doc_id and b.page = s.page) as tolerance, max(y1) over"), ("y0 > reach + 3 ", "y0 > reach + tolerance ")):
        own = own.replace(old, new)
    over(fx.SHAPED, "detected_reading_order", own)(lambda b: order.detected_order(b).select("doc_id", "elem_id", F.col("column").alias("column_no"), "visual"))


over(fx.PLACED, "column_interleaving", "with p as (select * from {s} x) select b.doc_id, b.page, b.parent_id, b.elem_id, b.column_no, b.place as current_place, max(a.place) + 1 as expected, count(*) as passed from p b join p a on a.doc_id = b.doc_id and a.page = b.page and a.parent_id = b.parent_id and a.column_no = b.column_no - 1 and a.place > b.place group by all")(lambda p: order.interleaved(p.withColumnRenamed("column_no", "column")).withColumnsRenamed({"column": "column_no", "current": "current_place"}))
over(fx.ORDERS, "order_moves", "with recursive o as (select *, row_number() over (partition by doc_id order by current_place) as i from {s} x), t as (select doc_id, i, [wanted] as tails from o where i = 1 union all select o.doc_id, o.i, list_concat(list_filter(t.tails, lambda v: v < o.wanted), list_concat([o.wanted], list_filter(t.tails, lambda v: v >= o.wanted)[2:])) from t join o on o.doc_id = t.doc_id and o.i = t.i + 1) select doc_id, max(i) as elements, max(i) - max(len(tails)) as moved from t group by doc_id")(lambda o: order.move_counts(o.withColumnRenamed("current_place", "current"), ["doc_id"]))

# ---- near texts ----------------------------------------------------------------------

of_many({"annotations": fx.NOTES, "texts": fx.WORDED}, "annotation_content", """with p as (select a.doc_id, a.page, a.elem_id, t.elem_id as near_id, t.text, a.x0 <= t.x1 and t.x0 <= a.x1 and a.y0 <= t.y1 and t.y0 <= a.y1 as over, sqrt(pow(greatest(a.x0 - t.x1, t.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - t.y1, t.y0 - a.y1, 0), 2)) as away from {annotations} a join {texts} t on t.doc_id = a.doc_id and t.page = a.page),
c as (select doc_id, page, elem_id, string_agg(text, ' ' order by near_id) as text, min(near_id) as near_id, cast(0 as double) as distance from p where over group by all),
n as (select doc_id, page, elem_id, text, near_id, away, row_number() over (partition by doc_id, page, elem_id order by away, near_id) as k from p where (doc_id, page, elem_id) not in (select (doc_id, page, elem_id) from c))
select * from c union all select doc_id, page, elem_id, text, near_id, round(away, 6) from n where k = 1""")(lambda annotations, texts: layout.near_content(annotations, texts).withColumn("distance", F.round("distance", 6)))

# ---- histories -----------------------------------------------------------------------

_STATES = """e as (select * from {s} x), t as (select doc_id, cast(0 as bigint) as seq, '' as kind, cast(0 as bigint) as state, cast(0 as bigint) as before, true as done, cast([] as bigint[]) as us, cast([] as bigint[]) as rs, cast(0 as bigint) as original, false as modified from (select distinct doc_id from e) d
 union all select e.doc_id, e.seq, e.kind, case when e.kind = 'edit' then e.seq when e.kind = 'undo' and len(us) > 0 then us[-1] when e.kind = 'redo' and len(rs) > 0 then rs[-1] when e.kind = 'revert' then original else state end, state,
   case e.kind when 'undo' then len(us) > 0 when 'redo' then len(rs) > 0 when 'apply' then modified else true end,
   case when e.kind = 'edit' then list_append(us, state)[-50:] when e.kind = 'undo' and len(us) > 0 then us[1:len(us) - 1] when e.kind = 'redo' and len(rs) > 0 then list_append(us, state) when e.kind = 'revert' or (e.kind = 'apply' and modified) then [] else us end,
   case when e.kind = 'edit' or e.kind = 'revert' or (e.kind = 'apply' and modified) then [] when e.kind = 'undo' and len(us) > 0 then list_append(rs, state) when e.kind = 'redo' and len(rs) > 0 then rs[1:len(rs) - 1] else rs end,
   case when e.kind = 'apply' and modified then state else original end,
   case when e.kind in ('apply', 'revert') then false when e.kind = 'edit' or (e.kind = 'undo' and len(us) > 0) or (e.kind = 'redo' and len(rs) > 0) then true else modified end
 from t join e on e.doc_id = t.doc_id and e.seq = t.seq + 1)"""
over(fx.LOG, "edit_states", f"with recursive {_STATES} select doc_id, seq, kind, state, before, done, len(us) as undos, len(rs) as redos from t where seq > 0")(history.states)


def _values(log):
    known = history.states(log)
    edits = log.where("kind = 'edit'").withColumnRenamed("column_name", "column")
    return history.values_after(edits, known, known.select("doc_id", "seq")).withColumnRenamed("column", "column_name")


over(fx.LOG, "edit_values_after", f"with recursive {_STATES}, line as (select doc_id, seq as state, seq as made from t where kind = 'edit' union all select l.doc_id, l.state, t.before from line l join t on t.doc_id = l.doc_id and t.seq = l.made where t.before > 0), w as (select t.doc_id, t.seq, e.node_id, e.column_name, e.value, row_number() over (partition by t.doc_id, t.seq, e.node_id, e.column_name order by l.made desc) as k from t join line l on l.doc_id = t.doc_id and l.state = t.state join e on e.doc_id = l.doc_id and e.seq = l.made where t.seq > 0) select doc_id, seq, node_id, column_name, value from w where k = 1")(_values)

# ---- soundness of trees --------------------------------------------------------------

of_many({"nodes": fx.BROKEN, "pages": fx.PAGE_COUNTS}, "structure_faults", """with recursive n as (select * from {nodes} x), f as (select doc_id, node_id, min(parent_id) as up, count(distinct parent_id) as ups from n group by all), g as (select f.*, exists (select 1 from f p where p.doc_id = f.doc_id and p.node_id = f.up) as goes from f),
r as (select doc_id, node_id, up as above from g where goes union select r.doc_id, r.node_id, g.up from r join g on g.doc_id = r.doc_id and g.node_id = r.above and g.goes),
c as (select distinct doc_id, node_id from r where node_id = above), z as (select doc_id, node_id from g where not goes union select r.doc_id, r.node_id from r join g on g.doc_id = r.doc_id and g.node_id = r.above and not g.goes),
o as (select doc_id, node_id from g where up is not null and not goes)
select doc_id, node_id, 'orphan' as fault from o union all select doc_id, node_id, 'second parent' from f where ups > 1 union all select doc_id, node_id, 'cycle' from c union all select doc_id, node_id, 'below a cycle' from g where (doc_id, node_id) not in (select (doc_id, node_id) from z) and (doc_id, node_id) not in (select (doc_id, node_id) from c)
union all select distinct r.doc_id, r.node_id, 'below an orphan' from r join o on o.doc_id = r.doc_id and o.node_id = r.above union all select doc_id, node_id, 'second root' from (select *, row_number() over (partition by doc_id order by node_id) as k from g where up is null) y where k > 1
union all select distinct n.doc_id, n.node_id, 'page out of range' from n join {pages} q on q.doc_id = n.doc_id where page < 0 or page >= page_count""")(integrity.faults)
_UP = "with recursive n as (select * from {s} x), u as (select doc_id, node_id, parent_id, page from n where page is not null union all select u.doc_id, n.node_id, n.parent_id, u.page from u join n on n.doc_id = u.doc_id and n.node_id = u.parent_id)"
over(fx.TREES, "page_runs", f"{_UP}, d as (select distinct doc_id, node_id, page from u), g as (select *, page - row_number() over (partition by doc_id, node_id order by page) as island, count(*) over (partition by doc_id, node_id) as n from d), i as (select doc_id, node_id, min(page) as low, max(page) as high from g where n > 1 group by doc_id, node_id, island) select doc_id, node_id, row_number() over (partition by doc_id, node_id order by low) as run, low, high from i")(integrity.page_runs)
over(fx.TREES, "page_disorder", f"{_UP}, f as (select doc_id, node_id, min(page) as first from u group by all), s as (select n.doc_id, n.parent_id, n.node_id, f.first as page, max(f.first) over (partition by n.doc_id, n.parent_id order by n.place, n.node_id rows between unbounded preceding and 1 preceding) as after from n join f on f.doc_id = n.doc_id and f.node_id = n.node_id where n.parent_id is not null) select * from s where page < after")(integrity.page_disorder)
over(fx.TREES, "ancestor_pairs", "with recursive n as (select * from {s} x), u as (select doc_id, node_id, node_id as above, 0 as up from n union all select u.doc_id, u.node_id, n.parent_id, u.up + 1 from u join n on n.doc_id = u.doc_id and n.node_id = u.above where n.parent_id is not null) select * from u")(closure.ancestors)

# ---- looks of texts ------------------------------------------------------------------

_LOOKED = r"""b as (select doc_id, page, block, trim(string_agg(text, '' order by line, span)) as text, max(size) as size, bool_or(contains(lower(font), 'bold') or flags & 2 <> 0) as bold, min(y0) as y0 from {s} x group by doc_id, page, block), m as (select doc_id, avg(size) as mean from {s} x group by doc_id),
 o as (select b.*, mean, row_number() over (partition by b.doc_id, page order by block) = 1 as first from b join m on m.doc_id = b.doc_id),
 l as (select *, case when size > mean * 1.6 then 1 when size > mean * 1.4 then 2 when size > mean * 1.2 then 3 when bold and length(text) < 100 then 4 when first then 1 end as level from o where text <> ''),
 k as (select *, case when level is not null then 'heading' when regexp_matches(text, '^\s*([•⦿⦾○●◦▪▫]|[0-9]+\.|\([0-9]+\)|[a-z]\)|[ivxlcdm]+\.|[IVXLCDM]+\.)\s') then 'item' else 'paragraph' end as kind from l)"""
over(fx.LOOKED, "visual_blocks", f"with {_LOOKED} select doc_id, page, block, text, size, bold, round(mean, 6) as mean, kind, level from k")(lambda s: styles.looked(s).withColumn("mean", F.round("mean", 6)).drop("y0"))
over(fx.LOOKED, "style_ladder", f"with {_LOOKED} select doc_id, page, round(size, 1) as size, count(*) as blocks, row_number() over (partition by doc_id, page order by round(size, 1) desc) as rung from k group by doc_id, page, round(size, 1)")(lambda s: styles.ladder(styles.looked(s)))
over(fx.LOOKED, "visual_heading_warnings", f"with {_LOOKED}, h as (select *, lag(level) over (partition by doc_id, page order by y0, block) as previous from k where kind = 'heading') select doc_id, page, block, level, previous, case when previous is null then 'not the first level' else 'skips a level' end as warning from h where (previous is null and level > 1) or level > previous + 1")(lambda s: styles.heading_warnings(styles.looked(s)))
