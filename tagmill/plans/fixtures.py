"""Logical inputs of the rules, derived from the star-schema tables by plain SQL that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: With l_orderkey a total order of the lines.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY = ", ".join(ORDER)

HEADINGS = f"select l_orderkey as doc_id, {KEY}, cast(floor(l_quantity) as bigint) % 6 + 1 as level, cast(floor(l_extendedprice) as bigint) % 3 as page from lineitem"

NODES = """
select cast(r_regionkey as bigint) as doc_id, concat('r', cast(r_regionkey as string)) as node_id, cast(null as string) as parent_id, cast(0 as bigint) as sib, 'Document' as type, r_name as text, '' as lang, cast(null as bigint) as page, '' as alt, '' as scope from region
union all select n_regionkey, concat('n', cast(n_nationkey as string)), concat('r', cast(n_regionkey as string)), n_nationkey, case n_nationkey % 6 when 0 then 'Sect' when 1 then 'L' when 2 then 'P' when 3 then 'Div' when 4 then 'LI' else 'Table' end, n_name, case n_nationkey % 5 when 0 then 'es' when 3 then 'x-' else '' end, null, '', '' from nation
union all select n_regionkey, concat('c', cast(c_custkey as string)), concat('n', cast(c_nationkey as string)), c_custkey, case c_custkey % 5 when 0 then 'Div' when 1 then 'LI' when 2 then 'Span' when 3 then 'TR' else 'L' end, case when c_custkey % 6 = 0 then ' ' else c_name end, case when c_custkey % 5 = 0 then 'fr' else '' end, case when c_custkey % 3 = 0 then null else c_custkey % 7 end, '', '' from customer join nation on c_nationkey = n_nationkey
union all select n_regionkey, concat('o', cast(o_orderkey as string)), concat('c', cast(o_custkey as string)), o_orderkey, case o_orderkey % 12 when 0 then 'P' when 1 then 'LBody' when 2 then 'H2' when 3 then 'TD' when 4 then 'Custom' when 5 then 'TH' when 6 then 'Figure' when 7 then 'Link' when 8 then 'H4' when 9 then 'TextContent' when 10 then 'LI' else 'H1' end, case when o_orderkey % 7 = 0 then '' else o_orderpriority end, '', o_orderkey % 50, case when o_orderkey % 5 = 0 then 'a description' else '' end, case when o_orderkey % 2 = 0 then 'Row' else '' end from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""

CELLS = f"""
select l_orderkey as table_id, l_suppkey % 3 as row_id, row_number() over (partition by l_orderkey, l_suppkey % 3 order by {KEY}) as col,
  case when l_partkey % 3 = 0 then 'TH' else 'TD' end as kind,
  case when l_partkey % 23 = 0 then 'x' when l_partkey % 21 = 0 then cast(l_linenumber as string) when l_partkey % 39 = 0 then '0' else '' end as colspan,
  case when l_suppkey % 29 = 0 then '9' when l_suppkey % 31 = 0 then '1' else '' end as rowspan,
  case when l_suppkey % 4 = 0 then 'Row' when l_suppkey % 4 = 1 then 'row' else '' end as scope, case when l_orderkey % 2 = 0 then concat('c', cast(l_linenumber as string)) else '' end as cell_id,
  case when l_orderkey % 4 = 0 then concat('c', cast(l_partkey % 9 as string), ' c', cast(l_linenumber as string)) else '' end as headers, l_suppkey % 5 > 0 as filled
from lineitem
"""

BOXES = f"""
select doc_id, cast(0 as bigint) as page, cast(row_number() over (partition by doc_id order by {KEY}) as bigint) as elem_id, l_linenumber as pre_order,
  x0, y0, x0 + 10 + q as x1, y0 + 5 + l_linenumber as y1, l_returnflag as font, 8 + q % 7 as size, cast(l_partkey % 5 as bigint) as color
from (select l_orderkey as doc_id, {KEY}, l_returnflag, cast((l_partkey * 7) % 60 as double) as x0, cast((l_suppkey * 13) % 40 as double) as y0, cast(floor(l_quantity) as double) as q from lineitem) t
"""

ROWS = f"select doc_id as table_id, elem_id as row_id, elem_id as pre_order, case color when 0 then 'THead' when 1 then 'TBody' when 2 then 'TBody' when 3 then 'TFoot' else null end as section, case when size = 9 then null else y0 end as y0, y1 from ({BOXES}) b"

SWATCHES = f"""
select doc_id, cast(0 as bigint) as page, cast(row_number() over (partition by doc_id order by l_orderkey, {KEY}) as bigint) as elem_id,
  case when l_partkey % 9 = 0 then 'text' when l_partkey % 2 = 0 then 'rect' else 'path' end as kind, cast(case when l_partkey % 10 = 7 then null else l_partkey % 5 end as bigint) as color, x0, y0, x0 + 8 as x1, y0 + 8 as y1
from (select cast(floor(l_orderkey / 16) as bigint) as doc_id, l_orderkey, {KEY}, cast((l_partkey * 37) % 600 as double) as x0, cast((l_suppkey * 53 + l_linenumber * 17) % 800 as double) as y0 from lineitem) t
"""

COLOURS = f"""
select l_orderkey as doc_id, {KEY}, cast(l_partkey % 256 as int) as r, cast((l_suppkey * 7) % 256 as int) as g, cast((l_linenumber * 37) % 256 as int) as b,
  cast((l_orderkey * 11) % 256 as int) as br, cast((l_partkey * 5) % 256 as int) as bg, cast((l_suppkey * 3) % 256 as int) as bb,
  cast(floor(l_quantity) as double) as size, l_returnflag = 'R' as bold from lineitem
"""

META = """
select doc_id, concat('docs/', source, '-', cast(doc_id as string), '_final.pdf') as filename, doc_id % 5 > 0 as has_xmp, doc_id % 4 > 1 as pdf_ua_flag,
  case doc_id % 11 when 0 then '' when 1 then 'Untitled' when 2 then concat('docs/', source, '-', cast(doc_id as string), '_final.pdf') when 3 then 'a|b' when 4 then 'ab' when 5 then 'Temporal' when 6 then ' test case ' when 7 then 'PDF FILE' else substring(text, 1, 60) end as title,
  case doc_id % 11 when 0 then '' when 1 then 'Untitled' when 3 then 'a|b' when 6 then null else substring(text, 1, 60) end as info_title,
  case doc_id % 11 when 2 then concat('docs/', source, '-', cast(doc_id as string), '_final.pdf') when 4 then 'ab' when 5 then 'Temporal' when 6 then '  ' when 8 then substring(text, 1, 230) else null end as xmp_title,
  case doc_id % 9 when 0 then '' when 1 then lang when 2 then upper(lang) when 3 then concat(lang, '-XX') when 4 then 'xx_1' when 5 then 'pt-AO' when 6 then 'ar' when 7 then 'ja-JP' else concat(lang, '-', lang) end as language, doc_id % 10 > 0 as has_lang,
  case when doc_id % 4 = 0 then source else '' end as author, case doc_id % 3 when 0 then 'x' when 1 then 'Document12' else '' end as subject, case when doc_id % 7 = 0 then 'k' else null end as keywords,
  doc_id % 6 > 0 as has_viewer_preferences, case doc_id % 3 when 0 then true when 1 then false else null end as display_title
from documents
"""

#: Codes of all kinds that the rules on languages tell apart.
CODES = "select doc_id, case doc_id % 16 when 0 then 'ar-EG' when 1 then 'he' when 2 then 'ha' when 3 then 'zh-CN' when 4 then 'ja-JP' when 5 then 'ko-KR' when 6 then 'ja' when 7 then 'en' when 8 then 'en_US' when 9 then 'PT-br' when 10 then 'fr-' when 11 then '' when 12 then 'xx1' when 13 then 'zh-hans' when 14 then 'catalan' else 'sd' end as language from documents"

#: Running heads of documents of a few pages: mostly alike, some of their own.
HEADERS = "select o_custkey as doc_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as page, case when o_orderkey % 7 = 0 then concat('chapter ', o_orderpriority) when o_orderkey % 11 = 0 then '' else concat('Report of the year on all that was bought by customer ', cast(o_custkey as string), ' part ', case when o_orderkey % 2 = 0 then 'one' else 'two' end) end as text from orders"

LINES = """
select doc_id, cast(0 as bigint) as page, cast(k as bigint) as seq,
  concat(case (doc_id + k) % 9 when 0 then '- ' when 1 then '- ' when 2 then concat(cast(k as string), '. ') when 3 then concat(cast(k as string), ') ') when 4 then 'a) ' when 5 then 'B. ' when 6 then 'iv) ' when 7 then 'xL. ' else '' end, line) as text
from ({exploded}) t where line <> ''
"""
LINES_SPARK = LINES.replace("{exploded}", r"select doc_id, posexplode(split(text, '\n')) as (k, line) from documents")
LINES_DUCK = LINES.replace("{exploded}", "select doc_id, unnest(range(0, len(s))) as k, unnest(s) as line from (select doc_id, string_split(text, chr(10)) as s from documents)")

FIELDS = "select p_partkey as field_id, concat(case p_partkey % 4 when 0 then 'txt' when 1 then 'chk_' when 2 then 'cmb' else '' end, replace(p_brand, '#', 'No'), '_', case when p_partkey % 2 = 0 then 'firstName' else 'ZIPCode' end) as name, case p_size % 4 when 0 then 'Btn' when 1 then 'Tx' when 2 then 'Ch' else 'Sig' end as type, cast(case p_partkey % 3 when 0 then 65536 when 1 then 32768 else 0 end as int) as flags from part"

IMAGES = "select o_custkey % 50 as doc_id, o_orderkey % 97 as page, o_orderkey as image_id from orders where o_orderstatus = 'F'"
FIGURES = "select o_custkey % 50 as doc_id, o_orderkey % 97 as page, o_orderkey as figure_id from orders where o_orderstatus = 'O'"

ROLES = "select n_regionkey as doc_id, concat('X', cast(n_nationkey as string)) as custom, case n_nationkey % 5 when 0 then 'P' when 1 then concat('X', cast(n_nationkey - 1 as string)) when 2 then concat('X', cast(n_nationkey as string)) when 3 then 'Unknown' else 'H1' end as mapped from (select n_nationkey, cast(0 as int) as n_regionkey from nation) t"

#: Names of types as documents have them.
NAMES = "select p_partkey as id, case p_partkey % 37 when 0 then 'H7' when 1 then 'HeaderCell' when 2 then 'Subtitle' when 3 then 'Chapter' when 4 then 'Section' when 5 then 'ParaStyle' when 6 then 'TextBlock' when 7 then 'Image' when 8 then 'ImgBox' when 9 then 'Picture' when 10 then 'Figure1' when 11 then 'TableData' when 12 then 'RowData' when 13 then 'Cell' when 14 then 'thCell' when 15 then 'TdCell' when 16 then 'ListBlock' when 17 then 'ItemBody' when 18 then 'BulletList' when 19 then 'NumberedList' when 20 then 'CaptionText' when 21 then 'LinkText' when 22 then 'Footnote' when 23 then 'Note1' when 24 then 'Quotation' when 25 then 'FormulaBlock' when 26 then 'Division' when 27 then 'Spanning' when 28 then 'AnnotationX' when 29 then 'FormField' when 30 then 'ReferenceX' when 31 then '' when 32 then 'Title2' when 33 then 'Heading 1' when 34 then null when 35 then 'Theme' else p_type end as name from part"

ANNOTATIONS = "select p_partkey % 300 as doc_id, cast(p_partkey % 9 as bigint) as page, p_partkey as annot_id, case p_size % 4 when 0 then 'Widget' when 1 then 'Link' when 2 then 'PrinterMark' else 'Text' end as subtype, case when p_partkey % 3 = 0 then p_name else '' end as contents, case when p_partkey % 5 = 0 then p_brand else '' end as alt, case when p_partkey % 2 = 0 then p_type else '' end as tu from part"
OUTLINES = "select doc_id from documents where doc_id % 2 = 0"

#: Documents and whether they have a tree.
STRUCTURED = "select doc_id, doc_id % 3 > 0 as has_structure from documents"


#: Versions of values of nodes, later ones over earlier ones.
EDITS = f"select l_orderkey as doc_id, concat('n', cast(l_suppkey % 3 as string)) as node_id, case l_partkey % 2 when 0 then 'type' else 'text' end as column_name, cast(row_number() over (partition by l_orderkey order by {KEY}) as bigint) as version, case when l_partkey % 7 = 0 then '' else l_returnflag end as value from lineitem"
#: Nodes with the texts that looks are told by.
LOOKS = NODES.replace("n_name, case", "case n_nationkey % 3 when 0 then '1.2 On nations:' when 1 then 'A figure of a nation' else n_name end, case").replace("case when c_custkey % 6 = 0 then ' ' else c_name end", "case c_custkey % 9 when 0 then '' when 1 then '- an item' when 2 then 'b) ' when 3 then '12.' when 4 then 'diagram 4' when 5 then 'A sentence of some length that goes on and on and ends here.' else c_name end")
LINKS = "select doc_id, annot_id, has_objr, alt from (select p_partkey % 300 as doc_id, p_partkey as annot_id, p_partkey % 4 = 0 as has_objr, case when p_partkey % 5 = 0 then 'x' else '' end as alt, p_partkey % 7 as k from part) e where k > 1"

#: The lines of orders, numbered within their order.
_NUMBERED = f"select l.*, o_custkey, row_number() over (partition by l_orderkey order by {KEY}) as rn from lineitem l join orders on l_orderkey = o_orderkey"
#: Trees of many documents, a customer's each: orders, their lines, and parts of lines.
TREES = f"""
select distinct o_custkey as doc_id, concat('d', cast(o_custkey as string)) as node_id, cast(null as string) as parent_id, cast(0 as bigint) as place, 'Document' as type, cast(null as bigint) as page, '' as actual, '' as alt, '' as expansion from orders
union all select o_custkey, concat('o', cast(o_orderkey as string)), concat('d', cast(o_custkey as string)), o_orderkey, case o_orderkey % 6 when 0 then 'Sect' when 1 then 'P' when 2 then 'Figure' when 3 then 'Span' when 4 then 'LI' else 'Div' end, case when o_orderkey % 4 = 0 then null else o_orderkey % 3 end,
  case when o_orderkey % 11 = 0 then ' said  instead ' when o_orderkey % 7 = 0 then '  ' else '' end, case when o_orderkey % 5 = 0 then 'a picture' else '' end, case when o_orderkey % 13 = 0 then 'in full' else '' end from orders
union all select o_custkey, concat('l', cast(l_orderkey as string), '-', cast(rn as string)), concat('o', cast(l_orderkey as string)), rn, case l_partkey % 4 when 0 then 'P' when 1 then 'Figure' when 2 then 'TD' else 'Span' end, case when l_suppkey % 3 = 0 then l_suppkey % 2 else null end,
  '', case when l_partkey % 10 = 1 then 'drawn' else '' end, case when l_partkey % 17 = 0 then 'spelled  out' else '' end from ({_NUMBERED}) a where l_partkey % 3 <> 0
union all select o_custkey, concat('e', cast(l_orderkey as string), '-', cast(rn as string)), concat('l', cast(l_orderkey as string), '-', cast(rn as string)), cast(1 as bigint), 'Span', cast(null as bigint), case when l_suppkey % 22 = 0 then 'short' else '' end, '', '' from ({_NUMBERED}) b where l_partkey % 3 <> 0 and l_suppkey % 2 = 0
"""
#: What they hold beside elements, and what is drawn on their pages.
ITEMS = f"""
select o_custkey as doc_id, concat('o', cast(l_orderkey as string)) as node_id, cast(rn as bigint) as place, case when l_partkey % 2 = 0 then concat(' word', cast(l_partkey % 100 as string), '  ') else cast(null as string) end as text, case when l_partkey % 2 = 0 then null else cast(l_suppkey % 20 as bigint) end as mcid from ({_NUMBERED}) a where l_partkey % 3 = 0
union all select o_custkey, concat('l', cast(l_orderkey as string), '-', cast(rn as string)), cast(0 as bigint), null, cast(l_suppkey % 20 as bigint) from ({_NUMBERED}) b where l_partkey % 3 <> 0
union all select o_custkey, concat('e', cast(l_orderkey as string), '-', cast(rn as string)), cast(0 as bigint), case when l_suppkey % 4 = 0 then '' else concat(l_returnflag, 'x') end, null from ({_NUMBERED}) c where l_partkey % 3 <> 0 and l_suppkey % 2 = 0
"""
MARKS = f"select o_custkey as doc_id, cast(l_linenumber % 3 as bigint) as page, cast(l_suppkey % 21 - 1 as bigint) as mcid, cast(l_orderkey * 100 + rn as bigint) as seq, concat('m', cast(l_partkey % 50 as string)) as text from ({_NUMBERED}) a where l_quantity > 10"

#: Blocks of pages and lines of lists, in order.
BLOCKS = f"""
select doc_id, page, seq, kind, case kind when 'L' then concat(case p % 3 when 0 then concat(cast(seq as string), '. ') when 1 then '- ' else 'iv) ' end, 'item ', cast(p as string)) when 'Table' then concat('one  ', cast(p as string), ' |two', case when p % 2 = 0 then '   ' else ' | three' end) else concat('words ', cast(p as string)) end as text
from (select cast(floor(l_orderkey / 16) as bigint) as doc_id, cast(floor(l_orderkey / 4) as bigint) % 4 as page, row_number() over (partition by cast(floor(l_orderkey / 16) as bigint) order by l_orderkey, {KEY}) as seq, case l_partkey % 7 when 0 then 'L' when 1 then 'L' when 2 then 'Table' when 3 then 'Table' when 4 then concat('H', cast(l_suppkey % 6 + 1 as string)) when 5 then 'P' else 'Figure' end as kind, l_partkey as p from lineitem) t
"""
INDENTED = f"select cast(floor(l_orderkey / 16) as bigint) as doc_id, cast(0 as bigint) as page, row_number() over (partition by cast(floor(l_orderkey / 16) as bigint) order by l_orderkey, {KEY}) as seq, concat(repeat('  ', cast(l_suppkey % 4 as int)), case l_partkey % 5 when 0 then '- ' when 1 then '2. ' when 2 then 'a) ' when 3 then '* ' else case when l_linenumber % 3 = 0 then '' else 'x] ' end end, 'w', cast(l_partkey as string)) as text from lineitem"

#: Drawn lines and texts of pages that hold tables or nearly do.
DRAWN = f"""
select cast(floor(l_orderkey / 4) as bigint) as doc_id, cast(0 as bigint) as page, row_number() over (partition by cast(floor(l_orderkey / 4) as bigint) order by l_orderkey, {KEY}) as line_id,
  cast(case when l_linenumber % 2 = 1 then 5 * (l_partkey % 3) else 40 * (l_partkey % 3) + l_suppkey % 2 end as double) as x0, cast(case when l_linenumber % 2 = 1 then 30 * (l_suppkey % 3) + l_partkey % 2 else 5 * (l_suppkey % 2) end as double) as y0,
  cast(case when l_linenumber % 2 = 1 then case when l_partkey % 13 = 0 then 20 else 100 - l_suppkey % 2 * 30 end else 40 * (l_partkey % 3) + l_suppkey % 2 + case when l_partkey % 17 = 0 then 9 else 0 end end as double) as x1, cast(case when l_linenumber % 2 = 1 then 30 * (l_suppkey % 3) + l_partkey % 2 + 1 else 80 end as double) as y1
from lineitem
"""
PRINTED = f"""
select cast(floor(l_orderkey / 4) as bigint) as doc_id, cast(0 as bigint) as page, l_orderkey as line_id, row_number() over (partition by l_orderkey order by {KEY}) as span_id,
  cast(45 * (l_linenumber % 3) + l_partkey % 4 as double) as x0, cast(18 * (l_orderkey % 4) + case when l_orderkey % 12 > 6 then 40 else 0 end as double) as y0, cast(45 * (l_linenumber % 3) + l_partkey % 4 + 30 as double) as x1, cast(18 * (l_orderkey % 4) + case when l_orderkey % 12 > 6 then 40 else 0 end + 9 + l_suppkey % 2 as double) as y1, case when l_partkey % 7 = 0 then ' ' else l_returnflag end as text
from lineitem
"""

#: Links of documents with the addresses that they lead to.
ADDRESSES = "select l_orderkey as doc_id, case when l_partkey % 5 = 0 then ' ' else concat(' part ', cast(l_linenumber % 2 as string), ' ') end as text, case when l_suppkey % 2 = 0 then 'https://a.example/x' else concat('https://a.example/', cast(l_suppkey % 4 as string)) end as dest from lineitem"
#: Nodes with all that they may say.
TALKING = f"select *, case when node_id like '%7' then 'said' else '' end as actual, case when node_id like '%3' then 'full' else '' end as expansion from ({NODES}) t"
#: Nodes with captions within and beside figures.
CAPTIONED = LOOKS.replace("when 1 then 'LBody'", "when 1 then 'Caption'").replace("when 2 then 'Span'", "when 2 then 'Figure'").replace("when 3 then 'TR'", "when 3 then 'Caption'")
#: Texts as they are seen, and boxes with the looks of texts and what they are tagged as.
SEEN = f"select *, cast(l_linenumber % 3 as bigint) as page, cast(null as string) as element_id, case when l_partkey % 19 = 0 then ' ' else concat(' number ', cast(l_partkey as string), ' of a text of some ', cast(l_suppkey * 1000 as string)) end as text, cast(case when l_suppkey % 10 = 0 then 16 else 4 end as int) as flags from ({COLOURS}) t"
STYLED = f"select *, concat('f', cast(elem_id % 2 as string)) as font, cast(8 + elem_id % 2 as bigint) as size from ({SWATCHES}) t"
TAGGED = f"select doc_id, page, elem_id, case when doc_id % 2 = 0 then concat('T', cast(color as string)) else 'P' end as type from ({SWATCHES}) t where kind = 'text' and doc_id % 3 > 0"
#: The rows of tables, some without cells, and tables without rows.
FRAMES = "select distinct l_orderkey as table_id, l_suppkey % 3 as row_id from lineitem union all select o_orderkey, cast(7 as bigint) from orders where o_orderkey % 5 = 0 union all select o_orderkey + 1000000000, cast(null as bigint) from orders where o_orderkey % 9 = 0"
UNTAGGED = "select doc_id, doc_id % 3 as page, case when doc_id % 7 = 0 then ' ' else text end as text from documents"
WITHOUT_TREE = "select doc_id from documents where doc_id % 3 = 0"
GLYPHS = f"select l_orderkey as doc_id, cast(l_linenumber % 3 as bigint) as page, case when l_partkey % 23 = 0 then 'a\ufffd' when l_partkey % 29 = 0 then '\x01b' when l_partkey % 31 = 0 then '\U0001f600' else l_returnflag end as text from lineitem"

_LINES_OF = f"select *, row_number() over (partition by doc_id order by l_orderkey, {KEY}) as rn from (select *, cast(floor(l_orderkey / 4) as bigint) as doc_id from lineitem) q"
#: Elements with their place among their siblings and their column, and orders of siblings.
PLACED = f"select doc_id, cast(0 as bigint) as page, l_orderkey % 2 as parent_id, rn as elem_id, cast(row_number() over (partition by doc_id, l_orderkey % 2 order by rn) - 1 as bigint) as place, cast(l_suppkey % 3 as bigint) as column_no from ({_LINES_OF}) t"
ORDERS = f"select doc_id, rn as elem_id, cast(rn as bigint) as current_place, cast(row_number() over (partition by doc_id order by l_partkey, rn) as bigint) as wanted from ({_LINES_OF}) t"
#: Logs of edits with what is taken back and done again.
LOG = "select user_id as doc_id, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as seq, case when event_id % 29 = 0 then 'apply' when event_id % 37 = 0 then 'revert' when event_type = 'view' then 'undo' when event_type = 'click' then 'redo' when event_type = 'error' and event_id % 3 = 0 then 'undo' else 'edit' end as kind, concat('n', cast(event_id % 5 as string)) as node_id, case when event_id % 2 = 0 then 'type' else 'text' end as column_name, concat('v', cast(event_id as string)) as value from events"
#: Trees that aren't: parents that are missing, second or in cycles, and pages out of range.
BROKEN = f"select doc_id, rn as node_id, case when rn = 1 then null when l_partkey % 11 = 0 then 99 else l_partkey % (rn + 2) + 1 end as parent_id, cast(l_linenumber - 2 as bigint) as page from ({_LINES_OF}) t union all select doc_id, rn, cast(1 as bigint), cast(null as bigint) from ({_LINES_OF}) u where l_suppkey % 13 = 0"
PAGE_COUNTS = "select distinct cast(floor(l_orderkey / 4) as bigint) as doc_id, cast(4 as bigint) as page_count from lineitem"
#: Spans of texts with their looks, and notes on pages of texts.
LOOKED = f"select cast(floor(l_orderkey / 32) as bigint) as doc_id, l_orderkey % 4 as page, l_orderkey as block, cast(l_linenumber as bigint) as line, cast(row_number() over (partition by l_orderkey order by {KEY}) as bigint) as span, case l_partkey % 7 when 0 then '• ' when 1 then '(3) ' when 2 then 'iv. ' when 3 then ' ' else concat('words ', cast(l_partkey as string), ' ') end as text, cast(8 + l_suppkey % 9 as double) as size, case when l_returnflag = 'R' then 'Sans-Bold' else 'Sans' end as font, cast(l_partkey % 2 as int) as flags, cast(10 * (l_orderkey % 8) as double) as y0 from lineitem"
NOTES = f"select * from ({SWATCHES}) t where kind = 'rect'"
WORDED = f"select *, concat('t', cast(elem_id as string)) as text from ({SWATCHES}) t where kind = 'text'"

#: Spans and shapes of pages of 120 by 60, and texts that run through documents.
SHEETS = "select distinct l_orderkey as doc_id, cast(0 as bigint) as page, cast(120 as bigint) as width, cast(60 as bigint) as height from lineitem"
EDGED = f"select *, case color when 0 then ' 12 ' when 1 then 'Page 3' when 2 then 'words of a head' when 3 then '2024-1-30 x' else 'TITLE' end as text, elem_id % 4 = 0 as tagged, case when elem_id % 3 = 0 then 'path' else 'image' end as kind, cast(case when elem_id % 2 = 0 then 1 when elem_id % 5 = 0 then null else 3 end as double) as stroke, cast(case when elem_id % 6 = 0 then 16 else 4 end as int) as flags from ({BOXES}) b"
RUNNING = "select o_custkey as doc_id, o_orderkey as elem_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as page, cast(10 + o_orderkey % 3 * 14 as double) as x0, cast(o_orderkey % 4 as double) as y0, cast(60 + o_orderkey % 3 * 14 as double) as x1, cast(o_orderkey % 4 + case when o_orderkey % 9 = 0 then 30 else 4 end as double) as y1, case when o_orderkey % 5 = 0 then concat('Page ', cast(o_orderkey % 13 as string)) when o_orderkey % 7 = 0 then concat('own words ', cast(o_orderkey as string)) else concat('the Report of all the year ', o_orderstatus) end as text from orders"
RUN_PAGES = "select o_custkey as doc_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as page, cast(120 as bigint) as width, cast(60 as bigint) as height from orders"
#: Lines of pages that begin like items, and items of lists with their places.
PRINTED_ITEMS = f"select doc_id, cast(0 as bigint) as page, rn as line_id, cast(l_suppkey % 3 * 4 as double) as x0, cast(rn * 10 + l_partkey % 3 * 8 as double) as y0, cast(l_suppkey % 3 * 4 + 50 as double) as x1, cast(rn * 10 + l_partkey % 3 * 8 + 9 as double) as y1, concat(case l_partkey % 6 when 0 then '• ' when 1 then '1. ' when 2 then ' ▪ ' when 3 then 'b) ' when 4 then '(4) ' else 'no ' end, 'words') as text from ({_LINES_OF}) t"
LIST_NODES = f"""
select doc_id, concat('L', cast(l_orderkey as string)) as node_id, cast(null as string) as parent_id, cast(0 as bigint) as sib, 'L' as type, '' as text from ({_LINES_OF}) a group by doc_id, l_orderkey
union all select doc_id, concat('I', cast(rn as string)), concat('L', cast(l_orderkey as string)), cast(rn as bigint), case l_partkey % 9 when 0 then 'P' when 1 then 'Caption' else 'LI' end, '' from ({_LINES_OF}) b
union all select doc_id, concat('K', cast(rn as string)), concat('I', cast(rn as string)), cast(0 as bigint), case l_suppkey % 4 when 0 then 'P' else 'Lbl' end, case l_partkey % 5 when 0 then '1. one' when 1 then 'b) two' when 2 then '- three' when 3 then '2.' else 'four' end from ({_LINES_OF}) c
union all select doc_id, concat('B', cast(rn as string)), concat('I', cast(rn as string)), cast(1 as bigint), case l_suppkey % 3 when 0 then 'P' else 'LBody' end, 'body' from ({_LINES_OF}) d where l_suppkey % 5 > 0
"""
LIST_ITEMS = f"select doc_id, l_orderkey as list_id, rn as node_id, cast(rn as bigint) as place, cast(case when l_partkey % 11 = 0 then null else l_suppkey % 40 end as double) as y0, cast(l_suppkey % 40 + 6 as double) as y1 from ({_LINES_OF}) t"
WIDGETS = f"select o_custkey as doc_id, o_orderkey % 3 as page, o_orderkey as widget_id, concat('txt', case when o_orderkey % 2 = 0 then 'firstName' else 'ZIPCode' end) as name from orders where o_orderkey % 4 = 1"

#: Images with the figures that they stand in, and figures in all kinds of places.
PICTURES = "select p_partkey % 300 as doc_id, cast(p_partkey % 9 as bigint) as page, p_partkey as image_id, concat('n', cast(p_partkey as string)) as node_id, case p_size % 6 when 0 then 'jpeg' when 1 then 'png' when 2 then 'tiff' when 3 then 'gif' when 4 then 'svg+xml' else 'bmp' end as kind, p_size as width, cast(p_partkey % 50 as int) as height, p_partkey % 7 = 0 as has_text, case when p_partkey % 14 = 0 then '' else p_name end as content, p_partkey % 5 = 0 as decorative, case p_partkey % 6 when 0 then '' when 1 then 'foto' when 2 then 'imagen 12' when 3 then 'abc' when 4 then 'page 3' else concat('a description of ', p_name) end as alt, case when p_partkey % 4 = 0 then 'x' else '' end as actual from part"
DRAWINGS = NODES.replace("case c_custkey % 5 when 0 then 'Div' when 1 then 'LI' when 2 then 'Span'", "case c_custkey % 5 when 0 then 'Link' when 1 then 'Annot' when 2 then 'Form'").replace("'a description'", "case o_orderkey % 3 when 0 then 'Un Diagrama' when 1 then 'a description' else 'gráfico 1' end")
NAMED_LINKS = f"select *, dense_rank() over (partition by doc_id order by text, dest) as link_id, case when doc_id % 3 = 0 then 'alt' else '' end as alt from (select distinct doc_id, text, dest from ({ADDRESSES}) t) u"
SHOWN = f"select doc_id, node_id, type, text, alt, scope, lang, case when node_id like '%4' then 'a b c' else '' end as headers, case when node_id like '%2' then 'Decimal' else '' end as listnumbering, case when node_id like '%8' then 7 else null end as mcid, length(node_id) - 2 as kids from ({NODES.replace("when 9 then 'TextContent'", "when 9 then case when o_orderkey % 5 = 0 then 'MCID' else 'TextContent' end")}) t"
ORDERED = f"select doc_id, node_id, parent_id, sib as place, type from ({NODES}) t"

#: Boxes with their kinds.
SHAPED = f"select *, case when elem_id % 5 = 0 then 'image' else 'text' end as kind from ({BOXES}) b"

#: Tables over pages, as trees, and links to add with the texts around them.
TABLE_TREES = f"""
select distinct doc_id, concat('T', cast(l_orderkey as string)) as node_id, cast(null as string) as parent_id, 'Table' as type, cast(null as bigint) as page from ({_LINES_OF}) a
union all select distinct doc_id, concat('R', cast(l_orderkey as string), '-', cast(l_suppkey % 3 as string)), concat('T', cast(l_orderkey as string)), case when l_orderkey % 5 = 0 then 'THead' else 'TR' end, cast(l_suppkey % 3 as bigint) from ({_LINES_OF}) b
union all select doc_id, concat('C', cast(rn as string)), concat('R', cast(l_orderkey as string), '-', cast(l_suppkey % 3 as string)), case when l_partkey % 2 = 0 then 'TH' else 'TD' end, cast(null as bigint) from ({_LINES_OF}) c
"""
LINKED = f"select *, case when elem_id % 3 = 0 then '' when elem_id % 3 = 1 then 't' else concat('#', cast(elem_id as string)) end as destination from ({SWATCHES}) t where kind = 'rect'"
HELD = f"select *, concat('t', cast(elem_id as string)) as text, concat('n', cast(elem_id as string)) as node_id from ({SWATCHES}) t where kind = 'text'"


def frame(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """sql over the tables that it names, read from sf_dir if they aren't given."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
