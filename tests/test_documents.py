"""What documents say and how they are built, against plain code on random and deep cases."""

import itertools
import json
import math
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tagmill.operators import closure, content, detect, export, grid, history, integrity, issues, layout, order, outline, tables
from tagmill.sources import pages, tagged

NODE = "doc_id long, node_id long, parent_id long, place long, type string, page long, actual string, alt string, expansion string"


def folded(text):
    return " ".join(text.split())


def tree(seed, n):
    rng = random.Random(seed)
    nodes, items = [], []
    kids = {}
    for k in range(n):
        up = None if k == 0 else rng.choice([k - 1, rng.randrange(k)])
        place = kids.setdefault(up, itertools.count())
        nodes.append((seed, k, up, next(place), rng.choice(["P", "Figure", "Sect", "Span"]), rng.choice([None, None, 0, 1, 2]), rng.choice(["", "", "", " said  it ", "  "]), rng.choice(["", "a picture"]), rng.choice(["", "", "", "in full"])))
    for k in range(n):
        for _ in range(rng.randrange(3)):
            kids.setdefault(k, itertools.count())
            items.append((seed, k, next(kids[k]), *rng.choice([(f" w{rng.randrange(9)} ", None), ("", None), (None, rng.randrange(6))])))
    spans = [(seed, rng.randrange(3), rng.randrange(-1, 6), s, f"m{s}") for s in range(30)]
    return nodes, items, spans


def plain_texts(nodes, items, spans):
    by = {n[1]: n for n in nodes}
    below = {}
    for n in nodes:
        if n[2] is not None:
            below.setdefault(n[2], []).append((n[3], "node", n[1]))
    for _, k, place, text, mcid in items:
        below.setdefault(k, []).append((place, "text", text) if mcid is None else (place, "mark", mcid))
    marks = {}
    for _, page, mcid, seq, text in sorted(spans, key=lambda s: s[3]):
        if mcid >= 0:
            marks.setdefault((page, mcid), []).append(text)

    def page_of(k):
        return 0 if k is None else page_of(by[k][2]) if by[k][5] is None else by[k][5]

    def text_of(k, page):
        _, _, _, _, kind, _, actual, alt, expansion = by[k]
        for said in (actual, alt if kind == "Figure" else "", expansion):
            if said.strip():
                return folded(said)
        parts = [x if what == "text" else " ".join(marks.get((page, x), [])) if what == "mark" else text_of(x, page) for _, what, x in sorted(below.get(k, []), key=lambda b: b[0])]
        return folded(" ".join(p for p in parts if p))

    texts = {k: text_of(k, page_of(k)) for k in by}

    def shown(k):
        return texts[k] or folded(" ".join(filter(None, (shown(x) for _, what, x in sorted(below.get(k, []), key=lambda b: b[0]) if what == "node"))))

    return {k: (page_of(k), texts[k]) for k in by}, {k: shown(k) for k in by}


def test_element_texts_of_random_trees(spark):
    cases = [tree(seed, n) for seed, n in ((1, 60), (2, 1), (3, 120), (4, 25))]
    nodes, items, spans = (spark.createDataFrame([r for c in cases for r in c[i]], s) for i, s in enumerate((NODE, "doc_id long, node_id long, place long, text string, mcid long", "doc_id long, page long, mcid long, seq long, text string")))
    texts = content.element_texts(nodes, items, spans)
    got = {(r["doc_id"], r["node_id"]): (r["page"], r["text"]) for r in texts.collect()}
    shown = {(r["doc_id"], r["node_id"]): r["text"] for r in content.shown_texts(nodes, texts).collect()}
    for case in cases:
        own, seen = plain_texts(*case)
        doc = case[0][0][0]
        assert {k: got[doc, k] for k in own} == own
        assert {k: shown[doc, k] for k in seen} == seen


def test_closure_of_deep_and_circular_trees(spark):
    chain = spark.createDataFrame([(1, k, k - 1 if k else None) for k in range(300)], "doc_id long, node_id long, parent_id long")
    assert closure.ancestors(chain).agg(F.count("*"), F.max("up")).first()[:] == (300 * 301 // 2, 299)
    ring = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 7, None)], "doc_id long, node_id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        closure.ancestors(ring)


def test_faults_of_trees(spark):
    rows = [(1, 1, None, 0), (1, 2, 1, 5), (1, 3, 9, -1), (1, 4, 3, None), (1, 5, 6, 0), (1, 6, 5, 0), (1, 7, 6, 0), (1, 8, 7, 0), (1, 2, 4, 0), (1, 11, None, 0), (2, 1, 1, 0), (3, 1, None, None)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, page long")
    counts = spark.createDataFrame([(1, 2), (2, 2)], "doc_id long, page_count long")
    want = {(1, 2, "page out of range"), (1, 3, "page out of range"), (1, 2, "second parent"), (1, 3, "orphan"), (1, 4, "below an orphan"), (1, 5, "cycle"), (1, 6, "cycle"), (1, 7, "below a cycle"), (1, 8, "below a cycle"), (1, 11, "second root"), (2, 1, "cycle")}
    assert {tuple(r) for r in integrity.faults(nodes, counts).collect()} == want
    assert integrity.faults(nodes.where("false"), counts).collect() == []


def place_cells(rows):
    """rows of (colspan, rowspan) -> columns, by a plain grid."""
    taken, out = set(), []
    for r, cells in enumerate(rows):
        c = 0
        for wide, high in cells:
            while (r, c) in taken:
                c += 1
            out.append((r, c))
            taken |= {(r + i, c + j) for i in range(high) for j in range(wide)}
    return out


def test_grid_of_random_tables(spark):
    rng = random.Random(3)
    shapes = [[[(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    rows = [(t, r, c, rng.choice(["TH", "TD"]), str(w), str(h), "", "", "") for t, shape in enumerate(shapes) for r, cells in enumerate(shape) for c, (w, h) in enumerate(cells)]
    cells = spark.createDataFrame(rows, "table_id long, row_id long, col long, kind string, colspan string, rowspan string, scope string, cell_id string, headers string")
    got = {(r["table_id"], r["row_id"], r["col"]): (r["row"], r["column"]) for r in grid.placed(cells).collect()}
    for t, shape in enumerate(shapes):
        keys = [(t, r, c) for r, cells_ in enumerate(shape) for c in range(len(cells_))]
        assert [got[k] for k in keys] == place_cells(shape)


def test_header_relations_by_hand(spark):
    # |     a     |     |  a covers two columns, b the two rows below in the first one
    # | b | c | d |
    # | . | e | f |
    rows = [(1, 0, 0, "TH", "3", "", "", "", ""), (1, 1, 0, "TH", "", "2", "", "own", ""), (1, 1, 1, "TD", "", "", "", "", ""), (1, 1, 2, "TD", "", "", "", "", ""), (1, 2, 0, "TD", "", "", "", "", ""), (1, 2, 1, "TD", "", "", "", "", ""), (2, 0, 0, "TD", "", "", "", "", ""), (2, 1, 0, "TD", "", "", "", "", "")]
    cells = spark.createDataFrame(rows, "table_id long, row_id long, col long, kind string, colspan string, rowspan string, scope string, cell_id string, headers string")
    got = {(r["row_id"], r["col"], r["attribute"]): r["value"] for r in grid.relations(cells).collect()}
    assert got == {(0, 0, "id"): "th_r0_c0", (1, 1, "headers"): "own th_r0_c0", (1, 2, "headers"): "own th_r0_c0", (2, 0, "headers"): "own th_r0_c0", (2, 1, "headers"): "own th_r0_c0"}


def test_headers_are_split_at_any_white_space(spark):
    cells = spark.createDataFrame([(1, 0, 0, "TD", "", "", "", "a", "b\tc\n a")], "table_id long, row_id long, col long, kind string, colspan string, rowspan string, scope string, cell_id string, headers string")
    assert {r["ref"] for r in tables.dangling_headers(cells).collect()} == {"b", "c"}


def test_nearest_by_rings(spark):
    rng = random.Random(5)
    boxes = [(d, p, k, x, y, x + rng.choice([0, 3, 40]), y + rng.choice([1, 9])) for d, p, n in ((1, 0, 90), (1, 1, 2), (2, 0, 1)) for k in range(n) for x, y in [(rng.choice([rng.uniform(0, 60), rng.uniform(0, 9000)]), rng.uniform(0, 700))]]
    frame = spark.createDataFrame(boxes, "doc_id long, page long, elem_id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r["doc_id"], r["page"], r["elem_id"]): (r["near_id"], r["distance"]) for r in layout.nearest(frame, frame).collect()}
    away = lambda a, b: math.hypot(max(a[3] - b[5], b[3] - a[5], 0), max(a[4] - b[6], b[4] - a[6], 0))
    want = {a[:3]: min((away(a, b), b[2]) for b in boxes if b[:2] == a[:2] and b is not a) for a in boxes if sum(b[:2] == a[:2] for b in boxes) > 1}
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][0]) for k in want)
    assert layout.nearest(frame.where("false"), frame).collect() == []


def test_moves_give_the_order_with_the_fewest(spark):
    rng = random.Random(7)
    groups = {g: rng.sample(range(n), n) for g, n in enumerate([1, 2, 5, 9, 30, 64])}
    rows = [(g, f"e{w}", i, w) for g, wanted in groups.items() for i, w in enumerate(wanted)]
    frame = spark.createDataFrame(rows, "g long, elem_id string, current long, wanted long").repartition(3)
    found = order.moves(frame, ["g"]).orderBy("g", "step").collect()
    for g, wanted in groups.items():
        now = [f"e{w}" for w in wanted]
        own = [r for r in found if r["g"] == g]
        for r in own:
            now.remove(r["elem_id"])
            now.insert(0 if r["after_id"] is None else now.index(r["after_id"]) + 1, r["elem_id"])
        best = [1] * len(wanted)
        for i in range(len(wanted)):
            best[i] = 1 + max((best[j] for j in range(i) if wanted[j] < wanted[i]), default=0)
        assert now == sorted(now, key=lambda e: int(e[1:])) and len(own) == len(wanted) - max(best)


def test_undo_and_redo(spark):
    kinds = ["undo", "edit", "edit", "undo", "edit", "redo", "undo", "undo", "redo", "apply", "undo", "edit", "revert", "redo", "apply"]
    log = spark.createDataFrame([(1, k + 1, kind) for k, kind in enumerate(kinds)] + [(2, k, "edit") for k in range(1, 61)] + [(2, 60 + k, "undo") for k in range(1, 61)], "doc_id long, seq long, kind string")
    got = {(r["doc_id"], r["seq"]): (r["state"], r["done"], r["undos"], r["redos"]) for r in history.states(log).collect()}
    assert [got[1, k + 1][0] for k in range(len(kinds))] == [0, 2, 3, 2, 5, 5, 2, 0, 2, 2, 2, 12, 2, 2, 2]
    assert [got[1, k + 1][1] for k in range(len(kinds))] == [False, True, True, True, True, False, True, True, True, True, False, True, True, False, False]
    assert got[2, 60][2] == 50 and got[2, 110][0] == 10 and got[2, 111] == (10, False, 0, 50)
    edits = spark.createDataFrame([(1, 2, "n", "c", "a"), (1, 3, "n", "c", "b"), (1, 5, "m", "c", "z"), (1, 12, "n", "c", "q")], "doc_id long, seq long, node_id string, column string, value string")
    known = history.states(log.where("doc_id = 1"))
    values = {}
    for r in history.values_after(edits, known, known.select("doc_id", "seq")).collect():
        values.setdefault(r["seq"], {})[r["node_id"]] = r["value"]
    assert [values.get(k) for k in (1, 2, 3, 4, 5, 7, 8, 9, 12, 13)] == [None, {"n": "a"}, {"n": "b"}, {"n": "a"}, {"n": "a", "m": "z"}, {"n": "a"}, None, {"n": "a"}, {"n": "q"}, {"n": "a"}]


def test_sections_and_lists_from_flat_order(spark):
    kinds = ["P", "H1", "P", "H3", "P", "H2", "H2", "P", "H1"]
    blocks = spark.createDataFrame([(1, 0, k, kind, "") for k, kind in enumerate(kinds)], "doc_id long, page long, seq long, kind string, text string")
    up = {r["node_id"]: r["parent_id"] for r in outline.sections(blocks).collect()}
    assert {k: up[k] for k in ("S1", "S3", "S5", "S6", "S8", "B0", "B2", "B4", "B7")} == {"S1": None, "S3": "S1", "S5": "S1", "S6": "S1", "S8": None, "B0": None, "B2": "S1", "B4": "S3", "B7": "S6"}
    texts = ["- a", "  1. b", "  2. c", "    - d", "- e", "no item", "  - f", "- g"]
    lines = spark.createDataFrame([(1, 0, k, x) for k, x in enumerate(texts)], "doc_id long, page long, seq long, text string")
    rows = {r["node_id"]: (r["parent_id"], r["place"], r["text"]) for r in outline.indented_lists(lines).collect()}
    assert rows["L0"][0] is None and rows["L1"][0] == "Body0" and rows["L3"][0] == "Body2" and rows["L6"][0] is None and rows["I7"][:2] == ("L6", 1)
    assert rows["I1"][:2] == ("L1", 0) and rows["I2"][:2] == ("L1", 1) and rows["I4"][:2] == ("L0", 1) and rows["Lbl1"][2] == "1." and rows["Body3"][2] == "d"


def test_built_structure_by_hand(spark):
    flow = [("L", "1. a"), ("L", "- b"), ("P", "p"), ("Table", "x  y"), ("Table", "z | w"), ("L", "2) c"), ("Table", "plain"), ("Table", "u"), ("P", "end"), ("Table", "t")]
    blocks = spark.createDataFrame([(1, 0, k, *x) for k, x in enumerate(flow)], "doc_id long, page long, seq long, kind string, text string")
    rows = {r["node_id"]: r for r in outline.built(blocks).collect()}
    top = sorted((r["place"], r["node_id"], r["type"], r["attribute"]) for r in rows.values() if r["parent_id"] is None)
    assert [x[1] for x in top] == ["L0", "B2", "L5", "B6", "T3", "B8", "T9"] and top[0][3] == "ListNumbering=Decimal" and top[2][3] == "ListNumbering=Decimal"
    assert [rows[k]["parent_id"] for k in ("R3", "R4", "R7", "C3.1", "C7.0")] == ["T3", "T3", "T3", "R3", "R7"]
    assert (rows["C3.0"]["type"], rows["C3.0"]["attribute"], rows["C4.1"]["type"], rows["C4.1"]["text"]) == ("TH", "Scope=Column", "TD", "w")
    lost = outline.built(spark.createDataFrame([(1, 0, 0, "Table", "a"), (1, 0, 1, "L", "- b")], blocks.schema))
    assert {r["type"] for r in lost.collect()} == {"L", "LI", "Lbl", "LBody"}


def test_tables_of_lines_and_texts(spark):
    across = [(1, 0, k, 0.0, 20.0 * k, 100.0, 20.0 * k) for k in range(3)]
    down = [(1, 0, 10 + k, 50.0 * k, 0.0, 50.0 * k, 40.0) for k in range(3)]
    drawn = spark.createDataFrame([*across, *down, (1, 0, 99, 5.0, 5.0, 9.0, 5.0)], "doc_id long, page long, line_id long, x0 double, y0 double, x1 double, y1 double")
    printed = [(1, 0, r, c, 50.0 * c + 2, 20.0 * r + 4, 50.0 * c + 40, 20.0 * r + 16, "x") for r in range(2) for c in range(2)] + [(1, 0, 5 + r, c, 60.0 * c, 300 + 12.0 * r, 60.0 * c + 30, 310 + 12.0 * r, "y") for r in range(3) for c in range(3)]
    spans = spark.createDataFrame(printed, "doc_id long, page long, line_id long, span_id long, x0 double, y0 double, x1 double, y1 double, text string")
    found, cells = detect.tables(drawn, spans)
    got = {(r["source"], r["x0"], r["y0"], r["x1"], r["y1"], r["n_rows"], r["n_cols"]) for r in found.collect()}
    assert got == {("lines", -1.0, -1.0, 101.0, 41.0, 3, 3), ("text", 0.0, 300.0, 150.0, 334.0, 3, 3)}
    assert cells.where("source = 'lines'").count() == 4 and cells.where("source = 'text'").count() == 12


def test_a_page_with_a_fault_keeps_the_others(spark):
    frame = spark.createDataFrame([(1, "<html><p>before</p><![x[ y"), (2, "<html><p>whole</p></html>"), (3, None)], "page_id long, html string")
    assert {(r["doc_id"], r["type"], r["text"]) for r in pages.nodes(frame).collect()} == {(1, "Document", ""), (1, "P", "before"), (2, "Document", ""), (2, "P", "whole")}
    errors = pages.load_errors(frame)
    assert [r["doc_id"] for r in errors.collect()] == [1]
    assert [(r["checkpoint"], r["severity"]) for r in issues.of_errors(errors).collect()] == [("general", "error")]


def test_xml_can_be_read_again(spark):
    rows = [(1, [0], "Document", "", "", "", "en"), (1, [0, 0], "P", "a < b & 'c' \x01\"d\"", "x > y & 'z'", "", ""), (1, [0, 1], "P", "plain", "", "", "")]
    nodes = spark.createDataFrame(rows, "doc_id long, path array<long>, type string, text string, alt string, scope string, lang string")
    xml = export.structure_xml(nodes, escape=True).first()["xml"]
    root = ElementTree.fromstring(xml)
    assert root.find("P/text").text == "a < b & 'c' \"d\"" and root.find("P/attr").get("value") == "x > y & 'z'"
    lines = [r["line"] for r in export.xml_lines(nodes, escape=True).orderBy("doc_id", "at").collect()]
    assert "\n".join(lines) == xml
    assert "a < b & 'c'" in export.structure_xml(nodes).first()["xml"]


def test_documents_from_files(spark, tmp_path):
    good = {"filename": "a.pdf", "metadata": {"title": "T", "author": None}, "pages": [{"spans": [{"text": "one", "mcid": 0, "bbox": [0, 0, 9, 9], "size": 8}], "annotations": [{"subtype": "Link", "bbox": [1, 1, 2, 2]}]}], "tree": {"type": "Document", "content": [{"type": "P", "page": 0, "content": [0, "and", {"type": "Span", "attributes": {"actualtext": "two"}}]}, {"type": "P", "content": []}]}}
    for name, text in (("a.json", json.dumps(good)), ("b.json", "{not json"), ("c.json", "[1]"), ("d.json", json.dumps({"tree": {"content": [1.5]}})), ("e.json", "{}"), ("f.txt", "x")):
        (tmp_path / name).write_text(text)
    frames = tagged.read(spark, str(tmp_path))
    short = lambda r: r["doc_id"].rsplit("/", 1)[1]
    assert {short(r) for r in frames["documents"].collect()} == {"a.json", "e.json"}
    assert {short(r) for r in frames["load_errors"].collect()} == {"b.json", "c.json", "d.json"}
    texts = content.element_texts(frames["nodes"], frames["items"], frames["spans"])
    assert sorted(r["text"] for r in texts.collect()) == ["", "one and two", "one and two", "two"]
    assert [tuple(r)[1:] for r in tagged.described(frames).orderBy("doc_id").collect()] == [(4, 1, 1), (0, 0, 0)]
    kept = tagged.written(frames, str(tmp_path / "out"))
    assert kept["nodes"].count() == 4 and kept["metadata"].count() == 2


def test_every_rule_of_the_bag(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    said = lambda frame: sorted((r["doc_id"], r["checkpoint"], r["severity"], r["page"]) for r in frame.collect())
    texts = one([(1, 0, None, "low", 200, 200, 200, 255, 255, 255, 10.0, False, 0), (1, 0, None, "fine", 0, 0, 0, 255, 255, 255, 10.0, False, 0), (1, 1, None, " ", 200, 200, 200, 255, 255, 255, 10.0, False, 0), (1, 1, None, "unseen", 200, 200, 200, 255, 255, 255, 10.0, False, 16), (1, 2, None, "large", 140, 140, 140, 255, 255, 255, 18.0, False, 0)], "doc_id long, page long, element_id string, text string, r int, g int, b int, br int, bg int, bb int, size double, bold boolean, flags int")
    assert said(issues.of_contrast(texts)) == [(1, "04-001", "warning", 0)]
    box = "doc_id long, page long, elem_id long, kind string, color long, x0 double, y0 double, x1 double, y1 double, font string, size long"
    looks = one([(1, 0, k, "text", k, 0.0, 90.0 * k, 9.0, 90.0 * k + 8, "f", 9) for k in range(3)] + [(2, 0, k, "rect", k, 0.0, 20.0 * k, 9.0, 20.0 * k + 8, "", 0) for k in range(3)], box)
    assert said(issues.of_colours(looks)) == [(1, "04-001", "warning", 0), (2, "04-001", "warning", 0)]
    tags = one([(1, 0, k, f"T{k}") for k in range(3)], "doc_id long, page long, elem_id long, type string")
    assert said(issues.of_colours(looks, tags)) == [(2, "04-001", "warning", 0)]
    assert said(issues.of_characters(one([(1, 0, "ok\t"), (1, 1, "�"), (1, 2, "a\x02")], "doc_id long, page long, text string"))) == [(1, "10-001", "info", 1), (1, "10-001", "info", 2)]
    assert said(issues.of_untagged(one([(1, 0, "x"), (1, 0, "y"), (1, 1, " "), (2, 0, "z")], "doc_id long, page long, text string"), one([(1,)], "doc_id long"))) == [(1, "11-001", "error", 0)]
    cells = one([(1, 0, 0, "TH", "", "", "Col", "", "", True)], "table_id long, row_id long, col long, kind string, colspan string, rowspan string, scope string, cell_id string, headers string, filled boolean")
    frames = one([(1, 0), (1, 1), (1, 2), (5, None)], "table_id long, row_id long")
    assert said(issues.of_tables(cells, frames=frames)) == [(1, "table-structure", "warning", None), (5, "table-structure", "error", None)]
    nodes = one([(1, "a", None, 0, "P", "x", "", None, "", "", "told", "")], "doc_id long, node_id string, parent_id string, sib long, type string, text string, lang string, page long, alt string, scope string, actual string, expansion string")
    meta = one([(1, "", True)], "doc_id long, language string, has_lang boolean")
    assert {c for _, c, _, _ in said(issues.of_languages(nodes, meta))} >= {"11-001", "11-002"}
    notes = one([(1, 0, "Text", "x", ""), (1, 1, "Widget", "", "tip")], "doc_id long, page long, subtype string, contents string, tu string")
    assert said(issues.of_annotations(notes, one([(1,)], "doc_id long"), meta)) == [(1, "11-003", "warning", None), (1, "11-004", "warning", 0), (1, "11-005", "warning", 1)]


