"""Cases worked out by hand, one for each rule that order or ties decide."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagmill.functions import colour, geometry, text
from tagmill.operators import conformance, export, issues, layout, lists, matching, metadata, tables, tree


def headings(spark, levels):
    return spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(levels)], "doc_id long, page long, seq int, level int")


@pytest.mark.parametrize(("levels", "bad"), [([2], [2]), ([1, 3, 2, 4], [3]), ([1, 2, 3], []), ([], [])])
def test_heading_skips(spark, levels, bad):
    assert [r["level"] for r in tree.heading_skips(headings(spark, levels), "doc_id", ["seq"]).collect()] == bad


@pytest.mark.parametrize(("levels", "bad"), [([1, 4], [4]), ([1, 3], [])])
def test_page_jumps(spark, levels, bad):
    assert [r["level"] for r in tree.page_jumps(headings(spark, levels), "doc_id", "page", ["seq"]).collect()] == bad


def test_heading_repair(spark):
    got = tree.repaired_levels(headings(spark, [1, 3, 5, 2]), "doc_id", ["seq"]).orderBy("seq").collect()
    assert [r["fixed"] for r in got] == [1, 2, 3, 2]


NODES = [(1, 0, None, "Document", "", "es"), (1, 1, 0, "L", "", ""), (1, 2, 1, "P", "x", ""), (1, 3, 1, "LI", "y", "fr"), (1, 4, 3, "LBody", "z", "")]


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(NODES, "doc_id long, node_id long, parent_id long, type string, text string, lang string")


def test_trees(spark, nodes):
    assert [(r["parent_type"], r["type"]) for r in tree.illegal_nesting(nodes).collect()] == [("L", "P")]
    assert tree.list_rules(nodes).first()[2:] == (1, 1)
    assert {r["node_id"]: r["depth"] for r in tree.depths(nodes).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}
    assert {r["node_id"]: r["eff_lang"] for r in tree.effective_languages(nodes).collect()} == {0: "es", 1: "es", 2: "es", 3: "fr", 4: "fr"}
    root = spark.createDataFrame([(1, 3)], "doc_id long, node_id long")
    assert sorted(r["node_id"] for r in tree.without_subtrees(nodes, root).collect()) == [0, 1, 2]
    pair = spark.createDataFrame([(1, 2, 4)], "doc_id long, a long, b long")
    assert tree.common_ancestors(nodes, pair).first()["common"] == 1
    assert tree.statistics(nodes).first()["max_depth"] == 3


def test_role_map(spark):
    rows = [(1, "A", "B"), (1, "B", "P"), (1, "X", "Y"), (1, "Y", "X"), (1, "Z", "Other")]
    got = tree.terminal_types(spark.createDataFrame(rows, "doc_id int, custom string, mapped string"))
    assert {r["custom"]: r["terminal"] for r in got.collect()} == {"A": "P", "B": "P", "X": "CYCLE", "Y": "CYCLE", "Z": "Other"}


CELL = "table_id int, row_id int, col int, kind string, colspan string, rowspan string, scope string, cell_id string, headers string, filled boolean"


def test_tables(spark):
    rows = [(1, 1, 1, "TH", "2", "", "", "a", "", True), (1, 1, 2, "TD", "x", "", "", "b", "a z", True), (1, 2, 1, "TD", "9", "", "", "c", "", True), (1, 2, 2, "TD", "", "4", "", "d", "", True), (1, 3, 1, "TD", "1", "3", "", "e", "", True)]
    cells = spark.createDataFrame(rows, CELL)
    assert [(r["cell_id"], r["ref"]) for r in tables.dangling_headers(cells).collect()] == [("b", "z")]
    assert sorted((r["span"], r["problem"]) for r in tables.bad_spans(cells).collect()) == [("colspan", "not a number"), ("colspan", "too wide"), ("rowspan", "too wide")]
    assert tables.ragged(cells).count() == 0 and tables.shape(cells).first()["complex"]
    assert [(r["row_id"], r["mode"]) for r in tables.row_outliers(cells).collect()] == [(3, 2)]
    assert tables.bad_scopes(cells).count() == 0  # tied by ids


def test_scopes(spark):
    """Without ids: taller than wide suggests Col; the repair goes by first row, header rows and header columns."""
    kinds = ["TH TH", "TH TD", "TD TH", "TH TD"]
    cells = spark.createDataFrame([(1, i, j, k, "", "", "row" if (i, j) == (0, 1) else "", "", "", True) for i, r in enumerate(kinds) for j, k in enumerate(r.split(), 1)], CELL)
    assert sorted((r["row_id"], r["col"], r["problem"], r["suggested"]) for r in tables.bad_scopes(cells).collect()) == [(0, 1, "unknown", "Col"), (0, 2, "missing", "Col"), (1, 1, "missing", "Col"), (2, 2, "missing", "Col"), (3, 1, "missing", "Col")]
    assert sorted((r["row_id"], r["col"], r["suggested"]) for r in tables.repaired_scopes(cells).collect()) == [(0, 2, "Column"), (1, 1, "Row"), (2, 2, "Both"), (3, 1, "Row")]
    found = [(r["checkpoint"], r["severity"]) for r in issues.of_tables(cells).collect()]
    assert found.count(("15-003", "error")) == 5 and ("table-accessibility", "info") in found


def test_colour(spark):
    row = spark.range(1)
    lit = lambda *x: tuple(F.lit(v) for v in x)
    assert row.select(colour.contrast_ratio(lit(0, 0, 0), lit(255, 255, 255))).first()[0] == pytest.approx(21.0)
    assert row.select(colour.required_ratio(F.lit(18.0), F.lit(False))).first()[0] == 3.0
    assert row.select(colour.parsed(F.lit("#0aF"))).first()[0].asDict() == {"r": 0, "g": 170, "b": 255}
    assert row.select(colour.parsed(F.lit("rgb(1, 2,3)"))).first()[0].asDict() == {"r": 1, "g": 2, "b": 3}
    assert row.select(colour.parsed(F.lit("nothing"))).first()[0] is None


def test_geometry_and_clusters(spark):
    row = spark.range(1)
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert row.select(geometry.overlap_ratio(box(0, 0, 10, 10), box(5, 0, 15, 10))).first()[0] == 0.5
    assert row.select(geometry.distance(box(0, 0, 1, 1), box(4, 5, 6, 6))).first()[0] == 5.0
    assert row.select(geometry.direction(box(0, 0, 1, 1), box(5, 5, 6, 6))).first()[0] == "TB"
    values = spark.createDataFrame([(1, v) for v in (0.0, 8.0, 16.0)], "doc_id int, v double")
    assert [(r["mean"], r["members"]) for r in layout.anchored_clusters(values, ["doc_id"], "v", 10.0).orderBy("cluster").collect()] == [(4.0, 2), (16.0, 1)]
    assert [(r["low"], r["members"]) for r in layout.chained_clusters(values, ["doc_id"], "v", 10.0).collect()] == [(0.0, 3)]
    boxes = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 1.0, 1.0), (1, 0, 2, 3.0, 0.0, 4.0, 1.0), (1, 0, 3, 90.0, 90.0, 91.0, 91.0), (2, 0, 4, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page long, elem_id long, x0 double, y0 double, x1 double, y1 double")
    assert {r["elem_id"]: r["block"] for r in layout.grown_blocks(boxes, 5.0).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_boxes(spark):
    """Joins by cells against all pairs: boxes of many sizes, on cell edges, below 0, flat, turned round and with nulls."""
    rng = random.Random(7)
    rows = []
    for i in range(240):
        x, y = rng.choice([0.0, -64.0, 64.0, 128.0, 700.0, rng.uniform(-300, 900)]), rng.uniform(-100, 900)
        w, h = (rng.choice([0.0, 5.0, 64.0, 128.0, 900.0, -3.0, rng.uniform(0, 80)]) for _ in "xy")
        rows.append((i % 3, i % 2, i, x, y, None if i == 5 else x + w, y + h))
    rows.append((0, 0, 999, -1e9, -1e9, 1e9, 1e9))
    boxes = spark.createDataFrame(rows, "doc_id long, page long, elem_id long, x0 double, y0 double, x1 double, y1 double").cache()
    key = lambda f, *c: sorted(tuple(r[k] for k in ("doc_id", "page", *c)) for r in f.collect())
    ratio = geometry.overlap_ratio(geometry.rect("a_"), geometry.rect("b_"))
    assert key(layout.overlaps(boxes, 0.3), "a_elem_id", "b_elem_id") == key(layout.paired(boxes).where(ratio >= 0.3), "a_elem_id", "b_elem_id") != []
    points = boxes.select("doc_id", "page", F.col("elem_id").alias("point_id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    rest = [r for r in rows if r[5] is not None]
    inside = {(p[0], p[1], p[2]): min(((b[5] - b[3]) * (b[6] - b[4]), b[2]) for b in rest if b[:2] == p[:2] and b[3] <= p[3] <= b[5] and b[4] <= p[4] <= b[6]) for p in rows if any(b[:2] == p[:2] and b[3] <= p[3] <= b[5] and b[4] <= p[4] <= b[6] for b in rest)}
    assert {(r["doc_id"], r["page"], r["point_id"]): r["elem_id"] for r in layout.hit(points, boxes).collect()} == {k: v[1] for k, v in inside.items()}
    across = boxes.select("doc_id", "page", F.col("elem_id").alias("h_id"), "x0", "x1", F.col("y0").alias("y"))
    down = boxes.select("doc_id", "page", F.col("elem_id").alias("v_id"), "y0", "y1", F.col("x0").alias("x"))
    want = sorted((h[0], h[1], h[2], v[2]) for h in rest for v in rows if h[:2] == v[:2] and h[3] - 2 <= v[3] <= h[5] + 2 and v[4] - 2 <= h[4] <= v[6] + 2)
    assert key(layout.crossings(across, down), "h_id", "v_id") == want != []
    assert layout.overlaps(boxes.limit(0)).count() == 0


def test_similar_texts(spark):
    """The prefix join against all pairs, with repeated rows, a page twice, blanks and nulls."""
    rng = random.Random(8)
    rows = [(i % 2, i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [rows[3], (0, 4, "a b c"), (1, 90, None)]
    sets = [(d, p, set((x or "").split())) for d, p, x in rows]
    for least in (0.25, 0.5, 0.8, 1.0):
        want = sorted((d, p, q) for d, p, x in sets for e, q, y in sets if d == e and p < q and x and y and len(x & y) >= least * len(x | y))
        got = lists.similar_texts(spark.createDataFrame(rows, "doc_id long, page long, text string"), least)
        assert sorted((r["doc_id"], r["a"], r["b"]) for r in got.collect()) == want != []


def test_text(spark):
    row = spark.range(1)
    one = lambda c: row.select(c).first()[0]
    assert one(text.jaccard(F.lit("a b c"), F.lit("A b d"))) == 0.5
    assert one(text.readable_field_name(F.lit("txtFirstName"))) == "First Name"
    assert one(text.readable_field_name(F.lit("txt_first_NAME"))) == "Txt First Name"
    assert one(text.marker_type(F.lit("i) x"))) == "numbered-lower-alpha"
    assert one(text.marker_type(F.lit(" 12. x"))) == "numbered-decimal"
    assert one(text.marker_type(F.lit("mdc) x"))) == "numbered-lower-roman"
    assert one(text.marker_type(F.lit("xL. x"))) == "numbered-other"
    assert one(text.marker_type(F.lit("plain"))) is None
    assert one(text.normalised(F.lit(" a\x01 \n b "))) == "a b"
    assert one(text.title_of_filename(F.lit("docs/my-file_v1.tar.pdf"))) == "Docs/my File V1.tar"
    assert one(text.title_of_filename(F.lit("ab.pdf"))) == "Ab - Documento PDF" and one(text.title_of_filename(F.lit(""))) == "Documento PDF"
    assert one(text.title_score(F.lit("Untitled"))) == 0.1
    assert one(text.title_score(F.lit("A plain title of some seven words"))) == pytest.approx(0.4 * 33 / 50 + 0.4 + 0.2)
    assert one(text.generic_alt(F.lit(" IMG_123456789 "))) and not one(text.generic_alt(F.lit("A red house by the sea")))
    got = one(text.recognition(F.lit("The house\nThe house\nxxxx bcd 111")))  # lines 1/3 again; xxxx and 111 of 7 words strange
    assert (got["valid"], got["errors"]) == (True, 1) and got["confidence"] == pytest.approx(0.8 * (1 + 2 / 3 + 5 / 7) / 3)
    assert [one(text.reading_mode(F.lit(x))) for x in ("ha-NG", "sd", "ja-JP", "zh")] == ["rl-tb", "lr-tb", "tb-lr", "tb-rl"]
    assert one(text.language_suggestions(F.lit("pt-brasil"))) == ["pt", "pt-PT", "pt-BR", "pt-PT"] and one(text.language_suggestions(F.lit("")))[0] == "en-US"
    assert one(text.repaired_language(F.lit("EN"))) == "en-US" and one(text.repaired_language(F.lit("xx"))) == "es-ES"
    assert one(tree.type_by_name(F.lit("SubtitleX"))) == "H2" and one(tree.type_by_name(F.lit("HeaderCell"))) == "H1" and one(tree.type_by_name(F.lit("promo"))) == "P"


def test_metadata(spark):
    """A blank title has one finding; XMP missing says nothing of its parts."""
    form = "doc_id int, filename string, has_xmp boolean, pdf_ua_flag boolean, title string, info_title string, xmp_title string, author string, subject string, keywords string, has_lang boolean, language string, has_viewer_preferences boolean, display_title boolean"
    rows = [(1, "a.pdf", True, True, "  ", "  ", None, "x", "y", "z", True, "es", True, True), (2, "a.pdf", False, False, "A.PDF", "", "", "", "test", None, False, "", False, None), (3, "a.pdf", True, False, "pdf", "pdf", "Other title", "x", "y", "z", True, "pt-AO", True, None)]
    meta = spark.createDataFrame(rows, form)
    got = {k: sorted((r["checkpoint"], r["severity"]) for r in metadata.issues(meta).where(f"doc_id = {k}").collect()) for k in (1, 2, 3)}
    assert got[1] == [("06-004", "warning"), ("metadata-quality", "info")]
    assert got[2] == [("06-001", "error"), ("07-001", "error"), ("11-006", "error"), ("metadata-quality", "info"), ("metadata-quality", "info"), ("metadata-quality", "info")]
    assert got[3] == [("06-002", "error"), ("07-001", "error"), ("11-007", "warning"), ("metadata-consistency", "warning")]
    assert [r["problem"] for r in metadata.title_problems(meta).orderBy("doc_id", "problem").collect()] == ["blank", "file name", "generic"]
    assert [round(r["completeness"]) for r in metadata.completeness(meta).orderBy("doc_id").collect()] == [100, 33, 67]


def test_repeated(spark):
    """At 0.8, on half of the pages or more, the leader being the first of its kind."""
    head = "a report on all the things of the year part"
    texts = [(1, 0, f"{head} one"), (1, 1, f"{head} two"), (1, 2, "its own"), (1, 3, f"{head} six"), (2, 0, "x"), (2, 3, "x"), (3, 0, ""), (3, 1, "")]
    got = lists.repeated(spark.createDataFrame(texts, "doc_id long, page long, text string")).collect()
    assert sorted((r["doc_id"], r["page"], r["first"]) for r in got) == [(1, 0, 0), (1, 1, 0), (1, 3, 0), (2, 0, 0), (2, 3, 0)]


def test_structure_issues(spark):
    form = "doc_id long, node_id string, parent_id string, sib long, type string, text string, lang string, page long, alt string, scope string"
    rows = [(1, "a", None, 0, "Document", "", "", None, "", ""), (1, "b", "a", 1, "L", "", "", 1, "", ""), (1, "c", "b", 0, "P", "x", "", 1, "", ""), (1, "d", "a", 0, "H2", " ", "", 1, "", ""), (1, "e", "a", 2, "H5", "t", "x-", 1, "", ""), (2, "z", None, 0, "Div", "", "", None, "", "")]
    nodes = spark.createDataFrame(rows, form)
    got = sorted((r["doc_id"], r["element_id"] or "", r["checkpoint"], r["severity"]) for r in issues.of_structure(nodes, spark.createDataFrame([(1,), (3,)], "doc_id long")).collect())
    assert got == [(1, "", "09-001", "warning"), (1, "b", "09-002", "error"), (1, "b", "09-002", "warning"), (1, "c", "09-002", "warning"), (1, "d", "01-006", "warning"), (1, "d", "14-003", "error"), (1, "e", "14-003", "error"), (2, "", "01-005", "error"), (2, "", "01-005", "warning"), (2, "", "01-006", "info"), (3, "", "01-005", "error")]
    meta = spark.createDataFrame([(1, "", False), (2, "es", True)], "doc_id long, language string, has_lang boolean")
    got = sorted((r["doc_id"], r["element_id"] or "", r["checkpoint"]) for r in issues.of_languages(nodes, meta).collect())
    assert got == [(1, "", "11-006"), (1, "c", "11-001"), (1, "e", "11-007")]


def test_lists_and_matching(spark):
    lines = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(["a) x", "b) y", "plain", "1. z"])], "doc_id long, page long, seq long, text string")
    assert [(r["type"], r["items"]) for r in lists.runs(lines).collect()] == [("numbered-lower-alpha", 2)]
    images = spark.createDataFrame([(1, 1, 10), (1, 1, 11)], "doc_id int, page int, image_id int")
    figures = spark.createDataFrame([(1, 1, 7)], "doc_id int, page int, figure_id int")
    assert {(r["image_id"], r["figure_id"]) for r in matching.image_figures(images, figures).collect()} == {(11, 7), (10, None)}


def test_conformance(spark):
    rows = [(1, "14-003", "error", "x", True, 1), (1, "15-003", "error", "y", False, None), (1, "table-structure", "warning", "z", True, None), (1, "general", "other", "w", False, None)]
    issues = spark.createDataFrame(rows, export.ISSUE)
    assert conformance.maturity(issues).first()["maturity"] == 93
    rolled = {r["category"]: r for r in conformance.rollup(issues).collect()}
    assert len(rolled) == 33 and rolled["table"]["warnings"] == 1 and rolled["00"]["infos"] == 1 and rolled["05"]["total"] == 0
    assert conformance.status(issues).first()[1:] == (False, 2, 4)
    assert sorted(export.from_json(export.to_json(issues)).collect(), key=str) == sorted(issues.collect(), key=str)
    assert conformance.maturity(issues.where("false")).count() == 0


def test_export(spark, nodes, tmp_path):
    full = nodes.withColumn("sib", F.col("node_id")).withColumn("alt", F.lit("a picture")).withColumn("scope", F.lit(""))
    xml = export.structure_xml(full.where("node_id <> 4").join(tree.paths(full), ["doc_id", "node_id"])).first()["xml"]
    alt = "<attr name='alt' value='a picture' />"
    assert xml.split("\n") == ["<Document>", f"  {alt}", "  <attr name='lang' value='es' />", "  <L>", f"    {alt}", "    <P>", f"      {alt}", "      <text>x</text>", "    </P>", "    <LI>", f"      {alt}", "      <attr name='lang' value='fr' />", "      <text>y</text>", "    </LI>", "  </L>", "</Document>"]
    found = spark.createDataFrame([(1, "14-003", "error", "x", True, 1)], export.ISSUE)
    for form in ("json", "csv", "text"):
        export.write_issues(found, str(tmp_path / form), form)
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "[14-003] error x"


def test_map_cycles(spark):
    rows = [(1, "A", "B"), (1, "B", "P"), (1, "X", "Y"), (1, "Y", "X"), (1, "W", "X"), (1, "Z", "Z")]
    got = tree.map_cycles(spark.createDataFrame(rows, "doc_id long, custom string, mapped string")).collect()
    assert {r["custom"]: r["length"] for r in got} == {"X": 2, "Y": 2, "Z": 1}


def test_mean_lines(spark):
    rows = [(1, 0, k, 0.0, y, 5.0, y + 10) for k, y in enumerate([0.0, 10.0, 20.0, 40.0])]
    got = layout.mean_lines(spark.createDataFrame(rows, "doc_id long, page long, elem_id long, x0 double, y0 double, x1 double, y1 double")).orderBy("line").collect()
    assert [(r["mean"], r["members"]) for r in got] == [(10.0, 2), (25.0, 1), (45.0, 1)]


def test_color_legends(spark):
    form = "doc_id long, page long, elem_id long, kind string, color long, x0 double, y0 double, x1 double, y1 double"
    box = lambda doc, k, kind, color, x: (doc, 0, k, kind, color, x, 0.0, x + 10, 10.0)
    rows = [box(d, k, "rect", k, 40.0 * k) for d in (1, 2) for k in range(6)] + [box(2, 9, "text", None, 29.0), box(3, 0, "rect", 1, 0.0), box(3, 1, "rect", 1, 1.0), box(3, 2, "path", 2, 2.0)]
    got = layout.color_legends(spark.createDataFrame(rows, form)).collect()
    assert sorted((r["doc_id"], r["legend"], r["members"], r["x0"], r["x1"]) for r in got) == [(1, 0, 3, 0.0, 90.0), (1, 3, 3, 120.0, 210.0), (2, 3, 3, 120.0, 210.0)]


def test_table_row_order(spark):
    rows = [(1, 1, 1, "TBody", 0.0, 10.0), (1, 2, 2, "THead", 20.0, 30.0), (1, 3, 3, None, 10.0, 20.0), (1, 4, 4, "TFoot", None, None), (2, 1, 1, None, 5.0, 6.0), (2, 2, 2, None, 5.0, 6.0)]
    got = tables.row_order(spark.createDataFrame(rows, "table_id long, row_id long, pre_order long, section string, y0 double, y1 double")).collect()
    assert sorted((r["row_id"], r["current"], r["expected"]) for r in got) == [(1, 0, 1), (2, 1, 0)]


def test_recognised_language(spark):
    texts = ["la casa de la que habla con el niño para siempre", "the house that is with the other of them", "der Hund und die Katze mit dem Ball", "el niño", None]
    got = spark.createDataFrame(enumerate(texts), "i int, t string").orderBy("i").select(text.recognised_language(F.col("t"))).collect()
    assert [r[0] for r in got] == ["spa", "eng", "deu", "eng", "eng"]


def plain_pairs(text, ground, target):
    """The pairs by plain code: lightness moved by 30 points, the best first."""
    import colorsys

    def hsl(c):
        h, light, s = colorsys.rgb_to_hls(*[x / 255 for x in c])
        return round(h * 360), round(s * 100), round(light * 100)

    def rgb(h, s, light):
        return tuple(round(x * 255) for x in colorsys.hls_to_rgb(h / 360, light / 100, s / 100))

    def ratio(a, b):
        lum = [sum(w * (x / 255 / 12.92 if x / 255 <= 0.03928 else ((x / 255 + 0.055) / 1.055) ** 2.4) for w, x in zip((0.2126, 0.7152, 0.0722), c, strict=True)) for c in (a, b)]
        return (max(lum) + 0.05) / (min(lum) + 0.05)

    (h, s, x), (p, q, y) = hsl(text), hsl(ground)
    moved = [(rgb(h, s, max(0, x - 30)), ground)] * (x > 50) + [(rgb(h, s, min(100, x + 30)), ground)] * (x < 50) + [(text, rgb(p, q, max(0, y - 30)))] * (y > 50) + [(text, rgb(p, q, min(100, y + 30)))] * (y < 50)
    found = sorted(((ratio(a, b), "#%02x%02x%02x" % a, "#%02x%02x%02x" % b) for a, b in moved if ratio(a, b) >= target), reverse=True)
    return found or [(21.0, "#000000", "#ffffff")]


def test_accessible_pairs(spark):
    import random

    pick = random.Random(3)
    rows = [(k, *[pick.randrange(256) for _ in range(6)]) for k in range(300)] + [(300, 100, 100, 100, 120, 120, 120)]
    frame = spark.createDataFrame(rows, "id int, r int, g int, b int, br int, bg int, bb int")
    pair = colour.accessible_pairs(tuple(map(F.col, "rgb")), tuple(map(F.col, ("br", "bg", "bb"))), F.lit(4.5))
    near = 0
    for r in frame.select("id", F.get(pair, F.lit(0)).alias("x")).collect():
        want = plain_pairs(tuple(rows[r["id"]][1:4]), tuple(rows[r["id"]][4:]), 4.5)[0]
        same = (r["x"]["text"], r["x"]["ground"]) == want[1:]
        near += same
        assert same or abs(r["x"]["ratio"] - want[0]) < 0.2  # a half rounds to the other side
    assert near > 280


def test_leaders_by_rounds():
    """Many pages at a time give the leaders that a fold over each page's points gives."""
    rng, reach = np.random.default_rng(7), 100.0
    pages = [[(None if rng.random() < 0.05 else float(rng.integers(0, 600)), float(rng.integers(0, 800))) for _ in range(n)] for n in (1, 40, 0, 3, 90)]
    near = lambda p, q: None not in (p[0], q[0]) and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 < reach * reach
    want = []
    for points in pages:
        found, own = [], []
        for k, p in enumerate(points):
            own.append(next((i for i in found if near(points[i], p)), k))
            found += [k] if own[-1] == k else []
        want.append(own)
    got = layout._leaders(pa.array([[p[0] for p in ps] for ps in pages], pa.list_(pa.float64())), pa.array([[p[1] for p in ps] for ps in pages], pa.list_(pa.float64())), reach)
    assert got.to_pylist() == want


def test_contrast_of_many(spark):
    """As in plain code, with nulls left out; and a filter on it takes a luminance once."""

    def plain(rgb):
        r, g, b = (x / 255 / 12.92 if x / 255 <= 0.03928 else ((x / 255 + 0.055) / 1.055) ** 2.4 for x in rgb)
        return 0.2126 * r + 0.7152 * g + 0.0722 * b

    rows = [tuple(k * m % 256 for m in (1, 7, 37, 11, 5, 3)) for k in range(300)]
    frame = spark.createDataFrame(rows, "r int, g int, b int, br int, bg int, bb int")
    ratio = colour.contrast_ratio((F.col("r"), F.col("g"), F.col("b")), (F.col("br"), F.col("bg"), F.col("bb")))
    for row in frame.withColumn("q", ratio).collect():
        x, y = plain(row[:3]), plain(row[3:6])
        assert row["q"] == pytest.approx((max(x, y) + 0.05) / (min(x, y) + 0.05), abs=1e-12)
    plan = frame.where(ratio < 4.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("POWER(") + plan.count("pow(") <= 6


def test_blank_is_what_strips_to_nothing(spark):
    """For every sign up to U+3100 and some with line ends, and nulls."""
    signs = [chr(k) for k in range(1, 0x3101)] + ["", " \n", "\n\n", "a\n", "\r\n", " \n", " x ", None]
    both = spark.createDataFrame([(x,) for x in signs], "s string").select("s", issues._blank(F.col("s")).alias("blank"), (text.stripped(F.coalesce("s", F.lit(""))) == "").alias("bare"))
    assert both.where("blank <> bare").isEmpty() and both.where("blank").count() > 20
