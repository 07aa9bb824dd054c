"""What written tables and the rounds between them leave on disk."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagmill.operators import closure, layout, tables, tree
from tagmill.plans import catalogue


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def shared(spark):
    return tree.shared_folder(spark).removeprefix("file:")


def shuffles(spark):
    """Names of the shuffle files that lie on this machine."""
    folders = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_a_cut_is_compressed_and_leaves_no_shuffle(spark):
    rows = spark.range(200_000).select((F.col("id") % 50).alias("doc_id"), F.lit("a text that comes again and again").alias("text"), "id")
    files, before = shuffles(spark), size(shared(spark))
    cut = tree._cut(rows.repartition("doc_id"))
    assert not shuffles(spark) - files
    assert size(shared(spark)) - before < 2_000_000  # as rows they take more than 10 MB
    assert cut.count() == 200_000 and cut.columns == rows.columns
    assert spark.conf.get(tree.TIDY) == "false"


def test_rounds_write_no_pair_twice(spark):
    """A chain of 400 has 80,200 pairs; written again in each round they would take more than once their size."""
    chain = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    before = size(shared(spark))
    lines = closure.ancestors(chain)
    grown = size(shared(spark)) - before
    assert lines.count() == 400 * 401 // 2
    assert grown < 1_000_000


def test_dropped_tables_are_gone(spark):
    frame, path = tree.written(spark.range(1000))
    assert frame.count() == 1000
    tree.dropped(spark, path)
    assert not Path(path.removeprefix("file:")).exists()


def test_rules_write_one_after_another(spark, monkeypatch):
    """The shuffles of a rule are gone before the next one runs."""
    data, files, left = "/root/testdata/sf0.001", shuffles(spark), []

    def found(spark, d):
        for k in range(3):
            left.append(shuffles(spark) - files)
            rows = spark.range(5000).select((F.col("id") % 9).alias("doc_id")).repartition("doc_id")
            yield rows.select("doc_id", F.lit(f"0{k + 1}-001").alias("checkpoint"))

    monkeypatch.setattr(catalogue, "_found", found)
    monkeypatch.setattr(catalogue, "_BAGS", {})
    bag = catalogue._bag(spark, data)
    assert bag.count() == 15_000 and left == [set()] * 3
    assert {r["checkpoint"]: r["count"] for r in bag.groupBy("checkpoint").count().collect()} == {f"0{k}-001": 5000 for k in (1, 2, 3)}


def test_steps_of_repeats_leave_no_shuffle(spark):
    """What op6 reads last are written tables; the shuffles of the steps before are gone by then."""
    suffix_dedup = pytest.importorskip("tagmill.llm.suffix_dedup")
    passage = " ".join(f"word{k * k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"{k} starts {passage} and ends {k * 7}") for k in range(40)], "doc_id long, text string")
    files = shuffles(spark)
    out = suffix_dedup.op6_suffix_dedup(docs)
    assert not shuffles(spark) - files
    assert out.where("n_removed >= 400").count() == 40


def test_bag_by_slices_is_whole_and_leaves_nothing_else(spark, monkeypatch):
    """Documents slice by slice give the bag that they give at once; tables of rules that are done don't stay."""
    data, bags = "/root/testdata/sf0.001", []
    size = sum(length for _, length, _ in catalogue._stamps(spark, data))
    for most in (size, size // 2):
        monkeypatch.setattr(catalogue, "SLICE", most)
        monkeypatch.setattr(catalogue, "_BAGS", {})
        before = {p.name for p in Path(shared(spark)).iterdir()}
        bags.append((catalogue._slices(spark, data), catalogue._bag(spark, data)))
        assert len({p.name for p in Path(shared(spark)).iterdir()} - before) == 1
    (one, whole), (many, sliced) = bags
    assert one == 1 and many >= 2 and whole.count() > 10_000
    assert whole.exceptAll(sliced).isEmpty() and sliced.exceptAll(whole).isEmpty()


def test_legends_shuffle_few_bytes(spark):
    """With joins as large inputs have them: boxes go once to their pages; only centres of groups that may be legends meet texts, in one cell each."""

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    k = F.col("id")
    place = lambda salt, most: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most))).cast("double")
    boxes = spark.range(60_000).select(F.floor(k / 60).alias("doc_id"), F.lit(0).cast("long").alias("page"), k.alias("elem_id"), F.when(k % 9 == 0, "text").otherwise("rect").alias("kind"), (k % 5).alias("color"), place(1, 600).alias("x0"), place(2, 800).alias("y0"))
    boxes = tree.written(boxes.withColumns({"x1": F.col("x0") + 8, "y1": F.col("y0") + 8}))[0]
    before, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert layout.color_legends(boxes).count() > 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert written() - before < 6_000_000


def test_legends_of_boxes_without_a_place(spark):
    """A box whose centre isn't known leads a group of its own and meets no text."""
    side = "x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 0, k, "rect", k, 10.0 * k, 0.0, 10.0 * k + 5, 5.0) for k in range(3)] + [(1, 0, 3, "rect", 3, None, 0.0, None, 5.0), (1, 0, 4, "text", 0, None, 0.0, 9.0, 9.0)]
    got = layout.color_legends(spark.createDataFrame(rows, f"doc_id long, page long, elem_id long, kind string, color long, {side}")).collect()
    assert [(r["legend"], r["members"], r["colours"], r["x0"], r["x1"]) for r in got] == [(0, 3, 3, 0.0, 25.0)]


def test_slices_filter_before_they_shuffle(spark, monkeypatch):
    """Cells of a slice go through their window without the lines of other slices."""
    data, plans, written = "/root/testdata/sf0.001", [], tree.written
    monkeypatch.setattr(catalogue, "_slices", lambda spark, d: 3)

    def noted(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return written(rows)

    monkeypatch.setattr(tree, "written", noted)
    found = catalogue._found(spark, data)
    while not any("rowspan" in p for p in plans):
        next(found)
    found.close()
    cells = next(p for p in plans if "rowspan" in p)
    assert 0 < cells.index("Window") < cells.index("pmod(")  # what stands below in the plan comes first


def test_small_files_of_many_rows_stay(spark):
    """A written table of little more than some bytes a row isn't broadcast within tidied, and settings come back."""
    rows = spark.range(400_000).select("id", F.lit("a text that comes again and again").alias("text"))
    small, path = tree.written(rows)
    assert size(path.removeprefix("file:")) < 10_000_000
    plan = lambda: spark.range(9_000_000).join(small, "id")._jdf.queryExecution().sparkPlan().toString()
    before = spark.conf.get(tree.BY_FILES)
    assert "BroadcastHashJoin" in plan()
    with tree.tidied(spark):
        assert "BroadcastHashJoin" not in plan()
    assert spark.conf.get(tree.BY_FILES) == before and spark.conf.get(tree.BY_ROWS, None) is None


def test_cells_know_their_tables(spark):
    """As shape and uses_ids say by joins, with one shuffle."""
    lines = catalogue.table(spark, "/root/testdata/sf0.001", "lineitem")
    cells = tree.written(catalogue._cells(spark, "/root/testdata/sf0.001", lines))[0]
    one = tables.in_tables(cells)
    want = tables.shape(cells).join(tables.uses_ids(cells), "table_id")
    got = one.where("at = 1").select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 1000
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_one_walk_for_all(spark):
    nodes = catalogue.frame(spark, "/root/testdata/sf0.001", catalogue.fx.TALKING)
    got, key = tree.walked(nodes), ["doc_id", "node_id"]
    for want in (tree.depths(nodes), tree.paths(nodes), tree.effective_languages(nodes)):
        same = got.select(want.columns)
        assert same.exceptAll(want).isEmpty() and want.exceptAll(same).isEmpty()
    assert got.select(key).count() == nodes.count()


def test_shown_text_places_once(spark, monkeypatch):
    """The paths of nodes are worked out once for both steps."""
    asked, places = [], closure.places
    monkeypatch.setattr(closure, "places", lambda *a: asked.append(a) or places(*a))
    assert catalogue.QUERIES["shown_text"](spark, "/root/testdata/sf0.001").count() > 1000
    assert len(asked) == 1
