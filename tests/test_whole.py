"""Walks over trees reach every node."""

from tagmill.operators import tree


def test_walks_beyond_the_limits_of_recursion(spark):
    chain = [(1, k, k - 1 if k else None, "es" if k == 0 else "") for k in range(6)] + [(2, k, 0 if k else None, "") for k in range(60)]
    nodes = spark.createDataFrame(chain, "doc_id long, node_id long, parent_id long, lang string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "3")
    try:
        assert {tuple(r) for r in tree.depths(nodes).collect()} == {(1, k, k) for k in range(6)} | {(2, k, min(k, 1)) for k in range(60)}
        assert tree.effective_languages(nodes).where("eff_lang = 'es'").count() == 6
        root = nodes.where("parent_id is null").select("doc_id", "node_id")
        assert tree.subtree(nodes, root).count() == 66
        assert tree.ancestors(nodes, nodes.select("doc_id", "node_id")).count() == 21 + 60 + 59
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
        spark.conf.unset("spark.sql.cteRecursionLevelLimit")


def test_common_ancestors_of_all_nodes(spark):
    up = {(d, k): None if k == 0 else (k * 7 + d) % k for d in range(3) for k in range(40)}
    nodes = spark.createDataFrame([(d, f"c{k:02}", None if p is None else f"c{p:02}") for (d, k), p in up.items()], "doc_id long, node_id string, parent_id string")

    def line(d, k):
        return [k] if up[d, k] is None else [k, *line(d, up[d, k])]

    want = {(d, f"c{k:02}", f"c{k + 1:02}", f"c{next(x for x in line(d, k) if x in line(d, k + 1)):02}") for d in range(3) for k in range(39)}
    got = tree.common_ancestors(nodes, tree.next_pairs(nodes)).select("doc_id", "a", "b", "common").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
