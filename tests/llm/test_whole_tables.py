"""The text operators do the whole job: nothing that was observed is left out."""

import numpy as np
import pytest

from tagmill.llm import html_main, lm_trie, mixing


@pytest.mark.parametrize("shard", [lm_trie.SHARD, 2])
def test_lm_keeps_pairs_seen_once(spark, shard):
    model = lm_trie.train(spark.createDataFrame([("a b c d",), ("a b e",)], "text string"), parts=2, shard=shard)
    assert model.n_shards == (2 if shard > 9 else 5)
    data = np.frombuffer(b"a b c d e", np.uint8)
    stream, _ = lm_trie.tokens(data, np.array([0, len(data)]))
    opened = model.opened()
    a, b, c, d, e = opened.words.look_up(np.sort(stream[:5]))[0][np.argsort(np.argsort(stream[:5]))].astype(np.uint64)
    pairs = {(a, b): 1.25 / 2, (b, c): 0.25 / 2, (c, d): 0.25, (b, e): 0.25 / 2, (a, c): 0.0}
    keys = sorted((p, (int(p[0]) << 32) | int(p[1])) for p in pairs)
    kept = opened.kept(np.sort(np.array([k for _, k in keys], np.uint64)))
    want = [pairs[p] for p, _ in sorted(keys, key=lambda x: x[1])]
    assert kept.tolist() == pytest.approx(want, rel=1e-5)
    # "a b c d": after (END, a) always b, after (a, b) c or e, after (b, c) d
    score = opened.scores(stream, np.arange(6))[3]
    single = lambda n: (n + 0.5) / (9 + 0.5 * 7)
    b_alone, c_alone = 1.25 / 2 + 0.75 / 2 * single(2), 0.25 / 2 + 1.5 / 2 * single(1)
    assert 10 ** score[1] == pytest.approx(1.25 / 2 + 0.75 / 2 * b_alone, rel=1e-5)
    assert 10 ** score[2] == pytest.approx(0.25 / 2 + 1.5 / 2 * c_alone, rel=1e-5)


def test_mixing_meets_targets(spark):
    words = {("big", "en"): 3000, ("big", "de"): 900, ("mid", "en"): 1500, ("mid", "de"): 600, ("small", "en"): 9, ("small", "de"): 3}
    docs = spark.createDataFrame([(k, "w " * n, lang, source) for k, ((source, lang), n) in enumerate(words.items())], "doc_id long, text string, lang string, source string")
    table = mixing.probabilities(docs.withColumn("topic", mixing.markers()), 0.75, mixing.POWERS)
    assert 0 < table.agg({"probability": "max"}).first()[0] <= 1
    got = mixing.residuals(table, mixing.POWERS).collect()
    assert len(got) == 6 and all(abs(r["target"] - r["reached"]) < 1e-9 for r in got)
    assert all(0 <= r["probability"] <= 1 for r in mixing.op2_mixing(docs).collect())


@pytest.mark.parametrize("name", ["layout with-sidebar", "content no-sidebar", "page has-header", "elementor-widget", "widget", "sidebar"])
def test_html_wrapper_keeps_its_article(name):
    page = f'<body><div class="{name}"><article><div class="entry-header"><h1>A title</h1></div><p>First, of all.</p><div class="comments"><p>A reader says, no.</p></div></article></div><div class="sidebar"><p>Side, text.</p></div></body>'
    assert html_main.main_text(page) == "A title\nFirst, of all."
