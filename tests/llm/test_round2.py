"""Queries and edge cases against plain code."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import html_main, lm_trie, mixing, ngram_join, pieces, pii, quality_ordinal, topk

rng = np.random.default_rng(8)


def kinds(t):
    return {t[a:b]: k for a, b, k in pii.find_spans(t)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("PassWord=ab12cd34ef5", {"ab12cd34ef5": "secret"}),
        ("aws_secret_access_key = wJalrXUtnFEMIK7MDENG", {"wJalrXUtnFEMIK7MDENG": "secret"}),
        ('{"password": "correcthorse"}', {"correcthorse": "secret"}),
        ("the secret: understanding is slow", {}),
        ("API_key=abcDEFghiJKLmnoPQR", {"abcDEFghiJKLmnoPQR": "secret"}),
        ("iBAN: DE89 3704 0044 0532 0130 00", {"DE89 3704 0044 0532 0130 00": "account"}),
        ("İİ PASSWORD=ab12cd34", {"ab12cd34": "secret"}),
    ],
)
def test_cues(text, want):
    assert {k: v for k, v in kinds(text).items() if v in ("secret", "account")} == want


def test_long_schemes():
    scheme = "a" * 300
    assert kinds(f"9{scheme}://h.example/x and x://y.example")[f"{scheme}://h.example/x"] == "url"
    assert pii.find_spans("a" * 200_000 + "://" + "password" * 20_000)[:1] == [(0, 200_000 + 3 + 8 * 20_000, "url")]


def test_ordinal_grades_of_any_range(spark):
    texts = [f"plain words {'good ' * (k % 4 >= 2)}{'great ' * (k % 4 == 3)}{'bad' * (k % 4 == 0)}" for k in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (3, None), (None, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, [-2, 1, 5, 9][k % 4], 0) for k in range(300)], "doc_id long, quality int, toxic int")
    model = quality_ordinal.train(docs, quality_ordinal.rated(labels))
    assert model.levels.tolist() == [-1, 2, 6, 10] and (np.diff(model.thresholds) > 0).all()
    got = quality_ordinal.op1_ordinal(docs, labels).collect()
    assert len(got) == 402
    for r in got:
        text = {k: t for k, t in enumerate(texts)}.get(r["doc_id"], "good")
        if r["doc_id"] == 3 and r["score"] == 0.0:
            text = ""
        score = sum(float(model.weights[b]) for b in set(quality_ordinal.buckets(text).tolist()))
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["p_highest"] == pytest.approx(above[-1], abs=1e-6)
        assert r["expected_grade"] == pytest.approx(-1 + 3 * above[0] + 4 * above[1] + 4 * above[2], abs=1e-5)
        assert r["kept"] == (r["p_highest"] >= 0.5)
    one = quality_ordinal.op1_ordinal(docs, labels.where("quality = 1"))
    assert {(r["expected_grade"], r["kept"]) for r in one.collect()} == {(2.0, True)}


def test_ordinal_bound_holds_for_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(quality_ordinal, "fit", lambda rows, grades: seen.append(len(rows)))
    quality_ordinal.train(docs, ratings, 10)
    assert seen == [10]


PLAIN = '<body><div class="menu"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div><div id="x7"><div>Home &gt; News</div><div class="t">{head}</div>{body}<div><a href="/1">More of it, here</a> <a href="/2">And more, there</a></div></div><div class="cookie"><p>We keep cookies, as you know. They are good, and they are small, and we like them.</p></div><div>All rights, reserved.</div></body>'
PARAS = [f"This is sentence {k}, which goes on for a while, and then some more; it ends here. Another one follows, as is usual." for k in range(6)]


def test_html_without_semantic_tags():
    body = "".join(f"<p>{x}</p>" for x in PARAS)
    got = html_main.main_text(PLAIN.format(head="A title of words", body=body)).split("\n")
    assert got[-6:] == PARAS and not any(x in " ".join(got) for x in ("One", "cookies", "rights", "More of it"))


def test_html_tables_lists_and_maths_stay():
    body = f"<h2>Part</h2><p>{PARAS[0]}<ul><li>short item<li>other</ul><table><tr><td>1<td>22</table><p>{PARAS[1]}</p><math>x = y</math><p>{PARAS[2]}"
    got = html_main.main_text(f"<body><article>{body}</article></body>").split("\n")
    assert got == ["Part", PARAS[0], "short item", "other", "1", "22", PARAS[1], "x = y", PARAS[2]]


def test_html_article_of_one_word_beats_an_advert():
    assert html_main.main_text(f'<body><nav><a href="/">a</a></nav><div class="ad">{PARAS[0]}</div><article><p>Sh is.</article><footer>{PARAS[1]}</footer>') == "Sh is."
    assert html_main.main_text(f"<body><nav><p>{PARAS[0]}</nav><footer>x</footer>") == ""


@pytest.mark.parametrize("tag", ["div", "ul><li", "table><tr><td", "p", "article"])
def test_html_deep(tag):
    assert html_main.main_text(f"<{tag}>" * 5000 + PARAS[0] + "</x></p>" * 5000) == PARAS[0]


def test_html_empty_and_repeated(spark):
    rows = [(1, "u", "<p>Twice, here.</p>", 1), (1, "u", "<p>Twice, here.</p>", 1), (None, None, None, 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    assert sorted(r["text"] for r in html_main.op5_html_main(frame).collect()) == ["", "Twice, here.", "Twice, here."]
    assert html_main.op5_html_main(frame.where("false")).count() == 0


def test_pieces_by_table(spark, monkeypatch):
    """Few remembered, hashes that clash and chunks too long for the table give the library's ids and texts; a chunk is segmented once."""
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    model = pieces.model_bytes()
    whole = pieces.Pieces(model).whole
    texts = [" ".join(rng.choice(["ab", "the", "Ünï", "x" * 400, "a▁b", "", "\n\n", "", "1234567"], 30).tolist()) for _ in range(60)] + ["", None, " ", "▁", "a" * 5000, "\x00", "</s>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encoded(docs, model).collect()}
    for k, t in enumerate(texts):
        ids = whole.encode(t or "")
        assert got[k] == (ids, whole.decode(ids))


def test_pieces_hashes_that_clash(tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "hashed", lambda c: 5 if c in ("a", "b", "c") else 7)
    entries = [(2, f"{k},70", c if k % 2 else f"{c}?") for k, c in enumerate("abcd")]
    pieces.write_part(f"{tmp_path}/chunks-0", list("abcd"), entries)
    table = pieces.Table(str(tmp_path), 1, frozenset([0]))
    assert table.look_up(["c", "d", "a", "e"]) == {"a": entries[0], "c": entries[2], "d": entries[3]}


def test_topk_tiles():
    """Ties at the edge of the list, repeated ids, widths that differ; every tile against a plain sort."""
    for n in (1, 5, 40, 300):
        ids = rng.integers(0, 50, n)
        rows = rng.integers(-2, 3, (n, 4)).astype(float)
        q_ids, q = rng.integers(0, 50, 7), rng.integers(-2, 3, (7, 3)).astype(float)
        got = topk.tile(q_ids, q, ids, rows, 6)
        want = [(i, k, -s) for i in range(7) for s, k in sorted((-float(q[i] @ rows[j, :3]), ids[j]) for j in range(n) if ids[j] != q_ids[i])[:6]]
        assert list(zip(*[x.tolist() for x in got], strict=True)) == want


def near_texts(n: int) -> list[str]:
    """Families of texts, each an edit of the family's first, at similarities around 0.8 and far below."""
    words = np.array([f"w{k}" for k in range(5000)])
    out = []
    for _ in range(n // 20):
        base = rng.choice(words, 120)
        for k in range(20):
            own = base.copy()
            own[rng.integers(0, 120, k // 4)] = "changed"
            out.append(" ".join(own[: 120 - 3 * (k % 5)]))
    return out


def chained_texts(n):
    """Texts that each share most of their words with the next ones: one group, however many."""
    words = [f"c{k}" for k in range(5 * n + 100)]
    return [" ".join(words[5 * k : 5 * k + 100 - 2 * (k % 3)]) for k in range(n)]


@pytest.mark.parametrize(("make", "n", "chained", "block"), [(near_texts, 400, 3072, 128), (chained_texts, 110, 3072, 128), (near_texts, 40, 10, 8)])
def test_ngram_recall(spark, monkeypatch, make, n, chained, block):
    """Every link of brute force, no other: groups in tiles, and, with groups of more than ten taken for chained ones, bucket by bucket in tiles of their own."""
    texts = make(n)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [[j for j in range(len(texts)) if j != i and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])] for i, a in enumerate(sets)]
    monkeypatch.setattr(ngram_join, "CHAINED", chained)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.op8_ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: len(x) for i, x in enumerate(alike)}
    assert sum(want.values()) >= 2 * n and got == want


def plain_rake(words, goals, rounds=60):
    """Iterative proportional fitting over cells (source, lang, topic) -> words."""
    w, total = dict.fromkeys(words, 1.0), sum(words.values())
    for _ in range(rounds):
        for d in range(3):
            for v in {k[d] for k in words}:
                have = sum(words[k] * w[k] for k in words if k[d] == v)
                for k in words:
                    if k[d] == v and have > 0:
                        w[k] *= goals[d][v] * total / have
    return w


@pytest.mark.parametrize("targets", [None, {"source": {"s0": 0.6, None: 0.4}, "topic": {"prose": 1.0, "odd": 2.0, "nowhere": 3.0}}])
def test_mixing_query(spark, targets):
    """Words, weights, probabilities and draws against plain code, nulls in every column included; the topic is the markers' or an expression."""
    words = ["License", "|", "a@b", "the", "a1", "of"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30), p=[0.02, 0.03, 0.03, 0.5, 0.3, 0.12]).tolist()) for _ in range(300)]
    rows = [(None if k == 7 else k, None if k % 41 == 0 else t, [None, "en", "de"][k % 3], ["s0", "s1", None][k % 5 % 3]) for k, t in enumerate(texts)] + [(5, texts[5], "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if targets:
        asked = F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 1, "odd").otherwise("prose")
        topic = {i: "odd" if (r[0] or 0) % 2 else "prose" for i, r in enumerate(rows)}
    else:
        asked = None
        topic = {i: next((k for k, x in (("licence", "icense"), ("table", " | "), ("contact", "@")) if x in (r[1] or "")), "prose") for i, r in enumerate(rows)}
    cells: dict = {}
    for i, r in enumerate(rows):
        key = (r[3], r[2], topic[i])
        cells[key] = cells.get(key, 0) + len((r[1] or "").split())
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        own = {v: sum(n for k, n in cells.items() if k[d] == v) for v in {k[d] for k in cells}}
        raised = {v: (targets[name].get(v, 0.0) if targets and name in targets else n ** mixing.POWERS[name]) if n else 0.0 for v, n in own.items()}
        goals.append({v: x / sum(raised.values()) for v, x in raised.items()})
    weight = plain_rake(cells, goals)
    share = min(0.75, 1 / max(w for k, w in weight.items() if cells[k]))
    got = mixing.op2_mixing(docs, targets=targets, topic=asked).collect()
    assert len(got) == len(rows)
    by = {(r["source"], r["lang"], r["topic"]): (r["weight"], r["probability"]) for r in got}
    for k, (w, p) in by.items():
        assert w == pytest.approx(weight[k], abs=1e-9) and p == pytest.approx(min(1.0, weight[k] * share), abs=1e-9)
    assert sorted((str(r["doc_id"]), r["n_words"], r["topic"]) for r in got) == sorted((str(r[0]), len((r[1] or "").split()), topic[i]) for i, r in enumerate(rows))
    assert not any(r["drawn"] for r in got if r["probability"] == 0) and 0 < sum(r["drawn"] for r in got) < len(rows)


def test_lm_score_of_plain_model(spark):
    """score is the sum of log10 of the discounted triple plus what its context leaves to the pair, and that to the word, up to quantisation."""
    texts = [" ".join(rng.choice(["a", "b", "C", "d", "ee"], rng.integers(0, 12)).tolist()) for _ in range(60)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = [[*(t or "").lower().split(), "</s>"] for t in texts]
    train = [t for k, t in enumerate(tokens) if zlib.crc32(str(k).encode()) % 5 != 1]
    count = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["</s>", *t], t, strict=False))
    n, v = sum(count.values()), len(count)
    left = {a: 1 - sum((c - 0.75) / count[a] for (x, _), c in pairs.items() if x == a) for a in count}
    triples = collections.Counter(p for t in train for p in zip(["</s>", *t], t, t[1:], strict=False))
    left3 = {(a, b): 1 - sum((c - 0.75) / pairs[a, b] for (x, y, _), c in triples.items() if (x, y) == (a, b)) for a, b, _ in triples}

    def estimate(a, b, c):
        pair = max(pairs[b, c] - 0.75, 0) / count.get(b, 1) + left.get(b, 1.0) * (count[c] + 0.5) / (n + 0.5 * (v + 1))
        return pair if a is None else max(triples[a, b, c] - 0.75, 0) / max(pairs[a, b], 1) + left3.get((a, b), 1.0) * pair

    for r in lm_trie.op10_lm_trie(docs).collect():
        t = tokens[r["doc_id"]]
        want = sum(math.log10(estimate(*g)) for g in zip([None, "</s>", *t], ["</s>", *t], t, strict=False))
        assert r["score"] == pytest.approx(want, abs=0.002 * len(t))
