"""The pipeline's stages one after the other, each against plain code, on a table with nulls, empty and long texts, copies, repeated rows and clashing names."""

import collections
import re

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from tagmill.llm import mixing, pieces, quality_rules
from tagmill.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, topic string, row string, weight double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(21)
WORDS = [f"word{k}" for k in range(500)]


def prose(n):
    return " ".join(rng.choice(WORDS, n).tolist())


BASE = prose(200)
TEXTS = [None, "", " \n", "too short to stay", BASE, BASE, BASE.replace("word7 ", "other "), "again and again it says " * 30, prose(3000), f"write to a.b@mail.example.org or +49 (30) 1234-5678 now {prose(60)}", "é ü ß " * 3 + prose(40), *[prose(int(n)) for n in rng.integers(25, 120, 40)]]
ROWS = [(k, t, ["en", "de", None][k % 3], f"s{k % 4}" if k % 9 else None, None if t is None else len(t), "clash", "clash", "clash", 0.5) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[12], ROWS[12], (None, prose(50), "en", "s0", 5, "", "", "", 0.0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def base_failed(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            again |= set(range(i, i + 8))
    return len(words) < 20 or 100 * len(again) > 30 * len(words)


def classes(rows):
    """Places of rows by class of texts that are alike by five words at 0.8 or more."""
    sets = []
    for r in rows:
        w = WORD.findall(r["text"] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = top[i], top[j]
                top = [new if x == old else x for x in top]
    out = collections.defaultdict(list)
    for i, x in enumerate(top):
        out[x].append(i)
    return list(out.values())


def test_stages(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    names, held = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == names
        held.append(docs.collect())
    start, ruled, single, safe, mixed, coded = held
    # rules: rows as they are, none that fails the base rule, and exactly those that the list keeps
    assert not counted(ruled) - counted(start) and not any(base_failed(r["text"]) for r in ruled)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.op7_quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()}
    assert counted(ruled) == counted(r for r in start if kept[r["doc_id"]])
    # near-duplicates: of each class the row of the least id, once
    first = lambda places: min((ruled[i] for i in places), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert counted(single) == counted(first(c) for c in classes(ruled))
    # personal data: same documents, texts without it, lengths that follow
    assert sorted(str(r["doc_id"]) for r in safe) == sorted(str(r["doc_id"]) for r in single)
    was = {r["doc_id"]: r["text"] for r in single}
    for r in safe:
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+49", r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == was[r["doc_id"]] or "@" in was[r["doc_id"]]
    # mixture: a sample of rows as they are, the same every time
    assert mixed and not counted(mixed) - counted(safe)
    again = corpus_pipeline.mixture(spark, spark.read.parquet(f"{tmp_path}/2"), folder).collect()
    assert counted(again) == counted(mixed)
    # ids as the library gives them
    import public_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(map(repr, ((r["doc_id"], r["n_tokens"], r["ids"]) for r in coded))) == sorted(map(repr, ((r["doc_id"], len(ids), ids) for r in mixed for ids in [model.encode(r["text"] or "")])))


def test_run_is_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {len(r["ids"]) == r["n_tokens"] for r in rows} == {True}


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_verdicts_of_a_table(spark, folder):
    """kept: the list's rules in their order, worked out on the operator's own statistics by plain code."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = quality_rules.op7_quality_rules(docs, labels).collect()
    for r in rows:
        assert not (r["base_failed"] and r["kept"])
    failed = {r["doc_id"] for r in rows if r["base_failed"]}
    assert failed == {d for d, t, *_ in ROWS if base_failed(t)}


def test_targets_that_cannot_be_met_are_told(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "w " * 30, "en", "a", "x"), (2, "w " * 30, "de", "b", "x")], "doc_id long, text string, lang string, source string, topic string")
    monkeypatch.setattr(mixing, "ROUNDS", (3, 6))
    with pytest.warns(UserWarning, match="off its target"):
        mixing.probabilities(docs, 0.75, mixing.POWERS, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}})


def test_pieces_model_is_the_file():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        assert pieces.model_bytes() == f.read()


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixture", "token ids"]
    assert corpus_pipeline.ORACLE_SQL is None
