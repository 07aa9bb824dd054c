"""Merkle manifest, sequences of ids and lexical search against plain code on tables with nulls, ties, repeated rows and long texts."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagmill.llm import lexical, merkle, sequences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, term string, query long, start long, number long"
rng = np.random.default_rng(8)
VOCABULARY = [f"wö{k}" if k % 5 == 0 else f"Word{k}" for k in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n, p=np.arange(300, 0, -1) / 45150).tolist())


def make(n, sources):
    out = [(k, prose(int(rng.integers(1, 60))), "en" if k % 3 else None, sources[int(rng.integers(len(sources)))], k) for k in range(n)]
    return out + [(None, None, None, None, None), (None, "no id", "en", sources[0], 3), (3, "UPPER of an id again", "en", sources[0], 3), (3, "UPPER of an id again", "en", sources[0], 3), (5, "", None, "", 0), (-9, "a\x00b ß don't. it, is; ..!  \t\r\n x9y", "x", "é", 1), (10**15, prose(4000), "en", sources[0], 9), (10**15 + 1, "z" * 9000, "en", sources[0], 9)]


@pytest.fixture(scope="module")
def table(spark):
    rows = make(700, ["s1", "s1", "s1", "s2", "ü", "s10"])
    return rows, spark.createDataFrame([(*r[:5], "", "", 0, 0, 0) for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- op11 ------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def lowered(row):
    small = None if row[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), row[1])
    return (row[0], small, *row[2:]) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else row


def manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, own = [], []
    for s in sources:
        mine = sorted([r for r in rows if r[3] == s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        own.append(mine)
        trees.append(levels_of([leaf_of(r) for r in mine]))
    top = levels_of([t[-1][0] for t in trees])
    for k, (mine, tree) in enumerate(zip(own, trees, strict=True)):
        for i, r in enumerate(mine):
            value, siblings = leaf_of(lowered(r)), []
            for at, levels in ((i, tree), (k, top)):
                for level in levels[:-1]:
                    a, run = at % 16, level[at // 16 * 16 : at // 16 * 16 + 16]
                    siblings += run[:a] + run[a + 1 :]
                    value = h(*run[:a], value, *run[a + 1 :])
                    at //= 16
            yield (r[0], leaf_of(r), tree[-1][0], top[-1][0], h(*siblings), value, value == top[-1][0])


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("shape", ["mixed", "one source", "many sources", "one row"])
def test_merkle_by_hand(spark, table, shape):
    rows = {"mixed": table[0], "one source": [(*r[:3], "s", r[4]) for r in table[0][:257]], "many sources": [(*r[:3], f"s{k // 2}", r[4]) for k, r in enumerate(table[0][:600])], "one row": table[0][:1]}[shape]
    got = found(merkle.op11_merkle(spark.createDataFrame([(*r, "", "", 0, 0, 0) for r in rows], SCHEMA).repartition(4)))
    assert got == sorted(manifest(rows), key=repr)
    assert shape == "one row" or {r[-1] for r in got} == {True, False}


def test_merkle_of_nothing(empty):
    frame = merkle.op11_merkle(empty)
    assert frame.collect() == [] and frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


# ---- op12 ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return sequences.default_tokenizer()


def coded(tokenizer, rows):
    plain = Tokenizer.from_str(tokenizer.decode())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ordered]


def test_sequences_by_library(spark, table, tokenizer):
    rows, docs = table
    want = coded(tokenizer, rows)
    got = sequences.op12_sequences(docs, tokenizer).orderBy("start").collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(ids) for _, ids in want)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(d), crc(ids)) for d, ids in want)


def test_sequences_are_found_by_number(spark, table, tokenizer, tmp_path):
    docs = table[1].where("doc_id between 10 and 400")
    written = sequences.write_sequences(docs, tokenizer, str(tmp_path), length=64)
    whole = [i for _, ids in coded(tokenizer, [r for r in table[0] if r[0] is not None and 10 <= r[0] <= 400]) for i in ids]
    read = sequences.read_sequences(spark, written).orderBy("sequence").collect()
    assert [r["sequence"] for r in read] == list(range(written.sequences_before[-1])) and {len(r["ids"]) for r in read} == {64}
    assert [i for r in read for i, m in zip(r["ids"], r["mask"], strict=True) if m] == whole
    for k in (0, len(read) // 2, len(read) - 1):
        ids, mask = written.sequence(k)
        assert ids.tolist() == read[k]["ids"] and mask.to_pylist() == read[k]["mask"] and not ids.flags.owndata
    with pytest.raises(IndexError):
        written.sequence(len(read))


@pytest.mark.parametrize("text", ["Ａ b.", "don't it's  x", "a ̈ İstanbul ΣΑΣ. ς", "x\x1cy z w v\tt\rr", "<|endoftext|> Hi", "'s 't...", "é. É.", "a.b, c.., ,", "K. Å Å! 9. 99?", "niño ñu. straße ÿ÷x ö", "\n\n", "ﬁ 가" + "q" * 90 + "."])
def test_chunks_give_the_ids_of_the_whole(tokenizer, text):
    coder = sequences.Encoder(tokenizer)
    want = [Tokenizer.from_str(tokenizer.decode()).encode(text, add_special_tokens=False).ids] * 2
    assert coder.splits and [np.frombuffer(x, coder.kind).tolist() for x in coder.encoded([text.encode()] * 2)] == want


def test_tokenizers_that_merge_across_blanks_take_whole_texts(tokenizer):
    other = tokenizer.replace(b'"use_regex":false', b'"use_regex":true').replace(b'"use_regex": false', b'"use_regex": true')
    assert not sequences.Encoder(other).splits


def test_sequences_of_nothing(empty, tokenizer):
    assert sequences.op12_sequences(empty, tokenizer).collect() == []


# ---- op13 ------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    kept = [(d, terms(t)) for d, t in docs if terms(t)]
    size, count = sum(len(t) for _, t in kept), len(kept)
    df = {}
    for _, t in kept:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    w = {x: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for x, n in df.items()}
    for item, text in items:
        scores = []
        for d, t in kept:
            m = 25 + 75 * len(t) * count // size
            scores.append((sum(w[x] * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms(text) if x in w), d))
        best = sorted([s for s in scores if s[0] > 0], key=lambda s: (-s[0], s[1] is not None, s[1] or 0))[:k]
        yield from ((item, r + 1, d, s) for r, (s, d) in enumerate(best))


ITEMS = [(0, prose(30)), (1, "word1 WORD2 word2, wö10"), (2, None), (3, ""), (4, "unknown terms"), (5, "z" * 9000), (6, prose(200)), (7, "word299"), (8, "Word1 " * 40), (9, "upper of an id"), (None, "id again")]


@pytest.mark.parametrize(("chunk", "per_round"), [(1 << 16, 1 << 20), (64, 30)])
def test_search_by_hand(spark, table, monkeypatch, chunk, per_round):
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    rows, docs = table
    items = spark.createDataFrame([(i, t, 7, "") for i, t in ITEMS], "item_id long, text string, query long, doc_id string")
    numbered = items.select("item_id", "text").withColumn("query", F.coalesce("item_id", F.lit(99)))
    got = lexical.search(docs.repartition(6), numbered.select("query", "text"), 10, per_round)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(ranked([(r[0], r[1]) for r in rows], [(99 if i is None else i, t) for i, t in ITEMS]), key=repr)
    if per_round > 30:
        assert sorted(map(tuple, lexical.op13_lexical(docs, items).collect()), key=repr) == sorted(ranked([(r[0], r[1]) for r in rows], ITEMS), key=repr)


def test_search_among_copies(spark):
    """Copies tie; the least ids stay, and a passage's holder is found among many that share its words."""
    docs = [(k, "same words here") for k in range(3000)] + [(5000 + k, f"here same rare{k % 7} words other") for k in range(500)] + [(9000, "rare1 rare2 here")]
    items = [(1, "same words here"), (2, "rare1 rare2"), (3, "here " * 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = lexical.op13_lexical(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(ranked(docs, items))


def test_search_of_nothing(spark, empty, table):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "word1")], "item_id long, text string")
    assert lexical.op13_lexical(empty, some).collect() == []
    assert lexical.op13_lexical(table[1], none).collect() == []


def test_terms_are_counted_over_bytes(spark):
    texts = [None, "", " ", "a", "a b", "-é-x", "a.b", "ab", "9", "\x00q\x7f"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert lexical.corpus_size(frame) == (sum(bool(terms(t)) for t in texts), sum(len(terms(t)) for t in texts))
