"""What the steps of op6 cost in Python and in sorting, and that they find what plain code finds."""

import collections
import hashlib
import sys

import numpy as np
import pyarrow as pa

from tagmill.llm import suffix_dedup

LENGTH, GRAM = suffix_dedup.LENGTH, suffix_dedup.GRAM


def calls(step, batch):
    """Rows of step over one batch, and how many functions were called for them."""
    n = 0

    def note(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(note)
    try:
        out = list(step(iter([batch])))
    finally:
        sys.setprofile(None)
    return pa.Table.from_batches(out).to_pylist(), n


def lists(rows, fields):
    return pa.array(rows, pa.list_(pa.struct(fields)))


def test_blocks_are_not_taken_one_by_one():
    """bringing and removing blocks calls a few functions for each batch, not some for each block."""
    text = "".join(np.random.default_rng(3).choice(list("abcdé"), 40_000))
    data = text.encode()
    places = range(0, len(data) - 400, 10)
    texts = pa.array([text, "short", text])
    wanted = [{"gram": k, "block": -k, "proof": 7, "n": 1, "place": p << 16 | (1 + k % 185) << 8 | 3} for k, p in enumerate(places)]
    fields = [(c, pa.int64()) for c in ("gram", "block", "proof", "n", "place")]
    got, n = calls(suffix_dedup._bring, pa.RecordBatch.from_arrays([texts, lists([wanted, [], wanted[::-1]], fields)], names=["text", "wanted"]))
    assert [(r["gram"], r["block"], r["proof"], r["n"], r["shape"], r["bytes"]) for r in got] == [(w["gram"], w["block"], w["proof"], w["n"], w["place"] & 0xFFFF, data[w["place"] >> 16 : (w["place"] >> 16) + (w["place"] >> 8 & 255) - 1 + LENGTH]) for w in wanted + wanted[::-1]]
    assert n < len(wanted)

    # blocks of which all windows repeat (no bits), the last one or none
    ends = {k: k % 185 + 1 for k in range(0, len(data) - 2 * LENGTH, 5)}
    found = [{"place": p << 16 | c << 8, "bits": None if p % 3000 == 0 else np.packbits(np.arange(c) == c - 1 if p % 9000 < 2000 else np.zeros(c, bool)).tobytes()} for p, c in ends.items()]
    gone = np.zeros(len(data), bool)
    for p, c in ends.items():
        for k in range(c) if p % 3000 == 0 else [c - 1] if p % 9000 < 2000 else []:
            gone[p + k : p + k + LENGTH] = True
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    want = {"n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()}
    assert 1 < spans and 0 < want["n_removed"] < len(data)
    whole = {"n_bytes": len(data), "n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(data).hexdigest()}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts, lists([found, None, []], [("place", pa.int64()), ("bits", pa.binary())])], names=["doc_id", "text", "found"])
    got, n = calls(suffix_dedup._remove, batch)
    assert got[0] == {"doc_id": 1, **want} and got[2] == {"doc_id": 3, **whole}
    assert got[1] == {"doc_id": 2, "n_bytes": 5, "n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(b"short").hexdigest()}
    assert n < len(found)


def test_runs_end_with_their_text():
    """The last window of a text and the first of the next lie LENGTH apart and are two runs."""
    texts = ["x" * LENGTH, "x" * LENGTH, "", "y" * (LENGTH + 1)]
    found = [[{"place": 1 << 8, "bits": None}]] * 2 + [None, [{"place": 2 << 8, "bits": np.packbits([0, 1]).tobytes()}]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts), lists(found, [("place", pa.int64()), ("bits", pa.binary())])], names=["doc_id", "text", "found"])
    for b in (batch, batch.slice(1, 3)):
        got = [(r["n_removed"], r["n_spans"]) for r in calls(suffix_dedup._remove, b)[0]]
        assert got == [(LENGTH, 1), (LENGTH, 1), (0, 0), (LENGTH, 1)][-len(got) :]


def test_windows_that_nothing_can_equal_are_not_sorted(monkeypatch):
    """of blocks under one gram only windows whose ends come again are sorted, and all repeats are found."""
    rng = np.random.default_rng(11)
    around = lambda n: rng.integers(97, 123, n).astype(np.uint8)
    gram, offset, count = around(GRAM), 184, 185
    common = np.concatenate([around(150), gram, around(60)])
    own = []
    for k in range(60):
        inner = common if k % 6 == 0 else np.concatenate([around(150), gram, around(60)])
        whole = np.concatenate([around(34), inner, around(124)])
        if k % 12 == 0:
            whole[140 + k // 12] ^= 1  # the ends of windows agree, and what is between doesn't
        own.append(whole)
    data, size = np.concatenate(own), LENGTH + count - 1
    assert {len(x) for x in own} == {size}
    taken = []
    sort = suffix_dedup.Suffixes.sort
    monkeypatch.setattr(suffix_dedup.Suffixes, "sort", lambda self, places, segment: (taken.append(len(places)), sort(self, places, segment))[1])
    bounds = np.arange(len(own) + 1) * size
    got = suffix_dedup.repeated_windows(np.full(len(own), 5), np.ones(len(own), np.int64), np.full(len(own), count << 8 | offset), data, bounds)
    windows = [x[k : k + LENGTH].tobytes() for x in own for k in range(count)]
    seen = collections.Counter(windows)
    assert got.tolist() == [seen[w] > 1 for w in windows]
    assert 0 < got.sum() < sum(taken) < len(windows) // 4
