"""Language-model scoring with an Elias-Fano n-gram trie.

Two passes count words and then runs of three. A task sums what it reads, deals sorted
runs of (key, count) out to parts as single binary rows, and each part is merged by one
task into a file in the shared folder: words as an Elias-Fano sequence of hashes with one of
running counts; pairs and triples as a trie shard: the pairs' contexts, monotone pointers
and successors relative to their context, then pointers from each pair to the words that
follow it, relative to the pair; each with one byte of quantised probability, and one byte
of back-off weight for each word and pair. A pair's triples lie in its own shard, and the
counts of pairs are sums over their triples. Scoring tasks map the files and search them;
nothing of the model is held by the driver, broadcast or collected.

A triple's probability is discounted, (c(a, b, c) - D) / c(a, b), and what its context has
left goes to the pair's estimate; that is discounted likewise, with the rest to the unigram
estimate, so the model sums to 1 over the words and one unknown. The first word of a text
has the end before it as its whole context. Every pair and triple that was seen counts; with
a `least` above 1, rarer ones give all their mass to the back-off.

Edge cases: a null text is an empty one with the end alone; a null id counts as the empty text where it
picks the part that is held out; repeated rows count and are scored each; without training rows
every token is unknown; extra columns aren't read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import _LETTERS, LOWER, load, mix, narrow, save, scratch, text_parts, word_hashes

_U = np.uint64
END = _U(0x51ED270B7A3C9D15)
DISCOUNT = 0.75
#: Tokens that a task sums before it deals them out, and tokens scored together.
BUFFER, SCORED = 3_000_000, 1_000_000
#: Tokens of the corpus to a shard of pairs and triples: there are as many shards as partitions, or more.
SHARD = 8_000_000
#: Stands for the word after an end; no word has this id.
NONE = _U(0xFFFFFFFF)
_FOLDED = _LETTERS[LOWER]


# ---- Elias-Fano sequences -----------------------------------------------------------


def ef_build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A sequence that never falls, below universe: high parts in unary, low bits packed, the place of every 32nd one."""
    n = len(values)
    low = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> _U(low)).astype(np.int64) + np.arange(n)
    size = (int(high[-1]) if n else 0) + 1
    bits = np.zeros((size + 63) // 64 * 8 + 8, np.uint8)
    for k in range(8):  # bits of a byte are told apart, so places don't meet
        at = high[(high & 7) == k]
        bits[at >> 3] |= np.uint8(1 << k)
    packed = [np.zeros(0, np.uint8)]
    for a in range(0, n if low else 0, 1 << 18):
        part = values[a : a + (1 << 18)]
        each = ((part[:, None] >> np.arange(low, dtype=np.uint64)) & _U(1)).astype(np.uint8)
        packed.append(np.packbits(each.ravel(), bitorder="little"))
    flat = np.concatenate(packed)
    lows = np.zeros((len(flat) + 7) // 8 * 8 + 16, np.uint8)
    lows[: len(flat)] = flat
    return {"head": np.array([n, low], np.int64), "bits": bits.view(np.uint64), "lows": lows.view(np.uint64), "marks": high[::32]}


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], name: str) -> None:
        head, self.bits, self.lows, self.marks = (arrays[f"{name}.{k}"] for k in ("head", "bits", "lows", "marks"))
        self.n, self.low = int(head[0]), int(head[1])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at places of 0..n - 1."""
        start = self.marks[at >> 5]
        word, left = start >> 6, at & 31
        bits = self.bits[word] & (~_U(0) << (start & 63).astype(np.uint64))
        count = np.bitwise_count(bits).astype(np.int64)
        open_ = np.flatnonzero(count <= left)
        while len(open_):
            left[open_] -= count[open_]
            word[open_] += 1
            bits[open_] = self.bits[word[open_]]
            count[open_] = np.bitwise_count(bits[open_])
            open_ = open_[count[open_] <= left[open_]]
        place = np.zeros(len(at), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & _U((1 << width) - 1)).astype(np.int64)
            up = below <= left
            left -= np.where(up, below, 0)
            place += np.where(up, width, 0)
            bits = np.where(up, bits >> _U(width), bits)
        out = ((word << 6) + place - at).astype(np.uint64) << _U(self.low)
        if self.low:
            bit = at * self.low
            k, off = bit >> 6, (bit & 63).astype(np.uint64)
            rest = (self.lows[k] >> off) | ((self.lows[k + 1] << _U(1)) << (_U(63) - off))
            out |= rest & _U((1 << self.low) - 1)
        return out

    def find(self, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray, v_lo: np.ndarray, v_hi: np.ndarray) -> np.ndarray:
        """Places of wanted within lo..hi, where values run from v_lo to below v_hi; -1 if absent. By interpolation, then halves."""
        out = np.full(len(wanted), -1, np.int64)
        lo, hi, v_lo, v_hi = lo.copy(), hi.copy(), v_lo.astype(np.float64), v_hi.astype(np.float64)
        goal = wanted.astype(np.float64)
        live, turn = np.flatnonzero(lo < hi), 0
        while len(live):
            a, b = lo[live], hi[live]
            if turn < 6 or turn % 2:
                part = (goal[live] - v_lo[live]) / np.maximum(v_hi[live] - v_lo[live], 1)
                guess = np.clip(a + (part * (b - a)).astype(np.int64), a, b - 1)
            else:
                guess = (a + b) >> 1
            v = self[guess]
            same, less = v == wanted[live], v < wanted[live]
            out[live[same]] = guess[same]
            up, down = live[less], live[~less & ~same]
            lo[up], v_lo[up] = guess[less] + 1, v[less]
            hi[down], v_hi[down] = guess[~less & ~same], v[~less & ~same]
            live = live[~same & (lo[live] < hi[live])]
            turn += 1
        return out


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each value and the 256 values that the bytes stand for."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    book = np.unique(np.quantile(values, np.linspace(0, 1, 256), method="nearest"))
    code = np.searchsorted((book[1:] + book[:-1]) / 2, values).astype(np.uint8)
    return code, np.resize(book, 256).astype(np.float32)


# ---- counting -----------------------------------------------------------------------


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, an END after each row's, and where the rows begin."""
    words, first = word_hashes(data, bounds, _FOLDED)
    rows = len(bounds) - 1
    out = np.empty(len(words) + rows, np.uint64)
    ends = first[1:] + np.arange(rows)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words, END
    return out, np.concatenate([[0], ends[:-1] + 1])


def planes(values: np.ndarray) -> bytes:
    """Rising 64-bit values as their steps, byte by byte, which packs well."""
    steps = np.diff(values, prepend=_U(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def dealt(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """A row for each part with the keys (rising within it) and counts that belong there."""
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    parts, start = np.unique(part, return_index=True)
    stop = np.append(start[1:], len(part))
    cells = [(planes(keys[a:b]), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([k for k, _ in cells], pa.binary()), pa.array([c for _, c in cells], pa.binary())], names=["part", "keys", "counts"])


DEALT = "part int, keys binary, counts binary"


def word_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(parts)) >> _U(32)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    joined, each = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(joined, kind="stable")
    joined, each = joined[order], each[order]
    start = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))
    return joined[start], np.add.reduceat(each, start)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each part of a task with its keys and summed counts."""
    held: dict[int, tuple[list, list]] = {}
    for b in batches:
        for part, k, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            keys, counts = held.setdefault(part, ([], []))
            keys.append(unplanes(k.as_py()))
            counts.append(np.frombuffer(c.as_py(), np.uint32).astype(np.int64))
    for part in sorted(held):
        yield part, *merged(*held.pop(part))


def _sum_tokens(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    waiting: list[np.ndarray] = []
    size = 0
    for b in batches:
        for data, bounds, _ in text_parts(b.column("text")):
            waiting.append(tokens(data, bounds)[0])
            size += len(waiting[-1])
            if size >= BUFFER:
                yield emit(waiting)
                waiting, size = [], 0
    if waiting:
        yield emit(waiting)


def _count_words(parts: int):
    def emit(waiting: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
        return dealt(keys, counts, word_part(keys, parts))

    return lambda batches: _sum_tokens(batches, emit)


def _build_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in gathered(batches):
            total = np.concatenate([[0], np.cumsum(counts)])
            save(f"{folder}/words-{part}", {**{f"hash.{k}": v for k, v in ef_build(keys, 1 << 64).items()}, **{f"count.{k}": v for k, v in ef_build(total, int(total[-1]) + 1).items()}})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(total[-1])], pa.int64())], names=["part", "words", "tokens"])

    return run


class Words:
    """The words of all parts: ids are ranks by hash."""

    def __init__(self, folder: str, sizes: list[int]) -> None:
        self.folder, self.sizes, self.base = folder, sizes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.open: dict[int, tuple[Sequence, Sequence]] = {}

    def part(self, p: int) -> tuple[Sequence, Sequence]:
        if p not in self.open:
            a = load(f"{self.folder}/words-{p}")
            self.open[p] = Sequence(a, "hash"), Sequence(a, "count")
        return self.open[p]

    def look_up(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of hashes that rise."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        parts = word_part(sorted_hashes, len(self.sizes)).astype(np.int64)
        edges = np.searchsorted(parts, np.arange(len(self.sizes) + 1))
        for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if a < b and self.sizes[p]:
                hashes, sums = self.part(p)
                n, step = b - a, 2.0**64 / len(self.sizes)
                at = hashes.find(sorted_hashes[a:b], np.zeros(n, np.int64), np.full(n, hashes.n), np.full(n, p * step), np.full(n, (p + 1) * step))
                hit = at >= 0
                ids[a:b][hit] = at[hit] + self.base[p]
                counts[a:b][hit] = (sums[at[hit] + 1] - sums[at[hit]]).astype(np.int64)
        return ids, counts


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, rising, and each one's place there in four bytes."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(values), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return ordered[new], place


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = high.astype(np.uint64)
    out <<= _U(32)
    out |= low
    return out


GRAMS = "part int, pairs binary, fans binary, thirds binary, counts binary"


def dealt_grams(pairs: np.ndarray, grams: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rising pairs, and rising grams (rank of the pair << 32 | third word) with counts -> a row for each shard."""
    shard = pair_shard(pairs, shards).astype(np.int64)
    rank = (grams >> _U(32)).astype(np.int64)
    fans = np.bincount(rank, minlength=len(pairs)).astype(np.uint32)
    by_pair, by_gram = np.argsort(shard, kind="stable"), np.argsort(shard[rank], kind="stable")
    pairs, fans, own = pairs[by_pair], fans[by_pair], shard[by_pair]
    thirds, counts = (grams[by_gram] & NONE).astype(np.uint32), counts[by_gram].astype(np.uint32)
    parts, start = np.unique(own, return_index=True)
    edge = np.concatenate([[0], np.cumsum(fans, dtype=np.int64)])
    rows: list[list[bytes]] = [[], [], [], []]
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(pairs)], strict=True):
        g = slice(int(edge[a]), int(edge[b]))
        for x, v in zip(rows, (planes(pairs[a:b]), fans[a:b].tobytes(), thirds[g].view(np.uint8).reshape(-1, 4).T.tobytes(), counts[g].tobytes()), strict=True):
            x.append(v)
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *[pa.array(x, pa.binary()) for x in rows]], names=["part", "pairs", "fans", "thirds", "counts"])


def gathered_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each shard of a task with its rising pairs, and the rank of the pair, third word and summed count of each gram."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for b in batches:
        for row in zip(*(b.column(k) for k in range(5)), strict=True):
            part, pairs, fans, thirds, counts = (x.as_py() for x in row)
            third = np.ascontiguousarray(np.frombuffer(thirds, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            for x, v in zip(held.setdefault(part, [[], [], [], []]), (unplanes(pairs), np.frombuffer(fans, np.uint32), third, np.frombuffer(counts, np.uint32)), strict=True):
                x.append(v)
    for part in sorted(held):
        runs, fans, thirds, counts = (np.concatenate(x) for x in held.pop(part))
        pairs, rank = np.unique(runs, return_inverse=True)
        grams, sums = merged([(np.repeat(rank.astype(np.uint64), fans) << _U(32)) | thirds], [counts.astype(np.int64)])
        yield part, pairs, (grams >> _U(32)).astype(np.int64), grams & NONE, sums


def _count_grams(folder: str, sizes: list[int], shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(folder, sizes)

        def emit(waiting: list[np.ndarray]) -> pa.RecordBatch:
            stream = np.concatenate(waiting)
            waiting.clear()
            own, place = ranked(stream)
            del stream
            ids = words.look_up(own)[0].astype(np.uint32)[place]
            del own, place
            end = ids[-1]  # every row ends with END, so what stands before a row is one too
            pairs, rank = ranked(_joined(np.concatenate([[end], ids[:-1]]), ids))
            grams = _joined(rank, np.where(ids == end, NONE, np.append(ids[1:], NONE).astype(np.uint64)))
            del ids, rank
            grams.sort()
            start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            counts = np.diff(np.append(start, len(grams))).astype(np.uint32)
            grams = grams[start]
            del start
            return dealt_grams(pairs, grams, counts, shards)

        yield from _sum_tokens(batches, emit)

    return run


def pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return mix(keys) % _U(shards)


def _build_grams(folder: str, sizes: list[int], least: int):
    universe = sum(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(folder, sizes)
        for shard, keys, owner, third, each in gathered_grams(batches):
            counts = np.bincount(owner, weights=each, minlength=len(keys)).astype(np.int64)
            keep = counts >= least
            seen = np.flatnonzero((third != NONE) & (each >= least))
            owner, third, each = (np.cumsum(keep) - 1)[owner[seen]], third[seen], each[seen]
            keys, counts = keys[keep], counts[keep]
            first, second = (keys >> _U(32)).astype(np.int64), keys & _U(0xFFFFFFFF)
            contexts, start = np.unique(first, return_index=True)
            rank = np.searchsorted(contexts, first)
            part = np.searchsorted(words.base, contexts, "right") - 1
            total = np.zeros(len(contexts), np.int64)
            for p in np.unique(part).tolist():
                sums, own = words.part(p)[1], np.flatnonzero(part == p)
                at = contexts[own] - words.base[p]
                total[own] = (sums[at + 1] - sums[at]).astype(np.int64)
            share = (counts - DISCOUNT) / total[rank] if len(keys) else np.zeros(0)
            code, book = quantise(np.log10(share))
            pieces = {"context": ef_build(contexts, universe), "pointer": ef_build(np.append(start, len(keys)), len(keys) + 1), "successor": ef_build(rank.astype(np.uint64) * _U(universe) + second, max(1, len(contexts)) * universe)}
            code3, book3 = quantise(np.log10((each - DISCOUNT) / counts[owner]))
            used = np.bincount(owner, weights=10.0 ** book3[code3].astype(np.float64), minlength=len(keys))
            back, backs = quantise(np.log10(np.clip(1 - used, 1e-4, 1)))
            pieces["pointer3"] = ef_build(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(keys)))]), len(owner) + 1)
            pieces["third"] = ef_build(owner.astype(np.uint64) * _U(universe) + third, max(1, len(keys)) * universe)
            save(f"{folder}/pairs-{shard}", {**{f"{n}.{k}": v for n, e in pieces.items() for k, v in e.items()}, "code": code, "book": book, "code3": code3, "book3": book3, "back": back, "backs": backs})
            if len(keys):  # what the table says, so that kept and left sum to 1
                mass = np.add.reduceat(10.0 ** book[code].astype(np.float64), start)
                yield dealt(contexts.astype(np.uint64), np.minimum(np.rint(mass * 2**31), 2**32 - 1), part)

    return run


def _build_left(folder: str, sizes: list[int]):
    """One byte for each word of a part: the share of its context's probability that its pairs leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.concatenate([[0], np.cumsum(sizes)])
        for part, contexts, mass in gathered(batches):
            left = np.ones(sizes[part])
            left[contexts.astype(np.int64) - base[part]] = np.clip(1 - mass / 2**31, 1e-4, 1)
            code, book = quantise(np.log10(left))
            save(f"{folder}/left-{part}", {"code": code, "book": book})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    return run


class Model:
    """folder, parts' sizes, shards, tokens: what a task needs to open the trie."""

    def __init__(self, folder: str, sizes: list[int], shards: list[int], n_shards: int, left: list[int], total: int) -> None:
        self.folder, self.sizes, self.n_shards, self.total = folder, sizes, n_shards, total
        self.has_pairs, self.has_left = frozenset(shards), frozenset(left)

    def opened(self) -> Opened:
        return Opened(self)


class Opened:
    def __init__(self, model: Model) -> None:
        self.m, self.words = model, Words(model.folder, model.sizes)
        self.pairs: dict[int, tuple] = {}
        self.left: dict[int, dict] = {}
        self.universe = sum(model.sizes)
        self.mass = model.total + 0.5 * (self.universe + 1)

    def shard(self, s: int) -> tuple[dict[str, Sequence], dict[str, np.ndarray]]:
        if s not in self.pairs:
            a = load(f"{self.m.folder}/pairs-{s}")
            self.pairs[s] = {n: Sequence(a, n) for n in ("context", "pointer", "successor", "pointer3", "third")}, a
        return self.pairs[s]

    def by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Shards that have a file, with the places, rising, that ask for them."""
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.m.n_shards + 1))
        for s in sorted(self.m.has_pairs):
            if edges[s] < edges[s + 1]:
                yield s, order[edges[s] : edges[s + 1]]

    def find_pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The discounted probabilities of rising pair keys (0 where the trie has none), their shards, and places there or -1."""
        out, place = np.zeros(len(keys)), np.full(len(keys), -1, np.int64)
        shard = pair_shard(keys, self.m.n_shards).astype(np.int64)
        for s, own in self.by_shard(shard):
            level, arrays = self.shard(s)
            contexts, pointers, successors = level["context"], level["pointer"], level["successor"]
            if not contexts.n:
                continue
            first, run = np.unique(keys[own] >> _U(32), return_inverse=True)
            n = len(first)
            rank = contexts.find(first, np.zeros(n, np.int64), np.full(n, contexts.n), np.zeros(n), np.full(n, self.universe))
            low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
            hit = np.flatnonzero(rank >= 0)
            low[hit], high[hit] = pointers[rank[hit]].astype(np.int64), pointers[rank[hit] + 1].astype(np.int64)
            origin = np.maximum(rank, 0).astype(np.uint64) * _U(self.universe)
            at = successors.find(origin[run] + (keys[own] & _U(0xFFFFFFFF)), low[run], high[run], origin[run], origin[run] + _U(self.universe))
            found = at >= 0
            place[own[found]] = at[found]
            out[own[found]] = 10.0 ** arrays["book"][arrays["code"][at[found]]].astype(np.float64)
        return out, shard, place

    def kept(self, keys: np.ndarray) -> np.ndarray:
        """The discounted probabilities of rising pair keys; 0 where the trie has none."""
        return self.find_pairs(keys)[0]

    def find_thirds(self, shard: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words (-1: unknown) after pairs of the trie, alike ones together: discounted probability, 0 where there is none, and what the pair leaves."""
        out, left = np.zeros(len(ids)), np.ones(len(ids))
        for s, own in self.by_shard(shard):
            level, arrays = self.shard(s)
            pair, run = np.unique(place[own], return_inverse=True)
            low, high = level["pointer3"][pair].astype(np.int64), level["pointer3"][pair + 1].astype(np.int64)
            left[own] = (10.0 ** arrays["backs"][arrays["back"][pair]].astype(np.float64))[run]
            asked = np.flatnonzero((ids[own] >= 0) & (high > low)[run])
            run, origin = run[asked], pair.astype(np.uint64) * _U(self.universe)
            at = level["third"].find(origin[run] + ids[own[asked]].astype(np.uint64), low[run], high[run], origin[run], origin[run] + _U(self.universe))
            found = at >= 0
            out[own[asked[found]]] = 10.0 ** arrays["book3"][arrays["code3"][at[found]]].astype(np.float64)
        return out, left

    def left_of(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids))
        part = np.searchsorted(self.words.base, ids, "right") - 1
        for p in np.unique(part[ids >= 0]).tolist():
            if p in self.m.has_left:
                if p not in self.left:
                    self.left[p] = load(f"{self.m.folder}/left-{p}")
                own = np.flatnonzero((part == p) & (ids >= 0))
                out[own] = 10.0 ** self.left[p]["book"][self.left[p]["code"][ids[own] - self.words.base[p]]].astype(np.float64)
        return out

    def scores(self, stream: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each row of a token stream."""
        own, place = np.unique(stream, return_inverse=True)
        ids, counts = self.words.look_up(own)
        single = (counts + 0.5) / self.mass
        end = np.searchsorted(own, END)
        before = np.concatenate([[end], place[:-1]])
        pair, where = np.unique((before.astype(np.uint64) << _U(32)) | place.astype(np.uint64), return_inverse=True)
        a, b = (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.int64)
        known = np.flatnonzero((ids[a] >= 0) & (ids[b] >= 0))
        keys = (ids[a[known]].astype(np.uint64) << _U(32)) | ids[b[known]].astype(np.uint64)
        kept, shard, at = np.zeros(len(pair)), np.zeros(len(pair), np.int64), np.full(len(pair), -1, np.int64)
        kept[known], shard[known], at[known] = self.find_pairs(keys)
        p = (kept + self.left_of(ids)[a] * single[b])[where]
        context = where[:-1]
        sure = np.flatnonzero((before[1:] != end) & (at[context] >= 0))  # a text's first word has no pair before it
        triple, same = np.unique((context[sure].astype(np.uint64) << _U(32)) | place[1:][sure].astype(np.uint64), return_inverse=True)
        c = (triple >> _U(32)).astype(np.int64)
        inner, left = self.find_thirds(shard[c], at[c], ids[(triple & _U(0xFFFFFFFF)).astype(np.int64)])
        p[1:][sure] = inner[same] + left[same] * p[1:][sure]
        return np.diff(np.append(first, len(stream))), np.add.reduceat((counts > 0)[place].astype(np.int64), first), np.add.reduceat(np.log10(single)[place], first), np.add.reduceat(np.log10(p), first)


def train(texts: DataFrame, least: int = 1, parts: int | None = None, shard: int = SHARD) -> Model:
    """The model of a column text, its files in the shared folder. Each part of the words and each shard, of `shard` tokens at most, is merged in a task of its own."""
    spark = texts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "trie")
    source = texts.select("text")
    words = source.mapInArrow(_count_words(parts), DEALT).repartitionById(parts, "part").mapInArrow(_build_words(folder), "part int, words long, tokens long").collect()
    size = {r["part"]: r["words"] for r in words}
    sizes, total = [size.get(p, 0) for p in range(parts)], sum(r["tokens"] for r in words)
    if sum(sizes) >= 2**32:
        raise ValueError("more than 2 ** 32 distinct words")
    shards = max(parts, -(-total // shard))
    pairs = source.mapInArrow(_count_grams(folder, sizes, shards), GRAMS).repartitionById(shards, "part").mapInArrow(_build_grams(folder, sizes, least), DEALT)
    left = pairs.repartitionById(parts, "part").mapInArrow(_build_left(folder, sizes), "part int").collect() if words else []
    have = [int(n.rpartition("-")[2]) for n in os.listdir(folder) if n.startswith("pairs-") and n.count(".") == 0]
    return Model(folder, sizes, have, shards, [r["part"] for r in left], total)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = model.opened()
        for b in batches:
            ids, held = b.column("doc_id"), b.column("held_out")
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            row, size = 0, 0
            for data, bounds, at in text_parts(b.column("text"), 4 << 20):
                waiting.append(tokens(data, bounds))
                size += len(waiting[-1][0])
                done = at + len(bounds) - 1
                if size >= SCORED or done == b.num_rows:
                    shift = np.cumsum([0, *[len(t) for t, _ in waiting[:-1]]])
                    stream, first = np.concatenate([t for t, _ in waiting]), np.concatenate([f + k for (_, f), k in zip(waiting, shift, strict=True)])
                    n, known, base, score = opened.scores(stream, first)
                    rows = len(first)
                    yield pa.RecordBatch.from_arrays([ids.slice(row, rows), held.slice(row, rows), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(rows, model.total)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    waiting, row, size = [], done, 0

    return run


def op10_lm_trie(docs: DataFrame, least: int = 1) -> DataFrame:
    fifth = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    source = narrow(docs, "doc_id", "text").withColumn("held_out", fifth == 1)
    model = train(source.where("not held_out"), least)
    return source.mapInArrow(_scorer(model), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
