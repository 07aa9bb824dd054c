"""Removal of repeated byte strings by a hash-compared suffix sort.

Every window of LENGTH bytes picks its least gram, so equal windows pick equal grams at
equal offsets, and windows that share one travel together as a block. Only blocks whose
gram occurs again go on. Blocks of one gram and one polynomial hash of all their bytes and
shape are copies if a second digest of those (BLAKE2, 64 bits) confirms it, and repeat as a
whole; blocks that the digest tells apart count as different. Of blocks that differ under a gram
one of each is brought to where its gram is, and there the windows are sorted as
suffixes, but for those whose first and last eight bytes no other has that holds the gram
at the same offset, since they can't repeat: prefix polynomial hashes and binary search give the common extension of two, a
merge sort orders them with it, and neighbours that share LENGTH bytes repeat, which their
bytes must confirm. Texts never meet as a whole; a task holds the different blocks of one
gram (some 400 bytes each) at least.

Edge cases: a null text is an empty one; texts shorter than LENGTH keep all; repeated rows
are repeats of each other; null ids and rows that share an id are told apart by a 64-bit
hash of their text; texts of any length are read whole, in overlapping pieces; empty tables
give no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import CHUNK, mix, narrow, powers, prefix_hashes, span_hashes, text_parts
from tagmill.operators.tree import written

_U = np.uint64
LENGTH, GRAM = 200, 16
#: Grams of a window.
WIDE = LENGTH - GRAM + 1
#: Bytes of blocks that are sorted together; a larger group under one gram is sorted whole.
TOGETHER = 1 << 20
_INVERSE = pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)


def blocks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram hash, block hash, first window, windows, offset of the gram in the first window; windows are within rows."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    words = data.astype(np.uint64)
    for k in (1, 2, 4):
        words = words[:-k] | (words[k:] << _U(8 * k))
    grams = mix(words[:-8] * _U(0xC2B2AE3D27D4EB4F) ^ mix(words[8:]))
    least = (grams & ~_U((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)  # leftmost among equals
    width = 1
    while 2 * width <= WIDE:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (WIDE - width)], least[WIDE - width :])
    at = (least & _U((1 << 24) - 1)).astype(np.int64)
    turns = np.zeros(n + 1, np.int8)
    long_rows = np.flatnonzero(np.diff(bounds) >= LENGTH)
    turns[bounds[long_rows]] += 1
    np.add.at(turns, bounds[long_rows + 1] - LENGTH + 1, -1)
    valid = np.cumsum(turns[: len(at)], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    start, end = np.flatnonzero(new), np.flatnonzero(last)
    offset = at[start] - start
    whole = span_hashes(prefix_hashes(data), start, end + LENGTH)
    return grams[at[start]], mix(whole + offset.astype(np.uint64) * _U(0x9FB21C651E98DF25)), start, end - start + 1, offset


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, row bounds, first row, offset in that row); a row of many MB comes in pieces that share LENGTH - 1 bytes."""
    for data, bounds, row in text_parts(column):
        if len(data) <= 4 * CHUNK:
            yield data, bounds, row, 0
        else:
            for a in range(0, len(data) - LENGTH + 1, CHUNK):
                part = data[a : a + CHUNK + LENGTH - 1]
                yield part, np.array([0, len(part)]), row, a


#: first window << 16 | windows << 8 | offset of the gram.
BLOCK = "gram long, block long, doc_id {}, tag long, place long, proof long"


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """64-bit BLAKE2 digests of the byte strings start:end, keyed by offset."""
    view, keys = memoryview(data), [bytes([k]) for k in range(WIDE)]
    own = [hashlib.blake2b(view[a:b], digest_size=8, key=keys[k]).digest() for a, b, k in zip(start.tolist(), end.tolist(), offset.tolist(), strict=True)]
    return np.frombuffer(b"".join(own), np.int64)


def _cut_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, bounds, _, _ in pieces(b.column("text")):
            gram, block, *_ = blocks(data, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(block.view(np.int64))], names=["gram", "block"])


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, bounds, row, shift in pieces(b.column("text")):
            gram, block, start, count, offset = blocks(data, bounds)
            own = np.searchsorted(bounds, start, "right") - 1
            take = pa.array(own + row)
            place = ((start - bounds[own] + shift) << 16) | (count << 8) | offset
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(block.view(np.int64)), b.column("doc_id").take(take), b.column("tag").take(take), pa.array(place), pa.array(digests(data, start, start + count - 1 + LENGTH, offset))], names=["gram", "block", "doc_id", "tag", "place", "proof"])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts or byte strings, none of them null, and the bounds of its rows within them."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _listed(column: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The structs in the lists of a column, a null one being empty, and the row of each."""
    return column.flatten(), np.repeat(np.arange(len(column)), np.asarray(pc.fill_null(pc.list_value_length(column), 0)))


def _bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text with the blocks wanted of it -> the blocks with their bytes."""
    for b in batches:
        data, bounds = _texts(b.column("text"))
        wanted, row = _listed(b.column("wanted"))
        place = np.asarray(wanted.field("place"))
        start, size = bounds[row] + (place >> 16), ((place >> 8) & 255) - 1 + LENGTH
        stop = np.cumsum(size)
        view = memoryview(data)
        a = 0
        while a < len(stop):
            z = max(a + 1, int(np.searchsorted(stop, stop[a] - size[a] + 4 * CHUNK, "right")))
            own = b"".join([view[f : f + k] for f, k in zip(start[a:z].tolist(), size[a:z].tolist(), strict=True)])
            offsets = np.concatenate([[0], stop[a:z] - (stop[a] - size[a])]).astype(np.int32)
            columns = [wanted.field(c).slice(a, z - a) for c in ("gram", "block", "proof", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place[a:z] & 0xFFFF), pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets), pa.py_buffer(own)])], names=["gram", "block", "proof", "n", "shape", "bytes"])
            a = z


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number; a view."""
    return np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,))


class Suffixes:
    """Comparison of the LENGTH bytes from places of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.sums = data, prefix_hashes(data)
        self.inverse = powers(_INVERSE, len(self.sums))
        self.words = eights(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes from x and y agree, LENGTH at most: halves by prefix hashes, where not all agree."""
        far = np.full(len(x), LENGTH)
        sx, sy, ix, iy = self.sums[x], self.sums[y], self.inverse[x], self.inverse[y]
        part = np.flatnonzero((self.sums[x + LENGTH] - sx) * ix != (self.sums[y + LENGTH] - sy) * iy)
        x, y, sx, sy, ix, iy = (v[part] for v in (x, y, sx, sy, ix, iy))
        lo, hi = np.zeros(len(part), np.int64), np.full(len(part), LENGTH - 1)
        for _ in range((LENGTH - 1).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.sums[x + mid] - sx) * ix == (self.sums[y + mid] - sy) * iy
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        far[part] = lo
        return far

    def below(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether x comes before y, and where they are equal, ties."""
        far = self.extension(x, y)
        end = np.minimum(far, LENGTH - 1)
        return np.where(far < LENGTH, self.data[x + end] < self.data[y + end], ties)

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for a in range(0, len(x), 1 << 14):
            steps = np.arange(0, LENGTH, 8)
            part = slice(a, a + (1 << 14))
            out[part] = (self.words[x[part, None] + steps] == self.words[y[part, None] + steps]).all(1)
        return out

    def sort(self, places: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Places in suffix order within their segments, which are runs: merges runs of 1, 2, 4 .. by binary search."""
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, len(places)))
        begin, inner = np.repeat(first, size), np.arange(len(places)) - np.repeat(first, size)
        total = np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            run = inner // width
            sibling = (run ^ 1) * width
            moving = np.flatnonzero((total > width) & (sibling < total))
            b, own = begin[moving], places[moving]
            lo = b + sibling[moving]
            hi = b + np.minimum(sibling[moving] + width, total[moving])
            base = lo.copy()
            right = (run[moving] & 1).astype(bool)
            live = np.arange(len(moving))
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                # on the right of the merge equals of the left count as before
                before = self.below(places[mid], own[live], right[live])
                lo[live[before]] = mid[before] + 1
                hi[live[~before]] = mid[~before]
                live = live[lo[live] < hi[live]]
            pair = b + (run[moving] >> 1) * 2 * width
            target = pair + (inner[moving] - run[moving] * width) + (lo - base)
            places = places.copy()
            places[target] = own
            width *= 2
        return places


def repeated_windows(gram: np.ndarray, copies: np.ndarray, shape: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For the windows of all blocks in order, whether another block's window (or a copy of the block) has the same bytes."""
    count, offset = shape >> 8, shape & 255
    total = int(count.sum())
    block = np.repeat(np.arange(len(count)), count)
    step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    place = bounds[:-1][block] + step
    found = copies[block] > 1
    # equal windows have one gram at one offset, and the same eight bytes at both ends; who has them alone isn't
    # sorted. A hash of all that which two share by chance makes a larger segment and nothing else
    suffixes = Suffixes(data)
    key = (np.unique(gram, return_inverse=True)[1][block] * 256 + offset[block] - step).astype(np.uint64)
    key = mix(mix(mix(key) ^ suffixes.words[place]) ^ suffixes.words[place + LENGTH - 8])
    order = np.argsort(key)
    key = key[order]
    alone = np.ones(total, bool)
    alone[1:] &= key[1:] != key[:-1]
    alone[:-1] &= key[1:] != key[:-1]
    order, key = order[~alone], key[~alone]
    if not len(order):
        return found
    ranked = suffixes.sort(place[order], key)
    window_at = np.full(len(data), -1, np.int64)
    window_at[place] = np.arange(total)
    near = np.flatnonzero(key[1:] == key[:-1])
    near = near[suffixes.extension(ranked[near], ranked[near + 1]) >= LENGTH]
    sure = suffixes.equal_bytes(ranked[near], ranked[near + 1])
    found[window_at[ranked[near[sure]]]] = True
    found[window_at[ranked[near[sure] + 1]]] = True
    for k in np.unique(key[near[~sure]]).tolist():  # hashes that met by chance: tell by bytes
        seen: dict[bytes, int] = {}
        for p in ranked[key == k].tolist():
            text = data[p : p + LENGTH].tobytes()
            if text in seen:
                found[window_at[[p, seen[text]]]] = True
            seen.setdefault(text, p)
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by gram -> block, and a bit for each of its windows that repeats."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        own = [np.asarray(table[c]) for c in ("gram", "block", "proof")]
        first = np.unique(np.stack(own), axis=1, return_index=True)[1]  # a row that is repeated brings a block twice
        first.sort()
        table = table.take(pa.array(first))
        own = table["bytes"].combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        own = own.cast(pa.large_binary())
        bounds = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
        data = np.frombuffer(own.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        shape = np.asarray(table["shape"])
        flags = repeated_windows(np.asarray(table["gram"]), np.asarray(table["n"]), shape, data, bounds - bounds[0])
        stop = np.cumsum(shape >> 8)
        bits = [np.packbits(flags[b - c : b]).tobytes() for b, c in zip(stop.tolist(), (shape >> 8).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*[table[c].combine_chunks() for c in ("gram", "block", "proof")], pa.array(bits, pa.binary())], names=["gram", "block", "proof", "bits"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        while b.num_rows:
            # up to the last change of gram, once there is enough
            held.append(b.slice(0, 512))
            b = b.slice(512)
            size += held[-1].column("bytes").nbytes
            if size >= TOGETHER:
                table = pa.Table.from_batches(held)
                gram = np.asarray(table["gram"])
                whole = int(np.searchsorted(-(gram != gram[-1]).astype(np.int8), 0))
                if whole:
                    yield flush(table.slice(0, whole))
                    table = table.slice(whole)
                held, size = table.to_batches(), table.nbytes if whole else 0
    if sum(b.num_rows for b in held):
        yield flush(pa.Table.from_batches(held))


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, texts of about CHUNK bytes at a time."""
    for _, bounds, row in text_parts(batch.column("text")):
        yield batch.slice(row, len(bounds) - 1)


def _windows(found: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of blocks that repeat, as first bytes within their row, and which block each is of."""
    place, bits = np.asarray(found.field("place")), found.field("bits")
    first, count = place >> 16, (place >> 8) & 255
    packed, bounds = _texts(pc.fill_null(bits, b""))
    block = np.repeat(np.arange(len(place)), count)
    step = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    hit = np.asarray(bits.is_null())[block]
    told = np.flatnonzero(~hit)
    hit[told] = np.unpackbits(packed)[8 * bounds[block[told]] + step[told]]
    return (first[block] + step)[hit], block[hit]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in _portions(whole):
            data, bounds = _texts(b.column("text"))
            found, row = _listed(b.column("found"))
            begins = np.zeros(len(data), bool)
            for a in range(0, len(found), 1 << 12):
                first, block = _windows(found.slice(a, 1 << 12))
                begins[first + bounds[row[a : a + (1 << 12)]][block]] = True
            at = np.flatnonzero(begins)
            own = np.searchsorted(bounds, at, "right") - 1
            # a removed run ends where no window begins within LENGTH, or with its text
            opens = np.flatnonzero(np.concatenate([[True], (np.diff(at) > LENGTH) | (own[1:] != own[:-1])])) if len(at) else at
            a, z = at[opens], at[np.append(opens[1:], len(at)) - 1] + LENGTH if len(at) else at
            spans = np.bincount(own[opens], minlength=len(b))
            gone = np.zeros(len(b), np.int64)
            np.add.at(gone, own[opens], z - a)
            view, last = memoryview(data), np.searchsorted(own[opens], np.arange(len(b) + 1))
            a, z, kept = a.tolist(), z.tolist(), []
            for begin, end, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), last[:-1].tolist(), last[1:].tolist(), strict=True):
                digest = hashlib.sha256()
                for k in range(i, j):
                    digest.update(view[begin : a[k]])
                    begin = z[k]
                digest.update(view[begin:end])
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in (np.diff(bounds), gone, spans)], pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])


def repeats(texts: DataFrame, bits: int = 64) -> DataFrame:
    """texts (doc_id, tag, text) -> doc_id, tag, found: the windows that occur elsewhere, as blocks with bits (null: all).

    bits of the polynomial hash tell blocks apart; with fewer the digests and the sort have more to do.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    block = F.col("block") if bits == 64 else F.col("block").bitwiseAND((1 << bits) - 1)
    hashes = texts.select("text").mapInArrow(_cut_hashes, "gram long, block long").withColumn("block", block)
    cut_up = texts.mapInArrow(_cut_blocks, BLOCK.format(kind)).withColumn("block", block)
    # each step is written as a compressed table, after which its shuffles are gone; and so the
    # join shuffles both sides itself and a hot gram can be split
    cut = lambda frame: written(frame)[0]
    again = cut(hashes.groupBy("gram").agg(F.count("*").alias("k"), F.min("block").alias("lo"), F.max("block").alias("hi")).where("k > 1").select("gram", (F.col("lo") == F.col("hi")).alias("alike")))
    some = cut(cut_up.join(again, "gram"))
    # grams with one hash whose digests differ: their blocks go the way of different ones
    clash = cut(some.where("alike").groupBy("gram").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo <> hi").select("gram"))
    if not clash.isEmpty():
        some = cut(some.join(clash.withColumn("clash", F.lit(True)), "gram", "left").withColumn("alike", F.col("alike") & F.col("clash").isNull()).drop("clash"))
    key = ["gram", "block", "proof"]
    mixed = some.where("not alike")
    one = mixed.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "place")).alias("at"))
    wanted = one.select("at.doc_id", "at.tag", F.struct(*key, "n", "at.place").alias("w")).groupBy("doc_id", "tag").agg(F.collect_list("w").alias("wanted"))
    bodies = texts.join(wanted, _same(texts, wanted)).select("text", "wanted").mapInArrow(_bring, "gram long, block long, proof long, n long, shape long, bytes binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = cut(bodies.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_compare, "gram long, block long, proof long, bits binary"))
    found = mixed.join(told, key).select("doc_id", "tag", "place", "bits").union(some.where("alike").select("doc_id", "tag", "place", F.lit(None).cast("binary").alias("bits")))
    return found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "bits")).alias("found"))


def op6_suffix_dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    texts = narrow(docs, "doc_id", "text").withColumn("tag", F.xxhash64("text"))
    found = repeats(texts, bits)
    rows = texts.join(found, _same(texts, found), "left").select(texts["doc_id"], "text", "found")
    return rows.mapInArrow(_remove, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
