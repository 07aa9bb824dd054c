"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece holds a marker after another character, merging never crosses the place
before a run of markers, so a text falls apart there into marked chunks. The corpus's
distinct chunks are gathered (each task sends each of its own once), dealt into parts by
hash, and segmented and decoded once each; a part is written as a sorted file in the
shared folder. Then the texts are read again, and the ids and the decoded text of every
chunk are looked up and joined by position: no position is shuffled. A worker maps the
files and remembers what it looked up, up to a bound, which only saves time. Chunks longer
than LONGEST, which hardly come again, aren't gathered but segmented where they stand.

Edge cases: a null text is an empty one, without ids, and decodes to the empty text; empty
tables give no rows; texts of any length are encoded whole; repeated rows, ties and null
ids give one row each; only doc_id and text are read, so extra columns can't clash. With
a model whose pieces cross markers each text is encoded as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tagmill.llm.common import load, narrow, save, scratch

MARK = "▁"
#: Chunks that a worker remembers, and code points of the longest chunk in the table.
REMEMBERED, LONGEST = 400_000, 256
#: Runs of markers with what follows them; spaces and literal markers mean the same.
_CHUNK = re.compile(r"[ ▁]+[^ ▁]*|[^ ▁]+")
#: Number of ids, the ids in decimal joined by commas, the decoded text.
Entry = tuple[int, str, str]


def chunks_of(text: str) -> list[str]:
    return _CHUNK.findall(" " + text) if text else []


def hashed(chunk: str) -> int:
    return xxhash.xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"))


class Pieces:
    """Encodes and decodes as the library does for a model that keeps white space, adds one marker in front, and has byte fallback."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece as sp
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        unmarked = ModelProto.FromString(model)
        unmarked.normalizer_spec.add_dummy_prefix = False
        self.whole = sp.SentencePieceProcessor(model_proto=model)
        self.parts = sp.SentencePieceProcessor(model_proto=unmarked.SerializeToString())
        self.before = self.whole.encode("x")
        names = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        probe = ["", "a", "  a  b ", f"{MARK}a{MARK}", "a\n\n b\t", "ﬁ é é 　Ａ", "</s> <s>", "\x00 b"]
        self.splits = not any(MARK in x.lstrip(MARK) for x in names) and all(joined(self.segmented(chunks_of(t))) == self.at_once(t) for t in probe)

    def segmented(self, chunks: list[str]) -> list[Entry]:
        """Each chunk's ids, and what they decode to behind another piece."""
        ids = self.parts.encode(chunks, num_threads=1) if chunks else []
        texts = self.whole.decode([self.before + x for x in ids], num_threads=1) if chunks else []
        return [(len(x), ",".join(map(str, x)), t[1:]) for x, t in zip(ids, texts, strict=True)]

    def at_once(self, text: str) -> Entry:
        ids = self.whole.encode(text)
        return len(ids), ",".join(map(str, ids)), self.whole.decode(ids)


def joined(entries: list[Entry]) -> Entry:
    """The entry of a text from those of its chunks in order: decoding takes one marker off the front."""
    text = "".join([t for _, _, t in entries])
    return sum([n for n, _, _ in entries]), ",".join([x for _, x, _ in entries if x]), text[1:] if text.startswith(" ") else text


# ---- the table ----------------------------------------------------------------------


def _strings(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, values)])
    return ends.astype(np.uint32 if ends[-1] < 2**32 else np.int64), np.frombuffer(b"".join(values) or b"\0", np.uint8)


def plain(chunk: str) -> str:
    """What a chunk decodes to as a rule."""
    return chunk.replace(MARK, " ")


def write_part(path: str, chunks: list[str], entries: list[Entry]) -> None:
    """One part as a file, sorted by hash, with the chunks to tell those of one hash apart; decoded texts are kept where they aren't plain."""
    hashes = np.array([hashed(c) for c in chunks], np.uint64)
    order = np.argsort(hashes, kind="stable")
    arrays = {"hash": hashes[order]}
    ids = [[int(x) for x in entries[i][1].split(",")] if entries[i][1] else [] for i in order.tolist()]
    flat = np.array([x for row in ids for x in row], np.int64)
    arrays["ids"] = flat.astype(np.uint16 if flat.max(initial=0) < 2**16 else np.int32)
    ends = np.cumsum([0, *map(len, ids)])
    arrays["ids_at"] = ends.astype(np.uint32 if ends[-1] < 2**32 else np.int64)
    odd = [k for k, i in enumerate(order.tolist()) if entries[i][2] != plain(chunks[i])]
    arrays["odd"] = np.array(odd, np.int64)
    columns = {"chunk": [chunks[i] for i in order.tolist()], "text": [entries[order[k]][2] for k in odd]}
    for name, values in columns.items():
        arrays[f"{name}_at"], arrays[name] = _strings([v.encode("utf-8", "surrogatepass") for v in values])
    save(path, arrays)


class Table:
    """The parts of the table, mapped when first asked for."""

    def __init__(self, folder: str, parts: int, have: frozenset[int]) -> None:
        self.folder, self.parts, self.have = folder, parts, have
        self.open: dict[int, Part] = {}

    def look_up(self, chunks: list[str]) -> dict[str, Entry]:
        """The entries of those chunks that the table holds."""
        out: dict[str, Entry] = {}
        hashes = np.array([hashed(c) for c in chunks], np.uint64)
        part = (hashes % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.unique(part).tolist():
            if p in self.have:
                if p not in self.open:
                    self.open[p] = Part(load(f"{self.folder}/chunks-{p}"))
                own = order[edges[p] : edges[p + 1]]
                self.open[p].look_up([chunks[i] for i in own.tolist()], hashes[own], out)
        return out


class Part:
    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.hash, self.chunk_at, self.ids_at, self.ids = (arrays[k] for k in ("hash", "chunk_at", "ids_at", "ids"))
        self.chunk = memoryview(arrays["chunk"])
        ends = arrays["text_at"].tolist()
        self.odd = {k: arrays["text"][a:b].tobytes().decode("utf-8", "surrogatepass") for k, a, b in zip(arrays["odd"].tolist(), ends[:-1], ends[1:], strict=True)}

    def look_up(self, chunks: list[str], hashes: np.ndarray, out: dict[str, Entry]) -> None:
        first = np.searchsorted(self.hash, hashes)
        some = np.flatnonzero((first < len(self.hash)) & (self.hash[np.minimum(first, len(self.hash) - 1)] == hashes))
        at = first[some]
        cells = [x.tolist() for x in (some, at, self.chunk_at[at], self.chunk_at[at + 1], self.ids_at[at], self.ids_at[at + 1])]
        for i, k, a, b, c, d in zip(*cells, strict=True):
            chunk = chunks[i]
            own = chunk.encode("utf-8", "surrogatepass")
            while self.chunk[a:b] != own:  # another chunk of that hash
                k += 1
                if k == len(self.hash) or self.hash[k] != hashes[i]:
                    break
                a, b, c, d = (int(x) for x in (self.chunk_at[k], self.chunk_at[k + 1], self.ids_at[k], self.ids_at[k + 1]))
            else:
                ids = self.ids[c:d].tolist()
                out[chunk] = len(ids), ",".join(map(str, ids)), self.odd[k] if k in self.odd else plain(chunk)


def _gather(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                fresh: set[str] = set()
                for text in b.column("text").slice(at, 256).to_pylist():
                    fresh.update(chunks_of(text))
                new = [c for c in fresh if c not in seen and len(c) <= LONGEST]
                if len(seen) + len(new) > REMEMBERED:
                    seen.clear()
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array([hashed(c) % parts for c in new], pa.int32()), pa.array(new, pa.string())], names=["part", "chunk"])

    return run


def _segment(model: bytes, folder: str):
    """Distinct chunks sorted by part -> the parts that were written, a file for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(model)
        part, held = -1, []

        def flush() -> None:
            entries = [e for i in range(0, len(held), 10_000) for e in pieces.segmented(held[i : i + 10_000])]
            write_part(f"{folder}/chunks-{part}", held, entries)

        for b in batches:
            for p, c in zip(b.column("part").to_pylist(), b.column("chunk").to_pylist(), strict=True):
                if p != part:
                    if held:
                        flush()
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])
                    part, held = p, []
                held.append(c)
        if held:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    return run


def build(source: DataFrame, model: bytes, parts: int | None = None) -> Table:
    """The table of all chunks of a column text, its parts in the shared folder."""
    spark = source.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "chunks")
    rows = source.select("text").mapInArrow(_gather(parts), "part int, chunk string").repartition(parts, "part").distinct()
    have = rows.sortWithinPartitions("part").mapInArrow(_segment(model, folder), "part int").collect()
    return Table(folder, parts, frozenset(r["part"] for r in have))


# ---- texts --------------------------------------------------------------------------

_loaded: dict[bytes, Pieces] = {}


def _load(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


class Joiner:
    """Entries of texts by the table; what was looked up is remembered, up to a bound."""

    def __init__(self, pieces: Pieces, table: Table) -> None:
        self.pieces, self.table = pieces, table
        self.known: dict[str, Entry] = {}

    def entries(self, texts: list[str]) -> list[Entry]:
        if not self.pieces.splits:
            return [self.pieces.at_once(t) for t in texts]
        rows = [chunks_of(t) for t in texts]
        known = self.known
        wanted = {c for row in rows for c in row}
        fresh = [c for c in wanted if c not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known = self.known = {c: known[c] for c in wanted if c in known}
        known.update(self.table.look_up([c for c in fresh if len(c) <= LONGEST]))
        long = [c for c in fresh if c not in known]
        known.update(zip(long, self.pieces.segmented(long), strict=True))
        out = [joined([known[c] for c in row]) for row in rows]
        for c in long:
            del known[c]
        return out


def _runner(model: bytes, table: Table, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(_load(model), table)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                coded = joiner.entries([t or "" for t in part.column("text").to_pylist()])
                if keep_text:
                    own = {"ids": pa.array([list(map(int, x.split(","))) if x else [] for _, x, _ in coded], pa.list_(pa.int32())), "decoded": pa.array([t for _, _, t in coded], pa.string())}
                else:
                    sha = lambda values: pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())
                    own = {"n_tokens": pa.array([n for n, _, _ in coded], pa.int64()), "ids_sha256": sha([x for _, x, _ in coded]), "decoded_sha256": sha([t for _, _, t in coded])}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *own.values()], names=["doc_id", *own])

    return run


def model_bytes(path: str | None = None) -> bytes:
    """The model, a few hundred kB, read on the driver and sent along with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids and the decoded text."""
    source = narrow(docs, "doc_id", "text")
    return source.mapInArrow(_runner(model, build(source, model), True), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def op4_pieces(docs: DataFrame, model: bytes) -> DataFrame:
    source = narrow(docs, "doc_id", "text")
    return source.mapInArrow(_runner(model, build(source, model), False), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
