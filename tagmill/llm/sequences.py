"""Token ids as Arrow files of equal-length sequences.

Documents, by id, are one stream of ids, each ending with an end id. Every task holds one
range of ids and writes two files in Arrow's file format: its stream, cut into batches of
fixed-size lists (`ids`, and `mask`, false for the padding behind the last id), and the
places of its documents. Sequences are read through a memory map, without a copy, by their
number alone. Files are written aside and renamed, so a task that runs again does no harm,
and only one row for each file goes to the driver.

Where the tokenizer cannot merge across white space, each chunk between blanks is encoded
once for a worker and remembered, up to a bound; otherwise whole texts are encoded.

Edge cases: a null or empty text is the end id alone; texts of any length are encoded
whole; null ids come first; rows of one id are ordered by their text, and repeated rows are
written as often as they come; an empty table gives no file and no rows; extra columns
aren't read. Ids take two bytes where the vocabulary allows it, else four.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagmill.llm.common import narrow, scratch

#: Ids of a sequence, and sequences of a batch.
LENGTH, BATCH = 2048, 256
END = 2
#: Chunks that a worker remembers, and bytes of the longest.
REMEMBERED, LONGEST = 1_200_000, 64
#: Fixed value: a tokenizer that splits by this pattern, drops what it doesn't match and folds white space, never merges across blanks.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SIGNS = (b".", b",", b";", b":", b"!", b"?")
#: Words of a to z and the small letters of U+00DF to U+00FF, in UTF-8.
_LATIN = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")
#: The signs that stand for bytes in byte-level vocabularies: those that are visible for themselves, the others from U+0100 on.
_VISIBLE = str.maketrans({b: chr(256 + k) for k, b in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174))})
#: A-Z as lower case, which the tokenizer does anyway, and line ends as blanks.
_SMALL = bytes(k + 32 if 65 <= k <= 90 else 32 if k == 10 else k for k in range(256))


def default_tokenizer() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


# ---- encoding -------------------------------------------------------------------------


def separable(model: dict) -> bool:
    """Whether chunks between blanks can be encoded one by one."""
    steps = (model.get("normalizer") or {}).get("normalizers", [])
    cuts = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    return steps == known and cuts == [split, bytewise] and model["model"]["type"] == "BPE" and not model.get("truncation") and not model.get("padding")


class Encoder:
    """Texts -> their ids as bytes of the narrowest type."""

    def __init__(self, tokenizer: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = json.loads(tokenizer)
        self.tokenizer = Tokenizer.from_str(tokenizer.decode())
        self.splits = separable(model)
        self.specials = [t["content"].encode() for t in model.get("added_tokens", [])]
        self.kind = np.dtype(id_type(tokenizer))
        self.known: dict[bytes, bytes] = {}

    def plain(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, fresh: list[bytes]) -> None:
        """A word of small Latin letters is itself after normalising and splitting, so the merges alone are asked; a sign behind letters is a token of its own."""
        tokenize, known = self.tokenizer.model.tokenize, self.known
        rest = []
        for c in fresh:
            word = c[:-1] if c[-1:] in _SIGNS else c
            if word.isalpha() or _LATIN.fullmatch(word):  # isalpha of bytes: ASCII letters
                ids = [t.id for t in tokenize(word.decode("latin-1").translate(_VISIBLE))]
                if len(word) < len(c):
                    ids += [t.id for t in tokenize(c[-1:].decode())]
                known[c] = np.array(ids, self.kind).tobytes()
            else:
                rest.append(c)
        known.update(zip(rest, self.plain(rest), strict=True))

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        whole = [not self.splits or any(s in t for s in self.specials) for t in texts]
        rows = [[t] if w else t.translate(_SMALL).split(b" ") for t, w in zip(texts, whole, strict=True)]
        wanted = {c for row, w in zip(rows, whole, strict=True) if not w for c in row}
        fresh = [c for c in wanted if c not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {c: self.known[c] for c in wanted if c in self.known}
        self._learn(fresh)
        known = self.known
        out = [self.plain(row)[0] if w else b"".join([known[c] for c in row]) for row, w in zip(rows, whole, strict=True)]
        for c in fresh:
            if len(c) > LONGEST:
                del known[c]
        return out


_encoders: dict[bytes, Encoder] = {}


def _encoder(tokenizer: bytes) -> Encoder:
    """One for a worker, with what it remembers."""
    key = hashlib.sha256(tokenizer).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer)
    return _encoders[key]


def id_type(tokenizer: bytes) -> str:
    return "<u2" if Tokenizer.from_str(tokenizer.decode()).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


# ---- files ----------------------------------------------------------------------------


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


def _batch(ids: np.ndarray, length: int) -> pa.RecordBatch:
    """All of ids, the last sequence padded with zeros that the mask leaves out."""
    n = -(-len(ids) // length) * length
    padded = np.zeros(n, ids.dtype)
    padded[: len(ids)] = ids
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(padded), length), pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n) < len(ids)), length)]
    return pa.RecordBatch.from_arrays(columns, schema=_schema(ids.dtype, length))


def _write(folder: str, tokenizer: bytes, end: int, length: int):
    """Documents in order -> the files of this task: part, file, documents and ids in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        name, aside = f"{folder}/{part:08d}", f"{folder}/.{uuid.uuid4().hex}"
        last = np.array([end], encoder.kind).tobytes()
        held, size, total, count = [], 0, 0, 0
        per = BATCH * length * encoder.kind.itemsize
        ids_file = docs_file = None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                coded = [x + last for x in encoder.encoded([t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()])]
                lengths = np.array([len(x) for x in coded], np.int64) // encoder.kind.itemsize
                places = total + np.cumsum(lengths) - lengths
                index = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(places), pa.array(lengths)], names=["doc_id", "start", "n_tokens"])
                if ids_file is None:
                    ids_file = pa.ipc.new_file(f"{aside}.ids", _schema(encoder.kind, length))
                    docs_file = pa.ipc.new_file(f"{aside}.docs", index.schema)
                docs_file.write_batch(index)
                total, count = total + int(lengths.sum()), count + len(coded)
                held += coded
                size += sum(map(len, coded))
                if size >= per:
                    stream = b"".join(held)
                    full = len(stream) // per * per
                    for k in range(0, full, per):
                        ids_file.write_batch(_batch(np.frombuffer(stream[k : k + per], encoder.kind), length))
                    held, size = [stream[full:]], len(stream) - full
        if ids_file is None:
            return
        if size:
            ids_file.write_batch(_batch(np.frombuffer(b"".join(held), encoder.kind), length))
        for f, suffix in ((ids_file, "ids"), (docs_file, "docs")):
            f.close()
            os.replace(f"{aside}.{suffix}", f"{name}.{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([count], pa.int64()), pa.array([total], pa.int64())], names=["part", "file", "documents", "ids"])

    return run


@dataclass(frozen=True)
class Written:
    """The files in order, and for each the ids before it and the sequences before it, with the totals at the end."""

    files: list[str]
    ids_before: list[int]
    sequences_before: list[int]
    length: int

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of the k-th sequence of all, as views of the mapped file."""
        if not 0 <= k < self.sequences_before[-1]:
            raise IndexError(k)
        part = bisect.bisect_right(self.sequences_before, k) - 1
        return SequenceFile(f"{self.files[part]}.ids")[k - self.sequences_before[part]]


class SequenceFile:
    """One file of sequences, mapped."""

    def __init__(self, path: str) -> None:
        self.reader = pa.ipc.open_file(pa.memory_map(path))
        batches = self.reader.num_record_batches
        self.size = self.reader.get_batch(0).num_rows if batches else 0
        self.rows = self.size * (batches - 1) + self.reader.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.rows

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if not 0 <= k < self.rows:
            raise IndexError(k)
        batch = self.reader.get_batch(k // self.size)
        ids, mask = (batch.column(c).slice(k % self.size, 1).flatten() for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def streams(self) -> Iterator[np.ndarray]:
        """The ids of each batch with its padding, without a copy."""
        for k in range(self.reader.num_record_batches):
            yield self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)


def write_sequences(docs: DataFrame, tokenizer: bytes, folder: str, end: int = END, length: int = LENGTH) -> Written:
    """The documents' ids in files of a folder that all hosts have mounted; ranges of ids, and of texts where one id has many, are dealt to tasks."""
    source = narrow(docs, "doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = source.withColumn("spread", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), "spread"]
    dealt = spread.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    done = sorted(tuple(r) for r in dealt.mapInArrow(_write(folder, tokenizer, end, length), "part int, file string, documents long, ids long").collect())
    ids, sequences = [0], [0]
    for _, _, _, n in done:
        ids.append(ids[-1] + n)
        sequences.append(sequences[-1] + -(-n // length))
    return Written([f for _, f, _, _ in done], ids, sequences, length)


def _read(written: Written):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in [k for b in batches for k in b.column(0).to_pylist()]:
            streams = SequenceFile(f"{written.files[part]}.ids").streams()
            stream, left = memoryview(b""), 0
            index = pa.ipc.open_file(pa.memory_map(f"{written.files[part]}.docs"))
            for k in range(index.num_record_batches):
                rows = index.get_batch(k)
                sums = np.zeros(rows.num_rows, np.int64)
                for i, n in enumerate(rows.column("n_tokens").to_pylist()):
                    crc = 0
                    while n:
                        if not left:
                            stream = memoryview(next(streams).astype("<u4")).cast("B")
                            left = len(stream) // 4
                        at, take = len(stream) // 4 - left, min(n, left)
                        crc = zlib.crc32(stream[4 * at : 4 * (at + take)], crc)
                        n, left = n - take, left - take
                    sums[i] = crc
                start = pa.array(np.asarray(rows.column("start")) + written.ids_before[part])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), start, rows.column("n_tokens"), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(spark: SparkSession, written: Written, kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and the ids' checksum of every document, from the files, a task for each."""
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    if not written.files:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(written.files), 1, len(written.files)).mapInArrow(_read(written), schema)


def _sequences(written: Written, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in [k for b in batches for k in b.column(0).to_pylist()]:
            reader = SequenceFile(f"{written.files[part]}.ids").reader
            at = written.sequences_before[part]
            for k in range(reader.num_record_batches):
                b = reader.get_batch(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), b.column(0).cast(pa.list_(kind)), b.column(1).cast(pa.list_(pa.bool_()))], names=["sequence", "ids", "mask"])
                at += b.num_rows

    return run


def read_sequences(spark: SparkSession, written: Written) -> DataFrame:
    """sequence, ids and mask of all sequences, in order within each file."""
    schema = "sequence long, ids array<int>, mask array<boolean>"
    if not written.files:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(written.files), 1, len(written.files)).mapInArrow(_sequences(written, pa.int32()), schema)


def op12_sequences(docs: DataFrame, tokenizer: bytes) -> DataFrame:
    spark = docs.sparkSession
    written = write_sequences(docs, tokenizer, scratch(spark, "sequences"))
    return read_documents(spark, written, docs.schema["doc_id"].dataType.simpleString())
