"""What the text operators share: tables, checkpoints, vectorised word hashes, components."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
GAP = r"[\x20\x09-\x0D]+"
#: Bytes that the kernels look at together; their arrays take about 100 bytes for each.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns of docs, text never null; others, whatever their names, stay out of the plan."""
    return docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) if c in ("text", "html") else docs[c] for c in columns])


def cut(frame: DataFrame) -> DataFrame:
    """frame, computed and written to the shared checkpoint folder; it survives the loss of executors."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or f"{frame.sparkSession.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return frame.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that all executors see."""
    cut(spark.range(0))
    return spark.sparkContext.getCheckpointDir()


# ---- files that tasks map ------------------------------------------------------------


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes aside and renames, so that a task that runs again or twice does no harm."""
    index, at = {}, 0
    for k, v in arrays.items():
        index[k] = (v.dtype.str, at, len(v))
        at += (v.nbytes + 63) // 64 * 64
    head = json.dumps(index).encode()
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + bytes(-(8 + len(head)) % 64))
        for v in arrays.values():
            f.write(v.tobytes() + bytes(-v.nbytes % 64))
    os.replace(aside, path)


def load(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    n = int(whole[:8].view(np.int64)[0])
    start = (8 + n + 63) // 64 * 64
    return {k: np.asarray(whole[start + at : start + at + size * np.dtype(kind).itemsize]).view(kind) for k, (kind, at, size) in json.loads(whole[8 : 8 + n].tobytes()).items()}


def local_path(uri: str) -> str:
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"files are memory-mapped, so {uri} must be a shared folder that is mounted on all hosts")
    return u.path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all hosts have mounted, for files that tasks write and map; it goes when the driver ends."""
    folder = f"{local_path(shared_folder(spark))}/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


# ---- components ----------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, comp), comp the least node of its component.

    First every node keeps the edge to its least neighbour below it, and its other such
    neighbours take an edge to that one; hubs in common then leave a few edges where
    there was one for each node and hub. Each round takes the least label of the neighbours and then the label of the
    label, so paths halve; every step is a join or an aggregate with partial sums,
    and hot nodes only meet in partial minima or joins that adaptive execution splits.
    """
    down = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    edges = least.select("a", F.col("m").alias("b")).union(down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        labels = cut(step.join(up, "comp").select("node", F.least("comp", "top").alias("comp"), (F.least("comp", "top") != F.col("was")).alias("moved")))
    return labels.select("node", "comp")


# ---- vectorised hashing -------------------------------------------------------------

_U = np.uint64
_LETTERS = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1024), base % 2**64, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all; one to one."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_hashes(data: np.ndarray, table: np.ndarray = _LETTERS) -> np.ndarray:
    """Sums of table[byte] * base ** place before each place, n + 1 of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings start:end, alike wherever they stand."""
    inverse = powers(pow(_BASE, -1, 2**64), len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


def text_parts(column: pa.Array, limit: int = CHUNK):
    """(bytes, row bounds within them, first row) of the texts of a batch, about limit bytes at a time."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row], row
        row = last


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses a bound between rows."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _IS_GAP[data]
    begins = ~gap[:-1]
    begins[1:] &= gap[:-2]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    begins[inner] = ~gap[inner]
    ends = ~gap[:-1] & gap[1:]
    cuts = bounds[1:][bounds[1:] > 0] - 1
    ends[cuts] = ~gap[cuts]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = _LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each row's words begin (rows + 1 places).

    A row of many MB is taken in pieces that end at a gap, so memory follows CHUNK and
    the longest word.
    """
    if len(bounds) == 2 and len(data) > 4 * CHUNK:
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            while end < len(data) and not _IS_GAP[data[end - 1]]:
                more = _IS_GAP[data[end : end + CHUNK]]
                end = end + int(more.argmax()) + 1 if more.any() else min(len(data), end + CHUNK)
            out.append(word_hashes(data[at:end], np.array([0, end - at]), table)[0])
            at = end
        joined = np.concatenate(out)
        return joined, np.array([0, len(joined)])
    start, end = word_spans(data, bounds)
    return mix(span_hashes(prefix_hashes(data, table), start, end) + _U(0x632BE59BD9B4E019)), np.searchsorted(start, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of size words; of all its words if it has fewer, none without words."""
    words, first = word_hashes(data, bounds)
    runs = words
    if len(words) >= size:
        n = len(words) - size + 1
        runs = np.zeros(n, np.uint64)
        for k in range(size):
            runs = mix(runs * _U(0xD6E8FEB86659FD93) + words[k : k + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = mix(h * _U(0xD6E8FEB86659FD93) + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
