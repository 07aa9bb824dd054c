"""Exact top-k inner products by tiles.

The queries are written as blocks, files in the shared folder. A task takes its rows in
shards, maps one block after the other, and makes a matrix product of block and shard,
from which every query's best rows are partly selected; the lists of a task's shards
merge within it, those of the tasks in groups, and those of the groups at last. Rows
aren't shuffled, and a task holds its own rows, one tile and one block's lists.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor
do null ids; rows with the query's own id aren't its candidates; repeated rows are as many
candidates; ties go to the smaller id; vectors of unequal length count as padded with
zeros; products beyond a long are held at its ends; empty tables give no rows; extra
columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import load, save, scratch

SCALE = 64
#: Queries of a block and rows of a shard.
BLOCK, SHARD = 512, 4096
#: Tasks whose lists meet in the first merge.
FAN = 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))


def quantised(lists: pa.Array) -> np.ndarray:
    """floor(64 x) of each component, padded to the widest."""
    lengths = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(lists), int(lengths.max(initial=0))))
    flat = np.floor(SCALE * np.asarray(lists.flatten(), np.float64))
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))), np.pad(b, ((0, 0), (0, width - b.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in doubles while every sum stays below 2 ** 53."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.array([[min(max(x, -(2**63)), 2**63 - 1) for x in row] for row in whole], np.int64).reshape(len(a), len(b))


def best(place: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of candidates of queries (by place) the k best of each: score falling, id rising; in order of place."""
    order = np.lexsort((ids, -scores.astype(np.float64) if scores.dtype.kind == "f" else ~scores, place))
    place, ids, scores = place[order], ids[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.append(starts, len(place))))
    keep = rank < k
    return place[keep], ids[keep], scores[keep]


def tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """place of the query, id and score of the k best rows of each query of a block within a shard."""
    scores = products(*same_width(q, rows))
    own = q_ids[:, None] == ids[None, :]
    scores[own] = np.iinfo(np.int64).min
    most = min(len(ids), k + int(own.sum(1).max(initial=0)))
    least = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most]
    place, at = np.nonzero((scores >= least[:, None]) & ~own)
    return best(place, ids[at], scores[place, at], k)


def _write_blocks(folder: str):
    """Queries -> the names of the files that hold them, BLOCK or less in each; a task that runs again writes others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _taken(batches, BLOCK):
            name = f"{folder}/queries-{uuid.uuid4().hex}"
            q = quantised(table.column("embedding").combine_chunks())
            save(name, {"id": np.asarray(table.column("vec_id")).astype(np.int64), "shape": np.array(q.shape, np.int64), "q": q.ravel()})
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return run


def _taken(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of size rows, the last one smaller."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - rows)
            b = b.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _search(names: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [(np.asarray(t.column("vec_id")).astype(np.int64), quantised(t.column("embedding").combine_chunks())) for t in _taken(batches, SHARD)]
        for name in names if shards else []:
            a = load(name)
            q_ids, q = a["id"], a["q"].reshape(a["shape"])
            found = [tile(q_ids, q, ids, rows, k) for ids, rows in shards]
            place, ids, scores = best(*[np.concatenate(x) for x in zip(*found, strict=True)], k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[place]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def top_products(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query; the lists of a query id that repeats are merged."""
    folder = scratch(rows.sparkSession, "queries")
    one = queries.select("vec_id", "embedding").mapInArrow(_write_blocks(folder), "name string")
    names = sorted(r["name"] for r in one.collect())
    lists = rows.select("vec_id", "embedding").mapInArrow(_search(names, k), "query_id long, vec_id long, score long")
    order: list[Column] = [F.desc("score"), F.asc("vec_id")]
    grouped = lists.withColumn("part", F.floor(F.spark_partition_id() / FAN))
    some = grouped.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(f"n <= {k}")
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(f"rank <= {k}")
    return out.select("query_id", "rank", "vec_id", "score")


def op9_topk(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    rows = usable(vectors)
    return top_products(rows.where(F.col("vec_id") % every == 0), rows, k)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
