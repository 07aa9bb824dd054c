"""Ranked lexical search: TPUT over postings that are partitioned by term.

One pass over the texts counts documents and terms; a second writes, for each term of the
queries and each chunk of documents, a block of the documents that hold it with their
impacts, and deals the blocks out by term, hot terms over many places. The three phases
are then joins and grouped sums over blocks:

1. the heads of all lists give each query a first lower bound of its k-th best score;
2. every list gives what reaches that bound over the query's number of lists, times a
   factor that keeps what isn't seen small; what a chunk gathers gives a better bound, and
   an upper bound for each document it saw;
3. the documents whose upper bound reaches the lower one are looked up in all lists.

Queries are taken in rounds of about a million list entries, which bounds what the driver
and the mapped files of a round hold; nothing else goes to the driver. A chunk holds at
most CHUNK documents or the texts of one batch, so no task holds a list, a query's
candidates or a corpus.

Edge cases: texts that are null or hold no term are no documents; queries without terms
that a document holds give no rows; repeated query rows give their rows as often, repeated
documents are as many documents; equal scores go by doc_id, null first; empty tables give
no rows; extra columns aren't read; texts of any length are read whole.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import cut, load, save, scratch, shared_folder

#: Documents of a chunk, and occurrences of query terms after which it ends.
CHUNK, FULL = 1 << 16, 1 << 21
#: One over the factor of the uniform threshold: the larger, the more is fetched and the less is looked up.
FINER = 8
#: List entries of a round of queries, about.
ROUND = 1 << 20
#: A term's blocks of so many tasks lie together.
TOGETHER = 64

#: ASCII that isn't a letter or digit parts terms; A-Z are lower-cased.
_TERMS = np.array([k + 32 if 65 <= k <= 90 else k if k > 127 or 48 <= k <= 57 or 97 <= k <= 122 else 32 for k in range(256)], np.uint8)
_TABLE = _TERMS.tobytes()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and their terms, of each batch; starts of runs are counted over all its bytes at once."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            texts = b.column("text").slice(at, 512).cast(pa.large_binary()).drop_null()
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            inside = _TERMS[data] != 32
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            first = ends[:-1][np.diff(ends) > 0] - ends[0]
            starts[first] = inside[first]
            n = np.diff(np.concatenate([[0], np.cumsum(starts)])[ends - ends[0]])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "terms"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents that have a term, and all their terms with repeats."""
    r = docs.select("text").mapInArrow(_counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


# ---- postings -------------------------------------------------------------------------


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, size: int) -> np.ndarray:
    m = 25 + 75 * n * documents // size
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _vocabulary(path: str) -> dict[bytes, int]:
    a = load(path)
    data, ends = a["terms"].tobytes(), a["ends"].tolist()
    return {data[x:y]: k for k, (x, y) in enumerate(zip([0, *ends], ends))}  # noqa: B905 - the last start has no end


def _post(path: str, documents: int, size: int):
    """Documents -> blocks (term, chunk, places, impacts), and for each chunk a row of its ids, term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _vocabulary(path).get
        part = TaskContext.get().partitionId()
        chunks = 0
        ids: list[pa.Array] = []
        found: list[np.ndarray] = []
        hits: list[int] = []
        lengths: list[int] = []

        def block() -> pa.RecordBatch:
            """Places follow doc_id, so that ties go by place."""
            kept = pa.concat_arrays(ids)
            order = np.asarray(pa.compute.array_sort_indices(kept, null_placement="at_start")).astype(np.int64)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            key, tf = np.unique(np.concatenate(found).astype(np.int64) << 32 | np.repeat(place, hits), return_counts=True)
            term, at = key >> 32, key & 0xFFFFFFFF
            s = impacts(tf, np.array(lengths, np.int64)[order][at], documents, size)
            cuts = np.flatnonzero(np.diff(term)) + 1
            edges = np.concatenate([[0], cuts, [len(term)]]) if len(term) else np.zeros(1, np.int64)
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            packed = lambda x: [None, *[x[a:b].tobytes() for a, b in spans]]
            n = 1 + len(spans)
            listed = pa.ListArray.from_arrays(pa.array([0, len(kept), *[len(kept)] * len(spans)], pa.int32()), kept.take(pa.array(order)), mask=pa.array([False, *[True] * len(spans)]))
            columns = [pa.array([-1, *term[edges[:-1]].tolist()], pa.int32()), pa.array([(part << 24) + chunks] * n, pa.int64()), pa.array(packed(at.astype("<u4")), pa.binary()), pa.array(packed(s.astype("<i4")), pa.binary()), listed]
            return pa.RecordBatch.from_arrays(columns, names=["term", "chunk", "places", "impacts", "ids"])

        for b in batches:
            for start in range(0, b.num_rows, 1024):
                rows = b.slice(start, 1024)
                ids.append(rows.column("doc_id"))
                for text in rows.column("text").cast(pa.binary()).to_pylist():
                    words = terms(text) if text else []
                    own = [k for k in map(get, words) if k is not None]
                    found.append(np.array(own, np.int32))
                    hits.append(len(own))
                    lengths.append(len(words))
                if len(lengths) >= CHUNK or sum(hits) >= FULL:
                    yield block()
                    chunks += 1
                    ids, found, hits, lengths = [], [], [], []
        if ids:
            yield block()

    return run


def postings(docs: DataFrame, path: str, documents: int, size: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The blocks, written by term, and the ids of each chunk, written with them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_post(path, documents, size), f"term int, chunk long, places binary, impacts binary, ids array<{kind}>")
    near = F.when(F.col("term") < 0, F.col("chunk")).otherwise(F.shiftright("chunk", 24 + TOGETHER.bit_length() - 1))
    rows.withColumn("near", near).repartition("term", "near").drop("near").withColumn("list", (F.col("term") >= 0).cast("int")).write.partitionBy("list").parquet(folder)
    read = docs.sparkSession.read.parquet(folder)
    return read.where("list = 1").select("term", "chunk", "places", "impacts"), read.where("list = 0").select("chunk", "ids")


# ---- the three phases -----------------------------------------------------------------


def _heads(k: int):
    """The k best of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for term, chunk, places, scores in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at, s = np.frombuffer(places, "<u4"), np.frombuffer(scores, "<i4")
                best = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                out += [(term, chunk, int(at[i]), int(s[i])) for i in best]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["term", "chunk", "place", "impact"])

    return run


def _kth(rows: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """query and bound, the k-th best value of each query that has as many."""
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(value), *ties))).where(f"n <= {k}")
    return best.groupBy("query").agg(F.min(value).alias("bound"), F.count("*").alias("n")).where(f"n = {k}").select("query", "bound")


def _above(path: str):
    """What some query of its term asks of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = load(path)["least"]
        for b in batches:
            kept: list[tuple] = []
            for term, chunk, places, scores in zip(*[c.to_pylist() for c in b.columns], strict=True):
                s = np.frombuffer(scores, "<i4")
                take = s >= least[term]
                if take.any():
                    kept.append((term, chunk, np.frombuffer(places, "<u4")[take].tobytes(), s[take].tobytes()))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["term", "chunk", "places", "impacts"])

    return run


def _gathered(path: str, k: int):
    """All that was fetched of one chunk -> for each query the documents that may be among its k best, with lower and upper bounds of their scores."""

    def run(table: pa.Table) -> pa.Table:
        a = load(path)
        blocks = {t: (np.frombuffer(p, "<u4"), np.frombuffer(s, "<i4").astype(np.int64)) for t, p, s in zip(*[table.column(c).to_pylist() for c in ("term", "places", "impacts")], strict=True)}
        width = 1 + max(int(p.max()) for p, _ in blocks.values())
        low, high = np.zeros(width, np.int64), np.zeros(width, np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        have = np.isin(a["term"], np.fromiter(blocks, np.int64))
        for q in np.unique(np.repeat(np.arange(len(a["at"]) - 1), np.diff(a["at"]))[have]).tolist():
            entries = np.arange(a["at"][q], a["at"][q + 1])
            low[:], high[:] = 0, 0
            for e in entries[have[entries]].tolist():
                places, s = blocks[int(a["term"][e])]
                take = s >= a["floor"][e]
                low[places[take]] += s[take] * a["weight"][e]
                high[places[take]] -= a["unseen"][e]
            seen = np.flatnonzero(low)
            if not len(seen):
                continue
            lower, upper = low[seen], low[seen] + high[seen] + a["unseen"][entries].sum()
            best = np.lexsort((seen, -lower))[:k]
            bound, last = (int(lower[best[-1]]), int(seen[best[-1]])) if len(best) == k else (0, -1)
            # k documents of this chunk are better than what can't pass the last of them
            keep = (upper >= a["bound"][q]) & ((upper > bound) | (upper == bound) & (seen <= last) if last >= 0 else True)
            keep[best] |= upper[best] >= a["bound"][q]
            out.append((np.full(int(keep.sum()), q), seen[keep], lower[keep], upper[keep]))
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4)]
        chunk = np.full(len(columns[0]), table.column("chunk")[0].as_py(), np.int64)
        return pa.table({"query": columns[0], "chunk": chunk, "place": columns[1], "lower": columns[2], "upper": columns[3]})

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each with the documents asked of it -> their parts of the scores."""
    for b in batches:
        for chunk, places, scores, queries, wanted, weight in zip(*[b.column(c).to_pylist() for c in ("chunk", "places", "impacts", "queries", "wanted", "weights")], strict=True):
            at, s = np.frombuffer(places, "<u4"), np.frombuffer(scores, "<i4")
            wanted, queries, weight = np.array(wanted, np.int64), np.array(queries, np.int64), np.array(weight, np.int64)
            i = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
            hit = at[i] == wanted
            yield pa.RecordBatch.from_arrays([pa.array(queries[hit]), pa.array(np.full(int(hit.sum()), chunk)), pa.array(wanted[hit]), pa.array(s[i[hit]] * weight[hit])], names=["query", "chunk", "place", "part"])


def _round(docs: DataFrame, lists: list[tuple[int, bytes, int]], documents: int, size: int, k: int) -> DataFrame:
    """query, rank, doc_id, score of the queries of lists (query, term, times)."""
    spark = docs.sparkSession
    files = scratch(spark, "lexical")
    words = sorted({t for _, t, _ in lists})
    numbers = {t: n for n, t in enumerate(words)}
    save(f"{files}/words", {"terms": np.frombuffer(b"".join(words), np.uint8), "ends": np.cumsum([len(t) for t in words])})
    blocks, ids = postings(docs, f"{files}/words", documents, size, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")

    # phase 1: heads of lists
    heads = cut(blocks.mapInArrow(_heads(k), "term int, chunk long, place long, impact long").withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "chunk", "place"))).where(f"n <= {k}").drop("n"))
    df, top = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for r in blocks.groupBy("term").agg(F.sum(F.octet_length("places") / 4).cast("long").alias("df")).collect():
        df[r["term"]] = r["df"]
    for r in heads.groupBy("term").agg(F.max("impact").alias("top")).collect():
        top[r["term"]] = r["top"]
    w = weights(df, documents)
    entries = sorted((q, numbers[t], n * int(w[numbers[t]])) for q, t, n in lists if df[numbers[t]] and w[numbers[t]])
    if not entries:
        return spark.createDataFrame([], f"query long, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    queries, term, weight = (np.array(c, np.int64) for c in zip(*entries, strict=True))
    asked = cut(spark.createDataFrame(pa.table({"query": queries, "term": term.astype(np.int32), "weight": weight})))
    first = heads.join(asked, "term").groupBy("query", "chunk", "place").agg(F.sum(F.col("impact") * F.col("weight")).alias("lower"))
    bound = np.zeros(int(queries[-1]) + 1, np.int64)
    for r in _kth(first, "lower", k, "chunk", "place").collect():
        bound[r["query"]] = r["bound"]

    # phase 2: a uniform threshold for all lists of a query
    at = np.searchsorted(queries, np.arange(len(bound) + 1))
    floor = np.maximum(1, -(-bound[queries] // (FINER * np.diff(at)[queries] * weight)))
    least = np.full(len(words), np.iinfo(np.int64).max)
    np.minimum.at(least, term, floor)
    save(f"{files}/lists", {"at": at, "term": term, "weight": weight, "floor": floor, "unseen": np.minimum(top[term], floor - 1) * weight, "bound": bound, "least": least})
    fetched = blocks.mapInArrow(_above(f"{files}/lists"), blocks.schema)
    seen = cut(fetched.groupBy("chunk").applyInArrow(_gathered(f"{files}/lists", k), "query long, chunk long, place long, lower long, upper long"))
    better = _kth(seen, "lower", k, "chunk", "place")
    left = seen.join(better, "query", "left").where("upper >= coalesce(bound, 0)").select("query", "chunk", "place")

    # phase 3: exact scores of what is left
    wanted = left.join(asked, "query").groupBy("term", "chunk").agg(F.collect_list(F.struct("query", "place", "weight")).alias("x")).select("term", "chunk", F.col("x.query").alias("queries"), F.col("x.place").alias("wanted"), F.col("x.weight").alias("weights"))
    parts = blocks.join(wanted, ["term", "chunk"]).mapInArrow(_looked_up, "query long, chunk long, place long, part long")
    scores = parts.groupBy("query", "chunk", "place").agg(F.sum("part").alias("score"))
    best = _named(scores, ids, k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query", "rank", "doc_id", "score")


def _named(scores: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The k best of each query and chunk, where place follows doc_id, with their ids."""
    near = scores.withColumn("n", F.row_number().over(Window.partitionBy("query", "chunk").orderBy(F.desc("score"), "place"))).where(f"n <= {k}").drop("n")
    return near.join(ids, "chunk").select("query", F.get("ids", F.col("place").cast("int")).alias("doc_id"), "score")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(q, t, n) for q, text in zip(b.column("query").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True) if text for t, n in Counter(terms(text)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["query", "term", "times"])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, per_round: int = ROUND) -> DataFrame:
    """query, rank, doc_id, score: the k best documents (doc_id, text) of each query (query long, text)."""
    documents, size = corpus_size(docs)
    lists = cut(queries.select("query", "text").mapInArrow(_lists, "query long, term binary, times long"))
    rounds = -(-lists.count() // per_round)
    out = docs.sparkSession.createDataFrame([], f"query long, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for r in range(rounds if documents else 0):
        own = lists.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r).toArrow().to_pylist()
        numbers = sorted({e["query"] for e in own})
        dense = {q: n for n, q in enumerate(numbers)}
        found = _round(docs, [(dense[e["query"]], e["term"], e["times"]) for e in own], documents, size, k) if own else None
        if found is not None:
            names = docs.sparkSession.createDataFrame(pa.table({"query": np.arange(len(numbers)), "name": np.array(numbers, np.int64)}))
            out = out.union(found.join(names, "query").select(F.col("name").alias("query"), "rank", "doc_id", "score"))
    return out


def op13_lexical(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    numbered = cut(items.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()))
    found = search(docs.select("doc_id", "text"), numbered, k)
    return found.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
n as (select doc_id, cast(len(terms) as bigint) as n from d where len(terms) > 0),
g as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as size from n),
p as (select doc_id, term, cast(count(*) as bigint) as tf from (select doc_id, unnest(terms) as term from d) group by doc_id, term),
w as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
      from (select term, cast(count(*) as bigint) as df from p group by term), g),
q as (select item_id, term, cast(count(*) as bigint) as times
      from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by item_id, term),
s as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // size)))) as bigint) as score
      from q join w using (term) join p using (term) join n using (doc_id), g group by item_id, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""
