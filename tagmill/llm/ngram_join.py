"""N-gram Jaccard join: near-duplicate documents by word shingles.

MinHash bands bring texts together, and a star per bucket and connected components make
groups of candidates. A pair is compared if it shares a bucket, in groups of every size:
groups of up to CHAINED texts in tiles of blocks, and larger ones, where template
texts chain together, bucket by bucket, each pair in the first that it shares, so work
follows the buckets and not the square of the group. Within a tile pairs compare MinHash values a few at a time: a pair
goes on only while the posterior probability that its similarity reaches the threshold is
above a tolerance. What is left is verified on the exact shingle sets. A tile returns link
counts and a spanning forest, never pairs, so the rows that move stay in proportion to the
texts.

Edge cases: empty tables give no rows; texts of any length are read whole; a null text is an empty one; texts without words link to nothing and are
their own class; a text of fewer words than a shingle has one shingle of all its words;
exact copies are one text with a number of documents; repeated rows count as documents;
null ids group by text like others, and a class of nothing else has a null id; extra
columns aren't read, and near_unique() passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import connected_components, cut, mix, narrow, shingle_sets, text_parts

SHINGLE = 5
#: The threshold as a fraction, 4 / 5.
OVER, UNDER = 4, 5
BANDS, ROWS = 24, 4
#: MinHash values of a step and in all, and the posterior probability below which a pair is dropped.
STEP, VALUES, TOLERANCE = 32, 128, 1e-9
#: Texts of a block; groups of more than two blocks are compared tile by tile.
BLOCK = 128
#: Texts of a group beyond which its buckets are compared, not the group.
CHAINED = BANDS * BLOCK
_SEEDS = np.random.default_rng(77).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, first: int, last: int) -> np.ndarray:
    """MinHash values first..last of a set with members."""
    return np.array([mix(shingles * s).min() >> np.uint64(32) for s in _SEEDS[first:last]], np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The first n MinHash values of each of the sets, none of them empty."""
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    joined = np.concatenate(sets)
    out = np.empty((len(sets), n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(mix(joined * _SEEDS[k]) >> np.uint64(32), starts)
    return out


def fewest_equal(tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 STEP, .. values, the equal ones that a pair needs.

    The similarity has a flat prior, so after m of n equal values it follows
    Beta(m + 1, n - m + 1), and P(similarity >= t) is the chance of at most m
    successes in n + 1 trials of chance t.
    """
    t, out = OVER / UNDER, []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return out


# ---- candidates ---------------------------------------------------------------------


def band_keys(values: np.ndarray) -> np.ndarray:
    """The keys of the bands of signatures, a column for each band; keys of different bands differ."""
    keys = np.empty((len(values), BANDS), np.uint64)
    for k in range(BANDS):
        h = np.full(len(values), k + 1, np.uint64)
        for c in range(ROWS):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + values[:, k * ROWS + c])
        keys[:, k] = h
    return keys


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes = b.column("node")
        for data, bounds, row in text_parts(b.column("text")):
            sets = shingle_sets(data, bounds, SHINGLE)
            some = [i for i, s in enumerate(sets) if len(s)]
            if not some:
                continue
            keys = band_keys(signatures([sets[i] for i in some], BANDS * ROWS))
            own = nodes.take(pa.array(np.repeat(np.array(some) + row, BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), own], names=["band", "node"])


def _nodes(docs: DataFrame) -> DataFrame:
    return narrow(docs, "doc_id", "text").select("doc_id", "text", F.unhex(F.md5("text")).alias("node"))


def band_rows(texts: DataFrame) -> DataFrame:
    """texts (node, text) -> (band, node), written out: a row for each band of a text; a text that repeats has its rows again."""
    return cut(texts.select("node", "text").mapInArrow(_bands, "band long, node binary"))


def candidate_groups(rows: DataFrame) -> DataFrame:
    """rows (band, node) -> (node, comp) for those that share a bucket with another."""
    # written out, so that the join below shuffles both sides itself and its hot buckets can be split
    stars = cut(rows.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top").select("band", "b"))
    edges = rows.join(stars, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return connected_components(edges)


# ---- verification -------------------------------------------------------------------


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, need: list[int], band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of left and right share a bucket and are alike; both may be the same places of sets, then each pair once; with a band's key only pairs that share no band before it."""
    same = left is right
    a_sig = signatures([sets[i] for i in left], VALUES)
    b_sig = a_sig if same else signatures([sets[i] for i in right], VALUES)
    equal = np.zeros((len(left), len(right)), np.int16)
    alive = np.triu(np.ones(equal.shape, bool), 1) if same else np.ones(equal.shape, bool)
    a_keys = band_keys(a_sig)
    b_keys = a_keys if same else band_keys(b_sig)
    if band is None:
        shared = np.zeros(equal.shape, bool)
        for k in range(BANDS):
            shared |= a_keys[:, k, None] == b_keys[None, :, k]
        alive &= shared
    else:
        own = int(np.flatnonzero(a_keys[0] == np.array(band, np.int64).view(np.uint64))[0])
        for k in range(own):
            alive &= a_keys[:, k, None] != b_keys[None, :, k]
    for step, least in enumerate(need):
        part = slice(step * STEP, (step + 1) * STEP)
        if alive.sum() * 8 > alive.size:
            for k in range(part.start, part.stop):
                equal += a_sig[:, k, None] == b_sig[None, :, k]
        else:
            x, y = np.nonzero(alive)
            equal[x, y] += (a_sig[x, part] == b_sig[y, part]).sum(1).astype(np.int16)
        alive &= equal >= least
    x, y = np.nonzero(alive)
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(x) <= 4 * (len(left) + len(right)):
        both = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    else:
        both = _overlaps([sets[i] for i in left], [sets[j] for j in right])[x, y]
    good = (OVER + UNDER) * both >= OVER * (sizes[left[x]] + sizes[right[y]])
    return left[x[good]], right[y[good]]


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over slices of the shingles in both sides."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    a_row, b_row = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    out = np.zeros((len(left), len(right)))
    cells = []
    for values, rows in ((a, a_row), (b, b_row)):
        at = np.searchsorted(shared, values)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == values[hit]
        order = np.argsort(at[hit], kind="stable")
        cells.append((at[hit][order], rows[hit][order]))
    for low in range(0, len(shared), columns):
        sides = []
        for (at, rows), n in zip(cells, (len(left), len(right)), strict=True):
            i, j = np.searchsorted(at, [low, low + columns])
            m = np.zeros((n, min(columns, len(shared) - low)), np.float32)
            m[rows[i:j], at[i:j] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _verify(frame: pd.DataFrame) -> pd.DataFrame:
    """One tile or bin: (node, comp, side, n, band, text) -> node, links (documents) and a root."""
    frame = frame.drop_duplicates(["node", "side"]).sort_values(["comp", "side", "node"])
    band = None if pd.isna(frame["band"].iloc[0]) else int(frame["band"].iloc[0])
    need = fewest_equal()
    column = pa.array(frame["text"], pa.large_string())
    sets: list[np.ndarray] = []
    for data, bounds, _ in text_parts(column):
        sets += shingle_sets(data, bounds, SHINGLE)
    copies, nodes, sides = frame["n"].to_numpy(), frame["node"].tolist(), frame["side"].to_numpy()
    links, root = np.zeros(len(sets), np.int64), list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for places in frame.reset_index(drop=True).groupby("comp", sort=False).indices.values():
        places = np.sort(places)
        if sides[places].max():  # two blocks
            halves = [(places[sides[places] == 1], places[sides[places] == 2])]
        else:
            cuts = [places[i : i + BLOCK] for i in range(0, len(places), BLOCK)]
            halves = [(p, q) for i, p in enumerate(cuts) for q in cuts[i:]]
        for p, q in halves:
            if len(p) and len(q):
                x, y = _linked(sets, p, q, need, band)
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    a, b = top(i), top(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": nodes, "links": links, "root": [nodes[top(i)] for i in range(len(sets))]})


def _tiled(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, size, node, comp, n, band) of groups by key, as tiles (big, i, j, side): each row goes to the tiles of its block with every other."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return spread.select(F.col(key).cast("string").alias("big"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "node", "comp", "n", "band")


def links(docs: DataFrame) -> DataFrame:
    """node, n, first_id, links (documents of other texts), comp (a node of the class) for every text with words that links to another; see classes()."""
    texts = _nodes(docs)
    rows = band_rows(texts)
    groups = candidate_groups(rows)
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    copies = texts.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    # written out, so that joins by node or bucket shuffle both sides themselves and hot ones can be split
    members = cut(groups.join(cut(sizes), "comp").join(copies, "node"))
    some = members.select("size", "node", F.hex("comp").alias("comp"), "n", F.lit(None).cast("long").alias("band"))
    bins = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // (4 * BLOCK)))
    small = some.where(f"size <= {2 * BLOCK}").select(F.lit(None).cast("string").alias("big"), F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("int").alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "node", "comp", "n", "band")
    whole = _tiled(some.where(f"size between {2 * BLOCK + 1} and {CHAINED}"), "comp")
    out = small.unionByName(whole)
    chained = members.where(f"size > {CHAINED}").select("node", "n")
    if not chained.isEmpty():
        wide = cut(rows.join(chained, "node").distinct())
        full = cut(wide.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
        out = out.unionByName(_tiled(wide.join(full, "band").withColumn("comp", F.col("band").cast("string")), "band"))
    # one row of each text: that of its least id (several, if rows repeat; dropped on arrival)
    firsts = members.select("node", "first_id")
    bodies = texts.select("node", F.col("doc_id").alias("own_id"), "text").join(firsts, "node").where("own_id <=> first_id").select("node", "text")
    told = out.join(bodies, "node").groupBy("big", "i", "j").applyInPandas(_verify, "node binary, links long, root binary")
    found = cut(told.where("links > 0"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return found.groupBy("node").agg(F.sum("links").alias("links")).join(classes, "node")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id (least id of the class), n_links (other documents at or above the threshold) for every row."""
    texts = _nodes(docs).select("doc_id", "node", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    copies = texts.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    linked = cut(links(docs))
    first = linked.join(copies, "node").groupBy("comp").agg(F.min("first_id").alias("class_id"))
    by_node = copies.join(linked.join(cut(first), "comp").select("node", "links", "class_id"), "node", "left").select("node", "n", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return texts.join(cut(by_node), "node").select("doc_id", "node", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("worded"), F.col("links") + F.col("n") - 1).otherwise(0).alias("n_links"))


def op8_ngram_join(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "n_links")


def near_unique(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the least id, with its own columns; texts without words all stay."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("row", F.col("doc_id").alias("own_id"), F.unhex(F.md5("text")).alias("node"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    worded = rows.where("worded")
    copies = worded.groupBy("node", "own_id").agg(F.count("*").alias("n")).groupBy("node").agg(F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "n")).alias("first"))
    labels = copies.join(links(docs).select("node", "comp"), "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
    best = F.min(F.struct("first.none", "first.own_id", "node", "first.n")).alias("best")
    keep = cut(labels.groupBy("comp").agg(best).select("best.node", F.col("best.own_id").alias("keep_id"), "best.n"))
    kept = worded.join(keep, "node").where("own_id <=> keep_id")
    if not keep.where("n > 1").isEmpty():  # the very same row again
        again = kept.where("n > 1").groupBy("node").agg(F.first("row").alias("row"))
        kept = kept.where("n = 1").select("row").union(again.select("row"))
    return kept.select("row.*").unionByName(rows.where("not worded").select("row.*"))
