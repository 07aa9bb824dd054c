"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(score - threshold k)): one weight for each hashed word or
word shape, shared by all grades, and thresholds in order. The fit runs on the driver over
a bounded sample of rated rows; scoring sends the weights (WIDTH floats) along with the
tasks and reads each text once, without a shuffle.

Edge cases: a null text is an empty one and gets the grades of score 0; without ratings of
two grades every text gets the one grade (0 without any) and is kept; grades may be any
whole numbers; empty tables give no rows; texts of any length are read whole; repeated
rows and null ids are scored one by one; ratings that differ for an id count by their
least, and those with a null don't count; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import narrow

WIDTH = 1 << 18
#: Words whose buckets a worker remembers.
REMEMBERED = 500_000
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]{2,}"), re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")
_buckets: dict[str, tuple[int, ...]] = {}


def _bucket(word: str) -> tuple[int, ...]:
    """The buckets of a word without the marks around it, of its first letters and of its shape."""
    shape = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))
    bare = word.strip(".,;:!?\"'()*%&#$|").lower()
    h = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) % WIDTH
    return h("w " + bare), h("p " + bare[:4]), h("s " + shape)


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text, in order."""
    if len(_buckets) > REMEMBERED:
        _buckets.clear()
    out: set[int] = set()
    for w in set(_GAP.split(text)):
        if w:
            own = _buckets.get(w)
            if own is None:
                own = _buckets[w] = _bucket(w)
            out.update(own)
    return np.sort(np.fromiter(out, np.int32, len(out)))


class Model:
    """levels are the grades in order, of any range; a threshold lies between each two."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, levels: np.ndarray) -> None:
        self.weights, self.thresholds, self.levels = weights, thresholds, levels

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the highest, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def expected(self, tail: np.ndarray) -> np.ndarray:
        """The mean grade for rows of above(): the lowest, and the steps up to the others times their chance."""
        return self.levels[0] + tail @ np.diff(self.levels)

    def highest(self, tail: np.ndarray) -> np.ndarray:
        """The chance of the highest grade, 1 if there is but one."""
        return tail[:, -1] if tail.shape[1] else np.ones(len(tail))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 240, rate: float = 0.05, decay: float = 1e-4, seen: int = 12, apart: float = 4.5) -> Model:
    """Adam on the cumulative-link likelihood; a bucket gets a weight if at least seen rows
    hold it and their mean grade is apart standard errors or more from that of all: the rest is chance.
    Grades are any whole numbers; those that occur are the levels. With less than two there is nothing to learn."""
    levels, grades = np.unique(grades, return_inverse=True) if len(rows) else (np.zeros(1, np.int64), grades)
    k = len(levels) - 1
    if k < 1:
        return Model(np.zeros(WIDTH, np.float32), np.zeros(0), levels.astype(np.float64))
    column = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    held = np.bincount(column, minlength=WIDTH)
    mean = np.bincount(column, grades[row], WIDTH) / np.maximum(held, 1)
    tells = (held >= seen) & (np.abs(mean - grades.mean()) * np.sqrt(held) >= apart * grades.std())
    keep = tells[column]
    known, column = np.unique(column[keep], return_inverse=True)
    row, width = row[keep], max(1, len(known))
    # thresholds: the first, then the logarithms of the steps between them
    share = [np.clip((grades <= j).mean(), 1e-4, 1 - 1e-4) for j in range(k)]
    logit = np.log(np.array(share) / (1 - np.array(share)))
    free = np.concatenate([logit[:1], np.log(np.maximum(np.diff(logit), 0.05))])
    w = np.zeros(width)
    m, v, mf, vf = np.zeros(width), np.zeros(width), np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        score = np.bincount(row, w[column], len(rows))
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        hi, lo = sigma(edge[grades + 1] - score), sigma(edge[grades] - score)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g = np.bincount(column, ((d_hi - d_lo) / len(rows))[row], width) + decay * w
        g_theta = np.array([((grades == j + 1) * d_lo - (grades == j) * d_hi).mean() for j in range(k)])
        g_free = np.array([g_theta.sum(), *[g_theta[j:].sum() * np.exp(free[j]) for j in range(1, k)]])
        for x, gx, mm, vv in ((w, g, m, v), (free, g_free, mf, vf)):
            mm += 0.1 * (gx - mm)
            vv += 0.001 * (gx * gx - vv)
            x -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(WIDTH, np.float32)
    weights[known] = w[: len(known)]
    return Model(weights, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]), levels.astype(np.float64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [buckets(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("grade"), b.column("place"), pa.array(rows, pa.list_(pa.int32()))], names=["grade", "place", "buckets"])


def rated(labels: DataFrame) -> DataFrame:
    """doc_id and grade: quality, and a point for a text that isn't toxic."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((F.min("quality") + 1 - F.max("toxic")).cast("int").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, max_rated: int = 8_000) -> Model:
    """From docs (doc_id, text) and ratings (doc_id, grade): of the rated rows the max_rated of least hash at most, however often an id repeats."""
    few = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    rows = narrow(docs, "doc_id", "text").join(F.broadcast(few), "doc_id").select("grade", F.xxhash64("doc_id", "text").alias("place"), "text")
    kept = rows.mapInArrow(_features, "grade int, place long, buckets array<int>").orderBy("place", "grade").limit(max_rated).toArrow()
    lists = kept.column("buckets").combine_chunks()
    grades = np.asarray(kept.column("grade")).astype(np.int64)
    bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    return fit([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] if len(grades) else [], grades)


def _scorer(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([float(model.weights[buckets(t.as_py())].sum(dtype=np.float64)) for t in b.column("text")])
            tail = model.above(score)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(model.expected(tail)), pa.array(model.highest(tail)), pa.array(model.highest(tail) >= least)], names=["doc_id", "score", "expected_grade", "p_highest", "kept"])

    return run


def op1_ordinal(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, score, expected_grade, p_highest (the chance of the highest grade) and kept, where that is at least least."""
    model, source = train(docs, rated(labels)), narrow(docs, "doc_id", "text")
    return source.mapInArrow(_scorer(model, least), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, expected_grade double, p_highest double, kept boolean")
