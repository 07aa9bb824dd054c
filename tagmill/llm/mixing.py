"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

All on DataFrame functions. Documents are counted into cells of source, language and topic
(any column or expression) with partial sums; only the cells, whose number doesn't follow
the documents, are raked, to shares that are given or else to the shares found, raised to
a power. Probabilities go back to the documents by a join on the
cell; residuals() tells how near the marginals come.

Edge cases: null sources, languages and topics are cells of their own; a null text has no
words, and its document is drawn with its cell's probability; texts of any
length are read whole; repeated rows share a draw; empty tables give no rows. Values that
no document has can't be met: the shares of the others are scaled to 1. Only the named
columns enter the arithmetic, and the columns of docs pass through sampled() whatever
their names.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import GAP, cut

#: dimension -> value -> share of all words.
Targets = dict[str, dict[str | None, float]]

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Rows of the cell table that one task rakes, and that a join may broadcast; beyond, both are spread.
FEW_CELLS = 50_000
#: Rounds of fitting that are tried in turn, and how near to its target a marginal's share must come.
ROUNDS, CLOSE = (60, 240, 960), 1e-6


def markers() -> Column:
    """A topic by what the text holds, for tables without a column of topics: licence terms, table rows, contacts and code, or running prose."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("opyright")), "licence")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | F.contains(text, F.lit("= \"")), "contact")
        .otherwise("prose")
    )


def n_words() -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), GAP), "")).cast("long")


def cells(docs: DataFrame) -> DataFrame:
    """Words and documents by source, lang and topic, a column of docs."""
    return docs.select("source", "lang", "topic", n_words().alias("words")).groupBy(*DIMENSIONS).agg(F.sum("words").alias("words"), F.count("*").alias("docs"))


def _goal(d: str, value: Column, own: Column, powers: dict[str, float], targets: Targets) -> Column:
    """What a value of a dimension is to have, before all are made to sum to 1; own are its words."""
    if d not in targets:
        return F.when(own > 0, F.pow(own, F.lit(powers[d]))).otherwise(0.0)
    out = F.lit(0.0)
    for v, share in targets[d].items():
        out = F.when(value.eqNullSafe(F.lit(v)), float(share)).otherwise(out)
    return F.when(own > 0, out).otherwise(0.0)


def rake(counts: DataFrame, powers: dict[str, float], largest: float = math.inf, rounds: int = 60, targets: Targets | None = None) -> DataFrame:
    """counts (DIMENSIONS, words, docs) with weight: the factor by which a cell's words count so that the marginals meet their targets.

    A value's target is the share given for it (0 if its dimension has others) or, without
    targets for the dimension, its share of words raised to the dimension's power; they
    are made to sum to 1. Iterative proportional fitting: each step scales the cells of one
    dimension's values by target over sum. Weights above largest would be trimmed after
    each step, and the targets then missed; without it nothing is trimmed.
    """
    counts = cut(counts)
    few = counts.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    return (_rake_row if few else _rake_spread)(counts, powers, largest, rounds, targets or {})


def _rake_row(counts: DataFrame, powers: dict[str, float], largest: float, rounds: int, targets: Targets | None = None) -> DataFrame:
    """As arrays of one row: a step reads each cell once, and no step needs a job. At most FEW_CELLS cells."""
    at = {d: F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(d)) - 1 for d in DIMENSIONS}
    placed = counts.coalesce(1).withColumns({f"i_{d}": c for d, c in at.items()})
    row = placed.agg(F.sort_array(F.collect_list(F.struct(*[f"i_{d}" for d in DIMENSIONS], *DIMENSIONS, "words", "docs"))).alias("c")).where(F.size("c") > 0)
    row = row.withColumn("words", F.transform("c", lambda x: x["words"].cast("double"))).withColumn("total", _sum(F.col("words")))
    for d in DIMENSIONS:
        row = row.withColumn(f"of_{d}", F.col(f"c.i_{d}"))
        row = row.withColumn(f"in_{d}", _members(f"of_{d}"))
        shares = F.transform(f"in_{d}", _goals(d, powers, targets or {}))
        row = row.withColumn(f"t_{d}", shares).withColumn(f"t_{d}", F.transform(f"t_{d}", _over(f"t_{d}")))
    weights = F.transform("c", lambda _: F.lit(1.0))
    row = row.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), weights, _round(largest)))
    return row.select(F.explode(F.arrays_zip(F.col("c").alias("c"), F.col("w").alias("w"))).alias("x")).select(*[F.col(f"x.c.{k}").alias(k) for k in (*DIMENSIONS, "words", "docs")], F.col("x.w").alias("weight"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _members(places: str) -> Column:
    """For each value the places of its cells: cells sorted by value, cut where the value changes."""
    order = F.sort_array(F.transform(places, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    empty = F.array().cast("array<array<int>>")

    def add(state: Column, x: Column) -> Column:
        last = F.struct(x["v"].alias("v"), F.array(x["i"]).alias("run"), F.when(state["v"] >= 0, F.concat(state["done"], F.array(state["run"]))).otherwise(state["done"]).alias("done"))
        more = F.struct(state["v"].alias("v"), F.concat(state["run"], F.array(x["i"])).alias("run"), state["done"].alias("done"))
        return F.when(x["v"] == state["v"], more).otherwise(last)

    start = F.struct(F.lit(-1).alias("v"), F.array().cast("array<int>").alias("run"), empty.alias("done"))
    return F.aggregate(order, start, add, lambda s: F.concat(s["done"], F.array(s["run"])))


def _goals(d: str, powers: dict[str, float], targets: Targets):
    def share(cells_of: Column) -> Column:
        own = F.aggregate(cells_of, F.lit(0.0), lambda s, i: s + F.get(F.col("words"), i))
        return _goal(d, F.get(F.col("c"), F.get(cells_of, F.lit(0)))[d], own, powers, targets)

    return share


def _over(name: str):
    def scaled(x: Column) -> Column:
        return F.when(_sum(F.col(name)) > 0, x / _sum(F.col(name))).otherwise(0.0)

    return scaled


def _round(largest: float):
    def fit(weights: Column, _: Column) -> Column:
        out = weights
        for d in DIMENSIONS:
            out = F.get(F.transform(F.array(out), _step(d, largest)), F.lit(0))
        return out

    return fit


def _step(d: str, largest: float):
    def scaled(w: Column) -> Column:
        def factor(cells_of: Column, k: Column) -> Column:
            have = F.aggregate(cells_of, F.lit(0.0), lambda s, i: s + F.get(F.col("words"), i) * F.get(w, i))
            return F.when(have > 0, F.get(F.col(f"t_{d}"), k) * F.col("total") / have).otherwise(1.0)

        def apply(factors: Column) -> Column:
            return F.transform(w, lambda x, i: F.least(F.lit(largest), x * F.get(factors, F.get(F.col(f"of_{d}"), i))))

        return F.get(F.transform(F.array(F.transform(F.col(f"in_{d}"), factor)), apply), F.lit(0))

    return scaled


def _rake_spread(counts: DataFrame, powers: dict[str, float], largest: float, rounds: int, targets: Targets | None = None, each: int = 5) -> DataFrame:
    """The same steps as windows over a cell table of any size, written to the shared folder every few rounds."""
    state = cut(counts.withColumn("weight", F.lit(1.0)))
    sums = state.agg(F.sum("words").cast("double").alias("total"))
    for d in DIMENSIONS:
        own = F.sum("words").cast("double")
        by = state.groupBy(d).agg(own.alias("own")).select(d, _goal(d, F.col(d), F.col("own"), powers, targets or {}).alias("r"))
        by = by.join(F.broadcast(by.agg(F.sum("r").alias("all"))), F.lit(True)).select(F.col(d).alias("v"), F.when(F.col("all") > 0, F.col("r") / F.col("all")).otherwise(0.0).alias(f"t_{d}"))
        state = state.join(by, state[d].eqNullSafe(by["v"])).drop("v")
    state = cut(state.withColumn("total", F.lit(sums.first()["total"])))
    for _ in range(0, rounds, each):
        for _ in range(each):
            for d in DIMENSIONS:
                state = state.withColumn("have", F.sum(F.col("words") * F.col("weight")).over(Window.partitionBy(d)))
                step = F.when(F.col("have") > 0, F.col(f"t_{d}") * F.col("total") / F.col("have")).otherwise(1.0)
                state = state.withColumn("weight", F.least(F.lit(largest), F.col("weight") * step)).drop("have")
        state = cut(state)
    return state.select(*DIMENSIONS, "words", "docs", "weight")


def draw(key: Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / float(2**53)


def probabilities(docs: DataFrame, keep: float, powers: dict[str, float], targets: Targets | None = None) -> DataFrame:
    """Cells with weight and probability, where keep is the share of all words to expect in the sample.

    Fitting goes on, with more rounds, until every marginal is within CLOSE of its target;
    where no weights meet all of them it ends with a warning that says how far they are off.
    The share is lowered to 1 over the largest weight of a cell with words, so that each
    probability is at most 1 and the words expected meet the targets.
    """
    counts = cut(cells(docs))
    for rounds in ROUNDS:
        fitted = cut(rake(counts, powers, rounds=rounds, targets=targets))
        off = residuals(fitted.withColumn("probability", F.col("weight")), powers, targets).agg(F.max(F.abs(F.col("target") - F.col("reached")))).first()[0]
        if off is None or off <= CLOSE:
            break
    else:
        warnings.warn(f"after {ROUNDS[-1]} rounds a marginal is off its target by {off:.2g}; no weights may meet all of them", stacklevel=2)
    top = fitted.where("words > 0").agg(F.max("weight")).first()[0]
    share = min(keep, 1.0 / top) if top else keep
    return fitted.select(*DIMENSIONS, "words", "docs", "weight", F.least(F.col("weight") * share, F.lit(1.0)).alias("probability"))


def residuals(table: DataFrame, powers: dict[str, float], targets: Targets | None = None) -> DataFrame:
    """dimension, value, target and reached: shares of the words expected by the probabilities of a table of cells."""
    out = None
    for d in DIMENSIONS:
        by = table.groupBy(F.col(d).alias("value")).agg(F.sum("words").cast("double").alias("own"), F.sum(F.col("words") * F.col("probability")).alias("drawn"))
        by = by.withColumn("raised", _goal(d, F.col("value"), F.col("own"), powers, targets or {}))
        sums = F.broadcast(by.agg(F.sum("raised").alias("all_raised"), F.sum("drawn").alias("all_drawn")))
        one = by.join(sums, F.lit(True)).select(F.lit(d).alias("dimension"), "value", (F.col("raised") / F.col("all_raised")).alias("target"), (F.col("drawn") / F.col("all_drawn")).alias("reached"))
        out = one if out is None else out.unionByName(one)
    return out


def marked(docs: DataFrame, keep: float = 0.75, powers: dict[str, float] | None = None, seed: int = 11, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """row (the whole row of docs), text, topic, weight, probability and drawn; topic is a column or expression over docs, markers() if not given."""
    one = docs.select(F.struct("*").alias("row"), "doc_id", "source", "lang", "text", (markers() if topic is None else topic).alias("topic"))
    table = probabilities(one, keep, powers or POWERS, targets).select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], "weight", "probability")
    table = F.broadcast(table) if table.limit(FEW_CELLS + 1).count() <= FEW_CELLS else table
    match = one["source"].eqNullSafe(table["c_source"]) & one["lang"].eqNullSafe(table["c_lang"]) & one["topic"].eqNullSafe(table["c_topic"])
    drawn = F.coalesce(draw(F.col("doc_id"), seed) < F.col("probability"), F.lit(False))
    return one.join(table, match).select("row", "doc_id", "source", "lang", "text", "topic", "weight", "probability", drawn.alias("drawn"))


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """The documents drawn, with their own columns."""
    return marked(docs, **settings).where("drawn").select("row.*")


def op2_mixing(docs: DataFrame, **settings) -> DataFrame:
    wanted = docs.select("doc_id", "source", "lang", "text")
    return marked(wanted, **settings).select("doc_id", "source", "lang", "topic", n_words().alias("n_words"), "weight", "probability", "drawn")
