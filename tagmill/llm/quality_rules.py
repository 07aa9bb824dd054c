"""Quality rules: text statistics, and a decision list learned from labels by sequential covering.

All on DataFrame functions. The statistics of a text come from its own row, so there is
no shuffle; the list is learned from a bounded sample of labelled rows, of which only
histograms (a few hundred counts) reach the driver.

Edge cases: a null text is an empty one; an empty text has no words and fails the base
rule; repeated rows and null ids are scored row by row; without labels of both kinds the
list is empty and the base rule alone decides. Only the named columns are read, so extra
columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import GAP, cut, narrow

WINDOW = 8
SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")


def features() -> dict[str, Column]:
    c = F.col
    return {
        "words": c("n_words").cast("double"),
        "word_length": _ratio(c("word_chars"), c("n_words")),
        "symbols": _ratio(c("n_symbols"), c("n_words")),
        "capitals": _ratio(c("n_capitals"), c("word_chars")),
        "shouts": _ratio(c("n_shouts"), c("n_words")),
        "stops": _ratio(c("n_stops"), c("n_words")),
        "same_lines": _ratio(c("n_dup_lines"), c("n_lines")),
        "same_words": _ratio(c("n_repeat_words"), c("n_words")),
    }


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: as a column it would be copied into each use where a filter moves below it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside a window of WINDOW words that the list holds twice or more.

    A window's hash comes from those of its halves. Only lists with a repeated hash
    sort theirs; neighbours in that order tell which windows repeat, and the gaps
    between their places how many words they cover.
    """

    def halves(span: int):
        def joined(runs: Column) -> Column:
            full = F.greatest(F.size(runs) - span, F.lit(0))
            return F.zip_with(F.slice(runs, F.lit(1), full), F.slice(runs, F.lit(1 + span), full), lambda x, y: F.xxhash64(x, y))

        return joined

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def again(order: Column) -> Column:
        held = F.filter(order, lambda x, k: (x["h"] == F.get(order, k - 1)["h"]) | (x["h"] == F.get(order, k + 1)["h"]))
        return F.sort_array(F.transform(held, lambda x: x["i"]))

    def count(runs: Column) -> Column:
        order = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(runs)) < F.size(runs), _let(_let(order, again), covered)).otherwise(0)

    runs, span = F.transform(words, lambda w: F.xxhash64(w)), 1
    while span < WINDOW:
        runs, span = _let(runs, halves(span)), 2 * span
    return _let(runs, count).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns of STATISTICS, base_failed, and the counts that features() read; text null counts as empty."""
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.array_remove(F.split(text, GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).alias("again")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    capitals = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    a = docs.withColumns({"_w": of_words, "_l": of_lines, "n_symbols": count(SYMBOLS), "n_capitals": capitals, "n_shouts": count("!?"), "n_stops": count(".,;:")})
    a = a.withColumns({"n_words": F.col("_w.n"), "word_chars": F.col("_w.chars"), "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.again"), "n_repeat_words": F.col("_w.again")}).drop("_w", "_l")
    return a.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


# ---- learning -----------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(f"f_{self.feature}") > self.bound if self.above else F.col(f"f_{self.feature}") <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


@dataclass(frozen=True)
class Rule:
    """Reject where all tests hold; of the learning rows that reach it, bad were rejected rightly and good wrongly."""

    tests: tuple[Test, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional: the first rule that holds rejects, what none rejects stays."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"f_{k}": c for k, c in features().items()})


def learn(rows: DataFrame, bins: int = 48, max_rules: int = 8, max_tests: int = 3, precision: float = 0.95, least: int = 8) -> list[Rule]:
    """Sequential covering over rows (f_* features, bad boolean, part "grow" or "prune").

    A rule grows by the threshold test of most information gain over the rows that no
    earlier rule covers, loses its last tests while the held-back part does not get
    worse, and is kept if its share of bad rows is at least precision and it covers
    least rows. Thresholds are quantiles of the bad and of all rows.
    """
    names = list(features())
    places = [k / bins for k in range(1, bins)]
    marks = rows.agg(*[F.percentile_approx(f"f_{n}", places, 10_000).alias(f"a_{n}") for n in names], *[F.percentile_approx(F.when(F.col("bad"), F.col(f"f_{n}")), places, 10_000).alias(f"b_{n}") for n in names]).first()
    cuts = {n: sorted({*(marks[f"a_{n}"] or []), *(marks[f"b_{n}"] or [])}) for n in names}
    if marks[f"b_{names[0]}"] is None:
        return []
    bin_of = lambda n: F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts[n]]), lambda x: x < F.col(f"f_{n}")))
    binned = rows.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), bin_of(n).alias("bin")) for n in names])).alias("at")).select("*", "at.*")
    binned = cut(binned.drop("at"))
    rules: list[Rule] = []
    open_rows = F.lit(True)
    for _ in range(max_rules):
        tests: list[Test] = []
        held = open_rows & (F.col("part") == "grow")
        for _ in range(max_tests):
            found = binned.where(held).groupBy("name", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            one = [r for r in found if r["name"] == names[0]]
            all_p, all_n = sum(r["p"] for r in one), sum(r["n"] for r in one)
            if all_p == 0 or all_n == 0:
                break
            best = (0.0, None)
            for name in names:
                count = {r["bin"]: (r["p"], r["n"]) for r in found if r["name"] == name}
                p = n = 0
                for k, bound in enumerate(cuts[name]):
                    p, n = p + count.get(k, (0, 0))[0], n + count.get(k, (0, 0))[1]
                    for above, a, b in ((False, p, n), (True, all_p - p, all_n - n)):
                        if a >= least // 2:
                            gain = a * (log2((a + 1) / (a + b + 2)) - log2((all_p + 1) / (all_p + all_n + 2)))
                            best = max(best, (gain, Test(name, above, bound)), key=lambda x: x[0])
            if best[1] is None:
                break
            tests.append(best[1])
            held = held & best[1].column()
        if not tests:
            break
        shorter = [Rule(tuple(tests[: k + 1]), 0, 0) for k in range(len(tests))]
        once = binned.where((F.col("name") == names[0]) & open_rows)
        seen = once.agg(*[F.count_if(r.column() & (F.col("bad") if bad else ~F.col("bad")) & (F.col("part") == part)).alias(f"{part}{k}{bad}") for k, r in enumerate(shorter) for bad in (True, False) for part in ("grow", "prune")]).first()
        worth = lambda k: (seen[f"prune{k}True"] - seen[f"prune{k}False"]) / max(1, seen[f"prune{k}True"] + seen[f"prune{k}False"])
        k = max(range(len(tests)), key=lambda k: (worth(k), -k))
        p, n = (seen[f"grow{k}{b}"] + seen[f"prune{k}{b}"] for b in (True, False))
        if p < least or p < precision * (p + n):
            break
        rules.append(Rule(shorter[k].tests, p, n))
        open_rows = open_rows & ~rules[-1].column()
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = 6_000, **settings) -> list[Rule]:
    """The list for docs (doc_id, text) from labels (doc_id, quality); quality 0 is bad.

    max_labelled bounds the rows that are learned from, by least hash of the id; rows
    that the base rule fails teach nothing, as they are rejected anyhow.
    """
    marked = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = narrow(docs, "doc_id", "text").join(F.broadcast(few), "doc_id")
    rows = cut(with_features(text_statistics(rows))).where(~F.col("base_failed")).select("doc_id", (F.col("quality") == 0).alias("bad"), F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) < 2, "grow").otherwise("prune").alias("part"), *[f"f_{n}" for n in features()])
    return learn(rows, **settings)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the statistics, base_failed and kept."""
    scored = with_features(text_statistics(docs)).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return scored.drop(*[f"f_{n}" for n in features()], "n_capitals", "n_shouts", "n_stops", "n_lines")


def passing(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that neither the base rule nor the list rejects, with their own columns."""
    return judge(docs.select(F.struct("*").alias("row"), "text"), rules).where("kept").select("row.*")


def op7_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn_from(docs, labels)
    return judge(narrow(docs, "doc_id", "text"), rules).select("doc_id", *STATISTICS, "base_failed", "kept")
