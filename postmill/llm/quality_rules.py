"""Quality rules as a learned decision list (operator 2, DataFrame functions only).

Text statistics are column expressions. Sequential covering learns from labelled statistics: a rule is
grown by adding the threshold with the greatest information gain until it covers no good document of the
growing part, pruned from its end on the pruning part, and kept if it is precise there; what it covers is
put aside and the next rule is grown. Every count is a Spark aggregation over binned statistics; the
driver sees bins only. The list becomes one ordered CASE expression.

Defined cases: a null text has no words, no lines and fails the base rules; without labels of both kinds
the list is empty and only the base rules reject; null labels and labels other than 0 and 1 are left out;
a document with several labels counts once for each; repeated rows are judged alike; an empty table gives
no rows; columns other than key and text play no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.expr import let
from postmill.llm.common import hash_sample, whole_row
from postmill.session import stage

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Base counts that the query reports, then the counts that only the learner reads.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_marks", "n_distinct_words")

#: Threshold candidates for a rule: share of one count in another.
FEATURES: dict[str, tuple[str, str | None]] = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
}

#: Quantiles of either class between which thresholds are tried; both ends belong to them.
QUANTILES = (0.0, 0.001, 0.005, 0.01, 0.02, *(i / 20 for i in range(1, 20)), 0.98, 0.99, 0.995, 0.999, 1.0)

#: Bad rows that a good row outweighs while a rule is grown.
GOOD_WEIGHT = 10


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hashes; only
    texts with an equal pair are sorted, and all steps are linear or n log n in the text."""
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def repeated(order: Column) -> Column:
        same = F.filter(
            order,
            lambda x, j: (F.coalesce(F.get(order, j - 1)["h"] == x["h"], F.lit(False)))
            | (F.coalesce(F.get(order, j + 1)["h"] == x["h"], F.lit(False))),
        )
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeated))

    return let(windows, count)


def text_stats(text: Column) -> Column:
    """Struct of the counts in BASE and MORE (long) over the whole text."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        ),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    length = F.length(text).cast("long")
    # replaced by one character fewer instead of being listed: no array of matches is built
    symbols = length - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    marks = length - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return let(
        F.struct(counts.alias("c"), line_counts.alias("l"), symbols.alias("s"), marks.alias("m")),
        lambda x: F.struct(
            x["c"]["n_words"].alias("n_words"), x["c"]["word_chars"].alias("word_chars"), x["s"].alias("n_symbols"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"), x["c"]["n_repeat_words"].alias("n_repeat_words"),
            x["l"]["n_lines"].alias("n_lines"), x["m"].alias("n_marks"), x["c"]["n_distinct_words"].alias("n_distinct_words"),
        ),
    )


def feature(name: str, stats: str = "stats") -> Column:
    top, bottom = FEATURES[name]
    value = F.col(f"{stats}.{top}").cast("double")
    return value if bottom is None else F.coalesce(F.try_divide(value, F.col(f"{stats}.{bottom}")), F.lit(0.0))


def base_failed(stats: str = "stats") -> Column:
    return (F.col(f"{stats}.n_words") < MIN_WORDS) | (F.col(f"{stats}.n_repeat_words") * 100 > F.col(f"{stats}.n_words") * MAX_REPEAT_PERCENT)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents that meet all conditions are rejected."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        whole = F.lit(True)
        for c in self.conditions:
            whole = whole & c.column()
        return whole

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, otherwise the document is kept."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def verdict(self) -> Column:
        """The rule that rejects (text), or null. Reads the struct column ``stats``."""
        chain = None
        for rule in self.rules:
            chain = (F if chain is None else chain).when(rule.column(), F.lit(str(rule)))
        return chain.otherwise(F.lit(None).cast("string")) if chain is not None else F.lit(None).cast("string")


def _bins(stats: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """Labelled rows as bin numbers: bin b of a feature means b thresholds lie below the value."""
    bins = [
        F.size(F.filter(F.array(*[F.lit(t) for t in thresholds[f]]), (lambda v: lambda t: t < v)(feature(f)))).alias(f)
        if thresholds[f] else F.lit(0).alias(f)
        for f in FEATURES
    ]
    part = F.when(F.pmod(F.xxhash64(F.lit("part"), F.col("key")), F.lit(3)) == 0, "prune").otherwise("grow")
    return stats.select(*bins, "quality", part.alias("part")).groupBy(*FEATURES, "quality", "part").agg(F.count(F.lit(1)).alias("n"))


def _met(conditions: Sequence[tuple[str, bool, int]]) -> Column:
    out = F.lit(True)
    for f, above, b in conditions:
        out = out & (F.col(f) > b if above else F.col(f) <= b)
    return out


def _histogram(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
    """Bad and good rows by feature and bin: features times bins numbers reach the driver."""
    long = rows.select("quality", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x"))
    found = long.groupBy("x.f", "x.b").agg(
        F.sum(F.when(F.col("quality") == 0, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good")
    ).collect()
    out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
    for r in found:
        out[r["f"]][r["b"]] = (r["bad"], r["good"])
    return out


def _best(hist: dict[str, dict[int, tuple[int, int]]], thresholds: dict[str, list[float]]) -> tuple[float, tuple[str, bool, int] | None, int, int]:
    """The condition with the greatest gain: bad rows kept times the rise in the log share of bad rows, in
    which a good row weighs as much as GOOD_WEIGHT bad ones, since losing a good document costs more."""
    best: tuple[float, tuple[str, bool, int] | None, int, int] = (0.0, None, 0, 0)
    for f in thresholds:
        bad, good = (sum(v[i] for v in hist[f].values()) for i in (0, 1))
        if not bad:
            return best
        before, low = math.log2(bad / (bad + GOOD_WEIGHT * good)), [0, 0]
        for b in range(len(thresholds[f])):
            low = [low[i] + hist[f].get(b, (0, 0))[i] for i in (0, 1)]
            for above, (p, n) in ((False, low), (True, [bad - low[0], good - low[1]])):
                gain = p * (math.log2(p / (p + GOOD_WEIGHT * n)) - before) if p else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, (f, above, b), p, n)
    return best


def learn_list(
    stats: DataFrame, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.98, min_covered: int = 2
) -> DecisionList:
    """A decision list from rows (key, quality 0 or 1, stats). All rows given are counted. A threshold lies
    midway between two quantiles, so that a rule keeps its distance from the documents it leaves alone."""
    stats = stage(stats.where(F.col("quality").isin(0, 1)).select("key", "quality", "stats"), "quality-labelled")
    points = F.array(*[F.lit(q) for q in QUANTILES])
    cuts = stats.groupBy("quality").agg(*[F.percentile_approx(feature(f), points, F.lit(10_000)).alias(f) for f in FEATURES]).collect()
    if len(cuts) < 2:
        return DecisionList()
    values = {f: sorted({v for row in cuts for v in row[f] or []}) for f in FEATURES}
    thresholds = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}
    binned = stage(_bins(stats, thresholds), "quality-bins")
    rules: list[Rule] = []
    rest = F.lit(True)
    openers = dict(thresholds)  # features that may open a rule: one that failed to be precise is not tried again
    while len(rules) < max_rules and openers:
        rows, chosen = binned.where(rest), []
        while len(chosen) < max_conditions:
            _, condition, bad, good = _best(_histogram(rows.where((F.col("part") == "grow") & _met(chosen))), thresholds if chosen else openers)
            if condition is None:
                break
            chosen.append(condition)
            if not good:
                break
        if not chosen:
            break
        # prune from the end: the shortest prefix with the best (bad - good) / covered on the other part
        held = rows.where(F.col("part") == "prune").agg(*[
            F.sum(F.when(_met(chosen[: k + 1]) & (F.col("quality") == q), F.col("n")).otherwise(0)).alias(f"n{k}_{q}")
            for k in range(len(chosen)) for q in (0, 1)
        ]).first()
        worth = [((held[f"n{k}_0"] or 0), (held[f"n{k}_1"] or 0)) for k in range(len(chosen))]
        best = max(range(len(chosen)), key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), -k))
        bad, good = worth[best]
        if bad < min_covered or bad < min_precision * (bad + good):
            del openers[chosen[0][0]]
            continue
        kept = chosen[: best + 1]
        rules.append(Rule(tuple(Condition(f, above, thresholds[f][b]) for f, above, b in kept), bad, good))
        rest = rest & ~_met(kept)
    return DecisionList(tuple(rules))


def fit_quality_rules(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, key: str = "doc_id", text: str = "text", **learning: float
) -> DecisionList:
    """Learn from a sample of at most ``max_labelled`` labelled ids, chosen by hash. Only their texts are
    measured; the sample is what is broadcast, so its size is bounded by the parameter."""
    labelled = labels.where(F.col("quality").isin(0, 1)).select(F.col(key).alias("key"), "quality").where("key IS NOT NULL")
    sample = stage(hash_sample(labelled, "key", max_labelled), "quality-sample")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), F.col("_key") == F.col("key"))
    return learn_list(rows.select("key", "quality", text_stats(F.col("_text")).alias("stats")), **learning)


def judge_quality(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with struct columns ``stats`` and ``quality_verdict`` (base_failed, rule, kept). Input
    columns of these two names are replaced."""
    rest = [c for c in docs.columns if c not in ("stats", "quality_verdict")]
    measured = docs.select(*rest, text_stats(F.col(text)).alias("stats"))
    rule = rules.verdict()
    return measured.withColumn(
        "quality_verdict", F.struct(base_failed().alias("base_failed"), rule.alias("rule"), (~base_failed() & rule.isNull()).alias("kept"))
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, text: str = "text") -> DataFrame:
    """Pipeline step: documents that pass the base rules and the learned list, columns as given."""
    rules = fit_quality_rules(docs, labels, max_labelled)
    judged = docs.select(whole_row(docs), text_stats(F.col(text)).alias("stats"))
    return judged.where(~base_failed() & rules.verdict().isNull()).select("row.*")
