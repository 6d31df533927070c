"""Filter interaction audit by truth-table survival words (operator 11).

Up to five filters are judged independently of each other on every document. From the filters that it
fails, a document gets a 32-bit word: bit S is set if the document survives when exactly the filters of
subset S are applied. Counting each bit over the documents of a part gives the survivors of all 32 subsets
at once, and every figure of every order of the filters is a difference of such counts:

    kept after a step       n[applied so far, this one included]
    removed by it           n[applied before] - n[applied so far]
    failing it              n[none] - n[it alone]; those not removed by it were removed earlier: redundant
    failing it only         n[all others] - n[all]
    removed in all orders   sum over subsets S without it of |S|! (k-1-|S|)! (n[S] - n[S and it])

The bits are counted by positional popcounts: words are added three at a time by carry-save adders (one
word of sums, one of carries of twice the weight), so the 32 counters advance together, and only the few
words that are left of each weight are taken apart.

Scale. Each task counts its own documents and passes on 32 counts for each part and label, which are
summed. The copy filter shuffles hashes of texts and ids, not texts; a text that many rows share is one
minimum, combined before the shuffle, and its rows are joined without one. Nothing is collected.

Defined cases: a null text is an empty one; a null id has no smaller id and is no smaller id; rows that
repeat id and text are equal, so neither has the smaller id; a null part is the empty part; a document
has a label if any label row of its id says 1; an empty table has no parts and gives no rows; columns
other than key, text and part play no part, whatever their names. Very long texts are judged whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.expr import let
from postmill.session import stage

#: Characters that part words.
BLANK = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST = 5
#: Classes whose survivors are counted for each part.
LABELS = ("all", "good", "toxic")
#: Share of the rows, one in so many, from which a text is hot.
HOT = 2000
#: Parts that a task counts before it passes counts on.
PARTS_HELD = 2048


def survival_words(filters: int = MOST) -> list[int]:
    """For each set of failed filters (a bit mask) the word of the subsets that such a document survives."""
    subsets = range(1 << filters)
    return [sum(1 << s for s in subsets if not s & failed) for failed in subsets]


def positional_popcount(words: np.ndarray, bits: int = 1 << MOST) -> np.ndarray:
    """How many of the words have each bit set."""
    counts = np.zeros(bits, np.int64)
    level, weight = np.ascontiguousarray(words, dtype=np.uint32), 1
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            level = np.concatenate([either ^ c, level[3 * third :]])
        for word in level:  # two at most of each weight
            counts += weight * ((int(word) >> np.arange(bits)) & 1)
        level, weight = (np.concatenate(carries) if carries else level[:0]), 2 * weight
    return counts


def text_failures(text: Column, least_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, marks: str = "[#$%&*|]") -> Column:
    """Bit mask of the text filters that a text fails: 1 too few words, 2 too few different words,
    4 too many capitals, 8 a mark that prose does not have."""

    def judged(t: Column) -> Column:
        capitals = F.length(t) - F.length(F.translate(t, UPPER, ""))
        words = F.filter(F.split(t, BLANK), lambda w: w != "")
        return let(words, lambda w: _mask([
            F.size(w) < least_words,
            100 * F.size(F.array_distinct(w)) < distinct_percent * F.size(w),
            100 * capitals > upper_percent * F.length(t),
            t.rlike(marks),
        ]))

    return let(F.coalesce(text, F.lit("")), judged)


def _mask(failed: Sequence[Column], first: int = 0) -> Column:
    bits = [F.when(c, F.lit(1 << (first + i))).otherwise(F.lit(0)) for i, c in enumerate(failed)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def judged_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, word, good, toxic) of every document: the text filters and, as the fifth, whether a
    smaller id has the same text."""
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("sha"), text_failures(F.col(text)).alias("failed"),
    )
    rows = stage(rows, "audit-rows")
    known = rows.where(F.col("id").isNotNull())
    # only texts of several ids can fail the fifth filter, so only those are joined
    groups = known.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("_rows")).where("first < _last")
    groups = stage(groups.select("sha", "first", "_rows"), "audit-copies")
    # a text with more than one in HOT of the rows is looked up where its rows are; there are fewer than HOT such texts
    large = F.col("_rows") * HOT > rows.count()
    hot = F.broadcast(groups.where(large).select("sha", "first"))
    copied = known.join(hot, "sha").unionByName(
        known.join(hot.select("sha"), "sha", "left_anti").join(groups.where(~large).select("sha", "first"), "sha", "left")
    )
    marked = copied.select("id", "part", (F.col("failed") + _mask([F.coalesce(F.col("id") > F.col("first"), F.lit(False))], 4)).alias("failed"))
    said = labels.select(F.col(key).alias("id"), "quality", "toxic").groupBy("id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    labelled = marked.join(said.where(F.col("id").isNotNull()), "id", "left").select("part", "failed", "quality", "toxic")
    nameless = rows.where(F.col("id").isNull()).select("part", "failed", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    table = F.array(*[F.lit(w) for w in survival_words()])
    word = F.get(table, F.col("failed")).cast("long").alias("word")
    return labelled.unionAll(nameless).select("part", word, (F.coalesce("quality", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


def survivors(words: DataFrame) -> DataFrame:
    """(part, n): survivors of each subset of filters among all, good and toxic documents of a part, as
    one list in the order of LABELS."""
    size = 1 << MOST

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            word = batch["word"].to_numpy(zero_copy_only=False).astype(np.uint32)
            classes = [None, *[batch[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic")]]
            parts = batch["part"].dictionary_encode()
            names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            bounds = np.searchsorted(code[order], np.arange(len(names) + 1))
            for i, name in enumerate(names):
                mine = order[bounds[i] : bounds[i + 1]]
                counts = [positional_popcount(word[mine] if c is None else word[mine][c[mine]]) for c in classes]
                held[name] = held.get(name, 0) + np.concatenate(counts)
            if len(held) > PARTS_HELD:
                yield _counts_batch(held)
                held = {}
        if held:
            yield _counts_batch(held)

    partial = words.mapInArrow(counted, "part string, slot int, n long")
    summed = partial.groupBy("part", "slot").agg(F.sum("n").alias("n"))
    # as many entries for a part as there are slots
    listed = F.array_sort(F.collect_list(F.struct("slot", "n")))
    return summed.groupBy("part").agg(F.transform(listed, lambda s: s["n"]).alias("n")).where(F.size("n") == size * len(LABELS))


def _counts_batch(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    slots = len(LABELS) << MOST
    parts = pa.array(list(held)).take(np.repeat(np.arange(len(held)), slots))
    return pa.record_batch([parts, pa.array(np.tile(np.arange(slots, dtype=np.int32), len(held))), pa.array(np.concatenate(list(held.values())))], ["part", "slot", "n"])


def order_report(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step, from the subsets' survivors."""
    k, size = len(names), 1 << MOST
    every = (1 << k) - 1
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[i] for i in order), step, f, before))
            before |= 1 << f
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("f"), F.lit(b).alias("before")) for o, s, f, b in steps])

    def at(label: str, subset: Column | int) -> Column:
        place = F.lit(LABELS.index(label) * size)
        return F.get(F.col("n"), place + (subset if isinstance(subset, Column) else F.lit(subset)))

    def shapley(f: int) -> Column:
        total = F.lit(0).cast("long")
        for s in range(1 << k):
            if not s >> f & 1:
                held = s.bit_count()
                total = total + (at("all", s) - at("all", s | 1 << f)) * math.factorial(held) * math.factorial(k - 1 - held)
        return total

    each = [F.struct(
        (at("all", 0) - at("all", 1 << f)).alias("failing"), (at("all", every ^ 1 << f) - at("all", every)).alias("unique"), shapley(f).alias("shapley"),
    ) for f in range(k)]
    rows = counts.select("part", "n", F.array(*each).alias("each")).select("part", "n", "each", F.explode(plan).alias("s"))
    rows = rows.select("part", "n", "s.*", F.get(F.col("each"), F.col("s.f")).alias("own"))
    after = F.col("before") + F.get(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("f"))
    lost = {c: at(c, F.col("before")) - at(c, after) for c in LABELS}
    return rows.select(
        "part", "filter_order", "step", at("all", after).alias("kept"), lost["all"].alias("removed"),
        (F.col("own.failing") - lost["all"]).alias("redundant"), F.col("own.unique").alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.col("own.shapley").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The report over all orders of the five filters for each part of ``docs``."""
    return order_report(survivors(judged_documents(docs, labels, key, text, part)))


AUDIT_SQL = r"""
WITH said AS (
  SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
masks AS (
  SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(words.doc_id > first, false)::INT AS failed
  FROM words LEFT JOIN said ON words.doc_id = said.doc_id),
grouped AS (SELECT part, failed, count(*) AS n, sum(q) AS q, sum(x) AS x FROM masks GROUP BY ALL),
parts AS (SELECT DISTINCT part FROM grouped),
alive AS (
  SELECT part, s::INT AS s, sum(n) FILTER (WHERE failed & s::INT = 0) AS n, sum(q) FILTER (WHERE failed & s::INT = 0) AS q, sum(x) FILTER (WHERE failed & s::INT = 0) AS x
  FROM grouped, range(32) r(s) GROUP BY ALL),
n AS (SELECT part, s, coalesce(n, 0)::BIGINT AS n, coalesce(q, 0)::BIGINT AS q, coalesce(x, 0)::BIGINT AS x FROM alive),
f AS (SELECT substr('ABCDE', i + 1, 1) AS f, 1 << i AS b FROM (SELECT unnest(range(5))::INT AS i)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (
  SELECT filter_order, step::INT AS step, bs[step] AS b, coalesce(list_sum(bs[:step - 1]), 0)::INT AS before
  FROM orders, range(1, 6) r(step)),
base AS (
  SELECT parts.part, steps.*, m.n - k.n AS removed, k.n AS kept, m.q - k.q AS good_lost, m.x - k.x AS toxic_lost
  FROM parts, steps JOIN n m ON m.s = before JOIN n k ON k.s = before + b WHERE m.part = parts.part AND k.part = parts.part),
shap AS (SELECT part, b, sum(removed)::BIGINT AS shapley FROM base GROUP BY ALL),
own AS (
  SELECT a.part, f.b, a.n - o.n AS failing, r.n - e.n AS unique_fails
  FROM f, n a JOIN n o USING (part) JOIN n r USING (part) JOIN n e USING (part)
  WHERE a.s = 0 AND o.s = f.b AND r.s = 31 - f.b AND e.s = 31)
SELECT part, filter_order, step, kept, removed, failing - removed AS redundant, unique_fails, good_lost, toxic_lost, shapley
FROM base JOIN shap USING (part, b) JOIN own USING (part, b)
"""
