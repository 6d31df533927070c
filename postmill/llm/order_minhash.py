"""Near-duplicate classes by order MinHash, verified by banded alignment (operator 9).

A text is its sequence of words (lower case, runs of letters and digits). Its k-mers are the runs of 16 bytes
that begin at each word, over the words with one blank between them, each labelled with its occurrence: the
second of two equal k-mers differs from the first. For each of several seeds a sketch takes the few k-mers with the smallest hashes and keeps them in text order,
so two texts share a sketch only if they hold the same sampled k-mers in the same order. Texts that share
a sketch are candidates. A candidate pair is verified by aligning the two sequences of words within a band:
the similarity is the longest common subsequence over the longer text, the share of words that one edit
script keeps. Pairs of 0.8 or more are linked; classes are the connected components.

Scale. Exact copies are collapsed first and are never paired. Texts that share a sketch are not paired
with each other: each bucket links its members to one leader, the member whose sketches occur most, and
components are built. In buckets that still hold several components each text outside the largest one meets a
member of that once more, drawn anew for each bucket. Texts of buckets that hold several even then go on, and with them all texts
that a pair with a text of under 40 words can hold, whatever they share. Among them, pairs from different
components are found by an exact prefix and position filter on their rarest words, which passes every pair
that can reach the threshold, and are verified. So no bucket is capped, and a pair that shares a
bucket or holds a short text is verified unless it is already in one class or proved to be below. Words
that many of these texts hold are counted where the texts are, and are joined in packs of up to 60 words of one
crowd of near-copies: two texts meet once for all such words of a crowd, in the last pack that they share.

No pair with a text of under 40 words is missed. Two longer texts with c k-mers of a union of u in
common (in one order) share none of the sketches with a chance of about (1 - (c / u)^3)^64. An edited word
breaks three or four k-mers: for words exchanged at random places a pair at 0.8 is missed with a chance of
about 18 %, one at 0.85 with 2 %, one at 0.9 with under 0.1 %; edits that stand together break fewer.

Defined cases: null and empty texts are copies of the empty text; texts without a word are only ever
copies; a k-mer ends with its text; a null id is an id; the class is named by its smallest
id (null only if all are); rows that repeat id and text are copies; an empty table gives no rows; columns
other than id and text play no part, whatever their names; very long texts are aligned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.arrowtext import mix, runs, text_bytes
from postmill.llm.common import whole_row
from postmill.session import Staging, stage

KMER, THRESHOLD = 16, 0.8
SKETCHES, SAMPLED = 64, 3
#: Texts of fewer words are paired by the exact filter, not by sketches alone.
SHORT = 40
#: Share of the rows, one in so many, from which a word is hot.
HOT = 2000
#: Texts from which a word is joined in a pack, and words of a pack: bits of a long.
OFTEN, PACK = 16, 60
#: Bytes of text whose hashes are held at once, and k-mers of one text whose hashes for all seeds are.
BYTES, TOGETHER = 1 << 20, 1 << 16

BASE = np.uint64(0x9E3779B97F4A7C15)
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Inverse of BASE modulo 2^64.
UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each word."""
    inside = WORD[data]
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets[:-1]] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    return np.flatnonzero(inside & (~before | starts_text[:-1])), np.flatnonzero(inside & (~after | starts_text[1:]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts in order, and the bounds between texts."""
    first, last = _edges(data, offsets)
    # hash of a word: its polynomial in BASE, from differences of one running sum
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)))])
    hashed = mix((running[last + 1] - running[first]) * _powers(UNDO, len(data))[first])
    return hashed, np.searchsorted(first, offsets)


def kmers(data: np.ndarray, offsets: np.ndarray, size: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of the k-mers of the texts in order, one for each word, and the bounds between texts."""
    first, last = _edges(data, offsets)
    bounds = np.searchsorted(first, offsets)
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    # the words with a blank behind each
    sizes = last - first + 2
    at = np.cumsum(sizes) - sizes
    joined = data[np.minimum(np.arange(at[-1] + sizes[-1]) + np.repeat(first - at, sizes), len(data) - 1)]
    joined[at + sizes - 1] = 32
    ends = np.append(at, len(joined))[bounds[1:]]
    left = np.repeat(ends, np.diff(bounds)) - at
    code = np.zeros(len(first), np.uint64)
    for k in range(0, size, 8):
        eight = np.zeros(len(first), np.uint64)
        for j in range(k, min(k + 8, size)):
            byte = joined[np.minimum(at + j, len(joined) - 1)].astype(np.uint64)
            byte[left <= j] = 0
            eight |= byte << np.uint64(8 * (j - k))
        code = mix(code * BASE + mix(eight))
    return labelled(code, bounds), bounds


def labelled(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The codes with their occurrence number among equal ones of the same text mixed in."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keyed = mix(code + owner.astype(np.uint64) * BASE)
    order = np.argsort(keyed, kind="stable")
    ranked = keyed[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    place = np.arange(len(ranked))
    nth = np.empty(len(ranked), np.uint64)
    nth[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return np.where(nth > 0, mix(code + nth * UNDO), code)


def _seeds(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * BASE)


def sketch(kmer: np.ndarray, sketches: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """One key for each seed: the hash of the sampled k-mers in text order. None for a text without words."""
    n = len(kmer)
    if not n:
        return np.zeros(0, np.int64)
    seeds, take = _seeds(sketches) | np.uint64(1), min(sampled, n)
    keys = np.empty(sketches, np.uint64)
    per = max(1, TOGETHER // n)
    for at in range(0, sketches, per):
        own = seeds[at : at + per]
        drawn = kmer[None, :] * own[:, None]  # the k-mers are mixed already
        row = np.arange(len(own))
        places = np.empty((len(own), take), np.int64)
        for t in range(take):
            places[:, t] = drawn.argmin(axis=1)
            drawn[row, places[:, t]] = MOST
        places.sort(axis=1)
        code = own.copy()
        for t in range(take):
            code = mix(code * BASE + kmer[places[:, t]])
        keys[at : at + per] = code
    return keys.view(np.int64)


def _common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of pairs within the band, a row of bits for each word of b."""
    bits: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        bits[x] = bits.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row, window = whole, (1 << 2 * band + 1) - 1
    for j, y in enumerate(b.tolist()):
        if y in bits:
            at = j - band
            hit = row & bits[y] & (window << at if at >= 0 else window >> -at)
            row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Longest common subsequence of two sequences of words over the longer one: an upper bound of it where
    that is below the threshold, a lower bound where that reaches it. Pairs of places off the diagonal by
    more words than the longer text may lose are outside the band."""
    longer = max(len(a), len(b))
    if not len(a) or not len(b):
        return 0.0
    need = max(1, ceil(threshold * longer - 1e-9))
    if min(len(a), len(b)) < need:
        return min(len(a), len(b)) / longer
    both = labelled(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    _, i, j = np.intersect1d(both[: len(a)], both[len(a) :], assume_unique=True, return_indices=True)
    if len(i) < need:
        return len(i) / longer
    band = longer - need
    near = np.abs(i - j) <= band
    other = j[near][np.argsort(i[near])]
    if len(other) < 2 or (other[1:] > other[:-1]).all():
        chain = len(other)
    else:
        tails: list[int] = []
        for x in other.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        chain = len(tails)
    if chain >= need:
        return chain / longer
    # equal ends are common; the rest is aligned
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    middle = _common(a[head : len(a) - tail], b[head : len(b) - tail], band)
    return (head + middle + tail) / longer


def sketches_of(text: Column) -> Column:
    """Struct of the number of words and the sketch keys of a lower-cased text."""

    @F.arrow_udf("n int, keys array<long>")
    def sketched(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        sizes, keys, ends = [], [np.zeros(0, np.int64)], [0]
        for a, b in runs(offsets, BYTES):
            kmer, bounds = kmers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for d in range(b - a):
                keys.append(sketch(kmer[bounds[d] : bounds[d + 1]]))
                ends.append(ends[-1] + len(keys[-1]))
            sizes.append(np.diff(bounds))
        n = pa.array(np.concatenate(sizes).astype(np.int32) if sizes else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
        return pa.StructArray.from_arrays([n, lists], ["n", "keys"])

    return sketched(text)


def words_of(text: Column) -> Column:
    """Occurrence-labelled words of a lower-cased text, in order."""

    @F.arrow_udf("array<long>")
    def listed(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        parts, ends = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for a, b in runs(offsets, BYTES):
            hashed, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append(labelled(hashed, bounds).view(np.int64))
            ends.append(bounds[1:] + ends[-1][-1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(parts)))

    return listed(text)


def aligned_similarity(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Similarity of two lower-cased texts, or a bound of it on its side of the threshold."""

    @F.arrow_udf("double")
    def aligned(left: pa.Array, right: pa.Array) -> pa.Array:
        sides = [text_bytes(left), text_bytes(right)]
        out = np.zeros(len(left))
        for at, to in runs(sides[0][1] + sides[1][1], BYTES):
            (x, xb), (y, yb) = (words(data[o[at] : o[to]], o[at : to + 1] - o[at]) for data, o in sides)
            for d in range(to - at):
                out[at + d] = similarity(x[xb[d] : xb[d + 1]], y[yb[d] : yb[d + 1]], threshold)
        return pa.array(out)

    return aligned(a, b)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): smallest node of each connected component, for all nodes that an edge (a, b) names
    but the roots themselves. Alternating star contraction: larger neighbours go to a node's smallest
    neighbour, then smaller ones, until nothing changes. Each round is written, and the one before deleted;
    minima combine before the shuffle, and joins on a hub split at run time."""
    hold = Staging(edges.sparkSession, "near-components")
    edges, before = hold(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    for _ in range(most):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = hold(large.where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = hold(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        hold.free_others(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Pairs are dealt by their node a, then by b; hubs split at run time."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.withColumn("_s", aligned_similarity(F.col("_a"), F.col("_b"), threshold)).where(F.col("_s") >= threshold).select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the root of their component; a node that no edge names is its own."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _rerooted(rooted: DataFrame, merged: DataFrame) -> DataFrame:
    """``rooted`` with the root of its root's component; a root that ``merged`` does not name stays."""
    return rooted.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root")


def _mixed(rooted: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components."""
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi")
    return rooted.join(mixed.select("key"), "key")


def link_texts(sketched: DataFrame, text_of: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of similar texts. ``sketched``: node (long), n words and keys of each different
    text; ``text_of`` gives (node, lower-cased text) for a table of nodes."""
    ratio, hold = F.lit(threshold), Staging(sketched.sparkSession, "near-links")
    rows = sketched.select("node", "n", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = hold(rows.join(sizes, "key"), "members")
    # the leader of a bucket: the member whose buckets are largest, then the smallest node
    hubs = members.groupBy("node").agg(F.sum("size").alias("hub"))
    ranked = hold(members.join(hubs, "node"), "ranked")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("hub", (-F.col("node")).alias("minus"), "n")).alias("top"))
    led = ranked.join(leaders.select("key", (-F.col("top.minus")).alias("leader"), F.col("top.n").alias("_n")), "key")
    near = F.least("n", "_n") >= ratio * F.greatest("n", "_n")
    stars = hold(led.where((F.col("leader") != F.col("node")) & near).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    hold.free(ranked)
    linked = hold(_verified(stars, hold(text_of(_named(stars)), "star-texts"), threshold), "linked")
    hold.free_others(members, stars, linked)
    roots = components(linked)
    # texts under SHORT and what they can link to; texts of fewer than the least only link to an equal sequence
    least = threshold / (1 - threshold) if threshold < 1 else SHORT
    short = sketched.where((F.col("n") >= least - 1e-6) & (F.col("n") * threshold < SHORT)).select("node", "n")
    rest = hold(_mixed(_rooted(members.select("key", "node", "n"), roots)), "mixed")
    every = hold(rest.select("node", "n", "root").unionAll(_rooted(short, roots).select("node", "n", "root")).distinct(), "every")
    own = hold(text_of(every.select("node")), "open-texts")
    hold.free(members)
    # once more with leaders drawn from the largest component of each bucket, so that few texts stay outside of it
    known = _both_ways(stars)
    drawn = hold(_drawn(rest, threshold).join(known, ["a", "b"], "left_anti"), "drawn")
    caught = hold(_verified(drawn, own, threshold), "caught")
    merged = hold(_merged(caught, every), "merged")
    still = _mixed(_rerooted(rest, merged))
    filtered = hold(still.select("node", "n", "root").unionAll(_rerooted(_rooted(short, roots), merged).select("node", "n", "root")).distinct(), "open")
    pairs = hold(_reachable(filtered, own, threshold).join(known.unionAll(_both_ways(drawn)), ["a", "b"], "left_anti"), "pairs")
    links = hold(linked.unionAll(caught).unionAll(_verified(pairs, own, threshold)), "links")
    found = components(links)
    hold.free_others()
    return found


def _drawn(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of near sizes of the members of each bucket outside its largest component with one member of that,
    drawn by hash: other buckets of the same texts draw others."""
    of_root = members.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("key", "node").alias("draw"), "node", "n")).alias("one")
    )
    leaders = of_root.groupBy("key").agg(F.max(F.struct("c", "root", "one")).alias("top"))
    led = members.join(leaders, "key").where(F.col("root") != F.col("top.root"))
    near = F.least("n", "top.one.n") >= threshold * F.greatest("n", "top.one.n")
    return led.where(near).select(F.col("node").alias("a"), F.col("top.one.node").alias("b")).distinct()


def _merged(links: DataFrame, rooted: DataFrame) -> DataFrame:
    """(node, root) of the components that links between nodes make of roots, for the roots that they merge."""
    of_a, of_b = (rooted.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return components(links.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _named(pairs: DataFrame) -> DataFrame:
    """The nodes that pairs (a, b) name."""
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()


def _reachable(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of open texts from different components that can reach the threshold, by prefix
    and position. Words are ordered by how few open texts have them. Texts that reach the threshold
    share one of the first n - threshold * n + 1; and if c of these are shared and the last of them is the i-th of one
    and the j-th of the other, they share at most c + min(n - i, m - j), which must be the threshold's share of the longer.
    For each word the component with most texts is not joined with itself, so a crowd of
    near-copies meets the few texts that are left of it, and is not paired. Words that OFTEN texts or more
    have in their prefix are packed with others of the same crowd, neighbours in the order of words."""
    hold = Staging(texts.sparkSession, "near-reach")
    open_texts = texts.join(nodes.select("node", "n", "root"), "node")
    sequences = hold(open_texts.select("node", "n", "root", words_of(F.col("text")).alias("words")), "words")
    listed = sequences.select("node", "n", "root", F.explode("words").alias("word"))
    shared = hold(listed.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    large = F.col("df") * HOT > (sequences.agg(F.sum(F.size("words"))).first()[0] or 0)  # fewer than HOT words
    lead = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    cold = listed.join(F.broadcast(shared.where(large).select("word")), "word", "left_anti")
    counted = cold.join(shared.where(~large), "word", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "word"))  # as many rows as the text has words
    ranked = counted.withColumn("i", rank).where((F.col("df") > 1) & (F.col("i") <= lead))
    # hot words come last: texts whose other words do not fill their prefix take the first of them
    hot = shared.where(large).agg(F.array_sort(F.collect_list(F.struct("df", "word")))["word"].alias("hot"))
    filled = cold.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    few = sequences.join(filled, "node", "left").withColumn("c", F.coalesce("c", F.lit(0))).where(F.col("c") < lead).crossJoin(F.broadcast(hot))
    led = F.slice(F.array_intersect("hot", "words"), F.lit(1), (lead - F.col("c")).cast("int"))
    last = few.select("node", "n", "root", "c", F.posexplode(led).alias("at", "word")).withColumn("i", (F.col("c") + F.col("at") + 1).cast("int"))
    columns = ("node", "n", "root", "word", "i")
    first = hold(ranked.select(*columns).unionAll(last.select(*columns)), "prefixes")
    hold.free_others(first, shared)
    # the component with most texts of each word; words of one component lead nowhere
    counts = first.groupBy("word", "root").agg(F.count(F.lit(1)).alias("c"))
    of_word = counts.groupBy("word").agg(
        F.max(F.struct("c", "root"))["root"].alias("crowd"), F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.sum("c").alias("texts")
    )
    crowds = hold(of_word.where("_lo <> _hi").select("word", "crowd", "texts"), "crowds")
    often = F.col("texts") >= OFTEN
    # joins of written tables, which split at run time where a word or a pack is hot
    left = hold(first.join(crowds.where(~often).select("word", "crowd"), "word").where("root <> crowd"), "left")
    packed = hold(_packed(first, crowds.where(often).join(shared, "word")), "packed")
    met = _met_by_word(left, first, threshold).unionAll(_met_by_pack(packed, threshold))
    pairs = met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("rest").alias("rest"), F.first("need").alias("need"))
    reached = hold(pairs.where("c + rest >= need - 1e-6").select("a", "b"), "reached")
    hold.free_others(reached)
    return reached


def _packed(first: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each text and pack of words (crowd, part) that it has in its prefix: a bit for each word, the
    places of these words in the text, and the numbers of its words in earlier and later packs of that crowd. Bits and
    places rise alike, as both follow the order of words."""
    nth = F.row_number().over(Window.partitionBy("crowd").orderBy("df", "word")) - 1  # as many rows as a crowd leads words
    dealt = words.select("word", "crowd", nth.alias("nth"))
    rows = first.select("node", "n", "root", "word", "i").join(dealt, "word")
    # as many rows in a group as the prefix of a text has words
    listed = rows.groupBy("node", "n", "root", "crowd").agg(F.array_sort(F.collect_list(F.struct("nth", "i"))).alias("words"))
    each = listed.withColumn("part", F.explode(F.array_distinct(F.transform("words.nth", lambda x: F.floor(x / PACK).cast("int")))))
    here = F.filter("words", lambda w: F.floor(w["nth"] / PACK) == F.col("part"))
    cut = each.withColumns({"here": here, "nths": F.col("words.nth")})
    bits = F.expr(f"aggregate(here, 0L, (b, w) -> b | shiftleft(1L, w.nth % {PACK}))").alias("bits")
    earlier = F.filter("nths", lambda x: x < F.col("part") * PACK).alias("earlier")
    later = F.filter("nths", lambda x: x >= (F.col("part") + 1) * PACK).alias("later")
    return cut.select("node", "n", "root", "crowd", "part", bits, F.col("here.i").alias("at"), earlier, later)


def _met_by_word(left: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """A row for each word of their prefixes that two texts share, of which one is outside the word's crowd."""
    columns = ("node", "n", "root", "i")
    x, y = _side(left, "x", columns, "word", "crowd"), _side(rows, "y", columns, "word")
    return _pairs(x.join(y, "word"), F.lit(1), F.col("i_x"), F.col("i_y"), threshold)


def _met_by_pack(packed: DataFrame, threshold: float) -> DataFrame:
    """A row for each crowd of whose packs two texts share words, in the last pack that they share: how many of all
    its packs, and what is left behind the last of them."""
    columns = ("node", "n", "root", "bits", "at", "earlier", "later")
    x, y = (_side(rows, side, columns, "crowd", "part") for rows, side in ((packed.where("root <> crowd"), "x"), (packed, "y")))
    both = F.col("bits_x").bitwiseAND(F.col("bits_y"))
    met = x.join(y, ["crowd", "part"]).where(both != 0).withColumn("both", both).withColumn("upto", F.expr("shiftleft(1L, length(bin(both))) - 1"))
    i, j = (F.expr(f"element_at(at_{side}, bit_count(bits_{side} & upto))") for side in "xy")
    shared, last = F.bit_count("both") + F.size(F.array_intersect("earlier_x", "earlier_y")), ~F.arrays_overlap("later_x", "later_y")
    return _pairs(met, shared, i, j, threshold, last)


def _side(rows: DataFrame, side: str, columns: tuple[str, ...], *shared: str) -> DataFrame:
    return rows.select(*shared, *[F.col(c).alias(f"{c}_{side}") for c in columns])


def _pairs(met: DataFrame, c: Column, i: Column, j: Column, threshold: float, *also: Column) -> DataFrame:
    """Of texts that meet, those of different components and near sizes, once, if ``also`` holds: the words ``c`` that
    they share here, the most that they can share behind places i and j, and what they must share."""
    need = F.greatest("n_x", "n_y") * threshold
    rest = F.least(F.col("n_x") - i, F.col("n_y") - j)
    sized = F.least("n_x", "n_y") >= need - 1e-6
    # two texts outside the crowd would meet from both sides
    once = (F.col("root_y") == F.col("crowd")) | (F.col("node_y") < F.col("node_x"))
    whole = reduce(Column.__and__, also, (F.col("root_x") != F.col("root_y")) & sized & once)
    return met.where(whole).select(
        F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b"), c.cast("long").alias("c"), rest.alias("rest"), need.alias("need")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: key, text_sha256, class_id (smallest id of the class), class_rows,
    class_texts (different texts) and is_first (the class's smallest id; of texts that share it the
    first by hash). Texts are read twice, for sketches and for the candidates' alignment."""
    rows = docs.select(F.col(key).alias("id"), _sha(F.col(text)).alias("sha"), lowered(F.col(text)).alias("text"))
    drawn = rows.select("id", "sha", sketches_of(F.col("text")).alias("s"))
    drawn = stage(drawn.select("id", "sha", "s.n", "s.keys"), "near-sketches")
    copies = drawn.groupBy("sha").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = stage(copies.withColumn("node", F.monotonically_increasing_id()), "near-copies")

    def text_of(nodes: DataFrame) -> DataFrame:
        # the row with the text's first id; rows that repeat id and text count once
        firsts = texts.join(nodes, "node").select("node", F.col("sha").alias("_sha"), F.col("id").alias("_id"))
        found = rows.join(firsts, (F.col("sha") == F.col("_sha")) & F.col("id").eqNullSafe(F.col("_id")))
        return found.groupBy("node").agg(F.first("text").alias("text"))

    roots = link_texts(texts.select("node", "n", "keys"), text_of, threshold)
    rooted = stage(_rooted(texts.select("node", "sha", "id", "rows"), roots), "near-rooted")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sha")).alias("first")
    classes = rooted.groupBy("root").agg(first, F.sum("rows").alias("class_rows"), F.count(F.lit(1)).alias("class_texts"))
    named = rooted.select("sha", "root").join(stage(classes, "near-classes"), "root").drop("root")
    return drawn.select("id", "sha").join(named, "sha").select(
        F.col("id").alias(key), F.col("sha").alias("text_sha256"), F.col("first.id").alias("class_id"), "class_rows", "class_texts",
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sha") == F.col("first.sha"))).alias("is_first"),
    )


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline step: one document of each class, its first; columns as given. Of rows that repeat id and
    text one stays; the join has dealt them together, so this costs no further shuffle."""
    found = near_duplicates(docs, key, text, threshold)
    first = found.where("is_first").select(F.col(key).alias("_id"), F.col("text_sha256").alias("_of")).distinct()
    marked = docs.select(whole_row(docs), _sha(F.col(text)).alias("sha"), F.col(key).alias("id"))
    kept = marked.join(first, (F.col("sha") == F.col("_of")) & F.col("id").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["_of", "_id"]).select("row.*")
