"""Language identification as mixture inference (operator 10).

A language is a distribution over hashed byte trigrams. A document is a mixture of languages: expectation
maximisation estimates their proportions from its trigrams' likelihoods, and the set of languages is the
one with the best penalised likelihood, grown from the best single language. The mixture likelihood is
concave, so a document is settled without iterations when no other language could raise it by more than
the penalty: the gain is at most n times the mean likelihood ratio less one.

Shares say which language fits best, not whether any does. A model learned with floors also judges that:
each language has a least mean log likelihood per trigram, half-way from what sampled texts of it reach
under models that have not seen them down to what the same texts reach with their characters shuffled. A
text fits if it reaches its languages' floors by their shares; the entropy of the shares is what mixing
alone costs, so texts in several languages fit, and short texts have the slack of their few trigrams.

Defined cases: null texts and texts without a letter are ``und`` with score 0; texts under three bytes
are judged on zero-filled trigrams; equal likelihoods go to the language that sorts first; null
languages are not learned; a language with too few texts to hold some out has a low floor; without learnable rows everything is ``und``; repeated rows are judged alike;
an empty table gives no rows; columns other than key, text and the learned language play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.arrowtext import runs, text_bytes
from postmill.llm.common import whole_row
from postmill.session import stage

BINS = 1 << 13
#: Bytes that are held with their likelihoods at once.
BYTES = 1 << 18
#: A language must raise the log likelihood by this many times the logarithm of the number of trigrams.
PENALTY = 8.0
#: Parts of the sample that are held out in turn for the floors.
FOLDS = 4
#: Standard deviations of a text's mean that it may lie below the floor.
SLACK = 3.0
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")

#: Bytes as the trigrams see them: lower case; digits, ASCII marks and controls all as a space.
SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


class Languages(NamedTuple):
    names: tuple[str, ...]
    prob: np.ndarray  # bin, language
    floor: np.ndarray | None = None  # least mean log likelihood of each language


def trigram_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams of the texts in order, and the offsets between texts. A text of n bytes has
    max(1, n) trigrams: one from each byte, with spaces beyond the end."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths, 1)
    ends = np.cumsum(counts)
    seen = np.full(int(ends[-1]) + 2 if len(ends) else 2, 32, np.uint32)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(data)) - offsets[owner] + (ends - counts)[owner]
    seen[place] = SEEN[data]
    n = len(seen) - 2
    second, third = seen[1 : n + 1].copy(), seen[2 : n + 2].copy()
    second[ends - 1] = 32  # trigrams don't reach into the next text
    third[ends - 1] = 32
    third[np.maximum(ends - 2, 0)[counts > 1]] = 32
    code = seen[:n] | (second << np.uint32(8)) | (third << np.uint32(16))
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64), np.concatenate([[0], ends])


def learn_languages(docs: DataFrame, per_language: int = 400, key: str = "doc_id", text: str = "text", lang: str = "lang", floors: bool = False) -> Languages:
    """Distributions from at most ``per_language`` documents of each language, chosen by hash. Ids are
    chosen first, then the chosen texts' trigrams are counted on the executors; the driver holds one row
    of bins for each language. All rows are counted by language; a hash limit set from the counts leaves
    about twice the wanted ids of each language, so no language gathers in one task before it is ranked.
    With ``floors`` the sample is staged, counted in FOLDS parts and read again to learn them."""
    named = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"))
    counts = named.groupBy("_lang").agg(F.count(F.lit(1)).alias("_rows"))
    draw = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    few = named.withColumn("_draw", draw).join(F.broadcast(counts), "_lang")  # a row for each language, as the model has
    few = few.where(F.col("_draw") * F.col("_rows") <= 2 * per_language + 20).select("_key", "_lang", "_draw").distinct()
    order = Window.partitionBy("_lang").orderBy("_draw", "_key")
    chosen = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).select("_key", "_lang")
    rows = docs.select(F.col(key).alias("_id"), F.col(lang).alias("_of"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    sample = rows.join(F.broadcast(chosen), (F.col("_id") == F.col("_key")) & (F.col("_of") == F.col("_lang")))
    part = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(13)), F.lit(FOLDS)) if floors else F.lit(0)
    sample = sample.select("_lang", "_text", part.cast("int").alias("_part"))
    if floors:
        sample = stage(sample, "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_bytes(batch.column(1))
            bins, bounds = trigram_bins(data, offsets)
            parts = np.array(batch.column(2))
            whose, part = np.repeat(names, np.diff(bounds)), np.repeat(parts, np.diff(bounds))
            for name, p in sorted(set(zip(names, parts.tolist()))):
                n = np.bincount(bins[(whose == name) & (part == p)], minlength=BINS)
                hit = np.flatnonzero(n)
                columns = [pa.array([name] * len(hit), pa.string()), pa.array([p] * len(hit), pa.int32()), pa.array(hit), pa.array(n[hit])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "part", "bin", "n"])

    counted = sample.mapInArrow(count, "lang string, part int, bin long, n long").groupBy("lang", "part", "bin").agg(F.sum("n").alias("n"))
    got = counted.groupBy("lang", "part").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns")).collect()
    names = tuple(sorted({r["lang"] for r in got}))
    tables = np.zeros((FOLDS if floors else 1, BINS, len(names)))
    for r in got:
        tables[r["part"], np.array(r["bins"]), names.index(r["lang"])] = r["ns"]

    def model(table: np.ndarray) -> Languages:
        return Languages(names, (table + 0.1) / (table + 0.1).sum(axis=0, keepdims=True))

    whole = tables.sum(axis=0)
    if not floors:
        return model(whole)
    return model(whole)._replace(floor=_floors(sample, names, [model(whole - t) for t in tables]))


def _floors(sample: DataFrame, names: tuple[str, ...], without: list[Languages]) -> np.ndarray:
    """Half-way between the median fits of each language's texts (_lang, _text, _part), as they are and with
    their characters shuffled, under the models ``without`` their part."""

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, part = batch.column(1), np.array(batch.column(2))
            shuffled = pa.array(["".join(np.random.default_rng(len(t)).permutation(list(t))) for t in texts.to_pylist()], pa.string())
            both = np.zeros((2, len(texts)))
            for p in set(part.tolist()):
                at = np.flatnonzero(part == p)
                for side, of in enumerate((texts, shuffled)):
                    both[side, at] = judge(without[p], *text_bytes(of.take(pa.array(at))))[2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[0]), pa.array(both[1])], ["lang", "own", "shuffled"])

    found = sample.where(F.length("_text") > 0).mapInArrow(fits, "lang string, own double, shuffled double")
    middle = {r["lang"]: (r["own"] + r["shuffled"]) / 2 for r in found.groupBy("lang").agg(*[F.percentile_approx(c, 0.5).alias(c) for c in ("own", "shuffled")]).collect()}
    return np.array([middle.get(n, -np.log(BINS)) for n in names])


def mixture(prob: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Proportions by expectation maximisation, and their log likelihood. ``prob``: distinct trigram by language."""
    n = counts.sum()
    for _ in range(rounds):
        joint = prob * share
        new = (joint * (counts / joint.sum(axis=1))[:, None]).sum(axis=0) / n
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(counts @ np.log(prob @ share))


def language_set(prob: np.ndarray, counts: np.ndarray, best: int, penalty: float) -> np.ndarray:
    """Proportions of all languages; those outside the selected set are 0."""
    n, chosen = counts.sum(), [best]
    share = np.array([1.0])
    likelihood = float(counts @ np.log(prob[:, best]))
    while len(chosen) < prob.shape[1]:
        ratio = (prob * (counts / (prob[:, chosen] @ share))[:, None]).sum(axis=0) / n
        ratio[chosen] = 0
        new = int(ratio.argmax())
        if n * (ratio[new] - 1) <= penalty:
            break
        start = np.append(share * 0.8, 0.2)
        tried, gained = mixture(prob[:, [*chosen, new]], counts, start)
        if gained - likelihood <= penalty:
            break
        chosen, share, likelihood = [*chosen, new], tried, gained
    out = np.zeros(prob.shape[1])
    out[chosen] = share
    return out


def proportions(model: Languages, data: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(proportion, chance among single languages) of each language for each text."""
    return judge(model, data, offsets, penalty)[:2]


def judge(model: Languages, data: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(proportion, chance among single languages) of each language for each text, and each text's fit (mean
    log likelihood of its trigrams under the selected mixture, plus the entropy of the shares) and number of trigrams."""
    n, k = len(offsets) - 1, len(model.names)
    share, chance, fit, trigrams = np.zeros((n, k)), np.zeros((n, k)), np.zeros(n), np.ones(n)
    log_prob = np.log(model.prob)
    for a, b in runs(offsets, BYTES):
        bins, bounds = trigram_bins(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        sizes = np.diff(bounds)
        likelihood = np.zeros((b - a, k))
        mean_ratio = np.zeros((b - a, k))
        owner = np.repeat(np.arange(b - a), sizes)
        pieces = [(at, min(at + BYTES, len(bins))) for at in range(0, len(bins), BYTES)]  # one long text in parts
        for x, y in pieces:
            for i in range(k):
                likelihood[:, i] += np.bincount(owner[x:y], log_prob[:, i][bins[x:y]], minlength=b - a)
        best = likelihood.argmax(axis=1)
        fit[a:b], trigrams[a:b] = likelihood.max(axis=1) / sizes, sizes
        for x, y in pieces:
            own = model.prob[bins[x:y], best[owner[x:y]]]
            for i in range(k):
                mean_ratio[:, i] += np.bincount(owner[x:y], model.prob[:, i][bins[x:y]] / own, minlength=b - a)
        mean_ratio /= sizes[:, None]
        bar = penalty * np.log(sizes + 1.0)
        mean_ratio[np.arange(b - a), best] = 0
        share[a + np.arange(b - a), best] = 1
        for d in np.flatnonzero(sizes * (mean_ratio.max(axis=1) - 1) > bar):
            hit, counts = np.unique(bins[bounds[d] : bounds[d + 1]], return_counts=True)
            share[a + d] = language_set(model.prob[hit], counts.astype(float), int(best[d]), float(bar[d]))
            some = share[a + d][share[a + d] > 0]
            fit[a + d] = counts @ np.log(model.prob[hit] @ share[a + d]) / sizes[d] - some @ np.log(some)
        # neighbouring trigrams share bytes, so a third of the log likelihood counts
        chance[a:b] = np.exp((likelihood - likelihood.max(axis=1, keepdims=True)) / 3)
    return share, chance / np.maximum(chance.sum(axis=1, keepdims=True), 1e-300), fit, trigrams


def fitting(model: Languages, share: np.ndarray, fit: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """Whether each text reaches the floors of its languages; all do where the model has none."""
    if model.floor is None:
        return np.ones(len(fit), bool)
    log_prob = np.log(model.prob)
    mean = (model.prob * log_prob).sum(axis=0)
    deviation = np.sqrt((model.prob * (log_prob - mean) ** 2).sum(axis=0))
    # as above, a third of the trigrams count
    return fit >= share @ model.floor - SLACK * (share @ deviation) * np.sqrt(3 / trigrams)


def detect(text: Column, model: Languages, penalty: float = PENALTY) -> Column:
    """Struct: lang, score (the language's proportion times its chance against other single languages, or
    its proportion in a mixture), langs and shares of the selected set, largest first, and fits (the text
    reaches their floors). The model, one column of bins for each language, travels with the function."""

    @F.arrow_udf("lang string, score double, langs array<string>, shares array<double>, fits boolean")
    def judged(texts: pa.Array) -> pa.Array:
        names = model.names
        letters = [bool(names) and t.is_valid and LETTER.search(t.as_py()) is not None for t in texts]
        share, chance, known = np.zeros((len(texts), 0)), np.zeros((len(texts), 0)), np.zeros(len(texts), bool)
        if names and len(texts):
            share, chance, fit, trigrams = judge(model, *text_bytes(texts), penalty)
            known = fitting(model, share, fit, trigrams) & np.array(letters)
        lang, score, langs, shares = [], [], [], []
        for d, ok in enumerate(letters):
            order = [i for i in np.argsort(-share[d], kind="stable") if share[d, i] > 0] if ok else []
            lang.append(names[order[0]] if order else UNDETERMINED)
            score.append(float(share[d, order[0]] * (chance[d, order[0]] if len(order) == 1 else 1)) if order else 0.0)
            langs.append([names[i] for i in order])
            shares.append([float(share[d, i]) for i in order])
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(known)],
            ["lang", "score", "langs", "shares", "fits"],
        )

    return judged(text)


def drop_undetermined(docs: DataFrame, model: Languages, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """Pipeline step: documents that fit the known languages, where the model has floors, and of which one
    holds at least ``min_score``; columns as given."""
    found = docs.select(whole_row(docs), detect(F.col(text), model).alias("found"))
    return found.where((F.col("found.lang") != UNDETERMINED) & (F.col("found.score") >= min_score) & F.col("found.fits")).select("row.*")
