"""URL filter: rules by host and path, and logistic regression on hashed character n-grams (operator 7).

Host and path are cut out by column expressions. Their character n-grams (n from 3 to 5, of host and
path apart) are hashed into a fixed number of bins; a URL's features are its bins' counts over the root
of their sum of squares. The regression is fitted by gradient descent on a small labelled table; the
model is one array of weights.

Defined cases: a null URL or one without ``://`` has empty host and path, meets no rule and is judged on
the intercept alone; repeated rows are judged alike; empty tables give no rows; columns other than key
and URL play no part; labelled rows with null URL or a label other than 0 and 1 are left out; without
rows of both labels the model allows everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.arrowtext import mix, text_bytes
from postmill.llm.common import hash_sample

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS, SIZES = 1 << 14, (3, 4, 5)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruling(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. The rules are a parameter and
    become one ordered CASE; equal lengths go to the longer host, then the earlier rule."""
    chain = F
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        chain = chain.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return chain.otherwise(none) if rules else none


def url_bins(hosts: pa.Array, paths: pa.Array, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(URL number, bin) of every n-gram. Host and path are hashed with different seeds."""
    whose, where = [], []
    for seed, texts in enumerate((hosts, paths)):
        data, offsets = text_bytes(texts)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
        for n in SIZES:
            code = np.full(len(data), seed * 8 + n, np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + np.concatenate([data[k:], np.zeros(min(k, len(data)), np.uint8)])
            whole = left >= n
            whose.append(owner[whole])
            where.append((mix(code[whole]) % np.uint64(bins)).astype(np.int64))
    return np.concatenate(whose), np.concatenate(where)


def url_features(hosts: pa.Array, paths: pa.Array, bins: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(URL number, bin, value) with counts scaled to length 1 per URL."""
    whose, where = url_bins(hosts, paths, bins)
    pairs, counts = np.unique(whose * bins + where, return_counts=True)
    whose, where = pairs // bins, pairs % bins
    norm = np.sqrt(np.bincount(whose, counts.astype(float) ** 2, minlength=len(hosts)))
    return whose, where, counts / norm[whose]


class UrlModel(NamedTuple):
    weights: np.ndarray
    intercept: float

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        whose, where, value = url_features(hosts, paths, len(self.weights))
        logit = np.bincount(whose, value * self.weights[where], minlength=len(hosts)) + self.intercept
        return 1 / (1 + np.exp(-logit))


def fit_urls(labelled: DataFrame, max_rows: int = 10_000, rounds: int = 400, rate: float = 4.0, decay: float = 1e-3, url: str = "url", label: str = "blocked") -> UrlModel:
    """Full-batch gradient descent on at most ``max_rows`` labelled URLs, chosen by hash; that table is
    collected, so the parameter bounds what the driver holds."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isin(0, 1)).select(F.col(url).alias("url"), F.col(label).cast("int").alias("y"))
    got = hash_sample(rows, "url", max_rows).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "y").toArrow()
    y = got["y"].to_numpy().astype(float)
    weights, intercept = np.zeros(BINS), 0.0
    if not 0 < y.sum() < len(y):
        return UrlModel(weights, -10.0)
    whose, where, value = url_features(got["host"].combine_chunks(), got["path"].combine_chunks())
    for _ in range(rounds):
        logit = np.bincount(whose, value * weights[where], minlength=len(y)) + intercept
        error = 1 / (1 + np.exp(-logit)) - y
        weights -= rate * (np.bincount(where, value * error[whose], minlength=BINS) / len(y) + decay * weights)
        intercept -= rate * error.mean()
    return UrlModel(weights, float(intercept))


def url_score(host: Column, path: Column, model: UrlModel) -> Column:
    weights, intercept = model.weights.astype(np.float32), model.intercept

    @F.arrow_udf("double")
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(UrlModel(weights, intercept).score(hosts, paths))

    return score(host, path)


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score): the rule's verdict, else the model's (block from 0.5)."""
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = parts.withColumn("score", url_score(F.col("host"), F.col("path"), model)).withColumn("_ruling", ruling(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(key, "host", "path", F.col("_ruling.rule").alias("rule"), F.coalesce("_ruling.verdict", learned).alias("verdict"), "score")


#: A small labelled table to start from: words that stand for spam, gambling, fake pharmacies, adult pages
#: and trackers, against words of ordinary sites. URLs are made from them by rule.
BLOCKED_WORDS = (
    "casino-royal", "mega-casino", "sports-bets", "betting-free", "online-poker", "slot-jackpot", "win-big", "pills-shop",
    "cheap-meds", "viagra-cheap", "ad-tracker", "track-click", "ads-popup", "spam-links", "seo-spam", "content-farm",
    "link-farm", "adult-cams", "x-adult", "xxx-video", "hot-porn", "payday-loan", "replica-watches", "warez-crack", "free-keygen",
)
ALLOWED_WORDS = (
    "library", "museum", "weather", "gardening", "recipes", "history", "science", "travel", "health-clinic", "university",
    "city-council", "news-daily", "open-data", "school", "music", "maps", "forum", "docs", "journal", "archive", "theatre",
    "the-herald", "northern-post", "bibliotheque", "quotidien", "ayuntamiento", "noticias", "zeitung", "rathaus", "evening-standard",
    "another", "thinking", "interest", "nation", "other", "reading",
)


def seed_labels() -> list[tuple[str, int]]:
    """Labelled URLs (url, blocked), the same on every call."""
    hosts, tops, paths = ("www", "m", "blog"), ("com", "net", "org"), ("/en/12", "/de/345.html", "/fr/67/", "/es/890")
    out = []
    for words, blocked in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0)):
        for i, w in enumerate(words):
            out += [(f"http://{hosts[(i + j) % 3]}.{w}.example.{tops[(i + j) % 3]}{paths[(i + j) % 4]}", blocked) for j in range(3)]
            out.append((f"https://{w}.{tops[i % 3]}{paths[i % 4]}", blocked))
    return out
