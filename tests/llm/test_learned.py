"""URL filter, quality network and language mixtures: contracts, held-out accuracy, odd rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.llm import langid, quality_cnn, url_filter
from postmill.llm.arrowtext import text_bytes
from postmill.llm.common import table
from postmill.llm.queries import QUERIES
from tests.llm.conftest import LONG, words

HELD_OUT_SF = "/root/testdata/sf0.01"


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


# --- URLs

def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/x?y#z", "https://www.example.com/en/1", "https://example.com/en/", "https://notexample.com/en/",
    "http://WWW.EXAMPLE.com/EN/", "ftp://u:p@b.example.com:80/en/x", "x://a://b/c", "http://example.net/es/1", "http://net/fr/2", "http://a.net/fr", "http://a.net?/es/", "http://a\nb.com/\nx", "http://É.com/",
]


def test_urls_by_rule(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, score string")
    model = url_filter.UrlModel(np.zeros(url_filter.BINS), -1.0)
    for r in url_filter.judge_urls(df, model).collect():
        host, path, rule = brute_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else "allow")
    assert url_filter.judge_urls(df.limit(0), model).count() == 0


def test_url_model_learns_and_generalises(spark):
    labelled = spark.createDataFrame(url_filter.seed_labels() + [(None, 1), ("http://x.org/", None), ("http://y.org/", 5)], "url string, blocked int")
    model = url_filter.fit_urls(labelled)
    unseen = {"https://grand-casino.example.org/a": 1, "http://cheap-viagra-pills.net/en/": 1, "https://adult-video.org/": 1, "https://library-of-science.org/en/": 0, "http://www.museum-history.net/de/4": 0}
    hosts, paths = (pa.array([brute_url(u)[i] for u in unseen]) for i in (0, 1))
    assert ((model.score(hosts, paths) >= 0.5) == list(unseen.values())).all()
    assert model.score(pa.array([""]), pa.array([""]))[0] < 0.5
    one_kind = url_filter.fit_urls(labelled.where("blocked = 0"))
    assert (one_kind.score(hosts, paths) < 0.5).all()


def test_url_query(spark, sf):
    urls = {r["page_id"]: r["url"] for r in table(spark, sf, "pages").collect()}
    for r in QUERIES["op7_url_filter"](spark, sf).collect():
        host, path, rule = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["score"] >= 0.5 else "allow")


# --- network

def brute_probability(net, text):
    data = text.encode()
    windows = max(1, len(data) - quality_cnn.WIDTH + 1)
    data = data + bytes(quality_cnn.WIDTH)
    response = np.array([sum(net.table[j][data[i + j]] for j in range(quality_cnn.WIDTH)) for i in range(windows)])
    chunks = [response[i : i + quality_cnn.CHUNK].max(axis=0) for i in range(0, windows, quality_cnn.CHUNK)]
    features = np.mean([np.maximum(c + net.shift, 0) for c in chunks], axis=0)
    return 1 / (1 + np.exp(-(features @ net.weight + net.intercept)))


def test_network_covers_whole_texts(monkeypatch):
    rng = np.random.default_rng(1)
    net = quality_cnn.Network(rng.normal(0, 1, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), rng.normal(0, 1, quality_cnn.FILTERS), rng.normal(0, 1, quality_cnn.FILTERS), 0.3)
    texts = ["", "a", "ab", "abcd", "é中", words(3, 400), "x" * 511, "x" * 515 + "!", words(4, 90)]
    want = [brute_probability(net, t) for t in texts]
    for windows in (1 << 17, 600):
        monkeypatch.setattr(quality_cnn, "WINDOWS", windows)
        assert np.allclose(quality_cnn.probabilities(net, pa.array(texts)), want, atol=1e-4)
    assert np.allclose(quality_cnn.probabilities(net, pa.array([None, ""])), want[0], atol=1e-6)
    # the end of a long text counts
    assert quality_cnn.probabilities(net, pa.array([LONG]))[0] != quality_cnn.probabilities(net, pa.array([LONG + "\x07\x07\x07\x07"]))[0]


def test_quality_held_out(spark):
    rows = QUERIES["op8_byte_cnn"](spark, HELD_OUT_SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, HELD_OUT_SF, "labels").collect()}
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_network_of_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    net = quality_cnn.fit_quality(odd_docs, none)
    assert {r[0] for r in odd_docs.select(quality_cnn.quality_score(F.col("text"), net)).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1), (2, 0), (9, 0), (9, 1)], "doc_id long, quality int")
    net = quality_cnn.fit_quality(odd_docs, both, epochs=1)
    scores = [r[0] for r in odd_docs.select(quality_cnn.quality_score(F.col("text"), net)).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    assert no_docs.select(quality_cnn.quality_score(F.col("text"), net)).count() == 0


# --- languages

def test_trigrams_stay_within_texts():
    texts = ["abc", "", "x", "abcd", "zz", "é!9"]
    data, offsets = text_bytes(pa.array(texts))
    bins, bounds = langid.trigram_bins(data, offsets)
    for i, t in enumerate(texts):
        alone, _ = langid.trigram_bins(*text_bytes(pa.array([t])))
        assert bins[bounds[i] : bounds[i + 1]].tolist() == alone.tolist() and len(alone) == max(1, len(t.encode()))


def toy(spark, docs_of):
    rows = [(i, words(i, 60), "en") for i in range(30)] + [(100 + i, words(i, 60).translate(str.maketrans("aeost", "uizkv")), "xx") for i in range(30)]
    return docs_of(rows + [(500, "text without language", None), (None, "no id", "en")])


def test_mixtures_are_found(spark, docs_of, monkeypatch):
    model = langid.learn_languages(toy(spark, docs_of))
    assert model.names == ("en", "xx")
    one, two = words(77, 200), words(78, 100).translate(str.maketrans("aeost", "uizkv"))
    for size in (1 << 18, 64):
        monkeypatch.setattr(langid, "BYTES", size)
        share, chance = langid.proportions(model, *text_bytes(pa.array([one, two, one + " " + two, "", "the"])))
        assert share[0].tolist() == [1, 0] and share[1].tolist() == [0, 1]
        assert 0.55 < share[2][0] < 0.78 and abs(share[2].sum() - 1) < 1e-6
        assert np.allclose(chance.sum(axis=1), 1)


def test_settled_texts_need_no_iterations(spark, docs_of):
    """The bound that skips iterations never hides a gain above the penalty."""
    model = langid.learn_languages(toy(spark, docs_of))
    for text in [words(5, 40), words(6, 30) + words(7, 4).translate(str.maketrans("aeost", "uizkv")), "the an"]:
        bins, _ = langid.trigram_bins(*text_bytes(pa.array([text])))
        share, _ = langid.proportions(model, *text_bytes(pa.array([text])))
        hit, counts = np.unique(bins, return_counts=True)
        best = int(np.argmax(counts @ np.log(model.prob[hit])))
        _, mixed = langid.mixture(model.prob[hit], counts.astype(float), np.array([0.5, 0.5]), 500)
        gain = mixed - counts @ np.log(model.prob[hit][:, best])
        assert (share[0] > 0).sum() == 1 or gain > langid.PENALTY * np.log(len(bins))


def test_languages_held_out(spark):
    rows = QUERIES["op10_language_mixture"](spark, HELD_OUT_SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in table(spark, HELD_OUT_SF, "documents").collect()}
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.98


def test_languages_of_odd_rows(spark, odd_docs, no_docs, docs_of):
    model = langid.learn_languages(odd_docs)
    assert model.names == ("de", "en", "fr")
    got = {(r["doc_id"], r["text"]): r["found2"] for r in odd_docs.withColumn("found2", langid.detect(F.col("text"), model)).collect()}
    assert all(f["lang"] in model.names or f["lang"] == "und" and f["score"] == 0 for f in got.values())
    assert all((f["lang"] == "und") == (t is None or not any(c.isalpha() for c in t)) for (_, t), f in got.items())
    kept = langid.drop_undetermined(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.where("found <> 'extra found'").count() == 0
    empty = langid.learn_languages(no_docs)
    assert {r["lang"] for r in odd_docs.select(langid.detect(F.col("text"), empty).alias("f")).select("f.lang").collect()} == {"und"}
    assert langid.drop_undetermined(no_docs, model).count() == 0


def test_unlearned_languages_are_dropped(spark, docs_of):
    """Texts in an unlearned language and of random letters go; texts in one or two learned languages stay."""
    import random

    import corpus_pipeline

    rnd = random.Random(4)
    learned = [r["text"] for r in table(spark, HELD_OUT_SF, "documents").where("lang IN ('en', 'de') AND length(text) > 600").orderBy("doc_id").limit(40).collect()]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. "
    letters = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(2, 10))) for _ in range(150))
    swapped = learned[0].lower().translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "qzjxkvwpybgfumcdhlnrtsioea"))
    odd = [polish, polish * 5, russian * 3, letters, swapped]
    mixed = [learned[i] + "\n" + learned[-1 - i] for i in range(10)]
    known = table(spark, HELD_OUT_SF, "documents")
    added = docs_of([(10**9 + i, t, None, "added", len(t)) for i, t in enumerate(odd + mixed)])
    kept = corpus_pipeline.language(spark, known.unionByName(added.select(known.columns)), HELD_OUT_SF)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {i for i in ids if i >= 10**9} == {10**9 + i for i in range(len(odd), len(odd + mixed))}
    assert ids >= {r["doc_id"] for r in known.where("length(text) > 0").select("doc_id").collect()}
