"""Operators on DataFrame functions: sharding, quality rules, licence scan, mixing."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.llm import licenses, mixing, quality_rules, sharding
from postmill.llm.common import table
from postmill.llm.queries import QUERIES
from tests.llm.conftest import words

SPACE = re.compile("[\x20\x09-\x0d]+")


# --- sharding

def test_shards_of_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op1_hash_tree_shards"](spark, sf).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    for got in slots.values():
        assert [s for s, _ in sorted(got)] == list(range(len(got)))
        assert [d for _, d in sorted(got)] == sorted(d for _, d in got)


def test_weights_and_movement(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = [sharding.Shard(0, 0, 0, 1), sharding.Shard(0, 0, 1, 1), sharding.Shard(0, 1, 2, 2), sharding.Shard(1, 2, 3, 4), sharding.Shard(1, 2, 9, 0), sharding.Shard(1, 3, 8, None)]
    after = [s._replace(weight=3) if s.shard == 2 else s for s in before]
    got = keys.select(sharding.place(F.col("doc_id"), before).alias("x"), sharding.place(F.col("doc_id"), after).alias("y")).collect()
    share = Counter(r["x"] for r in got)
    assert set(share) == {0, 1, 2, 3}
    for shard, weight in ((0, 1), (1, 1), (2, 2), (3, 4)):
        assert abs(share[shard] / 20_000 - weight / 8) < 0.015
    # weight grew in region 0, rack 1: rows enter region 0, or rack 1 within it, and nothing else moves
    region = {s.shard: s.region for s in before}
    rack = {s.shard: s.rack for s in before}
    for r in got:
        if r["x"] != r["y"]:
            assert region[r["y"]] == 0 and (region[r["x"]] == 1 or rack[r["y"]] == 1)


@pytest.mark.parametrize("n", [16, 17, 20])
def test_one_more_shard(spark, n):
    keys = spark.range(3000)
    got = keys.select(sharding.place(F.col("id"), sharding.tree_for(n)).alias("x"), sharding.place(F.col("id"), sharding.tree_for(n + 1)).alias("y")).collect()
    assert {r["y"] for r in got if r["x"] != r["y"]} == {n}


def test_shards_of_odd_rows(odd_docs, no_docs):
    tree = sharding.tree_for(16)
    rows = sharding.assign_shards(odd_docs, tree, tree).collect()
    assert len(rows) == odd_docs.count()
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in rows if r["doc_id"] == 9}) == 1
    assert all((r["size"], r["text_crc32"]) == (1, 0) for r in rows if r["doc_id"] in (3, 4))
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign_shards(no_docs, tree, tree).count() == 0
    assert sharding.assign_shards(odd_docs, [], tree).where("shard IS NULL").count() == odd_docs.count()


# --- quality rules

def brute_stats(text):
    w = [x for x in SPACE.split(text or "") if x]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    missed = 0
    for r in QUERIES["op2_quality_rules"](spark, sf).collect():
        want = brute_stats(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
        if r["doc_id"] in labels and not r["base_failed"]:
            assert r["kept"] or not labels[r["doc_id"]]
            missed += r["kept"] and not labels[r["doc_id"]]
    assert missed <= 0.05 * len(labels)


def test_list_learns_both_patterns(spark, docs_of):
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        text = words(i, 100)
        if bad:
            text = text.replace(" ", "## ") if i % 2 else text.replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    found = quality_rules.fit_quality_rules(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert found.rules
    judged = quality_rules.judge_quality(docs_of(rows), found).select("doc_id", "quality_verdict.kept").collect()
    assert all(r["kept"] == (r["doc_id"] % 3 != 0) for r in judged)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit_quality_rules(odd_docs, none).rules == ()
    one_kind = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, quality int")
    assert quality_rules.fit_quality_rules(odd_docs, one_kind).rules == ()
    kept = quality_rules.drop_low_quality(odd_docs, none)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 1, 2, 9, 9, 8, None])  # the long text repeats its windows
    assert all(r["stats"] == "extra stats" for r in rows)
    assert quality_rules.drop_low_quality(no_docs, none).count() == 0
    stats = {r["doc_id"]: r["stats"] for r in quality_rules.judge_quality(odd_docs, quality_rules.DecisionList()).collect()}
    for r in odd_docs.where("doc_id IS NOT NULL AND doc_id <> 9").collect():
        got = stats[r["doc_id"]]
        assert tuple(got[c] for c in quality_rules.BASE) == brute_stats(r["text"])


# --- licences

def brute_places(text, templates):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    found = [(t.label, i) for t in templates for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
    return len(w), sorted(found)


def test_licence_places(spark, sf, odd_docs, docs_of):
    crafted = docs_of([
        (1, "MIT License mit license; CC-BY 4.0, cc by cc by-nc"), (2, "gnu General PUBLIC license version 3 gnu gnu general public license"),
        (3, "public license general gnu"), (4, "K mité license É apache  license, version 2.0"), (5, "apache licens"), (6, None), (7, ""),
    ])
    for docs in (crafted, odd_docs, table(spark, sf, "documents")):
        texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id <> 9").collect()}
        for r in licenses.scan_licences(docs).where("doc_id <> 9").collect():
            n, places = brute_places(texts[r["doc_id"]], licenses.TEMPLATES)
            assert (r["n_words"], sorted((p["label"], p["start"]) for p in r["places"])) == (n, places)
            assert 0 <= r["score"] <= 1 and (r["score"] == 1) == bool(places)


def test_whole_licences(docs_of):
    """Licence texts word for word, altered, twice and side by side; their rare words scattered; their phrases alone."""
    import random

    rnd = random.Random(6)
    rows, want = [], {}

    def add(text, found):
        want[len(rows)] = found
        rows.append((len(rows), text))

    for x in licenses.LICENCES:
        w = x.words
        add(" ".join(w), {(x.label, 0)})
        add(words(31, 300) + " " + x.text.upper() + ", " + words(32, 50), {(x.label, 300)})
        add(" ".join([*w, *["and"] * 500, *w]), {(x.label, 0), (x.label, len(w) + 500)})
        keep = {i for p in x.mandatory for i in range(licenses._offset(w, p.split()), licenses._offset(w, p.split()) + len(p.split()))}
        other = [v if i in keep or rnd.random() > 0.12 else f"other{i}" for i, v in enumerate(w)]
        first = licenses._offset(w, x.mandatory[0].split())
        add(words(33, 90) + " " + " ".join([*other[:first], *other[first:first + 9], "inserted", "words", *other[first + 9:]]), {(x.label, 90)})
        scattered = w[:]
        rnd.shuffle(scattered)
        add(" ".join(v + " " + words(40 + i % 7, 12) for i, v in enumerate(scattered)), set())
        add(words(35, 100) + " " + " ".join(x.mandatory) + " " + words(36, 100), set())
    add(" ".join(x.text for x in licenses.LICENCES), {(x.label, sum(len(y.words) for y in licenses.LICENCES[:i])) for i, x in enumerate(licenses.LICENCES)})
    add("merchantability unencumbered sublicense " * 3000, set())
    filler = [(1000 + i, words(500 + i, 60) + " the of and to is in a") for i in range(60)]
    got = {r["doc_id"]: {(p["label"], p["start"]) for p in r["licences"]} for r in licenses.scan_licences(docs_of(rows + filler)).collect()}
    wrong = {i: (got[i], w) for i, w in want.items() if got[i] != w}
    assert not wrong and not any(got[i] for i, _ in filler)


def test_licence_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["op3_license_scan"](spark, sf).collect():
        _, places = brute_places(texts[r["doc_id"]], licenses.BASE_TEMPLATES)
        starts = [s for _, s in places]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(starts), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for x, _ in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_licences_of_no_rows(no_docs):
    assert licenses.scan_licences(no_docs).count() == 0


# --- mixing

def test_poisson_inverse(spark):
    import math

    rates = spark.createDataFrame([("a", 0.3), ("b", 4.0), ("c", 900.0), ("d", 0.0)], "source string, mix_rate double")
    steps = {r["source"]: r["cdf"] for r in mixing.poisson_steps(rates).collect()}
    assert set(steps) == {"a", "b", "c"}
    for source, rate in (("a", 0.3), ("b", 4.0), ("c", 900.0)):
        total = 0.0
        for k, value in enumerate(steps[source]):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            assert abs(value - total) < 1e-9
        assert steps[source][-1] > 1 - 1e-10


def test_rates_reach_targets(spark, docs_of):
    docs = docs_of([(i, f"text {i}", "en", "big" if i % 10 else "small", 1) for i in range(6000)])
    mixed = mixing.poisson_mix(docs, mixing.target_rates(docs, {"big": 1.0, "small": 1.0, "absent": 5.0}))
    got = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(got["big"] - 3000) < 250 and abs(got["small"] - 3000) < 500
    per = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mix_copies").alias("c"), F.countDistinct("mix_copy").alias("d"))
    assert per.where("n <> c OR n <> d").count() == 0


def test_mixing_of_odd_rows(odd_docs, no_docs, monkeypatch):
    rates = mixing.tempered_rates(odd_docs, 0.5, 3.0)
    assert rates.count() == 4  # a, b, c and null
    few = mixing.poisson_mix(odd_docs, rates)
    assert "mix_copy" in few.columns and few.columns.count("mix_copy") == 1
    key = ["doc_id", "text", "source", "mix_copies", "mix_copy"]
    broad = Counter(map(tuple, few.select(*key).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", 0)
    salted = Counter(map(tuple, mixing.poisson_mix(odd_docs, rates).select(*key).collect()))
    assert broad == salted and all(v % 2 == 0 for k, v in broad.items() if k[0] == 1)
    assert mixing.poisson_mix(no_docs, mixing.tempered_rates(no_docs)).count() == 0
    assert mixing.poisson_mix(odd_docs, mixing.target_rates(odd_docs, {})).count() == 0
