"""Near-duplicate classes against all pairs, and the pipeline."""

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.llm import order_minhash as near
from postmill.llm.arrowtext import text_bytes
from postmill.llm.common import table
from postmill.llm.queries import QUERIES
from tests.llm.conftest import words

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def brute_words(text):
    return WORD.findall((text or "").lower())


def common(a, b):
    """Length of the longest common subsequence: longest increasing run of places in b, taken backwards for each word of a."""
    places, tails = defaultdict(list), []
    for j, y in enumerate(b):
        places[y].append(j)
    for x in a:
        for j in reversed(places.get(x, ())):
            at = bisect_left(tails, j)
            tails[at : at + 1] = [j]
    return len(tails)


def brute_similarity(a, b):
    if not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return 0.0
    if sum((Counter(a) & Counter(b)).values()) < 0.8 * max(len(a), len(b)):
        return 0.0
    return common(a, b) / max(len(a), len(b))


def brute_classes(rows):
    """Smallest id of each row's class, from all pairs of texts."""
    texts = sorted({t or "" for _, t in rows})
    parts = [brute_words(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            low, high = sorted((len(parts[i]), len(parts[j])))
            if low >= 0.8 * high and brute_similarity(parts[i], parts[j]) >= 0.8:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for d, t in rows:
        ids[find(texts.index(t or ""))].append(d)
    return [min((d for d in ids[find(texts.index(t or ""))] if d is not None), default=None) for _, t in rows]


def edited(text, n, rnd):
    w = text.split()
    for _ in range(n):
        at = rnd.randrange(len(w))
        w[at : at + 1] = rnd.choice([[], [f"new{rnd.random()}"], [w[at], f"more{rnd.random()}"]])
    return " ".join(w)


@pytest.fixture(scope="module")
def crowd():
    """A group of near copies with few to many edits, a passage that many texts share, copies, short texts."""
    rnd = random.Random(8)
    base, passage = words(1000, 150), words(2000, 40)
    texts = [edited(base, n % 9, rnd) for n in range(150)] + [base] * 20
    texts += [words(3000 + i, 15 + i % 30) + " " + passage + " " + words(4000 + i, 20) for i in range(60)]
    texts += [words(5000 + i, n) for i, n in enumerate([1, 2, 4, 5, 6, 7, 300])] * 2
    for i in range(40):
        a = words(6000 + i, 60 + 7 * i)
        texts += [a, edited(a, 1 + i % 4, rnd), a.upper() + "!"]
    order = list(enumerate(texts))
    rnd.shuffle(order)
    return [(i, t) for i, (_, t) in enumerate(order)]


def test_classes_like_all_pairs(crowd, docs_of):
    got = near.near_duplicates(docs_of(crowd)).collect()
    want = dict(zip([d for d, _ in crowd], brute_classes(crowd)))
    wrong = {r["doc_id"]: (want[r["doc_id"]], r["class_id"]) for r in got if want[r["doc_id"]] != r["class_id"]}
    assert len(got) == len(crowd) and not wrong
    sizes = Counter(want.values())
    assert all(r["class_rows"] == sizes[r["class_id"]] for r in got)
    assert {r["doc_id"] for r in got if r["is_first"]} == set(want.values())


def test_classes_of_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_order_minhash"](spark, sf).collect()}
    assert got == dict(zip([d for d, _ in rows], brute_classes(rows)))


def test_classes_of_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = Counter(zip([(r["doc_id"], r["text"]) for r in rows], brute_classes([tuple(r) for r in rows])))
    got = near.near_duplicates(odd_docs)
    texts = {near_sha(r["text"]): r["text"] or "" for r in rows}
    assert Counter(((r["doc_id"], texts[r["text_sha256"]]), r["class_id"]) for r in got.collect()) == Counter({((d, t or ""), c): n for ((d, t), c), n in _merge(want).items()})
    kept = near.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("node <> 'extra node'").count() == 0
    assert near.near_duplicates(no_docs).count() == 0 and near.drop_near_duplicates(no_docs).count() == 0


def near_sha(text):
    import hashlib

    return hashlib.sha256((text or "").encode()).hexdigest()


def _merge(counts):
    out = Counter()
    for ((d, t), c), n in counts.items():
        out[((d, t or ""), c)] += n
    return out


def test_recall_of_edited_texts():
    """Pairs with one word in ten, one in eight and one in six exchanged at random, at every length of longer texts,
    share a sketch as often as the module says."""
    rnd, found = random.Random(4), Counter()
    for i in range(300):
        a = words(20000 + i, 60 + 5 * (i % 60)).split()
        every = (10, 8, 6)[i % 3]
        b = a[:]
        for at in rnd.sample(range(len(a)), len(a) // every):
            b[at] = f"new{rnd.random()}"
        (x, _), (y, _) = (near.kmers(*text_bytes(pa.array([" ".join(t)]))) for t in (a, b))
        found[every] += bool(set(near.sketch(x).tolist()) & set(near.sketch(y).tolist()))
    assert found[10] >= 99 and found[8] >= 97 and found[6] >= 88


def test_recall_against_word_alignment(spark):
    """Of all pairs of texts that share 80 % of their words in order, at least 95 % are in one class; and no class
    holds texts that no chain of such pairs connects."""
    rows = [(r["doc_id"], r["text"] or "") for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    first = {t: d for d, t in sorted(rows, reverse=True)}
    texts = sorted(first, key=lambda t: len(brute_words(t)))
    parts = [brute_words(t) for t in texts]
    pairs = []
    for i, a in enumerate(parts):
        for j in range(i + 1, len(parts)):
            if len(a) < 0.8 * len(parts[j]):
                break
            if brute_similarity(a, parts[j]) >= 0.8:
                pairs.append((first[texts[i]], first[texts[j]]))
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_order_minhash"](spark, "/root/testdata/sf0.01").collect()}
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    want = dict(zip([d for d, _ in rows], brute_classes(rows)))
    classes = defaultdict(set)
    for d, c in got.items():
        classes[c].add(want[d])
    assert all(len(c) == 1 for c in classes.values())


def test_kmers_do_not_depend_on_neighbours():
    texts = ["", "one", "a b c d e f g", "a b c d e a b c d e a b c d e", "..", "é1 ünï " * 9, "last"]
    both, bounds = near.kmers(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        alone, _ = near.kmers(*text_bytes(pa.array([t])))
        assert both[bounds[i] : bounds[i + 1]].tolist() == alone.tolist()
        assert len(alone) == len(brute_words(t)) == len(set(alone.tolist()))
    same = [near.kmers(*text_bytes(pa.array([t])))[0].tolist() for t in ("one two three four fives", "one,  two three four five", "one two three four")]
    assert same[0][:2] == same[1][:2] != same[2][:2] and same[0][2] != same[1][2]


def test_similarity_is_the_longest_common_sequence():
    rnd = random.Random(2)
    for n in range(400):
        a = [rnd.randrange(1, 12 if n % 2 else 10**6) for _ in range(rnd.randrange(1, 60))]
        b = a[:]
        for _ in range(rnd.randrange(1 + len(a) // 4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = [rnd.choice(a)] * rnd.randrange(2)
            if b and rnd.random() < 0.2:
                x, y = rnd.randrange(len(b)), rnd.randrange(len(b))
                b[x], b[y] = b[y], b[x]
        if not b:
            continue
        want = common(a, b) / max(len(a), len(b))
        got = near.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert (0.8 - 1e-9 <= got <= want + 1e-9) if want >= 0.8 - 1e-9 else want - 1e-9 <= got < 0.8


def test_sketches_share_by_similarity():
    """Pairs at 0.9 share a sketch practically always, unrelated pairs never."""
    rnd = random.Random(3)
    hit = 0
    for i in range(60):
        a = words(9000 + i, 200)
        b = edited(a, 2, rnd)
        (x, xb), (y, yb) = (near.kmers(*text_bytes(pa.array([t]))) for t in (a, b))
        hit += bool(set(near.sketch(x).tolist()) & set(near.sketch(y).tolist()))
        z, _ = near.kmers(*text_bytes(pa.array([words(9500 + i, 200)])))
        assert not set(near.sketch(x).tolist()) & set(near.sketch(z).tolist())
    assert hit == 60


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(500, 499), (499, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 200 for i in range(201, 260)} | {500: 499}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_texts_that_differ_at_an_end(docs_of):
    """One word more, one less, or one exchanged for one at the other end: classes are those of all pairs."""
    rows = []
    for n in range(8, 31):
        for i in range(3):
            w = words(7000 + 40 * i + n, n).split()
            other = [[*w, f"more{i}"], w[1:], [*w[1:], f"more{i}"]][i]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    for n in (43, 45, 52):  # a text of under 40 words and one of more
        w = words(8000 + n, n).split()
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: n - 4]))]
    want = brute_classes(rows)
    assert len(set(want)) < len(rows) * 0.65
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs_of(rows)).collect()}
    assert got == dict(zip([d for d, _ in rows], want))


def test_words_of_a_crowd_meet_in_packs(spark, monkeypatch):
    """Texts of the same common words in other orders, each a component of its own, meet once or twice a pair and not once
    for each common word of their prefixes; and every pair that shares enough words is passed on."""
    rnd, texts, roots = random.Random(5), [], []
    for g in range(3):
        common_words = sorted(set(words(9100 + g, 900).split()))[: 85 - 10 * g]
        for i in range(40):
            w = common_words + [f"own{g}x{i}x{j}" for j in range(10 + i % 6)]
            rnd.shuffle(w)
            texts.append(" ".join(w))
            roots.append(40 * g + (0 if i < 12 else i))  # a crowd, and others
    for _ in range(60):  # texts of few words, each many times
        texts.append(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(4, 14))))
        roots.append(len(roots))
    rows = [(i, len(t.split()), r, t) for i, (t, r) in enumerate(zip(texts, roots))]
    both = spark.createDataFrame(rows, "node long, n int, root long, text string")
    met, grouped = [], type(both).groupBy

    def seen(df, *columns):
        if columns == ("a", "b"):
            met.append(df.where("a < 120").count())
        return grouped(df, *columns)

    monkeypatch.setattr(type(both), "groupBy", seen)
    got = {tuple(r) for r in near._reachable(both.select("node", "n", "root"), both.select("node", "text"), 0.8).collect()}
    monkeypatch.undo()
    counts = [Counter(t.split()) for t in texts]
    want = {
        (a, b) for a in range(len(rows)) for b in range(a)
        if roots[a] != roots[b] and sum((counts[a] & counts[b]).values()) >= 0.8 * max(rows[a][1], rows[b][1]) - 1e-9
    }
    long = sum(a < 120 for a, _ in want)
    assert want <= got and long > 1500 and len(met) == 1 and met[0] <= 2 * long


def test_pairs_meet_once_for_all_packs_of_a_crowd(spark, monkeypatch):
    """Texts whose prefixes share words of several packs meet in one row, with all words that they share."""
    rnd, common_words, rows = random.Random(6), sorted(set(words(9200, 3000).split()))[:700], []
    for i in range(24):
        w = common_words + [f"own{i}x{j}" for j in range(20 + i % 6)]
        rnd.shuffle(w)
        rows.append((i, len(w), 0 if i < 9 else i, " ".join(w)))
    both = spark.createDataFrame(rows, "node long, n int, root long, text string")
    met, by_pack = [], near._met_by_pack

    def seen(packed, threshold):
        out = by_pack(packed, threshold)
        met.extend((packed.where("root = crowd").groupBy("node").count().agg(F.max("count")).first()[0], r["a"], r["b"]) for r in out.collect())
        return out

    monkeypatch.setattr(near, "_met_by_pack", seen)
    got = {tuple(r) for r in near._reachable(both.select("node", "n", "root"), both.select("node", "text"), 0.8).collect()}
    want = {(a, b) for a in range(24) for b in range(a) if rows[a][2] != rows[b][2]}
    assert got == want and {(a, b) for _, a, b in met} == want
    assert met[0][0] >= 2 and len(met) == len(want)


def test_texts_of_a_bucket_meet_one_of_its_largest_component(spark):
    """Each text outside a bucket's largest component meets one text of that, of near size, and links join whole components."""
    members = [(k, n, 100, 0) for k in (1, 2) for n in range(6)] + [(1, 7, 101, 7), (1, 8, 100, 7), (2, 7, 101, 7), (2, 9, 99, 9), (1, 10, 10, 10)]
    rows = spark.createDataFrame(members, "key long, node long, n int, root long")
    pairs = [tuple(r) for r in near._drawn(rows, 0.8).collect()]
    assert {a for a, _ in pairs} == {7, 8, 9} and {b for _, b in pairs} <= set(range(6)) and len(pairs) <= 4
    links = spark.createDataFrame([(8, 3), (9, 7)], "a long, b long")
    merged = near._merged(links, rows.select("node", "root").distinct())
    after = {r["node"]: r["root"] for r in near._rerooted(rows, merged).collect()}
    assert after == {**{n: 0 for n in range(6)}, 7: 0, 8: 0, 9: 0, 10: 10}


# --- pipeline

def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    from postmill.session import stage

    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "mixing", "bpe"]
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, stage(function(spark, docs, sf), "test-stage")
        kept[name] = (before, docs)
        if name != "bpe":
            assert docs.dtypes == before.dtypes
        if name in ("quality_rules", "language_id", "near_duplicates"):
            assert docs.exceptAll(before).count() == 0
    before, after = kept["quality_rules"]
    good = table(spark, sf, "labels").where("quality = 1").join(before.where("size(split(trim(text), '\\\\s+')) >= 50"), "doc_id").select("doc_id")
    assert good.exceptAll(after.select("doc_id")).count() == 0
    before, after = kept["language_id"]
    assert after.count() == before.count()
    before, after = kept["near_duplicates"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in after.collect()} == set(brute_classes(rows))
    before, after = kept["mixing"]
    assert after.select("doc_id").exceptAll(after.select("doc_id").distinct()).count() == after.count() - after.select("doc_id").distinct().count()
    assert after.join(before, "doc_id", "left_anti").count() == 0
    before, after = kept["bpe"]
    assert after.count() == before.count() and after.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, ran.select("doc_id", "n_tokens").collect())) == sorted(map(str, after.select("doc_id", "n_tokens").collect()))


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline

    from postmill.session import stage

    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        at = tmp_path / name
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0, "x"), (2, 0, None, "y"), (None, 0, 0, "z")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{at}/labels.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for _, function in corpus_pipeline.STAGES[:-1]:
            before, now = now, stage(function(spark, now, str(at)), "test-stage")
            assert now.dtypes == before.dtypes
        last = corpus_pipeline.STAGES[-1][1](spark, now, str(at))
        assert last.where("NOT round_trip").count() == 0 and last.count() == now.count()
        if name == "none":
            assert last.count() == 0
        assert now.where(F.col("doc_id").isin(3, 4, 6)).count() == 0
