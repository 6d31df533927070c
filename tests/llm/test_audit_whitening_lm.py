"""Filter audit, whitening and interpolated language model against brute force."""

import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import filter_audit as A
from postmill.llm import interpolated_lm as L
from postmill.llm import queries as Q
from postmill.llm import whitening as W
from postmill.llm.common import split_of
from tests.llm.conftest import LONG, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"

# -- filter audit


def failed(rows, i):
    """The set of filters that row ``i`` fails."""
    key, text = rows[i][0], rows[i][1] or ""
    w = WORD.findall(text)
    out = set()
    if len(w) < 200:
        out.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if key is not None and any(r[0] is not None and r[0] < key and (r[1] or "") == text for r in rows):
        out.add("E")
    return out


def audited(rows, labels):
    good = {r[0] for r in labels if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    out = {}
    for part in {r[3] or "" for r in rows}:
        mine = [(rows[i][0], failed(rows, i)) for i in range(len(rows)) if (rows[i][3] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f,
                ]
                left = kept
        for k in [k for k in out if k[0] == part]:
            out[k][-1] = shapley[out[k][-1]]
    return out


def report(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 7, 64, 1000):
        words_ = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        want = [int(((words_ >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]
        assert A.positional_popcount(words_).tolist() == want


def test_survival_words_hold_the_truth_table():
    table = A.survival_words()
    assert all((table[m] >> s & 1) == (s & m == 0) for m in range(32) for s in range(32))


def test_audit_equals_applying_every_order(spark, docs_of):
    texts = [words(1, 250), words(2, 30), "Word " * 300, "A " * 250, words(3, 260) + " 5%", words(1, 250), "", None, words(4, 220).upper()]
    rows = [(i if i % 11 else None, texts[i % 9] if i % 4 else texts[0], "en", ["a", "a", "b", None, ""][i % 5]) for i in range(60)]
    rows += [(7, texts[0], "en", "a"), (7, texts[0], "en", "a"), (61, LONG, "en", "c")]
    labels = [(i % 40, i % 2, (i // 2) % 2) for i in range(50)] + [(None, 1, 1), (3, None, None)]
    got = report(A.audit_filters(docs_of(rows), spark.createDataFrame(labels, LABELS)))
    assert got == audited(rows, labels)


def test_audit_of_odd_and_no_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd_docs.select("doc_id", "text", "lang", "source").collect()]
    assert report(A.audit_filters(odd_docs, none)) == audited(rows, [])
    assert A.audit_filters(no_docs, none).count() == 0


def test_audit_query_equals_its_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracles import rows_of

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    df = Q.QUERIES["op11_filter_audit"](spark, sf)
    cur = con.execute(Q.ORACLES["op11_filter_audit"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


# -- whitening


def whitened(vectors, most=32):
    width = max(len(v) for v in vectors)
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    c = off.astype(float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > values[0] * W.RANK).sum()))
    return (off**2).sum(axis=1), c @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 7)) + rng.normal(size=(300, 7)) * 0.5
    vectors = [[float(np.float32(c)) for c in v] for v in mixed]
    vectors[7] = vectors[8]
    vectors[9] = vectors[9][:4]  # entries that are not there count as 0
    rows = [(i if i != 20 else 19, v) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] + [0.0] * 6), (903, [float("inf")] + [0.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("index", F.lit(1)).withColumn("x", F.lit("other"))
    got = W.whitened_components(df, most=6, block_rows=64).collect()
    deviation, white, explained = whitened(vectors, 6)
    assert len(got) == 300 * 6 and {r.n for r in got} == {300} and max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
    signs = None
    for (i, v), d, w in zip(rows, deviation, white):
        mine = by[i, int(d)]
        if signs is None:
            signs = [1 if mine[c + 1][0] * w[c] > 0 else -1 for c in range(6)]
        for c in range(6):
            assert any(abs(x - signs[c] * w[c]) < 1e-7 for x in mine[c + 1])


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])] * 3):
        out = W.whitened_components(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns == columns
    line = W.whitened_components(spark.createDataFrame([(1, [0.5, 0.5]), (2, [-0.5, -0.5]), (None, [0.0, 0.0])], schema))
    assert {r.component for r in line.collect()} == {1} and line.count() == 3


# -- language model


def tokens_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*WORD.findall(low), None]


def scored(rows, trained, weights):
    """(n_tokens, n_known, train_tokens, base, score) of each text by plain counting."""
    texts = [tokens_of(t) for _, t in rows]
    one, two = Counter(), Counter()
    for t, use in zip(texts, trained):
        if use:
            one.update(t)
            two.update(zip(["<start>", *t], t))
    n, v, starts = sum(one.values()), len(one), sum(trained)
    out = []
    for t in texts:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for before, w in zip(["<start>", *t], t):
            seen = starts if before == "<start>" else one[before]
            a, b, g = weights[min(seen.bit_length(), L.BUCKETS - 1)]
            score += math.log10(a * (two[before, w] / seen if seen else 0) + b * one[w] / max(n, 1) + g / (v + 1))
        out.append((len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def scores(spark, docs, monkeypatch, **options):
    """Rows of the operator, and the weights that it learned."""
    held, plain = {}, L.learn_weights
    monkeypatch.setattr(L, "learn_weights", lambda *a, **k: held.setdefault("w", plain(*a, **k)))
    out = L.score_texts(docs, split_of(F.col("doc_id"), 7) != 2, **options).collect()
    monkeypatch.setattr(L, "learn_weights", plain)
    return out, held["w"]


def same(got, rows, weights):
    trained = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    want = sorted(zip([(-1 if i is None else i, t) for (i, _), t in zip(rows, trained)], scored(rows, trained, weights)))
    have = sorted(((-1 if r.doc_id is None else r.doc_id, r.trained), (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got)
    assert len(want) == len(have)
    for (k, a), (j, b) in zip(want, have):
        assert k == j and a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_equal_plain_counting(spark, docs_of, monkeypatch):
    rows = [(i, " ".join(words(i % 17, 40 + i).split()[i % 5 :]).title() if i % 3 else words(i, 90)) for i in range(160)]
    rows += [(200, "x" * 1000 + " Y " + "x" * 1000), (201, "x" * 1000), (202, None), (203, " \t\n"), (204, "é É ﬁ \x85 a\xa0b")]
    for chunk in (1 << 20, 700):  # many chunks give what one gives
        got, weights = scores(spark, docs_of(rows), monkeypatch, chunk=chunk)
        assert np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()
        same(got, rows, weights)


def test_scores_of_odd_and_no_documents(spark, odd_docs, no_docs, docs_of, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got, weights = scores(spark, odd_docs, monkeypatch)
    same(got, rows, weights)
    assert L.score_texts(no_docs, F.lit(True)).count() == 0
    untrained = L.score_texts(docs_of([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in untrained) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_the_weights_explain_held_out_text_best(spark, sf, monkeypatch):
    """No weights of a grid do better on the deleted texts, and texts held out score above the base."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, weights = scores(spark, docs, monkeypatch)
    held = [r for r in got if not r.trained]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_packed_integers_come_back():
    for values in ([], [0], [1, 2, 300], [2**63, 5], list(range(70000))):
        x = np.array(values, np.uint64)
        assert (L.unpack(L.pack(x)) == x).all()
