"""Language-model scores by deleted interpolation (operator 13).

A bigram model. The chance of token w after v is mixed from maximum-likelihood estimates,

    p(w | v) = a_b c(v w) / c(v) + b_b c(w) / N + g_b / (V + 1),

with counts from the training documents and weights (a, b, g) for each bucket b of the context's frequency
(powers of two; unseen contexts have a bucket of their own). The weights come from held-out counts: one in
DEV training documents is deleted from the counts, and expectation-maximisation finds the weights under
which the counts of the others explain its bigrams best. The final estimates then use all counts. A text
starts after a start mark and ends with an end token, which is counted as a token.

Scale. Documents are packed into chunks of about CHUNK bytes of text, written once as a row each, so
every pass sees the same chunks, also in tasks that run again. A chunk passes on its different words and
bigrams as sorted 64-bit hashes with their counts in it, cut into parts by hash; a part adds up the
counts of each key and answers every chunk that asked, in the chunk's order, so answers carry no keys.
A word that stands in a third of all rows is one entry of a chunk, and parts grow in number with the text.
Chunks then meet their answers and score their documents. Both shuffles are in proportion to the different
keys of chunks. Only N, V, the number of training documents and the weights of at most BUCKETS buckets
reach the driver. Counts are of all rows and whole texts; nothing is pruned.

Keys are hashes of 64 bits of the whole word: two of a million different words are taken for one with a
chance of 3e-8, of a billion bigrams two pairs in a hundred corpora.

Defined cases: a null text is an empty one, whose one token is the end; null ids are ids, on the training
side if their hash says so; rows that repeat an id are scored, and counted, each; without training rows
all counts are 0 and the base score is 0; without held-out counts the weights are equal; very long texts
are chunks of their own and very long words are hashed whole; an empty table gives no rows; columns other
than key and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.arrowtext import mix, text_bytes
from postmill.session import stage

CHUNK = 5 << 20
#: Bytes of text for each part that adds up counts.
PART_BYTES = 8 << 20
DEV = 20
BUCKETS = 48
ROUNDS, SETTLED = 30, 1e-7
#: Bytes of a word that are hashed in steps of eight; longer words are hashed one by one.
WORD_BYTES = 256
#: Words that are hashed at once.
TOGETHER = 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
WORDS, PAIRS = 1, 2


def word_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each word (its bytes from ``first`` on)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.empty(len(first), np.uint64)
    for at in range(0, len(first), TOGETHER):
        some = slice(at, at + TOGETHER)
        out[some] = _hashed(padded, first[some], size[some])
    for i in np.flatnonzero(size > WORD_BYTES):
        digest = hashlib.blake2b(data[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def _hashed(padded: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Eight bytes of each word are mixed in at a time."""
    out = mix(size.astype(np.uint64) * ODD)
    for at in range(0, WORD_BYTES, 8):
        live = np.flatnonzero(size > at)
        if not len(live):
            break
        start, left = first[live] + at, size[live] - at
        eight = np.zeros(len(live), np.uint64)
        for j in range(8):
            byte = padded[np.minimum(start + j, len(padded) - 1)].astype(np.uint64)
            byte[left <= j] = 0
            eight |= byte << np.uint64(8 * j)
        out[live] = mix(out[live] * ODD + mix(eight + np.uint64(at + 1)))
    return out


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each word; texts, which touch each other, end words."""
    inside = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts).astype(np.int32), np.flatnonzero(ends).astype(np.int32)


class Tokens:
    """Words and bigrams of the texts of a chunk: ``token`` hashes with the end of every text, the context
    before each, its bigram, and where texts start among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
        first, last = word_edges(lower, offsets)
        words = word_hashes(lower, first, last + 1 - first)
        upto = np.searchsorted(first, offsets)  # words before each text
        n = len(offsets) - 1
        self.bounds = upto + np.arange(n + 1)
        self.token = np.full(len(words) + n, END, np.uint64)
        is_word = np.ones(len(self.token), bool)
        is_word[self.bounds[1:] - 1] = False
        self.token[is_word] = words
        self.context = np.concatenate([[START], self.token[:-1]]) if len(self.token) else self.token
        self.opens = self.bounds[:-1]
        self.context[self.opens] = START
        self.pair = mix(self.context * ODD + mix(self.token ^ ODD))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each text (each has one at least)."""
        return np.add.reduceat(values, self.opens) if len(self.opens) else values[:0]


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers byte plane by byte plane, so that small ones compress."""
    wide = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    used = max([1, *(np.flatnonzero(wide.any(axis=0)) + 1)]) if len(wide) else 1
    planes = np.ascontiguousarray(wide[:, :used].T).tobytes()
    return bytes([used]) + pa.compress(planes, codec="zstd", asbytes=True) + len(planes).to_bytes(8, "little")


def unpack(packed: bytes) -> np.ndarray:
    used, size = packed[0], int.from_bytes(packed[-8:], "little")
    planes = np.frombuffer(pa.decompress(packed[1:-8], decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    wide = np.zeros((size // used, 8), np.uint8)
    wide[:, :used] = planes.reshape(used, -1).T
    return wide.reshape(-1).view("<u8")


def _distinct(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and how often each occurs in training texts."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return ranked[at], (np.add.reduceat(trained[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64))


def _part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the key range starts among sorted keys; parts are equal ranges of the hash."""
    steps = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, steps), [len(keys)]]).astype(np.int64)


def write_chunks(docs: DataFrame, trained: Column, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """Written rows (chunk, dev, ids, trained, ends, texts compressed, n_bytes, n_tokens and n_trained tokens, docs):
    documents in the order of their task, the deleted ones of the training side (dev) in chunks of their own."""
    dev = trained & (F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(13)), F.lit(DEV)) == 0)
    rows = docs.select(F.col(key).alias("id"), trained.alias("trained"), dev.alias("dev"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("dev", T.BooleanType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("trained", T.ArrayType(T.BooleanType())),
        T.StructField("ends", T.BinaryType()), T.StructField("texts", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_trained", T.LongType()), T.StructField("docs", T.LongType()),
    ])

    def closed(dev: bool, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = text_bytes(table["text"])
        fold = table["trained"].to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.diff(np.searchsorted(word_edges(data, offsets)[0], offsets)) + 1

        def one(a: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)

        ids = table["id"].combine_chunks() if isinstance(table["id"], pa.ChunkedArray) else table["id"]
        return pa.record_batch([
            pa.array([dev]), one(ids), one(pa.array(fold)), pa.array([pack(offsets[1:])]),
            pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)]), pa.array([len(data)]), pa.array([int(sizes[fold].sum())]), pa.array([int(fold.sum())]),
        ], ["dev", "ids", "trained", "ends", "texts", "n_bytes", "n_trained", "docs"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            _, offsets = text_bytes(batch["text"])
            group = batch["dev"].to_numpy(zero_copy_only=False).astype(bool)
            for which in (False, True):
                mine = np.flatnonzero(group == which)
                lengths = np.diff(offsets)[mine]
                at = 0
                while at < len(mine):
                    fits = int(np.searchsorted(np.cumsum(lengths[at:]), chunk - size[which], "right"))
                    take = mine[at : at + max(fits, 0 if size[which] else 1)]
                    if len(take):
                        held[which].append(batch.take(pa.array(take)))
                        size[which] += int(lengths[at : at + len(take)].sum())
                        at += len(take)
                    if at < len(mine):  # the next text does not fit
                        yield closed(which, held[which])
                        held[which], size[which] = [], 0
        for which in (False, True):
            if held[which]:
                yield closed(which, held[which])

    return stage(rows.mapInArrow(packed, schema).withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")


def _texts(row: dict) -> tuple[Tokens, np.ndarray]:
    data = np.frombuffer(pa.decompress(row["texts"], decompressed_size=row["n_bytes"], codec="zstd", asbytes=True), np.uint8) if row["n_bytes"] else np.zeros(0, np.uint8)
    offsets = np.concatenate([np.zeros(1, np.int64), unpack(row["ends"]).astype(np.int64)])
    return Tokens(data, offsets), np.asarray(row["trained"], bool)


def ask(chunks: DataFrame, parts: int) -> DataFrame:
    """(kind, part, chunk, dev, keys, counts): the different words and bigrams of each chunk."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch[c][row].as_py() for c in ("chunk", "dev", "texts", "ends", "n_bytes", "trained")}
                tokens, fold = _texts(one)
                trained = np.repeat(fold, np.diff(tokens.bounds))
                for kind, keys in ((WORDS, tokens.token), (PAIRS, tokens.pair)):
                    ranked, counts = _distinct(keys, trained)
                    bounds = _part_bounds(ranked, parts)
                    held = np.flatnonzero(np.diff(bounds))
                    cut = [slice(bounds[p], bounds[p + 1]) for p in held]
                    # first key, then steps, so that high bytes are zero
                    key_bytes = [pack(np.diff(ranked[c], prepend=np.uint64(0))) for c in cut]
                    n = len(held)
                    yield pa.record_batch([
                        pa.array(np.full(n, kind, np.int32)), pa.array(held.astype(np.int32)), pa.array(np.full(n, one["chunk"], np.int64)), pa.array(np.full(n, one["dev"], bool)),
                        pa.array(key_bytes, pa.binary()), pa.array([pack(counts[c]) for c in cut], pa.binary()),
                    ], ["kind", "part", "chunk", "dev", "keys", "counts"])

    wanted = chunks.select("chunk", "dev", "texts", "ends", "n_bytes", "trained")
    return wanted.mapInArrow(asked, "kind int, part int, chunk long, dev boolean, keys binary, counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """(kind, part, chunk, dev, counts, deleted, types): for the keys of each chunk, in its order, their
    counts over all training texts and over the deleted ones; types (on one row of each part): trained keys."""

    def added(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(k), dtype=np.uint64) for k in group["keys"].to_pylist()]
        counts = [unpack(c).astype(np.int64) for c in group["counts"].to_pylist()]
        dev = group["dev"].to_numpy().astype(bool)
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        every, own = np.concatenate(keys), np.concatenate(counts)
        different, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, own, len(different)).astype(np.int64)
        deleted = np.bincount(place, own * np.repeat(dev, np.diff(bounds)), len(different)).astype(np.int64)
        found, gone = total[place], deleted[place]
        types = np.zeros(len(keys), np.int64)
        types[0] = (total > 0).sum()
        return pa.table({
            "kind": group["kind"], "part": group["part"], "chunk": group["chunk"], "dev": group["dev"],
            "counts": pa.array([pack(found[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()),
            # only deleted texts are weighed against the others
            "deleted": pa.array([pack(gone[a:b]) if d else None for a, b, d in zip(bounds, bounds[1:], dev)], pa.binary()), "types": pa.array(types),
        })

    return asked.groupBy("kind", "part").applyInArrow(added, "kind int, part int, chunk long, dev boolean, counts binary, deleted binary, types long")


def _looked_up(tokens: Tokens, answers: pa.Table, column: str) -> dict[int, np.ndarray]:
    """Counts of each token and of each bigram of a chunk from its answers."""
    out = {}
    kind, part = answers["kind"].to_numpy(), answers["part"].to_numpy()
    for which, keys in ((WORDS, tokens.token), (PAIRS, tokens.pair)):
        rows = np.flatnonzero(kind == which)
        rows = rows[np.argsort(part[rows])]
        counts = [unpack(answers[column][int(r)].as_py()) for r in rows]
        _, place = np.unique(keys, return_inverse=True)
        out[which] = (np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64))[place]
    return out


def _contexts(tokens: Tokens, words: np.ndarray, texts: int) -> np.ndarray:
    """Count of the context of each token: that of the word before it, or of texts at a text's start."""
    out = np.concatenate([[0], words[:-1]]) if len(words) else words.copy()
    out[tokens.opens] = texts
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2 of the count)."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1) * (context > 0)


def estimates(context: np.ndarray, pair: np.ndarray, word: np.ndarray, n: int, types: int) -> list[np.ndarray]:
    """The three maximum-likelihood estimates of each token."""
    return [np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1), np.full(len(word), 1 / (types + 1))]


def learn_weights(chunks: DataFrame, answers: DataFrame, n: int, types: int, docs: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, estimate) by expectation-maximisation on the deleted texts' bigrams. Every round is
    a sum over the table of different observations; at most BUCKETS rows reach the driver."""
    gone = chunks.where("dev").agg(F.coalesce(F.sum("n_trained"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    rest, rest_docs = n - gone[0], docs - gone[1]

    def observed(chunk: pa.Table, own: pa.Table) -> pa.Table:
        parts = []
        for row in chunk.to_pylist():
            tokens, _ = _texts(row)
            total, deleted = _looked_up(tokens, own, "counts"), _looked_up(tokens, own, "deleted")
            word, pair = total[WORDS] - deleted[WORDS], total[PAIRS] - deleted[PAIRS]
            seen = np.stack([_contexts(tokens, word, rest_docs), pair, word], 1)
            parts.append(np.unique(seen, axis=0, return_counts=True))
        rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, 3), np.int64)
        times = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return pa.table({"context": rows[:, 0], "pair": rows[:, 1], "word": rows[:, 2], "times": times.astype(np.int64)})

    asked = chunks.where("dev").select("chunk", "texts", "ends", "n_bytes", "trained").groupBy("chunk")
    seen = asked.cogroup(answers.where("dev").groupBy("chunk")).applyInArrow(observed, "context long, pair long, word long, times long")
    table = stage(seen.groupBy("context", "pair", "word").agg(F.sum("times").alias("times")), "lm-observed")
    bucket = F.when(F.col("context") > 0, F.least(F.length(F.bin("context")), F.lit(BUCKETS - 1))).otherwise(0).cast("int")
    parts = [
        F.when(F.col("context") > 0, F.col("pair") / F.col("context").cast("double")).otherwise(0.0),
        F.col("word") / F.lit(float(max(rest, 1))), F.lit(1.0 / (types + 1)),
    ]
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        by_bucket = [F.array(*[F.lit(float(w)) for w in weights[:, k]]) for k in range(3)]
        each = table.select("times", bucket.alias("b"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])
        shares = each.select("times", "b", *[(F.get(by_bucket[k], F.col("b")) * F.col(f"p{k}")).alias(f"m{k}") for k in range(3)])
        whole = F.col("m0") + F.col("m1") + F.col("m2")
        sums = shares.groupBy("b").agg(*[F.sum(F.col("times") * F.col(f"m{k}") / whole).alias(f"e{k}") for k in range(3)]).collect()
        expected = np.zeros((BUCKETS, 3))
        for r in sums:
            expected[r["b"]] = [r["e0"], r["e1"], r["e2"]]
        # one count each for what all buckets see together, so that no bucket rules anything out
        prior = (expected.sum(axis=0) + 1) / (expected.sum() + 3)
        new = (expected + 3 * prior) / (expected.sum(axis=1, keepdims=True) + 3)
        moved = np.abs(new - weights).max()
        weights = new
        if moved < SETTLED:
            break
    return weights


def score_texts(docs: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, trained, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, learned
    from the rows where ``trained`` holds. Scores are base-10 logarithms."""
    spark = docs.sparkSession
    chunks = write_chunks(docs, F.coalesce(trained, F.lit(False)), key, text, chunk)
    n, texts, size = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_trained", "docs", "n_bytes")]).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    answers = stage(answer(ask(chunks, parts)), "lm-answers")
    types = answers.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    weights = learn_weights(chunks, answers, n, types, texts)

    def scored(chunk: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        for row in range(chunk.num_rows):
            one = {c: chunk[c][row].as_py() for c in ("texts", "ends", "n_bytes", "trained")}
            tokens, fold = _texts(one)
            count = _looked_up(tokens, own, "counts")
            context = _contexts(tokens, count[WORDS], texts)
            mixed = sum(weights[bucket_of(context), k] * e for k, e in enumerate(estimates(context, count[PAIRS], count[WORDS], n, types)))
            base = np.log10((count[WORDS] + 1) / (n + types + 1))
            out.append(pa.table({
                key: chunk["ids"][row].values, "trained": pa.array(fold), "n_tokens": pa.array(np.diff(tokens.bounds).astype(np.int64)),
                "n_known": pa.array(tokens.per_text((count[WORDS] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(fold), n, np.int64)),
                "base_score": pa.array(tokens.per_text(base)), "score": pa.array(tokens.per_text(np.log10(mixed))),
            }))
        return pa.concat_tables(out) if out else empty

    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("trained", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    empty = pa.table({f.name: [] for f in schema})
    asked = chunks.select("chunk", "ids", "texts", "ends", "n_bytes", "trained").groupBy("chunk")
    return asked.cogroup(answers.select("chunk", "kind", "part", "counts").groupBy("chunk")).applyInArrow(scored, schema)
