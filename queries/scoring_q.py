"""Vectors and score components."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import scoring as S
from postmill.functions.expr import instant
from postmill.operators import scoring as O
from queries.binding import AS_OF, oracle, postings, table
from queries.registry import query

COS = (
    "list_dot_product(e.embedding::DOUBLE[], r.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[],"
    " e.embedding::DOUBLE[])) * sqrt(list_dot_product(r.v, r.v)))"
)
REF = "(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) r"


def _reference(spark, sf):
    """The one reference vector."""
    row = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding]


@query("cosine_topk", f"SELECT vec_id, round({COS}, 6) AS cosine FROM embeddings e, {REF}"
       f" ORDER BY {COS} DESC, vec_id LIMIT 25")
def cosine_topk(spark, sf):
    top = O.nearest(table(spark, sf, "embeddings"), _reference(spark, sf), 25, "vec_id")
    return top.withColumn("cosine", F.round("cosine", 6))


@query("cosine_all", f"SELECT vec_id, round({COS}, 6) AS cosine, round(least(1, greatest(0, ({COS} -"
       f" 0.6::DOUBLE) / (0.85::DOUBLE - 0.6::DOUBLE))), 6) AS rescaled FROM embeddings e, {REF}")
def cosine_all(spark, sf):
    cosine = S.cosine(F.col("embedding"), _reference(spark, sf))
    return (
        table(spark, sf, "embeddings")
        .select("vec_id", cosine.alias("c"))
        .select(
            "vec_id", F.round("c", 6).alias("cosine"),
            F.round(S.rescale_similarity(F.col("c")), 6).alias("rescaled"),
        )
    )


FRESH = (
    "CASE WHEN posted_at IS NULL THEN 0.5::DOUBLE WHEN age <= 48 THEN 1.0::DOUBLE WHEN age <= 168 THEN"
    " 0.7::DOUBLE WHEN age <= 720 THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END"
)
AGED = "SELECT *, datediff('second', posted_at, TIMESTAMP '2001-08-02 00:00:00') / 3600 AS age FROM postings"


@query("freshness_steps", oracle(
    f"SELECT {FRESH} AS freshness_score, count(*) AS n FROM a GROUP BY 1", "postings", a=AGED,
))
def freshness_steps(spark, sf):
    fresh = S.freshness_score(F.col("posted_at"), instant(AS_OF))
    return postings(spark, sf).groupBy(fresh.alias("freshness_score")).agg(F.count("*").alias("n"))


def _round(x: str) -> str:
    """Six digits, by the exact value of the double: x * 1e6 = p + q without error."""
    halves = f"list_transform([{x}], lambda v: [v * 134217729::DOUBLE - (v * 134217729::DOUBLE - v), v])[1]"
    parts = f"list_transform([{halves}], lambda h: [h[1] * 1e6::DOUBLE, (h[2] - h[1]) * 1e6::DOUBLE])[1]"
    return (
        f"list_transform([{parts}], lambda s: (floor(s[1] + s[2]) + CASE WHEN s[1] - floor(s[1] + s[2]) -"
        " 0.5::DOUBLE > -s[2] OR (s[1] - floor(s[1] + s[2]) - 0.5::DOUBLE = -s[2] AND floor(s[1] + s[2]) % 2"
        " <> 0) THEN 1 ELSE 0 END) / 1e6::DOUBLE)[1]"
    )


NEAR = "[" + ", ".join(f"'{c}'" for c in S.NEARBY) + "]"


def _rule_sql() -> str:
    from queries.text_q import city_key_sql

    kind = "COALESCE(remote_type, 'onsite')"
    return (
        f"(0.45::DOUBLE * CASE {kind} WHEN 'remote' THEN 1.0::DOUBLE WHEN 'hybrid' THEN 0.7::DOUBLE ELSE"
        f" 0.4::DOUBLE END + 0.2::DOUBLE * CASE WHEN {kind} = 'onsite' AND NOT list_contains({NEAR},"
        f" {city_key_sql('location')}) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END + 0.35::DOUBLE * CASE WHEN"
        " salary_source = 'none' OR COALESCE(salary_max, salary_min) IS NULL THEN 0.55::DOUBLE ELSE"
        " least(1.0::DOUBLE, greatest(0.0::DOUBLE, (COALESCE(salary_max, salary_min) - 125000)::DOUBLE /"
        " 25000)) END)"
    )


@query("rule_score", oracle(
    f"SELECT posting_key, {_round(_rule_sql())} AS rule_score FROM postings", "postings",
))
def rule_score(spark, sf):
    score = S.rule_score(
        F.coalesce("remote_type", F.lit("onsite")), F.col("location"), F.col("salary_min"),
        F.col("salary_max"), F.col("salary_source"),
    )
    return postings(spark, sf).select("posting_key", score.alias("rule_score"))


BLEND = (
    "least(1::DOUBLE, greatest(0::DOUBLE, 0.55::DOUBLE * near + 0.25::DOUBLE * rules + 0.2::DOUBLE * fresh))"
)
SCORED = (
    f"SELECT posting_key, {_round('near')} AS embed_similarity, rules AS rule_score, fresh AS"
    f" freshness_score, {_round(BLEND)} AS total_score FROM (SELECT a.posting_key, least(1::DOUBLE,"
    f" greatest(0::DOUBLE, ({COS} - 0.6::DOUBLE) / (0.85::DOUBLE - 0.6::DOUBLE))) AS near,"
    f" {_round(_rule_sql())} AS rules, {FRESH} AS fresh FROM a JOIN (SELECT vec_id AS posting_key,"
    " list_transform(embedding, lambda x, i: x * 0.3::DOUBLE + r.v[i]) AS embedding FROM embeddings,"
    f" {REF}) e USING (posting_key), {REF})"
)


@query("score_postings", oracle(SCORED, "postings", a=AGED))
def score_postings(spark, sf):
    """Vectors are pulled towards the reference, so that similarities spread over the band."""
    ref = _reference(spark, sf)
    pulled = F.zip_with(
        F.col("embedding"), F.lit(ref).cast("array<double>"), lambda x, y: x * F.lit(0.3) + y
    )
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("posting_key"), pulled.alias("embedding")
    )
    scored = O.score_postings(postings(spark, sf), vectors, ref, AS_OF)
    return scored.select(
        "posting_key", "embed_similarity", "rule_score", "freshness_score", "total_score"
    )


@query("awaiting_vector", oracle("SELECT posting_key FROM postings WHERE posting_key NOT IN (SELECT vec_id FROM"
       " embeddings)", "postings"))
def awaiting_vector(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("posting_key"))
    return O.awaiting_vector(postings(spark, sf), vectors)


STRETCH_SQL = "('0x' || substr(sha256(posting_key::VARCHAR || ':0'), 1, 12))::BIGINT % 10000 < 700"


@query("stretch_slice", oracle(f"SELECT posting_key, title FROM postings WHERE {STRETCH_SQL}", "postings"))
def stretch_slice(spark, sf):
    """The pseudo-random slice of one posting in fourteen or so."""
    return postings(spark, sf).where(S.is_stretch(F.col("posting_key"))).select("posting_key", "title")


@query("embed_export", "SELECT doc_id AS posting_key, n::INTEGER AS chunk_no, source || chr(10) || substr(text,"
       " n * 4000 + 1, 4000) AS text FROM documents, range(0, 1000) t(n) WHERE n = 0 OR n * 4000 < length(text)")
def embed_export(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("posting_key"), F.col("source").alias("title"),
        F.col("text").alias("description"),
    )
    return O.embed_export(docs)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("embed_hook", "SELECT doc_id AS posting_key, CAST(round(10000 * list_sum(list_transform(n, lambda x: x * x)) / greatest(list_sum(n), 1) ** 2) AS BIGINT) AS evenness, n[1]"
       " AS a, n[26] AS z FROM (SELECT doc_id, list_transform(string_split('" + ",".join(LETTERS) + "', ','), lambda c: length(t) - length(replace(t, c, ''))) AS n FROM"
       " (SELECT doc_id, lower(text) AS t FROM documents))")
def embed_hook(spark, sf):
    """V3: an encoder that places a text by how often it has each letter, in batches by the hook."""

    def loader():
        import numpy as np

        first = ord(LETTERS[0])

        def encode(texts):
            out = np.zeros((len(texts), len(LETTERS)))
            for i, t in enumerate(texts):
                points = np.frombuffer(t.lower().encode("utf-32-le"), np.uint32).astype(np.int64) - first
                out[i] = np.bincount(points[(points >= 0) & (points < len(LETTERS))], minlength=len(LETTERS))
            return out.tolist()

        return encode

    docs = table(spark, sf, "documents").selectExpr("doc_id AS posting_key", "text")
    n = F.col("embedding")
    total = F.aggregate(n, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x)
    return O.embed_texts(docs, loader).select("posting_key", F.col("embedding").cast("array<double>").alias("embedding")).select(
        "posting_key", F.round(F.lit(10000) * squares / F.pow(F.greatest(total, F.lit(1.0)), F.lit(2.0))).cast("bigint").alias("evenness"),
        F.get(n, F.lit(0)).cast("bigint").alias("a"), F.get(n, F.lit(25)).cast("bigint").alias("z"),
    )
