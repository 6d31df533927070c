"""Employer screen: term lists, verdict precedence and its reports
(P4, J6, J7, J9, T4, T5, U7, F39, A4, A16)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.expr import instant, let
from postmill.functions.places import factored
from postmill.operators.postings import is_live
from postmill.session import stage
from postmill.vocab import TermLists

# Employer verdicts, relevance verdicts and what an unlisted one becomes.
VERDICTS = ("allowed", "excluded", "flagged", "unknown")
RELEVANCE = ("strong", "possible", "weak")
COST_PER_CLASSIFICATION = 0.0005


def _alternation(terms) -> str:
    return factored(terms) or "(?!)"


def _pairs(pairs) -> Column:
    return F.array(
        *[F.struct(F.lit(s).alias("sector"), F.lit(t).alias("term")) for s, t in pairs]
    )


def screen_terms(name: Column, text: Column, lists: TermLists | None = None) -> Column:
    """P4. ``struct<verdict, sector, reason>`` of the first term in list order, or null.

    An allowed phrase in the name settles it before any term. One compiled alternation decides
    whether any term occurs; only rows with a hit look for the first term.
    """
    lists = lists or TermLists()
    low_name, low_text = F.lower(name), F.lower(text)

    def first(pairs, hit) -> Column:
        return F.get(F.filter(_pairs(pairs), hit), F.lit(0))

    def ruling(term: Column, lead: str) -> Column:
        return let(
            term,
            lambda t: F.when(
                t.isNotNull(),
                F.struct(
                    F.lit("excluded").alias("verdict"),
                    t["sector"].alias("sector"),
                    F.concat(
                        F.lit(lead + " '"), t["term"], F.lit("' ("), t["sector"], F.lit(").")
                    ).alias("reason"),
                ),
            ),
        )

    found = F.when(low_name.rlike(_alternation(lists.allowed)), F.lit(None))
    if lists.name_terms:
        word = r"(?U)\b(?:%s)\b"
        found = found.when(
            low_name.rlike(word % _alternation(t for _, t in lists.name_terms)),
            ruling(
                first(
                    lists.name_terms,
                    lambda t: F.regexp_like(
                        low_name,
                        F.concat(F.lit(r"(?U)\b\Q"), t["term"], F.lit(r"\E\b")),
                    ),
                ),
                "Company name contains",
            ),
        )
    if lists.description_terms:
        found = found.when(
            low_text.rlike(_alternation(t for _, t in lists.description_terms)),
            ruling(
                first(lists.description_terms, lambda t: low_text.contains(t["term"])),
                "Description states",
            ),
        )
    return found


#: Words, or characters, of the pieces by which phrases are looked up.
RUN = 3
#: Bits of the Bloom filters for each piece, and the largest sizes of the one that is part of an expression
#: (and so of every plan that holds it) and of the one that is a table (2 MB).
BITS_EACH, MOST_BITS, MOST_TABLE_BITS = 16, 1 << 16, 1 << 24


def _pieces(units: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` neighbouring units (words or characters), in order."""

    def runs(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashed) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(n)]))

    def found(hashed: Column) -> Column:
        return F.when(F.size(hashed) >= n, runs(hashed)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(units, lambda u: F.xxhash64(u)), found)


def _bits(pieces: DataFrame, piece: str, most: int) -> int:
    n = pieces.agg(F.approx_count_distinct(piece)).first()[0]
    return min(most, 1 << max(10, (BITS_EACH * n).bit_length()))


def _set_bits(places: DataFrame) -> DataFrame:
    """(word, bits): the bits ``at`` that are set, 32 a row."""
    return places.groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 31 AS INT)))").alias("bits"))


def likely(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The ``rows(doc, piece)`` whose piece is one of ``pieces(piece)``, and few others. The filter is a table of at
    most MOST_TABLE_BITS bits that is broadcast, so lists of any size add nothing to the plan."""
    size = _bits(pieces, "piece", MOST_TABLE_BITS)
    place = F.pmod(F.shiftright("piece", 24), F.lit(size))
    words = stage(_set_bits(pieces.select(place.alias("at"))), "piece-bits")
    placed = rows.withColumn("_at", place).withColumn("word", F.shiftright("_at", 5).cast("int")).join(F.broadcast(words), "word")
    return placed.where(F.getbit("bits", F.col("_at").bitwiseAND(F.lit(31)).cast("int")) == 1).select(*rows.columns)


def bloom_filter(pieces: DataFrame, piece: str = "piece") -> Callable[[Column], Column]:
    """A test that holds for every one of the pieces (64-bit hashes) and for few others. Its bits, at most
    MOST_BITS, are the only thing that reaches the driver; beyond that size it lets more pass."""
    size = _bits(pieces, piece, MOST_BITS)

    def places(h: Column) -> list[Column]:
        return [F.pmod(h, F.lit(size)), F.pmod(F.shiftright(h, 32), F.lit(size))]

    words = _set_bits(pieces.select(F.explode(F.array(*places(F.col(piece)))).alias("at")))
    set_ = {r["word"]: r["bits"] for r in words.collect()}
    table = F.split(F.lit(",".join(str(set_.get(i, 0)) for i in range(size // 32))), ",").cast("array<bigint>")

    def holds(h: Column) -> Column:
        first, second = [F.getbit(F.get(table, F.shiftright(p, 5).cast("int")), p.bitwiseAND(F.lit(31)).cast("int")) == 1 for p in places(h)]
        return first & second

    return holds


def _shuffled(table: DataFrame) -> DataFrame:
    """A table of texts or terms, which grows with the data and is joined by shuffles alone: texts and hashes of
    repetitive tables are many times larger in memory than the files that Spark would judge them by."""
    return table.hint("merge")


def _candidates(texts: DataFrame, phrases: DataFrame, pieces: Column) -> DataFrame:
    """(doc, no) where the text has the rarest piece of phrase ``no``. ``phrases`` lists its ``pieces``; those of
    a text are tested by Bloom filters of all phrases', a short one before they become rows and a long one before
    they are shuffled, so what is shuffled is in proportion to the hits. Texts are counted per piece, so a piece
    that half the texts share leads nowhere if the phrase has a rarer one."""
    wanted = stage(phrases.select("no", F.explode(F.array_distinct("pieces")).alias("piece")), "phrase-pieces")
    holds = bloom_filter(wanted)
    held = likely(texts.select("doc", F.explode(F.array_distinct(F.filter(pieces, holds))).alias("piece")), wanted)
    had = stage(held.join(_shuffled(wanted.select("piece").distinct()), "piece"), "text-pieces")
    counts = had.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.join(_shuffled(counts), "piece", "left")
        .groupBy("no")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))["piece"].alias("piece"))
    )
    return had.join(rarest, "piece").select("doc", "no")


def _characters(text: str) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def held_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc, no) of the ``phrases(no, phrase)`` that each of the ``texts(doc, text)`` holds, as they are written.

    A phrase's inner words stand in a text that holds it as whole words, so its rarest run of three
    of them is looked up by an equi-join; shorter phrases go by their characters. What is found
    is verified. Empty phrases occur nowhere.
    """
    words = F.split("phrase", r"\s+")
    p = phrases.select("no", "phrase", F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))).alias("inner")).where("phrase <> ''")
    p = stage(p, "phrases")
    long = F.size("inner") >= RUN
    found = _candidates(texts, p.where(long).select("no", _pieces(F.col("inner"), RUN).alias("pieces")), _pieces(F.split("text", r"\s+"), RUN))
    short = p.where(~long).withColumn("n", F.least(F.length("phrase"), F.lit(RUN)))
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):  # 1, 2 or 3
        some = short.where(F.col("n") == n).select("no", _pieces(_characters("phrase"), n).alias("pieces"))
        found = found.unionByName(_candidates(texts, some, _pieces(_characters("text"), n)))
    near = found.distinct().join(_shuffled(p.select("no", "phrase")), "no").join(_shuffled(texts), "doc")
    return near.where(F.contains("text", "phrase")).select("doc", "no")


def screen_passages(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """J9, P4 for phrase lists of any size. ``texts(doc, text)``, ``phrases(item, phrase)``: the
    smallest item of which a phrase occurs in each text, letter case aside; texts without one are left
    out. An item may have several phrases."""
    numbered = phrases.select("item", F.lower("phrase").alias("phrase"), F.monotonically_increasing_id().alias("no"))
    numbered = stage(numbered, "numbered")
    held = held_phrases(texts.select("doc", F.lower("text").alias("text")), numbered.select("no", "phrase"))
    return held.join(_shuffled(numbered.select("no", "item")), "no").groupBy("doc").agg(F.min("item").alias("item"))


#: Sign that stands for the edge of a word.
MARK = "\u0001"


def _marked(text: Column) -> Column:
    """The text with a sign at each edge of a word."""
    return F.regexp_replace(text, r"(?U)\b", MARK)


def _held_names(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, no) of the ``terms(no, phrase)`` that stand in the ``names(doc, text)`` between word edges: looked up
    by the word of a term that fewest names have, then verified with the edges marked in both. A term without a
    word has no edges and stands nowhere."""

    def words(text: str) -> Column:
        return F.array_distinct(F.filter(F.split(text, r"(?U)\W+"), lambda w: w != ""))

    of_terms = terms.select("no", F.explode(words("phrase")).alias("word"))
    had = stage(names.select("doc", F.explode(words("text")).alias("word")).join(_shuffled(of_terms.select("word").distinct()), "word", "left_semi"), "name-words")
    counts = had.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pick = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word")
    rarest = of_terms.join(_shuffled(counts), "word", "left").groupBy("no").agg(pick)
    near = had.join(rarest, "word").select("doc", "no").join(_shuffled(terms), "no").join(_shuffled(names), "doc")
    needle = F.concat(F.lit(MARK), F.btrim(_marked(F.col("phrase")), F.lit(MARK)), F.lit(MARK))
    return near.where(F.contains(_marked(F.col("text")), needle)).select("doc", "no")


def screen_by_table(companies: DataFrame, terms: DataFrame) -> DataFrame:
    """P4 from a table of terms of any size: ``companies(company_key, name, description)`` with ``ruling``, the
    struct of ``screen_terms``. ``terms(kind, sector, term, place)``: kind is ``allowed``, ``name`` or ``description``, and of
    several hits the smallest place counts, names before descriptions. Terms are looked up by joins, an inverted
    index by their rarest piece; none is compiled as a pattern, and none is in the plan."""
    known = terms.select("kind", "sector", "term", F.lower("term").alias("phrase"), "place", F.monotonically_increasing_id().alias("no"))
    known = stage(known.where("phrase <> ''"), "terms")
    rows = companies.select(F.col("company_key").alias("doc"), F.lower("name").alias("name"), F.lower("description").alias("description"))

    def of(kind: str) -> DataFrame:
        return known.where(F.col("kind") == kind).select("no", "phrase")

    names, texts = rows.select("doc", F.col("name").alias("text")), rows.select("doc", F.col("description").alias("text"))
    allowed = held_phrases(names, of("allowed")).select("doc").distinct()
    hits = _held_names(names, of("name")).select("doc", "no", F.lit("Company name contains").alias("lead"), F.lit(0).alias("turn")).unionAll(
        held_phrases(texts, of("description")).select("doc", "no", F.lit("Description states").alias("lead"), F.lit(1).alias("turn"))
    )
    told = hits.join(_shuffled(known.select("no", "sector", "phrase", "place")), "no").join(allowed, "doc", "left_anti")
    first = told.groupBy("doc").agg(F.min_by(F.struct("sector", "phrase", "lead"), F.struct("turn", "place", "no")).alias("h"))
    reason = F.concat(F.col("h.lead"), F.lit(" '"), F.col("h.phrase"), F.lit("' ("), F.col("h.sector"), F.lit(")."))
    ruled = first.select(F.col("doc").alias("company_key"), F.struct(F.lit("excluded").alias("verdict"), F.col("h.sector").alias("sector"), reason.alias("reason")).alias("ruling"))
    return companies.join(_shuffled(ruled), "company_key", "left")


def term_table(spark: SparkSession, lists: TermLists | None = None) -> DataFrame:
    """Term lists as a table ``(kind, sector, term, place)``."""
    lists = lists or TermLists()
    rows = [("allowed", None, t, i) for i, t in enumerate(lists.allowed)]
    rows += [("name", s, t, i) for i, (s, t) in enumerate(lists.name_terms)]
    rows += [("description", s, t, i) for i, (s, t) in enumerate(lists.description_terms)]
    return spark.createDataFrame(rows, "kind string, sector string, term string, place long")


def newest_text(companies: DataFrame, postings: DataFrame) -> DataFrame:
    """J7, T5. Each employer with the text of its latest posting, empty where it has none.

    ``max_by`` combines before the shuffle, so an employer with a third of all postings sends
    one row per task.
    """
    latest = postings.groupBy("company_key").agg(
        F.max_by("description", F.struct("last_seen_at", "posting_key")).alias("description")
    )
    return companies.join(latest, "company_key", "left").withColumn(
        "description", F.coalesce("description", F.lit(""))
    )


def screen_companies(
    companies: DataFrame, postings: DataFrame, lists: TermLists | None = None
) -> DataFrame:
    """P4 over J7: employers with ``ruling``."""
    return newest_text(companies, postings).withColumn(
        "ruling", screen_terms(F.col("name"), F.col("description"), lists)
    )


def clean_verdict(verdict: Column) -> Column:
    """F39. An unlisted employer verdict asks a person."""
    return F.when(verdict.isin(*VERDICTS), verdict).otherwise("flagged")


def clean_relevance(judged: DataFrame) -> DataFrame:
    """F39. Ingested judgements: unlisted verdict, score range, stray white space."""
    return judged.withColumns(
        {
            "relevance_verdict": F.when(
                F.col("relevance_verdict").isin(*RELEVANCE), F.col("relevance_verdict")
            ).otherwise("possible"),
            "relevance_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("relevance_score"))),
            "rationale": F.trim("rationale"),
        }
    )


def latest_rulings(rulings: DataFrame) -> DataFrame:
    """U7. The owner's last ruling per employer; an unknown verdict is an error."""
    checked = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(
        F.raise_error(F.concat(F.lit("unknown verdict: "), F.col("verdict")))
    )
    return rulings.groupBy("company_key").agg(
        F.max_by(checked, F.col("decided_at")).alias("user_verdict"),
        F.max("decided_at").alias("user_at"),
    )


def settle_verdicts(
    screened: DataFrame, rulings: DataFrame, verdicts: DataFrame, as_of: datetime
) -> DataFrame:
    """U7. Employer verdicts by precedence: the owner's ruling, an earlier decision, the term
    screen, an ingested model verdict, else unknown (which is asked again next time).

    ``screened`` is ``screen_companies`` output, ``rulings`` is ``(company_key, verdict,
    decided_at)`` and ``verdicts`` is ``(company_key, verdict, sector, reason)``, one row per
    employer.
    """
    model = verdicts.select(
        "company_key",
        clean_verdict(F.col("verdict")).alias("model_verdict"),
        F.col("sector").alias("model_sector"),
        F.col("reason").alias("model_reason"),
    )
    joined = screened.join(latest_rulings(rulings), "company_key", "left").join(
        model, "company_key", "left"
    )
    stands = (F.col("verdict_source") == "user") | (
        F.col("verdict_source").isNotNull() & (F.col("verdict") != "unknown")
    )

    def pick(user: Column, kept: str, listed: Column, modelled: Column, other: Column) -> Column:
        return (
            F.when(F.col("user_verdict").isNotNull(), user)
            .when(stands, F.col(kept))
            .when(F.col("ruling").isNotNull(), listed)
            .when(F.col("model_verdict").isNotNull(), modelled)
            .otherwise(other)
        )

    now = instant(as_of)
    settled = {
        "verdict": pick(
            F.col("user_verdict"), "verdict", F.col("ruling.verdict"), F.col("model_verdict"),
            F.lit("unknown"),
        ),
        "sector": pick(
            F.col("sector"), "sector", F.col("ruling.sector"), F.col("model_sector"), F.col("sector")
        ),
        "reason": pick(
            F.lit("Set manually."), "reason", F.col("ruling.reason"), F.col("model_reason"),
            F.col("reason"),
        ),
        "verdict_source": pick(
            F.lit("user"), "verdict_source", F.lit("blocklist"), F.lit("llm"),
            F.col("verdict_source"),
        ),
        "decided_at": pick(F.col("user_at"), "decided_at", now, now, F.col("decided_at")),
    }
    return joined.withColumns(settled).drop(
        "user_verdict", "user_at", "ruling", "model_verdict", "model_sector", "model_reason",
        "description",
    )


def company_screen(companies: DataFrame, postings: DataFrame) -> DataFrame:
    """A4, J6. Ruled-on employers with the live postings each ruling touches: flagged, then
    excluded, then the rest, costliest first. Postings are counted before the join."""
    live = postings.where(is_live()).groupBy("company_key").agg(F.count("*").alias("live"))
    rank = F.when(F.col("verdict") == "flagged", 0).when(F.col("verdict") == "excluded", 1)
    return (
        companies.where(F.col("verdict") != "unknown")
        .join(live, "company_key", "left")
        .withColumn("live_jobs", F.coalesce("live", F.lit(0)))
        .drop("live")
        .orderBy(rank.otherwise(2), F.col("live_jobs").desc(), "name")
    )


def screen_cost(companies: DataFrame, postings: DataFrame) -> DataFrame:
    """A4. Employers and live postings per verdict."""
    return company_screen(companies, postings).groupBy("verdict").agg(
        F.count("*").alias("companies"), F.sum("live_jobs").alias("live_jobs")
    )


def reviewable(companies: DataFrame) -> DataFrame:
    """T4. Employers whose verdict is worth showing or revisiting."""
    wanted = F.col("verdict").isin("flagged", "excluded") | (F.col("verdict_source") == "user")
    return companies.where(wanted).orderBy("verdict", "name")


def screen_dry_run(screened: DataFrame) -> DataFrame:
    """A16. What the term lists settle, and the estimated cost of the rest."""
    hit = F.col("ruling").isNotNull()
    return screened.agg(
        F.count("*").alias("companies"),
        F.count_if(hit).alias("excluded"),
        F.count_if(~hit).alias("unresolved"),
        F.round(F.count_if(~hit) * F.lit(COST_PER_CLASSIFICATION), 4).alias("estimated_cost"),
    )
