"""Feed formats: payload schema and its mapping to raw postings.

Payload files land under ``source=<name>/token=<board>/...``. Each format is a ``SourceSpec``;
a new feed is one more entry in ``SOURCES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.expr import let
from postmill.functions.pay import structured_pay
from postmill.functions.text import (
    epoch_millis,
    iso_timestamp,
    join_section_array,
    strip_html,
    strip_html_each,
)
from postmill.schemas import RAW_POSTING, conform
from postmill.vocab import read_lists


@dataclass(frozen=True)
class SourceSpec:
    """``to_raw`` maps payload rows (with ``token``) to raw postings. ``items`` names the array
    of postings inside a payload, or is null where the payload root is that array."""

    name: str
    schema: str
    to_raw: Callable[[DataFrame], DataFrame]
    items: str | None = "jobs"
    needs_token: bool = True
    min_interval_seconds: int = 0
    #: Whether payloads are comments of threads, of which only the newest counts.
    threads: bool = False


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _first(*columns: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[_blank_to_null(c) for c in columns])


# -- S1 ------------------------------------------------------------------------------------

GREENHOUSE = (
    "jobs array<struct<id: bigint, title: string, company_name: string, absolute_url: string,"
    " content: string, first_published: string, updated_at: string, location: struct<name: string>>>,"
    " meta struct<total: bigint>"
)


def greenhouse_raw(payloads: DataFrame) -> DataFrame:
    job = payloads.select("token", F.explode("jobs").alias("j"))
    return job.select(
        F.lit("greenhouse").alias("source"),
        F.col("j.id").cast("string").alias("source_job_id"),
        _first(F.col("j.company_name"), F.col("token")).alias("company_name"),
        F.col("j.title").alias("title"),
        F.col("j.location.name").alias("location"),
        strip_html(F.col("j.content")).alias("description"),
        F.col("j.absolute_url").alias("apply_url"),
        F.coalesce(
            iso_timestamp(F.col("j.first_published")), iso_timestamp(F.col("j.updated_at"))
        ).alias("posted_at"),
        F.lit("none").alias("salary_source"),
    )


# -- S2 ------------------------------------------------------------------------------------

LEVER = (
    "id string, text string, categories struct<location: string>, descriptionPlain string,"
    " description string, lists array<struct<text: string, content: string>>,"
    " additionalPlain string, additional string, hostedUrl string, applyUrl string,"
    " createdAt bigint, workplaceType string"
)


def lever_raw(payloads: DataFrame) -> DataFrame:
    blocks = F.transform(
        "lists",
        lambda b: F.concat(
            F.coalesce(b["text"], F.lit("")), F.lit(" "), F.coalesce(b["content"], F.lit(""))
        ),
    )
    none = F.array().cast("array<string>")

    def unless(plain: str, html: str) -> Column:
        return F.when(F.coalesce(F.col(plain), F.lit("")) == "", F.col(html))

    # all fragments by one expression
    fragments = F.concat(
        F.array(unless("descriptionPlain", "description"), unless("additionalPlain", "additional")),
        F.coalesce(blocks, none),
    )

    def sections(plain: Column) -> Column:
        return F.concat(
            F.array(_first(F.col("descriptionPlain"), F.get(plain, F.lit(0)))),
            F.slice(plain, F.lit(3), F.size(plain)),
            F.array(_first(F.col("additionalPlain"), F.get(plain, F.lit(1)))),
        )

    return payloads.select(
        F.lit("lever").alias("source"),
        F.col("id").alias("source_job_id"),
        F.col("token").alias("company_name"),
        F.col("text").alias("title"),
        F.col("categories.location").alias("location"),
        join_section_array(let(strip_html_each(fragments), sections)).alias("description"),
        _first(F.col("hostedUrl"), F.col("applyUrl")).alias("apply_url"),
        epoch_millis(F.col("createdAt")).alias("posted_at"),
        F.col("workplaceType").alias("remote_type_hint"),
        F.lit("none").alias("salary_source"),
    )


# -- S3 ------------------------------------------------------------------------------------

ASHBY = (
    "jobs array<struct<id: string, title: string, location: string, descriptionPlain: string,"
    " descriptionHtml: string, jobUrl: string, applyUrl: string, publishedAt: string,"
    " isListed: boolean, workplaceType: string, shouldDisplayCompensationOnJobPostings: boolean,"
    " compensation: struct<compensationTiers: array<struct<components: array<struct<"
    "compensationType: string, `interval`: string, currencyCode: string, minValue: double,"
    " maxValue: double>>>>>>>"
)


def ashby_raw(payloads: DataFrame) -> DataFrame:
    job = (
        payloads.select("token", F.explode("jobs").alias("j"))
        .where(F.coalesce(F.col("j.isListed"), F.lit(True)))
        .withColumn(
            "pay",
            structured_pay(
                F.col("j.shouldDisplayCompensationOnJobPostings"),
                F.col("j.compensation.compensationTiers"),
            ),
        )
    )
    return job.select(
        F.lit("ashby").alias("source"),
        F.col("j.id").alias("source_job_id"),
        F.col("token").alias("company_name"),
        F.col("j.title").alias("title"),
        F.col("j.location").alias("location"),
        F.coalesce(
            _blank_to_null(F.col("j.descriptionPlain")), strip_html(F.col("j.descriptionHtml"))
        ).alias("description"),
        _first(F.col("j.jobUrl"), F.col("j.applyUrl")).alias("apply_url"),
        iso_timestamp(F.col("j.publishedAt")).alias("posted_at"),
        F.col("j.workplaceType").alias("remote_type_hint"),
        F.col("pay.low").alias("salary_min"),
        F.col("pay.high").alias("salary_max"),
        F.when(F.col("pay.low").isNotNull(), "structured").otherwise("none").alias("salary_source"),
    )


# -- S4 ------------------------------------------------------------------------------------

REMOTIVE = (
    "jobs array<struct<id: bigint, url: string, title: string, company_name: string,"
    " description: string, publication_date: string, candidate_required_location: string>>"
)


def remotive_raw(payloads: DataFrame) -> DataFrame:
    job = payloads.select(F.explode("jobs").alias("j"))
    return job.select(
        F.lit("remotive").alias("source"),
        F.col("j.id").cast("string").alias("source_job_id"),
        _first(F.col("j.company_name"), F.lit("unknown")).alias("company_name"),
        F.col("j.title").alias("title"),
        F.col("j.candidate_required_location").alias("location"),
        strip_html(F.col("j.description")).alias("description"),
        F.col("j.url").alias("apply_url"),
        iso_timestamp(F.col("j.publication_date")).alias("posted_at"),
        F.lit("remote").alias("remote_type_hint"),
        F.lit("none").alias("salary_source"),
    )


# -- S5, S6, F6 ----------------------------------------------------------------------------

STORIES = ("hits array<struct<objectID: string, title: string, created_at: string>>")
THREAD = (
    "hits array<struct<objectID: string, comment_text: string, created_at: string,"
    " parent_id: bigint, story_id: bigint>>, nbPages int"
)

# Which threads count, and what a header segment looks like.
THREAD_TITLE = r"(?iU)who\s+is\s+hiring"
OTHER_THREAD = r"(?iU)wants\s+to\s+be\s+hired|freelancer"
ROLE_WORD = (
    r"(?iU)\b(engineer(ing)?|developer|scientist|architect|sre|devops|programmer|analyst|designer"
    r"|manager|lead|founder|cto|full[\s-]?stack|backend|frontend|infrastructure|security"
    r"|researcher)\b"
)
PLACE_WORD = r"(?iU)\b(remote|onsite|on-site|hybrid)\b"
EMPLOYMENT_TYPE = (
    r"(?iU)^\s*(full[\s-]?time|part[\s-]?time|contract|intern(ship)?|freelance|flexible"
    r"|permanent)\s*$"
)
LINK_PARENTHETICAL = r"(?iU)\(\s*(?:https?://)?[\w.-]+\.[a-z]{2,}(?:/[^)\s]*)?\s*\)"
#: A segment longer than this is a sentence, not an employer.
MAX_COMPANY_CHARS = 60
ITEM_LINK = "https://news.ycombinator.com/item?id="


def latest_thread(stories: DataFrame) -> DataFrame:
    """S5. One row: the newest hiring thread. ``stories(objectID, title, created_at)``."""
    wanted = stories.where(F.col("title").rlike(THREAD_TITLE) & ~F.col("title").rlike(OTHER_THREAD))
    newest = F.struct(iso_timestamp(F.col("created_at")), F.col("objectID").try_cast("bigint"))
    return wanted.agg(F.max_by("objectID", newest).alias("story_id"))


def landed_stories(spark: SparkSession, landing: str, lines: bool = False) -> DataFrame | None:
    """S5. Landed lists of threads (``source=hn_stories``); nothing where none has landed."""
    try:
        payloads = spark.read.schema(STORIES).options(**json_options(lines)).json(f"{landing}/source=hn_stories")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return payloads.select(F.explode("hits").alias("h")).select("h.*")


def only_latest(payloads: DataFrame, stories: DataFrame | None) -> DataFrame:
    """S5, S6. Payloads with the comments of one thread: the newest hiring thread of the landed list, which
    has none if the list names none; without a list the newest thread that comments have landed of."""
    if stories is None:
        seen = payloads.select(F.array_max(F.transform("hits", lambda h: h["story_id"])).alias("s"))
        latest = seen.agg(F.max("s").alias("_story"))
    else:
        latest = latest_thread(stories).select(F.col("story_id").try_cast("bigint").alias("_story"))
    one = F.broadcast(latest.where("_story IS NOT NULL").withColumn("_k", F.lit(0)))  # a single row
    told = payloads.withColumn("_k", F.lit(0)).join(one, "_k")
    own = F.filter("hits", lambda h: h["story_id"] == F.col("_story"))
    return told.withColumn("hits", own).drop("_k", "_story")


def header_fields(head: Column, most_company_chars: int = MAX_COMPANY_CHARS) -> Column:
    """F6. ``struct<company_name, title, location>`` of a header line, or null where it names no
    employer or no role."""
    segments = F.filter(
        F.transform(F.split(head, r"\|"), lambda s: F.btrim(s, F.lit(" *_·-"))), lambda s: s != ""
    )

    def read(parts: Column) -> Column:
        bare = F.regexp_replace(F.get(parts, F.lit(0)), LINK_PARENTHETICAL, "")
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        roles = F.filter(rest, lambda s: s.rlike(ROLE_WORD) & ~s.rlike(EMPLOYMENT_TYPE))
        return F.struct(
            F.btrim(bare, F.lit(" -–—,")).alias("company_name"),
            F.get(roles, F.lit(0)).alias("title"),
            rest.alias("rest"),
        )

    def place(h: Column) -> Column:
        places = F.filter(h["rest"], lambda s: (s != h["title"]) & s.rlike(PLACE_WORD))
        usable = (F.length(h["company_name"]) >= 1) & h["title"].isNotNull()
        # A segment too long for a name is a sentence: without a title the row goes to quarantine.
        title = F.when(F.length(h["company_name"]) <= most_company_chars, h["title"]).alias("title")
        return F.when(usable, F.struct(h["company_name"], title, F.get(places, F.lit(0)).alias("location")))

    return let(let(segments, read), place)


def parse_header(comments: DataFrame) -> DataFrame:
    """F6. Add ``company_name``, ``title`` and ``location`` read off the header line, the part of
    ``comment_text`` before its first paragraph mark; rows without a readable header are dropped."""
    head = strip_html(F.get(F.split("comment_text", "<p>", 2), F.lit(0)))
    read = comments.withColumn("_head", header_fields(head)).where(F.col("_head").isNotNull())
    return read.select("*", "_head.*").drop("_head")


def thread_raw(payloads: DataFrame) -> DataFrame:
    """S6. Top-level comments with a readable header."""
    hits = payloads.select(F.explode("hits").alias("h")).select("h.*")
    top = hits.where(F.col("parent_id").eqNullSafe(F.col("story_id")))
    return parse_header(top).select(
        F.lit("hn_algolia").alias("source"),
        F.col("objectID").alias("source_job_id"),
        "company_name",
        "title",
        "location",
        strip_html(F.col("comment_text")).alias("description"),
        F.concat(F.lit(ITEM_LINK), F.col("objectID")).alias("apply_url"),
        iso_timestamp(F.col("created_at")).alias("posted_at"),
        F.col("location").alias("remote_type_hint"),
        F.lit("none").alias("salary_source"),
    )


# -- S7, O4 --------------------------------------------------------------------------------

SOURCES: dict[str, SourceSpec] = {
    spec.name: spec
    for spec in (
        SourceSpec("greenhouse", GREENHOUSE, greenhouse_raw),
        SourceSpec("lever", LEVER, lever_raw, items=None),
        SourceSpec("ashby", ASHBY, ashby_raw),
        # Their published guidance is four calls a day.
        SourceSpec("remotive", REMOTIVE, remotive_raw, needs_token=False, min_interval_seconds=21_600),
        SourceSpec("hn_algolia", THREAD, thread_raw, items="hits", needs_token=False, threads=True),
    )
}

CORRUPT = "_corrupt_record"


def payload_schema(spec: SourceSpec) -> str:
    """Payload fields and the text of unreadable payloads."""
    return f"{spec.schema}, {CORRUPT} string"


def read_payloads(
    spark: SparkSession, landing: str, spec: SourceSpec, lines: bool = False, fresh: DataFrame | None = None
) -> DataFrame:
    """Payload files of one feed. By default a file is one JSON document (for a bare array, one
    record per element). With ``lines`` a file holds one payload per line: such files can be
    split and spare the cluster millions of small ones. ``fresh(file, modified)`` limits the read to those
    files: older ones are passed over when the folder is listed, others by a join on their path."""
    nothing = spark.createDataFrame([], f"{payload_schema(spec)}, _metadata struct<file_path: string>, token string")
    reader = spark.read.schema(payload_schema(spec)).options(**json_options(lines))
    if fresh is not None:
        own = fresh.where(F.col("file").contains(f"/source={spec.name}/"))
        oldest = own.agg(F.date_format(F.min("modified") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
        if oldest is None:
            return nothing
        reader = reader.option("modifiedAfter", oldest)
    try:
        payloads = reader.json(f"{landing}/source={spec.name}").select("*", "_metadata")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":  # nothing of this feed has landed
            raise
        return nothing
    if fresh is not None:
        payloads = payloads.join(own.select(F.col("file").alias("_file")), F.col("_metadata.file_path") == F.col("_file"), "left_semi")
    return with_token(payloads)


def json_options(lines: bool) -> dict[str, str]:
    return {
        "multiLine": str(not lines).lower(),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "recursiveFileLookup": "true",
    }


def with_token(payloads: DataFrame) -> DataFrame:
    token = F.regexp_extract(F.col("_metadata.file_path"), r"/token=([^/]+)/", 1)
    return payloads.withColumn("token", _blank_to_null(token))


def sound(raw: DataFrame) -> Column:
    """Mandatory fields are present."""
    return (
        F.col("source_job_id").isNotNull()
        & F.col("title").isNotNull()
        & F.col("apply_url").isNotNull()
    )


def read_raw(
    spark: SparkSession, landing: str, names: Iterable[str] | None = None, lines: bool = False,
    fresh: DataFrame | None = None,
) -> DataFrame:
    """O4. Raw postings of all feeds, as one table; unsound rows are kept for ``quarantine``. Of threads the
    newest counts (S5)."""
    frames = []
    for spec in [SOURCES[n] for n in (names or SOURCES)]:
        payloads = read_payloads(spark, landing, spec, lines, fresh).where(F.col(CORRUPT).isNull())
        if spec.threads:
            payloads = only_latest(payloads, landed_stories(spark, landing, lines))
        frames.append(conform(spec.to_raw(payloads), RAW_POSTING))
    return reduce(DataFrame.unionByName, frames)


def corrupt_rows(payloads: DataFrame, spec: SourceSpec) -> DataFrame:
    """Unreadable payloads with their path and text, for the quarantine, and whether the first
    field could be read (Spark reads the corrupt text only beside a field)."""
    first = spec.schema.split()[0]
    return payloads.where(F.col(CORRUPT).isNotNull()).select(
        F.lit(spec.name).alias("source"), "token", F.col("_metadata.file_path").alias("path"),
        F.col(CORRUPT).alias("payload"), F.col(first).isNotNull().alias("partly_read"),
    )


def unreadable(
    spark: SparkSession, landing: str, names: Iterable[str] | None = None, lines: bool = False,
    fresh: DataFrame | None = None,
) -> DataFrame:
    """O4, S9. Payloads of all feeds that could not be read as their schema."""
    frames = [corrupt_rows(read_payloads(spark, landing, SOURCES[n], lines, fresh), SOURCES[n]) for n in (names or SOURCES)]
    return reduce(DataFrame.unionByName, frames)


def split_sound(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings fit for use, and the quarantine of those lacking a mandatory field."""
    ok = sound(raw)
    return raw.where(ok), raw.where(~ok)


def targets(boards: DataFrame) -> DataFrame:
    """S7. (source, token) of the boards of a settings table, and of the feeds that need none."""
    rows = [(s.name, None) for s in SOURCES.values() if not s.needs_token]
    return boards.select("source", "token").unionAll(boards.sparkSession.createDataFrame(rows, "source string, token string"))


def targets_table(spark: SparkSession, path: str) -> DataFrame:
    """S7. The same from a settings file of ``source: [tokens]``."""
    rows = [(name, str(t)) for name, tokens in read_lists(path).items() for t in tokens or []]
    return targets(spark.createDataFrame(rows, "source string, token string"))
