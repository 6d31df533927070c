"""Place classes from a vocabulary table of any size.

The same reading as ``functions.places``, as joins instead of patterns: different texts are cut into places and
comma parts, the parts into runs of letters and digits, and every sequence of runs that a term may have is
looked up in the vocabulary by an equi-join. What a part holds is a row of flags; parts are folded into
places, and a place's flags give its class. No list is a pattern or a literal, and none is collected.

Word edges are those of any script here: a letter of any alphabet beside a term makes it another word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.places import CLASSES, split_places
from postmill.functions.text import collapse
from postmill.operators.common import unique_join
from postmill.session import stage

#: Sections whose terms may be ordinary words, which do not count in prose.
OPEN = ("non_us_countries", "non_us_cities", "bay_area", "us_wide", "anywhere")
#: Sections whose terms join the place before them, and those of them within the country.
DOMESTIC = ("us_states", "us_wide", "us_state_codes")
QUALIFIERS = (*DOMESTIC, "non_us_countries")
HOME = ("california", "ca")
EDGE = r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])"
CORE = r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
FLAGS = ("foreign", "state", "city", "local", "ambiguous", "wide", "home_name", "code", "home_code", "qualifier", "domestic")


def _runs(text: Column) -> Column:
    """Alternating runs of letters and digits and of what stands between them."""
    return F.filter(F.split(text, EDGE), lambda p: p != "")


def terms(vocab: DataFrame, home: tuple[str, str] = HOME) -> DataFrame:
    """Distinct terms of the table ``(section, term)`` as they are looked up: ``core`` from the first letter
    or digit to the last, what stands around it (``lead``, ``tail``), its runs, and whether it is an ordinary word."""
    low = vocab.select("section", F.trim(F.lower("term")).alias("term")).where(F.col("term").rlike(CORE)).distinct()
    common = low.where("section = 'common_words'").select("term", F.lit(True).alias("common"))
    cut = low.where("section <> 'common_words'").join(common, "term", "left")
    core = F.regexp_extract("term", f"^(.*?)({CORE})(.*)$", 2)
    kept = cut.select(
        F.when(F.col("section").isin("us_states", "us_state_codes") & (F.col("term") == home[0]), "home_name")
        .when(F.col("section").isin("us_states", "us_state_codes") & (F.col("term") == home[1]), "home_code")
        .otherwise(F.col("section")).alias("section"),
        "term", core.alias("core"), F.coalesce("common", F.lit(False)).alias("common"),
    )
    return kept.withColumns({
        "lead": F.expr("substr(term, 1, instr(term, core) - 1)"),
        "tail": F.expr("substr(term, instr(term, core) + length(core))"),
        "n": F.floor((F.size(_runs(F.col("core"))) + 1) / 2).cast("int"),
    })


def part_facts(parts: DataFrame, vocab: DataFrame, home: tuple[str, str] = HOME) -> DataFrame:
    """(part, prose, flags): what each different part holds. Parts that hold nothing have no row."""
    known = stage(terms(vocab, home), "place-terms")
    longest = known.agg(F.max("n")).first()[0] or 1
    different = parts.select("part", "prose").distinct().withColumn("_runs", _runs(F.col("part")))
    # runs stand at every other place, from the first or the second on
    first = F.when(F.get("_runs", F.lit(0)).rlike(r"^[\p{L}\p{N}]"), 0).otherwise(1)
    started = different.withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), F.size("_runs")), lambda i: (i < F.size("_runs")) & ((i - first) % 2 == 0))))
    sized = started.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(longest)))).where(F.col("at") + 2 * F.col("n") - 1 <= F.size("_runs"))
    end = F.col("at") + 2 * F.col("n") - 1
    grams = sized.select(
        "part", "prose", "n", F.array_join(F.slice("_runs", F.col("at") + 1, 2 * F.col("n") - 1), "").alias("core"),
        F.when(F.col("at") > 0, F.get("_runs", F.col("at") - 1)).otherwise("").alias("before"), (F.col("at") > 1).alias("run_before"),
        F.coalesce(F.get("_runs", end), F.lit("")).alias("after"), (end + 1 < F.size("_runs")).alias("run_after"),
    )
    # signs that belong to the term must be there, and the character beyond them no letter or digit
    lead = F.endswith("before", "lead") & ((F.col("lead") == "") | ~F.col("run_before") | (F.length("before") > F.length("lead")))
    tail = F.startswith("after", "tail") & ((F.col("tail") == "") | ~F.col("run_after") | (F.length("after") > F.length("tail")))
    hits = grams.join(known, ["core", "n"]).where(lead & tail)
    counts = ~(F.col("prose") & F.col("common") & F.col("section").isin(*OPEN))
    whole = F.col("part") == F.col("term")

    def any_of(*sections: str, only: Column = counts) -> Column:
        return F.bool_or(F.col("section").isin(*sections) & only)

    state = F.col("section").isin("home_name", "home_code")
    return hits.groupBy("part", "prose").agg(
        any_of("non_us_countries", "non_us_cities").alias("foreign"), any_of("us_states").alias("state"), any_of("us_cities").alias("city"),
        any_of("bay_area").alias("local"), any_of("bay_area_ambiguous").alias("ambiguous"), any_of("us_wide", "anywhere").alias("wide"),
        any_of("home_name").alias("home_name"), any_of("us_state_codes", only=whole).alias("code"), any_of("home_code", only=whole).alias("home_code"),
        F.bool_or(whole & (F.col("section").isin(*QUALIFIERS) | state)).alias("qualifier"), F.bool_or(whole & (F.col("section").isin(*DOMESTIC) | state)).alias("domestic"),
    )


def _rank(place: Column) -> Column:
    """F18. First class in the order of the lists, null when nothing is known."""
    single = place["n"] == 1
    code = place["later_code"] | (single & place["code"])
    home = place["home_name"] | place["later_home"] | (single & place["home_code"])

    def rank(name: str) -> Column:
        return F.lit(CLASSES.index(name))

    return (
        F.when(place["foreign"], rank("elsewhere"))
        .when(place["state"] | code | place["city"], rank("us"))
        .when(place["local"] | (home & place["ambiguous"]), rank("local"))
        .when(place["wide"], rank("us_wide"))
        .when(home, rank("us"))
    )


def _fold(parts: Column) -> Column:
    """F17. Places of one stretch between separators from its comma parts: a qualifier joins the place before
    it, except that a domestic one never joins a place that is local beyond doubt."""
    either = ("foreign", "state", "city", "local", "ambiguous", "wide", "home_name")

    def place(p: Column) -> Column:
        return F.struct(
            F.lit(1).alias("n"), *[p[f].alias(f) for f in either], p["code"].alias("code"), p["home_code"].alias("home_code"),
            F.lit(False).alias("later_code"), F.lit(False).alias("later_home"),
        )

    def joined(a: Column, p: Column) -> Column:
        return F.struct(
            (a["n"] + 1).alias("n"), *[(a[f] | p[f]).alias(f) for f in either], a["code"].alias("code"), a["home_code"].alias("home_code"),
            (a["later_code"] | p["code"]).alias("later_code"), (a["later_home"] | p["home_code"]).alias("later_home"),
        )

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & p["qualifier"] & ~(p["domestic"] & last["local"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last, p)))).otherwise(F.concat(done, F.array(place(p))))

    kind = "array<struct<n:int," + ",".join(f"{f}:boolean" for f in (*either, "code", "home_code", "later_code", "later_home")) + ">>"
    return F.aggregate(parts, F.array().cast(kind), step)


def text_ranks(texts: DataFrame, vocab: DataFrame, home: tuple[str, str] = HOME) -> DataFrame:
    """F19. (id, rank) of ``texts(id, text, prose)`` in which a place is known; ids are unique."""
    plain = collapse(F.lower("text"))
    stretches = texts.select("id", "prose", F.posexplode(split_places(plain)).alias("stretch", "s"))
    cut = F.filter(F.transform(F.split("s", ","), lambda p: F.trim(p)), lambda p: p != "")
    parts = stage(stretches.select("id", "prose", "stretch", F.posexplode(cut).alias("nth", "part")), "place-parts")
    facts = part_facts(parts, vocab, home)
    told = parts.join(facts, ["part", "prose"], "left").select(
        "id", "stretch", F.struct("nth", *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in FLAGS]).alias("p"), F.col("qualifier").isNotNull().alias("known")
    )
    # parts of one stretch of one text
    folded = told.groupBy("id", "stretch").agg(F.array_sort(F.collect_list("p")).alias("parts"), F.bool_or("known").alias("known")).where("known")
    ranked = folded.select("id", F.array_min(F.transform(_fold(F.col("parts")), _rank)).alias("rank"))
    return ranked.groupBy("id").agg(F.min("rank").alias("rank")).where("rank IS NOT NULL")


def classify_by_table(
    postings: DataFrame, vocab: DataFrame, key: str = "posting_key", header_chars: int | None = None, home: tuple[str, str] = HOME
) -> DataFrame:
    """F20. ``postings`` with ``location_class`` from the vocabulary ``(section, term)``: from the location, else from the
    description, or its first ``header_chars`` characters. Each different location is read once."""
    header = F.col("description") if header_chars is None else F.left("description", F.lit(header_chars))
    rows = postings.withColumn("_place", F.coalesce("location", F.lit("")))
    places = rows.select(F.col("_place").alias("id")).distinct().select("id", F.col("id").alias("text"), F.lit(False).alias("prose"))
    ranks = text_ranks(places, vocab, home).select(F.col("id").alias("_place"), "rank")
    located = stage(unique_join(rows, ranks, "_place", "left").drop("_place").withColumn("_rank", F.col("rank")).drop("rank"), "located")
    told = located.where(F.col("_rank").isNotNull())
    silent = located.where(F.col("_rank").isNull()).withColumn("_text", F.sha2(F.coalesce(header, F.lit("")), 256)).drop("_rank")
    texts = silent.groupBy(F.col("_text").alias("id")).agg(F.first(F.coalesce(header, F.lit(""))).alias("text")).withColumn("prose", F.lit(True))
    read = text_ranks(texts, vocab, home).select(F.col("id").alias("_text"), F.col("rank").alias("_rank"))
    both = told.unionByName(unique_join(silent, read, "_text", "left").drop("_text"))
    classes = F.array(*[F.lit(c) for c in CLASSES])
    name = F.get(classes, F.coalesce("_rank", F.lit(CLASSES.index("unknown"))))
    return both.withColumn("location_class", name).drop("_rank")
