"""Text clean-up, timestamps and display labels."""

from __future__ import annotations

import json
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.expr import let

# Unicode white space plus the four ASCII separators Java leaves out of that class.
SPACES = r"(?U)[\s\x1c-\x1f]+"
TAG = r"<[^>]+>"

# Named character references of HTML5, as the standard library lists them; some also stand without a semicolon.
NAMED = json.dumps(html5)
BARE = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
# References that most texts have, tried before the whole list.
USUAL = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "#39;", "#x27;", "#x2F;")
# Numbers 128 to 159 mean what they mean in Windows-1252, where it has a character there.
WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))
#: Digits of a number that may be a character.
MOST_DIGITS = 10


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _character(number: Column) -> Column:
    """What a numeric reference stands for: nothing for control and non-characters, U+FFFD for what is no
    character at all."""
    lost = F.lit("\ufffd")
    nothing = (
        number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
        | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when(number.isNull() | (number > 0x10FFFF) | (number == 0) | number.between(0xD800, 0xDFFF), lost)
        .when(number.between(128, 159), F.substr(F.lit(WINDOWS), (number - 127).cast("int"), F.lit(1)))
        .when(nothing, F.lit(""))
        .otherwise(plain)
    )


def _reference(piece: Column, bare: bool) -> Column:
    """The text after an ampersand with the reference that it begins with decoded; ``bare`` ones too, which no
    semicolon ends."""
    end = ";?" if bare else ";"

    def after(start: Column) -> Column:
        return F.substr(piece, F.length(start) + 1, F.length(piece))

    def numeric(digits: Column, base: int) -> Column:
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(short) <= MOST_DIGITS, F.conv(short, base, 10).cast("bigint"))

    def by_number(whole: str, digits: str, base: int) -> Column:
        return F.concat(_character(numeric(F.regexp_extract(piece, digits, 1), base)), after(F.regexp_extract(piece, whole, 0)))

    table = F.from_json(F.lit(NAMED), "map<string,string>")

    def by_name(name: Column) -> Column:
        # the table stands in the expression once: plans repeat its text wherever they are kept
        names = F.array(name, F.regexp_extract(piece, BARE, 0)) if bare else F.array(name)
        known = F.transform(names, lambda n: F.struct(n.alias("name"), F.try_element_at(table, n).alias("text")))
        return let(
            F.get(F.filter(known, lambda k: k["text"].isNotNull()), F.lit(0)),
            lambda k: F.when(k.isNotNull(), F.concat(k["text"], after(k["name"]))).otherwise(F.concat(F.lit("&"), piece)),
        )

    out = F.when(F.lit(False), piece)
    for name in USUAL:
        out = out.when(F.startswith(piece, F.lit(name)), F.concat(F.lit(unescape("&" + name)), F.substr(piece, F.lit(len(name) + 1), F.length(piece))))
    return (
        out.when(piece.rlike("^#[0-9]+" + end), by_number("^#[0-9]+" + end, "^#([0-9]+)", 10))
        .when(piece.rlike("^#[xX][0-9a-fA-F]+" + end), by_number("^#[xX][0-9a-fA-F]+" + end, "^#[xX]([0-9a-fA-F]+)", 16))
        .otherwise(let(F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32}" + end, 0), by_name))
    )


def decode_entities(text: Column, bare: bool = True) -> Column:
    """Character references of HTML5, decoded as browsers do, without a semicolon too where that is allowed, unless
    ``bare`` is off. Only texts with an ampersand are taken apart."""

    def decoded(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda piece: _reference(piece, bare))
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    return F.when(text.contains("&"), let(F.split(text, "&"), decoded)).otherwise(text)


def strip_html(raw: Column, bare: bool = True) -> Column:
    """F1. Decode, drop tags, decode again, collapse white space. With ``bare`` off only references that a semicolon
    ends are decoded."""
    return F.coalesce(_plain(raw, bare), F.lit(""))


def _plain(raw: Column, bare: bool) -> Column:
    def step(text: Column, again: Column) -> Column:
        shown = F.when(again, F.regexp_replace(text, TAG, " ")).otherwise(text)
        return let(shown, lambda t: decode_entities(t, bare))

    # one expression that is run twice
    return collapse(F.aggregate(F.array(F.lit(False), F.lit(True)), raw, step))


def strip_html_each(raw: Column) -> Column:
    """F1 over an array of fragments; a null one is empty."""
    return F.transform(raw, lambda r: strip_html(r))


def join_sections(*parts: Column) -> Column:
    """F2. Non-empty trimmed sections, one blank line between them."""
    return join_section_array(F.array(*parts))


def join_section_array(parts: Column) -> Column:
    edges = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, edges, ""))
    return F.array_join(F.filter(trimmed, lambda p: p.isNotNull() & (p != "")), "\n\n")


def squash(text: Column) -> Column:
    """F8. Lower case; each run outside ``[a-z0-9]`` becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def iso_timestamp(text: Column) -> Column:
    """F7. ISO text to an instant; no zone means UTC (the session zone); bad text is null."""
    return F.when(text.rlike(r"^\d{4}-?\d{2}-?\d{2}"), text.try_cast("timestamp"))


def epoch_millis(value: Column) -> Column:
    """F7. Epoch milliseconds; figures below 1e12 are seconds in disguise and give null."""
    return F.when(value >= F.lit(1_000_000_000_000), F.timestamp_millis(value.cast("long")))


def age_label(when: Column, as_of: Column) -> Column:
    """F36."""
    hours = (_micros(as_of) - _micros(when)) / F.lit(3_600_000_000)
    return (
        F.when(when.isNull(), "unknown")
        .when(hours < 1, "just now")
        .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def money_label(low: Column, high: Column) -> Column:
    """F36."""

    def thousands(x: Column) -> Column:
        return F.concat(F.lit("$"), F.format_number(F.floor(x / 1000), 0), F.lit("k"))

    return (
        F.when(low.isNull() & high.isNull(), "not listed")
        .when(high.isNull(), F.concat(thousands(low), F.lit("+")))
        .when(low.isNull(), F.concat(F.lit("up to "), thousands(high)))
        .when(low == high, thousands(low))
        .otherwise(F.concat(thousands(low), F.lit("–"), thousands(high)))
    )


def percent_label(value: Column) -> Column:
    """F36."""
    shown = F.concat(F.bround(value * 100, 0).cast("long").cast("string"), F.lit("%"))
    return F.when(value.isNull(), "—").otherwise(shown)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def judge_input(title: Column, company: Column, place: Column, kind: Column, text: Column) -> Column:
    """F38. The text handed to an outside judge."""
    return F.concat(
        F.lit("Title: "), title,
        F.lit("\nCompany: "), company,
        F.lit("\nLocation: "), F.coalesce(F.nullif(place, F.lit("")), F.lit("unspecified")),
        F.lit(" ("), kind, F.lit(")\n\nDescription:\n"), text,
    )


def embed_input(title: Column, text: Column) -> Column:
    """F38. The text handed to an embedding model."""
    return F.concat(title, F.lit("\n"), text)


def parts(text: Column, chars: int) -> Column:
    """F38. A text in parts of ``chars`` characters, in order, so that an input limit loses nothing; an
    empty text is one empty part."""
    last = F.greatest(F.ceil(F.length(text) / chars) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * chars + 1, F.lit(chars)))


def resume_text(resume: Column) -> Column:
    """F37. Flatten a resume struct in a fixed order.

    Fields: ``summary``, ``skills array<struct<grp, items>>``, ``experience
    array<struct<title, company, bullets>>``, ``education array<struct<degree, school>>``.
    """

    def pair(a: Column, b: Column) -> Column:
        return F.trim(F.concat(F.coalesce(a, F.lit("")), F.lit(" "), F.coalesce(b, F.lit(""))))

    skills = F.transform(
        resume["skills"], lambda s: F.concat(s["grp"], F.lit(": "), F.array_join(s["items"], ", "))
    )
    roles = F.flatten(
        F.transform(
            resume["experience"],
            lambda r: F.concat(
                F.array(pair(r["title"], r["company"])),
                F.coalesce(r["bullets"], F.array().cast("array<string>")),
            ),
        )
    )
    schools = F.transform(resume["education"], lambda e: pair(e["degree"], e["school"]))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(resume["summary"]),
        F.coalesce(skills, none), F.coalesce(roles, none), F.coalesce(schools, none),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")
