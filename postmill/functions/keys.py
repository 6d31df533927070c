"""Identity keys: company, title, city and the content fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.expr import let
from postmill.functions.text import squash

# Legal-form tokens that are no part of a company's identity.
LEGAL_FORMS = (
    "inc", "llc", "llp", "lp", "ltd", "corp", "corporation", "company", "co", "pbc", "gmbh", "plc",
    "sa", "sas", "ag", "bv", "nv", "srl", "pte", "pvt",
)

# Words that mark a parenthetical as a work arrangement, and its longest length.
ARRANGEMENT_WORD = r"\b(?:remote|hybrid|on[\s-]?site|wfh)\b"
MAX_ARRANGEMENT_WORDS = 4

# One pass over the title. The first branch matches an arrangement parenthetical and leaves
# group 1 unset, the second any other parenthetical; both are replaced by " $1 ".
_PARENTHETICAL = (
    rf"(?iU)\((?=[^)]*{ARRANGEMENT_WORD})"
    rf"\s*[^\s)]+(?:\s+[^\s)]+){{0,{MAX_ARRANGEMENT_WORDS - 1}}}\s*\)"
    r"|\(([^)]*)\)"
)


def company_key(name: Column) -> Column:
    """F9. Squashed name without legal-form tokens, unless nothing else is left."""
    squashed = squash(name)
    forms = F.array(*[F.lit(t) for t in LEGAL_FORMS])

    def strip_forms(s: Column) -> Column:
        kept = F.filter(F.split(s, " "), lambda t: ~F.array_contains(forms, t))
        return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), s)

    return let(squashed, strip_forms)


def title_key(title: Column) -> Column:
    """F10. Arrangement parentheticals go, other parentheticals stay as words."""
    return squash(F.regexp_replace(title, _PARENTHETICAL, " $1 "))


def city_key(location: Column) -> Column:
    """F11. First component, or the last where the first is a code of up to three characters."""
    parts = F.filter(
        F.transform(F.split(location, r"[,\-–—/]"), squash), lambda p: p != ""
    )

    def pick(p: Column) -> Column:
        inverted = (F.size(p) > 1) & (F.length(F.get(p, F.lit(0))) <= 3)
        return F.when(inverted, F.get(p, F.size(p) - 1)).otherwise(F.get(p, F.lit(0)))

    return F.coalesce(let(parts, pick), F.lit(""))


def fingerprint(company: Column, title: Column, location: Column) -> Column:
    """F12. SHA-256 over the three keys; nulls are blanked so that no field can shift."""
    keys = [company_key(company), title_key(title), city_key(location)]
    return F.sha2(F.concat_ws("|", *[F.coalesce(k, F.lit("")) for k in keys]), 256)
