"""Work arrangement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What feeds write, letters only, and what it means.
ALIASES = {
    "remote": "remote",
    "fullyremote": "remote",
    "remotefirst": "remote",
    "hybrid": "hybrid",
    "onsite": "onsite",
    "inoffice": "onsite",
    "office": "onsite",
}

# Patterns over title, location and prose.
HYBRID = r"(?iU)\bhybrid\b"
REMOTE = r"(?iU)\b(?:fully\s+)?remote\b"
NOT_REMOTE = (
    r"(?iU)\b(?:not|non|no|isn't)[\s-]+(?:\w+\s+){0,2}?remote\b"
    r"|\bremote\b(?:\s+\w+){0,2}?\s+(?:is\s+)?(?:not|un)(?:\s+|available|supported)"
)


def stated_arrangement(value: Column) -> Column:
    """F13."""
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(table, F.regexp_replace(F.lower(value), "[^a-z]", ""))


def arrangement(title: Column, location: Column, text: Column, hint: Column) -> Column:
    """F14. The stated value, then title and location, then prose; hybrid outranks remote."""
    strong = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(location, F.lit("")))
    body = F.coalesce(text, F.lit(""))
    stated = stated_arrangement(hint)
    return (
        F.when(stated.isNotNull(), stated)
        .when(strong.rlike(HYBRID), "hybrid")
        .when(strong.rlike(REMOTE), "remote")
        .when(body.rlike(HYBRID), "hybrid")
        .when(body.rlike(REMOTE) & ~body.rlike(NOT_REMOTE), "remote")
        .otherwise("onsite")
    )
