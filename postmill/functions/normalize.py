"""Raw posting to stored posting, as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.arrangement import arrangement
from postmill.functions.keys import company_key, fingerprint
from postmill.functions.pay import parse_pay


def normalize_postings(raw: DataFrame) -> DataFrame:
    """F15. Structured pay is kept; without it the description is read."""
    stated = F.coalesce(F.col("salary_min"), F.col("salary_max")).isNotNull()
    priced = raw.withColumn("_pay", parse_pay(F.when(~stated, F.col("description"))))
    source = (
        F.when(stated, F.col("salary_source"))
        .when(F.col("_pay.low").isNotNull(), "parsed")
        .otherwise("none")
    )
    return priced.withColumns(
        {
            "posting_key": fingerprint(F.col("company_name"), F.col("title"), F.col("location")),
            "company_key": company_key(F.col("company_name")),
            "remote_type": arrangement(
                F.col("title"), F.col("location"), F.col("description"), F.col("remote_type_hint")
            ),
            "salary_source": source,
            "salary_min": F.when(stated, F.col("salary_min")).otherwise(F.col("_pay.low")),
            "salary_max": F.when(stated, F.col("salary_max")).otherwise(F.col("_pay.high")),
            "company_name": F.trim("company_name"),
            "title": F.trim("title"),
        }
    ).drop("_pay", "remote_type_hint")
