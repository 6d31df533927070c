"""The stored relations of one workspace folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from postmill import schemas as S
from postmill.sources.tables import StoredTable, absent


@dataclass(frozen=True)
class Workspace:
    """Human-owned state (``status_events``, rulings, answers) is kept in its own logs, which no
    ingest or scoring run writes to."""

    spark: SparkSession
    root: str

    def _table(self, name: str, schema: dict[str, str], key: str, codec: str | None = None) -> StoredTable:
        return StoredTable(self.spark, f"{self.root}/{name}", schema, key, codec=codec)

    @property
    def postings(self) -> StoredTable:
        # keys are digests in hexadecimal digits, which zstd halves
        return self._table("postings", S.POSTING, "posting_key", "zstd")

    @property
    def companies(self) -> StoredTable:
        return self._table("companies", S.COMPANY, "company_key")

    @property
    def scores(self) -> StoredTable:
        return self._table("scores", S.SCORE, "posting_key")

    def log_path(self, name: str) -> str:
        return f"{self.root}/logs/{name}"

    def log(self, name: str, schema: dict[str, str]) -> DataFrame:
        """An append-only log, empty before its first batch."""
        reader = self.spark.read.schema(S.ddl(schema)).option("recursiveFileLookup", True)
        try:
            return reader.parquet(self.log_path(name))
        except AnalysisException as problem:
            if not absent(problem):
                raise
            return self.spark.createDataFrame([], S.ddl(schema))
