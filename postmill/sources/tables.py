"""Stored tables (S12): commits of changed rows, read as the latest row of each key.

A commit writes its rows to a folder of their own and then one record that names the folder. Only what a
record names is read, and nothing that is there is ever overwritten, so a commit that breaks off at any
point leaves the table as it was and can simply run again; readers see the table before or after it. A
commit may carry a label: one whose label is recorded is not taken in twice.

So a commit costs its own rows and no more. Reading lays the commits over the last whole copy. Once they
hold more than ``share`` of its rows a new whole copy is written, so a row is rewritten about once while the
table changes by that share; many small commits are folded into one in between. ``vacuum`` deletes folders
that no reader of the current table needs.

A table has one writer at a time: feeds that share a workspace are united into one stream or one run. Where
a catalog offers ``MERGE INTO``, use that instead.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from postmill.schemas import conform, ddl
from postmill.session import FEW_ROWS, Staging, dealt, discard

GONE, NUMBER = "_gone", "_commit"
RECORD = "number long, kind string, path string, rows long, label string"
#: Kinds of commits: a whole copy, changed rows, and the changed rows of all commits since the whole copy.
WHOLE, CHANGED, FOLDED = "whole", "changed", "folded"


def absent(problem: AnalysisException) -> bool:
    """Whether reading failed because nothing is there, and not for another reason."""
    return problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@dataclass(frozen=True)
class StoredTable:
    """``schema`` maps column to type; ``key`` (a column or several) is unique. ``part`` may name a key
    column by which every folder is partitioned, for reads of few of its values; ``codec`` how rows are
    compressed, by default as the session says."""

    spark: SparkSession
    root: str
    schema: dict[str, str]
    key: str | tuple[str, ...]
    part: str | None = None
    share: float = 0.1
    fold_at: int = 16
    codec: str | None = None

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) else list(self.key)

    def records(self) -> list[Row]:
        """All commits, a small record each, in order."""
        reader = self.spark.read.schema(RECORD).option("recursiveFileLookup", True)
        try:
            return sorted(reader.json(f"{self.root}/commits").collect(), key=lambda r: r.number)
        except AnalysisException as problem:
            if not absent(problem):  # nothing committed yet
                raise
            return []

    def has(self, label: str) -> bool:
        return any(r.label == label for r in self.records())

    @staticmethod
    def _current(records: list[Row]) -> tuple[Row | None, list[Row]]:
        """The last whole copy and the commits to lay over it."""
        whole = max((i for i, r in enumerate(records) if r.kind == WHOLE), default=None)
        later = records if whole is None else records[whole + 1 :]
        folded = max((i for i, r in enumerate(later) if r.kind == FOLDED), default=0)
        return (None if whole is None else records[whole]), [r for r in later[folded:] if r.rows]

    def _load(self, records: list[Row]) -> DataFrame:
        kinds = ddl({**self.schema, GONE: "boolean", NUMBER: "bigint"})
        paths = [f"{self.root}/{r.path}" for r in records if r is not None and r.rows]
        if not paths:
            return self.spark.createDataFrame([], kinds)
        if not self.part:
            return self.spark.read.schema(kinds).parquet(*paths)
        # every folder is partitioned by itself
        return reduce(DataFrame.unionByName, [self.spark.read.schema(kinds).parquet(p) for p in paths])

    def _changes(self, later: list[Row], only: Column | None = None) -> DataFrame:
        """The latest change of each key."""
        rows = self._load(later)
        if only is not None:
            rows = rows.where(only)
        if len(later) < 2:
            return rows
        rest = [c for c in rows.columns if c not in self.keys]
        newest = F.max_by(F.struct(*rest), NUMBER).alias("_row")  # combines before the shuffle
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_row.*").select(*rows.columns)

    def _read(self, records: list[Row], only: Column | None = None) -> DataFrame:
        whole, later = self._current(records)
        base = self._load([whole])
        if only is not None:
            base = base.where(only)
        if not later:
            return base.select(*self.schema)
        changes = self._changes(later, only)
        return self._laid(base, dealt(changes.select(*self.keys), sum(r.rows for r in later)), changes)

    def _laid(self, base: DataFrame, changed: DataFrame, changes: DataFrame) -> DataFrame:
        """Changes over a copy, whose rows of the keys ``changed`` give way."""
        return base.join(changed, self.keys, "left_anti").select(*self.schema).unionByName(
            changes.where(~F.col(GONE)).select(*self.schema)
        )

    def read(self, parts: list | None = None) -> DataFrame:
        """The current rows; with ``parts`` those of some values of the partition column."""
        return self._read(self.records(), None if parts is None else F.col(self.part).isin(parts))

    def commit(self, changes: DataFrame, gone: DataFrame | None = None, label: str | None = None) -> bool:
        """Take in changed rows (one per key) and drop the keys in ``gone``; false if the label has been
        taken in before."""
        records = self.records()
        if label is not None and any(r.label == label for r in records):
            return False
        rows = conform(changes, self.schema).withColumn(GONE, F.lit(False))
        if gone is not None:
            rows = rows.unionByName(conform(gone, self.schema).withColumn(GONE, F.lit(True)))
        whole, later = self._current(records)
        first = whole is None and not later and gone is None
        records.append(self._write(rows, records, WHOLE if first else CHANGED, label))
        whole, later = self._current(records)
        if sum(r.rows for r in later) > self.share * (whole.rows if whole else 0):
            self._copy(records)
        elif len(later) >= self.fold_at:
            self._write(self._changes(later).drop(NUMBER), records, FOLDED, None)
        return True

    def _copy(self, records: list[Row], few: int = FEW_ROWS) -> None:
        """A new whole copy. Where many rows changed, the keys of the last copy that are among them are looked up
        first: of those that are new the copy has none, so few are left and its rows are not shuffled."""
        whole, later = self._current(records)
        size, steps, rows = sum(r.rows for r in later), None, self._read(records)
        if whole is not None and size > few:
            base, steps = self._load([whole]), Staging(self.spark, "copied")
            changed = dealt(self._load(later).select(*self.keys), size, few)
            hit = steps(base.select(*self.keys).join(changed, self.keys, "left_semi"), "hit")
            rows = self._laid(base, dealt(hit, hit.count(), few), self._changes(later))
        self._write(rows.withColumn(GONE, F.lit(False)), records, WHOLE, None)
        if steps:
            steps.clear()

    def _write(self, rows: DataFrame, records: list[Row], kind: str, label: str | None) -> Row:
        number, path = (records[-1].number + 1 if records else 0), f"data/{uuid.uuid4().hex}"
        writer = rows.select(*self.schema, GONE).withColumn(NUMBER, F.lit(number).cast("bigint")).write
        (writer.partitionBy(self.part) if self.part else writer).parquet(f"{self.root}/{path}", compression=self.codec)
        written = self.spark.read.schema(ddl({**self.schema, GONE: "boolean"})).parquet(f"{self.root}/{path}")
        return self._record(Row(number=number, kind=kind, path=path, rows=written.count(), label=label))

    def _record(self, record: Row) -> Row:
        """The commit itself: one small file, which is there or not. A folder of the same number without a
        record is what an earlier attempt left."""
        one = self.spark.createDataFrame([tuple(record)], RECORD).coalesce(1)
        one.write.mode("overwrite").json(f"{self.root}/commits/number={record.number}")
        return record

    def vacuum(self) -> int:
        """Delete the folders of commits that the current table is not read from; run it when no reader is
        at work on an older state. Returns how many."""
        records = self.records()
        whole, later = self._current(records)
        needed = {r.path for r in [whole, *later] if r is not None}
        old = [r for r in records if r.path not in needed]
        for r in old:
            discard(self.spark, f"{self.root}/{r.path}")
        return len(old)


def append_once(rows: DataFrame, root: str, batch_id: str) -> None:
    """An append-only log: one folder per batch, so a batch that runs again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
