"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stream state (one row per posting) lives on disk, not in executor memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "postmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster settings stay as submitted."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or where that is unset a
    folder beside the session's tables, which executors must be able to reach as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a step's result to the shared folder and go on from the written table. Later steps
    then neither repeat its work nor depend on its executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which Spark may choose to broadcast the keys of a written table.
FEW_ROWS = 50_000


def dealt(df: DataFrame, rows: int, few: int = FEW_ROWS) -> DataFrame:
    """A side of a join that is not broadcast if it has more than ``few`` rows. Spark takes a written table's
    size, and that of some of its columns, from its compressed files; the keys of a large one can be many
    times that in the driver's memory."""
    return df.hint("merge") if rows > few else df


#: Ends a query where a side of a join turns out to be empty, with tasks of the other side's shuffle still at work.
ENDS_EARLY = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def spare_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of each query of this session at its end. Otherwise they are kept until the driver
    collects garbage, which may be never where its heap is large. For sessions of one job: its steps are written.
    No query ends before its shuffles do, since what their tasks write after its end would stay."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    excluded = spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None)
    if ENDS_EARLY not in (excluded or ""):
        spark.conf.set("spark.sql.adaptive.optimizer.excludedRules", f"{excluded},{ENDS_EARLY}" if excluded else ENDS_EARLY)


def discard(spark: SparkSession, path: str) -> bool:
    """Delete a folder through Spark's own file systems; whether it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Staging:
    """Steps of one job in a folder of their own below the shared one, each of which can be deleted as soon as
    nothing reads it any more: what the job keeps on disk is what it still needs. ``codec`` compresses them, by
    default the session's."""

    def __init__(self, spark: SparkSession, label: str, codec: str | None = None):
        self.spark, self.root, self.codec, self.paths = spark, scratch(spark, label), codec, {}

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        """``stage`` within the folder."""
        path = f"{self.root}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=self.codec)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = (written, path)
        return written

    def free(self, *steps: DataFrame) -> None:
        """Delete these steps."""
        for step in steps:
            discard(self.spark, self.paths.pop(id(step))[1])

    def clear(self) -> None:
        """Delete the folder."""
        self.paths.clear()
        discard(self.spark, self.root)

    def free_others(self, *kept: DataFrame) -> None:
        """Delete all steps but these."""
        self.free(*[step for key, (step, _) in list(self.paths.items()) if key not in {id(k) for k in kept}])
