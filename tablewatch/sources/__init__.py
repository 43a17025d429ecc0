"""Reading and writing: versioned documents, file listings, incremental catalogs, quarantine, runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: The version that inspections must have, and what they hold.
INSPECTION_VERSION = 7
INSPECTION = "schema_version int, status string, assets array<struct<path:string,kind:string,properties:array<struct<name:string,value:string>>>>, decode_errors array<struct<path:string,code:string>>"
TABLE_KINDS = ("DataTable", "CompositeDataTable")


def inspections(documents: DataFrame, column: str) -> DataFrame:
    """``documents`` with their JSON ``column`` parsed: status, assets and decode_errors.

    Absent lists are empty, partial documents stay. A document of another version, or that is no JSON object, is an error.
    """
    rows = documents.withColumn("_d", F.from_json(column, INSPECTION))
    right = F.when(F.col("_d.schema_version") == INSPECTION_VERSION, True).otherwise(F.raise_error(F.lit(f"schema_version must be {INSPECTION_VERSION}")).cast("boolean"))
    rows = rows.where(right).withColumns({"status": F.col("_d.status"), "decode_errors": F.coalesce("_d.decode_errors", F.array())})
    assets = F.transform(F.coalesce("_d.assets", F.array()), lambda a: F.struct(a["path"].alias("path"), a["kind"].alias("kind"), F.coalesce(a["properties"], F.array()).alias("properties")))
    return rows.withColumn("assets", assets).drop("_d", column)


def scan_inspections(spark: SparkSession, path: str) -> DataFrame:
    """The JSON documents below ``path``, one in each file or line."""
    return inspections(spark.read.text(path).where("length(value) > 0"), "value")


def watch_inspections(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream: files that arrive below ``path`` are read once, and a query that restarts goes on after those it has read."""
    return inspections(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).where("length(value) > 0"), "value")


def table_descriptors(inspected: DataFrame) -> DataFrame:
    """(table_path, kind, completeness) of the table assets of inspections; partial if the document is or had errors."""
    partial = (F.col("status") == "partial") | (F.size("decode_errors") > 0)
    rows = inspected.select(F.when(partial, "partial").otherwise("complete").alias("completeness"), F.explode("assets").alias("a"))
    return rows.where(F.col("a.kind").isin(*TABLE_KINDS)).select(F.col("a.path").alias("table_path"), "a.kind", "completeness")


def scan_snapshots(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Snapshots of both versions; those without a producer can only be read."""
    both = current.unionByName(legacy, allowMissingColumns=True)
    return both.withColumn("classification", F.when(F.col("producer").isNull(), "legacy_read_only").otherwise("current"))


def with_suffix(listing: DataFrame, path: str, suffix: str) -> DataFrame:
    """Entries of a listing whose name ends in ``suffix``, case aside, in order of their paths."""
    return listing.where(F.lower(path).endswith(suffix.lower())).orderBy(path)


def discover_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, modificationTime, length) of files below ``path`` by suffix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return with_suffix(files.select("path", "modificationTime", "length"), "path", suffix)


def incremental_catalog(previous: DataFrame, current: DataFrame, key: str, signature: list[str], failed: Column | None = None) -> DataFrame:
    """(key, outcome): hit where ``previous`` has the same signature, changed or added where work is to do, deleted where
    it is gone; what ``failed`` to be looked at is never a hit."""
    p, c = previous.select(key, F.struct(*signature).alias("_signature")).alias("p"), current.select("*", F.struct(*signature).alias("_signature"), (failed if failed is not None else F.lit(False)).alias("_failed")).alias("c")
    same = F.col("p._signature").eqNullSafe(F.col("c._signature"))
    outcome = F.when(F.col(f"c.{key}").isNull(), "deleted").when(F.col("c._failed"), "failed").when(F.col(f"p.{key}").isNull(), "added").when(same, "hit").otherwise("changed")
    return p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full").select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), outcome.alias("outcome"))


def catalog_report(outcomes: DataFrame) -> DataFrame:
    """How many of each outcome, in one row."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("hit", "changed", "added", "deleted", "failed")])


def migrate_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions of both versions in the form of the second: save_receipts is empty where there was none; migrated tells the first."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({"migrated": F.col("version") == 1, "save_receipts": F.coalesce("save_receipts", F.array().cast(new.schema["save_receipts"].dataType)), "version": F.lit(2)})


def quarantine_split(df: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """(documents that parse, with ``parsed``; those that don't)."""
    parsed = df.withColumn("parsed", F.try_parse_json(document))
    return parsed.where("parsed is not null"), parsed.where("parsed is null").drop("parsed")


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and its file system, for any store that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_run(df: DataFrame, path: str, run_id: str) -> str:
    """Write a run once, all or nothing, and return where it is.

    It is written to a hidden folder beside the runs, which readers of ``path`` pass over, and takes its name by one rename when it is whole. A
    run that exists is never overwritten, also if it came into being meanwhile; one that fails leaves nothing, so its id can be used again.
    """
    spark = df.sparkSession
    target, files = _files(spark, f"{path}/run_id={run_id}")
    if files.exists(target):
        raise FileExistsError(f"run {run_id} exists")
    staging, _ = _files(spark, f"{path}/.staging-{run_id}-{uuid.uuid4().hex}")
    try:
        df.write.parquet(str(staging))
        if files.exists(target) or not files.rename(staging, target):
            raise FileExistsError(f"run {run_id} exists")
    finally:
        files.delete(staging, True)
    # a store that moves a folder into one that appeared in between would show it there
    inner = spark._jvm.org.apache.hadoop.fs.Path(target, staging.getName())
    if files.exists(inner):
        files.delete(inner, True)
        raise FileExistsError(f"run {run_id} exists")
    return str(target)


def discard_staging(spark: SparkSession, path: str, run_id: str = "*") -> int:
    """Delete what drivers that died left of a run that they never finished; how many folders that was."""
    pattern, files = _files(spark, f"{path}/.staging-{run_id}-*")
    left = files.globStatus(pattern) or []
    for folder in left:
        files.delete(folder.getPath(), True)
    return len(left)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All finished runs below ``path``, with run_id."""
    return spark.read.parquet(path)


def artifact_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))
