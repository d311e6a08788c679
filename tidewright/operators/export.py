"""Exports: one pass over the rows, partitioned layouts, capped files, manifest and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.columns import safe_key

# Fixed value: most rows one exported file may hold.
MAX_ROWS = 1_000_000
# With a smaller cap than this, tasks are dealt by files: 64 MB of rows would be thousands of files in one task.
SMALL_CAP = 100_000
FILES_PER_TASK = 64


def export_partitioned(
    df: DataFrame, path: str, by: Sequence[str] = (), order: Sequence[str] = (), max_rows: int = MAX_ROWS, form: str = "parquet"
) -> None:
    """Write rows under ``path`` in one folder per value of ``by``, sorted inside each file.

    Folder values go through :func:`safe_key`. Rows are rebalanced, so a value that holds a third of the rows
    is spread over many files and rare values share tasks; no file exceeds ``max_rows``. Under a cap below
    ``SMALL_CAP`` rows are counted first, and a value gets one task for every ``FILES_PER_TASK`` files. A target that
    exists fails the job before anything is written.
    """
    folders = [f"by_{c}" for c in by]
    keyed = df.withColumns({f: safe_key(F.col(c).cast("string")) for f, c in zip(folders, by, strict=True)}) if by else df
    if max_rows < SMALL_CAP:
        spread = _dealt(keyed, folders, max_rows * FILES_PER_TASK)
    else:
        spread = keyed.hint("rebalance", *folders) if by else keyed.hint("rebalance")
    sorted_rows = spread.sortWithinPartitions(*folders, *order) if (by or order) else spread
    writer = sorted_rows.write.mode("errorifexists").option("maxRecordsPerFile", max_rows)
    if form == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*folders)
    writer.format(form).save(path)


def _dealt(df: DataFrame, folders: Sequence[str], share: int) -> DataFrame:
    """Rows dealt over tasks of about ``share`` rows; a value of ``folders`` with more is split evenly, smaller ones stay whole."""
    sizes = df.groupBy(*folders).agg(F.count("*").alias("_rows"))
    tasks = max(1, -(-(sizes.agg(F.sum("_rows")).first()[0] or 0) // share))
    if not folders:
        return df.repartition(tasks)
    # the part follows from the row and the partition it comes from, so a repeated task deals alike and equal rows spread
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    parts = sizes.select(*folders, F.ceil(F.col("_rows") / share).alias("_parts"))
    marked = df.withColumn("_mark", F.xxhash64(*plain, F.spark_partition_id())).join(parts, list(folders))
    part = F.pmod(F.col("_mark"), F.col("_parts"))
    return marked.repartition(tasks, *folders, part).select(*df.columns)


def export_event(
    spark: SparkSession, df: DataFrame, root: str, layouts: dict[str, Sequence[str]], order: Sequence[str] = ("reported_at",),
    max_rows: int = MAX_ROWS, form: str = "csv",
) -> DataFrame:
    """All rows once, then every layout from the stored copy; returns the manifest.

    The stored copy replaces a cache: losing executors repeats a read, not the pipeline behind ``df``.
    """
    stored = f"{root}/all_rows"
    export_partitioned(df, stored, (), order, max_rows, "parquet")
    rows = spark.read.parquet(stored)
    for name, by in layouts.items():
        export_partitioned(rows, f"{root}/{name}", by, order, max_rows, form)
    parts = [manifest(spark.read.parquet(stored), "all_rows")]
    for name in layouts:
        layout = spark.read.format(form).schema(rows.schema)
        layout = layout.option("header", True) if form == "csv" else layout
        parts.append(manifest(layout.load(f"{root}/{name}"), name))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def manifest(df: DataFrame, category: str) -> DataFrame:
    """Rows per file of a table read back from disk."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows")).select(
        F.lit(category).alias("category"), "file", "rows"
    )


def refuse_overwrite(spark: SparkSession, path: str) -> None:
    """Stop when the target holds any file."""
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return
        raise
    if listing.select("path").head(1):
        raise FileExistsError(f"target is not empty: {path}")


def write_report_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as CSV with a header and as JSON lines under ``root``."""
    for name, table in tables.items():
        table.write.mode("errorifexists").option("header", True).csv(f"{root}/{name}_csv")
        table.write.mode("errorifexists").json(f"{root}/{name}_json")
