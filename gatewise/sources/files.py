"""File scans and sinks for raw, clean and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gatewise.schema import RAW_COLUMNS, RAW_SCHEMA


def _raw_reader(spark: SparkSession, schema: T.StructType, multi_line: bool):
    # Column pruning must be off: with it Spark parses only the wanted columns and
    # a malformed line would then count in a narrow query and not in a wide one.
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("columnPruning", False)
        .option("multiLine", multi_line)
    )


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All-text CSV by position, header skipped, malformed lines dropped.

    ``multi_line`` accepts newlines inside quoted fields but makes a file
    unsplittable, so it is off unless the data needs it.
    """
    return _raw_reader(spark, RAW_SCHEMA, multi_line).option("mode", "DROPMALFORMED").csv(path)


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header names and inferred types (an extra pass; for profiling only)."""
    return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)


def read_logins_file(spark: SparkSession, path: str) -> DataFrame:
    """Parquet when the path ends in ``.parquet``, all-text CSV otherwise."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_raw_csv(spark, path)


def first_rows(raw: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """The first ``n`` rows by numeric row index, for development runs.

    Spark files have no global order; the index column restates the file order.
    The plan is a top-n per partition and a merge, not a sort of the table.
    """
    return raw.orderBy(F.col(order).try_cast("bigint").asc_nulls_last()).limit(n)


def parse_integrity(spark: SparkSession, path: str) -> DataFrame:
    """Row counts of a loose and a strict read of the same CSV, and their difference."""
    loose = _raw_reader(spark, RAW_SCHEMA, False).option("mode", "PERMISSIVE").csv(path)
    strict = read_raw_csv(spark, path).agg(F.count(F.lit(1)).alias("n"))
    return loose.agg(F.count(F.lit(1)).alias("loose_rows")).select(
        "loose_rows", strict.scalar().alias("strict_rows"),
        (F.col("loose_rows") - strict.scalar()).alias("malformed_rows"),
    )


def write_raw_csv(raw: DataFrame, path: str) -> None:
    """Raw rows as CSV that ``read_raw_csv`` reads back unchanged."""
    (
        raw.select(*RAW_COLUMNS)
        .write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_events(events: DataFrame, path: str, partition_by_day: bool = False) -> None:
    """Parquet with ZSTD; ``partition_by_day`` adds a day column for partition pruning."""
    writer = events
    if partition_by_day:
        writer = events.withColumn("day", F.to_date("ts")).repartition("day", F.col("row_id") % 64)
    out = writer.write.option("compression", "zstd")
    (out.partitionBy("day") if partition_by_day else out).parquet(path)


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report table as CSV with header or as JSON lines."""
    if fmt == "json":
        report.write.json(path)
    else:
        report.write.option("header", True).csv(path)
