"""Report dataset: write, read, count, retention."""

from pyspark.sql import functions as F

from sitewise import schemas
from sitewise.operators.reports import expired


def write_reports(reports, path, mode="overwrite"):
    """JSON lines by report date; the commit protocol hides unfinished files.

    One dataset with the report name in each row, not one file per lead. Nulls are
    written. Only the dates that occur are replaced, so a day that is written again
    leaves one copy and other days stay.
    """
    rows = reports.withColumn(
        "report_date", F.to_date(F.substring(F.col("_metadata")["saved_at"], 1, 10))
    )
    (
        rows.write.mode(mode)
        .option("ignoreNullFields", False)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("report_date")
        .json(path)
    )


def read_reports(spark, path, multiline=False, pattern=None):
    """Report rows; broken text gives a row with only ``_corrupt`` filled."""
    reader = (
        spark.read.schema(f"{schemas.REPORT}, _corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("multiLine", multiline)
    )
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def report_files(spark, path, pattern="analysis_*.json"):
    """(file, modified) of single-report files under a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"))
    )


def count_reports(spark, path, pattern="analysis_*.json"):
    return report_files(spark, path, pattern).agg(F.count("*").alias("reports"))


def expired_files(spark, path, now, retention_days, pattern="analysis_*.json"):
    """Report files past retention; nothing is deleted here."""
    return expired(report_files(spark, path, pattern), now, retention_days)
