"""Writers for combined tables, snapshots and reports."""

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_combined(df: DataFrame, path: str, mode: str = "error") -> None:
    """Pipe-delimited text without a header; missing values are blank."""
    writer = df.write.mode(mode).option("sep", "|").option("header", False)
    writer.option("nullValue", "").option("emptyValue", "").csv(path)


def write_snapshot(df: DataFrame, path: str, partition_by=("vin_yr",), mode: str = "error") -> None:
    """Parquet snapshot partitioned for later pruning.

    Rows are rebalanced on the partition columns first, so that a task does not
    open a file in every folder; adaptive execution splits large vintages and
    merges small ones.
    """
    columns = list(partition_by)
    if columns:
        df = df.hint("rebalance", *columns)
        df.write.mode(mode).partitionBy(*columns).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_reports(
    reports: Mapping[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """One folder per report name under ``root``; a report is a handful of rows."""
    for name, report in reports.items():
        writer = report.coalesce(1).write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{root.rstrip('/')}/{name}")
