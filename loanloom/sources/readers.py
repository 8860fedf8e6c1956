"""Readers for the pipe-delimited loan files, prepared cohorts and ZIP tables.

All paths of a table are read in one scan; there is no loop over files.  The
performance readers add ``row_seq``, which keeps the order of rows in their
files: give it to the panel operators to break ties as the files do.
"""

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from loanloom import schema

QUARTER_PATTERN = r"(\d{4}Q[1-4])"
#: Bytes that a file can have for its rows to keep their order among the quarters: 16 TB.
FILE_BITS = 44


def read_pipe(
    spark: SparkSession, paths, struct: T.StructType | None, columns=None, header: bool = False
) -> DataFrame:
    """Pipe-delimited text; ``columns`` limits parsing to those columns."""
    reader = spark.read.option("sep", "|").option("header", header)
    df = (reader.schema(struct) if struct is not None else reader.option("inferSchema", True)).csv(paths)
    return df.select(*columns) if columns else df


def read_acquisitions(spark: SparkSession, paths, columns=None) -> DataFrame:
    return read_pipe(spark, paths, schema.ACQUISITION, columns)


def file_order() -> Column:
    """A number that grows with the quarter in the file's name and the row's place in the file.

    For columns of a scan.  A file is read in splits; a split that is not its
    file's last fills a partition alone, so rows counted from the split's first
    byte stay below the next split's first byte, as every row has a byte.  The
    last split may share its partition, which only raises its numbers.
    """
    quarter = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})Q([1-4])", 1)
    of_year = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})Q([1-4])", 2)
    number = F.coalesce(F.try_to_number(quarter, F.lit("9999")) * 4 + F.try_to_number(of_year, F.lit("9")), F.lit(0))
    in_partition = F.monotonically_increasing_id() % F.lit(1 << 33)
    return (number.cast("long") * (1 << FILE_BITS) + F.col("_metadata.file_block_start") + in_partition).alias("row_seq")


def read_performance(spark: SparkSession, paths, columns=None) -> DataFrame:
    df = read_pipe(spark, paths, schema.PERFORMANCE)
    return df.select(*(columns or df.columns), file_order())


def read_combined(spark: SparkSession, paths, columns=None) -> DataFrame:
    return read_pipe(spark, paths, schema.COMBINED, columns)


def read_cohort(spark: SparkSession, paths, struct: T.StructType | None = None) -> DataFrame:
    """A prepared cohort with a header line.

    Give its schema when it is known: inferring one reads the files twice.
    """
    return read_pipe(spark, paths, struct, header=True)


def read_quarters(
    spark: SparkSession,
    folder: str,
    acquisitions: str = "*Acquisition*.txt",
    performance: str = "*Performance*.txt",
) -> tuple[DataFrame, DataFrame]:
    """All quarterly file pairs of a folder, tagged with the quarter in their name.

    Use ``keys=("quarter", "loan_id")`` downstream to keep every pair on its own.
    """
    quarter = F.regexp_extract(F.col("_metadata.file_name"), QUARTER_PATTERN, 1)

    def tagged(pattern: str, struct: T.StructType, *more: Column) -> DataFrame:
        df = read_pipe(spark, f"{folder.rstrip('/')}/{pattern}", struct)
        return df.select("*", *more, quarter.alias("quarter"))

    return tagged(acquisitions, schema.ACQUISITION), tagged(performance, schema.PERFORMANCE, file_order())


def read_zip_dimension(spark: SparkSession, paths) -> DataFrame:
    """User-supplied ZIP table: code, latitude, longitude, with a header line."""
    return spark.read.schema(schema.ZIP_DIMENSION).option("header", True).csv(paths)
