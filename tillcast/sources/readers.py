"""Sources: the transaction log, stored facts, delivered forecast files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tillcast.config import DATE, MERCHANT

# --- fixed values: schema of the transaction log and of a forecast file ---
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("request_date", T.DateType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("response_result", T.StringType()),
    T.StructField("payment_type", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("amount_gbp", T.DecimalType(18, 2)),
    T.StructField("calendar_year", T.IntegerType()),
    T.StructField("calendar_month", T.IntegerType()),
    T.StructField("month_name", T.StringType()),
    T.StructField("calendar_quarter", T.IntegerType()),
    T.StructField("calendar_week_of_year", T.IntegerType()),
    T.StructField("is_uk_bank_holiday", T.BooleanType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("day_of_month", T.IntegerType()),
    T.StructField("day_name", T.StringType()),
    T.StructField("day_type", T.StringType()),
    T.StructField("merchant_name", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("sector_group", T.StringType()),
    T.StructField("iso_id", T.IntegerType()),
    T.StructField("iso_name", T.StringType()),
    T.StructField("merchant_created_datetime", T.TimestampType()),
    T.StructField("acquiring_bank_name", T.StringType()),
    T.StructField("integration_api", T.StringType()),
    T.StructField("has_fraud_notification", T.BooleanType()),
    T.StructField("has_dispute", T.BooleanType()),
])
FORECAST_SCHEMA = T.StructType([
    T.StructField("time_idx", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("q35", T.DoubleType()),
    T.StructField("q50", T.DoubleType()),
    T.StructField("q65", T.DoubleType()),
    T.StructField("expected_gbp", T.DoubleType()),
])
# A file named after its merchant, or the folder that a partitioned write makes for it.
MERCHANT_FILE = r"/forecast_merchant_([^/]+)\.csv$"
MERCHANT_FOLDER = r"/merchant_id=([^/]+)/[^/]*$"
# --- end of fixed values ---


def read_transactions(spark: SparkSession, name: str, format: str = "parquet",
                      schema: T.StructType | None = TRANSACTION_SCHEMA, **options) -> DataFrame:
    """The payment log from a path, or from a catalog table with ``format='table'``."""
    if format == "table":
        return spark.table(name)
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(name)


def load_fact(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def frame_size(frame: DataFrame) -> DataFrame:
    """Rows and columns of a table as one row."""
    return frame.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(frame.columns)))


def _unescaped(text: Column) -> Column:
    """Percent codes turned back; a plus sign is itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def read_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """All forecast files below a folder, each row with the merchant its path names.

    Reads ``forecast_merchant_<id>.csv`` files and the ``merchant_id=<id>`` folders that
    ``write_forecasts`` makes; other files are passed over.  Ids are text, as they were
    before the writer escaped them for a folder's name.  The date column comes back under
    the fact's name.
    """
    found = (
        spark.read.schema(FORECAST_SCHEMA).option("header", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )
    # The path is an address, itself escaped; a folder's name is escaped once more.
    path = _unescaped(F.col("_path"))
    flat, folder_name = (F.regexp_extract(path, p, 1) for p in (MERCHANT_FILE, MERCHANT_FOLDER))
    merchant = F.when(folder_name != "", _unescaped(folder_name)).otherwise(flat)
    return (found.withColumn(MERCHANT, merchant).where(F.col(MERCHANT) != "")
            .select(MERCHANT, "time_idx", F.col("date").alias(DATE), "q35", "q50", "q65",
                    "expected_gbp"))
