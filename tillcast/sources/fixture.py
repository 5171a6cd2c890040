"""The test tables seen as a transaction log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillcast.config import DATE
from tillcast.operators.calendar import bank_holidays, calendar_from_dates, days_between

MERCHANT_KEYS = {"supplier": "l_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}
# The test tables run from 1995 to 2001.  Fixed years give the calendar a known size.
CALENDAR_YEARS = (dt.date(1992, 1, 1), dt.date(2010, 12, 31))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Share out a scan that yields fewer partitions than there are task slots.

    A small file in one row group is read by a single task, and all work up to the next
    exchange would stay in it.  A log of many files passes through unchanged.
    """
    slots = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(slots) if frame.rdd.getNumPartitions() < slots else frame


def _choose(number: Column, names: list[str], otherwise: str) -> Column:
    chosen = F.lit(otherwise)
    for i, name in reversed(list(enumerate(names))):
        chosen = F.when(number == i, name).otherwise(chosen)
    return chosen


def transactions(spark: SparkSession, folder: str, merchant: str = "supplier") -> DataFrame:
    """Line items as payment attempts of a supplier, nation or region."""
    items = spread(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    suppliers = table(spark, folder, "supplier")
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    joined = (items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(regions, F.col("n_regionkey") == F.col("r_regionkey")))
    tax = F.round(F.col("l_tax") * 100).cast("int")
    line = F.col("l_linenumber")
    quantity = F.col("l_quantity")
    balance = F.col("s_acctbal")
    return joined.select(
        F.col("l_shipdate").cast("date").alias(DATE),
        F.col(MERCHANT_KEYS[merchant]).cast("string").alias("merchant_id"),
        F.when(tax <= 5, F.when(F.col("l_linestatus") == "F", "SUCCESS").otherwise("Success"))
        .when(tax == 6, "DECLINED").when(tax == 7, "Expired")
        .otherwise(_choose(line - 1, ["CANCELLED", "PENDING", "ERROR", "QUARANTINED", "UNKNOWN"],
                           "BLOCKED")).alias("response_result"),
        _choose(quantity.cast("int") % 6,
                ["CARD", "DIRECT_DEBIT", "PAY_BY_BANK", "PAYOUTS", "BACS_RECEIVE"],
                "VARIABLE_RECURRING_PAYMENT").alias("payment_type"),
        F.when((F.col("l_returnflag") == "R") & (quantity > 40), "REFUND")
        .when((F.col("l_returnflag") == "A") & (quantity > 45), "VOID")
        .otherwise("SALE").alias("transaction_type"),
        F.when(F.col("l_discount") != 0,
               F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount_gbp"),
        _choose(line - 1, ["MIGRATION", "Acquired.com", "TRUST PAYMENTS", "UNKNOWN", "CASHFLOWS",
                           "BARCLAYCARD"], "LLOYDS CARDNET").alias("acquiring_bank_name"),
        F.when(line % 2 == 0, "CORE").otherwise("REST").alias("integration_api"),
        F.when(line != 7, quantity == 50).alias("has_fraud_notification"),
        F.when(line != 7, quantity == 1).alias("has_dispute"),
        F.col("s_name").alias("merchant_name"),
        F.when(balance < 2500, "SMALL").when(balance < 6000, "MEDIUM")
        .otherwise("LARGE").alias("merchant_category"),
        F.col("r_name").alias("sector_group"),
        F.col("n_nationkey").alias("iso_id"),
        F.when(F.col("n_nationkey") != 0, F.col("n_name")).alias("iso_name"),
        F.when(F.col("s_suppkey") % 10 != 9,
               F.date_add(F.lit(dt.date(1990, 1, 1)), F.col("s_suppkey").cast("int"))
               ).alias("merchant_created_datetime"),
        F.col("l_orderkey").alias("ingest_key"),
        F.col("l_linenumber").alias("ingest_line"),
    )


def with_warehouse_calendar(log: DataFrame) -> DataFrame:
    """Add the ten calendar columns that a warehouse log carries on each row.

    They come from a table of the fixed years' days, some 7,000 rows.
    """
    spark = log.sparkSession
    days = days_between(spark, *CALENDAR_YEARS)
    table = calendar_from_dates(days, bank_holidays(spark, *CALENDAR_YEARS))
    return log.join(F.broadcast(table), DATE, "left")


def event_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a small merchant-day fact: users are merchants, errors are failures."""
    events = table(spark, folder, "events")
    value = F.col("value").cast("decimal(18,2)")
    success = F.col("event_type") != "error"
    zero = F.lit(0).cast("decimal(18,2)")
    return events.groupBy(
        F.col("ts").cast("date").alias(DATE), F.col("user_id").cast("string").alias("merchant_id"),
    ).agg(
        F.count(F.lit(1)).alias("daily_transaction_amount"),
        F.count_if(success).alias("daily_successful_transaction_count"),
        F.sum(F.when(success, value).otherwise(zero)).alias("daily_successful_amount_gbp"))
