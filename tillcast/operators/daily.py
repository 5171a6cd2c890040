"""From the transaction log to a clean merchant-day fact."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tillcast.config import (
    ACQUIRER_COUNTS, CALENDAR_COLUMNS, COUNT_COLUMNS, Config, DATE, INTEGRATION_COUNTS, MERCHANT,
    MERCHANT_ATTRIBUTES, PAYMENT_COUNTS, RESPONSE_COUNTS, STATIC_ATTRIBUTES,
)
from tillcast.functions.columns import (
    as_date, as_double, as_identifier, equals_folded, is_true, or_unknown,
)
from tillcast.functions.stats import exact_percentiles


#: Texts the measures ask for, by the column of the log that holds them.
CODED = {
    "acquiring_bank_name": ACQUIRER_COUNTS,
    "response_result": RESPONSE_COUNTS,
    "payment_type": PAYMENT_COUNTS,
    "integration_api": INTEGRATION_COUNTS,
    "transaction_type": {"_refund": "REFUND", "_void": "VOID"},
}


def _code(column: str) -> Column:
    """The number of a text among those asked for, 0 for any other; NULL stays NULL."""
    code = F.when(F.col(column).isNull(), F.lit(None))
    for number, text in enumerate(CODED[column].values(), 1):
        code = code.when(equals_folded(column, text), number)
    return code.otherwise(0).cast("tinyint").alias(f"_{column}")


def _is(column: str, text: str) -> Column:
    return F.col(f"_{column}") == F.lit(list(CODED[column].values()).index(text) + 1)


def _money(condition: Column) -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    return F.sum(F.when(condition, F.col("amount_gbp")).otherwise(zero))


def _money_measures(strict_reference: bool) -> dict[str, Column]:
    success = _is("response_result", "SUCCESS")
    payout = _is("payment_type", "PAYOUTS")
    refund = _is("transaction_type", "REFUND")
    void = _is("transaction_type", "VOID")
    returned = F.lit(False) if strict_reference else success & ~payout
    return {
        "daily_successful_amount_gbp": _money(success & ~payout & ~refund & ~void),
        "daily_payout_amount_gbp": _money(success & payout),
        "daily_refund_amount_gbp": _money(returned & refund),
        "daily_void_amount_gbp": _money(returned & void),
        "daily_unsuccessful_amount_gbp": _money(~success),
    }


def _one_row_per_day(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Each merchant-day's measures, taken over all its rows and kept on one of them.

    A window holds a merchant-day's rows on disk where they are many.
    """
    arrival = W.partitionBy(DATE, MERCHANT).orderBy(DATE)
    day = arrival.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.select(
        DATE, MERCHANT, *[m.over(day).alias(name) for name, m in measures.items()],
        F.row_number().over(arrival).alias("_row")).where("_row = 1").drop("_row")


def daily_fact(transactions: DataFrame, attributes: Iterable[str] | None = None,
               strict_reference: bool = False, grouping: str = "hashed") -> DataFrame:
    """One row per date and merchant with all measures and the wanted attributes.

    The texts that measures ask for become numbers first, so that each is folded and compared
    once per row.  The rows are then brought together in one of three ways, with equal results:

    * ``hashed`` groups the log with the text attributes in the key, which keeps the pass over
      it a hash aggregation.  Partial sums form before the exchange, so a merchant holding much
      of the log sends a few rows per day and input task; a second grouping sees merchant-days
      only.  Where the texts vary within a merchant-day it has a row for each of their
      combinations, and may be no smaller than the log.
    * ``sorted`` has each task sort its rows by merchant-day for the maxima over text.  Whatever
      the texts, a merchant-day leaves a task as one row: for logs with many rows of a
      merchant-day.  The one exchange moves merchant-days.
    * ``gathered`` exchanges the log's rows, which are narrower than those of the fact, and
      groups them where they arrive: for logs with few rows of a merchant-day, where partial
      sums would make the data larger.  With texts it does so by windows, which sum in one step
      what an aggregate would sum and then merge.

    Refund and void money follow the stated intent (successful, not a payout);
    ``strict_reference`` gives the zeros that the published condition literally yields.
    """
    if grouping not in ("hashed", "sorted", "gathered"):
        raise ValueError(f"unknown grouping {grouping!r}")
    wanted = CALENDAR_COLUMNS + MERCHANT_ATTRIBUTES if attributes is None else tuple(attributes)
    present = [c for c in wanted if c in transactions.columns]
    money = _money_measures(strict_reference)
    counts = {
        name: F.count_if(_is(source, text))
        for source in ("acquiring_bank_name", "response_result", "payment_type", "integration_api")
        for name, text in CODED[source].items()
    }
    measures = {
        "daily_transaction_amount": F.count(F.lit(1)),
        **money,
        **counts,
        "daily_fraud_amount": F.count_if(is_true("has_fraud_notification")),
        "daily_dispute_amount": F.count_if(is_true("has_dispute")),
    }
    rows = transactions.select(
        DATE, MERCHANT, "amount_gbp", "has_fraud_notification", "has_dispute",
        *[_code(c) for c in CODED], *present)
    texts = [c for c in present if isinstance(transactions.schema[c].dataType, T.StringType)]
    if grouping == "hashed":
        by_attribute = rows.groupBy(DATE, MERCHANT, *texts).agg(
            *[m.alias(name) for name, m in measures.items()],
            *[F.max(c).alias(c) for c in present if c not in texts])
        if not texts:
            return by_attribute.select(DATE, MERCHANT, *measures, *present)
        return by_attribute.groupBy(DATE, MERCHANT).agg(
            *[F.sum(c).alias(c) for c in measures], *[F.max(c).alias(c) for c in present])
    if grouping == "gathered":
        rows = rows.repartition(DATE, MERCHANT)
    per_day = {**measures, **{c: F.max(c) for c in present}}
    if grouping == "gathered" and texts:
        facts = _one_row_per_day(rows, per_day)
    else:
        facts = rows.groupBy(DATE, MERCHANT).agg(
            *[m.alias(name) for name, m in per_day.items()])
    if not texts:
        return facts
    return facts.withColumns({c: F.col(c).cast("decimal(38,2)") for c in money})


def without_months(transactions: DataFrame, year: int, months: Sequence[str]) -> DataFrame:
    """Drop the named months of one year (a cutoff for presentations)."""
    return transactions.where(
        ~(F.col("month_name").isin(*months) & (F.col("calendar_year") == year)))


def coerce_fact(fact: DataFrame) -> DataFrame:
    """Plain types throughout: dates, trimmed text ids, doubles, no NULL attribute text.

    Rows without a merchant id cannot belong to a series and are dropped
    (``null_merchant_rows`` in ``operators.quality`` counts them).
    """
    missing = [c for c in (DATE, MERCHANT) if c not in fact.columns]
    if missing:
        raise ValueError(f"the fact lacks key columns {missing}")
    changed = {DATE: as_date(DATE, fact.schema[DATE].dataType), MERCHANT: as_identifier(MERCHANT)}
    for name in COUNT_COLUMNS:
        if name in fact.columns:
            changed[name] = as_double(name)
    for name in STATIC_ATTRIBUTES:
        if name not in fact.columns:
            continue
        if name == "merchant_created_datetime":
            changed[name] = as_date(name, fact.schema[name].dataType)
        else:
            changed[name] = or_unknown(name)
    return fact.where(F.col(MERCHANT).isNotNull()).withColumns(changed)


def positive_medians(fact: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Each merchant's median over rows with revenue, however many copies of a day there are."""
    sold = fact.where(F.col(cfg.raw_target) > 0)
    return exact_percentiles(sold, cfg.raw_target, [0.5], [MERCHANT]).select(
        MERCHANT, F.col("percentiles")[0].alias("_median"))


def impute_revenue(fact: DataFrame, cfg: Config = Config(), medians: DataFrame | None = None
                   ) -> DataFrame:
    """Fill revenue that is NULL although payments succeeded; flag it as ``target_imputed``.

    The fill is the merchant's median over its rows with revenue, or 0 without any.  The
    fact must hold one row per merchant and day: the median is then a window whose state is
    a few thousand values, on the partitioning that the series need anyway.  Medians over
    more rows than that come in ready-made.
    """
    revenue = F.col(cfg.raw_target)
    if "daily_successful_transaction_count" not in fact.columns:
        return fact.withColumn("target_imputed", F.lit(0.0))
    lacking = revenue.isNull() & (F.coalesce("daily_successful_transaction_count", F.lit(0.0)) > 0)
    if medians is None:
        whole = W.partitionBy(MERCHANT).orderBy(DATE).rowsBetween(
            W.unboundedPreceding, W.unboundedFollowing)
        median = F.percentile(F.when(revenue > 0, revenue), F.lit(0.5)).over(whole)
        fact = fact.withColumn("_median", median)
    else:
        fact = fact.join(medians, MERCHANT, "left")
    return (
        fact.withColumn("target_imputed", F.when(lacking, 1.0).otherwise(0.0))
        .withColumn(cfg.raw_target,
                    F.when(lacking, F.coalesce("_median", F.lit(0.0))).otherwise(revenue))
        .drop("_median")
    )


def latest_per_day(frame: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep the last row per merchant and day in the given order of arrival.

    Ties on the order columns are settled by the remaining columns, so the result does
    not depend on file order.  This is an aggregate with partial maxima, not a window:
    many copies of one key shrink before the exchange.  A maximum over rows with texts is a
    sort aggregate, so each task sorts its rows by key before that.
    """
    order = list(order)
    rest = [c for c in frame.columns if c not in (MERCHANT, DATE, *order)]
    newest = frame.groupBy(MERCHANT, DATE).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return newest.select(MERCHANT, DATE, "_row.*").select(*frame.columns)
