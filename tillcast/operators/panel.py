"""The dense daily panel: one gap-free series per merchant on a shared day axis."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast.config import (
    CALENDAR_COLUMNS, COUNT_COLUMNS, Config, DATE, MERCHANT, STATIC_ATTRIBUTES, TIME,
)
from tillcast.functions.columns import log_gbp
from tillcast.functions.dates import age_in_days
from tillcast.operators.calendar import Calendar
from tillcast.operators.features import categories_as_text

STAT_COLUMNS = ("series_days", "series_log_std", "series_active_days")


def by_date():
    """The one ordering of all windows over a merchant, so that they share one sort."""
    return W.partitionBy(MERCHANT).orderBy(DATE)


def whole_series():
    return by_date().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def observed_series(fact: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Observed days with filled attributes, trimmed to start at the first sale.

    Adds ``_next`` (the next observed date) and the merchant's first and last date.  All
    windows share one exchange on the merchant and one sort on the date, and a merchant
    has at most one row per calendar day, however many payments it holds.
    """
    so_far = by_date().rowsBetween(W.unboundedPreceding, W.currentRow)
    # The latest known value, else the first one to come.
    filled = {c: F.coalesce(F.last(c, True).over(so_far), F.first(c, True).over(whole_series()))
              for c in STATIC_ATTRIBUTES if c in fact.columns}
    series = fact.withColumns({
        "_next": F.lead(DATE).over(by_date()),
        "_first_sale": F.min(F.when(F.col(cfg.raw_target) > 0, F.col(DATE))).over(whole_series()),
        "series_last_date": F.max(DATE).over(whole_series()),
        "_first_seen": F.min(DATE).over(whole_series()),
        **filled,
    })
    start = F.col("_first_sale") if cfg.trim_leading_zeros else F.col("_first_seen")
    return (series.withColumn("series_first_date", start).drop("_first_sale", "_first_seen")
            .where(F.col(DATE) >= F.col("series_first_date")))


def with_tenure(observed: DataFrame) -> DataFrame:
    """Log of the merchant's smallest age in its series.

    Age only grows across a gap, so the observed days hold the minimum.
    """
    if "merchant_created_datetime" not in observed.columns:
        return observed.withColumn("log_tenure_at_series_start", F.lit(0.0))
    age = age_in_days(F.col(DATE), F.col("merchant_created_datetime"))
    return observed.withColumn(
        "log_tenure_at_series_start", F.log1p(F.min(age).over(whole_series())))


def with_series_stats(observed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Length, spread of the log target and active days of each dense series.

    Days without a row are zeros, so all three follow from the observed days: the
    spread is taken around the mean over all days, with the absent days' share added.
    Series are thereby judged before they are made dense.
    """
    level = log_gbp(F.col(cfg.raw_target))
    days = (F.datediff("series_last_date", "series_first_date") + 1).cast("long")
    n_observed = F.count(F.lit(1)).over(whole_series())
    mean = F.col("_mean")
    squares = F.sum(F.pow(F.col("_level") - mean, 2)).over(whole_series())
    absent = (F.col("series_days") - F.col("_observed")) * mean * mean
    return (
        observed.withColumns({"series_days": days, "_level": level, "_observed": n_observed})
        .withColumn("_mean", F.sum("_level").over(whole_series()) / F.col("series_days"))
        .withColumns({
            "series_log_std": F.when(
                F.col("series_days") > 1,
                F.sqrt((squares + absent) / (F.col("series_days") - 1))),
            "series_active_days": F.sum(
                F.when(F.col(cfg.raw_target) > 0, 1).otherwise(0)).over(whole_series()),
        })
        .drop("_level", "_observed", "_mean")
    )


def passes_filter(days: str, log_std: str, active: str, cfg: Config) -> Column:
    return ((F.col(days) >= cfg.min_series_days)
            & (F.coalesce(F.col(log_std), F.lit(0.0)) >= cfg.min_log_std)
            & (F.col(active) >= cfg.min_active_days))


def where_usable(observed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Drop whole series too short, too constant or too idle to forecast, by their statistics."""
    return observed.where(passes_filter(*STAT_COLUMNS, cfg))


def axis_start(observed: DataFrame) -> Column:
    """The date of index 0: the earliest first sale of all series, kept or not."""
    return observed.agg(F.min("series_first_date")).scalar()


def axis_end(observed: DataFrame, cfg: Config = Config(), filtered: bool = True) -> Column:
    """The largest time index of the kept series, from the sparse form in one pass."""
    last = F.col("series_last_date")
    if filtered:
        last = F.when(passes_filter(*STAT_COLUMNS, cfg), last)
    return observed.agg(
        F.datediff(F.max(last), F.min("series_first_date")).cast("long")).scalar()


def densify(observed: DataFrame, last_days: int | None = None) -> DataFrame:
    """Every day from each merchant's first to last row; absent days hold zeros.

    With ``last_days`` only so many days at the end of each series are made.

    Each observed row expands to itself and the gap behind it, so no calendar-by-merchant
    join takes place.  Counts, target and flags become 0 on absent days, attributes carry
    over, and columns of neither kind are NULL there.
    """
    carried = {MERCHANT, "_next", "series_first_date", "series_last_date",
               "log_tenure_at_series_start", *STATIC_ATTRIBUTES, *STAT_COLUMNS}
    zeroed = {*COUNT_COLUMNS, "target_imputed"}
    begin, through = F.col(DATE), F.coalesce(F.date_sub("_next", 1), F.col(DATE))
    if last_days is not None:
        begin = F.greatest(begin, F.date_sub("series_last_date", last_days - 1))
        observed = observed.where(through >= begin)
    dense = observed.withColumn("_day", F.explode(F.sequence(begin, through)))
    is_row = F.col("_day") == F.col(DATE)
    columns = [F.col("_day").alias(DATE)]
    for name in observed.columns:
        if name in (DATE, "_next"):
            continue
        if name in carried:
            columns.append(F.col(name))
        elif name in zeroed:
            columns.append(F.when(is_row, F.coalesce(F.col(name), F.lit(0.0)))
                           .otherwise(0.0).alias(name))
        else:
            columns.append(F.when(is_row, F.col(name)).alias(name))
    return dense.select(*columns)


def daily_grid(fact: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The dense grid of a coerced fact, before features and before the series filter."""
    grid = densify(observed_series(fact, cfg))
    return grid.drop("series_first_date", "series_last_date",
                     *[c for c in CALENDAR_COLUMNS if c in grid.columns])


def with_time_index(grid: DataFrame, first_day: Column) -> DataFrame:
    """Days since the earliest date of all trimmed series, and where each series starts and ends."""
    return grid.withColumns({
        TIME: F.datediff(F.col(DATE), first_day).cast("long"),
        "series_start_idx": F.datediff(F.col("series_first_date"), first_day).cast("long"),
        "series_last_idx": F.datediff(F.col("series_last_date"), first_day).cast("long"),
    })


def series_stats(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per merchant: days, sample spread of the log target, days with revenue."""
    return panel.groupBy(MERCHANT).agg(
        F.count(F.lit(1)).alias("days"),
        F.stddev_samp(cfg.target).alias("log_std"),
        F.count_if(F.col(cfg.raw_target) > 0).alias("active_days"),
    )


def filter_series(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Keep the merchants of a dense panel that pass all three thresholds."""
    keep = series_stats(panel, cfg).where(passes_filter("days", "log_std", "active_days", cfg))
    return panel.join(keep.select(MERCHANT), MERCHANT, "left_semi")


def filter_report(stats: DataFrame, cfg: Config = Config()) -> DataFrame:
    """How many series pass, and how many fail each threshold (one may fail several)."""
    return stats.agg(
        F.count(F.lit(1)).alias("merchants"),
        F.count_if(passes_filter("days", "log_std", "active_days", cfg)).alias("kept"),
        F.count_if(F.col("days") < cfg.min_series_days).alias("too_short"),
        F.count_if(F.coalesce("log_std", F.lit(0.0)) < cfg.min_log_std).alias("near_constant"),
        F.count_if(F.col("active_days") < cfg.min_active_days).alias("barely_active"),
    )


class Split:
    """Shared cut points on the day axis, as scalar subqueries.

    The last index is sought in the panel unless it is given (see ``axis_end``).
    """

    def __init__(self, panel: DataFrame, cfg: Config = Config(), full: bool = False,
                 max_t: Column | None = None) -> None:
        self.max_t = panel.agg(F.max(TIME)).scalar() if max_t is None else max_t
        self.val_cutoff = self.max_t - cfg.horizon
        self.sel_cutoff = self.val_cutoff - cfg.val_days
        self.train_cutoff = self.max_t if full else self.sel_cutoff


def split_bounds(panel: DataFrame, cfg: Config = Config(), full: bool = False) -> DataFrame:
    """The cut points and the training population as one row."""
    ends = panel.agg(F.max(TIME).alias("max_time_idx"))
    cut = ends.select(
        "max_time_idx",
        (F.col("max_time_idx") - cfg.horizon).alias("val_cutoff"),
        (F.col("max_time_idx") - cfg.horizon - cfg.val_days).alias("sel_cutoff"),
    )
    cut = cut.withColumn("train_cutoff", F.col("max_time_idx") if full else F.col("sel_cutoff"))
    split = Split(panel, cfg, full)
    population = panel.where(F.col(TIME) <= split.train_cutoff)
    return cut.withColumns({
        "train_rows": population.agg(F.count(F.lit(1))).scalar(),
        "train_merchants": population.agg(F.count_distinct(MERCHANT)).scalar(),
    })


def window_origins(panel: DataFrame, part: str, cfg: Config = Config(),
                   full: bool = False, max_t: Column | None = None,
                   keep: Iterable[str] = ()) -> DataFrame:
    """Forecast origins of one part: ``train``, ``validation`` or ``holdout``.

    An origin is the first decoder day.  It needs the shortest encoder before it and a
    whole horizon that ends inside both the part and the series.  On a dense panel each
    row is a candidate, so this is a filter: no window is ever materialised here.
    ``keep`` names columns of the origin's row to carry along.
    Validation origins are thinned to every n-th of a series by arithmetic on the index.
    """
    split = Split(panel, cfg, full, max_t)
    origin, start = F.col(TIME), F.col("series_start_idx")
    limit, inside = {
        "train": (split.train_cutoff, F.lit(True)),
        "validation": (split.val_cutoff, origin > split.sel_cutoff),
        "holdout": (split.max_t, origin > split.val_cutoff),
    }[part]
    earliest = start + cfg.min_encoder_length
    usable = ((origin >= earliest) & inside
              & (origin + cfg.horizon - 1 <= F.least(limit, F.col("series_last_idx"))))
    if part == "validation" and cfg.val_stride > 1:
        first = F.greatest(split.sel_cutoff + 1, earliest)
        usable = usable & ((origin - first) % cfg.val_stride == 0)
    encoder_start = F.greatest(start, origin - cfg.max_encoder_length)
    return panel.where(usable).select(
        MERCHANT, origin.alias("origin_time_idx"), encoder_start.alias("encoder_start_idx"),
        (origin - encoder_start).alias("encoder_length"), *keep)


def latest_origins(series: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One origin per merchant: the day after its own last day, if it has history enough."""
    ends = series.groupBy(MERCHANT).agg(
        (F.max(TIME) + 1).alias("origin_time_idx"), F.min(TIME).alias("_start"))
    start = F.greatest("_start", F.col("origin_time_idx") - cfg.max_encoder_length)
    return ends.select(
        MERCHANT, "origin_time_idx", start.alias("encoder_start_idx"),
        (F.col("origin_time_idx") - start).alias("encoder_length"),
    ).where(F.col("encoder_length") >= cfg.min_encoder_length)


def encoder_rows(panel: DataFrame, origins: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The encoder days of each origin: an equi-join on merchant and day, at most
    ``max_encoder_length`` rows per origin."""
    days = F.sequence(F.col("encoder_start_idx"), F.col("origin_time_idx") - 1)
    wanted = origins.select(MERCHANT, "origin_time_idx", F.explode(days).alias(TIME))
    return wanted.join(panel.select(MERCHANT, TIME, *columns), [MERCHANT, TIME])


def decoder_rows(origins: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The decoder days of each origin, numbered by step from 1."""
    step = F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon))).alias("step")
    return origins.select(MERCHANT, "origin_time_idx", step).withColumn(
        TIME, F.col("origin_time_idx") + F.col("step") - 1)


def day_blocks(panel: DataFrame, columns: Iterable[str], days: int) -> DataFrame:
    """The panel in blocks of so many days, one row (merchant, block, before, own, after) each:
    the rows of the block and of both its neighbours, as arrays in the order of days.

    One exchange on the merchant serves the blocks and their neighbours.
    """
    block = F.floor(F.col(TIME) / days).cast("int")
    packed = (
        panel.select(MERCHANT, TIME, *columns).repartition(MERCHANT)
        .groupBy(MERCHANT, block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(TIME, *columns))).alias("own")))
    order = W.partitionBy(MERCHANT).orderBy("block")

    def beside(way: int) -> Column:
        near = F.lag("block", -way).over(order) == F.col("block") + way
        return F.coalesce(F.when(near, F.lag("own", -way).over(order)), F.slice("own", 1, 0))

    return packed.select(MERCHANT, "block", beside(-1).alias("before"), "own",
                         beside(1).alias("after"))


def window_arrays(panel: DataFrame, origins: DataFrame, observed: Iterable[str],
                  known: Iterable[str], normaliser: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Model input per origin: encoder array, decoder array of known columns, scale pair.

    A block of days is at least as long as an encoder or a horizon, so each origin meets one
    row, its own block with the neighbours, and both arrays are cut from that.  Call it on
    thinned origins; each array is bounded by the encoder length or the horizon.
    """
    observed, known = list(observed), list(known)
    days = max(cfg.max_encoder_length, cfg.horizon)
    origin = F.col("origin_time_idx")
    wanted = origins.select(MERCHANT, "origin_time_idx", "encoder_start_idx",
                            F.floor(origin / days).cast("int").alias("block"))
    met = wanted.join(day_blocks(panel, [*observed, *known], days), [MERCHANT, "block"])
    past = F.filter(F.concat("before", "own"), lambda d: (
        d[TIME] >= F.col("encoder_start_idx")) & (d[TIME] < origin))
    ahead = F.filter(F.concat("own", "after"), lambda d: (
        d[TIME] >= origin) & (d[TIME] < origin + cfg.horizon))
    decoder = F.transform(ahead, lambda d: F.struct(
        d[TIME].alias(TIME), *[d[c].alias(c) for c in known]))
    return (
        met.select(MERCHANT, "origin_time_idx", past.alias("encoder"), decoder.alias("decoder"))
        .where((F.size("encoder") > 0) & (F.size("decoder") > 0))
        .join(normaliser.select(MERCHANT, "center", "scale"), MERCHANT, "left"))


def future_rows(panel: DataFrame, calendar: Calendar, ratio_names: Iterable[str],
                cfg: Config = Config()) -> DataFrame:
    """The horizon of every merchant, from the day after its own last row.

    Static columns are copied from that row, everything only observed is zeroed, and the
    calendar and the merchant's age are worked out anew.
    """
    kept_logs = ("log_merchant_age", "log_tenure_at_series_start")
    zeroed = {
        cfg.raw_target, cfg.target, "daily_transaction_amount",
        "daily_successful_transaction_count", "daily_unsuccessful_amount_gbp",
        "daily_fraud_amount", "daily_dispute_amount", *ratio_names,
        *[c for c in panel.columns if c not in kept_logs and c.startswith(
            ("log_", "is_zero_day", "had_no_attempts", "target_imputed"))],
    }
    last = panel.where(F.col(TIME) == F.col("series_last_idx"))
    step = F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon)))
    future = last.withColumn("_step", step)
    future = future.withColumns({
        TIME: F.col(TIME) + F.col("_step"),
        DATE: F.date_add(DATE, F.col("_step")),
        **{c: F.lit(0.0) for c in panel.columns if c in zeroed},
    }).drop("_step")
    future = calendar.attach(future)
    if "merchant_created_datetime" in panel.columns:
        age = age_in_days(F.col(DATE), F.col("merchant_created_datetime"))
        future = future.withColumns(
            {"since_merchant_creation": age, "log_merchant_age": F.log1p(age)})
    return categories_as_text(future).select(*panel.columns)


def with_future(panel: DataFrame, calendar: Calendar, ratio_names: Iterable[str],
                cfg: Config = Config()) -> DataFrame:
    """History followed by the horizon, for all merchants at once."""
    return panel.unionByName(future_rows(panel, calendar, ratio_names, cfg))


def single_future(panel: DataFrame, merchant: str, calendar: Calendar,
                  ratio_names: Iterable[str], cfg: Config = Config()) -> DataFrame:
    """History and horizon of one merchant; an unknown merchant is an error."""
    history = panel.where(F.col(MERCHANT) == merchant)
    if history.isEmpty():
        raise ValueError(f"merchant {merchant!r} is not in the panel")
    return with_future(history, calendar, ratio_names, cfg)
