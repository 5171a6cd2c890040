"""The same results as plain SQL, built from common table expressions.

These follow the definitions directly (calendar joined to merchants, running flags,
grouped statistics) and share no logic with the Spark side but fixed names.
"""

from __future__ import annotations

from tillcast.config import (
    ACQUIRER_COUNTS, INTEGRATION_COUNTS, MIX_GROUPS, PAYMENT_COUNTS, RESPONSE_COUNTS,
)

KEYS = {"supplier": "l.l_suppkey", "nation": "n.n_nationkey", "region": "r.r_regionkey"}
LEVELS = (0.02, 0.1, 0.25, 0.35, 0.5, 0.65, 0.75, 0.9, 0.98)
Q = ("q02", "q10", "q25", "q35", "q50", "q65", "q75", "q90", "q98")
WEIGHTS = (0.06, 0.115, 0.125, 0.125, 0.15, 0.125, 0.125, 0.115, 0.06)
CALENDAR = ("day_of_week", "day_of_month", "calendar_month", "month_name", "calendar_year",
            "calendar_quarter", "calendar_week_of_year", "day_name", "day_type",
            "is_uk_bank_holiday")
COUNTS = {**{k: ("acquiring_bank_name", v) for k, v in ACQUIRER_COUNTS.items()},
          **{k: ("response_result", v) for k, v in RESPONSE_COUNTS.items()},
          **{k: ("payment_type", v) for k, v in PAYMENT_COUNTS.items()},
          **{k: ("integration_api", v) for k, v in INTEGRATION_COUNTS.items()}}

# --- fixed values: bank holidays of England and Wales, 1995 to 2002 ---
HOLIDAYS = """
1995-01-02 1995-04-14 1995-04-17 1995-05-08 1995-05-29 1995-08-28 1995-12-25 1995-12-26
1996-01-01 1996-04-05 1996-04-08 1996-05-06 1996-05-27 1996-08-26 1996-12-25 1996-12-26
1997-01-01 1997-03-28 1997-03-31 1997-05-05 1997-05-26 1997-08-25 1997-12-25 1997-12-26
1998-01-01 1998-04-10 1998-04-13 1998-05-04 1998-05-25 1998-08-31 1998-12-25 1998-12-28
1999-01-01 1999-04-02 1999-04-05 1999-05-03 1999-05-31 1999-08-30 1999-12-27 1999-12-28 1999-12-31
2000-01-03 2000-04-21 2000-04-24 2000-05-01 2000-05-29 2000-08-28 2000-12-25 2000-12-26
2001-01-01 2001-04-13 2001-04-16 2001-05-07 2001-05-28 2001-08-27 2001-12-25 2001-12-26
2002-01-01 2002-03-29 2002-04-01 2002-05-06 2002-06-03 2002-06-04 2002-08-26 2002-12-25 2002-12-26
""".split()
# --- end of fixed values ---


def r(expression: str, digits: int = 6, name: str | None = None) -> str:
    return f"ROUND({expression}, {digits}) + 0.0 AS {name or expression}"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def txn(merchant: str = "supplier") -> str:
    return f"""txn AS (
  SELECT CAST(l.l_shipdate AS DATE) AS request_date,
    CAST({KEYS[merchant]} AS VARCHAR) AS merchant_id,
    CASE WHEN CAST(ROUND(l.l_tax * 100) AS INT) <= 5
           THEN CASE WHEN l.l_linestatus = 'F' THEN 'SUCCESS' ELSE 'Success' END
         WHEN CAST(ROUND(l.l_tax * 100) AS INT) = 6 THEN 'DECLINED'
         WHEN CAST(ROUND(l.l_tax * 100) AS INT) = 7 THEN 'Expired'
         WHEN l.l_linenumber = 1 THEN 'CANCELLED' WHEN l.l_linenumber = 2 THEN 'PENDING'
         WHEN l.l_linenumber = 3 THEN 'ERROR' WHEN l.l_linenumber = 4 THEN 'QUARANTINED'
         WHEN l.l_linenumber = 5 THEN 'UNKNOWN' ELSE 'BLOCKED' END AS response_result,
    CASE CAST(l.l_quantity AS INT) % 6 WHEN 0 THEN 'CARD' WHEN 1 THEN 'DIRECT_DEBIT'
         WHEN 2 THEN 'PAY_BY_BANK' WHEN 3 THEN 'PAYOUTS' WHEN 4 THEN 'BACS_RECEIVE'
         ELSE 'VARIABLE_RECURRING_PAYMENT' END AS payment_type,
    CASE WHEN l.l_returnflag = 'R' AND l.l_quantity > 40 THEN 'REFUND'
         WHEN l.l_returnflag = 'A' AND l.l_quantity > 45 THEN 'VOID'
         ELSE 'SALE' END AS transaction_type,
    CASE WHEN l.l_discount = 0 THEN NULL
         ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS amount_gbp,
    CASE l.l_linenumber WHEN 1 THEN 'MIGRATION' WHEN 2 THEN 'Acquired.com'
         WHEN 3 THEN 'TRUST PAYMENTS' WHEN 4 THEN 'UNKNOWN' WHEN 5 THEN 'CASHFLOWS'
         WHEN 6 THEN 'BARCLAYCARD' ELSE 'LLOYDS CARDNET' END AS acquiring_bank_name,
    CASE WHEN l.l_linenumber % 2 = 0 THEN 'CORE' ELSE 'REST' END AS integration_api,
    CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_quantity = 50 END AS has_fraud_notification,
    CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_quantity = 1 END AS has_dispute,
    s.s_name AS merchant_name,
    CASE WHEN s.s_acctbal < 2500 THEN 'SMALL' WHEN s.s_acctbal < 6000 THEN 'MEDIUM'
         ELSE 'LARGE' END AS merchant_category,
    r.r_name AS sector_group, n.n_nationkey AS iso_id,
    CASE WHEN n.n_nationkey = 0 THEN NULL ELSE n.n_name END AS iso_name,
    CASE WHEN s.s_suppkey % 10 = 9 THEN NULL
         ELSE DATE '1990-01-01' + CAST(s.s_suppkey AS INT) END AS merchant_created_datetime,
    l.l_orderkey AS ingest_key, l.l_linenumber AS ingest_line
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


HOLIDAY = "holiday AS (SELECT CAST(UNNEST([" + ", ".join(
    f"'{d}'" for d in HOLIDAYS) + "]) AS DATE) AS h)"


def calendar_select(day: str, flag: str) -> str:
    """The ten calendar columns of a date, given its holiday flag."""
    return f"""CAST(isodow({day}) AS INT) AS day_of_week, CAST(day({day}) AS INT) AS day_of_month,
    CAST(month({day}) AS INT) AS calendar_month, monthname({day}) AS month_name,
    CAST(year({day}) AS INT) AS calendar_year, CAST(quarter({day}) AS INT) AS calendar_quarter,
    CAST(strftime({day}, '%U') AS INT) AS calendar_week_of_year, dayname({day}) AS day_name,
    CASE WHEN {flag} THEN 'Holiday' WHEN isodow({day}) >= 6 THEN 'Weekend'
         ELSE 'Working Day' END AS day_type, {flag} AS is_uk_bank_holiday"""


FLAG = "(request_date IN (SELECT h FROM holiday))"


def measures() -> str:
    up = "UPPER({})".format
    success = f"{up('response_result')} = 'SUCCESS'"
    sale = f"{success} AND {up('payment_type')} <> 'PAYOUTS'"
    kind = up("transaction_type")
    counts = ",\n    ".join(f"COUNT(*) FILTER (WHERE {up(c)} = '{v}') AS {k}"
                            for k, (c, v) in COUNTS.items())
    return f"""COUNT(*) AS daily_transaction_amount,
    SUM(CASE WHEN {sale} AND {kind} NOT IN ('REFUND', 'VOID') THEN amount_gbp ELSE 0 END)
      AS daily_successful_amount_gbp,
    SUM(CASE WHEN {success} AND {up('payment_type')} = 'PAYOUTS' THEN amount_gbp ELSE 0 END)
      AS daily_payout_amount_gbp,
    SUM(CASE WHEN {sale} AND {kind} = 'REFUND' THEN amount_gbp ELSE 0 END)
      AS daily_refund_amount_gbp,
    SUM(CASE WHEN {sale} AND {kind} = 'VOID' THEN amount_gbp ELSE 0 END) AS daily_void_amount_gbp,
    SUM(CASE WHEN {up('response_result')} <> 'SUCCESS' THEN amount_gbp ELSE 0 END)
      AS daily_unsuccessful_amount_gbp,
    {counts},
    COUNT(*) FILTER (WHERE has_fraud_notification IS TRUE) AS daily_fraud_amount,
    COUNT(*) FILTER (WHERE has_dispute IS TRUE) AS daily_dispute_amount"""


MONEY = ("daily_successful_amount_gbp", "daily_payout_amount_gbp", "daily_refund_amount_gbp",
         "daily_void_amount_gbp", "daily_unsuccessful_amount_gbp")
ATTRIBUTES = ("merchant_name", "merchant_category", "sector_group", "iso_id", "iso_name",
              "merchant_created_datetime")


def fact() -> str:
    attributes = ", ".join(f"MAX({a}) AS {a}" for a in ATTRIBUTES)
    return f"""fact AS (SELECT request_date, merchant_id, {measures()}, {attributes}
  FROM txn GROUP BY request_date, merchant_id)"""


# Coerced and imputed: text attributes without NULLs, revenue filled by the merchant's median.
CLEAN = """med AS (
  SELECT merchant_id, MEDIAN(CAST(daily_successful_amount_gbp AS DOUBLE)) AS m FROM fact
  WHERE daily_successful_amount_gbp > 0 GROUP BY merchant_id),
clean AS (
  SELECT fact.* REPLACE (
      CASE WHEN daily_successful_amount_gbp IS NULL AND daily_successful_transaction_count > 0
           THEN COALESCE(m, 0) ELSE CAST(daily_successful_amount_gbp AS DOUBLE) END
        AS daily_successful_amount_gbp,
      CAST(daily_unsuccessful_amount_gbp AS DOUBLE) AS daily_unsuccessful_amount_gbp,
      COALESCE(merchant_name, 'unknown') AS merchant_name,
      COALESCE(merchant_category, 'unknown') AS merchant_category,
      COALESCE(sector_group, 'unknown') AS sector_group,
      COALESCE(iso_name, 'unknown') AS iso_name),
    CASE WHEN daily_successful_amount_gbp IS NULL AND daily_successful_transaction_count > 0
         THEN 1.0 ELSE 0.0 END AS target_imputed
  FROM fact LEFT JOIN med USING (merchant_id))"""

ZEROED = ("daily_transaction_amount", "daily_successful_amount_gbp",
          "daily_unsuccessful_amount_gbp", "daily_fraud_amount", "daily_dispute_amount",
          *COUNTS, "target_imputed")
CARRIED = ("merchant_name", "merchant_category", "sector_group", "iso_name",
           "merchant_created_datetime")


def grid(trim: bool = True) -> str:
    zeroed = ",\n    ".join(f"CAST(COALESCE(c.{x}, 0) AS DOUBLE) AS {x}" for x in ZEROED)
    carried = ",\n    ".join(
        f"COALESCE(LAST_VALUE(c.{x} IGNORE NULLS) OVER past, "
        f"FIRST_VALUE(c.{x} IGNORE NULLS) OVER ahead) AS {x}" for x in CARRIED)
    kept = "WHERE traded" if trim else ""
    return f"""span AS (SELECT merchant_id, MIN(request_date) AS lo, MAX(request_date) AS hi
  FROM clean GROUP BY merchant_id),
days AS (SELECT merchant_id,
    CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY))
      AS DATE) AS request_date FROM span),
filled AS (
  SELECT d.merchant_id, d.request_date, {zeroed},
    CAST(c.daily_payout_amount_gbp AS DOUBLE) AS daily_payout_amount_gbp,
    {carried}
  FROM days d LEFT JOIN clean c ON c.merchant_id = d.merchant_id
    AND c.request_date = d.request_date
  WINDOW past AS (PARTITION BY d.merchant_id ORDER BY d.request_date
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY d.merchant_id ORDER BY d.request_date
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
flagged AS (SELECT *, BOOL_OR(daily_successful_amount_gbp > 0) OVER (
    PARTITION BY merchant_id ORDER BY request_date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS traded FROM filled),
grid AS (SELECT * EXCLUDE (traded) FROM flagged {kept})"""


CORE = """core AS (
  SELECT *, GREATEST(COALESCE(daily_successful_amount_gbp, 0), 0) AS v,
    LN(1 + GREATEST(COALESCE(daily_successful_amount_gbp, 0), 0)) AS tpv,
    CAST(request_date - (SELECT MIN(request_date) FROM grid) AS BIGINT) AS time_idx,
    CAST(MIN(request_date) OVER (PARTITION BY merchant_id)
         - (SELECT MIN(request_date) FROM grid) AS BIGINT) AS series_start_idx,
    CAST(MAX(request_date) OVER (PARTITION BY merchant_id)
         - (SELECT MIN(request_date) FROM grid) AS BIGINT) AS series_last_idx
  FROM grid)"""


def kept(min_active: int = 20, days: int = 30, log_std: float = 0.20) -> str:
    return f"""stats AS (SELECT merchant_id, COUNT(*) AS days, STDDEV_SAMP(tpv) AS log_std,
    COUNT(*) FILTER (WHERE v > 0) AS active_days FROM core GROUP BY merchant_id),
series AS (SELECT * FROM core WHERE merchant_id IN (SELECT merchant_id FROM stats
    WHERE days >= {days} AND COALESCE(log_std, 0) >= {log_std} AND active_days >= {min_active}))"""


def base(merchant: str, min_active: int = 20, trim: bool = True, days: int = 30,
         log_std: float = 0.20) -> list[str]:
    return [txn(merchant), fact(), CLEAN, grid(trim), CORE, kept(min_active, days, log_std)]


def changed_base(merchant: str, revenue: str, where: str = "TRUE") -> list[str]:
    """The same over a fact with other revenue, or fewer rows."""
    first = fact().replace("fact AS (", "fact0 AS (", 1)
    assert first.startswith("fact0")
    changed = f"""fact AS (SELECT * REPLACE ({revenue} AS daily_successful_amount_gbp)
  FROM fact0 WHERE {where})"""
    return [txn(merchant), first, changed, CLEAN, grid(), CORE, kept()]


CUT = """cut AS (SELECT MAX(time_idx) AS max_t, MAX(time_idx) - 91 AS val_cutoff,
    MAX(time_idx) - 271 AS sel_cutoff FROM series)"""

ORIGIN = """SELECT merchant_id, time_idx AS origin_time_idx,
    GREATEST(series_start_idx, time_idx - 120) AS encoder_start_idx,
    time_idx - GREATEST(series_start_idx, time_idx - 120) AS encoder_length
  FROM series, cut WHERE time_idx - series_start_idx >= 28"""
TRAIN = f"{ORIGIN} AND time_idx + 90 <= LEAST(sel_cutoff, series_last_idx)"
VALIDATION = f"""SELECT * EXCLUDE (k) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY origin_time_idx) - 1 AS k FROM (
    {ORIGIN} AND time_idx > sel_cutoff AND time_idx + 90 <= LEAST(val_cutoff, series_last_idx)))
  WHERE k % 7 = 0"""
HOLDOUT = f"""{ORIGIN} AND time_idx > val_cutoff
    AND time_idx + 90 <= LEAST(max_t, series_last_idx)"""

# The whole calendar up to a horizon past the last covered date, with all date features.
CALENDAR_DIM = """covered AS (SELECT MIN(request_date) AS lo, MAX(request_date) AS hi FROM txn),
alldays AS (SELECT CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP),
    CAST(hi AS TIMESTAMP) + INTERVAL {ahead} DAY, INTERVAL 1 DAY)) AS DATE) AS request_date
  FROM covered),
known AS (SELECT h FROM holiday, covered WHERE (h IN (SELECT request_date FROM txn) AND h <= hi)
    OR (h > hi AND h <= hi + {reach})),
near AS (SELECT request_date,
    (SELECT MAX(h) FROM known WHERE h < request_date) AS before,
    (SELECT MIN(h) FROM known WHERE h >= request_date) AS after FROM alldays),
dim AS (SELECT request_date, {columns},
    {waves},
    CASE WHEN day(request_date) <= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_month_start,
    CASE WHEN day(request_date) >= day(last_day(request_date)) - 1 THEN 1.0 ELSE 0.0 END::DOUBLE
      AS is_month_end,
    CASE WHEN day(request_date) >= 25 OR day(request_date) <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE
      AS is_payday_window,
    CASE WHEN month(request_date + 1) <> month(request_date) AND month(request_date) IN (3, 6, 9, 12)
         THEN 1.0 ELSE 0.0 END::DOUBLE AS is_quarter_end,
    CAST(LEAST(day(last_day(request_date)) - day(request_date), 15) AS DOUBLE)
      AS days_to_month_end,
    CAST(GREATEST(-10, LEAST(10, CASE
      WHEN before IS NULL AND after IS NULL THEN 0
      WHEN after IS NULL THEN before - request_date
      WHEN before IS NULL THEN after - request_date
      WHEN request_date - before <= after - request_date THEN before - request_date
      ELSE after - request_date END)) AS DOUBLE) AS holiday_offset
  FROM near)"""


def calendar_dim(ahead: int) -> str:
    waves = [f"{f}(2 * pi() * {k} * dayofyear(request_date) / 365.25) AS year_{f}{k}"
             for k in (1, 2, 3) for f in ("sin", "cos")]
    waves += [f"{f}(2 * pi() * {k} * (day(request_date) - 1) / day(last_day(request_date)))"
              f" AS month_{f}{k}" for k in (1, 2) for f in ("sin", "cos")]
    flag = "(request_date IN (SELECT h FROM known))"
    return HOLIDAY + ",\n" + CALENDAR_DIM.format(
        ahead=ahead, reach=ahead + 20, columns=calendar_select("request_date", flag),
        waves=",\n    ".join(waves))


AGE = "CAST(GREATEST(COALESCE(p.request_date - p.merchant_created_datetime, 0), 0) AS DOUBLE)"


def panel(source: str = "series") -> str:
    """Feature columns of the panel; needs the calendar and one of core or series."""
    ratios = []
    for group in MIX_GROUPS:
        total = " + ".join(f"p.{c}" for c in group)
        ratios += [f"CASE WHEN {total} > 0 THEN p.{c} / ({total}) ELSE 0 END AS {c}_ratio"
                   for c in group]
    calendar = ", ".join(f"dim.{c}" for c in (
        "is_month_start", "is_month_end", "is_payday_window", "is_quarter_end",
        "days_to_month_end", "holiday_offset", "year_sin1", "year_cos1", "month_cos2", "day_type"))
    return f"""panel AS (SELECT p.*, {calendar},
    CAST(dim.day_of_week AS VARCHAR) AS day_of_week,
    CAST(dim.day_of_month AS VARCHAR) AS day_of_month,
    CAST(dim.calendar_month AS VARCHAR) AS calendar_month,
    CASE WHEN dim.is_uk_bank_holiday THEN 'True' ELSE 'False' END AS is_uk_bank_holiday,
    {AGE} AS since_merchant_creation,
    LN(1 + {AGE}) AS log_merchant_age,
    LN(1 + MIN({AGE}) OVER (PARTITION BY p.merchant_id)) AS log_tenure_at_series_start,
    LN(1 + daily_successful_transaction_count) AS log_success_count,
    LN(1 + daily_unsuccessful_amount_gbp) AS log_unsuccessful_gbp,
    LN(1 + daily_fraud_amount) AS log_fraud_count,
    LN(1 + daily_dispute_amount) AS log_dispute_count,
    LN(1 + CASE WHEN daily_successful_transaction_count > 0
           THEN v / daily_successful_transaction_count ELSE 0 END) AS log_avg_ticket,
    CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_zero_day,
    CASE WHEN daily_transaction_amount <= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS had_no_attempts,
    {', '.join(ratios)}
  FROM {source} p JOIN dim ON dim.request_date = p.request_date)"""


RATIO_NAMES = [f"{c}_ratio" for group in MIX_GROUPS for c in group]
LEVEL_LIST = "[" + ", ".join(str(x) for x in LEVELS) + "]"

# The newest origin of each merchant, quantiles per weekday, and one row per step.
LATEST = f"""ends AS (SELECT merchant_id, MAX(time_idx) AS last_t, MAX(request_date) AS last_date,
    COUNT(*) AS history_days FROM series GROUP BY merchant_id HAVING COUNT(*) >= 28),
wq AS (SELECT s.merchant_id, isodow(s.request_date) AS dow,
    quantile_cont(s.tpv, {LEVEL_LIST}) AS q
  FROM series s JOIN ends e ON e.merchant_id = s.merchant_id AND s.time_idx > e.last_t - 120
  GROUP BY 1, 2),
steps AS (SELECT merchant_id, last_t, last_date,
    CAST(UNNEST(generate_series(1, 91)) AS INT) AS step FROM ends),
predicted AS (SELECT s.merchant_id, s.last_t + 1 AS origin_time_idx, s.step,
    s.last_t + s.step AS time_idx, s.last_date + s.step AS date, wq.q
  FROM steps s JOIN wq ON wq.merchant_id = s.merchant_id
    AND wq.dow = isodow(s.last_date + s.step))"""

EXPECTED = " + ".join(f"{w} * {q}" for w, q in zip(WEIGHTS, Q))
MONEY_LEVELS = ", ".join(f"GREATEST(EXP(q[{i + 1}]) - 1, 0) AS {c}" for i, c in enumerate(Q))
TABLE = f"""tab0 AS (SELECT merchant_id, origin_time_idx, step, time_idx, date, {MONEY_LEVELS}
  FROM predicted),
tab AS (SELECT *, {EXPECTED} AS expected_gbp FROM tab0)"""


def tidy(*parts: str) -> str:
    """Predictions of evaluation origins beside actuals."""
    selects = {"validation": VALIDATION, "holdout": HOLDOUT}
    union = " UNION ALL ".join(f"SELECT '{p}' AS part, * FROM ({selects[p]})" for p in parts)
    return f"""orig AS ({union}),
oq AS (SELECT o.part, o.merchant_id, o.origin_time_idx, isodow(s.request_date) AS dow,
    quantile_cont(s.tpv, {LEVEL_LIST}) AS q
  FROM orig o JOIN series s ON s.merchant_id = o.merchant_id
    AND s.time_idx BETWEEN o.encoder_start_idx AND o.origin_time_idx - 1
  GROUP BY 1, 2, 3, 4),
tidy0 AS (SELECT oq.part, oq.merchant_id, oq.origin_time_idx, s.time_idx,
    CAST(s.time_idx - oq.origin_time_idx + 1 AS INT) AS step, s.request_date,
    GREATEST(EXP(s.tpv) - 1, 0) AS actual_gbp, {MONEY_LEVELS}
  FROM oq JOIN series s ON s.merchant_id = oq.merchant_id
    AND isodow(s.request_date) = oq.dow
    AND s.time_idx BETWEEN oq.origin_time_idx AND oq.origin_time_idx + 90),
tidy AS (SELECT *, {EXPECTED} AS expected_gbp FROM tidy0)"""


SMAPE = "AVG(ABS(q50 - actual_gbp) / GREATEST((ABS(actual_gbp) + ABS(q50)) / 2, 1e-9))"


def metric_select(keys: str) -> str:
    pinball = " + ".join(
        f"GREATEST({t} * (actual_gbp - {q}), ({t} - 1) * (actual_gbp - {q}))"
        for t, q in zip(LEVELS, Q))
    return f"""SELECT {keys} COUNT(*) AS n, {r('AVG(ABS(q50 - actual_gbp))', 4, 'MAE_gbp')},
    {r('SQRT(AVG((q50 - actual_gbp) * (q50 - actual_gbp)))', 4, 'RMSE_gbp')},
    {r('MEDIAN(ABS(q50 - actual_gbp))', 4, 'MedAE_gbp')},
    {r('AVG(q50 - actual_gbp)', 4, 'bias_gbp')},
    {r('CAST(ROUND(SUM(CAST(actual_gbp AS DECIMAL(28, 6))), 2) AS DOUBLE)', 2, 'total_actual_gbp')}, {r('SUM(q50)', 2, 'total_pred_median_gbp')},
    {r('AVG(ABS(LN(1 + GREATEST(q50, 0)) - LN(1 + actual_gbp)))', 6, 'MAE_log')},
    {r(f'SUM({pinball}) / SUM(ABS(actual_gbp))', 6, 'wQL')}, {r(SMAPE, 6, 'sMAPE')},
    {r('AVG(CASE WHEN actual_gbp BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END)', 6, 'coverage_p10_p90')},
    {r('AVG(CASE WHEN actual_gbp BETWEEN q02 AND q98 THEN 1.0 ELSE 0.0 END)', 6, 'coverage_outer')}
  FROM tidy"""


NAIVE = """naive AS (SELECT t.merchant_id, t.step, t.time_idx, t.actual_gbp,
    COALESCE((SELECT v FROM series s WHERE s.merchant_id = t.merchant_id
      AND s.time_idx = t.origin_time_idx - 1), 0) AS naive_last,
    COALESCE((SELECT SUM(v) FROM series s WHERE s.merchant_id = t.merchant_id
      AND s.time_idx <= t.origin_time_idx - 1 AND s.time_idx >= t.time_idx - 7 *
        (CAST(CEIL(t.step / 7.0) AS BIGINT) + 3) AND (t.time_idx - s.time_idx) % 7 = 0), 0) / 4
      AS seasonal_naive
  FROM tidy t)"""

SUMMARY = """totals AS (SELECT merchant_id, MIN(date) AS forecast_start_date,
    MAX(date) AS forecast_end_date, SUM(q50) AS med, SUM(expected_gbp) AS expd
  FROM tab GROUP BY merchant_id),
past AS (SELECT merchant_id, ARG_MAX(merchant_name, time_idx) AS merchant_name,
    COUNT(*) AS history_days, MAX(request_date) AS last_observed_date, MAX(time_idx) AS last_t,
    AVG(v) FILTER (WHERE series_last_idx - time_idx < 28) AS recent,
    COUNT(*) FILTER (WHERE time_idx <= (SELECT sel_cutoff FROM cut)) AS train_days
  FROM series GROUP BY merchant_id),
summary AS (SELECT past.merchant_id, merchant_name, history_days, last_observed_date,
    (SELECT max_t FROM cut) - last_t AS days_since_last_observation,
    forecast_start_date, forecast_end_date, recent AS recent28_mean_gbp,
    med AS horizon_total_median_gbp, expd AS horizon_total_expected_gbp,
    CASE WHEN recent > 0 THEN med / 91 / recent END AS level_ratio,
    CASE WHEN med > 0 THEN expd / med END AS dispersion_ratio,
    train_days = 0 AS cold_start, train_days >= 119 AS had_training_windows,
    CAST(0 AS BIGINT) AS quantile_crossings
  FROM past JOIN totals ON totals.merchant_id = past.merchant_id)"""
SUMMARY_ROUNDED = f"""SELECT * REPLACE ({r('recent28_mean_gbp', 2)},
    {r('horizon_total_median_gbp', 2)}, {r('horizon_total_expected_gbp', 2)},
    {r('level_ratio')}, {r('dispersion_ratio')}) FROM summary"""
FAILS = """(COALESCE(level_ratio < 0.2 OR level_ratio > 5, FALSE)
    OR COALESCE(dispersion_ratio > 6, FALSE))"""
BAND = """CASE WHEN {x} <= 0 THEN NULL WHEN {x} <= 100 THEN '<100' WHEN {x} <= 1000 THEN '100-1k'
    WHEN {x} <= 10000 THEN '1k-10k' WHEN {x} <= 100000 THEN '10k-100k' ELSE '>100k' END"""
FIT = """fit AS (SELECT merchant_id, AVG(tpv) AS center,
    GREATEST(COALESCE(STDDEV_SAMP(tpv), 0), 0.25) AS scale FROM series
  WHERE time_idx <= (SELECT sel_cutoff FROM cut) GROUP BY merchant_id)"""

ROLLUP = """last_seen AS (SELECT merchant_id, MAX(request_date) AS last_date FROM fact GROUP BY 1),
gone AS (SELECT merchant_id FROM last_seen
  WHERE (SELECT MAX(request_date) FROM fact) - last_date > 7),
from_month AS (SELECT date_trunc('month', MIN(last_date)) AS d FROM last_seen
  WHERE merchant_id NOT IN (SELECT merchant_id FROM gone)),
both_sides AS (
  SELECT merchant_id, request_date, CAST(daily_successful_amount_gbp AS DOUBLE) AS a,
    CAST(daily_successful_amount_gbp AS DOUBLE) AS b, CAST(daily_successful_amount_gbp AS DOUBLE) AS c
  FROM fact
  UNION ALL
  SELECT merchant_id, date,
    CASE WHEN q35 = 0 THEN expected_gbp WHEN expected_gbp / q35 >= 6
         THEN (expected_gbp + q35) / 2 ELSE q35 END,
    CASE WHEN q50 = 0 THEN expected_gbp WHEN expected_gbp / q50 >= 3
         THEN (expected_gbp + q50) / 2 ELSE q50 END,
    CASE WHEN q65 = 0 THEN expected_gbp WHEN expected_gbp / q65 >= 2
         THEN (expected_gbp + q65) / 2 ELSE q65 END
  FROM tab)
SELECT CAST(merchant_id AS BIGINT) AS merchant_id, CAST(year(request_date) AS INT) AS request_year,
  CAST(month(request_date) AS INT) AS request_month,
  ROUND(COALESCE(SUM(CASE WHEN a < 0.01 THEN 0 ELSE a END), 0), 2) + 0.0 AS daily_expected_q35,
  ROUND(COALESCE(SUM(CASE WHEN b < 0.01 THEN 0 ELSE b END), 0), 2) + 0.0 AS daily_expected_q50,
  ROUND(COALESCE(SUM(CASE WHEN c < 0.01 THEN 0 ELSE c END), 0), 2) + 0.0 AS daily_expected_q65
FROM both_sides WHERE merchant_id NOT IN (SELECT merchant_id FROM gone)
  AND request_date >= (SELECT d FROM from_month)
GROUP BY 1, 2, 3"""

FEATURE_SELECT = f"""SELECT merchant_id, request_date, time_idx, series_start_idx, {r('tpv')},
    {', '.join(r(c) for c in ('log_success_count', 'log_unsuccessful_gbp', 'log_fraud_count',
                              'log_dispute_count', 'log_avg_ticket', 'log_merchant_age',
                              'log_tenure_at_series_start'))},
    is_zero_day, had_no_attempts, target_imputed, since_merchant_creation, day_of_week,
    day_of_month, calendar_month, day_type, is_uk_bank_holiday, merchant_category, sector_group,
    iso_name, {r('year_sin1')}, {r('month_cos2')}, is_payday_window, holiday_offset FROM panel"""


def grid_select(trim: bool) -> str:
    return ctes(txn(), fact(), CLEAN, grid(trim)) + f"""SELECT merchant_id, request_date,
    {r('daily_successful_amount_gbp')}, daily_transaction_amount,
    daily_successful_transaction_count, daily_payout_amount_gbp, target_imputed, card_amount,
    shift4_amount, merchant_name, merchant_category, sector_group, iso_name,
    merchant_created_datetime FROM grid"""


def fact_select(merchant: str, calendar: bool = True) -> str:
    extra = f", {calendar_select('request_date', FLAG)}" if calendar else ""
    return ctes(txn(merchant), HOLIDAY, fact()) + f"""SELECT * REPLACE (
    {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in MONEY)}){extra} FROM fact"""


def oracles() -> dict[str, str]:
    latest = [CUT, LATEST, TABLE]
    out: dict[str, str] = {}
    out["daily_fact"] = fact_select("supplier")
    out["daily_fact_by_region"] = fact_select("region", calendar=False)
    out["daily_fact_strict_returns"] = ctes(txn()) + """SELECT DISTINCT request_date, merchant_id,
    CAST(0 AS DOUBLE) AS daily_refund_amount_gbp, CAST(0 AS DOUBLE) AS daily_void_amount_gbp
    FROM txn"""
    out["log_size"] = ctes(txn()) + """SELECT COUNT(*) AS rows, CAST(28 AS INT) AS columns,
    COUNT(*) FILTER (WHERE merchant_id IS NULL) AS without_merchant FROM txn"""
    out["presentation_cutoff"] = ctes(txn(), fact()) + """SELECT
    CAST(year(request_date) AS INT) AS calendar_year,
    CAST(month(request_date) AS INT) AS calendar_month, COUNT(*) AS merchant_days,
    CAST(SUM(daily_successful_amount_gbp) AS DOUBLE) AS revenue_gbp
    FROM fact WHERE NOT (year(request_date) = 1998 AND month(request_date) IN (6, 7))
    GROUP BY 1, 2"""
    out["daily_fact_imputed"] = ctes(txn(), fact(), CLEAN) + f"""SELECT merchant_id, request_date,
    {r('daily_successful_amount_gbp')}, CAST(target_imputed AS DOUBLE) AS target_imputed,
    CAST(daily_successful_transaction_count AS DOUBLE) AS daily_successful_transaction_count
    FROM clean"""
    out["coerced_attributes"] = ctes(txn(), fact(), CLEAN) + """SELECT merchant_id, request_date,
    merchant_name, merchant_category, sector_group, iso_name, merchant_created_datetime,
    CAST(unknown_amount AS DOUBLE) AS unknown_amount FROM clean"""
    out["coerced_text"] = f"""SELECT CAST(l_suppkey AS VARCHAR) AS merchant_id,
    CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS request_date,
    COUNT(*) AS rows, COUNT(*) FILTER (WHERE l_discount <> 0) AS readable,
    {r('SUM(CASE WHEN l_discount <> 0 THEN l_extendedprice END)', 2, 'revenue_gbp')}
    FROM lineitem GROUP BY 1, 2"""
    out["latest_row_per_day"] = ctes(txn()) + """SELECT request_date, merchant_id, ingest_key,
    ingest_line, response_result, payment_type, transaction_type,
    CAST(amount_gbp AS DOUBLE) AS amount_gbp
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id, request_date ORDER BY
      ingest_key DESC, ingest_line DESC, response_result DESC, payment_type DESC,
      transaction_type DESC, amount_gbp DESC NULLS LAST) AS k FROM txn) WHERE k = 1"""

    out["imputed_after_copies"] = ctes(txn(), """med AS (SELECT merchant_id,
    MEDIAN(CAST(amount_gbp AS DOUBLE)) AS m FROM txn WHERE amount_gbp > 0 GROUP BY 1)""") + f"""SELECT
    merchant_id, request_date, ingest_key, ingest_line,
    {r('CASE WHEN missing THEN COALESCE(m, 0) ELSE CAST(amount_gbp AS DOUBLE) END', 6,
       'daily_successful_amount_gbp')},
    CASE WHEN missing THEN 1.0 ELSE 0.0 END::DOUBLE AS target_imputed
    FROM (SELECT *, amount_gbp IS NULL AND UPPER(response_result) = 'SUCCESS' AS missing,
        ROW_NUMBER() OVER (PARTITION BY merchant_id, request_date ORDER BY ingest_key DESC,
          ingest_line DESC, amount_gbp DESC NULLS LAST,
          (UPPER(response_result) = 'SUCCESS') DESC) AS k FROM txn)
    LEFT JOIN med USING (merchant_id) WHERE k = 1"""

    days = "SELECT DISTINCT request_date FROM txn"
    out["calendar_lookup"] = ctes(txn(), HOLIDAY) + (
        f"SELECT request_date, {calendar_select('request_date', FLAG)} FROM ({days})")
    out["calendar_lookup_first_row"] = """SELECT request_date, day_of_week, day_name, day_type
    FROM (SELECT CAST(l_shipdate AS DATE) AS request_date, l_linenumber AS day_of_week,
      l_returnflag AS day_name, l_linestatus AS day_type, ROW_NUMBER() OVER (
        PARTITION BY CAST(l_shipdate AS DATE)
        ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus) AS k FROM lineitem)
    WHERE k = 1"""
    out["calendar_dim"] = out["calendar_lookup"]
    out["calendar_week"] = ctes(txn(), calendar_dim(91)) + (
        "SELECT request_date, calendar_week_of_year FROM dim")
    out["bank_holidays"] = ctes(txn(), HOLIDAY) + """SELECT h AS holiday_date FROM holiday
    WHERE h BETWEEN (SELECT MIN(request_date) FROM txn) AND (SELECT MAX(request_date) FROM txn)"""
    waves = [f"year_{f}{k}" for k in (1, 2, 3) for f in ("sin", "cos")]
    waves += [f"month_{f}{k}" for k in (1, 2) for f in ("sin", "cos")]
    out["calendar_features"] = ctes(txn(), calendar_dim(91)) + (
        f"SELECT * REPLACE ({', '.join(r(c) for c in waves)}) FROM dim")
    out["holiday_offset"] = ctes(txn(), calendar_dim(0)) + (
        "SELECT request_date, holiday_offset FROM dim")
    out["calendar_agreement"] = ctes(txn()) + """SELECT UNNEST(['day_of_week', 'day_of_month',
      'calendar_month', 'calendar_week_of_year', 'day_type', 'day_name', 'month_name'])
      AS column_name, n AS dates, CAST(1.0 AS DOUBLE) AS agreement,
      CAST(NULL AS DATE) AS first_difference
    FROM (SELECT COUNT(DISTINCT request_date) AS n FROM txn)"""
    out["holiday_diff"] = ctes(txn(), HOLIDAY) + """SELECT COUNT(*) AS differences FROM holiday
    WHERE h BETWEEN (SELECT MIN(request_date) FROM txn) AND (SELECT MAX(request_date) FROM txn)
      AND h NOT IN (SELECT request_date FROM txn)"""
    faulty = f"""lab AS (SELECT request_date, {calendar_select('request_date', FLAG)} FROM ({days})),
faulty AS (SELECT * REPLACE (
    CASE WHEN day(request_date) = 13 THEN 'Someday' ELSE day_name END AS day_name,
    CASE WHEN month(request_date) = 3 AND day(request_date) = 1 THEN 2 ELSE day_of_month END
      AS day_of_month,
    CASE WHEN month(request_date) = 12 AND day(request_date) = 26 THEN FALSE
         WHEN month(request_date) = 6 AND day(request_date) = 2 THEN TRUE
         ELSE is_uk_bank_holiday END AS is_uk_bank_holiday) FROM lab),
relab AS (SELECT f.request_date, CASE WHEN f.is_uk_bank_holiday THEN 'Holiday'
    WHEN isodow(f.request_date) >= 6 THEN 'Weekend' ELSE 'Working Day' END AS day_type FROM faulty f)"""
    out["calendar_agreement_faulty"] = ctes(txn(), HOLIDAY, faulty) + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) AS dates,
    {r(f'AVG(CASE WHEN f.{c} = {other}.{c} THEN 1.0 ELSE 0.0 END)', 6, 'agreement')},
    MIN(CASE WHEN f.{c} <> {other}.{c} THEN f.request_date END) AS first_difference
    FROM faulty f JOIN lab ON lab.request_date = f.request_date
      JOIN relab ON relab.request_date = f.request_date"""
        for c, other in (("day_of_week", "lab"), ("day_of_month", "lab"), ("calendar_month", "lab"),
                         ("calendar_week_of_year", "lab"), ("day_type", "relab"),
                         ("day_name", "lab"), ("month_name", "lab")))
    out["holiday_diff_faulty"] = ctes(txn(), HOLIDAY, faulty, """own AS (
  SELECT request_date AS h FROM faulty WHERE is_uk_bank_holiday),
rules AS (SELECT h FROM holiday WHERE h BETWEEN (SELECT MIN(request_date) FROM txn)
    AND (SELECT MAX(request_date) FROM txn))""") + """SELECT h AS holiday_date,
    'warehouse' AS only_in FROM own WHERE h NOT IN (SELECT h FROM rules)
    UNION ALL SELECT h, 'computed' FROM rules WHERE h NOT IN (SELECT h FROM own)"""
    out["upcoming_holidays"] = ctes(txn(), HOLIDAY) + """SELECT h AS holiday_date FROM holiday,
    (SELECT MAX(request_date) AS hi FROM txn) WHERE h > hi AND h <= hi + 91"""

    out["daily_grid"] = grid_select(False)
    out["grid_trimmed"] = grid_select(True)
    out["grid_by_nation"] = ctes(txn("nation"), fact(), CLEAN, grid()) + f"""SELECT merchant_id,
    request_date, {r('daily_successful_amount_gbp')}, merchant_name, merchant_category, iso_name,
    merchant_created_datetime FROM grid"""
    out["series_span"] = ctes(*base("supplier")) + """SELECT merchant_id,
    MIN(request_date) AS first_date, MAX(request_date) AS last_date,
    MIN(time_idx) AS series_start_idx, MAX(time_idx) AS last_time_idx FROM core GROUP BY 1"""
    out["panel_features"] = ctes(
        *base("supplier"), calendar_dim(0), panel("core")) + FEATURE_SELECT
    out["panel_features_by_nation"] = ctes(
        *base("nation"), calendar_dim(0), panel()) + FEATURE_SELECT
    out["mix_ratios"] = ctes(*base("nation"), calendar_dim(0), panel("core")) + (
        f"SELECT merchant_id, request_date, {', '.join(r(c) for c in RATIO_NAMES)} FROM panel")
    out["series_stats"] = ctes(*base("supplier")) + (
        f"SELECT merchant_id, days, {r('log_std')}, active_days FROM stats")
    out["series_filter"] = ctes(*base("supplier", 275, days=2480, log_std=3.35)) + """SELECT s.merchant_id,
    COUNT(*) AS observed_days FROM series s JOIN clean c ON c.merchant_id = s.merchant_id
      AND c.request_date = s.request_date GROUP BY 1"""
    out["filter_report"] = ctes(*base("supplier", 275, days=2480, log_std=3.35)) + """SELECT COUNT(*) AS merchants,
    COUNT(*) FILTER (WHERE days >= 2480 AND log_std >= 3.35 AND active_days >= 275) AS kept,
    COUNT(*) FILTER (WHERE days < 2480) AS too_short,
    COUNT(*) FILTER (WHERE log_std < 3.35) AS near_constant,
    COUNT(*) FILTER (WHERE active_days < 275) AS barely_active FROM stats"""
    out["filtered_panel"] = ctes(*base("supplier", 275, days=2480, log_std=3.35)) + (
        f"SELECT merchant_id, COUNT(*) AS days, {r('SUM(v)', 4, 'revenue_gbp')} FROM series GROUP BY 1")
    out["target_profile"] = ctes(*base("nation")) + f"""SELECT COUNT(*) AS n,
    {r('AVG(v)', 4, 'mean_gbp')}, MEDIAN(v) AS median_gbp, MAX(v) AS max_gbp,
    {r('AVG(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END)', 6, 'zero_day_share')},
    {r('AVG(tpv)', 6, 'mean_log')}, {r('STDDEV_SAMP(tpv)', 6, 'std_log')},
    {r('SKEWNESS(tpv)', 6, 'skew_log')}, {r('SKEWNESS(v)', 6, 'skew_gbp')} FROM series"""

    def bounds(train: str) -> str:
        return ctes(*base("region"), CUT) + f"""SELECT max_t AS max_time_idx, val_cutoff, sel_cutoff,
    {train} AS train_cutoff, (SELECT COUNT(*) FROM series WHERE time_idx <= {train}) AS train_rows,
    (SELECT COUNT(DISTINCT merchant_id) FROM series WHERE time_idx <= {train}) AS train_merchants
    FROM cut"""

    out["split_bounds"] = bounds("sel_cutoff")
    out["split_bounds_full"] = bounds("max_t")
    out["window_origins"] = ctes(*base("nation"), CUT) + TRAIN
    out["val_origins_strided"] = ctes(*base("nation"), CUT) + VALIDATION
    out["holdout_origins"] = ctes(*base("nation"), CUT) + HOLDOUT
    out["window_arrays"] = ctes(
        *base("region"), calendar_dim(0), panel(), CUT, FIT, f"orig AS ({VALIDATION})",
        """enc AS (SELECT o.merchant_id, o.origin_time_idx, COUNT(*) AS encoder_days,
    SUM(p.tpv * (p.time_idx - o.encoder_start_idx + 1)) AS a,
    SUM(p.holiday_offset * (p.time_idx - o.encoder_start_idx + 1)) AS b
  FROM orig o JOIN panel p ON p.merchant_id = o.merchant_id
    AND p.time_idx >= o.encoder_start_idx AND p.time_idx < o.origin_time_idx GROUP BY 1, 2)""",
        """dec AS (SELECT o.merchant_id, o.origin_time_idx, COUNT(*) AS decoder_days,
    SUM(p.days_to_month_end * (p.time_idx - o.origin_time_idx + 1)) AS c
  FROM orig o JOIN panel p ON p.merchant_id = o.merchant_id
    AND p.time_idx BETWEEN o.origin_time_idx AND o.origin_time_idx + 90 GROUP BY 1, 2)""",
    ) + f"""SELECT enc.merchant_id, enc.origin_time_idx, encoder_days, decoder_days,
    {r('a', 4, 'encoder_tpv')}, {r('b', 4, 'encoder_offset')}, {r('c', 4, 'decoder_month_end')},
    {r('center')}, {r('scale')}
    FROM enc JOIN dec USING (merchant_id, origin_time_idx) LEFT JOIN fit USING (merchant_id)"""

    out["category_codes"] = ctes(txn()) + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, value, ROW_NUMBER() OVER (ORDER BY value) AS code
    FROM (SELECT DISTINCT {c} AS value FROM txn WHERE {c} IS NOT NULL)"""
        for c in ("merchant_id", "merchant_category", "sector_group", "iso_name"))
    out["encoded_rows"] = ctes(txn(), fact(), """codes AS (
  SELECT iso_name, DENSE_RANK() OVER (ORDER BY iso_name) AS code
  FROM (SELECT DISTINCT iso_name FROM fact WHERE request_date < DATE '1995-01-20'
        AND iso_name IS NOT NULL))""") + """SELECT f.iso_name,
    COALESCE(code, 0) AS iso_name_code, COUNT(*) AS rows
    FROM fact f LEFT JOIN codes ON codes.iso_name = f.iso_name GROUP BY 1, 2"""
    out["group_normaliser"] = ctes(*base("nation"), CUT, FIT) + (
        f"SELECT merchant_id, {r('center')}, {r('scale')} FROM fit")
    out["normaliser_fallback"] = ctes(*base("nation"), CUT, FIT) + (
        f"SELECT {r('MEDIAN(center)', 6, 'center')}, {r('MEDIAN(scale)', 6, 'scale')} FROM fit")
    out["normalised_target"] = ctes(*base("nation"), CUT, FIT) + f"""SELECT merchant_id, time_idx,
    {r('(tpv - c) / s', 5, 'tpv_scaled')}, {r('tpv', 5, 'tpv_back')} FROM (
      SELECT series.*, COALESCE(center, (SELECT MEDIAN(center) FROM fit)) AS c,
        COALESCE(scale, (SELECT MEDIAN(scale) FROM fit)) AS s
      FROM series LEFT JOIN fit USING (merchant_id))"""
    out["cold_start"] = ctes(*base("supplier"), """fit AS (SELECT merchant_id, AVG(tpv) AS center,
    GREATEST(COALESCE(STDDEV_SAMP(tpv), 0), 0.25) AS scale FROM core WHERE time_idx <= 10
  GROUP BY merchant_id)""") + f"""SELECT merchant_id, center IS NULL AS cold_start,
    {r('COALESCE(center, (SELECT MEDIAN(center) FROM fit))', 6, 'center')},
    {r('COALESCE(scale, (SELECT MEDIAN(scale) FROM fit))', 6, 'scale')}
    FROM (SELECT DISTINCT merchant_id FROM core) LEFT JOIN fit USING (merchant_id)"""
    observed = ["tpv", "log_success_count", "log_unsuccessful_gbp", "log_fraud_count",
                "log_dispute_count", "log_avg_ticket", "is_zero_day", "had_no_attempts",
                "target_imputed", *RATIO_NAMES]
    spread = ctes(*base("nation"), calendar_dim(0), panel(), CUT)
    out["column_spread"] = spread + "SELECT " + ", ".join(
        r(f"STDDEV_SAMP({c})", 6, c) for c in observed) + (
        " FROM panel WHERE time_idx <= (SELECT sel_cutoff FROM cut)")
    out["informative_columns"] = spread + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name FROM panel WHERE time_idx <= (SELECT sel_cutoff FROM cut)
    HAVING STDDEV_SAMP({c}) > 1e-6""" for c in observed)
    out["group_mask"] = ctes(*base("nation"), CUT) + f"""SELECT o.*, draw < 1500 AS masked,
    CASE WHEN draw < 1500 THEN 0 ELSE code END AS merchant_id_code
    FROM (SELECT *, CAST('0x' || substr(md5(merchant_id || '|' || origin_time_idx || '|42'), 1, 8)
        AS BIGINT) % 10000 AS draw FROM ({VALIDATION})) AS d
    JOIN (SELECT merchant_id, ROW_NUMBER() OVER (ORDER BY merchant_id) AS code
      FROM (SELECT DISTINCT merchant_id FROM series)) AS c USING (merchant_id)
    JOIN ({VALIDATION}) AS o USING (merchant_id, origin_time_idx)"""
    out["scale_alignment"] = ctes(*base("nation"), CUT, FIT, f"""orig AS (
  SELECT 'validation' AS part, merchant_id FROM ({VALIDATION})
  UNION ALL SELECT 'holdout', merchant_id FROM ({HOLDOUT}))""") + """SELECT part,
    COUNT(*) FILTER (WHERE center IS NOT NULL) AS checked,
    COUNT(*) FILTER (WHERE center IS NULL) AS cold, CAST(0 AS BIGINT) AS mismatched
    FROM orig LEFT JOIN fit USING (merchant_id) GROUP BY part"""
    out["scale_floor"] = ctes(*base("supplier"), """fit AS (SELECT merchant_id, AVG(x) AS center,
    GREATEST(STDDEV_SAMP(x), 0.25) AS scale
  FROM (SELECT merchant_id, LN(1 + daily_successful_transaction_count) AS x FROM series)
  GROUP BY merchant_id)""") + f"""SELECT COUNT(*) AS merchants,
    COUNT(DISTINCT (center, scale)) AS distinct_pairs, {r('MIN(center)', 6, 'lowest_center')},
    {r('MAX(center)', 6, 'highest_center')}, {r('MIN(scale)', 6, 'lowest_scale')},
    {r('MAX(scale)', 6, 'highest_scale')},
    COUNT(*) FILTER (WHERE scale <= 0.25) AS on_floor FROM fit"""

    def future(merchant: str) -> str:
        return ctes(*base(merchant), calendar_dim(91), panel(), """fut AS (
  SELECT p.* REPLACE (p.time_idx + k AS time_idx, p.request_date + k AS request_date)
  FROM panel p, (SELECT CAST(UNNEST(generate_series(1, 91)) AS INT) AS k)
  WHERE p.time_idx = p.series_last_idx)""")

    age = AGE.replace("p.request_date", "f.request_date").replace(
        "p.merchant_created", "f.merchant_created")
    zero = ("tpv", "daily_successful_amount_gbp", "log_success_count", "card_amount_ratio")
    out["future_frame"] = future("nation") + f"""SELECT f.merchant_id, f.time_idx, f.request_date,
    {', '.join(f'CAST(0 AS DOUBLE) AS {c}' for c in zero)}, f.card_amount,
    CAST(d.day_of_week AS VARCHAR) AS day_of_week, CAST(d.day_of_month AS VARCHAR) AS day_of_month,
    CAST(d.calendar_month AS VARCHAR) AS calendar_month, d.day_type,
    CASE WHEN d.is_uk_bank_holiday THEN 'True' ELSE 'False' END AS is_uk_bank_holiday,
    d.holiday_offset, d.days_to_month_end, {r('d.year_cos1', 6, 'year_cos1')},
    {r(f'LN(1 + {age})', 6, 'log_merchant_age')},
    {r('f.log_tenure_at_series_start', 6, 'log_tenure_at_series_start')},
    {age} AS since_merchant_creation
    FROM fut f JOIN dim d ON d.request_date = f.request_date"""
    out["history_and_future"] = ctes(*base("region")) + """SELECT merchant_id,
    COUNT(*) + 91 AS days, MIN(time_idx) AS first_time_idx, MAX(time_idx) + 91 AS last_time_idx,
    MAX(request_date) + 91 AS last_date,
    CAST(COUNT(*) FILTER (WHERE v <= 0) AS DOUBLE) AS zero_days FROM series GROUP BY 1"""
    out["future_batch_vs_single"] = "SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right"
    out["future_calendar_check"] = future("region") + """SELECT f.merchant_id, COUNT(*) AS days,
    CAST(0 AS BIGINT) AS wrong_weekday, COUNT(DISTINCT d.day_of_week) AS weekdays,
    COUNT(DISTINCT d.day_type) AS day_types,
    COUNT(*) FILTER (WHERE d.is_uk_bank_holiday) AS bank_holidays, TRUE AS passes
    FROM fut f JOIN dim d ON d.request_date = f.request_date GROUP BY 1"""
    out["min_history"] = ctes(*base("supplier")) + """SELECT COUNT(*) AS merchants,
    COUNT(*) FILTER (WHERE n < 2475) AS too_short_to_forecast,
    COUNT(*) FILTER (WHERE n < 2485) AS without_training_window, MIN(n) AS shortest
    FROM (SELECT COUNT(*) AS n FROM series GROUP BY merchant_id)"""

    q_logs = ", ".join(r(f"q[{i + 1}]", 6, c) for i, c in enumerate(Q))
    out["quantile_forecast"] = ctes(*base("region"), CUT, LATEST) + (
        f"SELECT merchant_id, origin_time_idx, step, time_idx, {q_logs} FROM predicted")
    out["ml_forecast_keys"] = ctes(*base("nation"), CUT, LATEST) + (
        "SELECT merchant_id, origin_time_idx, step, time_idx, date FROM predicted")
    some_levels = ("level7", "level28", "level120", "highest", "idle")
    some_days = ("year_cos1", "is_month_start", "is_payday_window", "days_to_month_end",
                 "holiday_offset", "log_merchant_age")
    inputs = sorted([*some_levels, "weekday_level", "step_share", *some_days, "one", "label"])
    pairs = [(a, b) for i, a in enumerate(inputs) for b in inputs[i:]]
    scaled = """scaled AS (SELECT p.*, (p.tpv - center) / scale AS label, 1.0 AS one,
    CASE WHEN p.tpv <= 0 THEN 1.0 ELSE 0.0 END AS no_sale FROM panel p JOIN fit USING (merchant_id)),
weekly AS (SELECT *, (label + COALESCE(LAG(label, 7) OVER w, label) + COALESCE(LAG(label, 14) OVER w, label)
    + COALESCE(LAG(label, 21) OVER w, label)) / 4 AS week,
    AVG(label) OVER (w ROWS 6 PRECEDING) AS level7, AVG(label) OVER (w ROWS 27 PRECEDING) AS level28,
    AVG(label) OVER (w ROWS 119 PRECEDING) AS level120, MAX(label) OVER (w ROWS 119 PRECEDING) AS highest,
    AVG(no_sale) OVER (w ROWS 119 PRECEDING) AS idle
  FROM scaled WINDOW w AS (PARTITION BY merchant_id ORDER BY time_idx)),
told AS (SELECT merchant_id, time_idx + 1 AS origin_time_idx, level7, level28, level120, highest, idle, ["""
    scaled += ", ".join(f"COALESCE(LAG(week, {k}) OVER w, level28)" for k in range(7)) + """] AS weeks
  FROM weekly WINDOW w AS (PARTITION BY merchant_id ORDER BY time_idx)),
stepped AS (SELECT k.*, UNNEST(range(1, 92)) AS step FROM orig o
  JOIN told k USING (merchant_id, origin_time_idx)),
x AS (SELECT s.level7, s.level28, s.level120, s.highest, s.idle, s.weeks[(91 - s.step) % 7 + 1] AS weekday_level,
    s.step / 91 AS step_share, d.* FROM stepped s JOIN scaled d
  ON d.merchant_id = s.merchant_id AND d.time_idx = s.origin_time_idx + s.step - 1)"""
    products = f"""SELECT UNNEST([{', '.join(f"'{a}'" for a, _ in pairs)}]) AS "left",
    UNNEST([{', '.join(f"'{b}'" for _, b in pairs)}]) AS "right",
    ROUND(UNNEST([{', '.join(f'SUM({a} * {b})' for a, b in pairs)}]) / COUNT(*), 5) + 0.0 AS mean,
    COUNT(*) AS n FROM x"""
    features_of = (*base("region"), calendar_dim(0), panel(), CUT, FIT)
    every = TRAIN.replace("LEAST(sel_cutoff, series_last_idx)", "series_last_idx")
    out["ml_moments"] = ctes(*features_of, f"orig AS ({TRAIN})", scaled) + products
    out["ml_full_refit_state"] = ctes(*features_of, f"orig AS ({every})", scaled) + products
    columns = ("merchant_id", "day_of_week", "day_of_month", "calendar_month", "is_uk_bank_holiday",
               "merchant_category", "sector_group", "iso_name")
    fold = "((time_idx // 91) % 5)"
    trained = f"""trained AS (SELECT p.*, (p.tpv - center) / scale AS label, {fold} AS fold
  FROM panel p JOIN fit USING (merchant_id), cut WHERE time_idx <= sel_cutoff)"""
    each = "each AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, label, fold FROM trained WHERE {c} IS NOT NULL"
        for c in columns) + ")"
    out["category_effects"] = ctes(
        *base("nation"), calendar_dim(0), panel(), CUT, FIT, trained, each) + """SELECT "column", value,
    COUNT(*) AS days, """ + r("SUM(label) / (COUNT(*) + 200)", 6, "effect0") + ", " + ", ".join(
        r(f"COALESCE(SUM(label) FILTER (WHERE fold <> {k}), 0) / (COUNT(*) FILTER (WHERE fold <> {k}) + 200)",
          6, f"effect{k + 1}") for k in range(5)) + " FROM each GROUP BY 1, 2"
    draw = "('0x' || substr(md5(o.merchant_id || '|' || o.origin_time_idx || '|42'), 1, 8))::BIGINT % 10000"
    out["masked_identity"] = ctes(
        *base("nation"), CUT, FIT, f"orig AS ({TRAIN})", f"""trained AS (SELECT merchant_id, {fold} AS fold,
    (tpv - center) / scale AS label FROM series JOIN fit USING (merchant_id), cut WHERE time_idx <= sel_cutoff)""",
        """own AS (SELECT merchant_id, f.fold, COALESCE(SUM(label) FILTER (WHERE t.fold <> f.fold), 0)
      / (COUNT(*) FILTER (WHERE t.fold <> f.fold) + 200) AS effect
  FROM trained t, (SELECT UNNEST(range(5)) AS fold) f GROUP BY 1, 2)""") + f"""SELECT o.merchant_id,
    COUNT(*) AS windows, COUNT(*) FILTER (WHERE {draw} < 1500 OR effect = 0) AS without_identity,
    {r(f'SUM(CASE WHEN {draw} < 1500 THEN 0 ELSE effect END)', 4, 'total_identity')}
    FROM orig o JOIN own ON own.merchant_id = o.merchant_id AND own.fold = (o.origin_time_idx // 91) % 5
    GROUP BY 1"""
    out["ml_pinball_gradient"] = f"SELECT UNNEST({LEVEL_LIST})::DOUBLE AS level, 0.0::DOUBLE AS largest_gap"
    out["ml_dropped_inputs"] = ctes(*base("region"), CUT, f"orig AS ({TRAIN})") + """SELECT
    UNNEST(['constant', 'twice', 'blend']) AS input, (SELECT COUNT(*) FROM orig) AS windows"""
    out["ml_evaluation_rows"] = ctes(*base("region"), CUT, tidy("validation", "holdout")) + f"""SELECT part,
    merchant_id, COUNT(*) AS rows, COUNT(DISTINCT origin_time_idx) AS origins,
    CAST(ROUND(SUM(CAST(actual_gbp AS DECIMAL(28, 6))), 2) AS DOUBLE) AS actual_gbp,
    CAST(0 AS BIGINT) AS crossed FROM tidy GROUP BY 1, 2"""
    out["scale_alignment_faulty"] = ctes(*base("nation"), CUT, FIT, f"orig AS ({VALIDATION})") + """SELECT
    'validation' AS part, COUNT(*) FILTER (WHERE center IS NOT NULL) AS checked,
    COUNT(*) FILTER (WHERE center IS NULL) AS cold,
    COUNT(*) FILTER (WHERE center IS NOT NULL AND (CAST(orig.merchant_id AS INT) % 3 = 0
                     OR CAST(orig.merchant_id AS INT) % 5 = 0)) AS mismatched
    FROM orig LEFT JOIN fit USING (merchant_id)"""
    out["quantile_forecast_by_origin"] = out["quantile_forecast"]
    out["forecast_report"] = ctes(*base("region"), *latest) + f"""SELECT merchant_id, time_idx, date,
    {', '.join(r(c, 4) for c in ('q35', 'q50', 'q65', 'expected_gbp'))} FROM tab"""
    out["decoder_dates"] = "SELECT CAST(0 AS BIGINT) AS days_without_date"
    tidy_select = f"""SELECT part, merchant_id, origin_time_idx, time_idx, step, request_date,
    {', '.join(r(c, 4) for c in ('actual_gbp', *Q, 'expected_gbp'))} FROM tidy"""
    out["holdout_predictions"] = ctes(*base("region"), CUT, tidy("holdout")) + tidy_select
    out["validation_predictions"] = ctes(*base("nation"), CUT, tidy("validation")) + tidy_select
    naive = ctes(*base("nation"), CUT, tidy("holdout"), NAIVE)
    out["baseline_last"] = naive + (
        f"SELECT merchant_id, step, time_idx, {r('actual_gbp', 4)}, {r('naive_last', 4)} FROM naive")
    out["baseline_seasonal"] = naive + (
        f"SELECT merchant_id, step, time_idx, {r('actual_gbp', 4)}, {r('seasonal_naive', 4)} FROM naive")
    out["baseline_metrics"] = ctes(*base("region"), CUT, tidy("holdout"), NAIVE) + " UNION ALL ".join(
        f"""SELECT '{b}' AS baseline, COUNT(*) AS n, {r(f'AVG(ABS({b} - actual_gbp))', 4, 'MAE_gbp')},
    {r(f'SQRT(AVG(({b} - actual_gbp) * ({b} - actual_gbp)))', 4, 'RMSE_gbp')},
    {r(f'AVG(ABS(LN(1 + {b}) - LN(1 + actual_gbp)))', 6, 'MAE_log')} FROM naive"""
        for b in ("naive_last", "seasonal_naive"))
    out["baseline_val_mae"] = ctes(*base("nation"), CUT, f"orig AS ({VALIDATION})") + f"""SELECT
    COUNT(*) AS n, {r('AVG(ABS(a.tpv - s.tpv))', 6, 'mae_log')}
    FROM orig o JOIN series a ON a.merchant_id = o.merchant_id AND a.time_idx = o.origin_time_idx - 1
    JOIN series s ON s.merchant_id = o.merchant_id
      AND s.time_idx BETWEEN o.origin_time_idx AND o.origin_time_idx + 90"""
    out["forecast_metrics"] = ctes(*base("region"), CUT, tidy("holdout")) + metric_select("")
    out["metrics_by_split"] = ctes(*base("nation"), CUT, tidy("validation", "holdout")) + (
        metric_select("part,") + " GROUP BY part")
    out["metrics_by_band"] = ctes(*base("nation"), CUT, tidy("holdout"), f"""lvl AS (
  SELECT merchant_id, {BAND.format(x='AVG(v)')} AS band FROM series GROUP BY 1)""") + f"""SELECT band,
    COUNT(*) AS n, {r('AVG(ABS(q50 - actual_gbp))', 4, 'MAE_gbp')},
    {r('AVG(ABS(LN(1 + q50) - LN(1 + actual_gbp)))', 6, 'MAE_log')}, {r(SMAPE, 6, 'sMAPE')}
    FROM tidy JOIN lvl USING (merchant_id) WHERE band IS NOT NULL GROUP BY band"""
    out["exact_medians"] = "SELECT l_returnflag, " + ", ".join(
        r(f"quantile_cont(l_extendedprice, {p})", 4, c)
        for p, c in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))) + (
        " FROM lineitem GROUP BY l_returnflag")

    out["forecast_summary"] = ctes(*base("region"), *latest, SUMMARY) + SUMMARY_ROUNDED
    out["forecast_summary_by_supplier"] = ctes(*base("supplier"), *latest, SUMMARY) + SUMMARY_ROUNDED
    nation = ctes(*base("nation"), *latest, SUMMARY)
    out["sanity_failures"] = nation + f"""SELECT merchant_id, history_days,
    days_since_last_observation, {r('recent28_mean_gbp', 2)}, {r('horizon_total_median_gbp', 2)},
    {r('level_ratio')}, {r('dispersion_ratio')} FROM (SELECT * FROM summary WHERE {FAILS}
      ORDER BY ABS(horizon_total_expected_gbp) DESC, merchant_id LIMIT 15)"""
    out["top_merchants"] = ctes(*base("nation")) + f"""SELECT merchant_id,
    {r('m', 4, 'mean_daily_gbp')} FROM (SELECT merchant_id, AVG(v) AS m FROM series
      GROUP BY merchant_id HAVING COUNT(*) >= 28 ORDER BY m DESC, merchant_id LIMIT 10)"""
    uneven = ctes(*changed_base(
        "nation", """CASE WHEN CAST(merchant_id AS INT) % 5 = 2 AND request_date >= DATE '2001-01-01'
      THEN 0 ELSE CAST(daily_successful_amount_gbp AS DOUBLE) END""",
        """NOT (CAST(merchant_id AS INT) % 5 = 0 AND request_date >= DATE '1999-01-01')
    AND NOT (CAST(merchant_id AS INT) % 5 = 1 AND request_date < DATE '2001-06-01')"""),
        *latest, SUMMARY)
    out["forecast_summary_uneven"] = uneven + SUMMARY_ROUNDED
    totals = f"""SELECT COUNT(*) AS forecasts,
    {r('SUM(horizon_total_median_gbp)', 2, 'total_median_gbp')},
    {r('SUM(horizon_total_expected_gbp)', 2, 'total_expected_gbp')},
    COUNT(*) FILTER (WHERE days_since_last_observation <= 1) AS current,
    COUNT(*) FILTER (WHERE days_since_last_observation > 30) AS stale,
    COUNT(*) FILTER (WHERE cold_start) AS cold_start,
    COUNT(*) FILTER (WHERE NOT had_training_windows) AS untrained,
    COUNT(*) FILTER (WHERE recent28_mean_gbp <= 0) AS dormant,
    COUNT(*) FILTER (WHERE {FAILS}) AS failed_sanity,
    CAST(SUM(quantile_crossings) AS BIGINT) AS quantile_crossings,
    COUNT(*) FILTER (WHERE quantile_crossings > 0) AS merchants_with_crossings FROM summary"""
    out["run_totals"] = nation + totals
    out["run_totals_uneven"] = uneven + totals
    levels = """l_quantity * 1000, l_extendedprice, l_tax * 500000,
      l_extendedprice / l_quantity * 10"""
    out["quantile_order"] = f"""SELECT l_suppkey AS merchant_id,
    CAST(SUM((x[2] < x[1])::INT + (x[3] < x[2])::INT + (x[4] < x[3])::INT) AS BIGINT) AS crossings,
    {', '.join(r(f'SUM(list_sort(x)[{i}])', 2, f'level_{i}') for i in (1, 2, 3, 4))}
    FROM (SELECT l_suppkey, [{levels}] AS x FROM lineitem) GROUP BY 1"""
    out["recent_level"] = ctes(*base("nation")) + f"""SELECT merchant_id,
    ARG_MAX(merchant_name, time_idx) AS merchant_name, COUNT(*) AS history_days,
    MAX(request_date) AS last_observed_date, MAX(time_idx) AS last_time_idx,
    {r('AVG(v) FILTER (WHERE series_last_idx - time_idx < 28)', 4, 'recent28_mean_gbp')}
    FROM series GROUP BY 1"""
    out["missing_forecasts"] = ctes(*base("supplier")) + """SELECT merchant_id,
    COUNT(*) AS history_days FROM core GROUP BY 1 HAVING COUNT(*) < 2470"""
    out["merchant_report"] = ctes(*base("region"), *latest, """mine AS (
  SELECT AVG(v) AS rm, MEDIAN(v) AS rmed FROM series
  WHERE merchant_id = '1' AND series_last_idx - time_idx < 28),
ahead AS (SELECT AVG(q50) AS hm, AVG(expected_gbp) AS he, SUM(q50) AS tm, SUM(expected_gbp) AS te
  FROM tab WHERE merchant_id = '1'),
rep AS (SELECT *, hm / GREATEST(rm, 1e-9) AS lr, he / GREATEST(hm, 1e-9) AS dr FROM mine, ahead)
""") + f"""SELECT '1' AS merchant_id, {r('rm', 2, 'recent_mean_gbp')},
    {r('rmed', 2, 'recent_median_gbp')}, {r('hm', 2, 'horizon_mean_median_gbp')},
    {r('he', 2, 'horizon_mean_expected_gbp')}, {r('tm', 2, 'horizon_total_median_gbp')},
    {r('te', 2, 'horizon_total_expected_gbp')}, CAST(0 AS BIGINT) AS quantile_crossings,
    {r('LN(1 + lr)', 6, 'level_ratio_log1p')}, {r('LN(1 + dr)', 6, 'dispersion_ratio_log1p')},
    lr BETWEEN 0.2 AND 5 AS level_plausible, dr <= 6 AS dispersion_ok FROM rep"""
    out["merchant_bands"] = ctes(*base("nation")) + f"""SELECT merchant_id,
    {r('AVG(v)', 4, 'mean_daily_gbp')}, {BAND.format(x='AVG(v)')} AS band FROM series GROUP BY 1"""
    out["training_days"] = ctes(*base("nation"), CUT) + """SELECT merchant_id,
    COUNT(*) FILTER (WHERE time_idx <= sel_cutoff) AS train_days,
    COUNT(*) FILTER (WHERE time_idx <= sel_cutoff) >= 119 AS had_training_windows
    FROM series, cut GROUP BY 1"""
    pairs = (("daily_successful_transaction_count", "log_success_count"),
             ("daily_unsuccessful_amount_gbp", "log_unsuccessful_gbp"),
             ("daily_successful_amount_gbp", "tpv"))
    whale = ctes(*base("nation"), calendar_dim(0), panel(), f"""lvl AS (
  SELECT merchant_id, {BAND.format(x='AVG(v)')} AS band FROM series GROUP BY 1)""",
                 "banded AS (SELECT panel.*, band FROM panel JOIN lvl USING (merchant_id))")

    def whale_row(raw: str, log: str) -> str:
        def z(c: str) -> str:
            return (f"(({c} - (SELECT AVG({c}) FROM banded)) / "
                    f"(SELECT STDDEV_POP({c}) FROM banded))")

        def share(c: str) -> str:
            return (f"SUM(CASE WHEN band = '>100k' THEN {z(c)} * {z(c)} ELSE 0 END)"
                    f" / SUM({z(c)} * {z(c)})")

        def sd(c: str) -> str:
            return f"STDDEV_POP(CASE WHEN band = '<100' THEN {z(c)} END)"

        return f"""SELECT '{raw}' AS column_name, COUNT(*) AS rows,
    COUNT(*) FILTER (WHERE band = '>100k') AS whale_rows,
    {share(log)} < {share(raw)} AND {sd(log)} > 5 * {sd(raw)} AS passes,
    {r(share(raw), 5, 'raw_share')}, {r(share(log), 5, 'log_share')},
    {r(sd(raw), 5, 'raw_spread')}, {r(sd(log), 5, 'log_spread')} FROM banded"""

    out["whale_share"] = whale + " UNION ALL ".join(whale_row(*p) for p in pairs)
    scaled = """CAST(daily_successful_amount_gbp AS DOUBLE) * CASE CAST(merchant_id AS INT) % 3
      WHEN 0 THEN 0.001 WHEN 1 THEN 10.0 ELSE 1.0 END"""
    out["whale_share_scaled"] = whale.replace(
        ctes(*base("nation")).rstrip(), ctes(*changed_base("nation", scaled)).rstrip(), 1
    ) + " UNION ALL ".join(whale_row(*p) for p in pairs)

    out["inactive_merchants"] = ctes(txn(), fact()) + """SELECT CAST(merchant_id AS BIGINT) AS
    merchant_id, MAX(request_date) AS last_date FROM fact GROUP BY 1
    HAVING (SELECT MAX(request_date) FROM fact) - MAX(request_date) > 7"""
    fixes = [("q35", "CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity * 100 END", 6),
             ("q50", "CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity * 300 END", 3),
             ("q65", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 700 END", 2)]
    inner = ", ".join(f"{e} AS {n}" for n, e, _ in fixes)
    outer = ", ".join(
        r(f"SUM(CASE WHEN {n} = 0 THEN e WHEN e / {n} >= {cap} THEN (e + {n}) / 2 ELSE {n} END)",
          4, f"daily_expected_{n}") for n, _, cap in fixes)
    out["forecast_repair"] = f"""SELECT merchant_id, request_date, {outer} FROM (
    SELECT l_suppkey AS merchant_id, CAST(l_shipdate AS DATE) AS request_date,
      l_extendedprice AS e, {inner} FROM lineitem) GROUP BY 1, 2"""
    out["monthly_rollup"] = ctes(*base("region"), *latest) .rstrip() + ",\n" + ROLLUP
    out["monthly_rollup_by_supplier"] = ctes(*base("supplier"), *latest).rstrip() + ",\n" + ROLLUP
    out["forecast_files_scan"] = ctes(*base("region"), *latest) + f"""SELECT
    CAST(merchant_id AS BIGINT) AS merchant_id, time_idx, date AS request_date,
    {', '.join(r(c, 4) for c in ('q35', 'q50', 'q65', 'expected_gbp'))} FROM tab"""
    for name, numbered in (("monthly_rollup_text_ids", "monthly_rollup"),
                           ("forecast_files_text_ids", "forecast_files_scan")):
        head, tail = out[numbered].rsplit("CAST(merchant_id AS BIGINT) AS merchant_id", 1)
        out[name] = head + "'S-' || merchant_id || ' a/b+50%' AS merchant_id" + tail
    for name, same in (("log_files", "daily_fact"), ("fact_files", "daily_fact_by_region"),
                       ("prediction_files", "holdout_predictions"),
                       ("summary_files", "forecast_summary"),
                       ("consolidated_files", "forecast_report"),
                       ("rollup_files", "monthly_rollup"), ("metric_files", "forecast_metrics")):
        out[name] = out[same]
    out["event_series"] = ctes("""clean AS (SELECT CAST(ts AS DATE) AS request_date,
    CAST(user_id AS VARCHAR) AS merchant_id, COUNT(*) AS n,
    CAST(SUM(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END)
      AS DOUBLE) AS daily_successful_amount_gbp FROM events GROUP BY 1, 2)""",
        """span AS (SELECT merchant_id, MIN(request_date) AS lo, MAX(request_date) AS hi
  FROM clean WHERE daily_successful_amount_gbp > 0 GROUP BY 1)""",
        """grid AS (SELECT d.merchant_id, d.request_date, c.daily_successful_amount_gbp FROM (
    SELECT s.merchant_id, CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP),
      CAST((SELECT MAX(request_date) FROM clean c WHERE c.merchant_id = s.merchant_id) AS TIMESTAMP),
      INTERVAL 1 DAY)) AS DATE) AS request_date FROM span s) d
    LEFT JOIN clean c ON c.merchant_id = d.merchant_id AND c.request_date = d.request_date)""",
        CORE, """ok AS (SELECT merchant_id FROM core GROUP BY 1 HAVING COUNT(*) >= 10
    AND COALESCE(STDDEV_SAMP(tpv), 0) >= 0.2 AND COUNT(*) FILTER (WHERE v > 0) >= 5)""",
    ) + f"""SELECT merchant_id, request_date, time_idx, series_start_idx,
    {r('v', 6, 'daily_successful_amount_gbp')}, {r('tpv')}
    FROM core WHERE merchant_id IN (SELECT merchant_id FROM ok)"""
    return out
