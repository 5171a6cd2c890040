"""Settings, column groups and column roles."""

from __future__ import annotations

from dataclasses import dataclass, replace

MERCHANT = "merchant_id"
DATE = "request_date"
TIME = "time_idx"

# --- fixed values: columns of the merchant-day fact and the texts they count ---
CALENDAR_COLUMNS = (
    "day_of_week", "day_of_month", "calendar_month", "month_name", "calendar_year",
    "calendar_quarter", "calendar_week_of_year", "day_name", "day_type", "is_uk_bank_holiday",
)
MERCHANT_ATTRIBUTES = (
    "merchant_name", "merchant_category", "sector_group", "iso_id", "iso_name",
    "merchant_created_datetime",
)
STATIC_ATTRIBUTES = (
    "merchant_category", "sector_group", "iso_name", "merchant_name", "merchant_created_datetime",
)
ACQUIRER_COUNTS = {
    "migration_amount": "MIGRATION",
    "acquired_amount": "ACQUIRED.COM",
    "trust_amount": "TRUST PAYMENTS",
    "unknown_amount": "UNKNOWN",
    "cashflows_amount": "CASHFLOWS",
    "barclaycard_amount": "BARCLAYCARD",
    "lloyds_amount": "LLOYDS CARDNET",
    "shift4_amount": "SHIFT4",
}
RESPONSE_COUNTS = {
    "daily_successful_transaction_count": "SUCCESS",
    "declined_amount": "DECLINED",
    "expired_amount": "EXPIRED",
    "cancelled_amount": "CANCELLED",
    "pending_amount": "PENDING",
    "error_amount": "ERROR",
    "quarantined_amount": "QUARANTINED",
    "unknown_response_amount": "UNKNOWN",
    "blocked_amount": "BLOCKED",
}
PAYMENT_COUNTS = {
    "card_amount": "CARD",
    "dd_amount": "DIRECT_DEBIT",
    "pbb_amount": "PAY_BY_BANK",
    "payouts_amount": "PAYOUTS",
    "bacs_amount": "BACS_RECEIVE",
    "vrp_amount": "VARIABLE_RECURRING_PAYMENT",
}
INTEGRATION_COUNTS = {"core_amount": "CORE", "rest_amount": "REST"}
ZERO_ON_INACTIVE_DAY = (
    "daily_transaction_amount",
    "daily_successful_transaction_count",
    "daily_successful_amount_gbp",
    "daily_unsuccessful_amount_gbp",
    "daily_fraud_amount",
    "daily_dispute_amount",
)
MIX_GROUPS = (
    tuple(ACQUIRER_COUNTS), tuple(PAYMENT_COUNTS), tuple(RESPONSE_COUNTS), tuple(INTEGRATION_COUNTS),
)
COUNT_COLUMNS = tuple(dict.fromkeys(
    ZERO_ON_INACTIVE_DAY + tuple(c for group in MIX_GROUPS for c in group)
))
# Upper bounds (GBP, mean daily revenue) and names of the merchant size bands.
SIZE_BANDS = ((100, "<100"), (1_000, "100-1k"), (10_000, "1k-10k"), (100_000, "10k-100k"),
              (float("inf"), ">100k"))
# Largest believable expected / quantile ratio per reported level of the rollup.
REPAIR_CAPS = {"q35": 6.0, "q50": 3.0, "q65": 2.0}
# --- end of fixed values ---

YEAR_HARMONICS = 3
MONTH_HARMONICS = 2
HOLIDAY_OFFSET_CLIP = 10
HOLIDAY_LOOKAHEAD_DAYS = 20
# A calendar of this many days is about 270 years and 25 MB; past it joins shuffle instead.
MAX_BROADCAST_DAYS = 100_000


@dataclass(frozen=True)
class ColumnRoles:
    """Which panel columns a forecaster may read, and when it knows them."""

    target: str
    known_reals: tuple[str, ...]
    known_categoricals: tuple[str, ...]
    observed_reals: tuple[str, ...]
    static_categoricals: tuple[str, ...]
    static_reals: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.target not in self.observed_reals:
            raise ValueError(f"{self.target} must be an observed real, or history is unseen")
        if self.target in self.known_reals:
            raise ValueError(f"{self.target} must never be known ahead of time")

    def without_observed(self, dropped) -> "ColumnRoles":
        gone = set(dropped)
        return replace(self, observed_reals=tuple(c for c in self.observed_reals if c not in gone))


@dataclass(frozen=True)
class Config:
    """Thresholds and lengths; the defaults are the reference settings."""

    raw_target: str = "daily_successful_amount_gbp"
    target: str = "tpv"
    horizon: int = 91
    max_encoder_length: int = 120
    min_encoder_length: int = 28
    val_days: int = 180
    val_stride: int = 7
    min_series_days: int = 30
    min_log_std: float = 0.20
    min_active_days: int = 20
    trim_leading_zeros: bool = True
    scale_floor: float = 0.25
    group_id_dropout: float = 0.15
    seed: int = 42
    quantiles: tuple[float, ...] = (0.02, 0.1, 0.25, 0.35, 0.5, 0.65, 0.75, 0.9, 0.98)
    report_quantiles: tuple[float, ...] = (0.35, 0.5, 0.65)
    recent_days: int = 28
    inactive_after_days: int = 7

    def __post_init__(self) -> None:
        if list(self.quantiles) != sorted(set(self.quantiles)):
            raise ValueError("quantile levels must be distinct and ascending")
        if not all(0 < q < 1 for q in self.quantiles):
            raise ValueError("quantile levels must lie strictly between 0 and 1")
        unknown = [q for q in self.report_quantiles if q not in self.quantiles]
        if unknown:
            raise ValueError(f"reported levels {unknown} are not forecast levels")
        if 0.5 not in self.quantiles:
            raise ValueError("the median must be one of the forecast levels")
        if not 1 <= self.min_encoder_length <= self.max_encoder_length:
            raise ValueError("encoder bounds must satisfy 1 <= min <= max")

    @property
    def training_window_days(self) -> int:
        return self.min_encoder_length + self.horizon
