"""Constants and cost terms shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Conventions the results depend on.
QUARTERS = 28
DAYS_PER_QUARTER = 91.3125
LEAD_CV = 0.3
QUANTILE_LEVELS = (0.5, 0.8, 0.9, 0.95, 0.99)
DEFAULT_SBA_ALPHA = 0.1
DEFAULT_SES_ALPHA = 0.5
DEFAULT_PRICE = 1.0
DEFAULT_LEAD_DAYS = 60.0
SEGMENT_LEVELS = ("Smooth", "Erratic", "Intermittent", "Lumpy")
ABC_LEVELS = ("A", "B", "C")
STRATEGY_LEVELS = (
    "Strategy 1", "Strategy 2", "Strategy 3", "Strategy 4", "Strategy 5", "Other",
)
HIGH_CRITICALITY = ("critical", "high", "1")
LOW_CRITICALITY = ("low", "3")
RETIRED_STATUS = ("Obsolete", "Scrapped", "Inactive")
MODELS = ("SBA", "SES", "MA", "CROSTON", "TSB", "ADIDA", "IMAPA", "ZIP", "HURDLE_NB")
SCALE_FAMILY = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
PRICE_THRESHOLDS = (100, 200, 400, 800, 1200, 1600, 2400, 3200, 6400, 12800)
BAND_PROBS = (0.0, 0.5, 0.8, 0.9, 0.95, 0.97, 0.99, 1.0)
HOLDING_RATES = (0.15, 0.20, 0.25, 0.30, 0.35)
ORDER_COSTS = (25.0, 50.0, 100.0, 250.0)
STOCKOUT_COSTS = (50.0, 100.0, 250.0, 500.0)
SERVICE_SCENARIOS = (
    # name, high, mid, low criticality targets
    ("default", 0.99, 0.97, 0.95),
    ("conservative", 0.99, 0.99, 0.99),
    ("aggressive", 0.90, 0.90, 0.90),
    ("highly_tiered", 0.995, 0.97, 0.90),
    ("flat95", 0.95, 0.95, 0.95),
)
LEAD_CV_GRID = (0.1, 0.3, 0.5)
ARMS = (
    # name, training quarters, first test quarter (0-based), test end, initial stock
    ("S/H4", 16, 16, 20, "S"),
    ("mid/H4", 16, 16, 20, "mid"),
    ("s/H4", 16, 16, 20, "s"),
    ("zero/H4", 16, 16, 20, "zero"),
    ("train12/S/H4", 12, 12, 16, "S"),
    ("train12/mid/H4", 12, 12, 16, "mid"),
    ("S/H8", 12, 12, 20, "S"),
    ("mid/H8", 12, 12, 20, "mid"),
    ("zero/H8", 12, 12, 20, "zero"),
)


@dataclass(frozen=True)
class Window:
    """Train on quarters [0, train), test on [start, end) of the series array."""

    train: int = 16
    start: int = 16
    end: int = 20

    @property
    def horizon(self) -> int:
        return self.end - self.start


CLEAN = Window(16, 16, 20)
SHORT = Window(12, 12, 16)
LONG_TEST = Window(12, 12, 20)
LATE = Window(20, 20, 28)


@dataclass(frozen=True)
class CostTerms:
    """Money and service parameters of the stocking policy."""

    holding_rate: float = 0.25
    order_cost: float = 50.0
    stockout_cost: float = 100.0
    quarters_per_year: int = 4
    sl_high: float = 0.99
    sl_mid: float = 0.97
    sl_low: float = 0.95

    @property
    def holding_per_quarter(self) -> float:
        return self.holding_rate / self.quarters_per_year

    @property
    def crossover_price(self) -> float:
        """Unit price at which a quarter's holding equals one unit short."""
        return self.stockout_cost / self.holding_per_quarter
