"""Parameters of the operators, with the cross-field checks that keep them usable."""

from __future__ import annotations

from dataclasses import dataclass

# The model's input columns, in the order the sequences hold them.
MODEL_FEATURES = (
    "open", "high", "low", "close", "volume",
    "return_1d", "volatility_5d", "volatility_20d",
    "rsi", "macd", "macd_signal",
    "short_trend_slope", "long_trend_slope",
    "short_trend_strength", "long_trend_strength",
    "trend_agreement", "ma_convergence",
)

KINDS = ("short", "long")


@dataclass(frozen=True)
class TrendParams:
    short_window: int = 5
    long_window: int = 25
    lookback: int = 60
    trend_threshold: float = 0.001
    volatility_window: int = 20
    ensemble_size: int = 5
    min_data_points: int = 100

    def __post_init__(self):
        if not 0 < self.short_window < self.long_window < self.lookback:
            raise ValueError("need 0 < short_window < long_window < lookback")
        if not 0 <= self.trend_threshold:
            raise ValueError("trend_threshold must not be negative")
        if self.ensemble_size < 1:
            raise ValueError("ensemble_size must be positive")
        if self.min_data_points < 1:
            raise ValueError("min_data_points must be positive")

    def window(self, kind: str) -> int:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
        return self.short_window if kind == "short" else self.long_window

    def slope_rows(self, kind: str) -> int:
        """How many moving-average values the slope of this kind is fitted on."""
        self.window(kind)
        return 3 if kind == "short" else 5


@dataclass(frozen=True)
class SplitParams:
    train_ratio: float = 0.8
    validation_ratio: float = 0.1
    test_ratio: float = 0.1
    min_train_rows: int = 100
    min_other_rows: int = 10

    def __post_init__(self):
        if abs(self.train_ratio + self.validation_ratio + self.test_ratio - 1.0) > 0.01:
            raise ValueError("the three ratios must sum to 1")

    @property
    def head_ratio(self) -> float:
        """Share of a series in front of its test part."""
        return 1.0 - (1.0 - self.train_ratio - self.validation_ratio)

    @property
    def train_share_of_head(self) -> float:
        return 1.0 - self.validation_ratio / (self.train_ratio + self.validation_ratio)


@dataclass(frozen=True)
class LearnParams:
    lookback: int = 60
    hidden_layers: tuple = (64, 32, 16)
    max_iter: int = 100
    # A classifier is judged after so many iterations, and trained on while one of the last
    # `patience` judgements was the best so far.
    step_iter: int = 20
    patience: int = 2
    tree_iter: int = 20
    tree_depth: int = 4
    seed: int = 42
    # Models are fitted on all training rows. Only who asks for a number of rows here has them
    # fitted on about so many, chosen by a hash; no query does.
    fit_rows: int | None = None

    def __post_init__(self):
        asked = () if self.fit_rows is None else (self.fit_rows,)
        if min(self.lookback, self.max_iter, self.step_iter, self.patience, self.tree_iter, *asked) < 1:
            raise ValueError("lookback, iterations, patience and fit_rows must be positive")
