"""Every window, threshold and grid in one frozen object that is passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleanConfig:
    max_ffill: int = 3
    z_window: int = 63
    z_threshold: float = 5.0
    iqr_multiplier: float = 1.5

    @property
    def z_min_periods(self) -> int:
        return max(20, self.z_window // 3)


@dataclass(frozen=True)
class FeatureConfig:
    return_windows: tuple[int, ...] = (1, 2, 3, 5, 10, 21)
    sma_windows: tuple[int, ...] = (10, 20, 50, 200)
    ema_windows: tuple[int, ...] = (12, 26)
    macd: tuple[int, int, int] = (12, 26, 9)
    rsi_period: int = 14
    stochastic: tuple[int, int] = (14, 3)
    roc_windows: tuple[int, ...] = (5, 20)
    vol_windows: tuple[int, ...] = (5, 10, 21, 63)
    atr_period: int = 14
    bollinger: tuple[int, float] = (20, 2.0)
    volume_z_window: int = 21
    obv_window: int = 21
    year_window: int = 252
    lags: tuple[int, ...] = (1, 2, 3, 5)
    month_edge: int = 2

    @property
    def warmup(self) -> int:
        return max(self.sma_windows) - 1


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.70
    val: float = 0.15


@dataclass(frozen=True)
class SentimentConfig:
    close_hour: int = 16
    bullish: float = 0.15
    bearish: float = -0.15
    momentum_window: int = 3
    volume_window: int = 7
    batch_size: int = 32


@dataclass(frozen=True)
class PortfolioConfig:
    risk_free: float = 0.04
    cap: float = 0.20
    candidates: int = 20_000
    frontier_points: int = 60
    backtest_days: int = 252
    model_weight: float = 0.5
    horizon: int = 21
    recent_days: int = 45
    block: int = 20
    resamples: int = 1000
    seed: int = 42


@dataclass(frozen=True)
class RecommendConfig:
    forecast: float = 0.5
    sentiment: float = 0.3
    risk: float = 0.2
    buy: float = 0.15
    sell: float = -0.15
    band: float = 0.05


@dataclass(frozen=True)
class EngineConfig:
    """Universe roles plus the parameter blocks of each operator family."""

    universe: tuple[str, ...] = ()
    benchmark: str = ""
    volatility_index: str = ""
    target_kind: str = "log_return"
    horizon: int = 1
    sequence_length: int = 60
    beta_window: int = 252
    beta_min_periods: int = 60
    clean: CleanConfig = field(default_factory=CleanConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    sentiment: SentimentConfig = field(default_factory=SentimentConfig)
    portfolio: PortfolioConfig = field(default_factory=PortfolioConfig)
    recommend: RecommendConfig = field(default_factory=RecommendConfig)


TRADING_DAYS = 252
