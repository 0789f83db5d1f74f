"""Strategy parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class StrategyConfig:
    """One configuration; the defaults are fixed values."""

    strategy: str = "rsi"
    ma_window: int = 20
    support_lookback: int = 20
    ma_discount: float = 0.05
    rsi_window: int = 14
    atr_window: int = 14
    rsi_oversold: float = 45.0
    tp_mult: float = 1.5
    sl_mult: float = 1.0
    sma_trend: int = 200
    volume_lookback: int = 20
    min_dollar_volume: float = 5_000_000.0
    earnings_warning_days: int = 14
    decline_days: int = 5
    decline_penalty: float = 1.5
    decline_penalty_cap: float = 30.0
    rrr_weight: float = 40.0
    rrr_cap: float = 4.0
    rsi_weight: float = 40.0
    rsi_floor: float = 30.0
    rsi_ceiling: float = 60.0
    distance_weight: float = 20.0
    distance_cap: float = 20.0
    strong_buy_above: float = 80.0
    buy_from: float = 60.0
    watch_from: float = 40.0
    share_decimals: int = 4
    sector_cap: float = 0.40
    max_holding: int = 15
    slippage: float = 0.001
    commission: float = 0.0
    max_entry_wait: int = 5
    breakout_lookback: int = 20
    breakout_rsi_max: float = 100.0
    breakout_relative_strength_min: float = -100.0
    breakout_volume_ratio_min: float = 0.0
    adx_window: int = 14
    breakout_adx_min: float = 0.0
    obv_window: int = 20
    breakout_obv_min: float = -100.0
    bb_window: int = 20
    squeeze_window: int = 60
    breakout_squeeze_max: float = 100.0
    pullback_ma: int = 20
    pullback_slope: int = 10
    pullback_band: float = 3.0
    retest_window: int = 10
    retest_band: float = 3.0
    week52_lookback: int = 252
    week52_nearness: float = 5.0

    @classmethod
    def from_dict(cls, values: dict) -> StrategyConfig:
        """Missing keys take defaults; unknown keys are an error."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown configuration keys: {sorted(unknown)}")
        return cls(**values)

    def loosened(self) -> StrategyConfig:
        """The same with the six breakout filters switched off."""
        off = {f.name: f.default for f in fields(self) if f.name.startswith("breakout_") and f.name != "breakout_lookback"}
        return replace(self, **off)


STRATEGIES = ("rsi", "breakout", "pullback", "retest", "week52")
