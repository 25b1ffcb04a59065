"""Trading costs as column expressions over a named profile."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    half_spread_bps: float = 1.0
    slippage_bps: float = 2.0
    impact: float = 0.1
    per_share: float = 0.0
    minimum: float = 0.0
    share_of_value: float = 0.0
    max_participation: float = 0.01
    borrow_bps: float = 50.0
    shorts: bool = False

    def scaled(self, k: float) -> Costs:
        """All frictions times k; limits stay."""
        names = ("half_spread_bps", "slippage_bps", "impact", "per_share", "minimum", "share_of_value", "borrow_bps")
        return replace(self, **{n: getattr(self, n) * k for n in names})

    def zero(self) -> Costs:
        return self.scaled(0.0)

    def price_impact(self, notional: Column, adv: Column, vol: Column) -> Column:
        """Fractional adverse move: spread, slippage and square-root impact; unknown volatility counts as 2 %."""
        share = F.when(adv > 0, F.least(notional / adv, F.lit(1.0))).otherwise(1.0)
        move = F.lit((self.half_spread_bps + self.slippage_bps) / 1e4) + F.lit(self.impact) * F.coalesce(vol, F.lit(0.02)) * F.sqrt(share)
        return F.when(F.abs(notional) > 0, move).otherwise(0.0)

    def commission(self, notional: Column, shares: Column) -> Column:
        paid = F.greatest(F.lit(self.minimum), F.lit(self.per_share) * F.abs(shares)) + F.lit(self.share_of_value) * F.abs(notional)
        return F.when(F.abs(notional) > 0, paid).otherwise(0.0)

    def round_trip(self, notional: Column, price: Column, adv: Column, vol: Column) -> Column:
        return 2 * (self.price_impact(notional, adv, vol) + self.commission(notional, F.abs(notional) / price) / F.abs(notional))


#: Named profiles.
PROFILES = {
    "retail_etf": Costs(1.0, 2.0, 0.1),
    "retail_largecap": Costs(3.0, 3.0, 0.1),
    "retail_smallcap": Costs(20.0, 10.0, 0.2, max_participation=0.005),
    "per_share_broker": Costs(2.0, 2.0, 0.1, per_share=0.005, minimum=1.0),
    "frictionless": Costs(0.0, 0.0, 0.0),
}


def profile(name: str) -> Costs:
    if name not in PROFILES:
        raise KeyError(f"unknown cost profile {name!r}")
    return PROFILES[name]
