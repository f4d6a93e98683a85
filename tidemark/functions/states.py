"""Rule-based classifiers of market states as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clamp, col, ladder

# The dollar basket's constant and exponents.
BASKET = 50.14348112
BASKET_POWERS = {"eur": -0.576, "jpy": 0.136, "gbp": -0.119, "cad": 0.091, "sek": 0.042, "chf": 0.036}
# Factor weights by regime.
REGIME_WEIGHTS = {
    "NORMAL": {"lt": 0.25, "st": 0.20, "rt": 0.20, "ft": 0.20, "sc": 0.15},
    "STRESS": {"lt": 0.25, "st": 0.15, "rt": 0.15, "ft": 0.30, "sc": 0.15},
    "CAPITULATION": {"lt": 0.15, "st": 0.10, "rt": 0.10, "ft": 0.40, "sc": 0.25},
}


def basket(rates: dict[str, object]) -> Column:
    """The geometric dollar basket of six rates; null if one is missing or not positive."""
    fine = reduce(Column.__and__, [F.coalesce(col(c) > 0, F.lit(False)) for c in rates.values()])
    product = reduce(Column.__mul__, [F.pow(col(c), F.lit(BASKET_POWERS[k])) for k, c in rates.items()])
    return F.when(fine, BASKET * product)


def transmission(liquidity, structure, change) -> dict[str, Column]:
    """Whether liquidity reaches the market: four corners of two stresses in 0..1, and how sure that is."""
    loose, tight = col(liquidity) < 0.40, col(liquidity) >= 0.60
    strong, weak = col(structure) < 0.40, col(structure) >= 0.60
    status = F.when(col(liquidity).isNull() | col(structure).isNull(), "UNAVAILABLE")
    for where, label in ((loose & strong, "STRENGTHENING"), (loose & weak, "TRANSMISSION_GAP"), (tight & strong, "DIVERGENCE"), (tight & weak, "DISTRESS_CASCADE")):
        status = status.when(where, label)
    edges = (loose | tight).cast("int") + (strong | weak).cast("int")
    up, down = (col(change) >= 0) & ~weak, (col(change) < 0) & ~strong
    moved = F.least(F.lit(0.95), 0.5 + 0.25 * edges + 0.10 * up.cast("int") - 0.10 * down.cast("int"))
    return {"status": status.otherwise("TRANSMITTING"), "confidence": F.when(col(change).isNull(), 0.5 + 0.25 * edges).otherwise(moved)}


def guard(risk) -> Column:
    """How much of a position a transition risk leaves."""
    return ladder(risk, [(0.60, 0.0), (0.50, 0.5)], 1.0)


def _lowest(x, steps, names) -> Column:
    """The name of the first step at or under which x lies."""
    out = None
    for bound, name in zip(steps, names, strict=True):
        hit = col(x) <= bound
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _highest(x, steps, names) -> Column:
    out = None
    for bound, name in zip(steps, names, strict=True):
        hit = col(x) >= bound
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def evidence(positioning, greed, cascade, divergence, flow, whale, regime) -> dict[str, Column]:
    """Bullish and bearish evidence from what is there, and the state of behaviour that it adds up to."""
    bull = [
        _highest(positioning, (75, 60), ("crowded_long", "positioned_long")), _highest(greed, (85, 70), ("extreme_greed", "greed")),
        F.when(col(flow) >= 0.65, "inflow"), F.when(col(whale) >= 0.65, "whale_buying"), F.when(col(regime) == "BULL", "regime_bull"),
    ]
    bear = [
        _lowest(positioning, (25, 40), ("positioned_short", "positioned_weak")), _lowest(greed, (15, 25), ("extreme_fear", "fear")),
        _highest(cascade, (0.5, 0.25), ("cascade_high", "cascade_elevated")), F.when(col(flow) <= 0.35, "outflow"), F.when(col(whale) <= 0.35, "whale_selling"),
        F.when(col(regime).isin("BEAR", "CRISIS"), "regime_bad"),
    ]
    up, down = F.array_compact(F.array(*bull)), F.array_compact(F.array(*bear))
    has = lambda side, *names: reduce(Column.__or__, [F.array_contains(side, n) for n in names])
    fear = has(down, "fear", "extreme_fear")
    div = F.coalesce(col(divergence), F.lit(""))
    n_up, n_down = F.size(up), F.size(down)
    state = (
        F.when(has(down, "cascade_high") | F.coalesce(col(regime) == "CRISIS", F.lit(False)), "PANIC")
        .when(has(up, "extreme_greed", "crowded_long") & (div != "HIDDEN_DISTRIBUTION"), "EUPHORIA")
        .when((div == "HIDDEN_DISTRIBUTION") | has(down, "outflow") & has(up, "positioned_long") | has(down, "whale_selling") & has(up, "greed"), "DISTRIBUTION")
        .when((div == "HIDDEN_ACCUMULATION") | has(up, "inflow", "whale_buying") & fear, "ACCUMULATION")
        .when((n_down >= 3) & (n_up == 0), "PANIC")
        .when((n_up >= 1) & (n_down <= 1), "EXPANSION")
        .when(n_up > n_down, "ACCUMULATION")
        .when(n_down > n_up, "DISTRIBUTION")
        .otherwise("EXPANSION")
    )
    return {"n_bull": n_up, "n_bear": n_down, "state": state}


def price_state(volatility, stress, price, floor) -> Column:
    return (
        F.when(col(volatility).isNull() | col(stress).isNull(), "NORMAL OSCILLATION")
        .when((col(volatility) >= 100) & (col(price) <= col(floor) * 1.05), "TURNING POINT")
        .when((col(volatility) < 40) & (col(stress) > 30), "DISSIPATIVE SLIDE")
        .when(col(stress) > 50, "STRUCTURAL DECAY")
        .when(col(volatility) > 80, "VOLATILITY BREAKDOWN")
        .otherwise("NORMAL OSCILLATION")
    )


def price_floor(price, stress) -> Column:
    """The price less a drawdown that grows with stress, 48 % at most."""
    return F.floor(col(price) * (1 - F.least(col(stress) / 100.0, F.lit(0.8)) * 0.6))


def augmented(x) -> dict[str, Column]:
    """The square, the logarithm where there is one, and a sigmoid of a feature in 0..1."""
    return {"squared": col(x) * col(x), "logged": F.when(col(x) > 0, F.ln(F.greatest(col(x), F.lit(1e-10)))), "curved": 1.0 / (1.0 + F.exp(2.5 - 5 * col(x)))}


def stress_norm(factor) -> Column:
    """A factor of -3..3 (calm is positive) as stress in 0..1."""
    return clamp((3.0 - col(factor)) / 6.0, 0.0, 1.0)
