"""Scored composites: five factors, six sub-models and their blend, liquidity and stress composites, regimes and signals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clamp, col, geometric_mean, interpolate, ladder, normal_cdf, sigmoid, squash, weighted_mean, z_fixed

# The constants of the scoring formulas.
FACTOR_WEIGHTS = {"lt": 1.01, "st": 1.0, "rt": 0.80, "ft": 1.09, "sc": 1.10}
FACTOR_RARITY = {"lt": 0.35, "st": 0.50, "rt": 0.40, "ft": 0.25, "sc": 0.80}
BAYES_ODDS = {"lt": 2.5, "st": 2.0, "rt": 2.0, "ft": 3.0, "sc": 1.5}
EWC = {"lt": 0.25, "st": 0.20, "rt": 0.20, "ft": 0.30, "sc": 0.05}
LOGIT_ANCHORS = [(-1.0, 0.08), (-2.0, 0.20), (-3.0, 0.55), (-4.0, 0.75), (-8.0, 0.95)]
QUANTILE_ANCHORS = [(-8.0, 0.95), (-5.0, 0.75), (-3.0, 0.5), (-1.5, 0.25), (-0.5, 0.1), (0.5, 0.04), (2.0, 0.01)]
BLEND = {"m1": 0.19, "m2": 0.16, "m3": 0.12, "m4": 0.16, "m5": 0.23, "m6": 0.14}
GLF = [("fed", 5.5, 8.0, 0.30), ("ecb", 4.0, 7.0, 0.15), ("boj", 3.0, 6.0, 0.03), ("china", 9.53, 1.73, 0.04), ("m2", 6.0, 4.0, 0.15)]
GLF_STRESS = [(70.0, 0.15), (55.0, 0.30), (40.0, 0.50), (25.0, 0.70)]
CONSENSUS = {"NORMAL": 20, "STRESS": 55, "CAPITULATION": 85, "BULL": 20, "SIDEWAYS": 25, "BEAR": 60, "CRISIS": 85}


def total(parts) -> Column:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def factors(chg24, dom, put_call, fng, dvol, dxy, corr) -> dict[str, Column]:
    """Five market factors from -3 (stress) to 3 (calm)."""
    pull = squash(dxy, 100, 0.2)
    sc = F.when(col(corr) > 0.3, pull).when((col(corr) > -0.3) & (col(corr) <= 0.3), -0.5 * pull).otherwise(-pull)
    sc = sc - F.when((col(dom) > 65) & (col(corr).isNull() | (col(corr) < 0.3)), 0.5).otherwise(0.0)
    raw = {"lt": squash(chg24, 0, 0.15), "st": -squash(dom, 55, 0.2) - squash(put_call, 0.8, 2), "rt": squash(fng, 50, 0.08), "ft": -squash(dvol, 65, 0.06), "sc": sc}
    return {k: clamp(v, -3, 3) for k, v in raw.items()}


def _logit_line() -> tuple[float, float]:
    """Least squares of the logit on z over the anchors."""
    xs, ys = [z for z, _ in LOGIT_ANCHORS], [math.log(p / (1 - p)) for _, p in LOGIT_ANCHORS]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    return my - slope * mx, slope


def ensemble(f: dict[str, str]) -> dict[str, Column]:
    """Six sub-models over factor columns, their blend, agreement and zone."""
    norm = {k: col(c) / 6 for k, c in f.items()}
    z = total(w * col(f[k]) for k, w in FACTOR_WEIGHTS.items())
    below = lambda bound: total((norm[k] < bound).cast("int") for k in f)
    alarm = {k: F.when(n < -0.333, 1.0).when(n < -0.167, 0.7).when(n < 0, 0.3).otherwise(0.0) for k, n in norm.items()}
    m1 = total(alarm[k] / FACTOR_RARITY[k] for k in f) / sum(1 / r for r in FACTOR_RARITY.values())
    b0, b1 = _logit_line()
    odds = F.lit(0.08 / 0.92)
    for k, n in norm.items():
        odds = odds * F.when(n < -0.3, BAYES_ODDS[k]).otherwise(1.0)
    mean = total(norm.values()) / 5
    var = total((n - mean) * (n - mean) for n in norm.values()) / 5
    m6 = clamp(-mean * 0.72, 0.0, 0.5) + 0.15 * below(-0.167) + 0.20 * below(-0.333) + F.when((mean < -0.083) & (var < 0.12), 0.10 * (1 - var)).otherwise(0.0)
    m6 = m6 + 0.15 * (norm["ft"] < -0.25).cast("int") + 0.10 * (norm["lt"] < -0.25).cast("int")
    return {"m1": m1, "m2": sigmoid(b0 + b1 * z), "m3": odds / (1 + odds), "m4": total(w * F.abs(col(f[k])) for k, w in EWC.items()) / 3, "m5": interpolate(z, QUANTILE_ANCHORS), "m6": F.least(F.greatest(m6, F.lit(0.01)), F.lit(0.99))}


def blend(m: dict[str, str]) -> dict[str, Column]:
    score = total(w * col(m[k]) for k, w in BLEND.items())
    mean = total(col(c) for c in m.values()) / len(m)
    std = F.sqrt(total((col(c) - mean) * (col(c) - mean) for c in m.values()) / len(m))
    return {"score": score, "agreement": clamp(1 - std / 0.20, 0.0, 1.0), "zone": ladder(score, [(0.75, "CRITICAL"), (0.5, "HIGH"), (0.25, "ELEVATED")], "CALM")}


def liquidity(parts: dict[str, object], dxy) -> dict[str, Column]:
    """Weighted z scores of the parts that are there, on a scale of 0 to 100, and the stress it stands for."""
    terms = [(F.when(col(parts[k]).isNotNull(), z_fixed(parts[k], mean, sd)), w) for k, mean, sd, w in GLF if k in parts]
    terms.append((-clamp((col(dxy) - 100) / 5, -2.0, 2.0), 0.13))
    level = clamp(55 + 17.5 * weighted_mean(terms), 0.0, 100.0)
    return {"level": level, "stress": ladder(level, GLF_STRESS, 0.85)}


def regime(dvol, stress_score, sentiment, news) -> dict[str, Column]:
    """Probabilities of three regimes, and the likeliest (the first listed on ties)."""
    mood = F.when(col(sentiment) < -0.3, 0.3 * F.least(F.abs(col(sentiment)), F.lit(1.0))).otherwise(0.0)
    cap = 0.4 * F.least(col(dvol) / 120, F.lit(1.0)) + 0.3 * F.least(col(stress_score) / 60, F.lit(1.0)) + mood
    tense = 0.45 * clamp((col(dvol) - 50) / 50, 0.0, 1.0) + 0.40 * F.least(col(stress_score) / 30, F.lit(1.0)) + 0.15 * F.least(col(news) / 20, F.lit(1.0))
    tense = F.least(tense, 1 - cap)
    normal = F.greatest(F.lit(0.0), 1 - cap - tense)
    top = F.greatest(cap, tense, normal)
    return {"p_capitulation": cap, "p_stress": tense, "p_normal": normal, "regime": F.when(cap == top, "CAPITULATION").when(tense == top, "STRESS").otherwise("NORMAL")}


def kelly(cascade, squeeze, funding, agreement, stress) -> dict[str, Column]:
    """Execution risk, confidence, Kelly fraction and signal."""
    risk = F.least(0.4 * col(cascade) + 0.3 * col(squeeze) + 0.3 * F.least(10 * F.abs(col(funding)), F.lit(1.0)), F.lit(0.95))
    macro = clamp(0.30 + 0.15 * col(agreement) + 0.08 * F.greatest(F.lit(0.0), 1 - col(stress) / 100), 0.05, 0.95)
    conf = clamp(macro * (1 - risk), 0.05, 0.95)
    size = F.greatest(F.lit(0.0), (2 * conf - (1 - conf)) / 2)
    return {"risk": risk, "confidence": conf, "kelly": size, "signal": F.when((size <= 0) | (col(stress) >= 50), "CASH").when(col(stress) < 25, "BUY").otherwise("HOLD")}


def slippage(size, volume, sigma) -> Column:
    """Square-root impact plus a linear permanent part, in basis points."""
    share = col(size) / col(volume)
    return (0.5 * col(sigma) * F.sqrt(share) + 0.1 * col(sigma) * share) * 10_000


def tail_risk(parts, leverage, correlation) -> Column:
    """Geometric mean of danger dimensions (0 to 100), amplified where leverage and correlation are both high."""
    base = 100 * geometric_mean([col(p) / 100 for p in parts])
    boost = F.when((col(leverage) >= 60) & (col(correlation) >= 60), 1 + 0.25 * col(leverage) * col(correlation) / 10_000).otherwise(1.0)
    return F.least(base * boost, F.lit(100.0))


def probability_head(mean, spread, confidence, history) -> dict[str, Column]:
    """A predictive standard deviation and quantiles on 0 to 100, and the chance to exceed 50."""
    sd = clamp(F.sqrt(col(spread) * col(spread) + F.pow(15 * (1 - col(confidence)), F.lit(2)) + col(history) * col(history)), 1.0, 25.0)
    q = lambda k: clamp(col(mean) + k * sd, 0.0, 100.0)
    return {"sd": sd, "q05": q(-1.645), "q25": q(-0.674), "q75": q(0.674), "q95": q(1.645), "p_over_50": 1 - normal_cdf((50 - col(mean)) / sd)}
