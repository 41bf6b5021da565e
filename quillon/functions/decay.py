"""Forgetting curves, reinforcement, strength, salience, retention: expressions over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Model constants; fixed values.
DECAY = 0.5
FORGET_THRESHOLD = 0.1


def elapsed_days(then: Column, now: Column) -> Column:
    """Days with millisecond precision."""
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / 1000) / 86_400_000.0


def retrievability(stability: Column, days: Column) -> Column:
    """1 before any time has passed; a stability of 0 is forgotten at once."""
    return F.when(days <= 0, 1.0).when(stability == 0, 0.0).otherwise(1.0 / (1.0 + days / (9.0 * F.nullif(stability, F.lit(0.0)))))


def reinforce(stability: Column, difficulty: Column, r: Column) -> Column:
    d, p = F.least(F.greatest(difficulty, F.lit(1.0)), F.lit(10.0)), F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0))
    return stability * (1 + 0.5 * (11 - d) * F.pow(stability, F.lit(-0.2)) * F.expm1(0.2 * (1 - p)))


def forget(stability: Column, difficulty: Column) -> Column:
    return F.greatest(stability * 0.3 * (11 - difficulty) / 10, F.lit(0.01))


def harder(difficulty: Column) -> Column:
    return F.least(difficulty + 2, F.lit(10.0))


def strengthen(strength: Column) -> Column:
    return strength + F.log1p(strength) + 0.1


def archived(strength: Column, r: Column) -> Column:
    return (strength < 1) & (r < FORGET_THRESHOLD)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def salience(novelty: Column, importance: Column, emotion: Column, surprise: Column) -> Column:
    return clamp(0.4 * novelty + 0.3 * importance + 0.1 * emotion + 0.2 * surprise)


def effective_stability(stability: Column, sal: Column, beta: float = 1.0) -> Column:
    return stability * (1 + beta * clamp(sal))


def retention(age_days: Column, accesses: Column, sal: Column, superseded: Column) -> Column:
    raw = 0.3 * F.exp(-age_days / 30) + 0.3 * F.least(F.log(accesses + 1.0) / 5, F.lit(1.0)) + 0.2 * sal + 0.2 - F.when(superseded, 0.3).otherwise(0.0)
    return clamp(raw)


def tier(score: Column) -> Column:
    return F.when(score >= 0.7, "keep").when(score >= 0.3, "compress").otherwise("archive")


def replay_priority(sal: Column, r: Column, superseded: Column) -> Column:
    return F.when(superseded, 0.0).otherwise(sal * (1 - r))


def activation(ages: Column, decay: float = DECAY) -> Column:
    """Base-level activation of access ages in seconds; ages that aren't positive don't count; -20 without any."""
    total = F.aggregate(F.filter(ages, lambda a: a > 0), F.lit(0.0), lambda s, a: s + F.pow(a, F.lit(-decay)))
    return F.when(total > 0, F.log(total)).otherwise(-20.0)


def bootstrap_ages(count: Column, last: Column, now: Column, step_s: int = 3600, most: int = 20) -> Column:
    """Ages of min(max(count, 1), most) accesses, step_s apart, back from the last one."""
    base = (F.unix_micros(now) - F.unix_micros(last)) / 1e6
    n = F.least(F.greatest(count, F.lit(1)), F.lit(most)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: base + i * float(step_s))


def surprise(cos: Column, rate: Column) -> Column:
    return clamp(F.log(F.greatest(cos, F.lit(1e-10)) / F.greatest(rate, F.lit(1e-6))), -2.0, 5.0)


def edge_confidence(base: Column, age_days: Column, half_life: Column | float = 90.0) -> Column:
    return base * F.exp(-age_days * math.log(2) / half_life)
