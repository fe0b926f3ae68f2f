"""Scores of a story as column expressions; null means too little evidence, never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def niche(coverage: Column) -> Column:
    """1 for a single outlet, falling to 0 at twenty."""
    return clamp01(1 - F.log1p(F.greatest(coverage - 1, F.lit(0))) / F.log1p(F.lit(19.0)))


def novelty(age_hours: Column, late_hours: Column, domain_days: Column) -> Column:
    """Fading with a story's age, less where it was found late or its domain is well known; unknown lateness and domains count as new."""
    late = F.when(late_hours > 24 * 14, 0.3).when(late_hours > 48, 0.6).otherwise(1.0)
    known = F.when(domain_days >= 180, 0.7).when(domain_days >= 30, 0.85).otherwise(1.0)
    return clamp01(F.exp(-F.greatest(age_hours, F.lit(0.0)) / 48) * late * known)


def freshness(lag_hours: Column) -> Column:
    """100 for what arrives at once, 0 from two days on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 - lag_hours / 48 * 100, 2)))


def distance_from_similarity(similarity: Column) -> Column:
    """Bits of 64 in which signatures of texts so similar may differ."""
    return F.round((1 - similarity) * 64).cast("int")


def decayed(rank: Column, age_days: Column) -> Column:
    """A search rank that counts up to twice for what is new, and half of that surplus after thirty days."""
    return rank * (1 + 1 / (1 + age_days / 30))


def depth(chars: Column, weight: Column, primary: Column) -> Column:
    return clamp01(0.35 * F.least(F.log1p(chars) / F.log1p(F.lit(12000.0)), F.lit(1.0)) + 0.5 * weight + 0.15 * primary.cast("double"))


def tier(importance: Column, niche_score: Column, novelty_score: Column) -> Column:
    return F.when(importance >= 8, "critical").when(importance >= 6, "notable").when((niche_score >= 0.6) & (novelty_score >= 0.5), "niche").otherwise("background")


def floored_share(part: Column, whole: Column, least: int = 20) -> Column:
    """Per cent, or null under `least` observations."""
    return F.when(whole >= least, F.round(100.0 * part / whole, 2))


def composite(weights: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the dimensions that are known; null if none is."""
    known = reduce(Column.__add__, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in weights])
    return reduce(Column.__add__, [F.coalesce(c * w, F.lit(0.0)) for c, w in weights]) / F.when(known > 0, known)


def backoff(base: Column, failures: Column) -> Column:
    return F.least(base * F.pow(F.lit(2.0), F.least(failures, F.lit(6))), F.lit(86400.0))


def health(failures: Column) -> Column:
    return F.when(failures >= 40, "dead").when(failures >= 10, "failing").when(failures >= 3, "degraded").otherwise("ok")
