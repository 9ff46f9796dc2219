"""Distances and scores as column expressions. NaN is turned into null on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's radius, the distance that halves nearness, the distance from its own city that makes a facility suspect, weights and ranks of verdicts.
EARTH_RADIUS_KM = 6371.0088
HALF_DISTANCE_KM = 30.0
MISMATCH_KM = 75.0
VERDICT_BASE = {"corroborated": 1.0, "claimed_only": 0.5, "insufficient_evidence": 0.0}
VERDICT_RANK = {"corroborated": 0, "claimed_only": 1, "insufficient_evidence": 2}
IMPLAUSIBLE_TYPES = ["dentist", "pharmacy", "farmacy"]


def number(c: Column) -> Column:
    """A finite double, or null."""
    x = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def rounded(c: Column, digits: int) -> Column:
    """The double rounded to so many decimals by its exact binary value, halves to even: 2.675, which lies below its decimal text, gives 2.67.

    The product with the power of ten and its error (by splitting the factors in halves) are exact together, so the side of the half is known.
    """
    scale = float(10**digits)
    high_scale = (134217729.0 * scale) - (134217729.0 * scale - scale)
    x = F.abs(c.cast("double"))
    p = x * scale
    high = 134217729.0 * x - (134217729.0 * x - x)
    low = x - high
    error = ((high * high_scale - p) + high * (scale - high_scale) + low * high_scale) + low * (scale - high_scale)
    whole = F.floor(p).cast("double")
    beyond = (p - whole - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 == 1))
    near = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(x >= 2**52 / scale, c.cast("double")).otherwise(near * F.signum(c.cast("double")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))  # least() passes over nulls


def proximity(distance: Column, mismatch: Column | None = None) -> Column:
    near = 1 / (1 + F.pow(distance / HALF_DISTANCE_KM, 2))
    return near if mismatch is None else near * F.when(mismatch >= MISMATCH_KM, 0.5).otherwise(1.0)


def by_verdict(verdict: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(verdict == k, F.lit(v)).otherwise(out)
    return out


def evidence(verdict: Column, readiness: Column) -> Column:
    return 0.5 * by_verdict(verdict, VERDICT_BASE, 0.0) + 0.5 * F.coalesce(number(readiness), F.lit(0.0))


def composite(evidence_score: Column, proximity_score: Column, facility_type: Column | None = None) -> Column:
    both = 0.6 * evidence_score + 0.4 * proximity_score
    if facility_type is None:
        return both
    odd = F.lower(F.trim(F.coalesce(facility_type, F.lit("")))).isin(IMPLAUSIBLE_TYPES)
    return both * F.when(odd, 0.2).otherwise(1.0)


def on_earth(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)
