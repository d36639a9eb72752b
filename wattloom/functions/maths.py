"""Numeric rules as plain expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_DIAMETER_KM = 12742.0
# Names of the eight directions, clockwise from north.
OCTANTS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def finite(x: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * EARTH_DIAMETER_KM


def bearing(lat: Column, lon: Column, plat: Column, plon: Column) -> Column:
    """Degrees clockwise from north of a point as seen from a place (flat approximation)."""
    return F.pmod(F.degrees(F.atan2((lon - plon) * F.cos(F.radians(plat)), lat - plat)) + 360, F.lit(360.0))


def octant(degrees: Column) -> Column:
    i = F.floor(F.pmod(degrees + 22.5, F.lit(360.0)) / 45).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in OCTANTS]), i + 1)


def bound_from_solution(flow: Column, rhs: Column, lhs: Column, factor: Column) -> Column:
    """Flow at which the equation would just hold, the other terms held."""
    return flow + (rhs - lhs) / F.nullif(factor, F.lit(0.0))


def pinball(y: Column, q: Column, tau: float) -> Column:
    e = y - q
    return F.greatest(F.lit(tau) * e, F.lit(tau - 1) * e)


def interval_score(y: Column, lo: Column, hi: Column, alpha: float) -> Column:
    zero = F.lit(0.0)
    return (hi - lo) + F.greatest(lo - y, zero) * (2 / alpha) + F.greatest(y - hi, zero) * (2 / alpha)


def weighted_interval_score(y: Column, median: Column, lo: Column, hi: Column, alpha: float) -> Column:
    """Median error and one central interval, weighted 1/2 and alpha/2, over 1.5."""
    return (F.abs(y - median) * 0.5 + interval_score(y, lo, hi, alpha) * (alpha / 2)) / 1.5


def crps(members: Column, y: Column) -> Column:
    """mean|x - y| - mean|x - x'|/2 from one sorted pass, without forming pairs."""
    n = F.size(members)
    near = F.aggregate(members, F.lit(0.0), lambda s, x: s + F.abs(x - y)) / n
    order = F.array_sort(members)
    # sum over pairs |xi - xj| = 2 * sum (2i - n + 1) x_(i), i from 0
    spread = F.aggregate(F.transform(order, lambda x, i: x * (2 * i - n + 1).cast("double")), F.lit(0.0),
                         lambda s, x: s + x)
    return near - spread / (n * n)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function from the complementary error function's
    rational Chebyshev fit (fractional error below 1.2e-7 everywhere)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the published fit, lowest order first.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398,
           1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = F.lit(c) + t * poly
    erfc = t * F.exp(-x * x + poly)
    return F.when(z >= 0, 1 - erfc / 2).otherwise(erfc / 2)


def bachelier_call(mu: Column, sd: Column) -> Column:
    """Expected positive part of a normal variable; max(mu, 0) without spread."""
    z = mu / F.nullif(sd, F.lit(0.0))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(sd > 0, sd * density + mu * normal_cdf(z)).otherwise(F.greatest(mu, F.lit(0.0)))


def relative_difference(a: Column, b: Column, floor: float) -> Column:
    return (a - b) / F.greatest(F.abs(a) + F.abs(b), F.lit(floor))
