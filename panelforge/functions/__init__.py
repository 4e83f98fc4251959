"""Column functions: null-safe arithmetic, labels and payload coercions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def positive_log(x: Column) -> Column:
    """Natural logarithm, null for values that are not positive."""
    return F.when(x > 0, F.log(x))


def finite(x: Column) -> Column:
    """x with infinities and NaN as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(x: Column) -> Column:
    """Text as a double, null where it is not a number."""
    return x.try_cast("double")


def truthy(*choices: Column) -> Column:
    """The first choice that is neither null nor zero, or else the last."""
    return F.coalesce(*(F.nullif(c, F.lit(0.0)) for c in choices[:-1]), choices[-1])


def has_category(categories: Column, needles: list[str]) -> Column:
    """Whether any category holds any of the needles, case ignored."""
    return F.exists(categories, lambda c: reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(n.lower())) for n in needles)))


def json_text(value: Column) -> Column:
    """Nested values as JSON text."""
    return F.to_json(value)


def sorted_map(value: Column) -> Column:
    """A map with its entries in order of their keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def stable_hash(value: Column) -> Column:
    """SHA-256 of a map's JSON text with sorted keys, the same for equal maps however they were built."""
    return F.sha2(F.to_json(sorted_map(value)), 256)


def ticker(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def evidence_tier(real_mcap: Column, real_supply: Column, anchor_supply: Column, price: Column) -> Column:
    """How a market value is known: real, price times real supply, price times anchored supply, or not at all."""
    return (
        F.when(real_mcap.isNotNull(), "1_real_mcap")
        .when(price.isNotNull() & real_supply.isNotNull(), "2_price_x_realsupply")
        .when(price.isNotNull() & anchor_supply.isNotNull(), "3_price_x_anchor")
        .otherwise("none")
    )


def leg_count(n: Column, frac: Column | float, target: Column | float, cap: float) -> Column:
    """Names of a leg: the fraction, at least one, enough to reach the target under the cap, at most n."""
    by_target = F.ceil(target / F.lit(cap)) if isinstance(target, Column) else F.ceil(F.lit(target / cap))
    return F.least(n, F.greatest(F.lit(1), F.ceil(n * frac), by_target)).cast("int")


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function to about 1e-7, by a fixed rational approximation (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    # Fixed coefficients of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-a * a / 2) / 2.5066282746310002
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """The inverse of the standard normal distribution function: a fixed rational approximation (Abramowitz and Stegun
    26.2.23, to 4.5e-4), then a step of Newton's method on ``normal_cdf``, which leaves about 1e-6."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    # Fixed coefficients of the approximation.
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    z = z - (q - (1 - normal_cdf(z))) * 2.5066282746310002 * F.exp(z * z / 2)
    return F.when(p < 0.5, -z).otherwise(z)
