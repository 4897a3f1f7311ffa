"""Free energies of alternative states combined: dG = -RT ln(sum exp(-dG_i / RT)), shifted by the largest term."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dna import _col

#: The gas constant in kcal / (mol K), and 0 degrees Celsius in K.
GAS_CONSTANT, ZERO_CELSIUS = 0.00198720425864083, 273.15


def _rt(temp_c: float) -> float:
    kelvin = float(temp_c) + ZERO_CELSIUS
    if not math.isfinite(kelvin) or kelvin <= 0:
        raise ValueError(f"invalid temperature: {temp_c} degrees Celsius")
    return GAS_CONSTANT * kelvin


def _finite(dg: Column) -> Column:
    """The value, or an error: not a number, infinite and null can't be combined."""
    good = dg.isNotNull() & ~F.isnan(dg) & (F.abs(dg) < float("inf"))
    return F.when(good, dg).otherwise(F.raise_error(F.lit("free energies must be finite")).cast("double"))


def combined_delta_g(values, temp_c: float = 37.0) -> Column:
    """Of an array column. Null in, null out; an empty array is an error."""
    rt, values = _rt(temp_c), _col(values)
    terms = F.transform(values, lambda x: -_finite(x.cast("double")) / rt)
    some = F.assert_true(F.size(values) > 0, F.lit("at least one free energy is needed")).isNull()
    most = F.array_max(terms)
    summed = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + F.exp(x - most))
    return F.when(values.isNotNull() & some, -rt * (most + F.log(summed)))


#: Terms are summed relative to the nearest multiple of this: far enough apart that a group has few of them, and no sum overflows.
STEP = 64.0


def delta_g_by_group(df: DataFrame, keys: list[str], value: str, temp_c: float = 37.0, into: str = "delta_g") -> DataFrame:
    """One row a group, from partial aggregates alone: each group's terms are first summed by multiples of STEP near them, so
    that a group leaves a task as a few rows, whatever its size; then those sums are combined relative to the largest."""
    rt = _rt(temp_c)
    terms = df.select(*keys, (-_finite(F.col(value).cast("double")) / rt).alias("_x")).withColumn("_near", F.rint(F.col("_x") / STEP) * STEP)
    sums = terms.groupBy(*keys, "_near").agg(F.sum(F.exp(F.col("_x") - F.col("_near"))).alias("_sum"))
    most = F.array_max(F.transform("_sums", lambda s: s["_near"]))
    total = F.aggregate("_sums", F.lit(0.0), lambda acc, s: acc + s["_sum"] * F.exp(s["_near"] - F.col("_most")))
    grouped = sums.groupBy(*keys).agg(F.collect_list(F.struct("_near", "_sum")).alias("_sums")).withColumn("_most", most)
    return grouped.select(*keys, (-rt * (F.col("_most") + F.log(total))).alias(into))


def delta_g_aggregate(temp_c: float = 37.0):
    """The same as an aggregate function for small groups: combine = delta_g_aggregate(); df.groupBy(k).agg(combine(x))."""
    rt = _rt(temp_c)

    @F.pandas_udf("double")
    def combine(values: pd.Series) -> float:
        if not len(values) or not all(map(math.isfinite, values.fillna(math.nan))):
            raise ValueError("free energies must be finite, and at least one is needed")
        terms = -values.astype(float) / rt
        most = float(terms.max())
        return -rt * (most + math.log(sum(math.exp(x - most) for x in terms)))

    return combine
