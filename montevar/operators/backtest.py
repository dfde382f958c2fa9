"""Back-tests of a VaR figure against realised instrument returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: 95 % critical value of the chi-square distribution with 1 degree of freedom.
CHI2_1_CRIT_95 = 3.841459


def _risk(risk) -> Column:
    return risk if isinstance(risk, Column) else F.lit(float(risk))


def count_failures(returns: DataFrame, risk, unit: str = "reference", key: str = "symbol",
                   value: str = "fluct", date_col: str = "date") -> DataFrame:
    """One row ``failures, size``.

    ``unit='reference'``: an instrument fails when its mean return is negative and
    below ``risk``; ``size`` is the total number of observations (not instruments).
    ``unit='observation'``: every return below ``risk`` is a failure out of all returns.
    ``risk`` is a number or a scalar Column (e.g. a VaR scalar subquery).
    """
    out = count_failures_many(returns, {"_": risk}, unit, key, value, date_col)
    return out.drop("risk_measure")


def count_failures_many(returns: DataFrame, risks: dict, unit: str = "reference", key: str = "symbol",
                        value: str = "fluct", date_col: str = "date") -> DataFrame:
    """``risk_measure, failures, size`` for several risk figures in one pass over the returns; zeros without returns."""
    if unit not in ("reference", "observation"):
        raise ValueError("unit must be 'reference' or 'observation'")
    names = list(risks)
    if unit == "observation":
        aggs = [F.count(F.when(F.col(value) < _risk(risks[n]), 1)).alias(f"_f{i}") for i, n in enumerate(names)]
        one = returns.agg(*aggs, F.count(F.lit(1)).alias("size"))
    else:
        per = returns.groupBy(key).agg(F.sum(value).alias("total"), F.count(date_col).alias("cnt"))
        mean = F.try_divide(F.col("total"), F.col("cnt"))
        aggs = [F.count(F.when((mean < 0) & (mean < _risk(risks[n])), 1)).alias(f"_f{i}") for i, n in enumerate(names)]
        one = per.agg(*aggs, F.coalesce(F.sum("cnt"), F.lit(0)).alias("size"))
    cells = F.array(*[F.struct(F.lit(n).alias("risk_measure"), F.col(f"_f{i}").cast("bigint").alias("failures"))
                      for i, n in enumerate(names)])
    return one.select(F.inline(cells), F.col("size").cast("bigint").alias("size"))


def _xlogy(x: Column, y: Column) -> Column:
    """``x * ln(y)`` with the limit 0 at ``x = 0``."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def kupiec_stat(x: Column, n: Column, p: float) -> Column:
    """Kupiec proportion-of-failures likelihood-ratio statistic."""
    x, n = x.cast("double"), n.cast("double")
    q = F.try_divide(x, n)
    return -2 * ((n - x) * math.log(1 - p) + x * math.log(p)
                 - _xlogy(n - x, 1 - q) - _xlogy(x, q))


def chi2_1_pdf(s: Column) -> Column:
    """Density of the chi-square distribution with one degree of freedom."""
    return F.when(s > 0, F.exp(-s / 2) / F.sqrt(2 * math.pi * s)).otherwise(F.lit(None).cast("double"))


def binomial_z_stat(x: Column, n: Column, p: float) -> Column:
    x, n = x.cast("double"), n.cast("double")
    return F.try_divide(x - n * p, F.sqrt(n * p * (1 - p)))


def kupiec(failures: DataFrame, p: float = 0.05) -> DataFrame:
    return failures.withColumn("kupiec_pof", kupiec_stat(F.col("failures"), F.col("size"), p))


def chi2_density(failures: DataFrame, p: float = 0.05) -> DataFrame:
    """Kupiec statistic, its chi-square(1) density, and the 95 % rejection flag."""
    k = kupiec(failures, p)
    return k.withColumn("chi2_pdf", chi2_1_pdf(F.col("kupiec_pof"))) \
            .withColumn("reject", F.col("kupiec_pof") > CHI2_1_CRIT_95)


def binomial_z(failures: DataFrame, p: float = 0.05) -> DataFrame:
    return failures.withColumn("binomial_z", binomial_z_stat(F.col("failures"), F.col("size"), p))
