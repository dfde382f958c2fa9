"""Factor return alignment, mean vector, covariance and correlation matrices.

The aligned table has one row per recency rank (bounded by the days in the
period); the moments are single-row global aggregates with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from montevar.functions.matrix import pair_moments


def factor_aligned(factor_returns: DataFrame, factors, key: str = "factor",
                   value: str = "fluct", order_col: str | None = None) -> DataFrame:
    """``k, <factor> ...``: the k-th newest return of each factor, ranks common to all."""
    from montevar.operators.features import recency_rank
    extra = [order_col] if order_col else []
    ranked = recency_rank(factor_returns.select(key, "date", value, *extra), key, ascending_order=order_col)
    cols = [F.max(F.when(F.col(key) == f, F.col(value))).alias(f) for f in factors]
    return ranked.groupBy("k").agg(*cols).na.drop()


def cov_name(a: str, b: str) -> str:
    return f"cov_{a}_{b}"


def factor_moments(wide: DataFrame, factors) -> DataFrame:
    """One row: ``n``, ``mean_<f>`` and sample covariances ``cov_<f>_<g>`` (f before g)."""
    d = len(factors)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(f).alias(f"mean_{f}") for f in factors]
    aggs += [F.covar_samp(factors[i], factors[j]).alias(cov_name(factors[i], factors[j]))
             for i in range(d) for j in range(i, d)]
    return wide.agg(*aggs)


def factor_moment_arrays(wide: DataFrame, factors) -> DataFrame:
    """One row: ``n``, ``mean`` (array) and ``cov`` (packed sample covariances) of any number of factors.

    The plan is the same for every number of factors; an empty table gives one row with ``n`` 0 and NULL moments.
    """
    d = len(factors)
    values = F.array(*[F.col(f).cast("double") for f in factors])
    one = pair_moments(wide.select(values.alias("_z")), [], "_z", d, {"": None}, sample=True)
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), "mean", "cov")


def factor_corr(wide: DataFrame, factors) -> DataFrame:
    """Pearson correlation matrix in long form: ``factor_a, factor_b, corr``.

    ``corr = cov / (sd_a sd_b)`` through ``try_divide``: a constant series gives
    NULL rather than failing the job.
    """
    d = len(factors)
    aggs = [F.stddev_samp(f).alias(f"sd_{f}") for f in factors]
    aggs += [F.covar_samp(factors[i], factors[j]).alias(cov_name(factors[i], factors[j]))
             for i in range(d) for j in range(i, d)]
    one = wide.agg(*aggs)
    cells = []
    for i in range(d):
        for j in range(d):
            a, b = factors[i], factors[j]
            cov = F.col(cov_name(*(sorted([a, b], key=factors.index))))
            c = F.try_divide(cov, F.col(f"sd_{a}") * F.col(f"sd_{b}"))
            cells.append(F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), c.alias("corr")))
    return one.select(F.inline(F.array(*cells)))
